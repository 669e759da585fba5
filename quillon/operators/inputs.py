"""Factors from side tables: valuation, money flow, shares, themes, tradeability events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.windows import div
from .asof import interval_join_by_month
from .families import KEYS, Family, _plus


def inverse(c: str) -> Column:
    return div(F.lit(1.0), F.when(F.col(c) > 0, F.col(c)))


def log(c: str) -> Column:
    return F.log(F.when(F.col(c) > 0, F.col(c)))


VALUATION = ("turnover_rate", "turnover_rate_f", "volume_ratio", "turnover_rate_low", "turnover_rate_f_low", "volume_ratio_low", "pe_ttm_inverse", "pb_inverse", "ps_ttm_inverse", "dv_ttm", "total_mv_log", "circ_mv_log")


def valuation(inputs: DataFrame) -> DataFrame:
    """A projection: the inputs, their negatives, inverses of positive multiples, logs of positive sizes."""
    c = F.col
    made = {"turnover_rate_low": -c("turnover_rate"), "turnover_rate_f_low": -c("turnover_rate_f"), "volume_ratio_low": -c("volume_ratio"), "pe_ttm_inverse": inverse("pe_ttm"), "pb_inverse": inverse("pb"), "ps_ttm_inverse": inverse("ps_ttm"), "total_mv_log": log("total_mv"), "circ_mv_log": log("circ_mv")}
    return inputs.withColumns(made).select(*KEYS, *VALUATION)


FLOWS = tuple(f"{side}_{size}_amount" for side in ("buy", "sell") for size in ("sm", "md", "lg", "elg"))
MONEYFLOW = ("net_mf_amount_ratio", "large_order_net_amount_ratio", "extra_large_order_net_amount_ratio", "small_order_sell_pressure")


def moneyflow(inputs: DataFrame) -> DataFrame:
    """Net flows over all flows, and their negatives (``_low``)."""
    c = F.col
    total = sum((F.abs(c(f)) for f in FLOWS[1:]), F.abs(c(FLOWS[0])))
    parts = {
        "net_mf_amount_ratio": c("net_mf_amount"),
        "large_order_net_amount_ratio": c("buy_lg_amount") + c("buy_elg_amount") - c("sell_lg_amount") - c("sell_elg_amount"),
        "extra_large_order_net_amount_ratio": c("buy_elg_amount") - c("sell_elg_amount"),
        "small_order_sell_pressure": c("sell_sm_amount") - c("buy_sm_amount"),
    }
    df = inputs.withColumn("total_flow", F.when(total > 0, total))
    df = df.withColumns({n: div(v, "total_flow") for n, v in parts.items()})
    return df.withColumns({f"{n}_low": -c(n) for n in MONEYFLOW}).select(*KEYS, *MONEYFLOW, *[f"{n}_low" for n in MONEYFLOW])


#: Fixed names of the basket factors; each has a negative (``_low``).
BASKET_FLOW = ("etf_net_mf_amount_ratio", "etf_large_order_net_amount_ratio", "etf_extra_large_order_net_amount_ratio", "etf_small_order_sell_pressure", "etf_net_mf_positive_weight")


def basket_flow(ratios: DataFrame, baskets: DataFrame) -> DataFrame:
    """Money flow of a fund's stocks, weighted by the basket known on the date; one row per fund and date.

    ``ratios`` is what moneyflow() gives; ``baskets`` has fund_symbol, asset_id (of the stock), known_date, end_date and
    weight. Sums are over the weights of the stocks that have flows that day; a missing ratio adds nothing but its weight.
    """
    held = interval_join_by_month(ratios.select("asset_id", "date", *MONEYFLOW), baskets.select("fund_symbol", "asset_id", "known_date", "end_date", "weight"), ["asset_id"], "date", "known_date", "end_date")
    weighted = {n: F.coalesce(F.sum(F.col("weight") * F.col(r)), F.lit(0.0)) for n, r in zip(BASKET_FLOW, MONEYFLOW)}
    positive = F.sum(F.when(F.col("net_mf_amount_ratio") > 0, F.col("weight")).otherwise(0.0))
    sums = held.groupBy("date", "fund_symbol").agg(F.sum("weight").alias("basket_weight_sum"), F.count_distinct("asset_id").alias("constituent_count"), *[c.alias(n) for n, c in weighted.items()], positive.alias(BASKET_FLOW[-1]))
    whole = F.when(F.col("basket_weight_sum") > 0, F.col("basket_weight_sum"))
    out = sums.withColumns({n: div(n, whole) for n in BASKET_FLOW})
    return out.withColumns({f"{n}_low": -F.col(n) for n in BASKET_FLOW})


SHARE_SIZE = ("share_change_1d", "share_change_1d_low", "size_change_1d", "size_change_1d_low", "nav_premium_discount", "nav_premium_discount_low", "total_share_log", "total_size_log")


def share_size(inputs: DataFrame) -> DataFrame:
    """Stored changes where the table has them, else changes to the row before; premium of price to asset value."""
    have = set(inputs.columns)
    base = {
        "share_change_1d": F.col("share_change_1d") if "share_change_1d" in have else w.change("total_share"),
        "size_change_1d": F.col("size_change_1d") if "size_change_1d" in have else w.change("total_size"),
        "nav_premium_discount": F.col("nav_premium_discount") if "nav_premium_discount" in have else div("close", F.when(F.col("nav") > 0, F.col("nav"))) - 1,
    }
    df = inputs.withColumns(base | {"total_share_log": log("total_share"), "total_size_log": log("total_size")})
    return df.withColumns({f"{n}_low": -F.col(n) for n in base}).select(*KEYS, *SHARE_SIZE)


THEME = ("theme_momentum_breadth", "theme_relative_strength", "theme_rank_strength", "theme_member_leadership", "theme_laggard_reversal", "theme_risk_adjusted_strength")


def theme_breadth(bars: DataFrame, theme: str = "industry", n: int = 60, least: int = 2) -> DataFrame:
    """Momentum of themes against their market; a theme needs ``least`` members, a market two such themes."""
    key = ["date", "market", theme]
    df = w.steps(bars, {"ret": w.change("adj_close"), "momentum": w.change("adj_close", n)}, {"volatility": w.std("ret", n)})
    stats = df.where("momentum is not null").groupBy(*key).agg(F.avg("momentum").alias("t_mean"), F.median("momentum").alias("t_median"), F.count(F.lit(1)).alias("t_n"), F.sum("momentum").alias("t_sum"), F.avg((F.col("momentum") > 0).cast("double")).alias("t_up"), F.avg("volatility").alias("t_vol"))
    market = w.cross()
    ok = F.col("t_n") >= least
    stats = stats.withColumns({"m_mean": F.sum("t_sum").over(market) / F.sum("t_n").over(market), "ranked": F.when(ok, F.col("t_mean")), "themes": F.sum(ok.cast("int")).over(market)})
    stats = stats.withColumns({"t_rank": w.pct_rank("ranked"), "t_ok": ok & (F.col("themes") >= 2)})
    df = df.join(stats, key, "left")
    values = {
        "theme_momentum_breadth": F.col("t_up"),
        "theme_relative_strength": F.col("t_mean") - F.col("m_mean"),
        "theme_rank_strength": F.col("t_rank"),
        "theme_member_leadership": F.col("momentum") - F.col("t_median"),
        "theme_laggard_reversal": F.col("t_mean") - F.col("momentum"),
        "theme_risk_adjusted_strength": div("t_mean", F.when(F.col("t_vol") > 0, F.col("t_vol"))),
    }
    return df.select(*KEYS, *[F.when(F.col("t_ok"), v).alias(k) for k, v in values.items()])


def tradeability_features(bars: DataFrame) -> DataFrame:
    """Counts of recent official events, and of events before a bar that can be traded again."""
    as_int = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    flags = {"up": as_int("limit_up"), "down": as_int("limit_down"), "halt": as_int("suspended"), "st": as_int("st_flag"), "free": as_int("fully_tradeable")}
    df = bars.withColumns(flags)
    df = df.withColumn("blocked", F.greatest("up", "down", "halt", "st", 1 - F.col("free")))
    sum_ = lambda c, n: w.total(c, n, 1)
    reopened = lambda c, n: F.col("free") * F.coalesce(w.total(c, n, 1, shift=1), F.lit(0.0))
    made = {"up_3": sum_("up", 3), "down_5": sum_("down", 5), "blocked_20": sum_("blocked", 20), "halt_20": sum_("halt", 20), "st_20": sum_("st", 20), "after_halt_10": reopened("halt", 10), "after_up_5": reopened("up", 5), "after_down_5": reopened("down", 5)}
    df = df.withColumns(made)
    return df.withColumns({"rebound": F.col("after_down_5") - 0.25 * F.col("blocked_20"), "recovery": F.col("after_down_5") - F.col("after_up_5") - 0.50 * F.col("halt_20")})


TRADEABILITY_EVENTS = Family(
    tradeability_features,
    "true",
    {
        "official_limit_down_reopen_rebound_5": {"rebound": 1.0},
        "official_limit_up_crowding_avoidance_3": {"up_3": -1.0},
        "official_limit_down_pressure_avoidance_5": {"down_5": -1.0},
        "official_post_suspension_reopen_risk_avoidance_10": {"after_halt_10": -1.0},
        "official_st_name_risk_avoidance_20": {"st_20": -1.0},
        "official_tradeability_cleanliness_20": {"blocked_20": -1.0},
        "official_limit_state_recovery_quality_5": {"recovery": 1.0},
    },
)


def valued_features(bars: DataFrame, more: tuple[dict[str, Column], ...] = (), parts: int | None = None) -> DataFrame:
    """Bars that carry the valuation columns: price and amount features over at least five rows, ranks, inverses.

    more: further stages by asset, taken before the rows are dealt by cross-section for the ranks; after them they would
    deal the rows back by asset. parts: partitions of the cross-sections (see windows.deal).
    """
    p = F.col("adj_close")
    low20, high20 = w.lowest(p, 20, 5), w.highest(p, 20, 5)
    df = w.steps(
        bars,
        {"return_1d": w.change(p), "momentum_20": w.change(p, 20), "skip5_momentum_20": div(w.lag(p, 5), w.lag(p, 25)) - 1, "reversal_5": -w.change(p, 5), "adv20": w.mean("amount", 20, 5), "adv5": w.mean("amount", 5, 3), "range_position_20": div(p - low20, high20 - low20), "hl": div("high", "low") - 1},
        {"down": F.when(F.col("return_1d").isNotNull(), F.least("return_1d", F.lit(0.0))), "realized_vol_20": w.std("return_1d", 20, 5), "path_20": w.total(F.abs("return_1d"), 20, 5), "hl_range_20": w.mean("hl", 20, 5), "stable_amount": -F.abs(div("adv5", "adv20") - 1)},
        {"downside_vol_20": w.std("down", 20, 5), "return_efficiency_20": div("momentum_20", "path_20"), "pb_inv": inverse("pb"), "pe_inv": inverse("pe_ttm"), "ps_inv": inverse("ps_ttm"), "log_size": log("circ_mv")},
        *more,
    )
    df = w.steps(
        w.deal(df, parts),
        {"amount_rank": w.pct_rank("amount"), "adv20_rank": w.pct_rank("adv20"), "downside_rank": w.pct_rank("downside_vol_20"), "turnover_rank": w.pct_rank("turnover_rate")},
    )
    return df.withColumns({"mid_liquidity": -F.abs(F.col("adv20_rank") - 0.65), "turnover_band": -F.abs(F.col("turnover_rank") - 0.30)})


_VALUE = {"pb_inv": 1.0, "pe_inv": 1.0, "ps_inv": 0.50}
_TAILS = {"downside_vol_20": -1.0, "range_position_20": 0.50, "hl_range_20": -0.25}

VALUE_TAIL = Family(
    valued_features,
    "adv20_rank > 0.20 and amount_rank > 0.20 and turnover_rank <= 1.0 and downside_rank <= 0.80 and range_position_20 >= 0.15 and abs(return_1d) <= 0.35",
    {
        "value_liquid_low_tail_20": _plus((1.0, _VALUE), (0.60, {"mid_liquidity": 1.0}), (1.0, _TAILS)),
        "dividend_value_liquid_low_tail_20": _plus((1.0, _VALUE), (1.0, {"dv_ttm": 1.0}), (0.50, {"mid_liquidity": 1.0}), (1.0, _TAILS)),
        "value_low_turnover_low_tail_20": _plus((1.0, _VALUE), (1.0, {"turnover_band": 1.0}), (1.0, _TAILS)),
    },
    fill=frozenset(_TAILS),
    bucket_size="log_size",
    dealt=True,
)

_MOM = {"skip5_momentum_20": 0.70, "momentum_20": 0.30}
_CALM = {"downside_vol_20": -1.0, "realized_vol_20": -0.55, "return_efficiency_20": 0.35, "range_position_20": 0.20}
_EVEN = {"mid_liquidity": 1.0, "stable_amount": 0.35}

QUALITY_VALUE_MOMENTUM = Family(
    valued_features,
    "adv20_rank >= 0.30 and amount_rank >= 0.30 and downside_rank <= 0.90 and range_position_20 >= 0.08 and abs(return_1d) <= 0.35",
    {
        "public_qvm_value_momentum_lowvol_20": _plus((0.95, _VALUE), (0.65, _MOM), (0.70, _CALM), (0.25, _EVEN)),
        "public_qvm_dividend_quality_momentum_20": _plus((0.70, _VALUE), (0.70, {"dv_ttm": 1.0}), (0.65, _CALM), (0.45, _MOM)),
        "public_qvm_value_reversal_quality_20": _plus((0.90, _VALUE), (0.60, {"reversal_5": 0.70, "momentum_20": -0.30}), (0.70, _CALM)),
        "public_qvm_lowbeta_value_momentum_20": _plus((0.80, _VALUE), (0.55, _MOM), (0.90, {"realized_vol_20": -1.0, "hl_range_20": -0.50})),
    },
    fill=True,
    bucket_size="log_size",
    dealt=True,
)

TURNOVER_COMBO = tuple(f"{c}_low_{kind}_mv_bucket_rank" for c in ("turnover_rate", "turnover_rate_f") for kind in ("liquid", "adv_blend"))


def turnover_combo(bars: DataFrame, parts: int | None = None) -> DataFrame:
    """Low turnover within size buckets of a date: among the liquid half, or blended with liquidity.

    parts: partitions of the dates (see windows.deal).
    """
    sides = ("turnover_rate", "turnover_rate_f")
    df = bars.select(*KEYS, w.mean("amount", 20, 1).alias("adv"), log("circ_mv").alias("size"), *sides)
    df = w.deal(df, parts, ("date",))
    whole = {c: F.col(c).isNotNull() & F.col("size").isNotNull() & F.col("adv").isNotNull() for c in sides}
    df = df.withColumns({f"bucket_{c}": w.edge_bucket(F.when(whole[c], F.col("size")), 5, ("date",), at_most=True) for c in sides})
    of = lambda c, value: (F.when(whole[c], value), F.col(f"bucket_{c}"))
    first = {f"sig_{c}": of(c, -F.col(c)) for c in sides} | {f"adv_{c}": of(c, F.col("adv")) for c in sides}
    ids = ("asset_id", "market")
    df = w.pct_ranks(df, first, ("date",), ids)
    second = {}
    for c in sides:
        blend = F.round(0.55 * F.col(f"sig_{c}") + 0.45 * F.col(f"adv_{c}"), 12)
        second |= {f"{c}_low_liquid_mv_bucket_rank": of(c, F.when(F.col(f"adv_{c}") >= 0.50, -F.col(c))), f"{c}_low_adv_blend_mv_bucket_rank": of(c, blend)}
    return w.pct_ranks(df, second, ("date",), ids).select(*KEYS, *TURNOVER_COMBO)


def skip_momentum(bars: DataFrame) -> DataFrame:
    """Momentum that leaves out the latest rows."""
    p = F.col("adj_close")
    df = bars.withColumns({"etf_skip5_momentum_60": div(w.lag(p, 5), w.lag(p, 65)) - 1, "etf_skip20_momentum_120": div(w.lag(p, 20), w.lag(p, 140)) - 1})
    return df.select(*KEYS, "etf_skip5_momentum_60", "etf_skip20_momentum_120")
