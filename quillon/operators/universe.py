"""Which assets count, and when: exclusions, funds, rotation members, fund baskets, and the timing of announcements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import session_after


def exclusion_reasons(bars: DataFrame, lifecycles: DataFrame, quarantined: DataFrame, jump: float = 2.0, drop_unknown: bool = False) -> DataFrame:
    """Bars with ``excluded``: quarantined, ratio_jump, unlisted, delisted, unknown (no listing date; if asked), or NULL.

    ``lifecycles`` has one row per asset with list_date and delist_date; more than one is an error, as is a delisting before
    the listing. Both tables are one row per asset before they meet the bars, so nothing is multiplied. ratio_jump takes all
    bars of an asset whose adjusted over plain close ever changes by more than ``jump`` times, up or down, from one bar that
    has both to the next. The first reason counts.
    """
    life = lifecycles.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"), F.max("list_date").alias("__list"), F.max("delist_date").alias("__delist"))
    wrong = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("several lifecycles of asset "), F.col("asset_id").cast("string")))).when(F.col("__delist") < F.col("__list"), F.raise_error(F.concat(F.lit("delisted before listed: asset "), F.col("asset_id").cast("string"))))
    life = life.select("asset_id", F.coalesce(wrong.cast("date"), F.col("__list")).alias("__list"), "__delist")
    held = quarantined.select("asset_id").distinct().withColumn("__held", F.lit(True))
    assets = life.join(held, "asset_id", "full")
    order = Window.partitionBy("asset_id").orderBy("date")
    ratio = F.when(F.col("close") > 0, F.col("adj_close") / F.col("close"))
    known = bars.withColumn("__ratio", ratio)
    known = known.withColumn("__before", F.last("__ratio", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    change = F.col("__ratio") / F.nullif("__before", F.lit(0.0))
    known = known.withColumn("__change", F.greatest(F.abs(change), F.abs(1 / F.nullif(change, F.lit(0.0)))))
    known = known.withColumn("__jumps", F.max("__change").over(Window.partitionBy("asset_id")) > jump).join(assets, "asset_id", "left")
    reason = F.when(F.col("__held"), "quarantined").when(F.col("__jumps"), "ratio_jump").when(F.col("date") < F.col("__list"), "unlisted").when(F.col("__list").isNotNull() & (F.col("date") > F.col("__delist")), "delisted")
    if drop_unknown:
        reason = reason.when(F.col("__list").isNull(), "unknown")
    return known.withColumn("excluded", reason).select(*bars.columns, "excluded")


def authority_bars(bars: DataFrame, lifecycles: DataFrame, quarantined: DataFrame, jump: float = 2.0, drop_unknown: bool = False) -> DataFrame:
    return exclusion_reasons(bars, lifecycles, quarantined, jump, drop_unknown).where("excluded is null").drop("excluded")


def active_funds(funds: DataFrame, as_of: str | None = None) -> DataFrame:
    """Exchange-traded funds of the two exchanges: listed by the day and not yet delisted, or of status L without a day.

    A fund is exchange-traded if is_etf says so, or without that column if its name or kind has the word. Symbols are upper
    case in the result.
    """
    symbol = F.upper("symbol")
    kinds = [c for c in ("name", "fund_type", "invest_type", "type") if c in funds.columns]
    etf = F.coalesce("is_etf", F.lit(False)) if "is_etf" in funds.columns else F.upper(F.concat_ws(" ", *kinds)).contains("ETF")
    if as_of:
        day = F.lit(as_of).cast("date")
        active = F.coalesce(F.col("list_date") <= day, F.lit(False)) & (F.col("delist_date").isNull() | (F.col("delist_date") > day))
    else:
        active = F.upper("status") == "L"
    return funds.where((F.upper("market") == "E") & etf & (symbol.endswith(".SH") | symbol.endswith(".SZ")) & active).withColumn("symbol", symbol)


def rotation_members(signals: DataFrame, membership: DataFrame, least_history: int | None = None, least_members: int | None = None) -> DataFrame:
    """Signals of assets that are members on the date, have a history so long, on dates with so many such members.

    ``membership`` has date, asset_id, is_rotation_member and history_rows. Members are counted once per date and asset, with
    map-side sums, and semi-joined: signals are not multiplied, whatever repeats.
    """
    live = membership.where("is_rotation_member")
    if least_history:
        live = live.where(F.col("history_rows") >= least_history)
    live = live.select("date", "asset_id").distinct()
    if least_members:
        counts = live.groupBy("date").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least_members)
        live = live.join(counts.select("date"), "date", "left_semi")
    return signals.join(live, ["date", "asset_id"], "left_semi")


def basket_weights(holdings: DataFrame) -> DataFrame:
    """(fund_symbol, stock_symbol, known_date, end_date, weight) of disclosed holdings.

    The basis is the market value, or the stated share where that is missing or not positive; rows without either go. Weights
    of a disclosure add up to one. It holds until the day before the fund's next one; the last stays open.
    """
    basis = F.when(F.col("mkv") > 0, F.col("mkv")).otherwise(F.col("stk_mkv_ratio"))
    rows = holdings.where("known_date is not null").select(F.upper("fund_symbol").alias("fund_symbol"), F.upper("stock_symbol").alias("stock_symbol"), "known_date", basis.alias("__basis")).where("__basis > 0")
    days = rows.select("fund_symbol", "known_date").distinct()
    nexts = days.withColumn("end_date", F.date_sub(F.lead("known_date").over(Window.partitionBy("fund_symbol").orderBy("known_date")), 1))
    weighted = rows.withColumn("weight", F.col("__basis") / F.sum("__basis").over(Window.partitionBy("fund_symbol", "known_date")))
    return weighted.join(nexts, ["fund_symbol", "known_date"]).select("fund_symbol", "stock_symbol", "known_date", "end_date", "weight")


def timing_audit(statements: DataFrame, bars: DataFrame, max_lag: int) -> DataFrame:
    """One row per market: how well announcements can be dated, and whether signals follow them strictly and in time.

    ``statements`` has asset_id, market, end_date, ann_date. A signal comes on the market's first session after the
    announcement.
    """
    key = ["asset_id", "market", "end_date", "ann_date"]
    whole = statements.where("ann_date is not null and end_date is not null")
    quality = statements.groupBy("market").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("ann_date").isNull()).alias("missing_announcements"),
        F.count_if(F.col("end_date").isNull()).alias("missing_periods"),
        F.count_if(F.col("ann_date") < F.col("end_date")).alias("early_announcements"),
    )
    same = whole.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    of_period = same.groupBy("asset_id", "market", "end_date").agg(F.count(F.lit(1)).alias("versions"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"))
    revised = of_period.groupBy("market").agg(F.sum("repeated").alias("duplicate_rows"), F.count_if(F.col("versions") > 1).alias("revised_periods"))
    dated = session_after(whole.select("market", "ann_date"), bars, "ann_date")
    lag = F.datediff("signal_date", "ann_date")
    mapped = dated.groupBy("market").agg(F.count(F.lit(1)).alias("mapped_rows"), F.count_if(lag <= 0).alias("early_signals"), F.count_if(lag > max_lag).alias("stale_signals"))
    sizes = whole.groupBy("market").agg(F.count(F.lit(1)).alias("__whole"))
    out = quality.join(revised, "market", "left").join(mapped, "market", "left").join(sizes, "market", "left").na.fill(0)
    out = out.withColumn("unmapped_rows", F.col("__whole") - F.col("mapped_rows")).drop("__whole")
    blocks = ("missing_announcements", "missing_periods", "early_announcements", "duplicate_rows", "early_signals", "stale_signals")
    return out.withColumn("blockers", F.concat_ws(";", *[F.when(F.col(b) > 0, b) for b in blocks]))
