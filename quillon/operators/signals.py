"""Signals before and around a portfolio: filters, masks, session classes, capacity, evidence rules, blends."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.windows import div
from .labels import sessions


def signal_window(rows: DataFrame, start: str | None, end: str | None, on: str = "date") -> DataFrame:
    """Rows whose date lies within the window, both ends included; an end that is None is open."""
    inside = F.col(on).isNotNull()
    if start is not None:
        inside = inside & (F.col(on) >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside & (F.col(on) <= F.lit(end).cast("date"))
    return rows.where(inside)


def min_signal_amount(factors: DataFrame, bars: DataFrame, least: float) -> DataFrame:
    """Signals whose bar of the date has at least this amount; a missing bar or amount counts as 0."""
    amounts = bars.select("date", "asset_id", "market", F.col("amount").alias("signal_amount"))
    joined = factors.join(amounts, ["date", "asset_id", "market"], "left").withColumn("signal_amount", F.coalesce("signal_amount", F.lit(0.0)))
    return joined.where(F.col("signal_amount") >= least)


def min_average_amount(factors: DataFrame, bars: DataFrame, least: float, n: int) -> DataFrame:
    """Signals whose asset's mean amount of the last n bars reaches the least one; without n bars there is none."""
    means = bars.select("asset_id", "date", w.mean("amount", n).alias("average_amount"))
    return factors.join(means, ["asset_id", "date"]).where(F.col("average_amount") >= least)


def scale_sleeves(selected: DataFrame, hold: int, every: int, gross: float = 1.0) -> DataFrame:
    """Weights of overlapping sleeves: with a holding period longer than the rebalance interval each gets its share."""
    share = 1.0 if hold <= 1 else min(every / hold, 1.0)
    return selected.withColumn("target_weight", F.col("target_weight") * share * gross)


@dataclass(frozen=True)
class Policy:
    """Who may be traded: days since listing, permitted boards, daily limits by board, and the limits' tolerance."""

    listing_days: int = 120
    boards: tuple[str, ...] = ("main",)
    limits: tuple[tuple[str, float], ...] = (("bse", 0.30), ("star", 0.20), ("chinext", 0.20))
    main_limit: float = 0.10
    special_limit: float = 0.05
    tolerance: float = 0.002


FLAGS = ("suspended", "limit_up", "limit_down", "special_treatment", "new_listing", "delisted", "board_blocked")


def tradeability_mask(bars: DataFrame, assets: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Every bar with its flags, ``can_buy``, ``can_sell`` and ``blocked_reasons``.

    ``assets`` has one row per asset: board, special, list_date, delist_date. One window pass and one join by asset.
    """
    close, before = F.col("close"), w.lag("close")
    df = bars.withColumn("prev_close", before).join(assets.select("asset_id", "board", "special", "list_date", "delist_date"), "asset_id", "left")
    limit = F.lit(policy.main_limit)
    for board, share in policy.limits:
        limit = F.when(F.col("board") == board, share).otherwise(limit)
    limit = F.when(F.coalesce("special", F.lit(False)), policy.special_limit).otherwise(limit)
    some = [F.col(c) for c in ("open", "high", "low", "close", "volume", "amount")]
    dead = F.lit(False)
    for c in some:
        dead = dead | c.isNull() | (c <= 0)
    moved = F.col("prev_close") > 0
    flags = {
        "suspended": dead,
        "limit_up": moved & (close >= F.col("prev_close") * (1 + limit - policy.tolerance)) & (F.col("high") <= close * (1 + policy.tolerance)),
        "limit_down": moved & (close <= F.col("prev_close") * (1 - limit + policy.tolerance)) & (F.col("low") >= close * (1 - policy.tolerance)),
        "special_treatment": F.col("special"),
        "new_listing": F.datediff("date", "list_date") < policy.listing_days,
        "delisted": F.col("date") >= F.col("delist_date"),
        "board_blocked": ~F.coalesce(F.col("board"), F.lit("main")).isin(*policy.boards),
    }
    df = df.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    base = F.col("suspended") | F.col("special_treatment") | F.col("new_listing") | F.col("delisted") | F.col("board_blocked")
    reasons = F.concat_ws(";", *[F.when(F.col(k), k) for k in FLAGS])
    return df.withColumns({"can_buy": ~(base | F.col("limit_up")), "can_sell": ~(base | F.col("limit_down")), "blocked_reasons": reasons})


def replace_blocked(factors: DataFrame, mask: DataFrame, n: int, keys: tuple[str, ...] = ("date", "market", "factor_name")) -> DataFrame:
    """The n best buyable assets of each group, so that the next one fills a blocked one's place; with the rank before."""
    ranked = factors.where(F.col("factor_value").isNotNull()).withColumn("rank_before", w.first_rank("factor_value", keys, down=True))
    good = ranked.join(mask.where("can_buy").select("asset_id", "date"), ["asset_id", "date"], "left_semi")
    best = good.withColumn("rank", w.first_rank("factor_value", keys, down=True)).where(F.col("rank") <= n)
    return best.withColumn("target_weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def session_classes(bars: DataFrame, assets: DataFrame, suspended: DataFrame, spans: DataFrame) -> DataFrame:
    """Sessions of the market between an asset's first and last bar on which it has none, and why.

    ``suspended`` has (asset_id, date), ``spans`` (asset_id, suspend_date, resume_date); the calendar is one row per
    market and session, and an asset's spans are few.
    """
    life = bars.groupBy("asset_id", "market").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    due = life.join(sessions(bars).select("market", "date"), "market").where("date between first and last").select("asset_id", "market", "date")
    gap = due.join(bars.select("asset_id", "date"), ["asset_id", "date"], "left_anti")
    known = gap.join(assets.select("asset_id", "list_date", "delist_date", F.lit(True).alias("known")), "asset_id", "left")
    known = known.join(suspended.select("asset_id", "date", F.lit(True).alias("daily")).distinct(), ["asset_id", "date"], "left")
    held = spans.groupBy("asset_id").agg(F.collect_list(F.struct("suspend_date", "resume_date")).alias("spans"))
    known = known.join(held, "asset_id", "left")
    within = F.exists("spans", lambda x: (F.col("date") >= x["suspend_date"]) & (x["resume_date"].isNull() | (F.col("date") < x["resume_date"])))
    why = F.when(F.col("date") < F.col("list_date"), "before_list_date").when(F.col("date") > F.col("delist_date"), "after_delist_date").when(F.col("daily"), "daily_suspension").when(within, "interval_suspension").when(F.col("known").isNull(), "missing_lifecycle").otherwise("unresolved")
    return known.select("asset_id", "market", "date", why.alias("session_class"))


def overlap_stats(curve: DataFrame, keys: list[str], hold: int, per_year: float = 252.0) -> DataFrame:
    """Sharpe ratio before and after the autocorrelation that overlapping holding periods bring, and what it does to n.

    A series is one value per date, so its ordered array is bounded by the calendar.
    """
    r = F.col("period_return")
    s = curve.where(r.isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", r.alias("v")))).alias("a"), F.avg(r).alias("mean_return"), F.var_samp(r).alias("variance"), F.count(F.lit(1)).alias("n"))
    s = s.where("n > 1 and variance > 0").withColumns({"c": F.transform("a", lambda x: x["v"] - F.col("mean_return")), "max_lag": F.least(F.lit(max(0, hold - 1)), F.col("n").cast("int") - 1)})
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    dot = lambda k: add(F.zip_with(F.slice("c", k + 1, F.size("c")), F.slice("c", 1, F.size("c") - k), lambda a, b: a * b))
    lags = F.filter(F.sequence(F.lit(0), F.col("max_lag")), lambda k: k > 0)
    whole = add(F.transform("c", lambda x: x * x))
    s = s.withColumns({"autocorrelations": F.transform(lags, lambda k: dot(k) / whole), "long_run_variance": F.greatest(F.lit(0.0), (whole + add(F.transform(lags, lambda k: 2 * (1 - k / (F.col("max_lag") + 1.0)) * dot(k)))) / (F.col("n") - 1))})
    ratio = F.col("long_run_variance") / F.col("variance")
    inflation = F.when(ratio > 0, ratio).otherwise(1.0)
    year = F.sqrt(F.lit(per_year))
    return s.select(
        *keys, "n", "max_lag", "mean_return", (F.col("mean_return") / F.sqrt("variance") * year).alias("naive_sharpe"), F.coalesce(div("mean_return", F.sqrt("long_run_variance")) * year, F.lit(0.0)).alias("adjusted_sharpe"),
        inflation.alias("variance_inflation"), F.least(F.col("n").cast("double"), F.col("n") / inflation).alias("effective_n"), F.coalesce(div("mean_return", F.sqrt(F.col("long_run_variance") / F.col("n"))), F.lit(0.0)).alias("t_stat"), "autocorrelations",
    )


def top_capacity(rows: DataFrame, keys: list[str], amount: str, value: float, positions: int, limit: float, least: int, q: int = 5) -> DataFrame:
    """How much the top bucket's assets trade: coverage, median and tenth percentile, participation of one position.

    Buckets are formed by date within a key; dates with fewer than ``least`` rows do not count.
    """
    date_keys = (*keys, "date")
    placed = rows.withColumns({"bucket": w.edge_bucket("factor_value", q, date_keys), "size": F.count("factor_value").over(Window.partitionBy(*date_keys))})
    top = placed.where((F.col("size") >= least) & (F.col("bucket") == q - 1))
    paid = F.when(F.col(amount) > 0, F.col(amount))
    out = w.exact_quantiles(top, keys, {"median_amount": (paid, 0.5), "p10_amount": (paid, 0.1)}, counts=("observations", "with_amount"))
    share = F.lit(value / positions) / F.nullif(F.col("p10_amount"), F.lit(0.0))
    return out.withColumns({"coverage": F.col("with_amount") / F.col("observations"), "participation": share, "within_limit": F.coalesce(share <= limit, F.lit(False))})


def blockers(rows: DataFrame, rules: list[tuple[str, Column]], out: str = "blockers") -> DataFrame:
    """The names of the rules that a row breaks, in their order; a rule that cannot be told counts as broken."""
    return rows.withColumn(out, F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules])))


def compare_to_benchmark(curve: DataFrame, benchmark: DataFrame, keys: list[str], on: list[str], cash: float = 0.0, per_year: float = 252.0) -> DataFrame:
    """Compounded totals of a curve and its benchmark, their difference, and the excess over cash."""
    mine = curve.groupBy(*keys).agg((F.product(1 + F.col("period_return")) - 1).alias("strategy_return"))
    base = benchmark.groupBy(*on).agg((F.product(1 + F.col("period_return")) - 1).alias("benchmark_return"), F.count(F.lit(1)).alias("n"))
    grown = F.pow(F.lit(1 + cash), F.greatest(F.lit(0), F.col("n") - 1) / per_year) - 1
    joined = mine.join(base, on).withColumn("cash_return", grown)
    return joined.select(*keys, "strategy_return", "benchmark_return", (F.col("strategy_return") - F.col("benchmark_return")).alias("relative_return"), "cash_return", (F.col("strategy_return") - F.col("cash_return")).alias("excess_over_cash"))


def allowed_dates(benchmark: DataFrame, keys: list[str], lookback: int) -> DataFrame:
    """Dates on which the benchmark's momentum is positive."""
    past = F.lag("equity", lookback).over(Window.partitionBy(*keys).orderBy("date"))
    m = benchmark.withColumn("momentum", div("equity", past) - 1)
    return m.select(*keys, "date", "momentum", F.coalesce(F.col("momentum") > 0, F.lit(False)).alias("allowed"))


def wide(factors: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """One column per factor name; the names are given, so no job looks for them. Of repeated rows the largest value counts."""
    return factors.groupBy(*keys).pivot("factor_name", names).agg(F.max("factor_value"))


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, values: list[str]) -> DataFrame:
    """Each left row with the last right row of its keys at or before it; left rows without one are left out."""
    from .asof import asof_by_key

    return asof_by_key(left, right, keys, left_on, right_on, values).where("as_of is not null")


def event_windows(events: DataFrame, bars: DataFrame, on: str, before: int, after: int) -> DataFrame:
    """Events repeated for the market's sessions around theirs: ``offset`` from -before to after, and its ``session_date``.

    An event between sessions belongs to the next one. Sessions are found by date once for each market and date.
    """
    from .asof import asof_by_key

    days = sessions(bars)
    dates = events.select("market", F.col(on).alias("__on")).distinct()
    at = asof_by_key(dates, days.withColumnRenamed("date", "__day"), ["market"], "__on", "__day", ["session"])
    home = at.select("market", "__on", (F.coalesce("session", F.lit(0)) + F.when(F.col("as_of") == F.col("__on"), 0).otherwise(1)).alias("__home"))
    spread = home.withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("__no", F.col("__home") + F.col("offset"))
    dated = spread.join(days.select("market", F.col("session").alias("__no"), F.col("date").alias("session_date")), ["market", "__no"])
    return events.withColumn("__on", F.col(on)).join(dated.drop("__no", "__home"), ["market", "__on"]).drop("__on")


def blend_weights(names: list[int], step: float, most: int) -> list[tuple[int, int, float]]:
    """(blend, component, weight): all ways to give up to ``most`` components positive multiples of ``step`` that add up to 1."""
    units, out, no = round(1 / step), [], 0
    for size in range(1, most + 1):
        for chosen in itertools.combinations(sorted(names), size):
            for cuts in itertools.combinations(range(1, units), size - 1):
                parts = [b - a for a, b in zip((0, *cuts), (*cuts, units))]
                out.extend((no, name, part / units) for name, part in zip(chosen, parts))
                no += 1
    return out


def blends(curves: DataFrame, keys: list[str], case: str, weights: list[tuple[int, int, float]]) -> DataFrame:
    """Return series of weighted blends on the dates that all components have: one explode by component, one aggregate."""
    size: dict[int, int] = {}
    for no, _, _ in weights:
        size[no] = size.get(no, 0) + 1
    listed = F.array(*[F.struct(F.lit(no).alias("blend"), F.lit(name).alias("component"), F.lit(x).alias("weight"), F.lit(size[no]).alias("size")) for no, name, x in weights])
    rows = curves.select(*keys, "date", "period_return", F.inline(F.filter(listed, lambda x: x["component"] == F.col(case))))
    out = rows.groupBy(*keys, "blend", "date").agg(F.sum(F.col("weight") * F.col("period_return")).alias("period_return"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    return out.where("n = size").drop("n", "size")


def monotonicity(groups: DataFrame, keys: list[str], quantiles: int = 5) -> DataFrame:
    """Share of neighbouring buckets whose mean return rises, of the means over all dates; and the top less the bottom."""
    means = groups.groupBy(*keys, "quantile").agg(F.avg("mean_forward_return").alias("m"))
    order = Window.partitionBy(*keys).orderBy("quantile")
    steps = means.withColumn("up", (F.col("m") > F.lag("m").over(order)).cast("double"))
    at = lambda q: F.max(F.when(F.col("quantile") == q, F.col("m")))
    return steps.groupBy(*keys).agg(F.avg("up").alias("monotonicity"), (at(quantiles) - at(1)).alias("spread"), F.count(F.lit(1)).alias("buckets"))


def yearly(ic: DataFrame, keys: list[str], column: str = "rank_ic", least: int = 12) -> DataFrame:
    """Mean by year, for years with enough dates: years, and the share of them that are positive."""
    years = ic.where(F.col(column).isNotNull()).groupBy(*keys, F.year("date").alias("year")).agg(F.avg(column).alias("mean"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return years.groupBy(*keys).agg(F.count(F.lit(1)).alias("usable_years"), F.avg((F.round("mean", 12) > 0).cast("double")).alias("positive_year_rate"), F.min("mean").alias("worst_year"))
