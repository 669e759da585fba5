"""Selection, trades, costs, equity curves and portfolio metrics, keyed by case throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.windows import div


def select_top(factors: DataFrame, n: Column | int, keys: tuple[str, ...] = ("date", "market", "factor_name")) -> DataFrame:
    """The n largest values of each group, ties by asset, with equal weights."""
    n = F.lit(n) if isinstance(n, int) else n
    ranked = factors.where(F.col("factor_value").isNotNull()).withColumn("pick", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("factor_value"), "asset_id")))
    chosen = ranked.where(F.col("pick") <= n)
    return chosen.withColumn("target_weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*keys))).drop("pick")


def select_grid(factors: DataFrame, cases: list[dict[str, float | int]], keys: tuple[str, ...] = ("market", "factor_name")) -> DataFrame:
    """The selections of many cases (``case_no``, ``top_n``, ``every``, and what else a case has) with equal weights.

    Values are ranked and dates counted once for all cases; only rows that a case takes are written for it. Dates are counted
    over the rows picked (each date has some), as one task counts those of a market and factor.
    """
    best = Window.partitionBy("date", *keys).orderBy(F.desc("factor_value"), "asset_id")
    dates = Window.partitionBy(*keys).orderBy("date")
    ranked = factors.where(F.col("factor_value").isNotNull()).withColumn("pick", F.row_number().over(best))
    listed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in cases])
    taken = F.filter(listed, lambda c: (F.col("pick") <= c["top_n"]) & (F.pmod(F.col("place"), c["every"]) == 0))
    few = ranked.where(F.col("pick") <= max(c["top_n"] for c in cases)).withColumn("place", F.dense_rank().over(dates) - 1)
    rows = few.select(*factors.columns, F.inline(taken))
    return rows.withColumn("target_weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("date", *keys, "case_no")))


def select_top_by_industry(factors: DataFrame, n: int, keys: tuple[str, ...] = ("date", "market", "factor_name"), industry: str = "industry") -> DataFrame:
    """Round robin: first the best of every industry, then the second best, until n are chosen."""
    rows = factors.where(F.col("factor_value").isNotNull() & F.col(industry).isNotNull())
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*keys, industry).orderBy(F.desc("factor_value"), "asset_id")))
    rows = rows.withColumn("pick", F.row_number().over(Window.partitionBy(*keys).orderBy("turn", F.desc("factor_value"), industry, "asset_id")))
    chosen = rows.where(F.col("pick") <= n)
    return chosen.withColumn("target_weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*keys))).drop("turn", "pick")


def exclude_bottom(factors: DataFrame, share: float, keys: tuple[str, ...] = ("date", "market", "factor_name")) -> DataFrame:
    """All but the lowest floor(share * n) values, at least one and never all, with equal weights."""
    n = F.count("factor_value").over(Window.partitionBy(*keys))
    drop = F.greatest(F.lit(1), F.least(F.floor(n * share), n - 1))
    rows = factors.where(F.col("factor_value").isNotNull()).withColumns({"n": n, "drop": drop, "rank": w.first_rank("factor_value", keys)})
    return rows.where("n > 1 and rank > drop").withColumn("target_weight", 1.0 / (F.col("n") - F.col("drop"))).drop("n", "drop", "rank")


def every_kth_date(rows: DataFrame, k: Column | int, offset: int = 0, keys: tuple[str, ...] = ("market", "factor_name")) -> DataFrame:
    """Rows on every k-th distinct date of a key, from ``offset``."""
    k = F.lit(k) if isinstance(k, int) else k
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy("date")) - 1 - offset
    return rows.withColumn("place", place).where((F.col("place") >= 0) & (F.pmod("place", k) == 0)).drop("place")


def impact_bps(bps: float, participation: Column, limit: float | None) -> Column:
    """Market impact grows with participation over its limit, and without a limit with participation up to 1."""
    scale = participation / limit if limit else F.least(participation, F.lit(1.0))
    return F.when(participation > 0, F.lit(float(bps)) * scale).otherwise(0.0)


def build_trades(selected: DataFrame, bars: DataFrame, lag: int = 1, hold: int = 1, cost_bps: Column | float = 0.0, impact: float = 0.0, limit: float | None = None, max_days: int | None = None, value: float = 1_000_000.0) -> DataFrame:
    """Trades with ``reject`` (NULL, or why there is none).

    Bought ``lag`` bars after the signal, sold ``hold`` bars later, or at the first later bar that can be sold on and is
    not past the calendar limit. Bars may say ``entry_tradeable`` and ``exit_tradeable``. One window pass over the bars
    finds entries and exits; selections then join on asset and date.
    """
    ok = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in bars.columns else F.lit(True)
    at = w.by_asset()
    ahead = at.rowsBetween(0, Window.unboundedFollowing)
    marked = bars.select("asset_id", "date", F.row_number().over(at).alias("no"), F.col("adj_close").alias("price"), F.col("amount").alias("paid") if "amount" in bars.columns else F.lit(0.0).alias("paid"), ok("entry_tradeable").alias("can_buy"), ok("exit_tradeable").alias("can_sell"))
    marked = marked.withColumns({"bar": F.struct("no", "date", "price", "paid", "can_buy"), "sale": F.min(F.when(F.col("can_sell"), F.struct("no", "date", "price"))).over(ahead)})
    plan = marked.select("asset_id", "date", F.lead("bar", lag).over(at).alias("entry"), F.lead(F.struct("no", "date"), lag + hold).over(at).alias("planned"), F.lead("sale", lag + hold).over(at).alias("exit"))
    t = selected.join(plan.where("planned is not null"), ["asset_id", "date"])
    days = F.greatest(F.lit(0), F.datediff("exit.date", "entry.date"))
    late = F.col("exit.no") > F.col("planned.no")
    past = days > max_days if max_days is not None else F.lit(False)
    controlled = limit is not None or impact > 0
    participation = F.when(F.col("entry.paid") > 0, F.abs("target_weight") * value / F.col("entry.paid"))
    t = t.withColumns({"days": days, "participation_rate": participation})
    reject = F.coalesce(
        F.when(~F.col("entry.can_buy"), "entry_not_tradeable"),
        F.when(F.col("exit").isNull() | (late & past), "exit_not_tradeable"),
        F.when(past, "calendar_limit"),
        F.when(F.lit(controlled) & F.col("participation_rate").isNull(), "amount_missing"),
        F.when(F.col("participation_rate") > (limit if limit is not None else float("inf")), "capacity"),
    )
    bps = (F.lit(float(cost_bps)) if isinstance(cost_bps, (int, float)) else cost_bps) + (impact_bps(impact, F.coalesce("participation_rate", F.lit(0.0)), limit) if impact > 0 else F.lit(0.0))
    gross = div("exit.price", "entry.price") - 1
    t = t.withColumns({"reject": reject, "cost_rate": 2 * bps / 10_000, "gross_return": gross})
    t = t.withColumns({"net_return": F.col("gross_return") - F.col("cost_rate"), "entry_date": F.col("entry.date"), "exit_date": F.col("exit.date"), "entry_amount": F.col("entry.paid"), "delayed": late})
    return t.withColumn("weighted_return", F.col("target_weight") * F.col("net_return")).drop("entry", "planned", "exit").withColumnRenamed("date", "signal_date")


def reject_counts(trades: DataFrame, keys: list[str]) -> DataFrame:
    return trades.groupBy(*keys, F.coalesce("reject", F.lit("traded")).alias("outcome")).agg(F.count(F.lit(1)).alias("trades"))


def equity(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted returns summed by exit date, and their running product."""
    daily = trades.where("reject is null").groupBy(*keys, F.col("exit_date").alias("date")).agg(F.sum("weighted_return").alias("period_return"))
    run = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("equity", F.product(1 + F.col("period_return")).over(run))


def return_metrics(curve: DataFrame, keys: list[str], per_year: float = 252.0) -> DataFrame:
    """Total, annualised return and volatility, Sharpe ratio, drawdown from the running peak, share of gains."""
    run = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    c = curve.withColumn("drawdown", div("equity", F.max("equity").over(run)) - 1)
    out = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("periods"), F.max_by("equity", "date").alias("last"), F.avg("period_return").alias("mean"), F.stddev_pop("period_return").alias("sd"), F.min("drawdown").alias("max_drawdown"), F.avg((F.col("period_return") > 0).cast("double")).alias("win_rate"))
    vol = F.col("sd") * F.sqrt(F.lit(per_year))
    grown = F.when(F.col("last") >= 0, F.pow("last", F.lit(per_year) / F.col("periods")) - 1)
    return out.select(*keys, "periods", (F.col("last") - 1).alias("total_return"), grown.alias("annualized_return"), vol.alias("annualized_volatility"), F.coalesce(div(F.col("mean") * per_year, vol), F.lit(0.0)).alias("sharpe"), "max_drawdown", "win_rate")


def weight_turnover(weights: DataFrame, keys: list[str], date: str = "signal_date") -> DataFrame:
    """Mean over rebalances of half the absolute changes of weights and of cash; everything is cash at first."""
    held = weights.groupBy(*keys, date, "asset_id").agg(F.sum("target_weight").alias("weight"))
    steps = held.select(*keys, date).distinct().withColumn("step", F.row_number().over(Window.partitionBy(*keys).orderBy(date)))
    held = held.join(steps, [*keys, date])
    cash = held.groupBy(*keys, "step").agg((1 - F.sum("weight")).alias("cash"))
    last = steps.groupBy(*keys).agg(F.max("step").alias("last"))
    before = held.select(*keys, "asset_id", (F.col("step") + 1).alias("step"), (-F.col("weight")).alias("weight")).join(last, keys).where("step <= last").drop("last")
    moves = held.select(*keys, "asset_id", "step", "weight").unionByName(before).groupBy(*keys, "asset_id", "step").agg(F.abs(F.sum("weight")).alias("move"))
    moves = moves.groupBy(*keys, "step").agg(F.sum("move").alias("moved"))
    step = Window.partitionBy(*keys).orderBy("step")
    both = cash.withColumn("cash_move", F.abs(F.col("cash") - F.coalesce(F.lag("cash").over(step), F.lit(1.0)))).join(moves, [*keys, "step"])
    return both.groupBy(*keys).agg(F.avg(0.5 * (F.col("moved") + F.col("cash_move"))).alias("turnover"))


def cap_weights(targets: DataFrame, keys: list[str], asset: float = 1.0, market: float = 1.0, gross: float = 1.0, cash: float = 0.0) -> DataFrame:
    """Caps per asset, then per market (rescaled), then of the whole (rescaled), with the cash that is left."""
    of, all_ = Window.partitionBy(*keys, "market"), Window.partitionBy(*keys)
    t = targets.where("target_weight > 0").withColumn("target_weight", F.least("target_weight", F.lit(asset)))
    t = t.withColumn("sum_market", F.sum("target_weight").over(of)).withColumn("target_weight", F.when(F.col("sum_market") > market, F.col("target_weight") * market / F.col("sum_market")).otherwise(F.col("target_weight")))
    most = min(gross, max(0.0, 1.0 - cash))
    t = t.withColumn("sum_all", F.sum("target_weight").over(all_)).withColumn("target_weight", F.when(F.col("sum_all") > most, F.col("target_weight") * most / F.col("sum_all")).otherwise(F.col("target_weight")))
    return t.withColumn("cash_weight", F.greatest(F.lit(0.0), 1 - F.sum("target_weight").over(all_))).drop("sum_market", "sum_all")


def rebalance_deltas(targets: DataFrame, holdings: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer comparison of target and held weights: change and action."""
    both = targets.select(*keys, "target_weight").join(holdings.select(*keys, "held_weight"), keys, "full").fillna(0.0, ["target_weight", "held_weight"])
    delta = F.col("target_weight") - F.col("held_weight")
    action = F.when(delta > 1e-12, "buy").when(delta < -1e-12, "sell").otherwise("hold")
    return both.withColumns({"delta": delta, "action": action})


def benchmark_curve(bars: DataFrame, keys: tuple[str, ...] = ("market",)) -> DataFrame:
    """Equal-weight mean of same-date returns (0 on the first date), compounded."""
    r = bars.withColumn("r", w.change("adj_close"))
    daily = r.groupBy(*keys, "date").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("period_return"))
    run = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("equity", F.product(1 + F.col("period_return")).over(run))


def concentration(weights: DataFrame, keys: list[str], dimension: str) -> DataFrame:
    """Herfindahl index and largest share of a dimension."""
    share = weights.groupBy(*keys, F.coalesce(F.col(dimension).cast("string"), F.lit("UNKNOWN")).alias("part")).agg(F.sum("target_weight").alias("s"))
    return share.withColumn("s", F.col("s") / F.sum("s").over(Window.partitionBy(*keys))).groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("hhi"), F.max("s").alias("top_share"), F.count(F.lit(1)).alias("parts"))


def market_beta(curve: DataFrame, benchmark: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """Regression of a curve's returns on a benchmark's."""
    both = curve.join(benchmark.select(*on, F.col("period_return").alias("b")), on)
    moves = F.min("b") < F.max("b")
    y, x = F.col("period_return"), F.col("b")
    return both.groupBy(*keys).agg(F.when(moves, F.regr_slope(y, x)).alias("beta"), F.when(moves, F.regr_intercept(y, x)).alias("alpha"), F.when(moves, F.regr_r2(y, x)).alias("r2"), F.count(F.lit(1)).alias("n"))
