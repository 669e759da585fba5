"""Overlays and repairs of traded return series: self-risk from closed returns, exclusion of flagged trades, delayed exits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import div, exact_quantiles
from .asof import asof_by_key


def _day(c: str | Column) -> Column:
    return F.datediff(c, F.lit("1970-01-01").cast("date"))


def closed_return_risk(events: DataFrame, keys: list[str], k: int, threshold: float, exposure: float, order: str) -> DataFrame:
    """Exposure of each decision by the sum of the last k returns that were closed by then.

    ``events`` has decision_date, date (the exit) and period_return; ``order`` tells rows of one exit and decision apart. A
    return is closed for the decisions on or after its exit, and never for decisions up to its own. Closed returns are one
    ordered stream that carries a rolling sum of k; decisions take the last sum as of their day. No range join. Adds
    prior_sum, self_exposure, adjusted_return, and equity and drawdown by exit.
    """
    decided, exit_ = _day("decision_date"), _day("date")
    # half days: a return that is closed no later than its own decision counts from after that decision on
    closed = F.when(exit_ > decided, exit_ * 2).otherwise(decided * 2 + 1)
    known = events.where("decision_date is not null and date is not null").withColumn("period_return", F.coalesce("period_return", F.lit(0.0)))
    rows = known.withColumns({"__closed": closed, "__decided": decided * 2})
    in_order = Window.partitionBy(*keys).orderBy("__closed", "date", "decision_date", order)
    rolled = rows.withColumns({"__roll": F.sum("period_return").over(in_order.rowsBetween(-(k - 1), 0)), "__no": F.row_number().over(in_order)})
    last = rolled.groupBy(*keys, "__closed").agg(F.max_by("__roll", "__no").alias("__prior"))
    met = asof_by_key(rows.drop("__closed"), last, keys, "__decided", "__closed", ["__prior"])
    out = met.withColumn("prior_sum", F.coalesce("__prior", F.lit(0.0))).drop("__prior", "as_of", "__decided")
    out = out.withColumn("self_exposure", F.when(F.col("prior_sum") < threshold, F.lit(exposure)).otherwise(1.0))
    out = out.withColumn("adjusted_return", F.col("period_return") * F.col("self_exposure"))
    by_exit = Window.partitionBy(*keys).orderBy("date", "decision_date", order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("equity", F.product(1 + F.col("adjusted_return")).over(by_exit))
    return out.withColumn("drawdown", F.coalesce(div("equity", F.max("equity").over(by_exit)) - 1, F.lit(0.0)))


def within(limits: dict[str, tuple[float | None, float | None]]) -> Column:
    """Whether all features lie within (least, most); a missing feature does not."""
    flag = F.lit(True)
    for name, (least, most) in limits.items():
        if least is not None:
            flag = flag & (F.col(name) >= least)
        if most is not None:
            flag = flag & (F.col(name) <= most)
    return F.coalesce(flag, F.lit(False))


def flagged_contributions(trades: DataFrame, flag: Column, keys: list[str], value: str = "weighted_return") -> DataFrame:
    """(keys, date, flagged_trades, contribution, abs_contribution) of flagged trades by exit date."""
    v = F.coalesce(F.col(value), F.lit(0.0))
    flagged = trades.where(flag).where(F.col("exit_date").isNotNull())
    return flagged.groupBy(*keys, F.col("exit_date").alias("date")).agg(F.count(F.lit(1)).alias("flagged_trades"), F.sum(v).alias("contribution"), F.sum(F.abs(v)).alias("abs_contribution"))


def exclude_from_template(template: DataFrame, contributions: DataFrame, keys: list[str]) -> DataFrame:
    """The template's returns less what flagged trades gave on the same date; one row per period of the template."""
    out = template.withColumn("base_return", F.coalesce("period_return", F.lit(0.0))).drop("period_return")
    out = out.join(contributions.select(*keys, "date", "flagged_trades", "contribution"), [*keys, "date"], "left")
    out = out.withColumns({"flagged_trades": F.coalesce("flagged_trades", F.lit(0)), "contribution": F.coalesce("contribution", F.lit(0.0))})
    return out.withColumn("period_return", F.col("base_return") - F.col("contribution"))


def unmatched_contributions(template: DataFrame, contributions: DataFrame, keys: list[str]) -> DataFrame:
    """Per key what fell on periods of the template and what did not: counts, sums, and the unmatched share of absolute sums."""
    held = template.select(*keys, "date").distinct().withColumn("__in", F.lit(True))
    both = contributions.join(held, [*keys, "date"], "left").withColumn("__in", F.coalesce("__in", F.lit(False)))
    part = lambda c, inside: F.sum(F.when(F.col("__in") == inside, F.col(c)).otherwise(0))
    out = both.groupBy(*keys).agg(
        F.sum("flagged_trades").alias("flagged_trades"),
        part("flagged_trades", True).alias("matched_trades"),
        part("flagged_trades", False).alias("unmatched_trades"),
        part("contribution", True).alias("matched_contribution"),
        part("contribution", False).alias("unmatched_contribution"),
        part("abs_contribution", False).alias("unmatched_abs_contribution"),
        F.sum("abs_contribution").alias("abs_contribution"),
    )
    return out.withColumn("unmatched_share", F.coalesce(div("unmatched_abs_contribution", "abs_contribution"), F.lit(0.0)))


def delayed_exits(trades: DataFrame, mask: DataFrame, max_delay: int, price: str = "adj_close", sellable: str = "can_sell", cost_rate: float | None = None) -> DataFrame:
    """Trades sold on the first sellable session from their exit on, at most ``max_delay`` days late, and priced there.

    ``mask`` has one row per asset and date with a price and whether it can be sold. Exits meet sellable sessions in one
    ordered stream per asset, backwards in time, so runs of blocked sessions cost nothing and no range is joined. Adds
    delayed_exit_date, exit_delay_days, delayed_gross_return, delayed_weighted_return and delayed_exit_status: entry_blocked,
    missing_entry_price, unresolved_exit (blocked for too long, or until the history ends), missing_exit_price,
    same_day_exit or delayed_exit. Returns are 0 unless the last two.
    """
    prices = mask.where(F.col(price).isNotNull())
    entries = prices.select("asset_id", F.col("date").alias("entry_date"), F.col(price).alias("__entry"))
    sales = prices.where(F.col(sellable)).select("asset_id", (-_day("date")).alias("__from"), F.col("date").alias("__sold"), F.col(price).alias("__exit"))
    rows = trades.withColumn("__wanted", -_day("exit_date")).join(entries, ["asset_id", "entry_date"], "left")
    met = asof_by_key(rows, sales, ["asset_id"], "__wanted", "__from", ["__sold", "__exit"]).drop("as_of")
    late = F.datediff("__sold", "exit_date")
    status = (
        F.when(~F.coalesce("entry_allowed", F.lit(True)), "entry_blocked")
        .when(F.col("__entry").isNull() | (F.col("__entry") <= 0), "missing_entry_price")
        .when(F.col("__sold").isNull() | (late > max_delay), "unresolved_exit")
        .when(F.col("__exit") <= 0, "missing_exit_price")
        .when(late == 0, "same_day_exit")
        .otherwise("delayed_exit")
    )
    met = met.withColumn("delayed_exit_status", status)
    done = F.col("delayed_exit_status").isin("same_day_exit", "delayed_exit")
    gross = F.when(done, F.col("__exit") / F.col("__entry") - 1).otherwise(0.0)
    cost = F.coalesce("cost_rate", F.lit(0.0)) if cost_rate is None else F.lit(cost_rate)
    out = met.withColumns({"delayed_exit_date": F.when(done, F.col("__sold")).otherwise(F.col("exit_date")), "exit_delay_days": F.when(done, late).otherwise(0), "delayed_gross_return": gross})
    net = F.when(done, (F.col("delayed_gross_return") - cost) * F.coalesce("target_weight", F.lit(0.0))).otherwise(0.0)
    return out.withColumn("delayed_weighted_return", net).drop("__wanted", "__entry", "__sold", "__exit")


def snapshot_changes(snapshots: DataFrame, least_change: float, keys: tuple[str, ...] = ("index_code",), member: str = "symbol", calendar: DataFrame | None = None) -> DataFrame:
    """Members added, removed or reweighted between consecutive snapshots (keys, date, member, weight) of an index.

    Each row says what holds on its own date and what held before the next snapshot; both are aggregated by date and member
    at once, so no snapshots are joined. The first snapshot gives no events. ``calendar`` (date) adds available_date, the
    next session after the event.
    """
    days = snapshots.select(*keys, "date").distinct()
    order = Window.partitionBy(*keys).orderBy("date")
    steps = days.withColumns({"__next": F.lead("date").over(order), "__first": F.row_number().over(order) == 1})
    rows = snapshots.groupBy(*keys, "date", member).agg(F.max("weight").alias("weight")).join(steps, [*keys, "date"])
    sides = F.array(F.struct(F.when(~F.col("__first"), F.col("date")).alias("event_date"), F.col("weight").alias("now"), F.lit(None).cast("double").alias("before")), F.struct(F.col("__next").alias("event_date"), F.lit(None).cast("double").alias("now"), F.col("weight").alias("before")))
    both = rows.select(*keys, member, F.inline(sides)).where("event_date is not null").groupBy(*keys, member, "event_date").agg(F.max("now").alias("now"), F.max("before").alias("before"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.abs(F.col("now") - F.col("before")) >= least_change, "weight_changed")
    events = both.withColumn("event_type", kind).where("event_type is not null")
    out = events.select(*keys, member, "event_date", "event_type", F.coalesce("before", F.lit(0.0)).alias("prior_weight"), F.coalesce("now", F.lit(0.0)).alias("current_weight"))
    out = out.withColumn("weight_change", F.col("current_weight") - F.col("prior_weight"))
    if calendar is None:
        return out
    # the next session of each distinct event date, backwards in time
    wanted = out.select("event_date").distinct().withColumns({"__all": F.lit(0), "__wanted": -_day("event_date") - 1})
    open_ = calendar.select("date").distinct().select(F.lit(0).alias("__all"), (-_day("date")).alias("__from"), F.col("date").alias("available_date"))
    found = asof_by_key(wanted, open_, ["__all"], "__wanted", "__from", ["available_date"])
    return out.join(found.select("event_date", "available_date"), "event_date", "left")


def prior_state_risk(curve: DataFrame, keys: list[str], rules: list[tuple[str, float, float]], late: tuple[str, float, float] | None = None) -> DataFrame:
    """Exposure by the state of the source series before each period: sums of its last 21 and 42 returns, and its drawdown.

    ``rules`` has (state, threshold, exposure): prior_sum_21, prior_sum_42 or prior_drawdown below the threshold takes the
    exposure; the first rule that holds counts. ``late`` is one more rule for periods that kept full exposure. States are
    windows of the source returns, not of the exposed ones.
    """
    r = F.coalesce("period_return", F.lit(0.0))
    order = Window.partitionBy(*keys).orderBy("date")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    state = curve.withColumn("source_return", r).drop("period_return")
    sums = {f"prior_sum_{n}": F.coalesce(F.sum("source_return").over(order.rowsBetween(-n, -1)), F.lit(0.0)) for n in (21, 42)}
    state = state.withColumns(sums | {"prior_equity": F.coalesce(F.product(1 + F.col("source_return")).over(before), F.lit(1.0))})
    state = state.withColumn("prior_drawdown", F.coalesce(div("prior_equity", F.max("prior_equity").over(order.rowsBetween(Window.unboundedPreceding, 0))) - 1, F.lit(0.0)))
    exposure = F.lit(None).cast("double")
    for name, threshold, level in rules:
        exposure = F.coalesce(exposure, F.when(F.col(name) < threshold, F.lit(float(level))))
    if late:
        exposure = F.when(exposure.isNull() | (exposure >= 0.999999), F.when(F.col(late[0]) < late[1], F.lit(float(late[2]))).otherwise(exposure)).otherwise(exposure)
    out = state.withColumn("self_exposure", F.coalesce(exposure, F.lit(1.0))).withColumn("period_return", F.col("source_return") * F.col("self_exposure"))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("equity", F.product(1 + F.col("period_return")).over(run))
    return out.withColumn("drawdown", F.coalesce(div("equity", F.max("equity").over(run)) - 1, F.lit(0.0)))


def market_state_caps(benchmark: DataFrame, keys: list[str], lookbacks: list[int], thresholds: list[float], drawdown: float, caps: list[float], lag: int = 1) -> DataFrame:
    """(keys, date, lookback, threshold, cap_exposure, cap) of a grid of policies over a benchmark's returns.

    A date is under stress if its momentum over the look-back is at most the threshold, or its distance from the highest
    equity of a full look-back at most ``drawdown``; the cap counts ``lag`` periods later. The states of a look-back are
    computed once; policies are rows made of them.
    """
    order = Window.partitionBy(*keys).orderBy("date")
    curve = benchmark.select(*keys, "date", F.product(1 + F.coalesce("period_return", F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("__equity"))
    states = {}
    for n in lookbacks:
        last = order.rowsBetween(-(n - 1), 0)
        peak = F.when(F.count("__equity").over(last) >= n, F.max("__equity").over(last))
        states |= {f"__m{n}": div("__equity", F.lag("__equity", n).over(order)) - 1, f"__d{n}": div("__equity", peak) - 1}
    known = curve.withColumns(states)
    grid = []
    for n in lookbacks:
        for t in thresholds:
            stress = F.coalesce(F.col(f"__m{n}") <= t, F.lit(False)) | F.coalesce(F.col(f"__d{n}") <= drawdown, F.lit(False))
            grid.append((n, t, f"__s{len(grid)}", stress))
    late = known.withColumns({name: F.coalesce(F.lag(stress.cast("boolean"), lag).over(order), F.lit(False)) for _, _, name, stress in grid})
    rows = [F.struct(F.lit(n).alias("lookback"), F.lit(float(t)).alias("threshold"), F.lit(float(c)).alias("cap_exposure"), F.when(F.col(name), F.lit(float(c))).otherwise(1.0).alias("cap")) for n, t, name, _ in grid for c in caps]
    return late.select(*keys, "date", F.inline(F.array(*rows)))


def align_caps(events: DataFrame, caps: DataFrame, keys: list[str], policy: list[str], decision: str = "decision_date") -> DataFrame:
    """Events once per policy with the cap known on their decision date (1 before the first), as of it and not on it alone."""
    policies = caps.select(*policy).distinct().collect()  # the grid, a handful of rows
    if not policies:
        raise ValueError("no policies to align")
    every = F.array(*[F.struct(*[F.lit(p[c]).alias(c) for c in policy]) for p in policies])
    each = events.select(*events.columns, F.inline(every))
    met = asof_by_key(each, caps.select(*keys, *policy, F.col("date").alias("__day"), "cap"), [*keys, *policy], decision, "__day", ["cap"]).drop("as_of")
    return met.withColumn("cap", F.coalesce("cap", F.lit(1.0))).withColumn("capped_return", F.coalesce("period_return", F.lit(0.0)) * F.col("cap"))


def hedged_spread(selected: DataFrame, benchmark: DataFrame, keys: list[str], ratio: float) -> DataFrame:
    """Returns of a selection less ``ratio`` times the benchmark's gross returns and their cost, on the dates of either.

    The benchmark has period_return and gross_return; a date that one side lacks counts 0 there.
    """
    b = benchmark.select(*keys, "date", F.coalesce("period_return", F.lit(0.0)).alias("__net"), F.coalesce("gross_return", "period_return", F.lit(0.0)).alias("__gross"))
    both = selected.select(*keys, "date", F.coalesce("period_return", F.lit(0.0)).alias("__own")).join(b, [*keys, "date"], "full").na.fill(0.0, ["__own", "__net", "__gross"])
    short = -F.col("__gross") - (F.col("__gross") - F.col("__net"))
    out = both.select(*keys, "date", (F.col("__own") + ratio * short).alias("period_return"))
    run = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("equity", F.product(1 + F.col("period_return")).over(run))


def extreme_trades(trades: DataFrame, keys: list[str], threshold: float, top: int, value: str = "gross_return", tie: str = "asset_id") -> tuple[DataFrame, DataFrame]:
    """A summary per key, and its ``top`` trades beyond the threshold (by size, ties by asset and signal date)."""
    size = F.abs(F.col(value))
    summary = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(size > threshold).alias("extreme_trades"), F.max(size).alias("max_size"), F.max(F.datediff("exit_date", "entry_date")).alias("max_days"),
        div(F.max(F.abs("weighted_return")), F.sum(F.abs("weighted_return"))).alias("top_weighted_share"),
    )
    summary = summary.join(exact_quantiles(trades, keys, {"p99_size": (size, 0.99), "p99_participation": (F.col("participation_rate"), 0.99)}), keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(size.desc(), tie, "signal_date"))
    return summary, trades.where(size > threshold).withColumn("place", place).where(F.col("place") <= top)


def reference_riskoff(curve: DataFrame, reference: DataFrame, keys: list[str], multiplier: float) -> DataFrame:
    """Returns times ``multiplier`` on the dates that a reference table (keys, date, riskoff) marks; other dates stay whole."""
    marked = reference.groupBy(*keys, "date").agg(F.max(F.coalesce("riskoff", F.lit(False))).alias("riskoff"))
    out = curve.join(marked, [*keys, "date"], "left").withColumn("riskoff", F.coalesce("riskoff", F.lit(False)))
    out = out.withColumn("guard_exposure", F.when(F.col("riskoff"), F.lit(multiplier)).otherwise(1.0))
    return out.withColumn("guarded_return", F.coalesce("period_return", F.lit(0.0)) * F.col("guard_exposure"))
