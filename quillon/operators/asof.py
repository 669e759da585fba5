"""Point-in-time joins: as of a date, after an event, within an interval, so many sessions apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .labels import sessions


def asof_by_key(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, values: list[str]) -> DataFrame:
    """The last right row of the key at or before each left row; NULLs where there is none.

    Both sides are put into one ordered stream per key, and the last right row is carried forward: one shuffle, no
    range join. Right rows must be unique by key and date.
    """
    row, value = F.struct(*left.columns), F.struct(*values, F.col(right_on).alias("as_of"))
    none = lambda df, c: F.lit(None).cast(df.select(c.alias("v")).schema["v"].dataType)
    l = left.withColumns({"__at": F.col(left_on), "__side": F.lit(1), "__row": row, "__value": none(right, value)})
    r = right.withColumns({"__at": F.col(right_on), "__side": F.lit(0), "__row": none(left, row), "__value": value})
    pick = [*keys, "__at", "__side", "__row", "__value"]
    order = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.select(*pick).unionByName(r.select(*pick)).withColumn("__last", F.last("__value", ignorenulls=True).over(order))
    return both.where("__side = 1").select("__row.*", *[F.col(f"__last.{v}").alias(v) for v in values], F.col("__last.as_of").alias("as_of"))


def asof_global(left: DataFrame, states: DataFrame, left_on: str, state_on: str, values: list[str]) -> DataFrame:
    """The state in force on each left date, the largest one where a date has several.

    Only distinct dates meet the states, in one ordered stream that the calendar bounds; rows are joined by date.
    """
    one = states.groupBy(F.col(state_on).alias("__from")).agg(F.max(F.struct(*values)).alias("__state"))
    days = left.select(F.lit(0).alias("__all"), F.col(left_on).alias("__day")).distinct()
    hit = asof_by_key(days, one.withColumn("__all", F.lit(0)), ["__all"], "__day", "__from", ["__state"])
    picked = hit.select("__day", "as_of", *[F.col(f"__state.{v}").alias(v) for v in values])
    return left.join(picked, left[left_on] == picked["__day"], "left").drop("__day")


def session_after(events: DataFrame, bars: DataFrame, event_on: str, extra: int = 0, strict: bool = True, key: str = "market") -> DataFrame:
    """The first session after each event (or from it on), ``extra`` sessions later: ``signal_date``.

    Sessions are those of the market, or with key="asset_id" the asset's own bars. Only the distinct event dates of a key
    go through the as-of window, which the calendar bounds; events are joined by date. Events without such a session are
    left out.
    """
    days = sessions(bars, key)
    dates = events.select(key, F.col(event_on).alias("__event")).distinct()
    # number of sessions up to the event
    at = asof_by_key(dates, days.withColumnRenamed("date", "__session_date"), [key], "__event", "__session_date", ["session"])
    same = (F.col("as_of") == F.col("__event")) if not strict else F.lit(False)
    first = F.coalesce("session", F.lit(0)) + F.when(same, 0).otherwise(1) + extra
    found = at.select(key, "__event", first.alias("__target")).join(days.select(key, F.col("date").alias("signal_date"), F.col("session").alias("__target")), [key, "__target"]).drop("__target")
    return events.withColumn("__event", F.col(event_on)).join(found, [key, "__event"]).select(*events.columns, "signal_date")


def interval_join(facts: DataFrame, spans: DataFrame, keys: list[str], on: str, start: str, end: str) -> DataFrame:
    """Facts with every span of their key that covers their date; an open end is NULL."""
    inside = (F.col(on) >= F.col(start)) & (F.col(end).isNull() | (F.col(on) <= F.col(end)))
    return facts.join(spans, keys).where(inside)


def interval_join_by_month(facts: DataFrame, spans: DataFrame, keys: list[str], on: str, start: str, end: str) -> DataFrame:
    """As interval_join(), for keys with many spans: spans are cut into months and meet the facts of the month alone.

    Open ends, and ends beyond the facts, are cut at the facts' last date.
    """
    month = lambda d: F.year(d) * 12 + F.month(d)
    last = facts.agg(F.max(on)).first()[0]  # one date
    cut = spans.withColumn("__end", F.least(F.coalesce(end, F.lit(last)), F.lit(last))).where(F.col(start) <= F.col("__end"))
    cut = cut.withColumn("__month", F.explode(F.sequence(month(start), month("__end"))))
    met = facts.withColumn("__month", month(on)).join(cut, [*keys, "__month"])
    return met.where(F.col(on).between(F.col(start), F.col("__end"))).drop("__month", "__end")


def covered(facts: DataFrame, spans: DataFrame, keys: list[str], on: str, start: str, end: str, out: str = "covered") -> DataFrame:
    """Whether any span of the key covers the date. Spans are merged per key first, so rows are not multiplied."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    past = F.max(F.coalesce(F.col(end), F.lit("9999-12-31").cast("date"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.coalesce((F.col(start) > F.date_add(past, 1)).cast("int"), F.lit(1)))
    marked = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = marked.groupBy(*keys, "__island").agg(F.min(start).alias("__from"), F.max(F.coalesce(F.col(end), F.lit("9999-12-31").cast("date"))).alias("__to"))
    last = asof_by_key(facts, islands.select(*keys, "__from", "__to"), keys, on, "__from", ["__to"])
    return last.withColumn(out, F.coalesce(F.col("__to") >= F.col(on), F.lit(False))).drop("__to", "as_of")


def sessions_ago(rows: DataFrame, bars: DataFrame, value: str, k: int, out: str) -> DataFrame:
    """The asset's value exactly k market sessions ago, NULL if it has no row there."""
    days = sessions(bars)
    numbered = rows.join(days, ["market", "date"])
    past = numbered.select("asset_id", "market", (F.col("session") + k).alias("session"), F.col(value).alias(out))
    return numbered.join(past, ["asset_id", "market", "session"], "left").drop("session")
