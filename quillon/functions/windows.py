"""Window building blocks: rolling statistics per asset, ranks and scores per cross-section.

Missing values are NULL throughout; a rolling statistic needs ``least`` present values in its frame (all of it by
default); every division yields NULL where the divisor is 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSET = ("asset_id",)
CROSS = ("date", "market")


def by_asset() -> Window:
    return Window.partitionBy(*ASSET).orderBy("date")


def frame(n: int, keys: tuple[str, ...] = ASSET, order: str = "date", shift: int = 0) -> Window:
    """The last n rows up to the current one, or to ``shift`` rows before it."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1) - shift, -shift)


def cross(keys: tuple[str, ...] = CROSS) -> Window:
    return Window.partitionBy(*keys)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0."""
    return as_col(a) / F.nullif(as_col(b), F.lit(0.0))


def lag(c: Column | str, n: int = 1, keys: tuple[str, ...] = ASSET, order: str = "date") -> Column:
    return F.lag(as_col(c), n).over(Window.partitionBy(*keys).orderBy(order))


def change(c: Column | str, n: int = 1) -> Column:
    """Relative change over n rows of the asset."""
    return div(as_col(c), lag(c, n)) - 1


def roll(agg: Callable[[Column], Column], c: Column | str, n: int, least: int | None = None, keys: tuple[str, ...] = ASSET, order: str = "date", shift: int = 0) -> Column:
    w = frame(n, keys, order, shift)
    c = as_col(c)
    return F.when(F.count(c).over(w) >= (n if least is None else least), agg(c).over(w))


def mean(c, n, least=None, **k) -> Column:
    return roll(F.avg, c, n, least, **k)


def std(c, n, least=None, **k) -> Column:
    return roll(F.stddev_pop, c, n, least, **k)


def total(c, n, least=None, **k) -> Column:
    return roll(F.sum, c, n, least, **k)


def highest(c, n, least=None, **k) -> Column:
    return roll(F.max, c, n, least, **k)


def lowest(c, n, least=None, **k) -> Column:
    return roll(F.min, c, n, least, **k)


def middle(c, n, least=None, **k) -> Column:
    return roll(lambda x: F.percentile(x, 0.5), c, n, least, **k)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once."""
    return F.transform(F.array(value), use)[0]


def array_median(values: Column) -> Column:
    """Median of an array without NULLs; NULL of an empty one."""
    at = lambda s: (F.element_at(s, ((F.size(s) + 1) / 2).cast("int")) + F.element_at(s, (F.size(s) / 2).cast("int") + 1)) / 2
    return F.when(F.size(values) > 0, _with(F.sort_array(values), at))


def mad(c: Column | str, n: int, least: int | None = None, keys: tuple[str, ...] = ASSET, order: str = "date", shift: int = 0) -> Column:
    """Rolling median absolute deviation from the window's own median. The frame is an array of n values at most."""
    off = lambda x: _with(array_median(x), lambda m: array_median(F.transform(x, lambda v: F.abs(v - m))))
    return _with(roll(F.collect_list, c, n, least, keys, order, shift), off)


def exponential(values: Column, span: int, least: int) -> Column:
    """Recursive exponential means along an array: 2 / (span + 1) of the new value, the rest of the mean before.

    The first present value starts it; over missing values the old mean loses weight; NULL until ``least`` values are there
    and at the start. A fold on the JVM: its state is the mean, its weight and the count.
    """
    a = 2.0 / (span + 1)
    zero = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(1.0).alias("weight"), F.lit(0).alias("n"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        kept = s["weight"] * (1 - a)
        mean = F.when(x.isNull(), s["mean"]).when(s["mean"].isNull(), x).otherwise((kept * s["mean"] + a * x) / (kept + a))
        n = s["n"] + F.when(x.isNotNull(), 1).otherwise(0)
        weight = F.when(x.isNull() & s["mean"].isNotNull(), kept).otherwise(1.0)
        return F.struct(mean.alias("mean"), weight.alias("weight"), n.alias("n"), F.concat(s["out"], F.array(F.when(n >= least, mean))).alias("out"))

    return F.aggregate(values, zero, step, lambda s: s["out"])


def pair_roll(agg: Callable[[Column, Column], Column], a: Column | str, b: Column | str, n: int, least: int | None = None, shift: int = 0) -> Column:
    """A statistic of pairs; a pair counts where both values are present."""
    a, b = as_col(a), as_col(b)
    both = a.isNotNull() & b.isNotNull()
    w = frame(n, shift=shift)
    x, y = F.when(both, a), F.when(both, b)
    moves = (F.min(x).over(w) < F.max(x).over(w)) & (F.min(y).over(w) < F.max(y).over(w))
    return F.when((F.count(x).over(w) >= (n if least is None else least)) & moves, agg(x, y).over(w))


def corr(a: Column, b: Column) -> Column:
    """Correlation as an aggregate of pairs, NULL where either side does not vary (the built-in one raises there)."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    moves = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(moves, F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def roll_corr(a: Column | str, b: Column | str, n: int, least: int | None = None) -> Column:
    part = lambda agg: pair_roll(agg, a, b, n, least)
    return part(F.covar_pop) / F.nullif(part(lambda x, _: F.stddev_pop(x)) * part(lambda _, y: F.stddev_pop(y)), F.lit(0.0))


def skew(c: Column | str, n: int, least: int | None = None) -> Column:
    """Bias-corrected skewness."""
    k = F.count(as_col(c)).over(frame(n))
    raw = roll(F.skewness, c, n, least)
    return F.when(k > 2, raw * F.sqrt(k * (k - 1)) / (k - 2))


def avg_rank(c: Column | str, keys: tuple[str, ...]) -> Column:
    """Rank from 1 among present values, ties sharing their mean rank.

    NULLs come first and are taken off again. Rank, ties and counts are frames of one ordered window, so they share its
    sort and one pass.
    """
    c = as_col(c)
    w = Window.partitionBy(*keys).orderBy(c)
    ties = F.count(c).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(c.isNotNull(), F.rank().over(w) - (F.count(F.lit(1)).over(_whole(w)) - F.count(c).over(_whole(w))) + (ties - 1) / 2)


def _whole(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def pct_rank(c: Column | str, keys: tuple[str, ...] = CROSS) -> Column:
    """Mean rank over the count of present values."""
    c = as_col(c)
    return avg_rank(c, keys) / F.count(c).over(_whole(Window.partitionBy(*keys).orderBy(c)))


def deal(df: DataFrame, parts: int | None = None, keys: tuple[str, ...] = CROSS) -> DataFrame:
    """Rows by cross-section, for all windows that follow: in ``parts`` partitions, or as the session sets it.

    The number has to grow with the table: with a fixed one, the rows that a task sorts grow with the table.
    """
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def pct_ranks(df: DataFrame, values: dict[str, Column | tuple[Column, Column]], keys: tuple[str, ...] = CROSS, ids: tuple[str, ...] = ("asset_id",)) -> DataFrame:
    """pct_rank of several values, added to df: one sort of narrow rows (value by value) for all of them.

    A window per value would sort the whole rows once each. A row's own columns travel once, beside its values, and are put
    together again by row; those outside keys and ids must be of fixed width. df is to be dealt by keys before, so that
    this needs no exchange. A pair is a value and the bucket within keys that it is ranked in.
    """
    if not values:
        return df
    kept = [c for c in df.columns if c not in (*keys, *ids)]
    whole = F.struct(*kept)
    none = F.lit(None)
    entry = lambda i, v, b, own: F.struct(F.lit(i).alias("__what"), b.cast("int").alias("__bucket"), v.cast("double").alias("__value"), own.alias("__own"))
    entries = [entry(0, none, none, whole), *[entry(i, *(v if isinstance(v, tuple) else (v, none)), F.when(F.lit(False), whole)) for i, v in enumerate(values.values(), 1)]]
    rows = df.withColumn("__row", F.monotonically_increasing_id()).select(*keys, *ids, "__row", F.inline(F.array(*entries)))
    by = Window.partitionBy(*keys, "__what", "__bucket").orderBy("__value")
    ties = F.count(F.lit(1)).over(by.rangeBetween(Window.currentRow, Window.currentRow))
    rank = (F.rank().over(by) + (ties - 1) / 2) / F.count(F.lit(1)).over(_whole(by))
    ranked = rows.where("__what = 0 or __value is not null").withColumn("__rank", rank)
    own = [F.max(F.col("__own")[c]).alias(c) for c in kept]
    return ranked.groupBy(*keys, *ids, "__row").agg(*own, *[F.max(F.when(F.col("__what") == i, F.col("__rank"))).alias(n) for i, n in enumerate(values, 1)]).drop("__row")


def upper_half(values: dict[str, Column], keys: tuple[str, ...] = CROSS) -> list[dict[str, Column]]:
    """Stages for steps() that make a flag for each value: whether its pct_rank is above a half.

    That takes the median and, for values equal to it, how many are below it and how many equal it: two passes over the
    cross-section for all flags together, without a sort. Columns beside the flags begin with an underscore.
    """
    w = Window.partitionBy(*keys)
    at = lambda n: F.col(f"_m_{n}")
    counts = {}
    for n in values:
        counts |= {f"_b_{n}": F.count_if(F.col(f"_v_{n}") < at(n)).over(w), f"_e_{n}": F.count_if(F.col(f"_v_{n}") == at(n)).over(w), f"_n_{n}": F.count(F.col(f"_v_{n}")).over(w)}
    flags = {n: (F.col(f"_v_{n}") > at(n)) | (F.col(f"_v_{n}") == at(n)) & (2 * F.col(f"_b_{n}") + F.col(f"_e_{n}") + 1 > F.col(f"_n_{n}")) for n in values}
    return [{f"_v_{n}": v for n, v in values.items()}, {f"_m_{n}": F.median(F.col(f"_v_{n}")).over(w) for n in values}, counts, flags]


def zscore(c: Column | str, keys: tuple[str, ...] = CROSS, sample: bool = False) -> Column:
    """Distance from the cross-section's mean in standard deviations; NULL where nothing varies."""
    c = as_col(c)
    sd = (F.stddev_samp(c) if sample else F.stddev_pop(c)).over(cross(keys))
    return (c - F.avg(c).over(cross(keys))) / F.when(sd > 1e-12, sd)


def demean(c: Column | str, keys: tuple[str, ...]) -> Column:
    c = as_col(c)
    return c - F.avg(c).over(cross(keys))


def first_rank(c: Column | str, keys: tuple[str, ...] = CROSS, tie: str = "asset_id", down: bool = False) -> Column:
    """1, 2, ... by value, ties by ``tie``; NULL where the value is."""
    c = as_col(c)
    order = c.desc_nulls_last() if down else c.asc_nulls_last()
    return F.when(c.isNotNull(), F.row_number().over(Window.partitionBy(*keys).orderBy(order, tie)))


def ceil_bucket(c: Column | str, q: int, keys: tuple[str, ...], tie: str = "asset_id") -> Column:
    """Buckets 1..q: the ceiling of rank * q / n."""
    c = as_col(c)
    n = F.count(c).over(cross(keys))
    return F.when(c.isNotNull(), F.least(F.lit(q), F.greatest(F.lit(1), F.ceil(first_rank(c, keys, tie) * q / n)))).cast("int")


def edge_bucket(c: Column | str, q: int, keys: tuple[str, ...], tie: str = "asset_id", at_most: bool = False) -> Column:
    """Buckets 0..q-1 between interpolated quantile edges of the ranks; one value alone is bucket 0.

    at_most: no more buckets than values.
    """
    c = as_col(c)
    n, r = F.count(c).over(cross(keys)), first_rank(c, keys, tie)
    q = F.least(F.lit(q), n) if at_most else F.lit(q)
    place = F.when(n == 1, F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil(div((r - 1) * q, (n - 1).cast("double"))) - 1))
    return F.when(c.isNotNull(), place).cast("int")


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    c = as_col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def row_mean(*cols: Column | str) -> Column:
    """Mean of several columns, NULL if any is."""
    cols = [as_col(c) for c in cols]
    return sum(cols[1:], cols[0]) / len(cols)


def row_mean_present(*cols: Column | str) -> Column:
    """Mean of the columns that are present."""
    cols = [as_col(c) for c in cols]
    present = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return div(sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0))), present)


def steps(df: DataFrame, *stages: dict[str, Column]) -> DataFrame:
    """Columns added stage by stage; a stage may use what earlier ones have made."""
    for s in stages:
        df = df.withColumns(s)
    return df


def exact_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], counts: tuple[str, str] | None = None) -> DataFrame:
    """(keys, names): interpolated quantiles without a table of all values in the memory of one task.

    Equal values are counted map-side, then ordered within the key, where the sort may spill; a quantile is what stands at
    the two places around it. NULLs do not count; a key without values has NULL. Quantiles of one value (the same Column object)
    share its order.
    counts: names for the number of rows, and of values of the first one, where they are wanted as well.
    """
    first = {n: next(m for m in wanted if wanted[m][0] is wanted[n][0]) for n in wanted}
    own = list(dict.fromkeys(first.values()))
    rows = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("__name"), wanted[n][0].cast("double").alias("__value")) for n in own])))
    counted = rows.groupBy(*keys, "__name", "__value").agg(F.count("__value").alias("__n"), F.count(F.lit(1)).alias("__rows"))
    order = Window.partitionBy(*keys, "__name").orderBy("__value")
    placed = counted.withColumns({"__upto": F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum("__n").over(Window.partitionBy(*keys, "__name"))})
    at = {}
    for n, (_, q) in wanted.items():
        place = F.lit(q) * (F.col("__all") - 1)
        inside = lambda i: (F.col("__name") == first[n]) & (F.col("__n") > 0) & (i >= F.col("__upto") - F.col("__n")) & (i < F.col("__upto"))  # noqa: B023, E731
        low, high = (F.max(F.when(inside(f(place)), F.col("__value"))) for f in (F.floor, F.ceil))
        at[n] = low + (high - low) * F.max(F.when(F.col("__name") == first[n], place - F.floor(place)))
    if counts:
        at |= {c: F.sum(F.when(F.col("__name") == own[0], F.col(x))) for c, x in zip(counts, ("__rows", "__n"))}
    return placed.groupBy(*keys).agg(*[c.alias(n) for n, c in at.items()])
