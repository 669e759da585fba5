"""Neutralisation: residuals of cross-sectional regressions, winsorising, demeaning, ranks within size buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w


#: A column of which less than this share (of its sum of squares) is left depends on the columns before it.
DEPENDENT = 1e-13


def partial_out(df: DataFrame, cases: dict[str, tuple[str, list[str]]], keys: tuple[str, ...], on_singular: str = "min_norm", against: dict[str, str] | None = None) -> DataFrame:
    """What centred columns leave of another centred one per key: ``cases`` is out -> (column, columns to take off).

    Columns are taken off one after the other, each from the column and from those still to come (modified Gram-Schmidt).
    What is left does not depend on how a rank-deficient system is solved: a column that depends on earlier ones is passed
    over, or with on_singular="null" nothing is left. Every step is one window by key for all cases, on rows that are dealt
    and sorted once: nothing is aggregated apart and joined back, so the rows are not computed twice. Nothing is left where a
    sum is not a number.

    against: columns by whose sum of squares others are found dependent, instead of by their own.
    """
    over = w.cross(keys)
    now = {o: [F.col(y), *map(F.col, xs)] for o, (y, xs) in cases.items()}
    sized = lambda x: F.col((against or {}).get(x, x))
    name = lambda o, i: f"__{o}_{i}"
    whole = {f"__{o}_all{i}": F.sum(sized(x) * sized(x)).over(over) for o, (_, xs) in cases.items() for i, x in enumerate(xs, 1)}
    df = df.withColumns({name(o, i): x for o, cols in now.items() for i, x in enumerate(cols)}).withColumns(whole)
    made = [*whole, *[name(o, i) for o, cols in now.items() for i in range(len(cols))]]
    for step in range(1, 1 + max(len(xs) for _, xs in cases.values())):
        sums, less = {}, {}
        for o, (_, xs) in cases.items():
            if step > len(xs):
                continue
            e, size = F.col(name(o, step)), F.col(f"__{o}_size{step}")
            sums[f"__{o}_size{step}"] = F.sum(e * e).over(over)
            alone = size > DEPENDENT * F.col(f"__{o}_all{step}")
            for i in [0, *range(step + 1, len(xs) + 1)]:
                dot = f"__{o}_dot{step}_{i}"
                sums[dot] = F.sum(e * F.col(name(o, i))).over(over)
                otherwise = F.lit(None) if on_singular == "null" else F.col(name(o, i))
                less[name(o, i)] = F.when(F.isnan(size), F.lit(None)).when(alone, F.col(name(o, i)) - F.col(dot) / size * e).otherwise(otherwise)
        df = w.steps(df, sums, less).drop(*sums)
    left = {o: F.when(~F.isnan(name(o, 0)), F.col(name(o, 0))) for o in cases}
    return df.withColumns(left).drop(*made)


def ols_residual(df: DataFrame, y: str, xs: list[str], keys: tuple[str, ...] = w.CROSS, least: int = 5, on_singular: str = "null", out: str = "residual") -> DataFrame:
    """What a regression of y on xs (with a constant) per cross-section leaves, NULL where it cannot be fitted.

    on_singular: "null" skips a rank-deficient cross-section, "min_norm" takes the smallest solution.
    """
    return ols_residuals(df, {out: (y, xs)}, keys, {out: least}, on_singular)


def ols_residuals(df: DataFrame, cases: dict[str, tuple[str, list[str]]], keys: tuple[str, ...], least: dict[str, int], on_singular: str = "null") -> DataFrame:
    """ols_residual() of several regressions, out -> (y, xs), in the same windows; see partial_out().

    Columns are centred first over the rows that have all of them, which keeps the system well conditioned.
    """
    over = w.cross(keys)
    c = lambda o, i: f"__c_{o}_{i}"
    present, centred, at = {}, {}, {}
    for o, (y, xs) in cases.items():
        whole = F.lit(True)
        for x in (y, *xs):
            whole = whole & F.col(x).isNotNull()
        present |= {c(o, i): F.when(whole, F.col(x).cast("double")) for i, x in enumerate((y, *xs))}
        # of equal values exactly nothing is left
        moves = lambda x: F.min(x).over(over) < F.max(x).over(over)
        centred |= {c(o, i): F.when(moves(c(o, i)), F.col(c(o, i)) - F.avg(c(o, i)).over(over)).otherwise(F.col(c(o, i)) * 0.0) for i in range(1 + len(xs))} | {f"__n_{o}": F.count(c(o, 0)).over(over)}
        at[o] = (c(o, 0), [c(o, i) for i in range(1, 1 + len(xs))])
    df = partial_out(w.steps(df, present, centred), at, keys, on_singular)
    return df.withColumns({o: F.when(F.col(f"__n_{o}") >= least[o], F.col(o)) for o in cases}).drop(*present, *[f"__n_{o}" for o in cases])


def industry_style_residual(df: DataFrame, y: str, styles: list[str], keys: tuple[str, ...] = w.CROSS, industry: str = "industry", least: int = 30, least_industries: int = 3, out: str = "residual") -> DataFrame:
    """What industry dummies and styles together leave of a factor's cross-section, NULL where it cannot be fitted.

    Factor and styles are z-scores over the rows that have all of them and an industry (0 where nothing varies). Industries
    may be many: taking the industry's mean off both sides leaves the same residual as a dummy each (partialling out), so
    only the styles are taken off. Windows by industry lie within those by cross-section, so the rows are shuffled once.
    Collinear styles leave what the smallest solution does.
    """
    cols = [y, *styles]
    whole = F.col(industry).isNotNull()
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    over, inner = w.cross(keys), w.cross((*keys, industry))
    v, z, d = (lambda c, p=p: f"{p}_{c}" for p in "vzd")
    scaled = w.steps(
        df,
        {v(c): F.when(whole, F.col(c)) for c in cols},
        {"n_rows": F.count(v(y)).over(over), "n_inner": F.count(v(y)).over(inner)} | {z(c): F.when(whole, F.coalesce(w.zscore(v(c), keys), F.lit(0.0))) for c in cols},
        {d(c): F.col(z(c)) - F.avg(z(c)).over(inner) for c in cols} | {"n_industries": F.round(F.sum(F.when(whole, 1 / F.col("n_inner"))).over(over))},
    )
    fitted = partial_out(scaled, {"__left": (d(y), [d(x) for x in styles])}, keys, against={d(x): z(x) for x in styles})
    enough = (F.col("n_rows") >= least) & (F.col("n_industries") >= least_industries)
    left = fitted.withColumn(out, F.when(enough, F.col("__left")))
    varies = F.stddev_pop(out).over(over) > 1e-12
    return left.withColumn(out, F.when(varies, F.col(out))).drop("__left", "n_rows", "n_inner", "n_industries", *[n(c) for n in (v, z, d) for c in cols])


def rank_residual(df: DataFrame, y: str, x: str, keys: tuple[str, ...] = w.CROSS) -> Column:
    """Residual of y on one exposure over the cross-section, as a column."""
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    a, b = F.when(both, F.col(y)), F.when(both, F.col(x))
    over = w.cross(keys)
    moves = F.min(b).over(over) < F.max(b).over(over)
    return F.when(moves, a - F.regr_intercept(a, b).over(over) - F.regr_slope(a, b).over(over) * b)


def winsorize(c: str, low: float, high: float, keys: tuple[str, ...] = w.CROSS) -> Column:
    """Clipped to the cross-section's interpolated quantiles."""
    at = lambda q: F.percentile(F.col(c), q).over(w.cross(keys))
    return F.when(F.col(c).isNotNull(), F.least(F.greatest(c, at(low)), at(high)))


def median_demean(c: str, keys: tuple[str, ...] = ("date", "market", "industry")) -> Column:
    return F.col(c) - F.median(c).over(w.cross(keys))


def size_bucket_rank(df: DataFrame, c: str, size: str, q: int = 5, keys: tuple[str, ...] = w.CROSS, out: str = "bucket_rank") -> DataFrame:
    """Fractional rank of c within buckets of size."""
    both = F.col(c).isNotNull() & F.col(size).isNotNull()
    df = df.withColumn("size_present", F.when(both, F.col(size)))
    df = df.withColumn("bucket", w.edge_bucket("size_present", q, keys))
    df = df.withColumn("in_bucket", F.when(F.col("bucket").isNotNull(), F.col(c)))
    return df.withColumn(out, w.pct_rank("in_bucket", (*keys, "bucket"))).drop("size_present", "in_bucket")


def industry_fit(df: DataFrame, y: str, keys: tuple[str, ...] = w.CROSS, industry: str = "industry") -> DataFrame:
    """Share of a factor's cross-section variance that industry means explain; one row per key."""
    d = df.where(F.col(y).isNotNull()).withColumns({"m": F.avg(y).over(w.cross(keys)), "g": F.avg(y).over(w.cross((*keys, industry)))})
    sums = d.groupBy(*keys).agg(F.sum((F.col(y) - F.col("g")) ** 2).alias("sse"), F.sum((F.col(y) - F.col("m")) ** 2).alias("sst"), F.count(F.lit(1)).alias("n"))
    return sums.select(*keys, F.when(F.col("sst") > 1e-18, 1 - F.col("sse") / F.col("sst")).alias("industry_r2"), "n")


def breadth_bridge(rows: DataFrame, keys: tuple[str, ...] = ("date", "market"), industry: str = "industry", least_assets: int = 3, least_industries: int = 3, top: float = 0.8, bottom: float = 0.2, picked: int = 1) -> DataFrame:
    """From stocks to industries: whether industries whose stocks rank high (breadth) go on to earn more; one row per key.

    Rows have factor_value and forward_return. An industry's breadth is the mean factor rank of its stocks, plus the share of
    them in the top of the cross-section, less the share in the bottom. The best and worst ``picked`` industries (but one
    fewer than there are) are compared with all. Ranks are taken once per cross-section; industries are sums of it.
    """
    whole = rows.where(f"factor_value is not null and forward_return is not null and {industry} is not null")
    ranked = whole.withColumn("__rank", w.pct_rank("factor_value", keys))
    share = lambda c: F.avg(c.cast("double"))
    groups = ranked.groupBy(*keys, industry).agg(
        F.count_distinct("asset_id").alias("__n"), F.count(F.lit(1)).alias("__rows"), (F.avg("__rank") + share(F.col("__rank") >= top) - share(F.col("__rank") <= bottom)).alias("breadth"), F.avg("forward_return").alias("__earned")
    )
    groups = groups.withColumn("__all", F.sum("__rows").over(w.cross(keys))).where(F.col("__n") >= least_assets).withColumn("breadth", F.round("breadth", 10))
    order = Window.partitionBy(*keys).orderBy(F.desc("breadth"), industry)
    placed = groups.withColumns({"__k": F.row_number().over(order), "__m": F.count(F.lit(1)).over(w.cross(keys)), "__br": w.avg_rank("breadth", keys), "__er": w.avg_rank("__earned", keys)})
    n = F.least(F.lit(picked), F.greatest(F.lit(1), F.col("__m") - 1))
    mean = lambda c: F.avg(F.when(c, F.col("__earned")))
    out = placed.groupBy(*keys).agg(
        F.max("__all").alias("stocks"), F.max("__m").cast("long").alias("industries"), w.corr(F.col("__br"), F.col("__er")).alias("industry_rank_ic"),
        mean(F.col("__k") <= n).alias("top_return"), F.avg("__earned").alias("all_return"), mean(F.col("__k") > F.col("__m") - n).alias("bottom_return"),
    )
    enough = F.col("industries") >= least_industries
    out = out.withColumns({c: F.when(enough, F.col(c)) for c in ("industry_rank_ic", "top_return", "all_return", "bottom_return")})
    return out.withColumns({"eligible": enough, "excess_return": F.col("top_return") - F.col("all_return"), "spread_return": F.col("top_return") - F.col("bottom_return")})
