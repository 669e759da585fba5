"""Guards against chance: purged combinations of test groups and their paths, deflated Sharpe ratios, neighbours in a lattice of
parameters, and duplicates marked in the order of rank.

Cases (parameter choices, candidates) are tens to thousands; what grows are the dates and series, which stay in Spark.
"""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import windows as w
from ..functions.windows import div

EULER_GAMMA = 0.5772156649015329
MOST_CASES = 5_000


def date_groups(dates: DataFrame, keys: list[str], groups: int) -> DataFrame:
    """(keys, date, position, group): distinct dates cut into runs whose sizes differ by one at most, longer ones first.

    Keys with fewer dates than groups are left out.
    """
    order = Window.partitionBy(*keys).orderBy("date")
    n = F.col("__n")
    days = dates.select(*keys, "date").distinct().withColumns({"position": F.row_number().over(order) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    size, more = F.floor(n / groups), n % groups
    long_part = more * (size + 1)
    group = F.when(F.col("position") < long_part, F.floor(F.col("position") / (size + 1))).otherwise(more + F.floor((F.col("position") - long_part) / size))
    return days.where(n >= groups).select(*keys, "date", "position", group.cast("int").alias("group"))


def purged_combinations(dates: DataFrame, keys: list[str], groups: int, chosen: int, purge: int = 0, embargo: int = 0) -> DataFrame:
    """(keys, split, date, group, role) for every combination of ``chosen`` test groups, numbered from 1.

    Dates from ``purge`` positions before a test group to ``embargo`` positions after it are `purged`, the rest is `train`. A
    date meets the runs of a split's groups, never single test dates. The combinations depend on the two counts alone.
    """
    if not 1 <= chosen < groups:
        raise ValueError("the number of test groups must be between 1 and groups - 1")
    table = [(i, list(c)) for i, c in enumerate(itertools.combinations(range(groups), chosen), start=1)]
    splits = dates.sparkSession.createDataFrame(table, "split int, tested array<int>")
    # a key's runs are at most ``groups``, gathered beside its dates: the dates are not computed again for them
    of_run = Window.partitionBy(*keys, "group")
    days = date_groups(dates, keys, groups).withColumn("run", F.struct("group", F.min("position").over(of_run).alias("a"), F.max("position").over(of_run).alias("z")))
    met = days.withColumn("runs", F.collect_set("run").over(Window.partitionBy(*keys))).crossJoin(F.broadcast(splits))
    near = F.exists("runs", lambda r: F.array_contains("tested", r["group"]) & F.col("position").between(r["a"] - purge, r["z"] + embargo))
    return met.select(*keys, "split", "date", "group", F.when(F.array_contains("tested", F.col("group")), "test").when(near, "purged").otherwise("train").alias("role"))


def evaluate_combinations(curves: DataFrame, combinations: DataFrame, keys: list[str], case: str, per_year: float = 252.0) -> DataFrame:
    """(keys, case, split, observations, mean_return, sharpe, positive) of every test set.

    Returns are summed once by group; a test set adds up the sums of its groups.
    """
    groups = combinations.select(*keys, "date", "group").distinct()
    r = F.col("period_return")
    parts = curves.where(r.isNotNull()).join(groups, [*keys, "date"]).groupBy(*keys, case, "group").agg(F.count(r).alias("n"), F.avg(r).alias("m"), F.var_pop(r).alias("v"))
    tests = combinations.where("role = 'test'").select(*keys, "split", "group").distinct()
    n, m = F.col("n"), F.col("m")
    sums = tests.join(parts, [*keys, "group"]).groupBy(*keys, case, "split").agg(F.sum("n").alias("observations"), F.sum(n * m).alias("s"), F.sum(n * (F.col("v") + m * m)).alias("q"))
    mean = F.col("s") / F.col("observations")
    spread = F.greatest(F.col("q") - F.col("observations") * mean * mean, F.lit(0.0))
    sd = F.when(F.col("observations") > 1, F.sqrt(spread / (F.col("observations") - 1)))
    # what rounding leaves of equal returns is no deviation
    sharpe = F.when(sd > 1e-7 * F.abs(mean), mean / sd * math.sqrt(per_year)).otherwise(0.0)
    return sums.select(*keys, case, "split", "observations", mean.alias("mean_return"), F.coalesce(sharpe, F.lit(0.0)).alias("sharpe"), (mean > 0).alias("positive"))


def combination_verdicts(evaluated: DataFrame, keys: list[str], case: str, least_positive: float = 0.5, least_p10: float = 0.0) -> DataFrame:
    """One row per case: splits, share of positive ones, 10 % quantile of means, median Sharpe ratio, and whether it passes."""
    out = evaluated.groupBy(*keys, case).agg(
        F.count(F.lit(1)).alias("splits"), F.avg(F.col("positive").cast("double")).alias("positive_rate"), F.percentile("mean_return", 0.1).alias("p10_mean_return"), F.percentile("sharpe", 0.5).alias("median_sharpe")
    )
    return out.withColumn("passes", (F.col("positive_rate") >= least_positive) & (F.col("p10_mean_return") >= least_p10))


def combination_paths(curves: DataFrame, combinations: DataFrame, keys: list[str], case: str) -> DataFrame:
    """(keys, path, periods, path_return, cases): out-of-sample histories put together from the splits.

    In each split the case with the best train score (mean over deviation, rounded to 10 digits; ties to the smaller case)
    is tested. A group is tested in several splits; its p-th one gives its dates to path p, so every path has all dates.
    """
    r = F.col("period_return")
    # scores, choices and places are windows over one join: curves and combinations are not computed again for each
    place = F.dense_rank().over(Window.partitionBy(*keys, "group", "role").orderBy("split"))
    met = curves.join(combinations.withColumn("path", F.when(F.col("role") == "test", place)), [*keys, "date"])
    trained, split = F.when(F.col("role") == "train", r), Window.partitionBy(*keys, "split")
    of_case = Window.partitionBy(*keys, "split", case)
    scored = met.withColumn("score", F.round(div(F.avg(trained).over(of_case), F.stddev_pop(trained).over(of_case)), 10))
    down = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(-F.col("score"))  # the order of a descending sort
    chosen = scored.withColumn("best", F.min(F.when(F.col("score").isNotNull(), F.struct(down.alias("s"), F.col(case).alias("case")))).over(split))
    chosen = chosen.where((F.col("role") == "test") & (F.col(case) == F.col("best.case")))
    return chosen.groupBy(*keys, "path").agg(F.count(r).alias("periods"), (F.product(1 + r) - 1).alias("path_return"), F.count_distinct(case).alias("cases"))


def _clipped(p: float) -> float:
    return min(max(p, 0.0), 1.0)


def deflated(sharpe: float, n: float, trials: int, skew: float = 0.0, kurtosis: float = 3.0, benchmark: float = 0.0) -> tuple[float, float]:
    """(hurdle, probability) that a Sharpe ratio per period beats what the best of so many trials without skill would show."""
    normal = NormalDist()
    error = math.sqrt(max(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe, 1e-12) / (n - 1)) if n > 1 else math.inf
    hurdle = benchmark
    if trials > 1 and math.isfinite(error):
        first, second = (normal.inv_cdf(min(1 - 1e-12, 1 - 1 / k)) for k in (trials, trials * math.e))
        hurdle += error * ((1 - EULER_GAMMA) * first + EULER_GAMMA * second)
    if not math.isfinite(error):
        return hurdle, 0.5 if sharpe == hurdle else float(sharpe > hurdle)
    return hurdle, _clipped(normal.cdf((sharpe - hurdle) / error))


@F.pandas_udf(T.StructType([T.StructField("hurdle", T.DoubleType()), T.StructField("dsr", T.DoubleType())]))
def _deflated(sharpe: pd.Series, n: pd.Series, trials: pd.Series, skew: pd.Series, kurt: pd.Series) -> pd.DataFrame:
    rows = [deflated(*x) if not any(math.isnan(v) for v in x) else (None, None) for x in zip(sharpe, n, trials, skew, kurt)]
    return pd.DataFrame(rows, columns=["hurdle", "dsr"])


def deflated_sharpe(curves: DataFrame, keys: list[str], case: str) -> DataFrame:
    """(keys, case, sharpe, n, trials, hurdle, dsr): every case of a key counts as a trial. One row per case meets Python."""
    r = F.col("period_return")
    s = curves.groupBy(*keys, case).agg(div(F.avg(r), F.stddev_samp(r)).alias("sharpe"), F.count(r).alias("n"), F.skewness(r).alias("skew"), (F.kurtosis(r) + 3).alias("kurtosis"))
    s = s.withColumn("trials", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return s.withColumn("d", _deflated("sharpe", "n", "trials", "skew", "kurtosis")).select(*keys, case, "sharpe", "n", "trials", "d.hurdle", "d.dsr")


def lattice_neighbours(cases: DataFrame, keys: list[str], axes: list[str], metric: str, least_fraction: float = 0.75, least_neighbours: int = 2) -> DataFrame:
    """Cells of a parameter lattice with how many neighbours hold up: one step at most along every axis, by dense rank.

    Cases of a cell are averaged; rows without a value on an axis or of the metric are left out. A neighbour passes with at
    least ``least_fraction`` of the cell's mean (of a mean that is not positive: all of it). A cell is copied to its
    3^axes - 1 neighbouring places, which meet the cells by equality: no pairs of cells are compared. ``best`` marks the
    cell of the greatest mean, ties to the first along the axes.
    """
    whole = F.col(metric).isNotNull()
    for a in axes:
        whole = whole & F.col(a).isNotNull()
    cells = cases.where(whole).groupBy(*keys, *axes).agg(F.avg(metric).alias("metric_mean"), F.count(F.lit(1)).alias("metric_count"))
    rank = {f"__r{i}": F.dense_rank().over(Window.partitionBy(*keys).orderBy(a)) for i, a in enumerate(axes)}
    ranked = cells.withColumns(rank)
    best = Window.partitionBy(*keys).orderBy(F.desc("metric_mean"), *axes)
    ranked = ranked.withColumn("best", F.row_number().over(best) == 1)
    moves = [m for m in itertools.product((-1, 0, 1), repeat=len(axes)) if any(m)]
    places = F.array(*[F.struct(*[(F.col(f"__r{i}") + d).alias(f"__r{i}") for i, d in enumerate(m)]) for m in moves])
    at = list(rank)
    sent = ranked.select(*keys, F.col("metric_mean").alias("__other"), F.inline(places))
    limit = F.when(F.col("metric_mean") > 0, F.col("metric_mean") * least_fraction).otherwise(F.col("metric_mean"))
    met = ranked.join(sent, [*keys, *at], "left")
    out = met.groupBy(*keys, *axes, "metric_mean", "metric_count", "best").agg(F.count("__other").alias("neighbours"), F.count_if(F.col("__other") >= limit).alias("passing"))
    return out.withColumns({"threshold": limit, "pass_rate": F.coalesce(div(F.col("passing").cast("double"), F.col("neighbours")), F.lit(0.0)), "stable": F.col("passing") >= least_neighbours})


def greedy_duplicates(candidates: DataFrame, pairs: DataFrame, keys: list[str], case: str, order: list[Column], threshold: float, most_similar: bool = False) -> DataFrame:
    """Candidates with ``kept``, ``duplicate_of`` and ``similarity``, decided in the order of rank.

    A candidate is compared with those kept before it only: what a dropped one resembles stays. It is a duplicate of the
    first kept one that is at least ``threshold`` similar, or with ``most_similar`` of the most similar such one (ties to
    the first). ``pairs`` has (keys, case, other, similarity), each pair once, in either order; ties of ``order`` go to the
    smaller case. Pairs beyond the threshold are gathered by the later candidate, and an ordered array per key is folded; more
    than ``MOST_CASES`` candidates of a key are refused.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, case))
    ranked = candidates.withColumn("__place", place)
    number = ranked.select(*keys, F.col(case).alias("__case"), "__place")
    close = pairs.where(F.col("similarity") >= threshold).select(*keys, F.col(case).alias("__a"), F.col("other").alias("__b"), "similarity")
    placed = close.join(number.select(*keys, F.col("__case").alias("__a"), F.col("__place").alias("__pa")), [*keys, "__a"]).join(number.select(*keys, F.col("__case").alias("__b"), F.col("__place").alias("__pb")), [*keys, "__b"])
    rival = F.struct(F.least("__pa", "__pb").alias("place"), F.col("similarity").cast("double").alias("similarity"))
    rivals = placed.groupBy(*keys, F.greatest("__pa", "__pb").alias("__place")).agg(F.sort_array(F.collect_list(rival)).alias("__rivals"))
    rows = ranked.select(*keys, case, "__place").join(rivals, [*keys, "__place"], "left")
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__place", F.col(case).alias("__case"), "__rivals"))).alias("__list"))
    checked = F.when(F.size("__list") <= MOST_CASES, F.col("__list")).otherwise(F.raise_error(F.lit(f"more than {MOST_CASES} candidates of a key")))
    verdict = "struct<place:int,displaced_by:int,similarity:double>"
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.array().cast(f"array<{verdict}>").alias("out"))

    def step(state: Column, c: Column) -> Column:
        near = F.filter(c["__rivals"], lambda x: F.array_contains(state["kept"], x["place"]))
        first = F.element_at(F.sort_array(F.transform(near, lambda x: F.struct((-x["similarity"]).alias("s"), x["place"].alias("place"))) if most_similar else F.transform(near, lambda x: F.struct(x["place"].alias("place"), (-x["similarity"]).alias("s")))), 1)
        found = F.coalesce(F.size(near), F.lit(0)) > 0
        row = F.struct(c["__place"].cast("int").alias("place"), F.when(found, first["place"]).cast("int").alias("displaced_by"), F.when(found, -first["s"]).alias("similarity"))
        kept = F.when(found, state["kept"]).otherwise(F.concat(state["kept"], F.array(c["__place"].cast("int"))))
        return F.struct(kept.alias("kept"), F.concat(state["out"], F.array(row)).alias("out"))

    folded = listed.select(*keys, F.col("__list.__case").alias("__cases"), F.inline(F.aggregate(checked, start, step, lambda s: s["out"])))
    named = folded.select(*keys, F.element_at("__cases", F.col("place")).alias(case), F.col("displaced_by").isNull().alias("kept"), F.when(F.col("displaced_by").isNotNull(), F.element_at("__cases", F.coalesce("displaced_by", F.lit(1)))).alias("duplicate_of"), "similarity")
    return candidates.join(named, [*keys, case])


def correlation_pairs(curves: DataFrame, keys: list[str], case: str, least: int = 3) -> DataFrame:
    """(keys, case, other, similarity): correlation of every pair of return series with enough shared dates."""
    b = curves.select(*keys, "date", F.col(case).alias("other"), F.col("period_return").alias("__r"))
    both = curves.select(*keys, "date", case, "period_return").join(b, [*keys, "date"]).where(F.col(case) < F.col("other"))
    out = both.groupBy(*keys, case, "other").agg(w.corr(F.col("period_return"), F.col("__r")).alias("similarity"), F.count(F.lit(1)).alias("n"))
    return out.where((F.col("n") >= least) & F.col("similarity").isNotNull()).drop("n")


def overlap_pairs(selections: DataFrame, keys: list[str], case: str, items: list[str], least: int = 1) -> DataFrame:
    """(keys, case, other, similarity): shared over joint items of pairs of cases; cases of fewer than ``least`` items have none."""
    s = selections.select(*keys, case, *items).distinct().withColumn("__size", F.count(F.lit(1)).over(Window.partitionBy(*keys, case))).where(F.col("__size") >= least)
    o = s.select(*keys, *items, F.col(case).alias("other"), F.col("__size").alias("__other"))
    both = s.join(o, [*keys, *items]).where(F.col(case) < F.col("other")).groupBy(*keys, case, "other").agg(F.count(F.lit(1)).alias("n"), F.first("__size").alias("a"), F.first("__other").alias("b"))
    return both.select(*keys, case, "other", (F.col("n") / (F.col("a") + F.col("b") - F.col("n"))).alias("similarity"))


def fold_metrics(curves: DataFrame, folds: DataFrame, keys: list[str], case: str, per_year: float) -> DataFrame:
    """(keys, fold, case) with train and test Sharpe ratios, total returns and periods; one join for both parts.

    Degradation is what the Sharpe ratio loses from train to test (0 if it gains), stability the test's less that.
    """
    met = curves.join(folds, keys).where(F.col("date").between(F.col("train_start"), F.col("test_end")))
    r = F.col("period_return")
    parts = {}
    for part in ("train", "test"):
        x = F.when(F.col("date").between(F.col(f"{part}_start"), F.col(f"{part}_end")), r)
        sharpe = F.coalesce(div(F.avg(x), F.when(F.stddev_pop(x) > 1e-12, F.stddev_pop(x))) * math.sqrt(per_year), F.lit(0.0))
        parts |= {f"{part}_sharpe": sharpe, f"{part}_return": F.coalesce(F.product(1 + x) - 1, F.lit(0.0)), f"{part}_periods": F.count(x)}
    each = met.groupBy(*keys, "fold", case).agg(*[c.alias(n) for n, c in parts.items()])
    each = each.withColumn("degradation", F.greatest(F.col("train_sharpe") - F.col("test_sharpe"), F.lit(0.0)))
    return each.withColumn("stability", F.col("test_sharpe") - F.col("degradation"))


def fold_decisions(metrics: DataFrame, least_sharpe: float, least_return: float, most_degradation: float) -> DataFrame:
    """Folds with the reasons that speak against a case, and whether it is accepted there."""
    why = {
        "train_missing": F.col("train_periods") == 0,
        "test_missing": F.col("test_periods") == 0,
        "test_sharpe_low": F.col("test_sharpe") < least_sharpe,
        "test_return_low": F.col("test_return") < least_return,
        "degradation_high": F.col("degradation") > most_degradation,
    }
    reasons = F.concat_ws(";", *[F.when(c, n) for n, c in why.items()])
    return metrics.withColumn("reasons", reasons).withColumn("accepted", F.col("reasons") == "")


def case_stability(decided: DataFrame, keys: list[str], case: str) -> DataFrame:
    """One row per case over its folds: how many accept it, mean test Sharpe ratio, worst test return, mean degradation and stability."""
    return decided.groupBy(*keys, case).agg(
        F.count(F.lit(1)).alias("folds"), F.count_if("accepted").alias("accepted_folds"), F.avg("test_sharpe").alias("mean_test_sharpe"),
        F.min("test_return").alias("worst_test_return"), F.avg("degradation").alias("mean_degradation"), F.avg("stability").alias("mean_stability"),
    )


def incremental_metrics(base: DataFrame, candidate: DataFrame, keys: list[str], by: list[str], per_year: float) -> DataFrame:
    """What a candidate series adds to a base on the dates that both have: returns, Sharpe ratios, drawdowns and their differences.

    ``by`` are columns of ``candidate`` (such as its name); the year is added as one more row kind: `all` or the year.
    """
    pair = base.select(*keys, "date", F.col("period_return").alias("__b")).join(candidate.select(*keys, *by, "date", F.col("period_return").alias("__c")), [*keys, "date"]).where("__b is not null and __c is not null")
    spans = pair.withColumn("span", F.explode(F.array(F.lit("all"), F.year("date").cast("string"))))
    of = [*keys, *by, "span"]
    run = Window.partitionBy(*of).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumns({f"__e{x}": F.product(1 + F.col(f"__{x}")).over(run) for x in "bc"})
    spans = spans.withColumns({f"__d{x}": div(f"__e{x}", F.greatest(F.max(f"__e{x}").over(run), F.lit(1.0))) - 1 for x in "bc"})
    made = []
    for x, name in (("b", "base"), ("c", "candidate")):
        sd = F.stddev_pop(f"__{x}")
        made += [(F.product(1 + F.col(f"__{x}")) - 1).alias(f"{name}_return"), F.coalesce(div(F.avg(f"__{x}"), F.when(sd > 1e-12, sd)) * math.sqrt(per_year), F.lit(0.0)).alias(f"{name}_sharpe"), F.min(f"__d{x}").alias(f"{name}_drawdown")]
    out = spans.groupBy(*of).agg(F.count(F.lit(1)).alias("periods"), *made)
    return out.withColumns({f"{m}_delta": F.col(f"candidate_{m}") - F.col(f"base_{m}") for m in ("return", "sharpe", "drawdown")})
