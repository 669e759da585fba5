"""Purged combinations, deflated Sharpe ratios, lattice neighbours and greedy duplicates against versions by hand."""

import itertools
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillon.operators import robustness

from .test_operators import day


def curves_of(spark, n=47, cases=3, seed=1):
    rng = np.random.default_rng(seed)
    rows = [("M", c, day(i), float(np.round(rng.normal(0.001 * c, 0.01), 6))) for c in range(cases) for i in range(n)]
    return rows, spark.createDataFrame(rows, "market string, case_no int, date date, period_return double")


def by_hand(n, groups, chosen, purge, embargo):
    base, more = divmod(n, groups)
    runs, at = [], 0
    for g in range(groups):
        size = base + (g < more)
        runs.append(range(at, at + size))
        at += size
    out = {}
    for split, picked in enumerate(itertools.combinations(range(groups), chosen), start=1):
        test = {p for g in picked for p in runs[g]}
        safe = {q for p in test for q in range(max(0, p - purge), min(n - 1, p + embargo) + 1)}
        for g, run in enumerate(runs):
            for p in run:
                out[split, p] = (g, "test" if p in test else "purged" if p in safe else "train")
    return out


@pytest.mark.parametrize("shape", [(47, 6, 2, 2, 3), (20, 5, 3, 0, 0), (9, 9, 1, 1, 0)])
def test_purged_combinations(spark, shape):
    n, groups, chosen, purge, embargo = shape
    _, curves = curves_of(spark, n)
    got = robustness.purged_combinations(curves, ["market"], groups, chosen, purge, embargo).collect()
    assert {(r.split, (r.date - day(0)).days): (r.group, r.role) for r in got} == by_hand(*shape) and len(got) == n * math.comb(groups, chosen)


def test_too_few_dates_and_wrong_counts(spark):
    _, curves = curves_of(spark, 4)
    assert robustness.purged_combinations(curves, ["market"], 5, 2).count() == 0
    with pytest.raises(ValueError):
        robustness.purged_combinations(curves, ["market"], 4, 4)


def test_scores_verdicts_and_paths(spark):
    rows, curves = curves_of(spark)
    splits = robustness.purged_combinations(curves, ["market"], 6, 2, 2, 3)
    roles = by_hand(47, 6, 2, 2, 3)
    value = {(c, (d - day(0)).days): r for _, c, d, r in rows}
    scored = {(r.case_no, r.split): r for r in robustness.evaluate_combinations(curves, splits, ["market"], "case_no", 52.0).collect()}
    for c in range(3):
        for s in range(1, 16):
            x = np.array([value[c, p] for p in range(47) if roles[s, p][1] == "test"])
            r = scored[c, s]
            assert r.observations == len(x) and r.mean_return == pytest.approx(x.mean()) and r.positive == (x.mean() > 0)
            assert r.sharpe == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(52))
    verdicts = {r.case_no: r for r in robustness.combination_verdicts(robustness.evaluate_combinations(curves, splits, ["market"], "case_no"), ["market"], "case_no").collect()}
    for c in range(3):
        means = [scored[c, s].mean_return for s in range(1, 16)]
        assert verdicts[c].splits == 15 and verdicts[c].p10_mean_return == pytest.approx(np.quantile(means, 0.1)) and verdicts[c].positive_rate == pytest.approx(np.mean([m > 0 for m in means]))
    best = {}
    for s in range(1, 16):
        train = [p for p in range(47) if roles[s, p][1] == "train"]
        score = {c: np.mean([value[c, p] for p in train]) / np.std([value[c, p] for p in train]) for c in range(3)}
        best[s] = max(score, key=lambda c: (round(score[c], 10), -c))
    paths = {}
    for g in range(6):
        for path, s in enumerate([s for s in range(1, 16) if any(roles[s, p] == (g, "test") for p in range(47))], start=1):
            paths.setdefault(path, []).extend(value[best[s], p] for p in range(47) if roles[s, p][0] == g)
    got = {r.path: r for r in robustness.combination_paths(curves, splits, ["market"], "case_no").collect()}
    assert set(got) == set(paths) == {1, 2, 3, 4, 5}
    for path, x in paths.items():
        assert got[path].periods == 47 and got[path].path_return == pytest.approx(np.prod(1 + np.array(x)) - 1)


def test_equal_returns_have_no_sharpe(spark):
    curves = spark.createDataFrame([("M", 0, day(i), 0.1) for i in range(12)], "market string, case_no int, date date, period_return double")
    out = robustness.evaluate_combinations(curves, robustness.purged_combinations(curves, ["market"], 4, 2), ["market"], "case_no").collect()
    assert len(out) == 6 and all(r.sharpe == 0 and r.positive for r in out)


def test_deflated_sharpe_by_hand(spark):
    normal, g = NormalDist(), 0.5772156649015329
    error = math.sqrt((1 - 0.2 * 0.3 + (4 - 1) / 4 * 0.09) / 99)
    hurdle = error * ((1 - g) * normal.inv_cdf(1 - 1 / 20) + g * normal.inv_cdf(1 - 1 / (20 * math.e)))
    assert robustness.deflated(0.3, 100, 20, 0.2, 4.0) == (pytest.approx(hurdle), pytest.approx(normal.cdf((0.3 - hurdle) / error)))
    assert robustness.deflated(0.3, 100, 1, 0.2, 4.0)[0] == 0 and robustness.deflated(0.3, 1, 5)[1] == 1.0
    rows, curves = curves_of(spark, 60, 4)
    got = {r.case_no: r for r in robustness.deflated_sharpe(curves, ["market"], "case_no").collect()}
    for c in range(4):
        x = np.array([r for _, k, _, r in rows if k == c])
        m = x - x.mean()
        skew, kurt = (m**3).mean() / (m**2).mean() ** 1.5, (m**4).mean() / (m**2).mean() ** 2
        want = robustness.deflated(x.mean() / x.std(ddof=1), 60, 4, skew, kurt)
        assert (got[c].trials, got[c].n) == (4, 60) and (got[c].hurdle, got[c].dsr) == (pytest.approx(want[0]), pytest.approx(want[1]))


def test_more_trials_never_raise_the_probability():
    chances = [robustness.deflated(0.2, 250, n)[1] for n in (1, 2, 5, 50, 500, 10**6, 10**14)]
    assert chances == sorted(chances, reverse=True)


def test_lattice_neighbours(spark):
    rng = random.Random(5)
    rows = [("M", a, b, c, round(rng.uniform(-1, 1), 3)) for a in (1, 5, 20) for b in (0.1, 0.2, 0.9, 1.5) for c in ("x", "y") if rng.random() < 0.9]
    rows += [("M", 1, 0.1, "x", 0.4), ("M", None, 0.1, "x", 9.0), ("M", 1, 0.1, "x", None)]
    out = robustness.lattice_neighbours(spark.createDataFrame(rows, "market string, a int, b double, c string, m double"), ["market"], ["a", "b", "c"], "m").collect()
    cells = {}
    for _, a, b, c, m in rows:
        if a is not None and m is not None:
            cells.setdefault((a, b, c), []).append(m)
    cells = {k: sum(v) / len(v) for k, v in cells.items()}
    ranks = [{v: i for i, v in enumerate(sorted({k[j] for k in cells}))} for j in range(3)]
    at = lambda k: [ranks[j][k[j]] for j in range(3)]
    assert len(out) == len(cells) and [(r.a, r.b, r.c) for r in out if r.best] == [max(cells, key=lambda k: cells[k])]
    for r in out:
        key, mean = (r.a, r.b, r.c), cells[r.a, r.b, r.c]
        near = [v for k, v in cells.items() if k != key and all(abs(x - y) <= 1 for x, y in zip(at(k), at(key)))]
        limit = mean * 0.75 if mean > 0 else mean
        assert r.metric_mean == pytest.approx(mean) and r.neighbours == len(near)
        assert r.passing == sum(v >= limit for v in near) and r.stable == (r.passing >= 2)


def greedy(ranked, similarity, threshold, most_similar):
    kept, out = [], {}
    for c in ranked:
        near = [(k, similarity[frozenset((c, k))]) for k in kept if similarity.get(frozenset((c, k)), -9) >= threshold]
        if not near:
            kept.append(c)
            out[c] = None
        else:
            out[c] = max(near, key=lambda x: x[1])[0] if most_similar else near[0][0]
    return out


@pytest.mark.parametrize("most_similar", [False, True])
def test_greedy_duplicates(spark, most_similar):
    rng = random.Random(11)
    similarity, pairs, candidates, want = {}, [], [], {}
    for key in "AB":
        names = [f"{key}{i}" for i in range(25)]
        score = {n: rng.choice([1, 2, 3]) for n in names}
        candidates += [(key, n, score[n]) for n in names]
        for a, b in itertools.combinations(names, 2):
            if rng.random() < 0.6:
                similarity[frozenset((a, b))] = s = round(rng.random(), 1)
                pairs.append((key, *rng.choice([(a, b), (b, a)]), s))
        want |= greedy(sorted(names, key=lambda n: (-score[n], n)), similarity, 0.8, most_similar)
    frame = spark.createDataFrame(candidates, "market string, case string, score int")
    out = robustness.greedy_duplicates(frame, spark.createDataFrame(pairs, "market string, case string, other string, similarity double"), ["market"], "case", [F.desc("score")], 0.8, most_similar)
    got = {r.case: r for r in out.collect()}
    assert {c: r.duplicate_of for c, r in got.items()} == want
    assert all(r.kept == (r.duplicate_of is None) and (r.similarity is None) == r.kept for r in got.values())
    assert all(r.similarity == similarity[frozenset((c, r.duplicate_of))] for c, r in got.items() if not r.kept)


def test_no_pairs_and_too_many_candidates(spark, monkeypatch):
    frame = spark.createDataFrame([("A", 1), ("A", 2)], "market string, case int")
    none = spark.createDataFrame([], "market string, case int, other int, similarity double")
    assert [r.kept for r in robustness.greedy_duplicates(frame, none, ["market"], "case", [], 0.5).collect()] == [True, True]
    monkeypatch.setattr(robustness, "MOST_CASES", 1)
    with pytest.raises(PySparkException, match="candidates"):
        robustness.greedy_duplicates(frame, none, ["market"], "case", [], 0.5).collect()


def test_pairs(spark):
    rows = [("A", day(i), "x"[:1] + str(c), r) for c, series in enumerate([[1, 2, 3, 4], [2, 4, 6, 9], [1, 1, 1, 1], [5, 4]]) for i, r in enumerate(series)]
    pairs = robustness.correlation_pairs(spark.createDataFrame([(a, d, c, float(r)) for a, d, c, r in rows], "market string, date date, case string, period_return double"), ["market"], "case").collect()
    assert [(r.case, r.other) for r in pairs] == [("x0", "x1")] and pairs[0].similarity == pytest.approx(np.corrcoef([1, 2, 3, 4], [2, 4, 6, 9])[0, 1])
    items = spark.createDataFrame([("A", c, i) for c, s in (("p", "abcd"), ("q", "bcdee"), ("r", "a")) for i in s], "market string, case string, item string")
    assert [(r.case, r.other, r.similarity) for r in robustness.overlap_pairs(items, ["market"], "case", ["item"], least=2).collect()] == [("p", "q", 3 / 5)]
