"""The label model against sums over all votes, and the fit's odd cases."""

import itertools
import math

import numpy as np
import pytest

from quillon.llm import toxicity as t


def sparse(dense):
    votes, said = np.nonzero(dense)
    return votes, said


def speaks_with(dense, parent):
    votes, said = sparse(dense)
    return np.array([parent[i] >= 0 and dense[r, parent[i]] == 1 for r, i in zip(votes, said)], dtype=bool)


def joint(row, rates, y):
    p = rates.prior if y else 1 - rates.prior
    for i, v in enumerate(row):
        speaks = (rates.tied if rates.parent[i] >= 0 and row[rates.parent[i]] else rates.free)[y, i]
        p *= speaks if v else 1 - speaks
    return p


def test_posteriors_are_those_of_the_joint_distribution():
    rng = np.random.default_rng(1)
    parent = np.array([-1, 0, 1, -1, 0])
    rates = t.Rates(parent, rng.uniform(0.01, 0.6, (2, 5)), rng.uniform(0.1, 0.9, (2, 5)), 0.2)
    rows = np.array(list(itertools.product((0, 1), repeat=5)))
    assert sum(joint(r, rates, y) for r in rows for y in (0, 1)) == pytest.approx(1)
    odds = rates.log_odds(*sparse(rows), speaks_with(rows, parent), len(rows))
    for r, z in zip(rows, odds):
        assert z == pytest.approx(math.log(joint(r, rates, 1) / joint(r, rates, 0)))


def test_rates_are_weighted_counts_and_em_does_not_lose_likelihood():
    rng = np.random.default_rng(2)
    y = rng.random(3000) < 0.3
    a, c = rng.random(3000) < np.where(y, 0.6, 0.05), rng.random(3000) < np.where(y, 0.5, 0.1)
    b = np.where(a, rng.random(3000) < 0.9, rng.random(3000) < 0.02)
    dense = np.stack([a, b, c], axis=1).astype(int)
    votes, said = sparse(dense)
    parent = t.dependencies(votes, said, 3000, 3, y.astype(float))
    assert sorted((i, int(j)) for i, j in enumerate(parent) if j >= 0) in ([(0, 1)], [(1, 0)])  # b copies a; c stands alone
    with_parent = speaks_with(dense, parent)
    w = rng.random(3000)
    rates = t.estimate(votes, said, with_parent, parent, w, 1 - w)
    for label, weight in ((0, 1 - w), (1, w)):
        for i in range(3):
            above = dense[:, parent[i]] == 1 if parent[i] >= 0 else np.zeros(3000, dtype=bool)
            assert rates.free[label, i] == pytest.approx((weight[~above] @ dense[~above, i] + 0.02) / (weight[~above].sum() + 2))
            assert rates.tied[label, i] == pytest.approx((weight[above] @ dense[above, i] + 0.5) / (weight[above].sum() + 1))
    q, last = np.where(y, 0.7, 0.3), -np.inf
    for _ in range(15):
        rates = t.estimate(votes, said, with_parent, parent, q, 1 - q)
        now = sum(math.log(joint(r, rates, 0) + joint(r, rates, 1)) for r in dense)
        assert now >= last - 0.5  # but for the smoothing
        last = now
        q = 1 / (1 + np.exp(-rates.log_odds(votes, said, with_parent, 3000)))
    posterior, rates = t.label_model(votes, said, 3000, 3, np.where(rng.random(3000) < 0.1, ~y, y).astype(float))
    sure = np.array([joint(r, rates, 1) / (joint(r, rates, 0) + joint(r, rates, 1)) for r in dense[:200]])
    assert posterior[:200] == pytest.approx(sure, abs=0.02)
    assert ((posterior > 0.5) == y).mean() > 0.8


def test_samples_without_telling_words_or_one_kind_of_label(spark):
    docs = spark.createDataFrame([(i, f"word{i} same text") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(30)], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    used = [r for r in labels.where(~t.held_out(labels.doc_id)).collect()]
    assert {round(r.score, 9) for r in t.score(docs, model).collect()} == {round(sum(r.toxic for r in used) / len(used), 9)}
    assert t.fit(docs, labels.where("toxic = 1")) is None and t.fit(docs.limit(0), labels) is None
    clashing = docs.selectExpr("doc_id", "text AS score", "text")
    assert t.score(clashing, model).columns == ["doc_id", "score", "text"] and t.drop_toxic(clashing, labels).columns == clashing.columns
