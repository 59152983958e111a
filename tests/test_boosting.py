"""Histogram boosting against direct computation."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tarmac.operators import boosting as B
from tarmac.operators import learn as L


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(600, 4)), 2)
    x[:, 3] = 7.0                                           # a constant feature
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=600) > 0.2).astype(int)
    rows = [(int(i), int(b), Vectors.dense(a.tolist())) for i, (a, b) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, ["flight_id", "label", "features"]).cache()


PLAIN = replace(B.LEVEL_WISE, rounds=3, depth=3, step=0.3, row_share=1.0, feature_share=1.0)


def _trees(model):
    return [(t.feature.tolist(), t.cut.tolist(), t.value.tolist()) for t in model.trees]


def test_first_split_is_the_best_of_all(data):
    x, y, df = data
    m = B.fit(df, replace(PLAIN, rounds=1, depth=1), id_col="flight_id")
    p = y.mean()
    assert m.base == pytest.approx(math.log(p / (1 - p)))
    best = None
    for f in range(4):
        for c in m.cuts[f]:
            left = x[:, f] <= c
            g, h = p - y, np.full(len(y), p * (1 - p))
            a, b = (g[left].sum(), h[left].sum()), (g[~left].sum(), h[~left].sum())
            if min(a[1], b[1]) < 1:
                continue
            gain = a[0] ** 2 / (a[1] + 1) + b[0] ** 2 / (b[1] + 1) - g.sum() ** 2 / (h.sum() + 1)
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, c, -0.3 * a[0] / (a[1] + 1), -0.3 * b[0] / (b[1] + 1))
    t = m.trees[0]
    assert (t.feature[0], m.cuts[t.feature[0]][t.cut[0]]) == best[1:3]
    assert t.gain[0] == pytest.approx(best[0], rel=1e-4) and t.value[1:3] == pytest.approx(best[3:], rel=1e-4)


def test_spark_model_scores_as_the_trees_walked_by_hand(data, spark):
    x, _, df = data
    for growth in (PLAIN, replace(B.LEAF_WISE, rounds=3, depth=4, leaves=5)):
        m = B.fit(df, growth, id_col="flight_id")
        model = B.to_spark_model(spark, m, "gbt_a", "GBTClassifier_t")
        got = {r.flight_id: r.p for r in model.transform(df).select("flight_id", vector_to_array("gbt_a_probability")[1].alias("p")).collect()}
        for i, row in enumerate(x):
            margin = m.base
            for t in m.trees:
                k = 0
                while t.feature[k] >= 0:
                    k = 2 * k + 1 + (row[t.feature[k]] > m.cuts[t.feature[k]][t.cut[k]])
                margin += t.value[k]
            assert got[i] == pytest.approx(1 / (1 + math.exp(-margin)), rel=1e-9)
        assert model.getNumTrees == 4 and model.featureImportances.toArray()[3] == 0


def test_siblings_by_subtraction_equal_direct_sums(data, monkeypatch):
    """Every node's best split is the one found from all its rows."""
    x, y, df = data
    m = B.fit(df, replace(PLAIN, rounds=1), id_col="flight_id")
    t, p = m.trees[0], y.mean()
    codes = np.stack([np.searchsorted(np.array(c), x[:, f], side="left") for f, c in enumerate(m.cuts)])
    lay = B._Survey(m.cuts)
    inside = {0: np.arange(len(y))}
    for i in range(len(t.feature)):
        if i not in inside:
            continue
        rows = inside[i]
        sums = np.zeros((1, lay.width, 3))
        for f in range(4):
            np.add.at(sums[0], lay.offsets[f] + codes[f, rows], np.stack([p - y[rows], np.full(len(rows), p * (1 - p)), np.ones(len(rows))], 1))
        if i < 7:
            gain, feature, cut, _ = B.best_splits(sums, lay.offsets, lay.widths, [0, 1, 2, 3], PLAIN)
            assert (feature[0] if gain[0] > 1e-6 else -1, t.rows[i]) == (t.feature[i], len(rows))
        if t.feature[i] >= 0:
            right = codes[t.feature[i], rows] > t.cut[i]
            inside[2 * i + 1], inside[2 * i + 2] = rows[~right], rows[right]


def test_partitions_do_not_change_the_trees(data, monkeypatch):
    _, _, df = data
    for growth in (replace(PLAIN, rounds=12, row_share=0.8, feature_share=0.5), replace(B.LEAF_WISE, rounds=12, depth=4, leaves=6)):
        one = _trees(B.fit(df, growth, id_col="flight_id"))
        monkeypatch.setattr(B, "PARTITION_ROWS", 130)       # a job for each level, sums merged
        many = _trees(B.fit(df.repartition(7), growth, id_col="flight_id"))
        monkeypatch.undo()
        assert [t[:2] for t in one] == [t[:2] for t in many]
        assert np.allclose([t[2] for t in one], [t[2] for t in many], rtol=1e-6)


def test_leaf_wise_takes_the_largest_gains_first(data):
    _, _, df = data
    full = B.fit(df, replace(PLAIN, rounds=1, depth=4), id_col="flight_id").trees[0]
    cut = B.fit(df, replace(PLAIN, rounds=1, depth=4, leaves=4), id_col="flight_id").trees[0]
    kept = {i for i in range(len(cut.feature)) if cut.feature[i] >= 0}
    assert len(kept) == 3 and 0 in kept and all((i - 1) // 2 in kept for i in kept if i)
    open_ = [i for i in range(len(full.feature)) if full.feature[i] >= 0 and i not in kept and (i - 1) // 2 in kept]
    last = min(full.gain[i] for i in kept)
    assert all(full.gain[i] <= max(full.gain[j] for j in kept) and full.gain[i] <= last + 1e-9 or full.gain[i] <= last for i in open_)


def test_one_sided_sample_estimates_the_sums(data):
    """Weighted sums of the sample are close to those of all rows."""
    x, y, _ = data
    codes = np.zeros((1, len(y)), np.uint8)
    g = replace(B.LEAF_WISE, rest_share=0.5)
    block = (codes, y.astype(np.uint8), np.arange(len(y), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 0.8 * (x[:, 0]))
    seen = {}

    def sums_of(ask):
        got = ask.sums(block)
        seen["survey"] = got
        return got

    B._grow(sums_of, 0.0, [], B._Survey([[]]), replace(g, depth=1), 0)
    s = seen["survey"]
    assert s[:B.STRATA, :, 2].sum() == len(y)
    drawn = s[B.STRATA:, :, 2].sum()
    assert 0.35 * len(y) < drawn < 0.65 * len(y)


def test_edges(spark):
    one = spark.createDataFrame([(i, 1, Vectors.dense([float(i), 0.0])) for i in range(20)], ["flight_id", "label", "features"])
    m = B.fit(one, replace(PLAIN, rounds=2), id_col="flight_id")                     # a single class: nothing to split
    assert all((t.feature == -1).all() for t in m.trees) and m.base > 10
    p = B.to_spark_model(spark, m, "gbt_a", "GBTClassifier_e").transform(one).select(vector_to_array("gbt_a_probability")[1].alias("p"))
    assert p.agg(F.min("p")).first()[0] > 0.999
    tied = spark.createDataFrame([(i, i % 2, Vectors.dense([1.0])) for i in range(20)], ["flight_id", "label", "features"])
    assert (B.fit(tied, PLAIN, id_col="flight_id").trees[0].feature == -1).all()


def test_logistic_coefficients_meet_the_first_order_condition(spark, data):
    """The gradient of the penalised loss vanishes at the fitted coefficients."""
    x, y, df = data
    clf = L.make_classifiers(L.Presets(), len(y))["LogisticRegression"].fit(df)
    w, b = clf.coefficients.toArray(), clf.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) * 0.1 + w).max() < 1e-2 and abs((p - y).sum()) < 1e-1


def test_forest_probability_is_the_mean_of_its_trees(spark, data):
    _, _, df = data
    clf = L.make_classifiers(L.Presets(rf_trees=5, rf_depth=3), 600)["RandomForest"].fit(df)
    got = [r.p for r in clf.transform(df).orderBy("flight_id").select(vector_to_array("rf_probability")[1].alias("p")).collect()]
    rows = [r.features for r in df.orderBy("flight_id").collect()[:25]]
    for v, p in zip(rows, got):
        each = [t.predictProbability(v)[1] for t in clf.trees]
        assert p == pytest.approx(sum(each) / len(each), rel=1e-9)
    total = np.zeros(4)
    for t in clf.trees:
        imp = t.featureImportances.toArray()
        total += imp
    assert clf.featureImportances.toArray() == pytest.approx(total / total.sum(), rel=1e-6)


def test_cuts_are_exact_ranks_over_many_rows(spark):
    """The values at ranks ceil(i n / bins), for more rows than a sketch keeps apart."""
    n, bins = 300_000, 64
    df = spark.range(n).select((F.xxhash64("id") % 1_000_000_007).cast("double").alias("a"), (F.xxhash64("id") % 5).alias("b"),
                               F.when(F.col("id") % 3 == 0, F.col("id")).alias("c"), F.lit(None).cast("double").alias("d"))
    got = B.cut_points(df, ["a", "b", "c", "d"], bins)
    for name, cuts in zip("abc", got):
        v = np.sort(np.array([r[0] for r in df.where(f"{name} IS NOT NULL").select(F.col(name).cast("double")).collect()]))
        want = {v[math.ceil(i * len(v) / bins) - 1] for i in range(1, bins)} - {v[-1]}
        assert cuts == sorted(want)
    assert got[3] == []


def test_levels_read_margins_that_hold_all_earlier_trees(data, monkeypatch):
    """Over several partitions no job walks a finished tree again."""
    _, _, df = data
    monkeypatch.setattr(B, "PARTITION_ROWS", 130)
    merged, seen = B._merged, []

    def asked(blocks, ask):
        seen.append(len(ask.done))
        return merged(blocks, ask)

    monkeypatch.setattr(B, "_merged", asked)
    m = B.fit(df, replace(PLAIN, rounds=4), id_col="flight_id")
    assert len(m.trees) == 4 and seen and max(seen) == 0
