"""Histogram forest against direct computation."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tarmac.operators import boosting as B
from tarmac.operators import forest as FO
from tarmac.operators import learn as L


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(700, 5)), 2)
    x[:, 4] = 7.0                                           # a constant feature
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=700) > 0.2).astype(int)
    rows = [(int(i), int(b), Vectors.dense(a.tolist())) for i, (a, b) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, ["flight_id", "label", "features"]).cache()


SPEC = FO.Forest(trees=6, depth=4, min_rows=5)


def _grown(df, spec=SPEC):
    rows = B.bin_rows(df, spec.bins, id_col="flight_id")
    blocks = rows.blocks.collect()
    trees = FO.fit(rows, spec)
    rows.blocks.unpersist()
    return rows, blocks, trees


def test_every_split_is_the_best_of_the_drawn_features(data):
    """From the rows drawn for each tree, by brute force over all cuts."""
    _, _, df = data
    rows, [(codes, y, marks)], trees = _grown(df)
    keys = FO.row_keys(marks)
    for t in range(SPEC.trees):
        times = FO.drawn_counts(keys, SPEC.seed, t).astype(int)
        inside, splits = {0: np.flatnonzero(times)}, 0
        for i in range((1 << SPEC.depth) - 1):
            if i not in inside:
                continue
            at, w = inside[i], times[inside[i]]
            n, p = w.sum(), (w * y[at]).sum()
            assert (trees.rows[t, i], trees.positives[t, i]) == (n, p)
            depth = (i + 1).bit_length() - 1
            nodes = {t: np.arange((1 << depth) - 1, (2 << depth) - 1)}
            drawn = FO.Level(SPEC, [len(c) + 1 for c in rows.cuts], trees.feature, trees.cut, nodes, depth).slots(t)[0][i + 1 - (1 << depth)]
            assert len(set(drawn.tolist())) == 3            # ceil(sqrt(5))
            best = (0.0, -1, 0)
            for f in drawn:
                for c in range(len(rows.cuts[f])):
                    left = codes[f, at] <= c
                    a, b = w[left].sum(), (w * y[at])[left].sum()
                    if min(a, n - a) < SPEC.min_rows:
                        continue
                    gain = FO._gini(n, p) - a / n * FO._gini(a, b) - (n - a) / n * FO._gini(n - a, p - b)
                    if gain > best[0] + 1e-12:
                        best = (gain, int(f), c)
            assert (trees.feature[t, i], trees.cut[t, i]) == best[1:]
            if best[1] >= 0:
                splits += 1
                right = codes[best[1], at] > best[2]
                inside[2 * i + 1], inside[2 * i + 2] = at[~right], at[right]
        assert splits > 3


def test_partitions_do_not_change_the_trees(data, monkeypatch):
    _, _, df = data
    one = _grown(df)[2]
    blocks = B.BLOCK_ROWS
    for partition, block in ((130, blocks), (700, 1)):      # six partitions; one partition of several blocks
        monkeypatch.setattr(B, "PARTITION_ROWS", partition)
        monkeypatch.setattr(B, "BLOCK_ROWS", block)
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "90")
        rows, packed, many = _grown(df.repartition(5))
        df.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert rows.blocks.getNumPartitions() == -(-700 // partition) and len(packed) >= 6
        assert all((getattr(one, a) == getattr(many, a)).all() for a in ("feature", "cut", "rows", "positives"))


def test_stored_model_walks_the_same_trees(spark, data):
    x, _, df = data
    rows, _, trees = _grown(df)
    model = FO.to_spark_model(spark, trees, rows.cuts, SPEC, "rf", "RandomForestClassifier_t")
    assert model.getNumTrees == SPEC.trees and model.numClasses == 2 and model.numFeatures == 5
    assert model.featureImportances.toArray()[4] == 0 and model.featureImportances.toArray().sum() == pytest.approx(1)
    merged = 0
    for v in x[:60]:
        for t, tree in enumerate(model.trees):
            i = 0
            while trees.feature[t, i] >= 0:
                f = trees.feature[t, i]
                i = 2 * i + 1 + int(v[f] > rows.cuts[f][trees.cut[t, i]])
            assert tree.predict(Vectors.dense(v)) == float(2 * trees.positives[t, i] > trees.rows[t, i])
            merged += tree.predictProbability(Vectors.dense(v))[1] != pytest.approx(trees.positives[t, i] / trees.rows[t, i])
    assert merged < 60 * SPEC.trees                         # leaves of one prediction are merged, the others hold their shares


def test_rows_are_drawn_as_by_a_poisson_count_each_by_itself():
    marks = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 100_000).astype(np.uint64))
    for m in (marks, np.full(100_000, 42, np.uint64)):      # one id for all rows, too
        a, b = (FO.drawn_counts(FO.row_keys(m), 42, t).astype(float) for t in (0, 1))
        assert abs(a.mean() - 1) < 0.02 and abs(a.var() - 1) < 0.03 and abs((a == 0).mean() - np.exp(-1)) < 0.01
        assert abs(np.corrcoef(a, b)[0, 1]) < 0.02
    same = np.full(10, 42, np.uint64)
    assert (np.r_[FO.row_keys(same[:4]), FO.row_keys(same[4:], 4)] == FO.row_keys(same)).all()


def test_all_models_of_trees_read_rows_binned_once(spark, data, monkeypatch):
    """A training bins the rows once, and a level of the forest is one job over all trees."""
    _, _, df = data
    from tarmac.schema import ALL_FEATURES
    wide = df.select("flight_id", "label", *[(df.flight_id * (k + 3) % 17).alias(f) for k, f in enumerate(ALL_FEATURES)])
    made, bin_rows = [], B.bin_rows
    monkeypatch.setattr(B, "bin_rows", lambda *a, **k: made.append(1) or bin_rows(*a, **k))
    small = L.Presets(rf_trees=4, rf_depth=3, gbt_rounds=2)
    res = L.train_all(spark, wide, small, models=["RandomForest", "GBT_A", "GBT_B"], evaluate=False)
    assert len(made) == 1
    assert res.models["RandomForest"].stages[-1].getNumTrees == 4 and res.models["GBT_B"].stages[-1].getNumTrees == 3


def test_a_single_class_and_no_features_to_split(spark):
    one = spark.createDataFrame([(i, 1, Vectors.dense([float(i), 0.0])) for i in range(20)], ["flight_id", "label", "features"])
    trees = _grown(one)[2]
    assert (trees.feature == -1).all() and (trees.rows[:, 0] == trees.positives[:, 0]).all()
    tied = spark.createDataFrame([(i, i % 2, Vectors.dense([1.0])) for i in range(20)], ["flight_id", "label", "features"])
    assert (_grown(tied)[2].feature == -1).all()
