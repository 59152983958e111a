"""Ranks, prefix sums and metrics against brute force on small fixtures."""

import random

import numpy as np
from pyspark.sql import functions as F

from tarmac.operators import learn as L
from tarmac.operators import metrics as M
from tarmac.operators import ranking as R
from tarmac.operators.monitor import probability_histogram


def _scored(spark, n=3000, seed=7, coarse=False):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = 1 if rnd.random() < 0.3 else 0
        p = min(1.0, max(0.0, rnd.gauss(0.35 + 0.3 * y, 0.2)))
        rows.append((i, y, round(p, 1) if coarse else round(p, 4)))
    return rows, spark.createDataFrame(rows, "id long, label int, probability double")


def _auc_brute(rows):
    pos = [p for _, y, p in rows if y == 1]
    neg = [p for _, y, p in rows if y == 0]
    s = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def test_auc_exact_matches_pairs(spark):
    for coarse in (False, True):
        rows, df = _scored(spark, 1500, coarse=coarse)
        got = M.roc_auc(df).first()["roc_auc"]
        assert abs(got - _auc_brute(rows)) < 1e-12


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "label int, probability double")
    assert M.roc_auc(df).first()["roc_auc"] is None


def test_prefix_sums_with_heavy_values(spark):
    vals = [(i, float(i % 7 if i < 600 else i)) for i in range(1000)]  # heavy repeated keys
    df = spark.createDataFrame(vals, "id long, v double")
    # order by a unique key, sum v
    out = R.prefix_sums(df, "id", ["v"], index_col="pos").orderBy("id").collect()
    acc = 0.0
    for r in out:
        acc += r["v"]
        assert r["cum_v"] == acc and r["pos"] == r["id"] + 1


def test_global_row_number_hot_key(spark):
    # a third of the rows share one timestamp
    rows = [(i, 5 if i % 3 == 0 else i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, ts long").repartition(7)
    out = R.global_row_number(df, F.col("ts"), F.col("id"), "rn", start=10).collect()
    expect = {k: n + 10 for n, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r["id"]: r["rn"] for r in out} == expect


def test_first_n_per_group_matches_sort(spark):
    rows = [(i, i % 4) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, g int").withColumn("h", F.md5(F.col("id").cast("string"))) \
        .withColumn("q", (F.col("g") * 100 + 37).cast("long"))
    out = R.first_n_per_group(df, "g", "h", "q", "sel").where("sel").select("id").collect()
    import hashlib
    expect = set()
    for g in range(4):
        ids = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, gg in rows if gg == g)
        expect |= {i for _, i in ids[: g * 100 + 37]}
    assert {r[0] for r in out} == expect


def test_split_exact_and_partition_invariant(spark):
    rows, df = _scored(spark, 2000)
    results = []
    for parts in (1, 4, 16):
        s = L.stratified_split(df.repartition(parts), "label", "id", 0.2, 42)
        results.append(sorted(r["id"] for r in s.where("split = 'test'").collect()))
        stats = L.split_stats(s, "label").first()
        assert stats["train_size"] + stats["test_size"] == 2000
    assert results[0] == results[1] == results[2]
    n1 = sum(1 for _, y, _ in rows if y == 1)
    n0 = 2000 - n1
    assert len(results[0]) == L.class_quota(n1, 0.2) + L.class_quota(n0, 0.2)


def test_roc_points_brute(spark):
    rows, df = _scored(spark, 800, coarse=True)
    got = sorted((r["threshold"], r["fpr"], r["tpr"]) for r in M.roc_points(df).collect())
    # brute force: thresholds descending, cumulative counts, drop collinear middles
    thr = sorted({p for _, _, p in rows}, reverse=True)
    P = sum(y for _, y, _ in rows)
    N = len(rows) - P
    tps = [sum(1 for _, y, p in rows if p >= t and y == 1) for t in thr]
    fps = [sum(1 for _, y, p in rows if p >= t and y == 0) for t in thr]
    keep = [0] + [i for i in range(1, len(thr) - 1)
                  if (fps[i + 1] - 2 * fps[i] + fps[i - 1]) or (tps[i + 1] - 2 * tps[i] + tps[i - 1])] + [len(thr) - 1]
    expect = sorted([(float("inf"), 0.0, 0.0)] + [(thr[i], fps[i] / N, tps[i] / P) for i in keep])
    assert got == expect


def test_confusion_and_report(spark):
    rows, df = _scored(spark, 1000)
    cm = {(r["actual"], r["predicted"]): r["n"] for r in M.confusion_matrix(df).collect()}
    tp = sum(1 for _, y, p in rows if y == 1 and p > 0.5)
    fp = sum(1 for _, y, p in rows if y == 0 and p > 0.5)
    fn = sum(1 for _, y, p in rows if y == 1 and p <= 0.5)
    tn = len(rows) - tp - fp - fn
    assert cm == {(0, 0): tn, (0, 1): fp, (1, 0): fn, (1, 1): tp}
    rep = {r["label"]: r for r in M.classification_report(df).collect()}
    assert rep["Delayed"]["precision"] == round(tp / (tp + fp), 4)
    assert rep["On Time"]["recall"] == round(tn / (tn + fp), 4)
    assert rep["accuracy"]["f1_score"] == round((tp + tn) / len(rows), 4)
    assert rep["weighted avg"]["support"] == len(rows)
    m = M.binary_metrics(df).first()
    assert m["f1"] == round(2 * tp / (2 * tp + fp + fn), 4)


def test_zero_division_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.2)], "label int, probability double")
    m = M.binary_metrics(df).first()
    assert (m["precision"], m["recall"], m["f1"], m["roc_auc"]) == (0.0, 0.0, 0.0, 1.0)


def test_model_comparison_long(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.9), ("b", 0, 0.8), ("b", 1, 0.2)],
                               "model string, label int, probability double")
    long = M.model_comparison(M.binary_metrics(df, by=["model"]))
    got = {(r["model"], r["metric"]): r["value"] for r in long.collect()}
    assert len(got) == 10 and got[("a", "roc_auc")] == 1.0 and got[("b", "roc_auc")] == 0.0


def test_histogram_matches_numpy(spark):
    rnd = random.Random(3)
    ps = [round(rnd.random(), 3) for _ in range(2000)] + [0.0, 1.0]
    df = spark.createDataFrame([(p,) for p in ps], "probability double")
    got = [r["n"] for r in probability_histogram(df).orderBy("bin").collect()]
    assert got == list(np.histogram(ps, bins=30)[0])
    same = spark.createDataFrame([(0.4,), (0.4,)], "probability double")
    h = probability_histogram(same).orderBy("bin").collect()
    assert len(h) == 30 and abs(h[0]["bin_start"] + 0.1) < 1e-12 and sum(r["n"] for r in h) == 2


def test_partition_invariance(spark):
    from tarmac.operators import scoring as SC
    rows, df = _scored(spark, 2000)
    ts = df.withColumn("ts", F.timestamp_seconds((F.col("id") % 97) * 60))
    aucs, ids = set(), []
    for parts in (1, 4, 16):
        aucs.add(M.roc_auc(df.repartition(parts)).first()["roc_auc"])
        out = SC.inference_ids(ts.repartition(parts), "ts", "id")
        ids.append(sorted((r["id"], r["inference_id"]) for r in out.collect()))
    assert len(aucs) == 1
    assert ids[0] == ids[1] == ids[2]
    assert sorted(i for _, i in ids[0]) == [f"INF-{k:06d}" for k in range(1, 2001)]


def test_row_number_nulls_first_and_many_buckets(spark):
    rows = [(i, None if i % 10 == 0 else float(i % 500)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, k double")
    old = R.MIN_BUCKETS
    R.MIN_BUCKETS = 100
    try:
        out = R.global_row_number(df, F.col("k"), F.col("id"), "rn").collect()
    finally:
        R.MIN_BUCKETS = old
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[0]))
    assert {r["id"]: r["rn"] for r in out} == {k: n + 1 for n, (k, _) in enumerate(order)}


def test_first_n_keeps_null_group(spark):
    rows = [(i, None if i % 5 == 0 else i % 2) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, g int").withColumn("h", F.md5(F.col("id").cast("string"))) \
        .withColumn("q", F.lit(50).cast("long"))
    out = R.first_n_per_group(df, "g", "h", "q", "sel")
    assert out.count() == 1000
    got = {r[0]: r[1] for r in out.groupBy("g").agg(F.sum(F.col("sel").cast("int"))).collect()}
    assert got == {None: 50, 0: 50, 1: 50}


def test_row_number_64_bit_and_text_ties(spark):
    big = 1 << 53
    rows = [(big + i, "k" + str(i % 37).zfill(3) + str(i), 1) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, name string, k int")
    got = {r["id"]: r["rn"] for r in R.global_row_number(df, F.col("k"), F.col("id"), "rn").collect()}
    assert got == {big + i: i + 1 for i in range(50)}
    keyed = {r["id"]: r["rn"] for r in R.global_row_number(df, F.col("id"), F.col("name"), "rn").collect()}
    assert keyed == got
    text = {r["name"]: r["rn"] for r in R.global_row_number(df, F.col("k"), F.col("name"), "rn").collect()}
    assert text == {n: i + 1 for i, n in enumerate(sorted(r[1] for r in rows))}


def test_null_and_heavy_keys_are_split(spark):
    n = 30_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7.0)
                               .otherwise(F.col("id").cast("double")).alias("k"))
    out = R.global_row_number(df, F.col("k"), F.col("id"), "rn")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_b2" in plan
    rows = sorted(((r["id"], r["k"]) for r in df.collect()), key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert {r["id"]: r["rn"] for r in out.collect()} == {k: i + 1 for i, (k, _) in enumerate(rows)}
