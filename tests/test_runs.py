"""The runs table: versions claimed one by one."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest

from tarmac.operators import learn as L
from tarmac.operators import runs as R
from tarmac.session import work_dir


def _rows(name, best=True, at=dt.datetime(2024, 1, 1)):
    return [(f"{name}-{m}", m, m, {"n": "1"}, {"roc_auc": 0.5}, f"/models/{name}", at, best and m == "A") for m in "AB"]


def test_a_file_is_created_once(spark):
    path = f"{work_dir(spark, 'claims')}/x/1"
    R._file_system(spark, path)[0].mkdirs(R._file_system(spark, path)[1].getParent())
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda _: R.create_if_absent(spark, path), range(40)))
    assert sum(made) == 1
    with pytest.raises(Exception):
        R.create_if_absent(spark, f"{work_dir(spark, 'claims')}/no/such/folder/1")


def test_concurrent_trainings_get_versions_of_their_own(spark):
    table = work_dir(spark, "runs")
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(lambda i: R.add_runs(spark, table, _rows(f"t{i}")), range(12)))
    assert sorted(versions) == list(range(1, 13))
    stored = R.read_runs(spark, table).collect()
    assert len(stored) == 24 and {(r.run_id.split("-")[0], r.version) for r in stored} == {(f"t{i}", v) for i, v in enumerate(versions)}
    best = L.best_run(spark, table).collect()
    assert [(r.run_id, r.version) for r in best] == [(f"t{versions.index(12)}-A", 12)]


def test_claims_without_rows_and_clocks(spark):
    table = work_dir(spark, "runs")
    assert R.claimed(spark, table) == 0
    R.add_runs(spark, table, _rows("late", at=dt.datetime(2030, 1, 1)))
    assert R.claim(spark, table) == 2                               # a writer that dies after its claim
    assert L.best_run(spark, table).first().run_id == "late-A"
    R.add_runs(spark, table, _rows("early", at=dt.datetime(2020, 1, 1)))
    R.add_runs(spark, table, _rows("none", best=False))
    best = L.best_run(spark, table).first()
    assert (best.run_id, best.version) == ("early-A", 3)            # the order of claims, not of clocks
    assert R.read_runs(spark, table).select("version").distinct().count() == 3
