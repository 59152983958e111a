"""Session helpers: the shared folder comes from the session; memory budget."""

from tarmac.operators import learn as L
from tarmac.session import checkpoint_root, work_dir


def test_checkpoint_root_from_session(spark):
    root = checkpoint_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    a, b = work_dir(spark, "x"), work_dir(spark, "x")
    assert a != b and a.startswith(root + "/x-") and b.startswith(root + "/x-")


def test_node_memory_budget(spark, monkeypatch):
    monkeypatch.setattr(L, "_memory_mb", lambda s: 16 * 1024)
    assert L.node_memory_mb(spark, 1024) == 1024
    monkeypatch.setattr(L, "_memory_mb", lambda s: 1024)
    assert L.node_memory_mb(spark, 1024) == 256
    monkeypatch.setattr(L, "_memory_mb", lambda s: 4096)
    assert L.node_memory_mb(spark, 1024) == 512
    assert L._memory_mb.__name__  # the real parser stays importable


def test_memory_parser(spark):
    assert L._memory_mb(spark) == 4096  # the test session runs with a 4g driver


def test_work_dirs_are_removed(spark, monkeypatch):
    from tarmac import session
    from tarmac.session import remove_work_dirs
    monkeypatch.setattr(session, "_work_dirs", [])      # leave other tests' tables alone
    from tarmac.sources.io import path_exists
    path = work_dir(spark, "t-remove")
    spark.range(3).write.parquet(path)
    assert path_exists(spark, path)
    assert remove_work_dirs(spark) >= 1 and not path_exists(spark, path)
    assert remove_work_dirs(spark) == 0


def test_noted_work_dirs_are_removed_alone(spark):
    from tarmac.session import noted_work_dirs, remove_work_dirs, work_dir
    from tarmac.sources.io import path_exists
    other = work_dir(spark, "other")
    spark.range(2).write.parquet(other)
    with noted_work_dirs() as outer:
        a = work_dir(spark, "a")
        with noted_work_dirs() as inner:
            b = work_dir(spark, "b")
    assert outer == [a, b] and inner == [b]
    spark.range(2).write.parquet(b)
    assert remove_work_dirs(spark, outer) == 1 and not path_exists(spark, b)    # a was never written
    assert path_exists(spark, other) and remove_work_dirs(spark, inner) == 0


def test_stages_stay_within_what_the_jvm_compiles(spark):
    """HotSpot interprets methods above 8,000 bytes: longer stages must not be generated whole."""
    from tarmac.session import apply_conf
    apply_conf(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
