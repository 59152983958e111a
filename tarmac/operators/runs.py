"""The runs table: one folder ``version=<n>`` for each training, numbered by
the order in which the trainings claimed their places.

A training claims a version by creating the file ``_claims/<n>``, which only
one of several writers can do; whoever finds it taken claims the next one. The
rows are then written as one file, which appears whole or not at all. Clocks
play no part: of two trainings that end together exactly one has the higher
version, and a reader that has seen a version as the newest never sees an older
one after it. A writer that dies after its claim leaves a number without rows.

The claim is atomic on local folders and on HDFS. An object store has to offer
create-if-absent for it (a conditional put).
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS_SCHEMA = ("run_id string, run_name string, model string, params map<string,string>, "
               "metrics map<string,double>, model_path string, created_at timestamp, is_best boolean")
CLAIMS = "_claims"                   # readers of the table do not list names that begin with an underscore


def _file_system(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def create_if_absent(spark: SparkSession, name: str) -> bool:
    """Create an empty file; False if it is there already. Of several callers one gets True."""
    fs, path = _file_system(spark, name)
    if fs.getScheme() == "file":      # Hadoop looks before it creates here, the operating system does both at once
        return spark.sparkContext._jvm.java.io.File(fs.makeQualified(path).toUri().getPath()).createNewFile()
    try:
        fs.create(path, False).close()
        return True
    except Py4JJavaError:
        if fs.exists(path):
            return False
        raise


def claimed(spark: SparkSession, table: str) -> int:
    """The newest claimed version, 0 if there is none."""
    fs, path = _file_system(spark, f"{table}/{CLAIMS}")
    if not fs.exists(path):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def claim(spark: SparkSession, table: str) -> int:
    """A version of the table that belongs to the caller alone."""
    fs, path = _file_system(spark, f"{table}/{CLAIMS}")
    fs.mkdirs(path)
    version = claimed(spark, table) + 1
    while not create_if_absent(spark, f"{table}/{CLAIMS}/{version}"):
        version = max(version, claimed(spark, table)) + 1
    return version


def add_runs(spark: SparkSession, table: str, rows: list[tuple]) -> int:
    """Add the runs of one training (rows of RUNS_SCHEMA) as a version of their own."""
    version = claim(spark, table)
    spark.createDataFrame(rows, RUNS_SCHEMA).coalesce(1).write.parquet(f"{table}/version={version}")
    return version


def read_runs(spark: SparkSession, table: str) -> DataFrame:
    """All stored runs with the version of their training."""
    return spark.read.schema(RUNS_SCHEMA + ", version long").parquet(table)


def newest_best(runs: DataFrame) -> DataFrame:
    """The best run of the newest training that has one."""
    return runs.where("is_best").orderBy(F.desc("version"), F.desc("run_id")).limit(1)
