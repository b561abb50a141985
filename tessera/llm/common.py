"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone (the path may be one that only Spark opens)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir; where it is unset, a local one in a local session only."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


#: Lets Spark delete a query's shuffle files when it ends: what it made is a written table then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables that cut lineage.

    Each one is Parquet in the shared folder, so the loss of an executor costs a reread at most. ``drop`` removes those
    that no later plan reads; what is left goes when the driver ends, as the result may read it until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame) -> DataFrame:
        """The rows of df, reread from a table."""
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        if not self.n:
            root, system = self._path(self.root)
            system.deleteOnExit(root)
        self.n += 1
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of ``write`` that nothing reads any more."""
        for t in tables:
            path, system = self._path(t.scratch_path)
            system.delete(path, True)


def unique_name(wanted: str, taken) -> str:
    """wanted, or wanted with underscores, so that it clashes with none of the taken names (case aside)."""
    low = {t.lower() for t in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def text_or_empty(col: str):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def salted_join(rows: DataFrame, few: DataFrame, on: list[str], by: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """rows joined with few, whose keys are distinct: each of few's rows goes to so many places, and the rows of a frequent key are dealt over them by ``by``."""
    salt = unique_name("salt", [*rows.columns, *few.columns])
    # the planner doesn't see that these are ``salts`` times as many rows, and would broadcast them by the size of few
    copies = few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(copies, [*on, salt], how).drop(salt)
