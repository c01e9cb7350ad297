"""Tables that cut lineage, in the shared folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_fallback: str | None = None
_roots: list[str] = []
_names: list[str] = []
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local master, as in tests, may do without: a temporary folder."""
    global _fallback
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if _fallback is None:
        _fallback = tempfile.mkdtemp(prefix="rulespark-")
        atexit.register(shutil.rmtree, _fallback, ignore_errors=True)
    return f"file://{_fallback}"


@contextmanager
def set_for(spark: SparkSession, name: str, value: object, default: str | None = None):
    """A setting for the jobs that run inside."""
    before = spark.conf.get(name) if default is None else spark.conf.get(name, default)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _shuffles_go(spark: SparkSession):
    """Shuffle files of a job go when it ends: what it wrote is all that is read again."""
    return set_for(spark, _CLEAN, "true", "false")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def purge(spark: SparkSession) -> None:
    """Delete the tables of all runs so far, once their results have been written or collected."""
    while _names:
        spark.sql(f"DROP TABLE IF EXISTS {_names.pop()}")
    while _roots:
        _delete(spark, _roots.pop())


class Scratch:
    """Parquet tables of one run. ``save`` writes and rereads, so executors lost later cost no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def save(self, df: DataFrame) -> DataFrame:
        if not self.made:
            _roots.append(self.root)
        self.made += 1
        path = f"{self.root}/t{self.made}"
        with _shuffles_go(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def save_by(self, df: DataFrame, key: str, buckets: int, order: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
        """``save`` in buckets of a key, each in the given order: joins and groups by the key do not deal such tables out again."""
        if not self.made:
            _roots.append(self.root)
        self.made += 1
        path = path or f"{self.root}/t{self.made}"
        name = f"rulespark_{uuid.uuid4().hex}"
        with _shuffles_go(self.spark):
            out = df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key)
            (out.sortBy(*order) if order else out).saveAsTable(name)
        return self._named(name, path)

    def open_by(self, path: str, schema: str, key: str, buckets: int, order: tuple[str, ...]) -> DataFrame:
        """A table that ``save_by`` wrote in another session."""
        name = f"rulespark_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{path}'")
        return self._named(name, path)

    def _named(self, name: str, path: str) -> DataFrame:
        _names.append(name)
        back = self.spark.table(name)
        back._scratch_path, back._scratch_name = path, name
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            if name := getattr(df, "_scratch_name", None):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            _delete(self.spark, df._scratch_path)
