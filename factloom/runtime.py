"""Session helpers: the shared folder, and tables written to it to cut lineage."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def session(app: str = "factloom", cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    n = 8 if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where the setting is absent (tests, a laptop) a temporary folder is made and
    stored in the session, so that one session uses one folder.
    """
    got = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set(CHECKPOINT_CONF, got)
    return got.rstrip("/")


def _path(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Scratch:
    """Written tables of one operator run, in the shared folder.

    A table survives the loss of any executor, and its plan is a plain scan.
    ``drop`` removes tables that nothing reads any more; the rest go when the
    driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"
        self.n = 0
        path, fs = _path(spark, self.base)
        fs.deleteOnExit(path)

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        where = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where), where

    def write_counted(self, df: DataFrame) -> tuple[DataFrame, str, int]:
        """As ``write``, with the number of rows, observed as they are written."""
        seen = Observation()
        out, where = self.write(df.observe(seen, F.count(F.lit(1)).alias("n")))
        return out, where, seen.get["n"]

    def drop(self, *tables: str) -> None:
        for where in tables:
            path, fs = _path(self.spark, where)
            fs.delete(path, True)


def shuffle_partitions(spark: SparkSession, rows: int | None = None, per_task: int = 200_000) -> int:
    """The session's shuffle width, or more where ``rows`` would overfill its tasks."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return least if rows is None else max(least, math.ceil(rows / per_task))


def spread(scan: DataFrame) -> DataFrame:
    """A scan of few splits over all cores, for work that costs far more than moving the rows; others stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() * 2 <= cores else scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table that is small by its nature, checked: more than ``most`` rows is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows")
    return rows
