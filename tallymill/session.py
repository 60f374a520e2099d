"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallymill", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only where it is unset and the master is local (tests) a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.getCheckpointDir():
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tallymill-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _reader(spark: SparkSession):
    """Without vectored reads: those keep a direct buffer per thread and column chunk, outside the heap."""
    return spark.read.option("parquet.hadoop.vectored.io.enabled", "false")


def materialize(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read and not a
    recomputation, and makes row ids that were generated once stay the same.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallymill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = _reader(spark).schema(df.schema).parquet(path)
    made.tallymill_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these tables, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "tallymill_path", None)
        if path:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, which it does when the driver collects garbage, and that may be minutes later."""
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; any store that Spark reads."""
    return _reader(spark).parquet(f"{sf_dir}/{name}.parquet")
