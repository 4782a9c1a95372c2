"""Session defaults, the shared scratch folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

# A broadcast side is only hinted below both bounds.
BROADCAST_MAX_ROWS = 4_000_000
BROADCAST_MAX_BYTES = 256 * 1024 * 1024


def local_session(cores: str = "*", app: str = "lexidom", memory: str = "8g") -> SparkSession:
    """Session for tests and the local bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A machine-local folder is chosen only in local mode with nothing set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="lexidom-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir()


_open = threading.local()


@contextmanager
def released(spark: SparkSession):
    """Deletes the tables staged inside when the block ends, failed or not.

    What is read after the block is staged with ``lasting``; it then belongs to the
    block around, if there is one. Only folders that this thread wrote are deleted.
    """
    blocks = _open.__dict__.setdefault("blocks", [])
    blocks.append([])
    try:
        yield
    finally:
        paths = blocks.pop()
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for name in paths:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def scratch_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    blocks = _open.__dict__.get("blocks", [])
    owners = blocks[: len(blocks) - lasting]
    if owners:
        owners[-1].append(path)
    return path


def stage(df: DataFrame, name: str = "stage", lasting: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint, but keeps column pruning,
    filter pushdown and size statistics for whatever reads it next. Inside
    ``released`` the table goes at the end of the block, unless it is ``lasting``.
    """
    path = scratch_path(df.sparkSession, name, lasting)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def fits_broadcast(df: DataFrame, text_col: str) -> bool:
    """Measure a lookup table before anybody hints it."""
    row = df.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b"),
    ).first()
    return row.n <= BROADCAST_MAX_ROWS and row.b + 32 * row.n <= BROADCAST_MAX_BYTES


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Hash a scan over all cores if it has fewer splits than there are cores.

    A gzip file, or a file of one row group, is read by one task whatever its
    size; work that costs more than reading should not stay there. A scan with
    enough splits is left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
