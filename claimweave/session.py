"""Session settings and the shared scratch folder."""

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession


def build_session(app_name="claimweave", master=None, shuffle_partitions=None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """New folder path below the checkpoint folder the cluster names. Only a local session makes one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="claimweave-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


# Rows of a file at most. A task that reads files takes so many bytes, and the rows of these tables are small: a hundred megabytes of them are
# many millions, with payloads to parse for each. Spark counts some megabytes for opening a file, so small files give more and even tasks.
ROWS_PER_FILE = 250_000

# Ids are digests in hexadecimal digits: half of each is code, which snappy does not take out.
ID_CODEC = "zstd"


def writer_of(rows: DataFrame, codec: str = ID_CODEC) -> DataFrameWriter:
    """Writer of a table that is read about as often as it is written: VARIANTs stay whole.

    Cutting them into columns takes as long as making them, which a few reads of single fields don't earn back, and reads of whole values
    put them together again.
    """
    return rows.write.option("spark.sql.variant.inferShreddingSchema", "false").option("compression", codec).option("maxRecordsPerFile", ROWS_PER_FILE)


# Paths written in the innermost open `scratch_scope`.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def stored(rows: DataFrame, purpose: str, codec: str = "snappy") -> str:
    """Path of rows that were written to the shared scratch folder."""
    path = scratch_dir(rows.sparkSession, purpose)
    writer_of(rows, codec).parquet(path)
    if _written.get() is not None:
        _written.get().append(path)
    return path


def materialize(rows: DataFrame, purpose: str, codec: str = "snappy") -> DataFrame:
    """Writes rows to the shared scratch folder and reads them back.

    Cuts lineage in a way that survives lost executors, and lets later passes read only the columns they need.
    """
    return rows.sparkSession.read.schema(rows.schema).parquet(stored(rows, purpose, codec))


@contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes what was materialized inside, for work whose results are stored elsewhere when it ends."""
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        for path in paths:
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
