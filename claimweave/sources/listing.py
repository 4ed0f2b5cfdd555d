"""Directory listings as DataFrames. Contents of listed files, and a stream that sees overwritten and deleted ones, are in `files`."""

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.sources.files import open_root, scan

#: Rows that a task hands to Spark at once.
LISTED_ROWS = 50_000

LISTING_COLUMNS = ("path", "modificationTime", "length")
_BINARY_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def relative_to(path: Column, root: str) -> Column:
    """Part of an absolute file URI below `root`, whatever its scheme."""
    bare_root = root.split("://", 1)[-1].removeprefix("file:").strip("/")
    prefix = f"/{bare_root}/"
    return F.substring(path, F.instr(path, prefix) + len(prefix), F.length(path))


def _listing(files: DataFrame, root: str) -> DataFrame:
    return files.select(
        relative_to(F.col("path"), root).alias("relative_path"),
        F.col("modificationTime").cast("timestamp_ntz").alias("modified_at"),
        F.col("length").alias("size"),
        F.lit("INSERT").alias("action"),
    )


def read_directory(spark: SparkSession, root: str, parts: int = 32) -> DataFrame:
    """All files below a folder, as they are when a job runs; no file is opened.

    The tasks list, each the names below the root and then its share of the folders; neither names nor times pass through the driver.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                rows = scan(root, number, parts, _passed_over)
                while some := list(islice(rows, LISTED_ROWS)):
                    paths, times, sizes = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(paths, pa.string()), pa.array([t // 1_000 for t in times], pa.int64()), pa.array(sizes, pa.int64())],
                        ["relative_path", "modified", "size"],
                    )

    files, path = open_root(root)
    if files.get_file_info(path).type == pa_fs.FileType.NotFound:
        raise FileNotFoundError(f"there is no folder {root}")
    listed = spark.range(0, parts, 1, parts).mapInArrow(found, "relative_path string, modified long, size long")
    return listed.select(
        "relative_path", F.timestamp_millis("modified").cast("timestamp_ntz").alias("modified_at"), "size", F.lit("INSERT").alias("action"),
    )


def _passed_over(name: str) -> bool:
    """Names that Spark's file sources skip."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def stream_directory(spark: SparkSession, root: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Files as they arrive below a folder; every name is seen once per checkpoint, so it suits stages whose files are never
    overwritten or deleted. `files.stream_files` and a change log (`stream_change_log`) give those changes, too."""
    reader = spark.readStream.format("binaryFile").schema(_BINARY_FILE).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _listing(reader.load(root), root)


def directory_changes(spark: SparkSession, root: str, known: DataFrame) -> DataFrame:
    """Changes of a folder against a stored listing: files that are new or have another time or size, and files that are gone."""
    now = read_directory(spark, root).select("relative_path", "modified_at", "size")
    before = known.filter(F.col("action") != "DELETE").select("relative_path", F.col("modified_at").alias("_at"), F.col("size").alias("_size"))
    both = now.join(before, "relative_path", "full_outer")
    gone = F.col("modified_at").isNull()
    same = F.col("modified_at").eqNullSafe(F.col("_at")) & F.col("size").eqNullSafe(F.col("_size"))
    return both.filter(~same).select(
        "relative_path", F.coalesce("modified_at", F.current_timestamp().cast("timestamp_ntz")).alias("modified_at"),
        F.coalesce("size", F.lit(0)).alias("size"), F.when(gone, "DELETE").otherwise("INSERT").alias("action"),
    )


def stream_change_log(spark: SparkSession, root: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Changes from a log that the storage writes as JSON lines (relative_path, modified_at, size, action).

    For stages with very many files: a directory stream has to list them all at every step, the log only its new part.
    """
    reader = spark.readStream.schema("relative_path string, modified_at timestamp_ntz, size long, action string")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(root)
