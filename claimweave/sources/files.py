"""Files below a folder as Spark data sources: the contents of listed files, and a stream of changes.

`listed_files` reads exactly the files of a stored listing; a partition is one part of that listing, dealt by number and
bytes of its files. A file that cannot be read is a row with the reason; an error that is not about the file ends the job.

`file_changes` streams files that are new, were overwritten or have gone. Its offsets number steps. A step is a listing of
(path, time, size), dealt over parts by the first name below the root and stored by the tasks that make it; a batch is the difference between the
listings of two steps. A batch that is repeated finds its listing stored and gives the same rows, so every change comes
exactly once per checkpoint. The driver only counts steps; names and listings stay on the executors.
"""

import os
import time
import zlib
from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from claimweave.functions.errors import error_text, is_outage
from claimweave.session import stored

CONTENTS = "relative_path string, content binary, read_error string"
CHANGES = "relative_path string, modified_at timestamp_ntz, size bigint, action string"

#: A task opens about so many files, or files of about so many bytes.
PART_FILES, PART_BYTES = 1_000, 128 << 20
#: Rows are handed to Spark when they hold so many bytes.
_BATCH_BYTES = 16 << 20
_VALUE_BYTES = (1 << 31) - 1


def open_root(root: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a root and its path in there."""
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    if "://" in root:
        files, path = pa_fs.FileSystem.from_uri(root)
        return files, path.rstrip("/")
    return pa_fs.LocalFileSystem(), root.rstrip("/")


# --- contents of listed files ------------------------------------------------------------------------------------------


class ListPart(InputPartition):
    """One stored part of a listing; none for an empty listing."""

    def __init__(self, path: str | None):
        super().__init__(path)


class ListedFilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.listing = options["root"], options["listing"]

    def partitions(self) -> list[ListPart]:
        files, path = open_root(self.listing)
        names = sorted(i.path for i in files.get_file_info(pa_fs.FileSelector(path)) if i.base_name.startswith("part-"))
        return [ListPart(name) for name in names] or [ListPart(None)]

    def paths(self, partition: ListPart) -> list[str]:
        if partition.value is None:
            return []
        files, _ = open_root(self.listing)
        with files.open_input_file(partition.value) as part:
            return pq.read_table(part, columns=["relative_path"]).column(0).to_pylist()

    def read(self, partition: ListPart) -> Iterator[pa.RecordBatch]:
        files, base = open_root(self.root)
        rows, held = [], 0
        for path in self.paths(partition):
            content, error = read_file(files, f"{base}/{path}")
            rows.append((path, content, error))
            held += len(content or b"")
            if held >= _BATCH_BYTES:
                yield _contents(rows)
                rows, held = [], 0
        yield _contents(rows)


def read_file(files: pa_fs.FileSystem, path: str) -> tuple[bytes | None, str | None]:
    """Content, or why there is none. Raises what is not about this file."""
    try:
        with files.open_input_file(path) as source:
            if source.size() > _VALUE_BYTES:
                raise ValueError("a file of more than 2 GB is no single value")
            return source.read(), None
    except Exception as problem:
        # A name that is a folder, or nothing any more, comes as a plain error from some file systems.
        if is_outage(problem) and (not isinstance(problem, OSError) or files.get_file_info(path).is_file):
            raise
        return None, error_text(problem)


def _contents(rows: list[tuple]) -> pa.RecordBatch:
    paths, contents, errors = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.string()), pa.array(contents, pa.binary()), pa.array(errors, pa.string())], ["relative_path", "content", "read_error"]
    )


class ListedFiles(DataSource):
    """Options: `root` of the files, `listing` (folder of a stored listing with relative_path)."""

    @classmethod
    def name(cls) -> str:
        return "listed_files"

    def schema(self) -> str:
        return CONTENTS

    def reader(self, schema) -> ListedFilesReader:
        return ListedFilesReader(self.options)


def read_contents(files: DataFrame, root: str) -> DataFrame:
    """relative_path, content and read_error of the listed files, each opened once, and no other file.

    `files` has relative_path, and size if it is known. The listing is stored and dealt out in parts; it does not pass through the driver.
    """
    spark = files.sparkSession
    size = F.col("size").cast("long") if "size" in files.columns else F.lit(0).cast("long")
    wanted = files.select("relative_path", size.alias("size")).groupBy("relative_path").agg(F.max("size").alias("size"))
    total = wanted.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-total.files // PART_FILES), -(-total.bytes // PART_BYTES))
    listing = stored(wanted.select("relative_path").repartition(parts, "relative_path"), "listed-files")
    spark.dataSource.register(ListedFiles)
    return spark.read.format("listed_files").option("root", root).option("listing", listing).load()


# --- changes as a stream -----------------------------------------------------------------------------------------------


class StepPart(InputPartition):
    """One part of the listings of two steps."""

    def __init__(self, number: int, start: int, end: int):
        super().__init__((number, start, end))


class FileChangesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.state, self.parts = options["root"], options["state"].rstrip("/"), int(options.get("parts", 16))

    def initialOffset(self) -> dict:
        return {"step": 0}

    def latestOffset(self) -> dict:
        """One step after the last whole one; a step that was begun is the newest there can be until it is whole."""
        files, state = open_root(self.state)
        steps = [int(i.base_name.removeprefix("step-")) for i in files.get_file_info(pa_fs.FileSelector(state, allow_not_found=True)) if i.base_name.startswith("step-")]
        whole = [step for step in steps if len(self._parts_of(files, state, step)) == self.parts]
        return {"step": max(whole, default=0) + 1}

    def _parts_of(self, files: pa_fs.FileSystem, state: str, step: int) -> list[str]:
        return [i.path for i in files.get_file_info(pa_fs.FileSelector(f"{state}/step-{step}", allow_not_found=True)) if i.base_name.endswith(".parquet")]

    def partitions(self, start: dict, end: dict) -> list[StepPart]:
        if start["step"] == end["step"]:
            return []
        return [StepPart(number, start["step"], end["step"]) for number in range(self.parts)]

    def commit(self, end: dict) -> None:
        """Listings before the one that the next batch starts from are not needed any more."""
        files, state = open_root(self.state)
        for info in files.get_file_info(pa_fs.FileSelector(state, allow_not_found=True)):
            if info.base_name.startswith("step-") and int(info.base_name.removeprefix("step-")) < end["step"]:
                files.delete_dir(info.path)

    def read(self, partition: StepPart) -> Iterator[pa.RecordBatch]:
        number, start, end = partition.value
        files, state = open_root(self.state)
        before = _no_listing() if start == 0 else _load(files, f"{state}/step-{start}/{number}.parquet")
        path = f"{state}/step-{end}/{number}.parquet"
        if not files.get_file_info(path).is_file:
            _store_once(files, self._scan(number), path)
        yield from _difference(before, _load(files, path)).to_batches()

    def _scan(self, number: int) -> pa.Table:
        """Path, time and size of this part's files as they are now, with the time of the scan."""
        now = time.time_ns() // 1_000
        rows = list(scan(self.root, number, self.parts, _hidden))
        paths, times, sizes = zip(*rows, strict=True) if rows else ((), (), ())
        table = pa.table({"relative_path": pa.array(paths, pa.string()), "modified": pa.array(times, pa.int64()), "size": pa.array(sizes, pa.int64())})
        return table.replace_schema_metadata({"scanned": str(now)})


def scan(root: str, number: int, parts: int, hidden: Callable[[str], bool]) -> Iterator[tuple[str, int, int]]:
    """Path, time in microseconds and size of the files of one part: of `parts`, dealt by the first name below the root."""
    files, root = open_root(root)
    for top in files.get_file_info(pa_fs.FileSelector(root)):
        if zlib.crc32(top.base_name.encode()) % parts != number or hidden(top.base_name):
            continue
        found = [top] if top.is_file else files.get_file_info(pa_fs.FileSelector(top.path, allow_not_found=True, recursive=True))
        for info in found:
            below = info.path[len(root) :].lstrip("/")
            if info.is_file and not any(map(hidden, below.split("/"))):
                yield below, (info.mtime_ns or 0) // 1_000, info.size


def _hidden(name: str) -> bool:
    """Names that Spark's own file sources skip as well."""
    return name.startswith((".", "_")) or name.endswith("._COPYING_")


def _no_listing() -> pa.Table:
    return pa.table({"relative_path": pa.array([], pa.string()), "modified": pa.array([], pa.int64()), "size": pa.array([], pa.int64())})


def _load(files: pa_fs.FileSystem, path: str) -> pa.Table:
    try:
        with files.open_input_file(path) as source:
            return pq.read_table(source)
    except FileNotFoundError as gone:
        raise RuntimeError(f"the stream's checkpoint needs the listing {path}, which is not there") from gone


def _store_once(files: pa_fs.FileSystem, table: pa.Table, path: str) -> None:
    """Writes a listing under its name unless another attempt of the task did so before; the first one counts.

    On a local or mounted file system that holds for attempts at the same moment, too. Stores without such a step must not run
    two attempts of a task at once (`spark.speculation`, off unless set).
    """
    files.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid4().hex}"
    with files.open_output_stream(draft) as sink:
        pq.write_table(table, sink)
    if isinstance(files, pa_fs.LocalFileSystem):
        try:
            os.link(draft, path)
        except FileExistsError:
            pass
        files.delete_file(draft)
    elif files.get_file_info(path).is_file:
        files.delete_file(draft)
    else:
        files.move(draft, path)


def _difference(before: pa.Table, after: pa.Table) -> pa.Table:
    """Changes that lead from one listing to the next. A file has gone at the time of the scan that missed it, after its own time."""
    scanned = int((after.schema.metadata or {}).get(b"scanned", b"0"))
    old = dict(zip(before["relative_path"].to_pylist(), zip(before["modified"].to_pylist(), before["size"].to_pylist(), strict=True), strict=True))
    rows = []
    for path, modified, size in zip(*(after[name].to_pylist() for name in ("relative_path", "modified", "size")), strict=True):
        if old.pop(path, None) != (modified, size):
            rows.append((path, modified, size, "INSERT"))
    rows += [(path, max(scanned, modified + 1), 0, "DELETE") for path, (modified, _) in old.items()]
    paths, times, sizes, actions = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({
        "relative_path": pa.array(paths, pa.string()), "modified_at": pa.array(times, pa.timestamp("us")), "size": pa.array(sizes, pa.int64()),
        "action": pa.array(actions, pa.string()),
    })


class FileChanges(DataSource):
    """Options: `root` of the files, `state` (folder of the stream's listings, its own for each checkpoint), `parts` (fixed at the first start)."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> FileChangesReader:
        return FileChangesReader(self.options)


def stream_files(spark: SparkSession, root: str, state: str, parts: int = 16) -> DataFrame:
    """Changes below a folder as a stream: files that are new or have another time or size (INSERT), and files that have gone (DELETE).

    `state` keeps the listings that the checkpoint refers to and is shared by all executors; give every checkpoint its own. Every task lists
    the names below the root and then its share of the folders. A step without changes is an empty batch.
    """
    spark.dataSource.register(FileChanges)
    return spark.readStream.format("file_changes").option("root", root).option("state", state).option("parts", parts).load()
