"""Token ids in blocks with Elias-Fano document boundaries.

A store is a folder of Parquet files whose rows are blocks. A block holds the token ids of consecutive documents, end to
end, and the ends of the documents as an Elias-Fano sequence: about 2 + log2(ids / documents) bits each, with sampled select
positions, in place of a table of 64-bit offsets. Blocks come in ascending order of doc_id: `part` is the range
partition, `block` counts inside it, `part_offset` is the number of ids before the block in its part. Spark's writer commits the
files, so a lost task leaves nothing behind.
"""

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import slices, text_bytes

#: A block is closed when it has so many ids; a longer document has a block of its own.
BLOCK_IDS = 1 << 20
SAMPLE_EVERY = 256
CACHE_ENTRIES = 400_000

BLOCKS = (
    "part int, block int, part_offset long, n_docs int, n_ids long, doc_ids array<bigint>, "
    "low_bits int, lower binary, upper binary, samples binary, id_bytes int, ids binary"
)


class EliasFano:
    """A non-decreasing sequence of integers from 0 to `top`, in lower bits and a unary upper part."""

    def __init__(self, n: int, low_bits: int, lower: bytes, upper: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.lower, self.upper = lower, np.frombuffer(upper, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def encode(cls, values, top: int) -> "EliasFano":
        values = np.asarray(values, np.int64)
        n = len(values)
        low_bits = max(0, int(top // n).bit_length() - 1) if n else 0
        low = values & ((1 << low_bits) - 1)
        bits = ((low[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
        ones = (values >> low_bits) + np.arange(n)
        upper = np.zeros((int(ones[-1]) if n else 0) + 1, np.uint8)
        upper[ones] = 1
        return cls(
            n, low_bits, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(upper, bitorder="little").tobytes(),
            ones[::SAMPLE_EVERY].astype("<u4").tobytes(),
        )

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        whole = int.from_bytes(self.lower[first // 8 : (first + self.low_bits + 7) // 8], "little")
        return (whole >> first % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: the upper bits are counted from the sampled position before it to the one after."""
        sample, rank = divmod(i, SAMPLE_EVERY)
        at = int(self.samples[sample])
        byte = at // 8
        stop = int(self.samples[sample + 1]) // 8 + 1 if sample + 1 < len(self.samples) else len(self.upper)
        rank += (int(self.upper[byte]) & ((1 << at % 8) - 1)).bit_count()
        ones = np.bitwise_count(self.upper[byte:stop]).cumsum()
        k = int(ones.searchsorted(rank, "right"))
        bits = int(self.upper[byte + k])
        for _ in range(rank - (int(ones[k - 1]) if k else 0)):
            bits &= bits - 1
        position = (byte + k) * 8 + (bits & -bits).bit_length() - 1
        return ((position - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        """Every value, in order."""
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n]
        bits = np.unpackbits(np.frombuffer(self.lower, np.uint8), count=self.n * self.low_bits, bitorder="little")
        low = bits.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return ((ones - np.arange(self.n)) << self.low_bits) | low


class _Ids(dict):
    """Ids by word, as bytes, in two generations: when the young one is full, it becomes the old one, and what is
    asked for again moves back. Its size is bounded, and frequent words stay."""

    def __init__(self, find):
        super().__init__()
        self.find, self.old = find, {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            ids = self.find(word)
        self[word] = ids
        return ids


def _plain(core: str) -> bool:
    """Whether these are letters that stay one letter each when normalised and lower-cased."""
    return core.isalpha() and (core.isascii() or max(core) <= "ÿ")


class _Encoder:
    """Ids of a text by its words. White space separates words and has no ids, so a word's ids do not depend on others.

    A word of plain letters with marks after them has two pre-tokens, which go to the tokenizer's merge model by themselves; any
    other word goes through the whole tokenizer. Both assumptions are tried out when a tokenizer is loaded; where they do not
    hold, whole texts are encoded.
    """

    MARKS = ".,;:!?"
    LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.words = _Ids(self._find)
        self.by_word = all(self._by_word(p) for p in (b"a b", b"a\n\tb", b"a\x0b\x0c\rb", b"  a. 'b  ", b"A.b c"))
        self.packed = [np.array([i], self.dtype).tobytes() for i in range(max(self.tokenizer.get_vocab().values(), default=-1) + 1)]
        self.written, self.ascii_as_is = {}, False
        if self.by_word and self.tokenizer.pre_tokenizer is not None:
            letters = sorted(set(self.LETTERS.lower()))
            found = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c) for c in letters}
            self.written = str.maketrans({c: p[0][0] for c, p in found.items() if len(p) == 1})
            probes = [*self.LETTERS, self.LETTERS, "THing", "élan", "Straße", "word.", "a,b", "x!!", "o.k.", "naïve?", *self.MARKS]
            if any(self._letters(p) not in (None, self._ids(p.encode())) for p in probes):
                self.written = {}
        # Letters that are written as they are need no translation.
        self.ascii_as_is = all(self.written.get(ord(c)) == c for c in map(chr, range(ord("a"), ord("z") + 1)))

    def _ids(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode(), add_special_tokens=False).ids

    def _by_word(self, probe: bytes) -> bool:
        return self._ids(probe) == [i for w in probe.split() for i in self._ids(w)]

    def _letters(self, word: str) -> list[int] | None:
        """Ids of letters of the first 256 characters with marks after them; None for other words."""
        core = word.rstrip(self.MARKS)
        if not _plain(core):
            return None
        ids = self._merged(core)
        return ids + [t.id for t in self.model.tokenize(word[len(core) :])] if len(core) < len(word) else ids

    def _merged(self, core: str) -> list[int]:
        letters = core.lower()
        return [t.id for t in self.model.tokenize(letters if self.ascii_as_is and letters.isascii() else letters.translate(self.written))]

    def _find(self, word: bytes) -> bytes:
        ids = None
        if self.written:
            text = word.decode()
            core = text.rstrip(self.MARKS)
            if _plain(core):
                if len(core) < len(text):  # so that letters are merged once, whatever follows them
                    tail = word[len(core.encode()) :]
                    return self.words[word[: -len(tail)]] + self.words[tail]
                ids = self._merged(core)
        return b"".join(map(self.packed.__getitem__, self._ids(word) if ids is None else ids))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return [np.array(self._ids(t), self.dtype).tobytes() for t in texts]
        return [b"".join(map(self.words.__getitem__, t.split())) for t in texts]


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def write_token_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of all rows, each document's followed by `end_id`, in ascending order of doc_id.

    Null texts are empty: their document is its end id alone. Null ids come first; rows of equal id are ordered by a hash
    of their text and each keeps its place; an empty table writes a store without blocks. Other columns are not read.
    """

    def blocks(batches):
        encoder, part = _encoder(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], encoder.dtype).tobytes()
        number, offset = 0, 0
        doc_ids, ends, ids, held = [], [], [], 0

        def block():
            boundaries = EliasFano.encode(ends, held)
            row = (part, number, offset, len(ends), held, doc_ids, boundaries.low_bits, boundaries.lower,
                   boundaries.upper.tobytes(), boundaries.samples.tobytes(), encoder.dtype.itemsize, b"".join(ids))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for rows, texts in slices(batch):
                for doc_id, encoded in zip(rows.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    n = len(encoded) // encoder.dtype.itemsize + 1
                    if held and held + n > block_ids:
                        yield block()
                        number, offset = number + 1, offset + held
                        doc_ids, ends, ids, held = [], [], [], 0
                    held += n
                    doc_ids.append(doc_id)
                    ends.append(held)
                    ids += (encoded, end)
        if held:
            yield block()

    i32, i64 = pa.int32(), pa.int64()
    schema = pa.schema(list(zip(
        ("part", "block", "part_offset", "n_docs", "n_ids", "doc_ids", "low_bits", "lower", "upper", "samples", "id_bytes", "ids"),
        (i32, i32, i64, i32, i64, pa.list_(i64), i32, pa.binary(), pa.binary(), pa.binary(), i32, pa.binary()), strict=True,
    )))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("text"))
    tie = F.xxhash64("text")
    rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie).mapInArrow(blocks, BLOCKS).write.parquet(path)


def _documents(spark: SparkSession, path: str, columns: str, made) -> DataFrame:
    """doc_id, start, n_tokens and `columns` of every document of a store, in one pass over its blocks.

    `made(texts, size)` gives the arrays of `columns`, for the ids of some documents (buffers) and the bytes of an id.
    """
    store = spark.read.schema(BLOCKS).parquet(path)
    # One number per range partition of the writer.
    sizes = {r.part: r.n for r in store.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    base = spark.sparkContext.broadcast(before)
    names = ["doc_id", "start", "n_tokens", *[column.split()[0] for column in columns.split(", ")]]

    def rows(batches):
        _encoder.cache_clear()  # a worker that reads needs none of the words it wrote
        for batch in batches:
            for b in range(batch.num_rows):
                block = {name: batch.column(i)[b] for i, name in enumerate(batch.schema.names)}
                value = {k: v.as_py() for k, v in block.items() if k != "ids"}
                bounds = EliasFano(value["n_docs"], value["low_bits"], value["lower"], value["upper"], value["samples"])
                ends = np.fromiter(map(bounds.select, range(value["n_docs"])), np.int64, value["n_docs"])
                starts = np.concatenate([[0], ends[:-1]])
                first = base.value[value["part"]] + value["part_offset"]
                ids = memoryview(block["ids"].as_buffer())
                size = value["id_bytes"]
                for s in range(0, len(ends), 512):
                    some = slice(s, s + 512)
                    texts = [ids[a * size : z * size] for a, z in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(value["doc_ids"][some], pa.int64()), pa.array(starts[some] + first), pa.array(ends[some] - starts[some]), *made(texts, size)],
                        names,
                    )

    return store.mapInArrow(rows, f"doc_id long, start long, n_tokens long, {columns}")


def _crc32(ids, size: int) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.frombuffer(ids, f"<u{size}").astype("<u4"))


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (as written) of every document of a store; `start` counts the ids of all before it."""

    def made(texts, size):
        return pa.array([size] * len(texts), pa.int32()), pa.array([bytes(t) for t in texts], pa.binary())

    return _documents(spark, path, "id_bytes int, ids binary", made)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """`ids_crc32` of `read_token_store`, made where the blocks are read: no ids leave the worker, and a task has one worker, not two."""
    return _documents(spark, path, "ids_crc32 long", lambda texts, size: [pa.array([_crc32(t, size) for t in texts], pa.int64())])


def ids_crc32(stored: DataFrame) -> DataFrame:
    """Adds the crc32 of a document's ids as little-endian unsigned 32-bit integers; drops the ids."""

    def digests(batches):
        for batch in batches:
            sizes, ids = batch.column(3).to_pylist(), batch.column(4)
            sums = [_crc32(ids[i].as_buffer(), size) for i, size in enumerate(sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.mapInArrow(digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
