"""Token counts of a subword model by a two-tier lookup of pre-token lengths on the map side.

A text falls into pre-tokens that no merge of the model can cross, so its token count is the sum of theirs. Lengths of
frequent pre-tokens come from a compact table that is broadcast; every other pre-token is encoded once per worker and kept
in the worker's cache. No pre-token is shuffled.

The frequent table comes from a sample of about `SAMPLE_ROWS` documents, chosen by a hash of id and text: `SAMPLE_TASKS` tasks count their
pre-tokens and send the `FREQUENT` largest counts each. It decides where a length is looked up, never what it is.
"""

import re
import zlib
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import slices

FREQUENT = 65_536
#: Documents that the frequent table is counted on, about, and tasks that count them.
SAMPLE_ROWS, SAMPLE_TASKS = 20_000, 16
#: Different pre-tokens that a task holds while it counts, at most; the rare half goes beyond.
SUMMARY_KEPT = 200_000
CACHE_ENTRIES = 400_000

# A run of spaces with the word after it, a word after a line end, or a line end. U+2581 stands for a space in the model.
_PRETOKEN = re.compile("[ ▁]+[^ ▁\n]*|[^ ▁\n]+|\n")


@lru_cache(maxsize=2)
def _model(path: str):
    """The model, and whether it has no piece that crosses a pre-token's end."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return model, not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)


def pretokens(text: str) -> list[str]:
    """The model puts one space before a text that is not empty; that makes all pre-tokens alike."""
    return _PRETOKEN.findall(" " + text) if text else []


class _Lengths(dict):
    """Token count by pre-token. The line end before it keeps the model's own space away; the two make two tokens."""

    def __init__(self, model):
        super().__init__()
        self.model, self.lead = model, len(model.encode("\n"))

    def __missing__(self, pretoken: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        length = self[pretoken] = len(self.model.encode("\n" + pretoken)) - self.lead
        return length


@lru_cache(maxsize=2)
def _cache(path: str) -> _Lengths:
    return _Lengths(_model(path)[0])


def pack_table(lengths: list[tuple[str, int]]) -> bytes:
    """Pre-tokens with their lengths below 256, as one compressed block; none holds a NUL, which separates them."""
    kept = [(p, n) for p, n in lengths if n < 256 and "\0" not in p]
    return zlib.compress("\0".join(p for p, _ in kept).encode() + b"\0\0" + bytes(n for _, n in kept))


@lru_cache(maxsize=2)
def unpack_table(block: bytes) -> dict[str, int]:
    names, _, lengths = zlib.decompress(block).partition(b"\0\0")
    return dict(zip(names.decode().split("\0"), lengths, strict=True)) if lengths else {}


def count_text(text: str, frequent: dict[str, int], cache: dict[str, int]) -> int:
    found = pretokens(text)
    known = list(map(frequent.get, found))
    if None not in known:
        return sum(known)
    return sum(cache[p] if n is None else n for p, n in zip(found, known, strict=True))


def frequent_pretokens(docs: DataFrame, most: int = FREQUENT, sample_rows: int = SAMPLE_ROWS, seed: int = 3) -> list[str]:
    """The pre-tokens that are frequent in a sample of the texts, at most `most`; ties go by the pre-token."""

    def summary(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for _, texts in slices(batch):
                for text in texts:
                    seen.update(pretokens(text))
                    if len(seen) > SUMMARY_KEPT:  # the rare half goes: counts become lower bounds
                        seen = Counter(dict(seen.most_common(SUMMARY_KEPT // 2)))
        sent = seen.most_common(most)
        yield pa.RecordBatch.from_pydict({"pretoken": pa.array([p for p, _ in sent], pa.string()), "n": pa.array([n for _, n in sent], pa.int64())})

    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    total = texts.count()
    if total > sample_rows:
        texts = texts.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)) < int(sample_rows / total * (1 << 30)) + 1)
    found: Counter[str] = Counter()
    for row in texts.select("text").repartition(SAMPLE_TASKS).mapInArrow(summary, "pretoken string, n long").toLocalIterator():
        found[row.pretoken] += row.n
    return [p for p, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most]]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4_096, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row, without begin or end tokens.

    Null texts count as empty (0 bytes, 0 tokens, within the limit). Null ids, repeated ids and repeated rows are kept as
    they are, one result each; an empty table gives an empty result. Columns other than doc_id and text are not read.
    Texts are counted whole, however long. A model whose pieces cross pre-tokens is run over whole texts instead.
    """
    model, splits = _model(model_path)
    block = b""
    if splits:
        lengths = _Lengths(model)
        block = pack_table([(p, lengths[p]) for p in frequent_pretokens(docs, frequent)])
    table = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches):
        model, splits = _model(model_path)
        known, cache = unpack_table(table.value) if splits and table.value else {}, _cache(model_path)
        for batch in batches:
            for part, texts in slices(batch):
                if splits:
                    n = [count_text(t, known, cache) if t else 0 for t in texts]
                else:
                    n = [len(x) for x in model.encode([t or "" for t in texts], num_threads=1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = sized.mapInArrow(count, f"doc_id {dict(sized.dtypes)['doc_id']}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
