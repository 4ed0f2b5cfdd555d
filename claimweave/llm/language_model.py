"""A hashed maximum-entropy language model with class-factored softmax.

Words of the training texts are counted in full. The most frequent ones form classes of 64 by rank; all others are one more class.
P(word | context) is P(class | context) P(word | class, context), both log-linear in hashed features of the two words before: the
previous word, the word before it (a skip feature), and the two together, each word by itself however rare. The class of other words
is a tree with 64 branches at each node, by the digits of the word's hash; a branch is log-linear in node and previous word. The tree
is as deep as the counted vocabulary asks for: 64 words in a cell at its end, on average. Within a cell, probabilities follow the
counts, smoothed, so the model covers every text.

Training is by rounds over disjoint shares of the training texts. In a round each task updates its own copy of the weights by Adagrad over all
its texts; the changes, weighted by tokens, are summed in a tree of shuffles and applied to the shared weights. Scoring
is numpy over batches of texts; only rows of weights that occur are touched.
"""

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import fold, slices, text_bytes
from claimweave.session import materialize

FOLDS = 10
#: Words whose counts are broadcast, at most (some 20 bytes each); the counts of rarer words are joined.
FREQUENT = 131_072
CLASSES, SLOTS = 32, 64
#: Words with a class and a slot; the last class is for all others.
KNOWN = (CLASSES - 1) * SLOTS
OTHER, START = KNOWN, KNOWN + 1
#: Other words are numbers from here on: 31 bits of their hash are added.
HASHED, _HASH = 1 << 31, (1 << 31) - 1
ROUNDS = 2
RATE, BATCH = 0.05, 16_384
#: Rows of the weights of classes: by previous word, by skipped word, by both (hashed), by either if it is another word (hashed); of
#: slots: by class and previous word (hashed); and of branches: by node and previous word (hashed).
_SKIPPED, _PAIR, _RARE, _RARE_SKIPPED, CLASS_ROWS, SLOT_ROWS, BRANCH_ROWS = 2_048, 4_096, 12_288, 16_384, 20_480, 8_192, 32_768
_CLASS_WEIGHTS = CLASS_ROWS * CLASSES
_SLOT_WEIGHTS = SLOT_ROWS * SLOTS
WEIGHTS = _CLASS_WEIGHTS + _SLOT_WEIGHTS + BRANCH_ROWS * SLOTS
#: Weights that go through the tree of sums together.
_BLOCK = 32_768
#: Distinct words that a task counts before it passes them on.
_COUNTED = 200_000
_SLICE = 1 << 20
_PRIOR = 0.1
#: The end of a text, which no word is.
END = ""


def word_counts(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(token, c) over all texts whose fold is not 0; the end is the empty token."""

    def count(batches):
        seen: Counter[bytes] = Counter()
        texts = 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

        for batch in batches:
            for _, some in slices(batch, "text", _SLICE):
                for text in some:
                    seen.update(text.lower().split())
                texts += len(some)
                if len(seen) > _COUNTED:
                    yield rows()
                    seen.clear()
        if texts:
            seen[b""] = texts
        yield rows()

    train = docs.where(fold(F.col("doc_id"), folds) != 0).select(text_bytes(F.col("text")).alias("text"))
    return train.mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))


class Vocabulary:
    """Counts of the frequent words, by rank, with the totals of all."""

    def __init__(self, words: list[str], counts: list[int], total: int, distinct: int):
        self.rank = {w.encode(): i for i, w in enumerate(words)}
        self.counts = np.array(counts, np.float64)
        self.log_counts = np.log10(self.counts + _PRIOR)
        self.total, self.distinct = total, distinct
        known = self.counts[:KNOWN]
        self.other = total - known.sum()
        self.log_all = math.log10(total + _PRIOR * (distinct + 1))
        self.log_other = math.log10(self.other + _PRIOR * (distinct - len(known) + 1))
        slots = np.full(KNOWN, -30.0)
        slots[: len(known)] = np.log(known + _PRIOR)
        self.slot_bias = np.concatenate([slots.reshape(-1, SLOTS), np.zeros((1, SLOTS))]).astype(np.float32)
        sizes = np.concatenate([np.pad(known, (0, KNOWN - len(known))).reshape(-1, SLOTS).sum(1), [self.other]])
        self.class_bias = np.log(sizes + _PRIOR).astype(np.float32)
        every = np.array([zlib.crc32(w.encode()) & _HASH for w in words], np.int64)
        self.ids = np.where(np.arange(len(words)) < KNOWN, np.arange(len(words)), HASHED + every).astype("<u4")
        self.depth = 0
        while SLOTS ** (self.depth + 1) < distinct - len(known):
            self.depth += 1
        self.cells = SLOTS**self.depth
        self.known_cells = every[:KNOWN] & (self.cells - 1)
        self.branch_bias: list[np.ndarray] = []
        self.log_cells = np.array([self.log_other])

    def fill_cells(self, cells: np.ndarray, counts: np.ndarray, words: np.ndarray) -> None:
        """The tree, from the cells that have words, the sums of their words' counts and the numbers of their words."""
        mass = np.full(self.cells, _PRIOR)
        mass[cells] += counts + _PRIOR * words
        np.subtract.at(mass, self.known_cells, self.counts[:KNOWN] + _PRIOR)
        mass = np.maximum(mass, _PRIOR)
        self.log_cells = np.log10(mass)
        self.branch_bias = []
        while len(mass) > 1:
            mass = mass.reshape(SLOTS, -1)
            self.branch_bias.insert(0, np.log(mass.T).astype(np.float32))
            mass = mass.sum(0)

    @property
    def biases(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        return self.class_bias, self.slot_bias, self.branch_bias


def _vocabulary(counts: DataFrame, most: int) -> tuple[Vocabulary, int]:
    """The frequent words and the count that they have at least: the words above it are counted by powers of two ** (1/8) first."""
    step = F.floor(F.log2("c") * 8).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.min("c").alias("least")).collect()
    chosen, least = 0, 1 << 62
    for r in sorted(steps, key=lambda r: -r.step):
        if chosen + r.n > most:
            break
        chosen, least = chosen + r.n, r.least
    rows = sorted(((r.token, r.c) for r in counts.where(F.col("c") >= least).collect()), key=lambda r: (-r[1], r[0]))
    vocabulary = Vocabulary([w for w, _ in rows], [c for _, c in rows], sum(r.c for r in steps), sum(r.n for r in steps))
    if vocabulary.depth:
        cell = F.crc32(F.col("token").cast("binary")).bitwiseAND(F.lit(vocabulary.cells - 1))
        found = counts.groupBy(cell.alias("cell")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).toArrow()
        vocabulary.fill_cells(*(found.column(c).to_numpy() for c in ("cell", "c", "n")))
    return vocabulary, least


class _Ranks(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


ENCODED = (
    "row long, doc_id {}, held_out boolean, share int, n_tokens long, n_known long, known_log double, other_log double, other_mass double, "
    "rare array<string>, rare_n array<int>, ids binary"
)


def encode(docs: DataFrame, vocabulary: Vocabulary, folds: int = FOLDS, rounds: int = ROUNDS) -> DataFrame:
    """Texts as ranks of their words, with the sums that frequent words give, and the words whose counts are still to be found."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches):
        vocabulary, part, number = shared.value, TaskContext.get().partitionId(), 0
        ranks = _Ranks(vocabulary.rank)
        end = ranks[b""]
        logs = np.append(vocabulary.log_counts, 0.0)
        codes = np.append(vocabulary.ids, np.uint32(0))
        for batch in batches:
            for some, texts in slices(batch, "text", _SLICE):
                out = []
                for text in texts:
                    words = text.lower().split()
                    rank = np.empty(len(words) + 1, np.int32)
                    rank[:-1] = np.fromiter(map(ranks.__getitem__, words), np.int32, len(words))
                    rank[-1] = end
                    known = rank >= 0
                    other = (rank < 0) | (rank >= KNOWN)
                    ids = codes[rank]
                    for i in np.flatnonzero(~known[:-1]):
                        ids[i] = HASHED + (zlib.crc32(words[i]) & _HASH)
                    if end < 0:
                        ids[-1] = HASHED + (zlib.crc32(b"") & _HASH)
                    mass = vocabulary.log_cells[ids[other] & (vocabulary.cells - 1)].sum()
                    rare = Counter(words[i].decode() for i in np.flatnonzero(~known[:-1])) if not known[:-1].all() else {}
                    if end < 0:
                        rare[END] = 1
                    out.append((
                        part << 36 | number, len(rank), int(known.sum()), float(logs[rank].sum()), float(logs[rank[other]].sum()), float(mass),
                        list(rare), list(rare.values()), ids.tobytes(),
                    ))
                    number += 1
                row, n, n_known, known_log, other_log, other_mass, rare, rare_n, ids = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row, pa.int64()), some.column(0), some.column(1), some.column(2), pa.array(n, pa.int64()), pa.array(n_known, pa.int64()),
                     pa.array(known_log), pa.array(other_log), pa.array(other_mass), pa.array(rare, pa.list_(pa.string())),
                     pa.array(rare_n, pa.list_(pa.int32())), pa.array(ids, pa.binary())],
                    ["row", "doc_id", "held_out", "share", "n_tokens", "n_known", "known_log", "other_log", "other_mass", "rare", "rare_n", "ids"],
                )

    share = F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(rounds)).cast("int")
    plain = docs.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), share.alias("share"), text_bytes(F.col("text")).alias("text"))
    return plain.mapInArrow(rows, ENCODED.format(dict(plain.dtypes)["doc_id"]))


def _contexts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words in order, the word before each and the one before that; a text starts after START."""
    words = np.concatenate(texts).astype(np.int64)
    first = np.cumsum([0, *map(len, texts[:-1])])
    previous = np.empty_like(words)
    previous[1:] = words[:-1]
    previous[first] = START
    skipped = np.empty_like(words)
    skipped[1:] = previous[:-1]
    skipped[first] = START
    return words, previous, skipped


class Maxent:
    """The weights in one vector: changes that features make to the logits of classes, to those of a class's slots, to those of branches."""

    def __init__(self, class_bias: np.ndarray, slot_bias: np.ndarray, weights: np.ndarray, branch_bias: list[np.ndarray] | None = None):
        self.class_bias, self.slot_bias, self.weights, self.branch_bias = class_bias, slot_bias, weights, branch_bias or []
        self.of_class = weights[:_CLASS_WEIGHTS].reshape(CLASS_ROWS, CLASSES)
        self.of_slot = weights[_CLASS_WEIGHTS : _CLASS_WEIGHTS + _SLOT_WEIGHTS].reshape(SLOT_ROWS, SLOTS)
        self.of_branch = weights[_CLASS_WEIGHTS + _SLOT_WEIGHTS :].reshape(BRANCH_ROWS, SLOTS)

    @staticmethod
    def class_rows(previous: np.ndarray, skipped: np.ndarray) -> list[np.ndarray]:
        pair = ((previous * 0x9E3779B1 + skipped * 0x85EBCA77) >> 7) % (_RARE - _PAIR)
        one = np.where(previous < HASHED, previous, _RARE + previous % (_RARE_SKIPPED - _RARE))
        two = np.where(skipped < HASHED, _SKIPPED + skipped, _RARE_SKIPPED + skipped % (CLASS_ROWS - _RARE_SKIPPED))
        return [r.astype(np.uint16) for r in (one, two, _PAIR + pair)]

    @staticmethod
    def slot_rows(words: np.ndarray, previous: np.ndarray) -> np.ndarray:
        return (((words // SLOTS * 0x9E3779B1 + previous * 0xC2B2AE3D) >> 7) % SLOT_ROWS).astype(np.uint16)

    def _branches(self, words: np.ndarray, previous: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each level of the tree: places of the other words, rows of weights, logits, branches taken."""
        at = np.flatnonzero(words >= HASHED)
        own, before = words[at] - HASHED, previous[at]
        for level, bias in enumerate(self.branch_bias):
            node = own & (len(bias) - 1)
            rows = ((((node * 4 + level) * 0x9E3779B1 + before * 0xC2B2AE3D) >> 7) % BRANCH_ROWS).astype(np.uint16)
            logits = self.of_branch[rows]
            logits += bias[node]
            yield at, rows, logits, own // len(bias) % SLOTS

    def _class_logits(self, rows: list[np.ndarray]) -> np.ndarray:
        logits = self.of_class[rows[0]]
        for own in rows[1:]:
            logits += self.of_class[own]
        logits += self.class_bias
        return logits

    def _slot_logits(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        logits = self.of_slot[rows]
        logits += self.slot_bias[words // SLOTS]
        return logits

    def log10(self, words: np.ndarray, previous: np.ndarray, skipped: np.ndarray) -> np.ndarray:
        """log10 probabilities; other words have those of their cell."""
        logits = self._class_logits(self.class_rows(previous, skipped))
        out = logits[np.arange(len(words)), np.minimum(words // SLOTS, CLASSES - 1)] - _log_sum(logits)
        for at, _, logits, taken in self._branches(words, previous):
            out[at] += logits[np.arange(len(at)), taken] - _log_sum(logits)
        known = np.flatnonzero(words < KNOWN)
        words = words[known]
        logits = self._slot_logits(words, self.slot_rows(words, previous[known]))
        out[known] += logits[np.arange(len(words)), words % SLOTS] - _log_sum(logits)
        return out * np.float32(1 / math.log(10))

    def update(self, squares: "Maxent", words: np.ndarray, previous: np.ndarray, skipped: np.ndarray) -> None:
        """One Adagrad step on the gradient of a batch."""
        rows = self.class_rows(previous, skipped)
        error = _softmax(self._class_logits(rows))
        error[np.arange(len(words)), np.minimum(words // SLOTS, CLASSES - 1)] -= 1
        for own in rows:
            _step(self.of_class, squares.of_class, own, error)
        for at, rows, logits, taken in self._branches(words, previous):
            error = _softmax(logits)
            error[np.arange(len(at)), taken] -= 1
            _step(self.of_branch, squares.of_branch, rows, error)
        known = np.flatnonzero(words < KNOWN)
        words = words[known]
        rows = self.slot_rows(words, previous[known])
        error = _softmax(self._slot_logits(words, rows))
        error[np.arange(len(words)), words % SLOTS] -= 1
        _step(self.of_slot, squares.of_slot, rows, error)


def _step(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, error: np.ndarray) -> None:
    """Adds up the gradients of each row that occurs, and moves only those rows."""
    if not len(rows):
        return
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    touched = rows[starts]
    gradient = np.add.reduceat(error[order], starts, axis=0)
    own = squares[touched] + gradient * gradient
    squares[touched] = own
    own += 1
    np.sqrt(own, out=own)
    gradient /= own
    gradient *= RATE
    weights[touched] -= gradient


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None]).sum(1))


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def _word_batches(ids: pa.BinaryArray):
    """Words with the two before each, in batches of at most BATCH, over all texts of an array in order."""
    start = 0
    while start < len(ids):
        texts, n = [], 0
        while start < len(ids) and (not texts or n < BATCH):
            texts.append(np.frombuffer(ids[start].as_buffer(), "<u4"))
            n += len(texts[-1])
            start += 1
        every = _contexts(texts)
        for first in range(0, n, BATCH):
            yield tuple(x[first : first + BATCH] for x in every)


def train(encoded: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """The weights after one pass over all training texts, in `rounds` rounds."""
    context = encoded.sparkSession.sparkContext
    weights = np.zeros(WEIGHTS, np.float32)
    for number in range(rounds):
        shared = context.broadcast((vocabulary.biases, weights))

        def changes(batches, shared=shared):
            (class_bias, slot_bias, branch_bias), weights = shared.value
            model = Maxent(class_bias, slot_bias, weights.copy(), branch_bias)
            squares, tokens = Maxent(class_bias, slot_bias, np.zeros_like(weights)), 0
            for batch in batches:
                for part in _word_batches(batch.column(0)):
                    model.update(squares, *part)
                    tokens += len(part[0])
            if tokens:
                branch = TaskContext.get().partitionId() % 64
                for block in range(0, WEIGHTS, _BLOCK):
                    change = model.weights[block : block + _BLOCK] - weights[block : block + _BLOCK]
                    yield _sum_row(block // _BLOCK, branch, tokens, change)

        texts = encoded.where(~F.col("held_out") & (F.col("share") == number)).select("ids")
        sums = texts.mapInArrow(changes, _SUMS)
        for keys in (["block", "branch"], ["block"]):
            sums = sums.groupBy(*keys).applyInArrow(_mean_change, _SUMS)
        change = np.zeros_like(weights)
        for r in sums.collect():
            change[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.frombuffer(r.change, "<f2")
        weights = weights + change
        shared.unpersist()
    return weights


_SUMS = "block int, branch int, tokens long, change binary"


def _sum_row(block: int, branch: int, tokens: int, change: np.ndarray) -> pa.RecordBatch:
    """A block of changes in half precision, with the tokens behind it."""
    values = zip((block, branch, tokens, change.astype("<f2").tobytes()), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], ["block", "branch", "tokens", "change"])


def _mean_change(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of changes, weighted by tokens, as they stream by."""
    total, tokens, branch = np.zeros(_BLOCK), 0, 0
    for batch in batches:
        for branch, n, change in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            total += np.frombuffer(change.as_buffer(), "<f2").astype(np.float64) * n
            tokens += n
    yield _sum_row(key[0].as_py(), branch, tokens, total / max(1, tokens))


def _rare_sums(encoded: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """(row, rare_log, rare_known): what words below the broadcast counts add. Words meet their counts by a join on the word."""
    asked = encoded.where(F.size("rare") > 0).select("row", F.inline(F.arrays_zip("rare", "rare_n"))).toDF("row", "token", "n")
    found = asked.join(counts.where(F.col("c") < least), "token", "left")
    logs = F.log10(F.coalesce(F.col("c"), F.lit(0)).cast("double") + F.lit(_PRIOR)) * F.col("n")
    known = F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)
    return found.groupBy("row").agg(F.sum(logs).alias("rare_log"), F.sum(known).cast("long").alias("rare_known"))


def score_texts(docs: DataFrame, folds: int = FOLDS, frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from rows whose fold is not 0.

    score is the model's log10 probability of the text and its end; base_score that of smoothed word counts. Null and empty texts are
    their end alone. A null id is held out; repeated ids and rows are learnt from and scored as often as they stand. Without
    training rows every word is unseen. An empty table gives an empty result. Only doc_id and text are read.
    """
    counts = materialize(word_counts(docs, folds), "word-counts")
    vocabulary, least = _vocabulary(counts, frequent)
    encoded = materialize(encode(docs, vocabulary, folds, rounds), "encoded")
    weights = train(encoded, vocabulary, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.biases, weights))

    def scored(batches):
        (class_bias, slot_bias, branch_bias), weights = shared.value
        model = Maxent(class_bias, slot_bias, weights, branch_bias)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            lengths = np.array([ids[i].as_buffer().size // 4 for i in range(len(ids))], np.int64)
            probabilities = [model.log10(*part).astype(np.float64) for part in _word_batches(ids)]
            sums = np.add.reduceat(np.concatenate(probabilities), np.cumsum(lengths) - lengths) if len(lengths) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums)], [*batch.schema.names[:-1], "model_log"])

    kept = encoded.drop("share", "rare", "rare_n")
    schema = ", ".join(f"{name} {kind}" for name, kind in kept.dtypes[:-1]) + ", model_log double"
    found = kept.mapInArrow(scored, schema).join(_rare_sums(encoded, counts, least), "row", "left").na.fill(0, ["rare_log", "rare_known"])
    base = F.col("known_log") + F.col("rare_log") - F.col("n_tokens") * F.lit(vocabulary.log_all)
    # Words of a cell share its probability by their counts.
    score = F.col("model_log") + F.col("other_log") + F.col("rare_log") - F.col("other_mass")
    return found.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("rare_known")).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"),
    )
