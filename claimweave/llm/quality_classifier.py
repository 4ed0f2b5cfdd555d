"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages, windows of 512 bytes. Each passage is encoded from the bytes it holds; a gated attention
learns from document labels alone how much each passage counts; the weighted passage representation is scored. The model is
fitted on the driver from a bounded sample of labelled rows; every passage of every document is scored on the executors.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import bounded_sample, fold, slices, text_bytes

PASSAGE_BYTES = 512
#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 8_000
#: Passages of all those rows together, at most: of a sample with more, the rows that come first by the hash of their id are taken, whole.
SAMPLE_PASSAGES = 100_000
FOLDS = 5
ACCEPT = 0.3

#: Texts are read in slices of so many bytes, where a text counts as a passage at least, and encoded by so many passages at a time.
_SLICE_BYTES = 1 << 20
_ROUND = 512
#: Bytes of the longest code.
_REACH = 8
_BUCKETS = 96
_CLASSES = 8
_CLASS = np.full(256, 7, np.int64)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A] = 1, 2, 3
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 4, 5
_CLASS[list(b"#*$%&|<>!?")] = 6
WIDTH = _CLASSES + _BUCKETS + 3


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A vector for each passage of the texts, in order, and the number of passages of each text; an empty text has one of zeros.

    Class shares of the bytes, a hashed histogram of byte pairs, and how much the byte pairs and triples of the passage repeat.
    No pair reaches from one text into the next, so a text's vectors depend on it alone. `_ROUND` passages are worked on at a time,
    of one long text or of many short ones; beside the vectors, memory does not grow with the texts.
    """
    counts = np.array([max(1, -(-len(t) // PASSAGE_BYTES)) for t in texts], np.int64)
    vectors = np.zeros((int(counts.sum()), WIDTH), np.float32)
    some, held, done = [], 0, 0
    for text, count in zip(texts, counts.tolist(), strict=True):
        first = 0
        while first < count:
            taken = min(count - first, _ROUND - held)
            some.append((text, first, taken))
            first, held = first + taken, held + taken
            if held == _ROUND:
                _encode(some, vectors[done : done + held])
                some, held, done = [], 0, done + held
    if held:
        _encode(some, vectors[done:])
    return vectors, counts


def _encode(some: list[tuple[bytes, int, int]], vectors: np.ndarray) -> None:
    """Fills `vectors` for runs of passages, given as (text, first passage, number of passages)."""
    total = len(vectors)
    # A run's bytes, and those after it that a code which starts in the run may reach into.
    parts = [text[first * PASSAGE_BYTES : (first + taken) * PASSAGE_BYTES + _REACH - 1] for text, first, taken in some]
    lengths = np.array([len(p) for p in parts], np.int64)
    owned = np.minimum(lengths, np.array([taken * PASSAGE_BYTES for *_, taken in some], np.int64))
    runs = np.array([taken for *_, taken in some], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    if not len(data):
        return
    within = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    passage = np.repeat(np.cumsum(runs) - runs, lengths) + within // PASSAGE_BYTES
    own, left = within < np.repeat(owned, lengths), np.repeat(lengths, lengths) - within
    size = np.maximum(1, np.bincount(passage[own], minlength=total)).astype(np.float32)
    vectors[:, :_CLASSES] = np.bincount(passage[own] * _CLASSES + _CLASS[data[own]], minlength=total * _CLASSES).reshape(total, -1) / size[:, None]
    for reach, place in ((2, 0), (4, 1), (_REACH, 2)):
        at = np.flatnonzero(own & (left >= reach))
        code = data[at]
        for step in range(1, reach):
            code = code * 257 + data[at + step]
        mixed = (code * 0x9E3779B97F4A7C1) >> 20
        buckets = _BUCKETS if reach == 2 else 1024
        seen = np.bincount(passage[at] * buckets + mixed % buckets, minlength=total * buckets).reshape(total, -1).astype(np.float32)
        codes = seen.sum(1)
        if reach == 2:
            vectors[:, _CLASSES : _CLASSES + _BUCKETS] = np.sqrt(seen / np.maximum(1, codes)[:, None])
        # The chance that two of them are alike, whatever the passage's length.
        alike = ((seen * seen).sum(1) - codes) / np.maximum(1, codes * (codes - 1))
        vectors[:, _CLASSES + _BUCKETS + place] = np.sqrt(alike)


@dataclass
class AttentionModel:
    """Encoder, gated attention and scorer; all of a fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, vectors: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _sigmoid(_forward(self.weights, (vectors - self.mean) / self.scale, counts)["logit"].astype(np.float64))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w: dict, x: np.ndarray, counts: np.ndarray) -> dict:
    starts = np.cumsum(counts) - counts
    h = np.tanh(x @ w["encode"] + w["encode_bias"])
    t, g = np.tanh(h @ w["tanh"]), _sigmoid(h @ w["gate"])
    energy = (t * g) @ w["energy"]
    energy = np.exp(energy - np.repeat(np.maximum.reduceat(energy, starts), counts))
    share = energy / np.repeat(np.add.reduceat(energy, starts), counts)
    bag = np.add.reduceat(share[:, None] * h, starts)
    return {"x": x, "h": h, "t": t, "g": g, "share": share, "bag": bag, "logit": bag @ w["score"] + w["score_bias"][0]}


def _gradient(w: dict, f: dict, counts: np.ndarray, error: np.ndarray) -> dict:
    """Gradients of the loss, given its derivative by each bag's logit."""
    starts = np.cumsum(counts) - counts
    out = {"score": f["bag"].T @ error, "score_bias": np.array([error.sum()])}
    by_passage = np.repeat(error, counts)
    value = f["h"] @ w["score"]
    d_share = by_passage * value
    d_energy = f["share"] * (d_share - np.repeat(np.add.reduceat(f["share"] * d_share, starts), counts))
    out["energy"] = (f["t"] * f["g"]).T @ d_energy
    d_t = d_energy[:, None] * w["energy"] * f["g"] * (1 - f["t"] ** 2)
    d_g = d_energy[:, None] * w["energy"] * f["t"] * f["g"] * (1 - f["g"])
    out["tanh"], out["gate"] = f["h"].T @ d_t, f["h"].T @ d_g
    d_h = (by_passage * f["share"])[:, None] * w["score"] + d_t @ w["tanh"].T + d_g @ w["gate"].T
    d_h *= 1 - f["h"] ** 2
    out["encode"], out["encode_bias"] = f["x"].T @ d_h, d_h.sum(0)
    return out


def fit(bags: list[np.ndarray], good: np.ndarray, hidden: int = 24, attention: int = 12, epochs: int = 12, seed: int = 5) -> AttentionModel:
    """Adam over batches of bags, with weight decay; without rows of both kinds every score is the share of good ones, or one half."""
    random = np.random.default_rng(seed)
    width = bags[0].shape[1] if bags else WIDTH
    w = {
        "encode": random.normal(0, width**-0.5, (width, hidden)), "encode_bias": np.zeros(hidden), "tanh": random.normal(0, hidden**-0.5, (hidden, attention)),
        "gate": random.normal(0, hidden**-0.5, (hidden, attention)), "energy": random.normal(0, 0.1, attention), "score": random.normal(0, 0.1, hidden), "score_bias": np.zeros(1),
    }
    rate = good.mean() if len(good) else 0.5
    if rate in (0.0, 1.0) or not len(good):
        w["score"][:] = 0
        w["score_bias"][:] = np.log((rate + 1e-6) / (1 - rate + 1e-6))
        return AttentionModel(np.zeros(width, np.float32), np.ones(width, np.float32), {k: v.astype(np.float32) for k, v in w.items()})
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 0.02
    w["score_bias"][:] = np.log(rate / (1 - rate))
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        order = random.permutation(len(bags))
        for start in range(0, len(order), 64):
            chosen = order[start : start + 64]
            counts = np.array([len(bags[i]) for i in chosen])
            f = _forward(w, (np.concatenate([bags[i] for i in chosen]) - mean) / scale, counts)
            grads = _gradient(w, f, counts, (_sigmoid(f["logit"]) - good[chosen]) / len(chosen))
            step += 1
            for k, g in grads.items():
                g = g + 1e-4 * w[k] * (not k.endswith("bias"))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - 0.01 / (1 + epoch / 4) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return AttentionModel(mean.astype(np.float32), scale.astype(np.float32), {k: v.astype(np.float32) for k, v in w.items()})


def _training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int, passages_most: int, folds: int, seed: int) -> DataFrame:
    """(doc_id, row, quality): at most `sample_rows` different labelled texts with at most `passages_most` passages together.

    They are the first by a hash of the id, so the same for the same tables. A text with more passages than that alone is not learnt from.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != 0))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = F.broadcast(bounded_sample(known, ["doc_id"], sample_rows, seed))
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(text_bytes(F.col("text"))) / F.lit(PASSAGE_BYTES)))
    sized = docs.select("doc_id", F.xxhash64("text").alias("row"), size.alias("size")).where(F.col("size") <= passages_most)
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id"), F.col("row")]
    first = sized.join(chosen, "doc_id").distinct().orderBy(*order).limit(sample_rows)
    # A window over the bounded sample.
    so_far = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return first.withColumn("_so_far", so_far).where(F.col("_so_far") <= passages_most).select("doc_id", "row", "quality")


def train(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS, seed: int = 5, passages_most: int = SAMPLE_PASSAGES
) -> AttentionModel:
    """Fits on a bounded sample of labelled texts whose fold is not 0 (`_training_rows`), on all passages of each."""
    chosen = F.broadcast(_training_rows(docs, labels, sample_rows, passages_most, folds, seed))
    texts = docs.select("doc_id", F.xxhash64("text").alias("row"), text_bytes(F.col("text")).alias("text")).join(chosen, ["doc_id", "row"])
    texts = texts.dropDuplicates(["doc_id", "row"]).select("doc_id", "text", "quality")

    def bags(batches):
        for batch in batches:
            for part, some in slices(batch, "text", _SLICE_BYTES, PASSAGE_BYTES):
                vectors, counts = passages(some)
                kept = [own.astype("<f4").tobytes() for own in np.split(vectors, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(kept, pa.binary())], ["doc_id", "quality", "bag"])

    found = texts.mapInArrow(bags, f"doc_id {dict(texts.dtypes)['doc_id']}, quality int, bag binary")
    rows = sorted((r.doc_id, r.quality, bytes(r.bag)) for r in found.collect())
    return fit([np.frombuffer(b, "<f4").reshape(-1, WIDTH) for *_, b in rows], np.array([float(q == 1) for _, q, _ in rows]), seed=seed)


def score(docs: DataFrame, model: AttentionModel, accept: float = ACCEPT, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from all passages of its text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            for part, texts in slices(batch, "text", _SLICE_BYTES, PASSAGE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(shared.value.scores(*passages(texts)), 6))], ["doc_id", "score"])

    rows = docs.select("doc_id", text_bytes(F.col("text")).alias("text"))
    found = rows.mapInArrow(scored, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
    return found.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`.

    Null and empty texts are bags of one empty passage and get a score like any other. Null labels, null ids and labels of
    ids that documents lack are not learnt from; of several labels for an id the lowest counts; without labels of both kinds the score is
    constant. Repeated rows are scored alike; a null id is held out; an empty table gives an empty result. Only
    doc_id, text and quality are read, whatever other columns there are.
    """
    return score(docs, train(docs, labels, sample_rows))


def accepted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, accept: float = ACCEPT) -> DataFrame:
    """The rows of `docs`, with all their columns, that the classifier predicts to be good. Rows stay in their tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows))
    at = docs.columns.index("text")

    def kept(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).fill_null(b"")
            for part, some in slices(pa.RecordBatch.from_arrays([texts, pa.array(range(len(texts)))], ["text", "i"]), "text", _SLICE_BYTES, PASSAGE_BYTES):
                good = np.round(shared.value.scores(*passages(some)), 6) >= accept
                yield batch.slice(part.column(1)[0].as_py(), len(part)).filter(pa.array(good))

    return docs.mapInArrow(kept, docs.schema)
