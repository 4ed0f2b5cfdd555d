"""Quality rules as statistics of whole texts, judged by an isolation forest.

Every text gets the base statistics of the rules and a vector of ratios. A forest of random splits is grown on one half of the
labelled rows, nearly all of them good; each tree draws its few rows anew, as the method has it. Texts that random splits set apart
after few steps are anomalous. The threshold on the anomaly score is calibrated on every labelled row of the other half.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import bounded_sample, slices, text_bytes
from claimweave.session import materialize

MIN_WORDS = 50
TREES, TREE_ROWS = 200, 256
#: Bad rows among the rows that the forest grows on, to widen its splits: so many for each good one.
BAD_SHARE = 0.03
#: What rejecting a good row costs, where keeping a bad one costs 1; both as shares of their class.
GOOD_COST = 5.0

SYMBOLS = b"#*$%&|<>"
FEATURES = (
    "word_length", "symbols_per_word", "repeat_word_share", "upper_share", "exclaim_share", "distinct_share", "top_word_share",
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Byte classes; the bytes of a character after its first are a class of their own.
_OTHER, _SPACE, _UPPER, _LOWER, _EXCLAIM, _SYMBOL, _CONTINUED = range(7)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x80:0xC0] = _UPPER, _LOWER, _CONTINUED
_CLASS[list(b"!?")] = _EXCLAIM
_CLASS[list(SYMBOLS)] = _SYMBOL


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more in the text, their first occurrence included."""
    n = len(words) - 2
    if n < 2:
        return 0
    number = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) > 1 << 20:  # keeps the product below within 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[which] > 1)
    covered = np.zeros(len(words), bool)
    for step in range(3):
        covered[starts + step] = True
    return int(covered.sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The base statistics and the features of one text, each line and word of it."""
    words = text.split()  # at space and 0x09 to 0x0D, as bytes do
    n = len(words)
    classes = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=7).tolist()
    chars = len(text) - classes[_SPACE] - classes[_CONTINUED]
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    duplicates = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    base = [n, chars, classes[_SYMBOL], duplicates, repeated]
    if not n:
        return base, [0.0] * len(FEATURES)
    counts = Counter(words)
    letters = max(1, classes[_UPPER] + classes[_LOWER])
    return base, [
        min(chars / n, 64.0), min(classes[_SYMBOL] / n, 8.0), repeated / n, classes[_UPPER] / letters,
        min(classes[_EXCLAIM] / n, 8.0), min(1.0, len(counts) / n**0.85), max(counts.values()) / n,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics and an array `features` of every row; null texts are empty."""

    def measure(batches):
        for batch in batches:
            for part, texts in slices(batch):
                base, features = zip(*map(statistics, texts), strict=True)
                columns = [pa.array(c, pa.int64()) for c in zip(*base, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(features, pa.list_(pa.float64()))], ["doc_id", *BASE, "features"])

    rows = docs.select("doc_id", text_bytes(F.col("text")).alias("text"))
    longs = ", ".join(f"{name} long" for name in BASE)
    return rows.mapInArrow(measure, f"doc_id {dict(rows.dtypes)['doc_id']}, {longs}, features array<double>")


def _depth_left(rows: int) -> float:
    """Mean depth of an unsplit leaf of so many rows, were it split on."""
    return 2 * (np.log(rows - 1) + 0.5772156649) - 2 * (rows - 1) / rows if rows > 2 else float(rows == 2)


class IsolationForest:
    """Trees of random splits in arrays, one row per tree; node k has children 2k + 1 and 2k + 2."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 17):
        random = np.random.default_rng(seed)
        self.height = max(1, int(np.ceil(np.log2(max(2, min(tree_rows, len(rows)))))))
        nodes = 2 ** (self.height + 1) - 1
        self.feature = np.full((trees, nodes), -1, np.int8)
        self.split = np.zeros((trees, nodes), np.float32)
        self.depth = np.zeros((trees, nodes), np.float32)
        for tree in range(trees):
            chosen = random.choice(len(rows), min(tree_rows, len(rows)), replace=False)
            self._grow(tree, 0, 0, rows[chosen], random)
        self.norm = max(_depth_left(min(tree_rows, len(rows))), 1e-9)

    def _grow(self, tree: int, node: int, depth: int, rows: np.ndarray, random) -> None:
        low, high = rows.min(0), rows.max(0)
        open_features = np.flatnonzero(high > low)
        if depth == self.height or len(rows) < 2 or not len(open_features):
            self.depth[tree, node] = depth + _depth_left(len(rows))
            return
        feature = random.choice(open_features)
        split = np.float32(random.uniform(low[feature], high[feature]))
        left = rows[:, feature] < split
        if left.all() or not left.any():
            self.depth[tree, node] = depth + _depth_left(len(rows))
            return
        self.feature[tree, node], self.split[tree, node] = feature, split
        self._grow(tree, 2 * node + 1, depth + 1, rows[left], random)
        self._grow(tree, 2 * node + 2, depth + 1, rows[~left], random)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path length over that of a random tree: near 1 is anomalous."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, split, depth in zip(self.feature, self.split, self.depth, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.height):
                own = feature[node]
                inner = own >= 0
                node = np.where(inner, 2 * node + 1 + (rows[every, own] >= split[node]), node)
            total += depth[node]
        return 2 ** (-total / len(self.feature) / self.norm)


class RuleJudge:
    """A forest with its threshold; a row is anomalous if its score is above."""

    def __init__(self, forest: IsolationForest | None, threshold: float):
        self.forest, self.threshold = forest, threshold

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return self.forest.scores(rows) if self.forest else np.zeros(len(rows))


def grow_forest(good: np.ndarray, bad: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 17) -> IsolationForest:
    """A forest on good rows, with a few bad ones that widen its splits."""
    return IsolationForest(np.concatenate([good, bad[: int(np.ceil(BAD_SHARE * len(good)))]]), trees, tree_rows, seed)


def fit_judge(rows: np.ndarray, good: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 17) -> RuleJudge:
    """The first half of the rows grows the forest, the other sets the threshold of least cost; midway between two scores."""
    half = np.arange(len(rows)) % 2 == 0
    if not len(rows[half & good]):
        return RuleJudge(None, 0.5)
    forest = grow_forest(rows[half & good], rows[half & ~good], trees, tree_rows, seed)
    held = ~half if (~half).any() else half
    return RuleJudge(forest, least_cost(forest.scores(rows[held]), good[held]))


def least_cost(scores: np.ndarray, kind: np.ndarray) -> float:
    """The threshold of least cost over scored rows, `kind` true for good ones."""
    order = np.argsort(scores, kind="stable")
    scores, kind = scores[order], kind[order]
    kept_bad = np.concatenate([[0], np.cumsum(~kind)]) / max(1, (~kind).sum())
    lost_good = 1 - np.concatenate([[0], np.cumsum(kind)]) / max(1, kind.sum())
    cost = kept_bad + GOOD_COST * lost_good
    cost[1:-1][scores[1:] == scores[:-1]] = np.inf  # equal scores fall on one side
    best = len(cost) - 1 - int(np.argmin(cost[::-1]))  # of equal cost, the one that keeps more
    edges = np.concatenate([[scores[0] - 1e-6], scores, [1.0]])
    return float((edges[best] + edges[best + 1]) / 2)


def threshold_of(scored: DataFrame) -> float | None:
    """`least_cost` of a table of any size (`score`, `good` boolean), None for an empty one.

    Scores are dealt by ranges; a task adds up its own, and what crosses tasks is a row per task.
    """
    counted = scored.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    placed = counted.repartitionByRange("score").sortWithinPartitions("score")
    placed = materialize(placed.withColumn("_piece", F.spark_partition_id()), "ordered-scores")
    pieces = placed.groupBy("_piece").agg(F.sum("good").alias("_good"), F.sum("bad").alias("_bad"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("_piece", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in ("good", "bad")])
    total = pieces.agg(F.coalesce(F.sum("_good"), F.lit(0)).alias("good"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad")).first()
    if not total.good + total.bad:
        return None
    upto = Window.partitionBy("_piece").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    ran = placed.withColumns({f"_ran_{k}": F.sum(k).over(upto) for k in ("good", "bad")}).join(materialize(starts, "score-starts"), "_piece")
    kept_bad = (F.col("_ran_bad") + F.col("_bad")) / F.lit(max(1, total.bad))
    lost_good = F.lit(1) - (F.col("_ran_good") + F.col("_good")) / F.lit(max(1, total.good))
    cost = kept_bad + F.lit(GOOD_COST) * lost_good
    # Of equal cost, the highest score: the one that keeps more. To keep nothing costs GOOD_COST.
    best = ran.agg(F.min(F.struct(cost.alias("cost"), (-F.col("score")).alias("score"))).alias("best"), F.min("score").alias("least")).first()
    if best.best.cost > GOOD_COST:
        return (best.least - 1e-6 + best.least) / 2
    low = -best.best.score
    above = placed.where(F.col("score") > low).agg(F.min("score")).first()[0]
    return (low + (1.0 if above is None else above)) / 2


def judge_rules(docs: DataFrame, labels: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, the base statistics, base_failed, anomaly and kept of every row.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows; such rows are never kept, others
    are unless their anomaly is above the threshold. Labelled rows that pass the base rules are halved by a hash of the id. Of one
    half the trees draw their rows, TREE_ROWS each, good ones but for a few; every row of the other is scored for the
    threshold. Without good ones every row has anomaly 0. Null texts are empty and fail. Labels that are null, or of ids that
    documents lack, are not used; of several for an id the lowest counts. Repeated rows are judged alike; an empty table gives an
    empty result. Columns other than doc_id and text are not read. Statistics are stored, so each text is measured once.
    """
    measured = materialize(document_statistics(docs), "rule-statistics")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    # An id may stand on several texts; alike ones count once.
    fitted = measured.where(~failed).join(known, "doc_id").select("doc_id", "good", "features").distinct()
    fitted = materialize(fitted.withColumn("half", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(2))), "labelled-statistics")
    # A label set of a few rows may have its good ones in one half alone.
    grown = fitted.where("good").agg(F.min("half")).first()[0]
    judge = RuleJudge(None, 0.5)
    if grown is not None:

        def drawn(good: bool, most: int) -> np.ndarray:
            rows = fitted.where((F.col("half") == grown) & (F.col("good") == good))
            # What 200 trees draw from all rows, as one draw; the same rows every time.
            rows = bounded_sample(rows, ["doc_id", "features"], most, seed).collect()
            return np.array([r.features for r in sorted(rows, key=lambda r: (r.doc_id, r.features))], np.float64).reshape(-1, len(FEATURES))

        most = TREES * TREE_ROWS
        forest = grow_forest(drawn(True, most), drawn(False, int(BAD_SHARE * most)), seed=seed)
        own = docs.sparkSession.sparkContext.broadcast(forest)

        def rated(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(own.value.scores(_vectors(batch))), batch.column(0)], ["score", "good"])

        def scored(rows: DataFrame) -> DataFrame:
            return rows.select("good", "features").mapInArrow(rated, "score double, good boolean")

        held = threshold_of(scored(fitted.where(F.col("half") != grown)))
        judge = RuleJudge(forest, threshold_of(scored(fitted)) if held is None else held)
    shared = docs.sparkSession.sparkContext.broadcast(judge)

    def judged(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.scores(_vectors(batch)))], [*batch.schema.names[:-1], "anomaly"])

    schema = ", ".join(f"{name} {kind}" for name, kind in measured.dtypes[:-1]) + ", anomaly double"
    scored_rows = measured.mapInArrow(judged, schema).withColumn("base_failed", failed)
    return scored_rows.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= judge.threshold))


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    features = batch.column(batch.schema.get_field_index("features"))
    return features.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
