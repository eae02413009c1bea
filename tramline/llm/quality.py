"""Quality rules: rule statistics, then an isolation forest over them.

Words are runs of anything but space and \\x09-\\x0D. `rule_statistics` reads each
whole text once. Documents under `MIN_WORDS` words, or with more than half of
their words in repeated 3-word windows, fail the base rules. The forest's trees
split at random on features of a bounded sample; a short mean path means an
anomaly. Its score threshold comes from all labelled rows.

Bounds: the forest is fit on the `SAMPLE_ROWS` documents of smallest hash, each
tree on `TREE_ROWS` of them. All other figures cover every row.

Defined results: a null, empty or blank text has zeros everywhere and fails the
base rules; repeated rows each get their own result; a label that is null, or
whose document is missing, is ignored, and several labels of one document count
by the largest; without labels of both kinds the threshold is
`DEFAULT_THRESHOLD`; an empty table gives an empty result; a null doc_id is kept
as such and never matches a label.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.shared import discard, text_bytes, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
TREES = 100
TREE_ROWS = 64
SAMPLE_ROWS = 8192
SEED = 17
BINS = 2000
DEFAULT_THRESHOLD = 0.65
#: Share of the good labelled rows that the threshold may reject at most.
MAX_FALSE_REJECTS = 0.01

_SYMBOL_BYTES = SYMBOLS.encode()
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(_SYMBOL_BYTES)] = True
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the forest splits on. Repetition is left to the base rules: its long tail among
#: good documents would hide the anomalies of the other statistics.
FEATURES = ["f_word_len", "f_symbols", "f_upper", "f_marks"]
OUT = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", " + ", ".join(f"{c} double" for c in FEATURES)


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered = 0, 0  # covered: first position not counted yet
    for k, w in enumerate(windows):
        if counts[w] > 1:
            total += k + 3 - max(k, covered)
            covered = k + 3
    return total


def statistics_of(raw: bytes | None) -> tuple[list[int], list[float]]:
    """The counts and the features of one text."""
    raw = raw or b""
    words = raw.split()
    n = len(words)
    if not n:
        return [0] * len(_COUNTS), [0.0] * len(FEATURES)
    data = np.frombuffer(raw, np.uint8)
    hist = np.bincount(data, minlength=256)
    chars = int(len(data) - hist[128:192].sum())
    blank = int(hist[9:14].sum() + hist[32])
    symbols = int(hist[_IS_SYMBOL].sum())
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            dup += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    word_chars = chars - blank
    upper = int(hist[65:91].sum())
    lower = int(hist[97:123].sum())
    marks = int(hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum())
    features = [
        math.log(word_chars / n), math.log1p(20 * symbols / n), upper / max(1, upper + lower), math.log1p(10 * marks / n),
    ]
    return [n, word_chars, symbols, dup, repeats], features


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics_of(raw) for raw in text_bytes(batch["text"])]
        counts = np.array([r[0] for r in rows], np.int64).reshape(-1, len(_COUNTS))
        features = np.array([r[1] for r in rows], np.float64).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], *(pa.array(c) for c in counts.T.copy()), *(pa.array(c) for c in features.T.copy())],
            ["doc_id", *_COUNTS, *FEATURES],
        )


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the five counts, the features and base_failed."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    return slim.mapInArrow(_statistics, OUT).withColumn("base_failed", failed)


def _mean_path(n: np.ndarray | float):
    """Mean length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, np.float64)
    safe = np.maximum(n, 2.0)
    return np.where(n < 2, 0.0, np.where(n == 2, 1.0, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe))


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays: a row for each tree, a node's children at 2k+1 and 2k+2."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    rows: int

    @staticmethod
    def fit(sample: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        rows = min(tree_rows, len(sample))
        depth = max(1, math.ceil(math.log2(max(2, rows))))
        nodes = 2 ** (depth + 1) - 1
        feature = np.full((trees, nodes), -1, np.int32)
        split = np.zeros((trees, nodes))
        path = np.zeros((trees, nodes))
        for t in range(trees):
            grow = [(0, 0, sample[rng.choice(len(sample), rows, replace=False)])] if rows else []
            while grow:
                node, level, part = grow.pop()
                low, high = part.min(axis=0), part.max(axis=0)
                choices = np.flatnonzero(high > low)
                if level == depth or len(part) <= 1 or not len(choices):
                    path[t, node] = level + _mean_path(len(part))
                    continue
                f = int(rng.choice(choices))
                at = rng.uniform(low[f], high[f])
                feature[t, node], split[t, node] = f, at
                left = part[:, f] <= at
                grow += [(2 * node + 1, level + 1, part[left]), (2 * node + 2, level + 1, part[~left])]
        return Forest(feature, split, path, rows)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for anomalies, 0.5 and less for ordinary rows."""
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[row, np.maximum(f, 0)] > split[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += path[node]
        return 2.0 ** (-total / max(1, len(self.path)) / max(1e-9, float(_mean_path(max(2, self.rows)))))


def _score_batches(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch[c].to_numpy(zero_copy_only=False) for c in FEATURES]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(x))], [*batch.schema.names, "score"])

    return run


def choose_threshold(bins: list[tuple[int, int, int]], max_false: float = MAX_FALSE_REJECTS) -> float | None:
    """The score from which rows are rejected. bins: (bin, good rows, bad rows).

    Largest gain of bad over good share among the thresholds that reject at most
    `max_false` of the good rows; ties go to the higher score. None without both kinds.
    """
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not good or not bad:
        return None
    best, at, lost, caught = 0.0, 1.0, 0, 0
    for k, g, b in sorted(bins, reverse=True):
        lost, caught = lost + g, caught + b
        if lost > max_false * good:
            break
        if caught / bad - lost / good > best:
            best, at = caught / bad - lost / good, k / BINS
    return at


def _fit(stats: DataFrame, labels: DataFrame, sample_rows: int, max_false: float) -> tuple[Forest, float]:
    """The forest, from the rows of smallest hash that pass the base rules, and the threshold, from all labelled rows."""
    worded = stats.where("not base_failed")
    # The smallest hashes lie below a bound of four times their expected number, so that few rows reach the driver.
    hashed = worded.select(F.xxhash64(F.lit(SEED), "doc_id", *FEATURES).alias("_h"), *FEATURES)
    share = min(1.0, 4 * sample_rows / max(1, worded.count()))
    if share < 1:
        hashed = hashed.where(F.col("_h") < int(-(1 << 63) + share * (1 << 64)))
    sample = hashed.orderBy("_h", *FEATURES).select(*FEATURES).limit(sample_rows)
    matrix = np.array([tuple(r) for r in sample.collect()], np.float64).reshape(-1, len(FEATURES))
    forest = Forest.fit(matrix)
    marks = labels.where("doc_id is not null and quality is not null").groupBy(
        F.col("doc_id").cast("long").alias("_label_id")
    ).agg(F.max("quality").alias("_quality"))
    bins = (
        _scored(stats, forest).where("not base_failed").join(marks, F.col("doc_id") == F.col("_label_id"))
        .groupBy(F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
        .agg(F.count_if(F.col("_quality") > 0).alias("good"), F.count_if(F.col("_quality") <= 0).alias("bad"))
    )
    found = choose_threshold([tuple(r) for r in bins.collect()], max_false)
    return forest, float(DEFAULT_THRESHOLD if found is None else found)


def _scored(stats: DataFrame, forest: Forest) -> DataFrame:
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema)
    return stats.mapInArrow(_score_batches(forest), f"{fields}, score double")


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS, max_false: float = MAX_FALSE_REJECTS,
) -> DataFrame:
    """One row per document: the statistics, base_failed, score, threshold and kept."""
    stats = written(rule_statistics(docs, id_col, text_col), "quality")
    forest, threshold = _fit(stats, labels, sample_rows, max_false)
    return _scored(stats, forest).withColumn("threshold", F.lit(threshold)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") < threshold)
    )


def _keeps(forest: Forest, threshold: float):
    def keeps(texts: pa.Array) -> pa.Array:
        rows = [statistics_of(raw) for raw in text_bytes(texts)]
        scores = forest.score(np.array([features for _, features in rows], np.float64).reshape(-1, len(FEATURES)))
        failed = [n < MIN_WORDS or repeats * 100 > n * MAX_REPEAT_PERCENT for (n, _, _, _, repeats), _ in rows]
        return pa.array([not bad and bool(score < threshold) for bad, score in zip(failed, scores, strict=True)], pa.bool_())

    return F.arrow_udf(keeps, "boolean")


def passing(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS, max_false: float = MAX_FALSE_REJECTS,
) -> DataFrame:
    """The rows of docs that `quality` keeps, all columns unchanged, each row judged by its own text.

    Texts are counted a second time rather than joined with their verdicts, so that no document is shuffled.
    """
    stats = written(rule_statistics(docs, id_col, text_col), "quality")
    forest, threshold = _fit(stats, labels, sample_rows, max_false)
    discard(stats)
    return docs.where(_keeps(forest, threshold)(F.col(text_col).cast("string")))
