"""Language identification by rank-order n-gram profiles.

A profile is the ranking of the `PROFILE` most frequent 1- to 3-grams of a
language's training texts. A document's own ranking is compared with each
profile by the out-of-place distance: the sum over its n-grams of the difference
of ranks, `PROFILE` where the profile lacks the n-gram. The nearest wins; ties go
to the smaller language name. Scores are 1 - distance / worst distance.

Texts are lower-cased; runs of anything but letters and marks become one
separator, which n-grams may touch. Counts cover every training row. Only
`MAX_LANGUAGES` profiles of `PROFILE` rows each reach the driver; more languages
are an error, not a silent cut.

Defined results: `und` with score 0 for a null text, one without letters, or when
nothing was learned; training rows with a null text or language are skipped;
repeated rows count as often as they occur in training and each get a result;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.shared import written

PROFILE = 400
MAX_LANGUAGES = 2000
#: Distinct n-grams that a training task holds before it passes them on.
HELD = 1 << 20
UNKNOWN = "und"
SALTS = 32


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: part of a word; a letter."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    letter = np.array([k == "L" for k in kinds])
    return letter | np.array([k == "M" for k in kinds]), letter


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct n-grams as packed code points (21 bits each), and their counts; None without a letter."""
    if not text:
        return None
    part, letter = _kinds()
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    inside = part[points]
    if not letter[points].any():
        return None
    points = np.where(inside, points, 32)
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # of a run of separators the first stays
    x = np.concatenate([[32], points[keep], [32]]) if not points[keep][-1] == 32 else np.concatenate([[32], points[keep]])
    two = (x[:-1] << 21) | x[1:]
    three = (two[:-1] << 21) | x[2:]
    return np.unique(np.concatenate([x[x != 32], two, three]), return_counts=True)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def merged(lang: str, grams: list[np.ndarray], counts: list[np.ndarray]) -> None:
        every = np.concatenate(grams)
        distinct, at = np.unique(every, return_inverse=True)
        held[lang] = distinct, np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, (grams, counts) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"]
            )
        held.clear()

    for batch in batches:
        own: dict[str, list] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if (found := ngrams(text)) is not None:
                own.setdefault(lang, []).append(found)
        for lang, parts in own.items():
            parts += [held[lang]] if lang in held else []
            merged(lang, [g for g, _ in parts], [c for _, c in parts])
        if sum(len(g) for g, _ in held.values()) > HELD:
            yield from flushed()
    yield from flushed()


def profiles(train: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """lang, gram (packed), rank from 0: the `size` most frequent n-grams of each language."""
    rows = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = (
        rows.where("lang is not null and text is not null").mapInArrow(_train, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    order = [F.desc("n"), F.asc("gram")]
    # Two steps: no task ranks a whole language.
    first = counts.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)))
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    kept = first.where(F.col("k") <= size).select("lang", "gram", "n")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1)
    return ranked.where(F.col("rank") < size).select("lang", "gram", "rank")


class Profiles:
    """All profiles as one sorted table of n-grams with a column of ranks for each language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        at = {lang: k for k, lang in enumerate(self.langs)}
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), size, np.int64)  # the last row: unknown n-gram
        self.known = np.zeros((len(self.grams) + 1, len(self.langs)), bool)
        for lang, gram, rank in rows:
            k = np.searchsorted(self.grams, gram)
            self.ranks[k, at[lang]] = rank
            self.known[k, at[lang]] = True

    def predict(self, text: str | None) -> tuple[str, float]:
        found = ngrams(text)
        if found is None or not self.langs:
            return UNKNOWN, 0.0
        grams, counts = found
        if len(grams) > self.size:
            least = np.partition(counts, -self.size)[-self.size]
            grams, counts = grams[counts >= least], counts[counts >= least]
        own = grams[np.lexsort((grams, -counts))][: self.size]
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at = np.where(self.grams[at] == own, at, len(self.grams))
        places = np.abs(self.ranks[at] - np.arange(len(own))[:, None])
        distance = np.where(self.known[at], places, self.size).sum(axis=0)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (self.size * len(own)))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(text) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return run


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> Profiles:
    """The profiles of all languages of `train`, from all its rows."""
    table = written(profiles(train, text_col, lang_col, size), "langid")
    languages = table.select("lang").distinct().count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"{languages} languages; at most {MAX_LANGUAGES} profiles are held in memory")
    return Profiles([tuple(r) for r in table.select("lang", "gram", "rank").collect()], size)


def predict(docs: DataFrame, model: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return slim.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")
