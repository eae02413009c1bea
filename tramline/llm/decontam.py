"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised (A-Z lower-cased, everything but digits, a-z and
non-ASCII characters taken as separators). A window is `window` consecutive
words of an item; an item of fewer words, but not none, is one window. The
automaton holds all windows, each with its separators, and reads every
document once. Matches become word positions, and word positions become
code-point offsets in the original text.

Defined results: a null or empty text, or one of separators only, has no words,
no hits and isn't contaminated; a null item, or one without words, never
matches; items of equal text all count; repeated rows each get their own result;
extra columns are ignored. An empty benchmark leaves all documents clean.

The benchmark is broadcast in blocks of at most `block_bytes` pattern bytes.
One block is the rule; a benchmark beyond that is scanned block by block, with
the hits kept in a table in the shared folder between blocks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.shared import discard, text_bytes, written

WINDOW = 13
BLOCK_BYTES = 64 << 20
#: Word characters: digits, a-z after lower-casing, and all that is not ASCII.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

OUT = (
    "doc_id long, n_words long, n_hit long, item_ids array<string>, "
    "spans array<struct<start:long,end:long>>, runs array<struct<first:long,last:long>>"
)
_RUN = pa.struct([("first", pa.int64()), ("last", pa.int64())])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def words_of(raw: bytes | None) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return (raw or b"").translate(NORMAL).split()


def windows_of(items: Iterable[tuple[str, bytes | None]], window: int = WINDOW) -> dict[bytes, set[str]]:
    """Window text -> the items that hold it."""
    found: dict[bytes, set[str]] = defaultdict(set)
    for item, raw in items:
        words = words_of(raw)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            found[b" ".join(words[k : k + window])].add(item)
    return found


class Scanner:
    """The automaton over all windows, and the scan of one text."""

    def __init__(self, windows: list[tuple[bytes, tuple[str, ...]]]):
        self.automaton = ahocorasick.Automaton()
        for text, items in windows:
            # latin-1 keeps one character for each byte, so that offsets are byte offsets
            self.automaton.add_word(f" {text.decode('latin-1')} ", (text.count(b" ") + 1, items))
        self.any = bool(windows)
        if self.any:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes], runs: list | None = None, items: Iterable[str] = ()) -> tuple[list, list[str]]:
        """Merged runs (first, last) of hit words and the sorted items, added to those given."""
        line = b" " + b" ".join(words) + b" "
        matches = list(self.automaton.iter(line.decode("latin-1"))) if self.any and words else []
        if not matches:
            return list(runs or ()), sorted(items)
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        found = set(items)
        spans = list(runs or ())
        lasts = np.searchsorted(gaps, [end for end, _ in matches]) - 1
        for last, (_, (length, own)) in zip(lasts.tolist(), matches, strict=True):
            spans.append((last - length + 1, last))
            found.update(own)
        merged: list[tuple[int, int]] = []
        for first, last in sorted(set(spans)):
            if merged and first <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
            else:
                merged.append((first, last))
        return merged, sorted(found)


_scanners: dict[int, Scanner] = {}


def _scanner(shared) -> Scanner:
    """One automaton for each Python worker and broadcast; only the latest is kept."""
    if shared.id not in _scanners:
        _scanners.clear()
        _scanners[shared.id] = Scanner(shared.value)
    return _scanners[shared.id]


class _Shared:
    """A broadcast with a stable name."""

    def __init__(self, broadcast, name: str):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self):
        return self.broadcast.value


def _scan_batches(shared: _Shared, last_block: bool, text_col: str, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared)
        for batch in batches:
            texts = text_bytes(batch[text_col])
            before = batch["runs"].to_pylist() if "runs" in batch.schema.names else [None] * len(texts)
            known = batch["item_ids"].to_pylist() if "item_ids" in batch.schema.names else [()] * len(texts)
            n_words, n_hit, ids, spans, all_runs = [], [], [], [], []
            for raw, old, own in zip(texts, before, known, strict=True):
                words = words_of(raw)
                runs, items = scanner.scan(words, [(r["first"], r["last"]) for r in old or ()], own or ())
                n_words.append(len(words))
                n_hit.append(sum(b - a + 1 for a, b in runs))
                ids.append(items)
                all_runs.append([{"first": a, "last": b} for a, b in runs])
                spans.append(original_spans(raw, runs) if runs and last_block else [])
            columns = [
                batch[id_col].cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(_SPAN)), pa.array(all_runs, pa.list_(_RUN)),
            ]
            names = ["doc_id", "n_words", "n_hit", "item_ids", "spans", "runs"]
            if not last_block:
                columns.append(pa.array([None if t is None else t.decode("utf-8", "replace") for t in texts], pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def original_spans(raw: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word runs as code-point offsets [start, end) of the original text."""
    wanted = {k for run in runs for k in run}
    at = {k: m.span() for k, m in enumerate(ORIGINAL_WORD.finditer(raw.decode("utf-8", "replace"))) if k in wanted}
    return [{"start": at[a][0], "end": at[b][1]} for a, b in runs]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids, spans (code points), runs (words)."""
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("body")
    ).where("body is not null")
    # A window has at most `window` words of text and starts at every word.
    size = items.agg(F.sum(F.octet_length("body") * window)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    now = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k)
        windows = windows_of(((r["item"], r["body"].encode("utf-8")) for r in part.toLocalIterator()), window)
        held = sorted((text, tuple(sorted(own))) for text, own in windows.items())
        broadcast = spark.sparkContext.broadcast(held)
        last = k == blocks - 1
        out = now.mapInArrow(
            _scan_batches(_Shared(broadcast, f"{spark.sparkContext.applicationId}-{broadcast._path}"), last, "text", "doc_id"),
            OUT if last else f"{OUT}, text string",
        )
        previous, now = now, out if last else written(out, "decontam")
        discard(previous) if k and not last else None
    return now


def contaminated(n_hit="n_hit", n_words="n_words"):
    """At least one word in twenty is hit."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))
