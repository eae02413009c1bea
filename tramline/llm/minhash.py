"""MinHash near-duplicates: exact links above a similarity, and their components.

Words are runs of anything but space and \\x09-\\x0D after lower-casing A-Z. A
document's set holds its distinct `width`-word shingles as 64-bit hashes; with
fewer words, the whole sequence is the one shingle. Universal hash functions
(multiply-add modulo 2**64, upper half) give the minima; documents that share a whole
band of them are candidates. `plan_for` sizes bands and sketches by the least
similarity, so that a pair at it shares no band with a probability of about 1e-6
(45 bands of 6 at 0.8). Candidates are filtered by their signatures where many
are left, and confirmed on the full sets. Components: alternating large-star and
small-star.

Rows of equal sets are one node, so that copies never meet in pairs; nodes that share
a doc_id are linked whatever their sets.

Defined results: a null, empty or blank text has an empty set, is linked with
nothing and stays; rows with words that share a doc_id are in one component; a row without doc_id has
no component and stays; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property, reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.graph import Buckets
from tramline.llm.shared import ASCII_LOWER, discard, text_bytes, written

WIDTH = 5
PERCENT = 80
SEED = 20
CHUNK = 1024
#: Chance that a pair at the least similarity shares no band, and that its sketches are further apart than allowed.
MISS, FAR = 1.2e-6, 1e-7
#: Hash functions in all, as far as bands of one row allow.
FUNCTIONS = 320


@dataclass(frozen=True)
class Plan:
    """Bands, rows a band, 64-bit words of the one-bit sketch, and the mismatches of two sketches that still count."""

    bands: int
    rows: int
    words: int
    mismatches: int

    @cached_property
    def numbers(self) -> tuple[np.ndarray, ...]:
        rng, n = np.random.default_rng(SEED), self.bands * self.rows
        a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, n, dtype=np.uint64)
        mix = rng.integers(0, 2**63, (self.bands, self.rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return a, b, mix, rng.integers(0, 2**63, self.bands, dtype=np.uint64)


@cache
def plan_for(percent: int) -> Plan:
    """The most rows a band that `FUNCTIONS` allow, with as many bands as `MISS` asks for."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1 to 100")
    s, rows, bands = percent / 100, 1, 1

    def bands_of(r: int) -> int:
        return math.ceil(math.log(MISS) / math.log1p(-(s**r))) if s < 1 else 1

    bands = bands_of(1)
    while (s < 1 or rows < 8) and bands_of(rows + 1) * (rows + 1) <= FUNCTIONS:
        rows += 1
        bands = bands_of(rows)
    n, p = bands * rows, (1 - s) / 2
    tail, most = 1.0, -1
    while tail > FAR:
        most += 1
        tail -= math.comb(n, most) * p**most * (1 - p) ** (n - most)
    return Plan(bands, rows, -(-n // 64), most)


_DEFAULT = plan_for(PERCENT)
_A, _B = _DEFAULT.numbers[:2]

OUT = "doc_id long, n_shingles long, set_id binary, keys array<long>, sketch array<long>"


def shingles(raw: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = (raw or b"").translate(ASCII_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    if width == 2:
        joined = [a + b" " + b for a, b in zip(words, words[1:], strict=False)]
    else:
        joined = [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)]
    return np.array([xxhash.xxh3_64_intdigest(s) for s in set(joined)], np.uint64)


def signature(hashes: np.ndarray, plan: Plan = _DEFAULT) -> np.ndarray:
    """The minima of all hash functions, 32 bits each."""
    x, (a, b, _, _) = hashes >> np.uint64(32), plan.numbers
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(x), CHUNK):
        values = a[:, None] * x[None, k : k + CHUNK]
        values += b[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least >> np.uint64(32)


def band_keys(minima: np.ndarray, plan: Plan = _DEFAULT) -> np.ndarray:
    _, _, mix, salt = plan.numbers
    keys = (minima.reshape(plan.bands, plan.rows) * mix).sum(axis=1, dtype=np.uint64) ^ salt
    keys ^= keys >> np.uint64(29)
    return (keys * np.uint64(0xBF58476D1CE4E5B9) + salt).view(np.int64)


def sketch_of(minima: np.ndarray, plan: Plan = _DEFAULT) -> np.ndarray:
    """One bit of each minimum, packed into 64-bit words."""
    mixed = (minima * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
    bits = np.zeros(plan.words * 64, np.uint8)
    bits[: len(minima)] = mixed
    return np.packbits(bits).view(np.int64)


def _set_id(hashes: np.ndarray) -> bytes:
    return blake2b(np.sort(hashes).tobytes(), digest_size=16).digest()


def _signatures(width: int, plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, keys, sketches = [], [], [], []
            for raw in text_bytes(batch["text"]):
                own = shingles(raw, width)
                sizes.append(len(own))
                if len(own):
                    minima = signature(own, plan)
                    ids.append(_set_id(own))
                    keys.append(band_keys(minima, plan))
                    sketches.append(sketch_of(minima, plan))
                else:
                    ids.append(None)
                    keys.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_id", "keys", "sketch"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(raw, width) for raw in text_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["set_id"], pa.array([_set_id(x) for x in own], pa.binary()), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))],
                ["id", "set_id", "own_id", "items"],
            )

    return run


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each set one bit per bucket of hashes: whether it holds an odd number. At least four bits a shingle; `half` is the sketch folded once."""
    for batch in batches:
        sizes, odd, half = [], [], []
        for own in batch["items"].to_pylist():
            x = np.array(own, np.int64).view(np.uint64)
            words = 1 << max(1, (-(-4 * len(x) // 64) - 1).bit_length())
            counts = np.bincount((x % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
            bits = np.packbits(counts.astype(np.uint8)).view(np.int64)
            sizes.append(len(x))
            odd.append(bits)
            half.append(bits[: words // 2] ^ bits[words // 2 :])
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(odd, pa.list_(pa.int64())), pa.array(half, pa.list_(pa.int64()))],
            ["id", "n", "odd", "half"],
        )


def _alike(plan: Plan):
    """Sketches as close as those of a pair at the least similarity are, but for once in 10**7."""

    def alike(x: str, y: str) -> Column:
        parts = [F.bit_count(F.col(f"{x}.s{k}").bitwiseXOR(F.col(f"{y}.s{k}"))) for k in range(plan.words)]
        return reduce(lambda p, q: p + q, parts) <= plan.mismatches

    return alike


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    plan = plan_for(percent)
    table = written(slim.mapInArrow(_signatures(width, plan), OUT), "minhash")
    usable = table.where("set_id is not null and doc_id is not null")
    # A node is a set; doc is the smallest doc_id that has it.
    sets = usable.groupBy("set_id").agg(F.min("doc_id").alias("doc"), F.min_by(F.struct("keys", "sketch"), "doc_id").alias("x"))
    sets = written(sets.select("set_id", F.xxhash64("set_id").alias("id"), "doc", "x.keys", "x.sketch"), "sets")
    sketch = sets.select("id", *[F.col("sketch")[k].alias(f"s{k}") for k in range(plan.words)])

    def narrow(rows: DataFrame) -> DataFrame:
        """The size and the parity sketch of every member."""
        wanted = items.join(rows.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("doc_id"), "items")
        odd = wanted.mapInArrow(_parities, "id long, n long, odd array<long>, half array<long>")
        return rows.join(odd, "id")

    def near(x: str, y: str) -> Column:
        """Sets differ in at least as many shingles as their parity sketches in bits."""
        same, more = F.size(f"{x}.odd") == F.size(f"{y}.odd"), F.size(f"{x}.odd") == F.size(f"{y}.odd") * 2
        less = F.size(f"{x}.odd") * 2 == F.size(f"{y}.odd")
        left = F.when(same | less, F.col(f"{x}.odd")).when(more, F.col(f"{x}.half"))
        right = F.when(same | more, F.col(f"{y}.odd")).when(less, F.col(f"{y}.half"))
        bits = F.zip_with(left, right, lambda p, q: F.bit_count(p.bitwiseXOR(q)))
        differing = F.aggregate(bits, F.lit(0), lambda p, q: p + q)
        # From 50 percent up sizes further apart than a doubling can't be similar; their sketches don't compare, and null is no.
        return F.coalesce(differing * (100 + percent) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - percent), F.lit(False))

    buckets = Buckets(
        sets.select("id", F.explode("keys").alias("key")), alike=_alike(plan), sketch=sketch,
        narrow=narrow if percent >= 50 else None, near=near if percent >= 50 else None,
    )
    wanted = buckets.candidates().join(sets.select("id", "set_id", "doc"), "id")
    texts = wanted.join(slim, F.col("doc") == F.col("doc_id")).select(F.col("id").alias("doc_id"), "set_id", "text")
    items = texts.mapInArrow(_sets(width), "id long, set_id binary, own_id binary, items array<long>").where("own_id = set_id")
    # Only rows of the smallest doc_id are looked up, and those of them with another set are gone by now.
    items = written(items.select("id", "items").dropDuplicates(["id"]), "items")

    def verify(pairs: DataFrame) -> DataFrame:
        left = items.select(F.col("id").alias("a"), F.col("items").alias("xs"))
        right = items.select(F.col("id").alias("b"), F.col("items").alias("ys"))
        both = F.size(F.array_intersect("xs", "ys"))
        return (
            pairs.join(left, "a").select("a", "b", "xs").join(right, "b")
            .select("a", "b", both.alias("n"), (F.size("xs") + F.size("ys")).alias("total"))
            .select("a", "b", (F.col("n") / (F.col("total") - F.col("n"))).alias("sim"), (F.col("n") * 100 >= (F.col("total") - F.col("n")) * percent).alias("linked"))
        )

    # The sets of one doc_id belong together.
    own = usable.select("doc_id", F.xxhash64("set_id").alias("id")).distinct()
    ends = own.groupBy("doc_id").agg(F.min("id").alias("u"), F.max("id").alias("v")).where("u <> v")
    known = written(own.join(ends.select("doc_id", "u"), "doc_id").select("u", F.col("id").alias("v")).where("u <> v"), "known")
    found = buckets.link(verify, known)
    named = sets.select("set_id", "id", "doc").join(found, F.col("id") == F.col("node"), "left")
    named = written(named.select("set_id", "doc", F.coalesce("component", "id").alias("component")), "named")
    for used in (found, items, known, sets, buckets.star):
        discard(used)
    least = named.groupBy("component").agg(F.min("doc").alias("c"))
    names = named.join(least, "component").select("set_id", "c")
    out = table.select("doc_id", "n_shingles", "set_id").join(names, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
