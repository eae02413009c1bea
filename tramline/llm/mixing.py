"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked until the sums over
each of the three match its target shares, then every document of a cell is drawn
with the cell's probability.

Targets: a share for each value of a dimension, or an exponent: shares in
proportion to tokens ** exponent. The weight of a cell is fitted tokens over
actual tokens; with the largest weight as 1 nothing would be drawn twice but much
lost, so `keep` states the share of all tokens to draw, and weights above 1 become
a probability of 1. The scale is raised until the expected tokens meet `keep` as
closely as whole documents allow.

The clipping gives the clipped tokens of rare cells to the others, so the mix then
misses its targets. With `copies`, as the query and the pipeline run it, nothing is clipped: the
probability is the expected number of copies, `keep` times the weight, of which the
whole part is always drawn and the fraction by the draw. The expected token shares
are the targets, and the expected tokens `keep` of all.

Draws are a keyed hash of doc_id (and the text, for rows without one), so that any
rerun draws the same rows.

The cells are bounded by the product of the dimensions' values. Up to `MAX_CELLS`
of them are raked on the driver; beyond that an error asks for coarser dimensions.

Defined results: a null in a dimension is a value of its own; a null or blank text
has no tokens, a weight of 1 and probability `keep`; equal rows share a draw;
values without a stated share get a share of 0 and are not drawn; stated values
that do not occur are ignored and the rest rescaled; extra columns pass through;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.shared import free_name

MAX_CELLS = 500_000
BROADCAST_BYTES = 32 << 20
ROUNDS = 30
#: Share error at which raking stops early; 0 runs all rounds.
TOLERANCE = 0.0
KEEP = 0.7
SEED = "mix-1"
#: Exponents of the default targets: sources and topics are flattened, languages more so.
DEFAULT_TARGETS = {"source": 0.7, "lang": 0.5, "topic": 0.7}


def n_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse content class from marks in the text."""
    return (
        F.when(text.isNull(), "none")
        .when(text.rlike(r"(?i)licen[sc]e|copyright"), "licensed")
        .when(text.rlike(r"[#*$%&|<>]"), "marked")
        .when(text.rlike(r"[0-9]{3}"), "numeric")
        .otherwise("prose")
    )


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of a keyed MD5."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _targets(tokens: np.ndarray, index: np.ndarray, values: list, wanted) -> np.ndarray:
    """Target shares of the values of one dimension."""
    own = np.bincount(index, tokens, len(values))
    if isinstance(wanted, dict):
        share = np.array([float(wanted.get(v, 0.0)) for v in values]) * (own > 0)
    else:
        share = np.where(own > 0, own ** float(wanted), 0.0)
    return share / share.sum() if share.sum() else share


def rake(
    tokens: np.ndarray, indices: list[np.ndarray], shares: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE
) -> np.ndarray:
    """Fitted tokens of the cells; their total is that of `tokens`."""
    fitted, total = tokens.astype(np.float64).copy(), float(tokens.sum())
    for _ in range(rounds):
        worst = 0.0
        for index, share in zip(indices, shares, strict=True):
            own = np.bincount(index, fitted, len(share))
            factor = np.divide(share * total, own, out=np.zeros_like(own), where=own > 0)
            worst = max(worst, float(np.abs(own / total - share).max(initial=0.0))) if total else 0.0
            fitted *= factor[index]
        if worst <= tolerance:
            break
    return fitted


def probabilities(tokens: np.ndarray, fitted: np.ndarray, keep: float = KEEP) -> np.ndarray:
    """min(1, scale * weight) with the scale at which the expected tokens are `keep` of all, where that can be."""
    weight = np.divide(fitted, tokens, out=np.zeros_like(fitted), where=tokens > 0)
    order = np.argsort(-weight, kind="stable")
    w, t = weight[order], tokens[order].astype(np.float64)
    goal, sure = keep * float(tokens.sum()), 0.0
    rest = float((w * t).sum())
    scale = 0.0
    for k in range(len(w)):
        if w[k] <= 0 or rest <= 0:
            break
        scale = (goal - sure) / rest
        if scale * w[k] <= 1:
            break
        sure, rest = sure + t[k], rest - w[k] * t[k]
    return np.minimum(1.0, np.maximum(0.0, scale * weight))


def expected_copies(tokens: np.ndarray, fitted: np.ndarray, keep: float = KEEP) -> np.ndarray:
    """How often a document of each cell is drawn, so that the expected shares are the fitted ones and the total `keep`."""
    weight = np.divide(fitted, tokens, out=np.zeros_like(fitted), where=tokens > 0)
    total = float(fitted.sum())
    return weight * (keep * float(tokens.sum()) / total) if total else weight


def mix(
    docs: DataFrame, dimensions: dict[str, Column], targets: dict | None = None, keep: float = KEEP, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text", copies: bool = False,
) -> DataFrame:
    """All columns of docs, then mix_tokens, mix_<dimension>, mix_weight, mix_prob, mix_draw, mix_kept; with copies, mix_copies too."""
    targets = targets or DEFAULT_TARGETS
    spark, names = docs.sparkSession, list(dimensions)
    made = {n: free_name(docs.columns, f"mix_{n}") for n in names}
    stem = {n: free_name(docs.columns, f"mix_{n}") for n in ("tokens", "weight", "prob", "draw", "kept", "copies")}
    text = F.col(text_col).cast("string")
    rows = docs.select("*", n_tokens(text).alias(stem["tokens"]), *(c.cast("string").alias(made[n]) for n, c in dimensions.items()))
    cells = rows.groupBy(*made.values()).agg(F.sum(stem["tokens"]).alias("t")).orderBy(*made.values())
    held = cells.limit(MAX_CELLS + 1).collect()
    if len(held) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells; use coarser dimensions")
    tokens = np.array([r["t"] for r in held], np.float64)
    indices, shares = [], []
    for n in names:
        values = list(dict.fromkeys(r[made[n]] for r in held))
        at = {v: k for k, v in enumerate(values)}
        indices.append(np.array([at[r[made[n]]] for r in held], np.int64))
        shares.append(_targets(tokens, indices[-1], values, targets[n]))
    fitted = rake(tokens, indices, shares) if len(held) else tokens
    probs = (expected_copies if copies else probabilities)(tokens, fitted, keep) if len(held) else tokens
    weights = np.divide(fitted, tokens, out=np.ones_like(fitted), where=tokens > 0)
    probs = np.where(tokens > 0, probs, keep)
    keys = [free_name(rows.columns, f"_mix_key_{k}") for k in range(len(names))]
    w_col, p_col = free_name(rows.columns, "_mix_w"), free_name(rows.columns, "_mix_p")
    schema = ", ".join(f"`{k}` string" for k in keys) + f", `{w_col}` double, `{p_col}` double"
    table = spark.createDataFrame(
        [(*(r[made[n]] for n in names), float(w), float(p)) for r, w, p in zip(held, weights, probs, strict=True)], schema
    )
    same = [F.col(made[n]).eqNullSafe(F.col(k)) for n, k in zip(names, keys, strict=True)]
    # Sent to all only where the cells' values are short enough; else a join by the cell's values.
    size = sum(16 + sum(len(r[made[n]] or "") for n in names) for r in held)
    out = rows.join(F.broadcast(table) if size <= BROADCAST_BYTES else table, same, "left")
    out = out.withColumn(stem["draw"], draw(F.col(id_col), text, seed))
    blank = F.col(stem["tokens"]) == 0
    weight = F.when(blank, 1.0).otherwise(F.col(w_col)).alias(stem["weight"])
    prob = F.when(blank, float(keep)).otherwise(F.col(p_col)).alias(stem["prob"])
    out = out.select(*rows.columns, weight, prob, stem["draw"])
    out = out.withColumn(stem["kept"], F.col(stem["draw"]) < F.col(stem["prob"]))
    if not copies:
        return out
    whole = F.floor(stem["prob"])
    more = (F.col(stem["draw"]) < F.col(stem["prob"]) - whole).cast("int")
    return out.withColumn(stem["copies"], (whole + more).cast("int"))
