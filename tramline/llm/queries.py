"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import chat, decontam, html, langid, linedup, minhash, mixing, pii, quality, warc
from tramline.llm.shared import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and -7, formatted into windows and read back from them."""
    escaped = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(escaped).alias("text"),
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = chat.windows(rows.unionByName(extra))
    turns = F.filter(chat.read_turns(F.col("formatted")), lambda t, k: k >= F.col("n_repeated"))
    back = made.select("conv_id", "window", "formatted", turns.alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("targets"))
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    part = F.struct(
        "window", F.array_join(told, "").alias("told"), F.array_join("targets", "").alias("target"),
    )
    whole = back.groupBy("conv_id").agg(
        F.sum(F.size("turns")).cast("long").alias("n_turns"), F.array_sort(F.collect_list(part)).alias("parts"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"),
    )
    target = F.array_join("parts.target", "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join("parts.told", ""), 256).alias("turns_sha256"),
        F.length(target).cast("long").alias("loss_chars"), F.sha2(target, 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )


def _op1_sql() -> str:
    budget = chat.Budget()

    def escaped(column: str) -> str:
        out = f"replace({column}, '{chat.MARK}', '{chat.MARK}0')"
        for c in chat.CONTROL:
            out = f"replace({out}, '{c}', '{c[0]}{chat.MARK}1{c[1:]}')"
        return out

    return rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, row_number() OVER o - 1 AS pos, len(regexp_extract_all(text, '{chat.TOKEN}')) + {chat.OVERHEAD} AS tok,
    length({escaped("role")}) + length({escaped("text")}) + {len(chat.START + chat.BODY + chat.END)} AS chars
  FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
s AS (SELECT *, pos = 0 AND role = 'system' AS sys FROM t),
p AS (
  SELECT *, max(CASE WHEN sys THEN tok END) OVER (PARTITION BY conv_id) AS sys_tok,
    sum(CASE WHEN sys THEN 0 ELSE tok END) OVER (PARTITION BY conv_id ORDER BY pos) - CASE WHEN sys THEN 0 ELSE tok END AS ofs
  FROM s),
k AS (
  SELECT *, greatest({budget.window - budget.history} - coalesce(sys_tok, 0), 1) AS room FROM p),
f AS (
  SELECT *, CASE WHEN sys THEN NULL ELSE (ofs // room) || ':' || ((ofs + tok - 1) // room) END AS key FROM k),
g AS (
  SELECT *, NOT sys AND (lag(key) OVER o IS NULL OR lag(key) OVER o <> key) AS is_first
  FROM f WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
h AS (SELECT *, sum(CAST(is_first AS INT)) OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS span FROM g),
n AS (SELECT conv_id, greatest(max(span), 0) AS last FROM h GROUP BY conv_id),
copies AS (
  SELECT h.conv_id, h.pos, count(*) AS again FROM h JOIN h l ON h.conv_id IS NOT DISTINCT FROM l.conv_id AND l.is_first
    AND l.ofs BETWEEN h.ofs + 1 AND h.ofs + {budget.history} AND NOT h.sys GROUP BY ALL),
c AS (
  SELECT h.conv_id, sum(h.chars * CASE WHEN h.sys THEN 1 + n.last ELSE 1 + coalesce(copies.again, 0) END) AS chars, max(n.last) + 1 AS n_windows
  FROM h JOIN n ON n.conv_id IS NOT DISTINCT FROM h.conv_id
  LEFT JOIN copies ON copies.conv_id IS NOT DISTINCT FROM h.conv_id AND copies.pos = h.pos GROUP BY h.conv_id),
d AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM t GROUP BY conv_id)
SELECT d.conv_id, d.n_turns, d.turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(c.chars AS BIGINT) AS formatted_chars, CAST(c.n_windows AS BIGINT) AS n_windows
FROM d JOIN c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the whole benchmark."""
    found = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), decontam.contaminated().alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits)
  GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn on three folds of four, predict every document."""
    docs = _table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    train = docs.where((fold != 2) & F.col("lang").isNotNull()).select("text", "lang")
    model = langid.fit(train)
    found = langid.predict(docs, model)
    return found.select("doc_id", (F.coalesce(fold, F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the forest's verdict for every document."""
    found = quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives in the shared folder and read back."""
    path = new_path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path)
    found = warc.records(warc.read(spark, path, bodies=False))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS top, count(*) AS n FROM p GROUP BY h)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(p.h, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN m USING (h)
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated lines."""
    found = linedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)
    return found.select("doc_id", "text", "n_lines", "n_removed_lines")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data."""
    found = pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents over distinct 2-word shingles at a similarity of 0.8."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 2 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS sh
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
f AS (SELECT doc_id, k, md5(string_agg(sh, chr(10) ORDER BY sh)) AS own FROM s JOIN n USING (doc_id) GROUP BY doc_id, k),
r AS (SELECT min(doc_id) AS rep, any_value(k) AS k, own FROM f GROUP BY own),
rs AS (SELECT s.* FROM s JOIN r ON s.doc_id = r.rep),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM rs x JOIN rs y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM pairs JOIN r ra ON ra.rep = a JOIN r rb ON rb.rep = b WHERE 100 * c >= 80 * (ra.k + rb.k - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (
  SELECT rep AS x, rep AS y FROM r UNION SELECT reach.x, l.b FROM reach JOIN l ON reach.y = l.a),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
  d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN r ON r.own = f.own LEFT JOIN c ON c.x = r.rep
"""

def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and drawn copies of every document under the default targets; expected shares are the targets."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    dimensions = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_of(F.col("text"))}
    found = mixing.mix(docs, dimensions, copies=True)
    return found.select(
        "doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"),
        F.round("mix_weight", 6).alias("weight"), F.round("mix_prob", 6).alias("expected_copies"), F.col("mix_copies").cast("long").alias("copies"),
    )


def _op10_sql(rounds: int = 30) -> str:
    dims = ("source", "lang", "topic")
    powers = mixing.DEFAULT_TARGETS
    steps, last = [], "c0"
    for k in range(rounds):
        for d in dims:
            name = f"c{k}_{d}"
            steps.append(
                f"{name} AS (SELECT * REPLACE (fit * coalesce(s_{d} * total / nullif(sum(fit) OVER (PARTITION BY {d}), 0), 0) AS fit) FROM {last})"
            )
            last = name
    shares = ", ".join(
        f"CASE WHEN o_{d} > 0 THEN power(o_{d}, {powers[d]}) ELSE 0 END / (SELECT sum(power(x, {powers[d]})) "
        f"FROM (SELECT sum(t) AS x FROM cells GROUP BY {d}) WHERE x > 0) AS s_{d}"
        for d in dims
    )
    owns = ", ".join(f"sum(t) OVER (PARTITION BY {d}) AS o_{d}" for d in dims)
    chain = ",\n".join(steps)
    return rf"""
WITH d AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
    CASE WHEN text IS NULL THEN 'none' WHEN regexp_matches(text, '(?i)licen[sc]e|copyright') THEN 'licensed'
      WHEN regexp_matches(text, '[#*$%&|<>]') THEN 'marked' WHEN regexp_matches(text, '[0-9]{{3}}') THEN 'numeric' ELSE 'prose' END AS topic,
    CAST('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS t FROM d GROUP BY ALL),
own AS (SELECT *, {owns}, sum(t) OVER () AS total FROM cells),
c0 AS (SELECT source, lang, topic, t, t AS fit, total, {shares} FROM own),
{chain},
f AS (SELECT sum(fit) AS fitted FROM {last}),
w AS (SELECT source, lang, topic, CASE WHEN t > 0 THEN fit / t ELSE 0 END AS w, {mixing.KEEP} * total / nullif(fitted, 0) AS scale FROM {last}, f),
p AS (
  SELECT d.*, CASE WHEN n_tokens = 0 THEN 1.0 ELSE w END AS w, CASE WHEN n_tokens = 0 THEN {mixing.KEEP} ELSE w * coalesce(scale, 1) END AS e
  FROM d JOIN w ON w.source IS NOT DISTINCT FROM d.source AND w.lang IS NOT DISTINCT FROM d.lang AND w.topic = d.topic)
SELECT doc_id, source, lang, topic, n_tokens, round(w, 6) AS weight, round(e, 6) AS expected_copies,
  CAST(floor(e) + CASE WHEN u < e - floor(e) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM p
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc": op5_warc,
    "op6_line_dedup": op6_line_dedup,
    "op7_main_text": op7_main_text,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_source_mixing": op10_source_mixing,
}
SQL: dict[str, str] = {"op1_chat_formatting": _op1_sql(), "op2_decontamination": OP2_SQL, "op5_warc": OP5_SQL, "op9_minhash_near_dedup": OP9_SQL, "op10_source_mixing": _op10_sql()}
