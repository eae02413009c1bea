"""Near-duplicates, line dedup, mixing, archives and the pipeline."""

from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.llm import graph, linedup, minhash, mixing, warc

SF = "/root/testdata/sf0.01"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, Key int, ID string")


def closed(n, linked):
    """Smallest member of each node's component."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


# components


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    for edges in ([], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)], [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]):
        frame = spark.createDataFrame(edges, "u long, v long")
        want = closed(100, edges)
        found = {r["node"]: r["component"] for r in graph.components(frame).collect()}
        nodes = {x for a, b in edges if a != b for x in (a, b)}
        assert found == {x: want[x] for x in nodes}


# near-duplicates


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}


def brute_components(rows, width, percent=80):
    sets = [shingle_set(t, width) for _, t in rows]
    linked = [
        (a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]
        and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    top = closed(len(rows), linked)
    smallest = {}
    for k, t in enumerate(top):
        smallest[t] = min(smallest.get(t, rows[k][0]), rows[k][0])
    return {rows[k][0]: (len(sets[k]), smallest[t]) for k, t in enumerate(top)}


def copies(rng, n, size, rate):
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    for _ in range(n):
        own = rate * rng.random()
        yield " ".join(w if rng.random() > own else f"v{rng.randrange(10**6)}" for w in base)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_against_brute_force(spark, width):
    rng = random.Random(width)
    texts = [t for n, size, rate in ((120, 150, 0.2), (60, 80, 0.1), (25, 40, 0.3)) for t in copies(rng, n, size, rate)]
    texts += [texts[5]] * 9 + [texts[130].upper()] * 2 + ["", " \n", "one", "ONE", "one two", "Two", None]
    chain = [f"c{k}" for k in range(300)]
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 120, 6)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    found = minhash.near_duplicates(docs_of(spark, rows), width=width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows, width)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


@pytest.mark.parametrize("percent", [30, 50, 95])
def test_near_duplicates_at_other_similarities(spark, percent):
    rng = random.Random(percent)
    texts = [t for n, size, rate in ((40, 90, 0.5), (30, 60, 0.03), (15, 40, 0.9)) for t in copies(rng, n, size, rate)]
    rows = list(enumerate(texts))
    found = minhash.near_duplicates(docs_of(spark, rows), width=2, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows, 2, percent)


def test_rows_of_one_doc_id_are_one_component(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(5, one), (5, two), (9, two + " z"), (7, "c d e"), (8, one), (9, ""), (4, None)]
    found = {(r["doc_id"], r["n_shingles"] > 0): r["component_id"] for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert found == {(5, True): 5, (9, True): 5, (7, True): 7, (8, True): 5, (9, False): 9, (4, False): 4}


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c"), (None, "a b c"), (3, "a b c"), (3, "a b c"), (1, "a b c"), (7, "x " * 60000), (8, "x")]
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs_of(spark, rows)).collect()), key=str)
    assert found == sorted(
        [(None, None, True), (None, None, True), (3, 1, False), (3, 1, False), (1, 1, True), (7, 7, True), (8, 8, True)], key=str
    )
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_signature_is_the_minimum_of_each_function():
    own = minhash.shingles(b"a b c d e f", 2)
    x = own >> np.uint64(32)
    whole = ((minhash._A[:, None] * x[None, :] + minhash._B[:, None]) >> np.uint64(32)).min(axis=1)
    assert (minhash.signature(own) == whole).all() and len(own) == 5


# lines


def normal(line):
    return re.sub(r"[0-9]+", "0", re.sub(r"[\W_]+", " ", line.lower())).strip()


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for k, x in enumerate(a, 1):
        last, row[0] = row[0], k
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(spark, rows, min_words=5):
    """Groups by SimHash distance and edit similarity of all pairs; the first occurrence stays."""
    lines = {}
    for d, text in rows:
        for no, line in enumerate((text or "").split("\n")):
            n = normal(line)
            if text is not None and len(n.split()) >= min_words:
                lines.setdefault(n, []).append((d, no))
    names = sorted(lines)
    words = sorted({w for n in names for w in n.split()})
    hashed = {r["w"]: r["x"] & (2**64 - 1) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("x")).collect()}

    def code(n):
        own = n.split()
        return sum(1 << b for b in range(64) if 2 * sum(hashed[w] >> b & 1 for w in own) > len(own))

    codes = [code(n) for n in names]
    linked = [
        (a, b) for a in range(len(names)) for b in range(a) if (codes[a] ^ codes[b]).bit_count() <= 3
        and levenshtein(names[a], names[b]) <= max(len(names[a]), len(names[b])) * 0.2 + 1e-9
    ]
    groups = {}
    for k, t in enumerate(closed(len(names), linked)):
        groups.setdefault(t, []).extend(lines[names[k]])
    gone = {x for own in groups.values() for x in sorted(own)[1:]}
    return {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows}, len(linked)


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(f"wort{rng.randrange(500)}" for _ in range(rng.choice([4, 6, 30, 90]))) for _ in range(25)]
    base += ["kept short", "", "Seite 12 von 99 im Buch", "Seite 7 von 100 im Buch."]

    def edited(line):
        words = line.split()
        if len(words) > 20:
            words[rng.randrange(len(words))] = "neu" + str(rng.randrange(9))
        return " ".join(words) + rng.choice(["", "!", " ."])

    rows = [(k, "\n".join(edited(rng.choice(base)) for _ in range(rng.randint(1, 8)))) for k in range(50)]
    rows += [(60, None), (61, ""), (62, "\n\n")]
    want, fuzzy = brute_lines(spark, rows)
    found = linedup.dedup_lines(docs_of(spark, rows))
    assert found.columns[:4] == ["doc_id", "text", "Key", "ID"]
    assert {r["doc_id"]: r["text"] for r in found.collect()} == want and fuzzy > 5


def test_line_dedup_edges(spark):
    long = " ".join(f"w{k % 977}" for k in range(40000))
    rows = [(1, "a b c d e f\nx"), (1, "a b c d e f\nx"), (None, "a b c d e f"), (2, long), (3, long + "\nend"), (4, "é")]
    found = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed_lines"]) for r in linedup.dedup_lines(docs_of(spark, rows)).collect()), key=str)
    assert found == sorted([(1, "x", 2, 1), (1, "x", 2, 1), (None, "a b c d e f", 1, 0), (2, long, 1, 0), (3, "end", 2, 1), (4, "é", 1, 0)], key=str)
    assert linedup.dedup_lines(docs_of(spark, [])).count() == 0


def test_whole_line_dedup_links_by_edit_similarity_alone(spark):
    """Groups of all pairs by edit similarity, without any other bound."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprst") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (5, 7, 10, 20, 30, 50, 60) for _ in range(4)]

    def edited(line):
        words = line.split()
        for k in rng.sample(range(len(words)), max(1, len(words) // 10)):
            words[k] = rng.choice(vocabulary)
        return " ".join(words)

    rows = list(enumerate(x for line in base for x in (line, edited(line), edited(line))))
    linked = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if levenshtein(rows[a][1], rows[b][1]) <= max(len(rows[a][1]), len(rows[b][1])) * 0.2 + 1e-9
    ]
    first = {}
    want = {k for k, t in enumerate(closed(len(rows), linked)) if first.setdefault(t, k) == k}
    found = {r["doc_id"] for r in linedup.dedup_lines(docs_of(spark, rows), whole=True).where("n_removed_lines = 0").collect()}
    assert found == want and len(linked) > 60


def test_whole_line_dedup_of_short_and_unspaced_lines(spark):
    passage = "人类社会的发展离不开语言文字的使用和传播以及知识的积累"
    edited = passage.replace("积累", "增长")
    rows = [(1, f"Home\n{passage}\n\n12"), (2, f"home!\n{edited}\n\n57"), (3, f"ติดต่อเรา\n{passage}"), (4, "ติดต่อเรา\n---\nAbout us")]
    found = {r["doc_id"]: r["text"] for r in linedup.dedup_lines(docs_of(spark, rows), whole=True).collect()}
    assert found == {1: f"Home\n{passage}\n\n12", 2: "\n57", 3: "ติดต่อเรา", 4: "---\nAbout us"}


def test_line_dedup_leaves_columns_of_any_name_alone(spark):
    names = ["_line_own", "_line_d", "_line_h", "_line_gone", "_line_lines", "n_lines", "n_removed_lines", "id", "norm", "key", "a", "b", "d", "h", "no"]
    docs = spark.createDataFrame([(k, "one two three four five six\nend", *(f"{n}{k}" for n in names)) for k in range(2)], ["doc_id", "text", *names])
    for whole in (True, False):
        found = linedup.dedup_lines(docs, whole=whole)
        assert found.columns == ["doc_id", "text", *names, "n_lines_1", "n_removed_lines_1"]
        rows = {r["doc_id"]: r for r in found.collect()}
        assert all(rows[k][n] == f"{n}{k}" for k in range(2) for n in names)
        assert rows[1]["text"] == ("" if whole else "end") and rows[0]["n_lines_1"] == 2


def test_whole_line_dedup_of_long_and_monotonous_lines(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnoprst") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    long = [rng.choice(words) for _ in range(4000)]
    edited = [w if rng.random() > 0.08 else rng.choice(words) for w in long]
    rows = [(1, " ".join(long)), (2, " ".join(edited)), (3, "na " * 300), (4, "na " * 310), (5, " ".join(long[:1500] + rng.choices(words, k=2500)))]
    found = {r["doc_id"]: r["n_removed_lines"] for r in linedup.dedup_lines(docs_of(spark, rows), whole=True).collect()}
    assert found == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0}


# mixing


def test_raked_marginals_meet_their_targets():
    rng = np.random.default_rng(2)
    tokens = rng.integers(1, 1000, 60).astype(float)
    indices = [np.arange(60) % 5, np.arange(60) % 4, np.arange(60) // 20]
    shares = [rng.dirichlet(np.ones(n)) for n in (5, 4, 3)]
    fitted = mixing.rake(tokens, indices, shares, rounds=200)
    for index, share in zip(indices, shares, strict=True):
        assert np.allclose(np.bincount(index, fitted) / tokens.sum(), share, atol=1e-6)
    probs = mixing.probabilities(tokens, fitted, 0.5)
    assert probs.max() <= 1 and np.isclose((probs * tokens).sum(), 0.5 * tokens.sum())
    free = probs < 1
    ratio = probs[free] / (fitted / tokens)[free]
    assert np.allclose(ratio, ratio[0])


def test_mixing_edges(spark):
    rows = [(1, "a b", "s", "en"), (1, "a b", "s", "en"), (None, None, None, None), (3, "", "s", None), (4, "c " * 9999, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, Mix_Tokens string")
    dims = {"source": F.col("source"), "lang": F.col("Mix_Tokens"), "topic": mixing.topic_of(F.col("text"))}
    found = mixing.mix(docs, dims, {"source": {"s": 1.0, "other": 3.0}, "lang": 1.0, "topic": 1.0}).collect()
    assert len(found) == 5
    big = next(r for r in found if r["doc_id"] == 4)
    assert big["mix_prob"] == 0 and not big["mix_kept"] and big["Mix_Tokens"] == "de"
    blank = next(r for r in found if r["doc_id"] == 3)
    assert blank["mix_weight"] == 1 and blank["mix_prob"] == mixing.KEEP
    assert mixing.mix(docs.limit(0), dims).count() == 0


def test_mixing_leaves_columns_of_any_name_alone(spark):
    names = ["_mix_w", "_mix_p", "_mix_key_0", "mix_kept", "t"]
    docs = spark.createDataFrame([(k, "a b c", f"s{k % 2}", *(f"{n}{k}" for n in names)) for k in range(4)], ["doc_id", "text", "source", *names])
    for copies in (False, True):
        found = mixing.mix(docs, {"source": F.col("source")}, {"source": 1.0}, copies=copies)
        assert found.columns[:8] == docs.columns and "mix_kept_1" in found.columns
        assert all(r[n] == f"{n}{r['doc_id']}" for r in found.collect() for n in names)


def test_expected_shares_of_copies_equal_the_targets(spark):
    rows = [(k, "w " * (1 + k % 7), "big" if k % 50 else "rare", "en" if k % 9 else "fr") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": {"big": 0.7, "rare": 0.3}, "lang": {"en": 0.6, "fr": 0.4}}
    found = mixing.mix(docs, {"source": F.col("source"), "lang": F.col("lang")}, targets, copies=True).collect()
    total = sum(r["mix_tokens"] for r in found)
    for name, shares in targets.items():
        for value, share in shares.items():
            own = sum(r["mix_prob"] * r["mix_tokens"] for r in found if r[name] == value)
            assert abs(own / (mixing.KEEP * total) - share) < 1e-6
    assert max(r["mix_prob"] for r in found) > 1
    assert all(abs(r["mix_copies"] - r["mix_prob"]) < 1 for r in found)
    drawn = sum(r["mix_copies"] * r["mix_tokens"] for r in found)
    assert abs(drawn / (mixing.KEEP * total) - 1) < 0.05


# archives


def page_rows():
    return [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "x", "<b>5</b>" * 5000), (None, "n", "<p>é</p>"), (6, "y", "six"), (6, "y", "six")]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, 0) for r in page_rows()], "page_id long, url string, html string, SHA int")
    path = str(tmp_path / "warc")
    warc.write(pages, path, segment=500)
    found = warc.read(spark, path)
    assert warc.gaps(found).count() == 0
    rows = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.records(found).collect()), key=str)
    assert rows == sorted(
        [(1, "revisit", 2, 9), (2, "response", None, 9), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 40000),
         (None, "revisit", 2, 9), (6, "response", None, 3), (6, "response", None, 3)], key=str)
    assert {bytes(r["payload"]) for r in warc.records(found).where("page_id = 5").collect()} == {b"<b>5</b>" * 5000}
    none = str(tmp_path / "none")
    warc.write(pages.limit(0), none)
    assert warc.records(warc.read(spark, none)).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_all_undamaged_records(packed):
    rng = random.Random(packed)
    for _ in range(60):
        records = [warc.record(k, f"u{k}", bytes(rng.randrange(256) for _ in range(rng.randrange(300))), None) for k in range(12)]
        parts = [warc.member(r) if packed else r for r in records]
        starts = np.cumsum([0, *map(len, parts)])
        data = bytearray(b"".join(parts))
        hit = set()
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(data))
            kind = rng.choice(["flip", "zero", "text"])
            size = rng.randint(1, 30)
            for k in range(at, min(len(data), at + size)):
                old = data[k]
                data[k] = old ^ 255 if kind == "flip" else 0 if kind == "zero" else 65
                if data[k] != old:
                    hit.add(int(np.searchsorted(starts, k, side="right")) - 1)
        found = list(warc.salvage(bytes(data)))
        own = {warc.id_of(x.headers["warc-record-id"]) for x in found if isinstance(x, warc.Record)}
        assert own >= set(range(12)) - hit
        covered = sorted((x.offset, x.offset + x.length) if isinstance(x, warc.Record) else (x.start, x.end) for x in found)
        assert all(a[1] <= b[0] for a, b in zip(covered, covered[1:], strict=False))
        for x in found:
            if isinstance(x, warc.Record) and warc.id_of(x.headers["warc-record-id"]) not in {None, *hit}:
                k = warc.id_of(x.headers["warc-record-id"])
                assert x.block == warc.parse(records[k])[1]


def test_salvage_of_cut_and_mixed_files():
    a, b = warc.record(1, "a", b"one", None), warc.record(2, "b", b"two", 1)
    found = list(warc.salvage(b"garbage" + warc.member(a) + b"\n\x00" + b + warc.member(a)[:40]))
    assert [type(x).__name__ for x in found] == ["Gap", "Record", "Record", "Gap"]
    assert found[0].start == 0 and found[0].end == 7 and found[-1].reason == "unfinished member"
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"\r\n")) == []


# the pipeline


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as p
    from tests.llm.test_text_operators import brute_hits

    rng = random.Random(8)
    words = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('klmnrst')}{k}er" for k in range(400)]
    words = [re.sub(r"\d", "", w) for w in words]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    items = [(k, prose(30)) for k in range(3)]
    shared = prose(60)
    base = [prose(120) for _ in range(3)]
    texts = [prose(80) + ".\n" + prose(30) for _ in range(30)]
    texts += [prose(70) + "\n" + shared for _ in range(4)] + [b.replace(" ", "  ", 3) + "\n" + prose(3) for b in base] + base
    texts += [prose(60) + " " + items[k][1] for k in range(3)] + [prose(20), "", None, "x y z " * 60]
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}", len(t or "")) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, stages = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(p.STAGES)

    def step(name, frame):
        out = stages[name](spark, frame, str(tmp_path))
        if name != "source_mixing":
            assert out.columns == p.COLUMNS
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        return spark.read.parquet(path), {r["doc_id"]: r["text"] for r in out.collect()}

    one, kept = step("quality_rules", docs)
    assert set(range(43)) >= set(kept) >= set(range(20)) and not set(kept) & {43, 44, 45, 46}
    two, lines = step("line_dedup", one)
    want, _ = brute_lines(spark, [(k, kept[k]) for k in sorted(kept)])
    assert lines == {k: t for k, t in want.items() if t.strip() or not kept[k].strip()}
    three, near = step("near_dedup", two)
    groups = brute_components(sorted(lines.items()), 5)
    assert set(near) == {k for k in lines if groups[k][1] == k}
    four, clean = step("benchmark_decontamination", three)
    dirty = {k for k, t in near.items() if (h := brute_hits(t, items))[1] and 20 * h[1] >= h[0]}
    assert set(clean) == set(near) - dirty and dirty
    five, last = step("source_mixing", four)
    assert set(last) <= set(clean) and "mix_prob" in five.columns
    run = {r["doc_id"] for r in p.run(spark, str(tmp_path)).collect()}
    assert run == set(last)


def test_texts_of_pairs_move_once_a_cell(spark):
    """300 lines paired with each other, and some pairs apart: every pair gets its texts, and no row is dealt anew once it has one."""
    dense = [(a, b) for a in range(300) for b in range(a + 1, 300)]
    apart = [(-(1 << 62) - k, (1 << 62) + k) for k in range(40)]
    pairs = spark.createDataFrame(dense + apart, "a long, b long")
    ids = sorted({x for p in dense + apart for x in p})
    texts = spark.createDataFrame([(x, f"t{x}", f"w{x}", x % 7) for x in ids], "id long, norm string, w string, m int")
    found = linedup._with_texts(pairs, texts)
    rows = found.collect()
    assert sorted((r["a"], r["b"]) for r in rows) == sorted(dense + apart)
    assert all((r["x"], r["wx"], r["mx"], r["y"], r["wy"], r["my"]) == (f"t{r['a']}", f"w{r['a']}", r["a"] % 7, f"t{r['b']}", f"w{r['b']}", r["b"] % 7) for r in rows)
    sent = found.select("cell", "a").distinct().count() + found.select("cell", "b").distinct().count()
    assert sent < len(rows) / 10


def test_linked_members_are_not_compared_with_the_second_head(spark):
    members = spark.createDataFrame([(1, x) for x in (1, 2, 3, 4, 5)], "key long, id long")
    asked = []

    def verify(pairs):
        asked.append({(r["a"], r["b"]) for r in pairs.collect()})
        odd = (F.col("a") % 2 == 1) & (F.col("b") % 2 == 1)
        return pairs.select("a", "b", F.when(odd, 0.9).otherwise(0.1).alias("sim"), odd.alias("linked"))

    found = {r["node"]: r["component"] for r in graph.Buckets(members).link(verify).collect()}
    assert found == {1: 1, 3: 1, 5: 1}
    assert asked == [{(1, 2), (1, 3), (1, 4), (1, 5)}, {(2, 5), (4, 5)}, {(2, 3), (2, 4), (3, 4)}]


def test_undecided_lines_are_compared_without_a_row_for_each_pair(spark, monkeypatch):
    """Lines around one text, most of them just beyond 0.8 of each other: the links of all pairs, and no table with as many rows as there are pairs."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnoprst") for _ in range(rng.randint(4, 8))) for _ in range(900)]
    base = [rng.choice(words) for _ in range(40)]

    def edited(share):
        return " ".join(w if rng.random() > share or 8 <= k < 20 else rng.choice(words) for k, w in enumerate(base))

    lines = [edited(0.25) for _ in range(60)]
    linked = [
        (a, b) for a in range(len(lines)) for b in range(a)
        if levenshtein(lines[a], lines[b]) <= max(len(lines[a]), len(lines[b])) * 0.2 + 1e-9
    ]
    first = {}
    want = {k for k, t in enumerate(closed(len(lines), linked)) if first.setdefault(t, k) == k}
    sizes = []

    def counted(df, tag, codec="snappy", write=linedup.written):
        out = write(df, tag, codec)
        if tag in ("pairs", "placed", "decided"):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    monkeypatch.setattr(linedup, "written", counted)
    docs = docs_of(spark, list(enumerate(lines)))
    assert {r["doc_id"] for r in linedup.dedup_lines(docs, whole=True).where("n_removed_lines = 0").collect()} == want
    # Three heads at most are compared with all; what the last step writes are links.
    assert 10 < len(want) < 50 and max(sizes) <= max(3 * len(lines), len(linked)) < len(lines) ** 2 / 8


def test_whole_line_dedup_links_lines_with_a_letter_changed_in_most_words(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnoprst") for _ in range(9)) for _ in range(12)]
    other = words[:4] + ["x" + w[1:] for w in words[4:]]
    found = linedup.dedup_lines(docs_of(spark, [(1, " ".join(words)), (2, " ".join(other))]), whole=True)
    assert {r["doc_id"]: r["n_removed_lines"] for r in found.collect()} == {1: 0, 2: 1}


def test_members_of_many_blocks_are_decided_where_they_meet(spark, monkeypatch):
    """150 members of one key in blocks of 16: the links of all pairs, found without a third call of verify."""
    monkeypatch.setattr(graph, "DECIDED", 16)
    n, asked = 150, []
    members = spark.createDataFrame([(1, x) for x in range(n)], "key long, id long")
    sketch = members.select("id", (F.col("id") * 37 % 149).alias("v"))

    def decide(x, y):
        return F.abs(F.col(f"{x}.v") - F.col(f"{y}.v")) == 7

    def verify(pairs):
        asked.append(pairs.count())
        both = pairs.join(sketch.select(F.col("id").alias("a"), F.col("v").alias("x")), "a").join(sketch.select(F.col("id").alias("b"), F.col("v").alias("y")), "b")
        return both.select("a", "b", F.lit(0.5).alias("sim"), (F.abs(F.col("x") - F.col("y")) == 7).alias("linked"))

    found = {r["node"]: r["component"] for r in graph.Buckets(members, sketch=sketch, decide=decide).link(verify).collect()}
    value = [k * 37 % 149 for k in range(n)]
    want = closed(n, [(a, b) for a in range(n) for b in range(a) if abs(value[a] - value[b]) == 7])
    assert {k: found.get(k, k) for k in range(n)} == {k: min(j for j in range(n) if want[j] == want[k]) for k in range(n)} and len(asked) == 2


def test_few_edges_are_linked_without_an_exchange(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    frame = spark.createDataFrame(edges, "u long, v long").repartition(5)
    exchanges = []

    def planned(df, tag, write=graph.written):
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return write(df, tag)

    monkeypatch.setattr(graph, "written", planned)
    want = closed(400, edges)
    for few in (graph.ONE_TASK, 0):
        monkeypatch.setattr(graph, "ONE_TASK", few)
        exchanges.clear()
        found = {r["node"]: r["component"] for r in graph.components(frame).collect()}
        assert {k: found.get(k, k) for k in range(400)} == {k: min(j for j in range(400) if want[j] == want[k]) for k in range(400)}
        assert len(exchanges) > 1 and (max(exchanges) == 0) == bool(few)


def test_scratch_tables_make_a_file_a_task_and_no_others(spark):
    """Every further file costs the executor or the driver a launched process, which counts with all of their memory."""
    found = linedup.written(spark.range(1000).repartition(4), "few")
    path = Path(found._tramline_path.removeprefix("file:"))
    names = sorted(p.name for p in path.iterdir())
    assert len(names) == 4 and all(re.fullmatch(r"part-.*\.parquet", n) for n in names)
    assert found.count() == 1000 and found.agg(F.sum("id")).first()[0] == 499500
    linedup.discard(found)
    assert not path.exists()
