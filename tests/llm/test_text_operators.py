"""Chat windows, decontamination, language, quality, pages and personal data."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tramline.llm import chat, decontam, html, langid, pii, quality

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, `N_Words` int, kept string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)


# chat


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")


def test_chat_round_trip_and_masks(spark):
    nasty = "a  b <|im_end|>\n<|im_start|>user\nx </s> 1 [/INST]"
    rows = [(1, 0, "system", "Be brief.", 0), (1, 1, "user", nasty, 0), (1, 2, "assistant", "ok " * 50, 0)]
    rows += [(1, k, "user" if k % 2 else "assistant", f"text {k} " * 40, 0) for k in range(3, 9)]
    rows += [(2, None, None, None, 0), (2, 0, "assistant", nasty, 0), (2, 0, "assistant", nasty, 0), (None, 0, "system", "", 0)]
    budget = chat.Budget(window=200, history=60)
    made = chat.windows(turns(spark, rows), budget)
    found = made.select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("targets")
    ).collect()
    for conv in (1, 2, None):
        want = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        own = sorted((w for w in found if w["conv_id"] == conv), key=lambda w: w["window"])
        told = [(t["role"], t["text"]) for w in own for t in w["turns"][w["n_repeated"] :]]
        assert told == [(r[2] or "", r[3] or "") for r in want]
        assert [t for w in own for t in w["targets"]] == [r[3] or "" for r in want if r[2] == "assistant"]
    first = sorted((w for w in found if w["conv_id"] == 1), key=lambda w: w["window"])
    assert len(first) > 2 and all(w["turns"][0]["role"] == "system" for w in first)
    assert all(w["tokens"] <= budget.window or w["over_budget"] for w in first)
    assert any(w["n_repeated"] > 1 for w in first)


def test_chat_huge_turn_and_empty_table(spark):
    rows = [(1, 0, "user", "word " * 3000, 0), (1, 1, "assistant", "fine", 0)]
    found = {w["window"]: w for w in chat.windows(turns(spark, rows)).collect()}
    assert found[0]["over_budget"] and found[0]["formatted"].count("word") == 3000
    assert chat.windows(turns(spark, [])).count() == 0


# decontamination


def brute_hits(text, items, window=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x7f" else c for c in text or ""))
    hit, own = set(), set()
    for item, body in items:
        parts = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x7f" else c for c in body or ""))
        n = min(window, len(parts))
        held = {tuple(parts[k : k + n]) for k in range(len(parts) - n + 1)} if n else set()
        for k in range(len(words) - n + 1) if n else ():
            if tuple(words[k : k + n]) in held:
                own.add(str(item))
                hit.update(range(k, k + n))
    return len(words), len(hit), sorted(own)


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 900])
def test_decontamination_against_brute_force(spark, block_bytes):
    rng = random.Random(5)
    vocabulary = ["Été", "über", "one", "two", "Three", "x9", "日本"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([20, 13, 14, 3, 1, 40])]
    items += [(6, None), (7, "..."), (8, items[0][1])]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for k in range(40)]
    rows += [(100, "x, " + items[0][1].replace(" ", "--") + "!"), (101, None), (102, ""), (103, "?!"), (100, items[5][1])]
    rows += [(None, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.decontaminate(docs_of(spark, rows), bench, block_bytes=block_bytes).collect()
    want = sorted(((r[0] or -1, *brute_hits(r[1], items)) for r in rows), key=str)
    assert sorted(((r["doc_id"] or -1, r["n_words"], r["n_hit"], r["item_ids"]) for r in found), key=str) == want
    assert any(r["spans"] and (r["spans"][0]["start"], r["spans"][0]["end"]) == (3, len(rows[40][1]) - 1) for r in found)


def test_decontamination_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs_of(spark, [(1, "a b")]), none).first()["n_hit"] == 0
    assert decontam.decontaminate(docs_of(spark, []), none).count() == 0


# language


def test_language_held_out_accuracy(spark):
    from tramline.llm.queries import op3_language_id

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op3_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95


def test_language_against_brute_force_and_edges(spark):
    texts = [("en", "the cat and the dog"), ("de", "der Hund und die Katze"), ("en", "a cat"), (None, "nothing"), ("fr", None)]
    model = langid.fit(spark.createDataFrame(texts, "lang string, text string"), size=30)
    assert model.langs == ["de", "en"]

    def grams(text):
        s = " " + re.sub(r"[^\w]+", " ", text.lower()).strip() + " "
        out = {}
        for n in (1, 2, 3):
            for k in range(len(s) - n + 1):
                if n > 1 or s[k] != " ":
                    out[s[k : k + n]] = out.get(s[k : k + n], 0) + 1
        return out

    def packed(g):
        v = 0
        for c in g:
            v = v << 21 | ord(c)
        return v

    def ranking(counts):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], packed(x[0])))][:30]

    profiles = {}
    for lang in ("de", "en"):
        total = {}
        for own, text in texts:
            if own == lang:
                for g, n in grams(text).items():
                    total[g] = total.get(g, 0) + n
        profiles[lang] = ranking(total)
    for text in ("the dog", "die Katze und das", "xyz q", "Hund"):
        own = ranking(grams(text))
        distance = {
            lang: sum(abs(p.index(g) - k) if g in p else 30 for k, g in enumerate(own)) for lang, p in profiles.items()
        }
        best = min(sorted(distance), key=distance.get)
        assert model.predict(text) == (best, pytest.approx(1 - distance[best] / (30 * len(own))))
    for text in (None, "", "123 !?", "́"):
        assert model.predict(text) == ("und", 0.0)
    found = langid.predict(docs_of(spark, [(1, None), (1, "the cat"), (None, "the cat"), (2, "der " * 50000)]), model)
    assert sorted(r["lang_pred"] for r in found.collect()) == ["de", "en", "en", "und"]
    assert langid.fit(spark.createDataFrame([], "lang string, text string")).predict("word") == ("und", 0.0)


# quality


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    repeated = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n")]
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:k] for k, x in enumerate(lines))
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or "") if words else 0, dup, len(repeated)]


def test_quality_statistics_against_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a b c a b c", "é # ü\n\né # ü\n", "x y   z"]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "## ", "日 ", "d"]) for _ in range(rng.randint(1, 80))) for _ in range(200)]
    for text in texts:
        assert quality.statistics_of(None if text is None else text.encode())[0] == brute_statistics(text), text


def test_quality_against_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality(docs, labels).join(labels, "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.3


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 0), (2, None)], "doc_id long, quality int")
    rows = [(1, "word " * 60), (1, None), (None, "other word here " * 60), (3, ""), (4, "x" * 100000)]
    found = quality.quality(docs_of(spark, rows), labels).collect()
    assert len(found) == 5 and all(r["threshold"] == quality.DEFAULT_THRESHOLD for r in found)
    assert all(r["base_failed"] and not r["kept"] for r in found)
    assert quality.quality(docs_of(spark, []), labels).count() == 0


def test_quality_passing_rows_are_the_kept_ones(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    own = docs.select("doc_id", "text").union(docs_of(spark, [(1, None), (1, ""), (None, "word " * 60), (1, "one two " * 9)]).select("doc_id", "text"))
    own = own.withColumn("kept", F.lit("mine")).withColumn("score", F.lit("too"))
    kept = sorted(((r["doc_id"] or -1) for r in quality.quality(own, labels).where("kept").collect()))
    found = quality.passing(own, labels)
    assert found.columns == own.columns and found.where("kept <> 'mine' or score <> 'too'").count() == 0
    assert sorted(((r["doc_id"] or -1) for r in found.collect())) == kept and 0 < len(kept) < own.count()
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert quality.passing(docs_of(spark, []), labels).count() == 0


# pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain", ""),
        ("<body><nav><ul><li>Menu</li></ul></nav><article><h1>T&amp;T</h1><p>One<br>two <b>three\n four<p>Five</article><footer>f</footer>", "T&T\nOne two three four\nFive"),
        ("<article><script>if (a</p>b) x()</script><p>a<aside>side</aside><div class='comment'>no</div><p>b&nbsp; c</p></article>", "a\nb c"),
        ("<nav><a href=x>unclosed<article><p>kept</p></article>", "kept"),
        (f"<div class='cookie-notice'>{'we use them ' * 20}</div><div><p>{'long text ' * 20}</p><p>short</p></div>", f"{'long text ' * 20}".strip() + "\nshort"),
        ("<main><form>f</form><p>x</p></main><div id='comments'><p>reader</p></div>", "x"),
        ("<article><p title='a > b'>q &lt;i&gt;</p><p", "q <i>"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page)[0] == text


def test_surge_and_dive_decide_inside_articles_too():
    body = "Here is a paragraph of an article that says a few things about the weather."
    links = "".join(f"<li><a href='/{k}'>Another story number {k}</a></li>" for k in range(5))
    page = f"<article><h1>Title</h1><p>{body}</p><p>{body}</p><ul>{links}</ul></article>"
    assert html.main_text(page)[0] == f"Title\n{body}\n{body}"
    every = [x[0] for x in html.lines_of(page) if x[0]]
    assert len(every) == 8 and html.main_text(page)[1] == [(0, 3)]
    # An advert in the middle doesn't end the article; short pages and short articles stay whole.
    ad = "<div class='advert'>Buy<p>now</p><p>and</p><p>cheap</p></div>"
    assert html.main_text(f"<article><p>{body}</p>{ad}<p>End.</p></article>")[0] == f"{body}\nEnd."
    assert html.main_text("<h1>Head</h1><p>A short paragraph of forty-two letters ok</p>")[0] == "Head\nA short paragraph of forty-two letters ok"
    assert html.main_text("<article><p>No.</p></article>")[0] == "No."
    assert html.main_text("<div><a href='/'>Home</a></div><div><a href='/b'>News</a></div>")[0] == ""


def test_main_text_outside_small_articles_and_inside_layout_wrappers():
    body = " ".join(["A sentence of the real text."] * 12)
    for mark in ("", " class='card'", " class='post teaser'"):
        page = f"<div><p>{body}</p><p>{body}</p></div><nav>m</nav><article{mark}><p>Read this next.</p></article>"
        assert html.main_text(page)[0].startswith(f"{body}\n{body}")
    for wrapper in ("no-sidebar", "has-sidebar", "search-results", "sidebar-layout"):
        assert html.main_text(f"<div class='{wrapper}'><p>{body}</p></div>")[0] == body
    gap = "<nav>a</nav>" * 4
    assert html.main_text(f"<div><p>{body}</p></div>{gap}<p>The end of it all came soon.</p>")[0] == f"{body}\nThe end of it all came soon."
    assert html.main_text("<p>A short page has one sentence.</p>")[0] == "A short page has one sentence."
    assert html.main_text(f"<article><p>{body}</p></article><div><p>Other words of the page stand here, in no article.</p></div>")[0] == body


def test_pages_match_their_articles(spark):
    from tramline.llm.queries import op7_main_text

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    import html as references

    for r in op7_main_text(spark, SF).collect():
        body = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(references.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
    empty = spark.createDataFrame([(None, None, None), (1, "u", None), (1, "u", None)], "page_id long, url string, html string")
    assert [r["text"] for r in html.extract(empty).collect()] == ["", "", ""]


# personal data


def test_surrogates_keep_type_and_distinctness():
    rng = random.Random(9)
    numbers = {"".join(rng.choice("0123456789") for _ in range(16)) for _ in range(3000)}
    made = {pii.surrogate("number", n) for n in numbers}
    assert len(made) == len(numbers) and all(pii.luhn(n) == pii.luhn(pii.surrogate("number", n)) for n in numbers)
    small = {pii.surrogate("ssn", f"{k:09d}") for k in range(2000)}
    assert len(small) == 2000
    assert len({pii.permute_text(f"{a}{b}", "t", "k") for a in "0123456789" for b in "0123456789"}) == 100
    ips = {f"10.0.{a}.{b}" for a in range(20) for b in range(50)}
    private = {pii.surrogate("ipv4", x) for x in ips}
    assert len(private) == 1000 and all(x.startswith("10.") for x in private)
    assert pii.surrogate("name", "Anna") in pii.FEMALE and pii.surrogate("name", "Иван") in pii.CYRILLIC_MALE
    names = {"".join(rng.choice("abcdefg") for _ in range(5)).capitalize() for _ in range(500)}
    assert len({pii.surrogate("name", n) for n in names}) == len(names)


def test_coreference_and_spelling():
    text = "Mr. John Smith, +1 (377) 555-0271 or 377-555-0271, 3775550271. Smith wrote to A.B@Mail.com, a.b@mail.com from 10.1.2.3."
    new, found = pii.replace(text)
    assert [k for _, _, k in found] == ["name", "name", "phone", "phone", "phone", "name", "email", "email", "ipv4"]
    for a, b, _ in found:
        assert text[a:b] not in new
    words = re.findall(r"[^\W\d_]+", new)
    assert words.count(words[2]) == 2 and words[1] in pii.MALE
    digits = {re.sub(r"\D", "", x)[-10:] for x in re.findall(r"[+(\d][\d ()-]{8,}\d", new)}
    assert len(digits) == 1
    assert len({x.lower() for x in re.findall(r"\S+@\S+example", new)}) == 1
    assert pii.replace("Clean text with 9.9. and 4.0 in it: fine.")[0] == "Clean text with 9.9. and 4.0 in it: fine."


def test_collisions_are_redrawn(spark):
    victim = pii.surrogate("ssn", "111223333")
    text = f"111-22-3333 and {victim[:3]}-{victim[3:5]}-{victim[5:]}"
    docs = spark.createDataFrame([(1, text, 7, None), (2, None, 7, None), (None, "", 7, None)], "doc_id long, text string, entities int, d string")
    rows = {r["doc_id"]: r for r in pii.pseudonymise(docs).collect()}
    made = re.findall(r"\d{3}-\d{2}-\d{4}", rows[1]["text"])
    originals = set(re.findall(r"\d{3}-\d{2}-\d{4}", text))
    assert len(set(made)) == 2 and not set(made) & originals
    assert rows[2]["text"] is None and rows[None]["text"] == "" and rows[1]["entities"] == 7
    assert pii.pseudonymise(docs.limit(0)).count() == 0


def test_names_change_and_dont_become_other_names(spark):
    for name in pii._PLACE:
        assert pii.surrogate("name", name) != name
    for group in pii.GROUPS:
        assert {pii.surrogate("name", n) for n in group} == set(group)
    assert all(pii.surrogate("name", c) != c for c in "ABCDXYZ")
    other = pii.surrogate("name", "Harrison")
    docs = spark.createDataFrame([(1, f"Mr Harrison met Mrs {other} there.")], "doc_id long, text string")
    new = pii.pseudonymise(docs).first()["text"]
    assert "Harrison" not in new and other not in new


@pytest.mark.parametrize("phone", ["01 23 45 67 89", "+33 6 12 34 56 78", "91 123 45 67", "07700 900123", "912 345 678", "06.12.34.56.78", "+44 7700 900123"])
def test_phones_of_other_shapes(phone):
    new, found = pii.replace(f"Call {phone} today.")
    assert found == [(5, 5 + len(phone), "phone")] and phone not in new and len(new) == len(phone) + 12
    for clean in ("On 09.12.2023 10 of 12 came.", "Rows 10 20 30 40 50 60"):
        assert pii.find(clean) == []


def test_no_original_is_left(spark):
    from tramline.llm.queries import op8_pii_surrogates

    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    hit = 0
    for r in op8_pii_surrogates(spark, SF).where("n_entities > 0").collect():
        for e in r["entities"]:
            hit += 1
            assert before[r["doc_id"]][e["start"] : e["end"]] not in r["text"]
    assert hit > 20


def test_digests_of_chat_query(spark):
    from tramline.llm.queries import op1_chat_formatting

    row = op1_chat_formatting(spark, SF).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and row["loss_chars"] == len(text)


def test_surrogates_of_a_whole_table_are_consistent_distinct_and_complete(spark):
    """Every text against its original: only entities change, each always into the same, different ones into different ones."""
    from tramline.llm.queries import op8_pii_surrogates

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    mapped, n = {}, 0
    for r in op8_pii_surrogates(spark, folder).collect():
        old, new = texts[r["doc_id"]], r["text"]
        if old is None:
            assert new is None and not r["n_entities"]
            continue
        at, parts, own = 0, [], []
        for e in r["entities"]:
            assert at <= e["start"] < e["end"] <= len(old)
            parts.append(re.escape(old[at : e["start"]]))
            own.append((e["type"], old[e["start"] : e["end"]]))
            at = e["end"]
        parts.append(re.escape(old[at:]))
        match = re.fullmatch("(.+?)".join(parts), new, re.S)
        assert match and len(own) == r["n_entities"]
        for (kind, was), now in zip(own, match.groups(), strict=True):
            n += 1
            assert was != now or kind == "name"
            if kind in ("email", "ssn", "iban", "ipv4", "number", "card"):
                assert mapped.setdefault((kind, was), now) == now
        for address in re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[a-z]{2,}", old):
            assert address not in new
    assert n > 20 and len({(k[0], v) for k, v in mapped.items()}) == len(mapped) > 5
