"""Personal data replaced by keyed surrogates of the same type.

Detected: e-mail addresses, IPv4 addresses, phone numbers, card and other long
numbers, social security numbers, IBANs, assigned secrets (token = "..."), and
names after a title or starting with a listed first name, with later mentions of
their surnames in the same text.

Every surrogate is a keyed permutation of the values of its pattern, so that equal
entities get equal surrogates in every document and different ones differ. The
pattern keeps length, punctuation, case, script, digit positions, card check
digits, private address ranges, and the gender of listed first names. Phones are
permuted by their last ten digits and addresses without regard to case, so that
other spellings of an entity follow it. Domains end in the reserved `.example`.

Collision checks: over the distinct entities of the corpus, no surrogate may equal
another entity's surrogate or any entity that occurs. Those that do are drawn again
with the next tweak, round by round; the few tweaks other than 0 reach the
documents by a join on the documents that hold such entities.

Defined results: a null text stays null; an empty text, or one without entities,
stays as it is; overlapping finds go to the earlier, longer one; repeated rows get
equal results; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.shared import free_name, written

KEY = "surrogate-key-1"
MAX_TWEAKS = 20
FEISTEL_ROUNDS = 8

#: First names by gender, as far as they aren't common words. Fixed values.
FEMALE = (
    "Alice Amanda Angela Anna Barbara Brigitte Camille Carmen Carolina Catherine Charlotte Christine Claudia Cristina Deborah "
    "Elena Elizabeth Emily Emma Francesca Gabriela Hannah Heike Helga Ingrid Isabelle Jennifer Jessica Johanna Julia Karen "
    "Katharina Laura Linda Lucia Margaret Maria Marie Martina Mary Michelle Monika Nathalie Olivia Patricia Petra Rosa Sabine "
    "Sandra Sarah Sofia Sophie Stefanie Susan Sylvie Teresa Ursula"
).split()
MALE = (
    "Alejandro Alexander Andreas Andrew Antonio Bernard Brian Carlos Charles Christopher Daniel David Diego Dieter Edward "
    "Fernando Frank Gabriel George Guillaume Hans Heinrich Henry James Jean Jeffrey Johannes John Jorge Joseph Juan Jürgen "
    "Kevin Klaus Laurent Luis Manuel Matthias Michael Miguel Nicolas Olivier Pablo Pascal Paul Pedro Philippe Pierre Rafael "
    "Richard Robert Stefan Steven Thierry Thomas Uwe William Wolfgang"
).split()
CYRILLIC_FEMALE = "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила".split()
CYRILLIC_MALE = "Александр Дмитрий Сергей Андрей Алексей Иван Михаил Николай Владимир Павел".split()
GREEK_FEMALE = "Μαρία Ελένη Αικατερίνη Σοφία Αγγελική".split()
GREEK_MALE = "Γεώργιος Ιωάννης Κωνσταντίνος Δημήτριος Νικόλαος".split()
#: Titles that a name follows, by the gender they tell. Fixed values.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"),
    "u": ("Dr", "Prof"),
}
GROUPS = [FEMALE, MALE, CYRILLIC_FEMALE, CYRILLIC_MALE, GREEK_FEMALE, GREEK_MALE]
_PLACE = {name: (g, k) for g, group in enumerate(GROUPS) for k, name in enumerate(group)}
_FOLDED = {name.lower() for name in _PLACE}

_NAME = r"[^\W\d_]*"
_UPPER = r"[A-ZÀ-ÖØ-ÞĀŁŚŽΑ-ΩА-ЯЁ]"
_WORD = rf"{_UPPER}{_NAME}(?:[-'’]{_UPPER}{_NAME})*"
_TITLE = "|".join(sorted((t for group in TITLES.values() for t in group), key=len, reverse=True))
_FIRST = "|".join(sorted(_PLACE, key=len, reverse=True))
PATTERNS = [
    ("email", re.compile(r"(?<![\w.+-])[\w](?:[\w.+'-]{0,62}[\w+])?@(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.)+[^\W\d_]{2,24}(?![\w-])")),
    ("secret", re.compile(
        r"(?i)\b(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|token|auth|passw(?:or)?d|pwd)\b\s*[:=]{1,2}\s*[\"']?([A-Za-z0-9+/_=.~-]{8,})")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ipv4", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("number", re.compile(r"(?<![\w+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![\w-])")),
    ("phone", re.compile(
        # International, national with a leading 0, and Spanish: groups of two digits and more, judged by their total.
        r"(?<![\w+])\+(?=(?:[ .()-]{0,2}\d){8,15}(?![\w-]))\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,6}){1,6}(?![\w-])"
        r"|(?<![\w+.-])0(?=\d{1,4}([ .-]))(?=(?:\1?\d){8,10}(?![\w-]|\1\d))\d{1,4}\1\d{2,6}(?:\1\d{2,6})*(?![\w-])"
        r"|(?<![\w+.-])(?<!\d[ ])[6-9]\d(?:\d([ .-])\d{3}\2\d{3}|([ .-])\d{3}\3\d{2}\3\d{2}|\d([ .-])\d{2}\4\d{2}\4\d{2})(?![\w-]|[ .-]\d)|"
        r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w-])|(?<![\w+])\+\d{8,15}(?!\w)")),
    ("name", re.compile(rf"\b(?:(?P<title>{_TITLE})\.?\s+(?P<named>{_WORD}(?: {_WORD}){{0,2}})|(?P<first>{_FIRST})(?P<rest>(?: {_WORD}){{1,2}}))\b")),
]

#: Classes of characters that a surrogate keeps: (first, last) code points. Fixed values.
RANGES = [
    ("0", "9"), ("a", "z"), ("A", "Z"), ("α", "ω"), ("Α", "Ρ"), ("а", "я"), ("А", "Я"), ("ء", "غ"), ("א", "ת"), ("अ", "ह"),
    ("ぁ", "ゖ"), ("ァ", "ヺ"), ("一", "鿿"), ("가", "힣"), ("ก", "ฮ"),
]
_ACCENTED = ("àáâãäåæçèéêëìíîïñòóôõöùúûüýÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ")
_SOUNDS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщъьё", "АЕИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬЁ", "αεηιουω", "βγδζθκλμνξπρστφχψς", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ")
_HEX = "0123456789abcdef"


@cache
def _alphabets(spoken: bool) -> dict[str, tuple[str, int]]:
    """character -> (its class, its place there)."""
    classes = [*_SOUNDS, *_ACCENTED] if spoken else [*_ACCENTED]
    classes += ["".join(map(chr, range(ord(a), ord(b) + 1))) for a, b in RANGES]
    out: dict[str, tuple[str, int]] = {}
    for own in classes:
        for k, c in enumerate(own):
            out.setdefault(c, (own, k))
    return out


@lru_cache(65536)
def _permuted(value: int, size: int, tweak: str, key: str) -> int:
    """A keyed permutation of 0..size-1: a balanced Feistel network with cycle walking."""
    if size < 2:
        return value
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for k in range(FEISTEL_ROUNDS):
            mixed = hashlib.blake2b(f"{tweak}|{k}|{right}".encode(), key=key.encode()[:64], digest_size=max(8, (half + 7) // 8)).digest()
            left, right = right, left ^ (int.from_bytes(mixed, "big") & mask)
        value = left << half | right
        if value < size:
            return value


@lru_cache(4096)
def _ring(size: int, tweak: str, key: str) -> dict[int, int]:
    """A keyed permutation of 0..size-1 that is one cycle, so that nothing stays itself."""
    order = [_permuted(k, size, tweak, key) for k in range(size)]
    return {k: order[at - 1] for at, k in enumerate(order)}


def permute_text(text: str, tweak: str, key: str, spoken: bool = False) -> str:
    """A keyed permutation of all texts with the classes of `text`, position by position."""
    alphabets = _alphabets(spoken)
    places = [alphabets.get(c) for c in text]
    value, size, pattern = 0, 1, []
    for c, place in zip(text, places, strict=True):
        own, k = place or ("", 0)
        pattern.append(own[0] if own else c)
        if own:
            value, size = value * len(own) + k, size * len(own)
    value = _permuted(value, size, f"{tweak}|{''.join(pattern)}", key)
    out = list(text)
    for at in range(len(text) - 1, -1, -1):
        if places[at]:
            own = places[at][0]
            value, k = divmod(value, len(own))
            out[at] = own[k]
    return "".join(out)


def _digits_into(shape: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in shape)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _number(digits: str, tweak: str, key: str) -> str:
    """Card numbers keep their first digit and their check digit's truth; others stay no card numbers."""
    if luhn(digits):
        body = digits[0] + permute_text(digits[1:-1], f"{tweak}|card", key)
        return next(body + c for c in "0123456789" if luhn(body + c))
    out = permute_text(digits, f"{tweak}|number", key)
    while luhn(out):
        out = permute_text(out, f"{tweak}|number", key)
    return out


def _range_of(value: int) -> tuple[int, int] | None:
    for first, bits in ((10 << 24, 24), ((172 << 24) + (16 << 16), 20), ((192 << 24) + (168 << 16), 16), (127 << 24, 24)):
        if first <= value < first + (1 << bits):
            return first, 1 << bits
    return None


def _ipv4(text: str, tweak: str, key: str) -> str:
    value = int.from_bytes(bytes(map(int, text.split("."))), "big")
    own = _range_of(value)
    if own:
        out = own[0] + _permuted(value - own[0], own[1], f"{tweak}|{own[0]}", key)
    else:
        out = _permuted(value, 1 << 32, tweak, key)
        while _range_of(out):
            out = _permuted(out, 1 << 32, tweak, key)
    return ".".join(map(str, out.to_bytes(4, "big")))


def _iban(compact: str, tweak: str, key: str) -> str:
    body = permute_text(compact[4:], tweak, key)
    rest = int("".join(str(int(c, 36)) for c in body + compact[:2] + "00")) % 97
    return f"{compact[:2]}{98 - rest:02d}{body}"


def _name_word(word: str, tweak: str, key: str) -> str:
    if word in _PLACE:
        g, k = _PLACE[word]
        return GROUPS[g][_ring(len(GROUPS[g]), f"{tweak}|first|{g}", key)[k]]
    if len(word) == 1 and (place := _alphabets(True).get(word)):
        return place[0][_ring(len(place[0]), f"{tweak}|initial|{place[0]}", key)[place[1]]]
    out = permute_text(word, f"{tweak}|name", key, spoken=True)
    while out.lower() in _FOLDED:
        out = permute_text(out, f"{tweak}|name", key, spoken=True)
    return out


def normal(kind: str, text: str) -> str:
    """The spelling that all mentions of an entity share."""
    if kind == "email":
        return text.lower()
    if kind == "iban":
        return text.replace(" ", "")
    if kind in ("number", "ssn"):
        return re.sub(r"\D", "", text)
    if kind == "phone":
        return re.sub(r"\D", "", text)[-10:]
    if kind == "secret" and _is_hex(text):
        return text.lower()
    return text


def _is_hex(text: str) -> bool:
    return len(text) >= 16 and not set(text.lower()) - set(_HEX) and text in (text.lower(), text.upper())


def surrogate(kind: str, own: str, tweak: int = 0, key: str = KEY) -> str:
    """The surrogate of a normal spelling, itself a normal spelling."""
    t = f"{kind}|{tweak}"
    if kind == "email":
        local, _, domain = own.rpartition("@")
        return f"{permute_text(local, t, key)}@{permute_text(domain, t + '|domain', key)}.example"
    if kind == "ipv4":
        return _ipv4(own, t, key)
    if kind == "number":
        return _number(own, t, key)
    if kind == "iban":
        return _iban(own, t, key)
    if kind == "name":
        return _name_word(own, t, key)
    if kind == "secret" and _is_hex(own):
        return f"{_permuted(int(own, 16), 16 ** len(own), f'{t}|{len(own)}', key):0{len(own)}x}"
    return permute_text(own, t, key)


def spelled(kind: str, mention: str, replacement: str) -> str:
    """A surrogate in the spelling of a mention."""
    if kind in ("number", "ssn"):
        return _digits_into(mention, replacement)
    if kind == "phone":
        digits = re.sub(r"\D", "", mention)
        return _digits_into(mention, digits[: len(digits) - len(replacement)] + replacement)
    if kind == "iban":
        left = iter(replacement)
        return "".join(c if c == " " else next(left) for c in mention)
    if kind == "secret" and _is_hex(mention):
        return replacement.upper() if mention == mention.upper() else replacement
    if kind == "email":
        out = [r.upper() if m.isupper() and len(r.upper()) == 1 else r for m, r in zip(mention, replacement, strict=False)]
        return "".join(out) + replacement[len(out) :]
    return replacement


_WORDS = re.compile(r"[^\W\d_]+")
_CAPITAL = re.compile(rf"{_UPPER}{_NAME}")
_NAMED = {*_PLACE, *(t for group in TITLES.values() for t in group)}
_TEN = re.compile(r"(?<!\w)\d{10}(?!\w)")


def find(text: str) -> list[tuple[int, int, str]]:
    """Entities as (start, end, type), in order, none overlapping. Names are one entity per word."""
    found: list[tuple[int, int, str]] = []
    surnames: set[str] = set()
    phones: set[str] = set()
    may = {  # cheap tests that spare most texts most patterns
        "email": "@" in text, "secret": "=" in text or ":" in text, "name": not _NAMED.isdisjoint(_CAPITAL.findall(text)),
    }
    digits = any(c in text for c in "0123456789")
    for kind, pattern in PATTERNS:
        if not may.get(kind, digits):
            continue
        for m in pattern.finditer(text):
            if kind == "secret":
                found.append((*m.span(1), kind))
            elif kind == "name":
                begin, end = m.span("named") if m["title"] else (m.start("first"), m.end())
                words = [(w.start() + begin, w.end() + begin, w[0]) for w in _WORDS.finditer(text[begin:end])]
                found += [(a, b, kind) for a, b, _ in words]
                surnames.update(w for _, _, w in words[-1:] if len(w) > 2)
            else:
                found.append((*m.span(), kind))
                if kind == "phone":
                    phones.add(normal(kind, m[0]))
    if phones:
        found += [(*m.span(), "phone") for m in _TEN.finditer(text) if m[0] in phones]
    if surnames:
        found += [(w.start(), w.end(), "name") for w in _WORDS.finditer(text) if w[0] in surnames]
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def replace(text: str, tweaks: dict[tuple[str, str], int] | None = None, key: str = KEY) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and the entities of the original."""
    found, parts, at = find(text), [], 0
    for begin, end, kind in found:
        own = normal(kind, text[begin:end])
        new = surrogate(kind, own, (tweaks or {}).get((kind, own), 0), key)
        parts += [text[at:begin], spelled(kind, text[begin:end], new)]
        at = end
    return "".join([*parts, text[at:]]), found


def _entities(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, h, text in zip(*(batch[c].to_pylist() for c in ("d", "h", "text")), strict=True):
                if text:
                    own = {(kind, normal(kind, text[a:b])) for a, b, kind in find(text)}
                    rows += [(d, h, kind, x, surrogate(kind, x, 0, key)) for kind, x in sorted(own)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["d", "h", "kind", "own", "new"]
            )

    return run


def _redraw(tweak: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(k, x, tweak, key) for k, x in zip(batch["kind"].to_pylist(), batch["own"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["kind"], batch["own"], pa.array(new, pa.string())], ["kind", "own", "new"])

    return run


def collisions(entities: DataFrame, key: str = KEY) -> DataFrame | None:
    """kind, own, tweak of the entities whose first surrogate can't stand; None if there are none.

    entities: kind, own, new. Listed first names and initials stand for many people
    and may be another's, but never stay themselves. All other names are checked.
    """
    table = entities.select("kind", "own", "new").distinct()
    free = (F.col("kind") != "name") | ((F.length("own") > 1) & ~F.col("own").isin(*_PLACE))
    originals = table.where(free).select(F.col("kind").alias("k2"), F.col("own").alias("o2"))

    def clashing(now: DataFrame, settled: DataFrame | None) -> DataFrame:
        real = now.join(originals, (F.col("kind") == F.col("k2")) & (F.col("new") == F.col("o2")), "left_semi")
        twice = now.where(free).groupBy("kind", "new").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        again = now.join(twice, ["kind", "new"]).where("own <> first").select("kind", "own")
        bad = real.select("kind", "own").union(again)
        if settled is not None:
            bad = bad.union(now.where(free).join(settled.select("kind", "new"), ["kind", "new"], "left_semi").select("kind", "own"))
        return bad.distinct()

    bad = written(clashing(table, None), "collisions")
    if bad.isEmpty():
        return None
    settled = table.join(bad, ["kind", "own"], "left_anti").withColumn("tweak", F.lit(0))
    done = None
    for tweak in range(1, MAX_TWEAKS + 1):
        now = written(bad.select("kind", "own").mapInArrow(_redraw(tweak, key), "kind string, own string, new string"), "redrawn")
        bad = written(clashing(now, settled), "collisions")
        good = now.join(bad, ["kind", "own"], "left_anti").withColumn("tweak", F.lit(tweak))
        settled = settled.unionByName(good)
        done = good if done is None else done.unionByName(good)
        if bad.isEmpty():
            return written(done.select("kind", "own", "tweak"), "tweaks")
    raise RuntimeError(f"collisions are left after {MAX_TWEAKS} draws")


_ENTITY = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string())])


def _rewrite(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch["_tweaks"].to_pylist()
            texts, entities = [], []
            for text, own in zip(batch["_text"].to_pylist(), held, strict=True):
                tweaks = {(x["kind"], x["own"]): x["tweak"] for x in own or ()}
                new, found = (text, []) if text is None else replace(text, tweaks, key)
                texts.append(new)
                entities.append([{"start": a, "end": b, "type": kind} for a, b, kind in found])
            keep = [k for k, n in enumerate(batch.schema.names) if n not in ("_text", "_tweaks")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(texts, pa.string()), pa.array(entities, pa.list_(_ENTITY))],
                [*(batch.schema.names[k] for k in keep), "_new", "_entities"],
            )

    return run


def pseudonymise(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, the text with surrogates, then entities (array of start, end, type in the original)."""
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))
    entities = written(
        slim.where("text is not null").mapInArrow(_entities(key), "d long, h long, kind string, own string, new string"), "entities"
    )
    tweaks = collisions(entities, key)
    names = {c: f"c{k}" for k, c in enumerate(docs.columns) if c != text_col}
    rows = docs.select(*(F.col(c).alias(n) for c, n in names.items()), text.alias("_text"))
    if tweaks is None:
        rows = rows.withColumn("_tweaks", F.lit(None).cast("array<struct<kind:string,own:string,tweak:int>>"))
    else:
        own = entities.join(tweaks, ["kind", "own"]).groupBy("d", "h").agg(F.collect_set(F.struct("kind", "own", "tweak")).alias("_tweaks"))
        same = F.col(names[id_col]).cast("long").eqNullSafe(F.col("d")) & (F.xxhash64("_text") == F.col("h"))
        rows = rows.join(own, same, "left").drop("d", "h")
    fields = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names.values())
    out = rows.mapInArrow(_rewrite(key), f"{fields}, _new string, _entities array<struct<start:long,end:long,type:string>>")
    entity = free_name(docs.columns, "entities")
    columns = [F.col("_new").alias(c) if c == text_col else F.col(names[c]).alias(c) for c in docs.columns]
    return out.select(*columns, F.col("_entities").alias(entity))
