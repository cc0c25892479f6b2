"""Personal data replaced by surrogates of the same kind.

Each entity found gets a keyed surrogate: the same entity always the same one, so that references stay together, and two
entities never the same one. Surrogates keep kind, format and script, and names their gender. Numbers and addresses are put
through a keyed permutation of their format's values, so no two can become the same; given names are dealt in a ring.
Surnames, e-mail addresses and IBANs draw from the key; the entities of the whole corpus are checked for collisions as a
table, and who loses tries again, with more room the more often, until none is left.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Given names by gender and script, and the titles that go before a surname.
GIVEN = {
    ("f", "latin"): "Alice Amelia Anna Barbara Carla Carmen Charlotte Claire Clara Elena Elizabeth Emily Emma Eva Hannah Helen Isabel Jane Julia Karen Laura Linda Lucia Margaret Maria Marie Martha Mary Monica Nora Olivia Patricia Petra Rosa Sarah Sofia Sophie Susan Ursula Victoria".split(),
    ("m", "latin"): "Albert Alexander Andrew Antonio Carlos Charles Daniel David Diego Edward Emil Felix Francis George Hans Henry Hugo Jack James John Jorge Joseph Julian Karl Louis Luis Manuel Martin Michael Miguel Oliver Oscar Otto Paul Peter Pierre Richard Robert Stefan Thomas Victor Walter William".split(),
    ("f", "cyrillic"): "Анна Вера Елена Ирина Мария Наталья Ольга Светлана Софья Татьяна".split(),
    ("m", "cyrillic"): "Алексей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
    ("f", "greek"): "Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("m", "greek"): "Γιώργος Γιάννης Δημήτρης Κώστας Νίκος".split(),
}
TITLES = "Mr Mrs Ms Miss Herr Frau Monsieur Madame Señor Señora Sr Sra".split()
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αεηιου"}
CONSONANTS = {"latin": "bdfgklmnprstv", "cyrillic": "бвгдклмнпрст", "greek": "βγδκλμνπρστ"}

_OF_GIVEN = {n: gs for gs, names in GIVEN.items() for n in names}

# a word of a name: inner capitals, apostrophes and hyphenated parts; a genitive 's is no part of it
_INNER = r"[\p{L}\p{M}]|['’](?!s(?!\w))(?=\p{L})"
_NAME = rf"\p{{Lu}}(?:{_INNER}|-(?=\p{{L}}))+"
PATTERNS: list[tuple[str, str]] = [
    ("email", r"(?<![\w.+-])[\w.+-]*\w@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?\.)+\p{L}{2,}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"),
    ("card", r"(?<![\w-])(?:\d{4}[ -]?){3}\d{1,7}(?!\w|-\d)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,12}(?!\d)|(?<![\w+])(?:\(\d{3}\)[ ]?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)"),
    ("name", rf"(?<!\w)(?:{'|'.join(sorted(_OF_GIVEN, key=len, reverse=True))})(?:-\p{{Lu}}\p{{L}}+)*(?:[ ]{_NAME}){{1,2}}(?!\w)|(?<!\w)(?:{'|'.join(TITLES)})\.?[ ]{_NAME}(?:[ ]{_NAME})?(?!\w)"),
]
# What goes before a full name, or after it, whatever the names are.
BEFORE = "my name is,i am called,name:,signed by,signed:,sincerely,regards,yours truly,dear,attn:,attention:,contact:,contact person:,dr.,prof.,mein name ist,ich heiße,name ist,gez.,mit freundlichen grüßen,je m'appelle,mon nom est,nom :,nom:,cordialement,me llamo,mi nombre es,nombre:,atentamente,меня зовут,имя:,с уважением,με λένε,όνομα:".split(",")
AFTER = "wrote said asked replied answered told called emailed phoned lives works schrieb sagte wohnt écrit habite escribió dijo vive написал написала сказал сказала живёт".split()
# Words that begin sentences, not names.
OPENERS = set("The A An This That These Those His Her Its Their Our My Your No Some Any And But For By To Der Die Das Ein Eine Dieser Diese Dieses Sein Seine Ihr Ihre Mein Meine Und Aber Le La Les Un Une Ce Cette Son Sa Et Mais El Los Las Una Este Esta Su Mi Pero".split())
# Country codes of one and two digits; all others have three.
CODES = {"1", "7"} | set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_FULL = rf"{_NAME}(?:[ ]{_NAME}){{1,2}}(?!\w)"
_WORDS = re.compile(r"[^\W\d_]+").findall
_CUES = [frozenset(_WORDS(x)) for x in (*BEFORE, *AFTER)]
_CUED = regex.compile(rf"(?<!\w)(?i:{'|'.join(regex.escape(x) for x in BEFORE)})[,:]?\s+\K{_FULL}|(?<![\w'’-])\p{{Lu}}\p{{L}}{{2,}} \p{{Lu}}\p{{L}}{{2,}}(?= (?:{'|'.join(AFTER)})(?!\w))")
_FIND = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
_LONE = regex.compile(rf"(?<!\w)\p{{Lu}}(?:{_INNER})*(?!\w)")


def _by_letter(words: list[str]) -> str:
    """An alternation that tries only the words with the first letter at hand."""
    heads: dict[str, list[str]] = {}
    for w in sorted(words, key=len, reverse=True):
        heads.setdefault(w[0], []).append(re.escape(w[1:]))
    return "|".join(f"{h}(?:{'|'.join(t)})" for h, t in sorted(heads.items()))


# what the patterns need to match at all: texts with none of it are passed over at once
_HINTS = (re.compile(r"\d[\d .()-]{5,}\d").search, re.compile(f"(?:{_by_letter([*_OF_GIVEN, *TITLES])})[. ]").search)


def script_of(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin"


def parts(kind: str, found: str) -> list[tuple[str, str, int, int]]:
    """(type, canonical form, start, end) of the entities in a match. The parts of a name, hyphenated ones too, are
    entities of their own."""
    if kind == "email":
        return [("email", found.lower(), 0, len(found))]
    if kind == "iban":
        return [("iban", found.replace(" ", ""), 0, len(found))]
    if kind == "ip":
        return [("ip", ".".join(str(int(x)) for x in found.split(".")), 0, len(found))]
    if kind in ("card", "ssn", "phone"):
        return [(kind, "+" * found.startswith("+") + "".join(str(int(c)) for c in found if c.isdecimal()), 0, len(found))]
    out, at = [], 0
    for word in found.split(" "):
        title = word.rstrip(".") in TITLES
        for part in word.split("-"):
            if part in _OF_GIVEN:
                out.append(("given", part, at, at + len(part)))
            elif not title:
                out.append(("surname", part.lower(), at, at + len(part)))
            at += len(part) + 1
    return out


def entities(text: str | None) -> list[tuple[str, str, int, int]]:
    """(type, canonical form, start, end) of all entities of the whole text, in order; code points, end exclusive.

    Full names are found by a known given name or title, or by the words before or after them. Given names and surnames
    found in full names count wherever they stand alone in the text as well, before or after.
    """
    words = set(_WORDS(text.lower())) if text else set()
    cued = any(cue <= words for cue in _CUES)
    hinted = bool(text) and ("@" in text or any(hint(text) for hint in _HINTS))
    if not (cued or hinted):
        return []
    found = [(k, c, m.start() + s, m.start() + e) for m in _FIND.finditer(text) for k, c, s, e in parts(m.lastgroup, m.group())] if hinted else []
    if cued:
        more, at = [], 0
        for m in _CUED.finditer(text):
            words = m.group().split(" ")
            while at < len(found) and found[at][3] <= m.start():
                at += 1
            if len(set(words)) == len(words) and words[0] not in OPENERS and (at == len(found) or found[at][2] >= m.end()):
                more += [(k, c, m.start() + s, m.start() + e) for k, c, s, e in parts("name", m.group())]
        found = sorted(found + more, key=lambda x: x[2]) if more else found
    names = {(k, c) for k, c, _, _ in found if k in ("given", "surname")}
    if not names:
        return found
    lone, at = [], 0
    for m in _LONE.finditer(text):
        while at < len(found) and found[at][3] <= m.start():
            at += 1
        if at == len(found) or found[at][2] >= m.end():
            entity = next((x for x in (("given", m.group()), ("surname", m.group().lower())) if x in names), None)
            if entity:
                lone.append((*entity, m.start(), m.end()))
    return sorted(found + lone, key=lambda x: x[2]) if lone else found


def _draw(key: bytes, kind: str, canonical: str, attempt: int) -> Callable[[int], int]:
    """A keyed stream: each call gives a number below n."""
    pool, at = b"", 0
    seed = f"{kind}\0{canonical}\0{attempt}".encode("utf-8", "surrogatepass")

    def below(n: int) -> int:
        nonlocal pool, at
        if at * 8 + 8 > len(pool):
            pool += hmac.new(key, seed + len(pool).to_bytes(4, "big"), hashlib.sha256).digest()
        at += 1
        return int.from_bytes(pool[at * 8 - 8 : at * 8], "big") % n

    return below


def permute(key: bytes, tweak: str, x: int, a: int, b: int, back: bool = False) -> int:
    """A keyed permutation of 0 to a * b - 1, another for each tweak, or its inverse: an alternating Feistel network."""
    left, right = divmod(x, b)
    for r in reversed(range(8)) if back else range(8):
        half, n = (right, a) if r % 2 == 0 else (left, b)
        step = int.from_bytes(hmac.new(key, f"{tweak}\0{r}\0{half}".encode(), hashlib.sha256).digest()[:16], "big") % n * (-1 if back else 1)
        left, right = ((left + step) % a, right) if r % 2 == 0 else (left, (right + step) % b)
    return left * b + right


def moved(key: bytes, tweak: str, x: int, a: int, b: int) -> int:
    """A keyed permutation that leaves no number in its place: one step along a cycle through all of them."""
    return permute(key, tweak, (permute(key, tweak, x, a, b) + 1) % (a * b), a, b, back=True)


def _digits(key: bytes, tweak: str, digits: str) -> str:
    n = len(digits)
    return f"{moved(key, f'{tweak}/{n}', int(digits), 10 ** (n // 2), 10 ** (n - n // 2)):0{n}d}" if n else ""


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10: 0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def luhn_digit(body: str) -> int:
    return (10 - luhn(body + "0")) % 10


def _private(octets: list[int]) -> int:
    """How many octets of a private or local address say so; 0 for a public one."""
    return 1 if octets[0] in (10, 127) else 2 if octets[:2] == [192, 168] else 0


def _like(c: str, below: Callable[[int], int]) -> str:
    """A random character of the kind of c: digit, letter of its script and case, or c itself."""
    if c.isdecimal():
        return str(below(10))
    if c.isalpha():
        s = script_of(c)
        out = (VOWELS[s] + CONSONANTS[s])[below(len(VOWELS[s] + CONSONANTS[s]))]
        return out.upper() if c.isupper() else out
    return c


def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0) -> str:
    """The surrogate of an entity, in canonical form. Another attempt gives another one, but for numbers and addresses, where
    no two entities have the same."""
    below = _draw(key, kind, canonical, attempt)
    if kind == "email":
        local, _, host = canonical.rpartition("@")
        *labels, top = host.split(".")
        new = [x if x == "example" else "".join(_like(c, below) for c in x) for x in labels]
        more = "".join(_like("a", below) for _ in range(attempt // 8))  # short addresses run out: then they get longer
        return "".join(_like(c, below) for c in local) + more + "@" + ".".join([*new, top])
    if kind == "ip":
        octets = [int(x) for x in canonical.split(".")]
        fixed = _private(octets)
        bits = 8 * (4 - fixed)
        tweak, x = "ip/" + ".".join(map(str, octets[:fixed])), int.from_bytes(bytes(octets[fixed:]), "big")
        while True:
            x = moved(key, tweak, x, 1 << bits // 2, 1 << bits // 2)
            new = [*octets[:fixed], *x.to_bytes(4 - fixed, "big")]
            if fixed or not _private(new):  # from a public address along the cycle to the next public one
                return ".".join(map(str, new))
    if kind == "iban":
        body = "".join(_like(c, below).upper() for c in canonical[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + canonical[:2] + "00")) % 97
        return f"{canonical[:2]}{check:02d}{body}"
    if kind == "card":
        off = int(canonical[-1]) - luhn_digit(canonical[:-1])
        body = canonical[0] + _digits(key, f"card/{canonical[0]}", canonical[1:-1])
        return body + str((luhn_digit(body) + off) % 10)
    if kind in ("phone", "ssn"):
        plus = canonical.startswith("+")
        code = next((canonical[: k + 1] for k in (1, 2) if canonical[1 : k + 1] in CODES), canonical[:4]) if plus else ""
        return code + _digits(key, f"{kind}/{code}", canonical[len(code) :])
    if kind == "given":
        gender_script = _OF_GIVEN[canonical]
        # a keyed order of the gender's and script's names; each name becomes the next one, so no two become the same
        ring = sorted(GIVEN[gender_script], key=lambda n: hmac.new(key, n.encode(), hashlib.sha256).digest())
        return ring[(ring.index(canonical) + 1) % len(ring)]
    s = script_of(canonical)
    return "".join(CONSONANTS[s][below(len(CONSONANTS[s]))] + VOWELS[s][below(len(VOWELS[s]))] for _ in range(max(2, min(8, len(canonical) // 2)) + attempt // 4)) + CONSONANTS[s][below(len(CONSONANTS[s]))]


def render(kind: str, surrogate_: str, found: str) -> str:
    """The surrogate in the format of the found text: its separators, groups and case."""
    if kind in ("card", "ssn", "phone"):
        digits = iter(surrogate_.lstrip("+"))
        return "".join(next(digits) if c.isdecimal() else c for c in found)
    if kind == "iban":
        chars = iter(surrogate_)
        return "".join(c if c == " " else next(chars) for c in found)
    if kind == "surname":
        return surrogate_.upper() if len(found) > 1 and found.isupper() else surrogate_.capitalize()
    if kind == "email" and found.isupper():
        return surrogate_.upper()
    return surrogate_


def replace(text: str, key: bytes, later: dict[tuple[str, str], int] | None = None) -> tuple[str, dict[str, int], set[tuple[str, str]]]:
    """The text with surrogates in place of its entities, how many there were of each type, and those whose surrogates are drawn.

    later has the attempt of those entities whose first surrogate was taken.
    """
    out, at, n, drawn = [], 0, {}, set()
    for kind, canonical, s, e in entities(text):
        attempt = later.get((kind, canonical), 0) if later else 0
        out += [text[at:s], render(kind, surrogate(key, kind, canonical, attempt), text[s:e])]
        at = e
        n[kind] = n.get(kind, 0) + 1
        if kind in DRAWN:
            drawn.add((kind, canonical))
    return "".join([*out, text[at:]]), n, drawn


#: Kinds whose surrogates are drawn; those of the others differ by construction.
DRAWN = ("email", "iban", "surname")
_MAP = "kind string, canonical string, attempt int"


def attempts(found: DataFrame, key: bytes, rounds: int = 50) -> DataFrame:
    """(kind, canonical, attempt) of the entities that must not take their first surrogate; found has distinct (kind, canonical).

    Only of the kinds DRAWN. A surrogate may be that of one entity only, and no entity of its type. Of those that want one, the smallest keeps
    it, the others try again. Everything is a table: entities are never gathered.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, canonical, attempt = (c.to_pylist() for c in b.columns)
            new = [surrogate(key, *x) for x in zip(kind, canonical, attempt, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], ["kind", "canonical", "attempt", "new"])

    now = common.materialise(found.where(F.col("kind").isin(*DRAWN)).withColumn("attempt", F.lit(0)), "entities")
    for _ in range(rounds):
        drawn = common.materialise(now.mapInArrow(draw, f"{_MAP}, new string"), "surrogates")
        first = drawn.groupBy("kind", "new").agg(F.min("canonical").alias("first"), F.count(F.lit(1)).alias("n"))
        lost = drawn.join(first.where("n > 1"), ["kind", "new"]).where("canonical <> first").select("kind", "canonical")
        taken = drawn.join(drawn.select("kind", F.col("canonical").alias("new")), ["kind", "new"], "left_semi").select("kind", "canonical")
        again = common.materialise(lost.unionByName(taken).distinct().withColumn("again", F.lit(1)), "collisions")
        if again.isEmpty():
            break
        now = common.materialise(now.join(again, ["kind", "canonical"], "left").select("kind", "canonical", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")), "entities")
    else:
        raise RuntimeError(f"collisions are left after {rounds} rounds")
    return now.where("attempt > 0")


def surrogates(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with surrogates in the whole texts; with count_col also how many entities of each type were replaced.

    key decides the surrogates. Null texts stay null; texts without entities stay as they are; other columns are passed
    on, whatever their names; a column count_col is replaced. Repeated rows stay; an empty table gives an empty one. Texts are
    matched once and written with first surrogates. Only where entities collide are they read again: texts are addressed by
    their SHA-256, and the further attempts of their entities are a table.
    """
    common.arrow_rows(docs.sparkSession)
    names = [c for c in docs.columns if c != count_col]
    docs = docs.select(names)
    counts, found, sha, later = (common.fresh(docs, c) for c in (count_col or "_counts", "_found", "_sha", "_later"))
    at, kinds = names.index(text_col), {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    fields = ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + f", `{counts}` map<string,int>"
    entity = pa.struct([("kind", pa.string()), ("canonical", pa.string())])

    def put(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in common.slices(batches):
                texts, n, drawn, shas = [], [], [], []
                for t, more in zip(b.column(at).to_pylist(), [None] * b.num_rows if first else b.column(b.num_columns - 1).to_pylist(), strict=True):
                    new, count, seen = replace(t, key, {(x["kind"], x["canonical"]): x["attempt"] for x in more or ()}) if t else (t, {}, ())
                    texts.append(new)
                    n.append(list(count.items()))
                    drawn.append([{"kind": k, "canonical": c} for k, c in sorted(seen)])
                    shas.append(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() if first and seen else None)
                cols = list(b.columns if first else b.columns[:-1])
                cols[at] = pa.array(texts, b.column(at).type)
                cols.append(pa.array(n, pa.map_(pa.string(), pa.int32())))
                more = [pa.array(drawn, pa.list_(entity)), pa.array(shas, pa.binary())] if first else []
                yield pa.RecordBatch.from_arrays([*cols, *more], [*names, counts, *([found, sha] if first else [])])

        return run

    done = common.materialise(docs.mapInArrow(put(True), f"{fields}, `{found}` array<struct<kind:string,canonical:string>>, `{sha}` binary"), "replaced")
    seen = done.select(F.col(sha).alias("sha"), F.explode(found).alias("e")).select("sha", "e.kind", "e.canonical")
    again = attempts(seen.select("kind", "canonical").distinct(), key)
    if again.isEmpty():
        out = done
    else:
        of_text = seen.join(again, ["kind", "canonical"]).groupBy("sha").agg(F.collect_set(F.struct("kind", "canonical", "attempt")).alias(later))
        of_text = common.materialise(of_text, "attempts")
        hashed = docs.withColumn(sha, F.unhex(F.sha2(F.col(text_col), 256)))
        wide = hashed.join(of_text.withColumnRenamed("sha", sha), sha, "left").select(*names, later)
        out = wide.mapInArrow(put(False), fields)
    return out.select(*names, *([F.col(counts).alias(count_col)] if count_col else []))


def pii_report(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, n_entities, kinds) for each row of docs; kinds is "type:count" by type, joined by commas."""
    out = surrogates(docs.select(id_col, text_col), key, id_col, text_col, "_entities")
    entries = F.array_sort(F.map_entries("_entities"))
    n = F.aggregate(F.map_values("_entities"), F.lit(0), lambda a, x: a + x).cast("long")
    said = F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return out.select(id_col, F.col(text_col).alias("text"), n.alias("n_entities"), said.alias("kinds"))
