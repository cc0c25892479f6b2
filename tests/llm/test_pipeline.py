"""The pipeline against plain Python on a small corpus: nulls, repeats, long texts, clashing columns, and an empty table."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline as cp
from stellarframe.llm import common, packing, tokens

WORDS = {"en": "the of and to in is that for it was on are with as his they at be this have from or one had by".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split()}


def corpus():
    rng = random.Random(8)
    say = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(n))
    items = [(k, "".join(rng.choice("abcdefghijklmnop") for _ in range(4)) + f" item {k} " + say("en", 18)) for k in range(4)]
    texts = [(say(lang, rng.randrange(30, 90)), lang) for lang in ("en", "de") for _ in range(18)]
    texts += [(texts[3][0], "en"), (texts[3][0].upper(), "en"), (texts[20][0], "de")]  # copies
    texts += [(say("en", 12) + " " + items[1][1] + " " + say("en", 9), "en"), (say("de", 8) + " " + items[2][1].replace("item", "itme") + ".", "de")]  # leaks
    texts += [(None, "en"), ("", "de"), ("12 34 --", "en"), ("x" * 30_000 + " " + say("en", 9000), "en")]
    texts += [(say("en", 40) + " mail jo.doe@corp.example.org or 10.1.2.3", "en"), (say("de", 40) + " an jo.doe@corp.example.org", "de")]
    rows = [(k, t, lang, "web", len(t or ""), 0.5, k) for k, (t, lang) in enumerate(texts)]
    rows.append(rows[5])  # a row that is there twice
    rows.append((None, say("en", 35), "en", "web", 1, 0.5, 7))
    rows.append((900, say("en", 33), None, None, None, None, None))
    return rows, items


def simhash(text):
    words = re.findall(r"[^ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def one_of_each(rows):
    """Of each class of near copies the rows with the smallest id, one of them; a null id comes last."""
    fps = [simhash(r[1]) for r in rows]
    at = list(range(len(rows)))

    def root(k):
        while at[k] != k:
            k = at[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                at[root(a)] = root(b)
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[root(k)].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0, r[1])) for g in groups.values()]


def closest(item, text):
    """The least edits of characters from item to any part of text."""
    row = np.zeros(len(text) + 1, np.int64)
    codes = np.array([ord(c) for c in text])
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)
        # what comes from the left adds one a place
        steps = np.arange(len(new))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def leaks(text, items):
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    return any(closest(i, plain(text)) <= int(0.2 * len(i)) for i in (plain(t) for _, t in items))


def test_stages_and_run(spark, tmp_path):
    rows, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, component long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    here, after = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in cp.STAGES:
        here = common.materialise(stage(spark, here, str(tmp_path)))
        after[name] = [tuple(r) for r in here.collect()]
        assert name == "sequences" or here.schema.simpleString() == spark.read.parquet(str(tmp_path / "documents.parquet")).schema.simpleString()

    lettered = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert Counter(after["language"]) == Counter(lettered) and len(lettered) == len(rows) - 3
    single = one_of_each(lettered)
    assert Counter(after["near copies"]) == Counter(single) and len(single) <= len(lettered) - 4
    clean = [r for r in single if not leaks(r[1], items)]
    assert Counter(after["benchmarks"]) == Counter(clean) and len(clean) == len(single) - 2

    was = {(r[0], r[2:4], r[5:]): r[1] for r in clean}
    new = {(r[0], r[2:4], r[5:]): r for r in after["personal data"]}
    assert was.keys() == new.keys()
    mails = set()
    for key, r in new.items():
        text = was[key]
        assert r[4] == len(r[1])
        if "@" not in text:
            assert r[1] == text
        else:
            gone = re.compile(r"\S+@\S+|10\.1\.2\.3")
            assert "jo.doe" not in r[1] and "10.1.2.3" not in r[1]
            mails |= set(re.findall(r"\S+@\S+", r[1]))
            assert re.sub(r"\S+@\S+|\b10(?:\.\d+){3}", "#", r[1]) == gone.sub("#", text)
    assert len(mails) == 1  # one address, one surrogate

    library = Tokenizer.from_file(tokens.vocabulary_path())
    want = Counter()
    for r in after["personal data"]:
        n = len(library.encode(r[1], add_special_tokens=False).ids) + 1
        first = n if n <= 2048 else (n % 2048 or 2048)
        want.update((r[0], k, s, m) for k, (s, m) in enumerate([(0, first)] + [(s, 2048) for s in range(first, n, 2048)]))
    assert Counter(r[:4] for r in after["sequences"]) == want
    filled = defaultdict(list)
    for r in after["sequences"]:
        filled[r[5]].append((r[6], r[3]))
    for parts in filled.values():
        ends = np.cumsum([0, *(m for _, m in sorted(parts))])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 2048
    total = sum(m for *_, m in want.elements())
    assert len(filled) <= -(-total // 2048) + 1
    assert Counter(r[:5] for r in map(tuple, cp.run(spark, str(tmp_path)).collect())) == Counter(r[:5] for r in after["sequences"])


def test_run_on_an_empty_table(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, component long").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def fewest(lengths, room):
    """The least number of bins, by trying everything."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= room and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]


def test_packing_against_the_optimum():
    rng = random.Random(3)
    over = 0
    for _ in range(60):
        lengths = [rng.randint(2, 20) for _ in range(rng.randint(3, 11))]
        bins = packing.plan(Counter(lengths), 20)
        placed = Counter()
        for times, used in bins:
            assert sum(n * k for n, k in used.items()) <= 20
            placed.update({n: times * k for n, k in used.items()})
        assert placed == Counter(lengths)
        over += sum(t for t, _ in bins) - fewest(lengths, 20)
    assert over <= 3  # of some 300 bins


def test_fullest_is_the_fullest():
    rng = random.Random(5)
    for _ in range(100):
        lengths = Counter(rng.randint(1, 30) for _ in range(rng.randint(0, 9)))
        sums = {0}
        for n in lengths.elements():
            sums |= {s + n for s in sums}
        used = packing.fullest(dict(lengths), 40)
        assert all(used[n] <= lengths[n] for n in used) and sum(n * k for n, k in used.items()) == max(s for s in sums if s <= 40)
