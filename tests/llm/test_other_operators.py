"""Embeddings, WARC, decontamination, language identification, personal data and the pipeline."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.fs as pafs
import pytest

from stellarframe.llm import common, decontaminate, embedding_dedup, language_id, pii, queries, warc

SF = "/root/testdata/sf0.001"


def brute_embeddings(rows, threshold=0.93):
    """(n_links, component) by id from (id, label, vector) rows, all pairs."""
    ids = [i for i, *_ in rows]
    vec = [None if v is None or any(x is None for x in v) else np.array(v, np.float64) for *_, v in rows]
    ok = [v is not None and np.isfinite(v).all() and v.any() and lab is not None for v, (_, lab, _) in zip(vec, rows, strict=True)]
    at, links = list(range(len(rows))), [0] * len(rows)

    def root(k):
        while at[k] != k:
            k = at[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][1] == rows[b][1] and len(vec[a]) == len(vec[b]) and vec[a] @ vec[b] / np.sqrt(vec[a] @ vec[a]) / np.sqrt(vec[b] @ vec[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)), key=lambda k: ids[k])
                at[y] = x
    return Counter((i, n, ids[root(k)], i == ids[root(k)]) for k, (i, n) in enumerate(zip(ids, links, strict=True)))


def near(rng, x, cos):
    y = rng.normal(size=len(x))
    x = x / np.linalg.norm(x)
    y -= x @ y * x
    return cos * x + np.sqrt(1 - cos * cos) * y / np.linalg.norm(y)


@pytest.mark.parametrize("block", [8, 1024])
def test_embeddings_against_all_pairs(spark, block):
    rng = np.random.default_rng(2)
    rows, base = [], rng.normal(size=(20, 64))
    for k in range(120):
        rows.append((1000 - k, "a" if k % 3 else "b", near(rng, base[k % 4], 0.985).astype(np.float32).tolist()))
    rows += [(k, "a", (base[k % 20] * (k % 3 + 1)).astype(np.float32).tolist()) for k in range(60)]
    rows += [(2000, None, rows[0][2]), (2001, "a", None), (2002, "a", [0.0] * 64), (2003, "a", [float("nan")] * 64), (2004, "a", [None] + [1.0] * 63), (2005, "a", [float("inf")] * 64), (2006, "a", [1.0] * 3)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, label string, embedding array<float>, bucket string, weight int, id int")
    out = embedding_dedup.embedding_components(df, block=block)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(map(tuple, out.collect())) == brute_embeddings(rows)
    assert embedding_dedup.embedding_components(df.where("false")).count() == 0


def test_embeddings_recall_at_the_threshold():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.stack([near(rng, v, 0.931) for v in x])
    met = embedding_dedup.first_shared(embedding_dedup.buckets(x), embedding_dedup.buckets(y)) >= 0
    assert met.mean() > 0.99


def test_buckets_do_not_depend_on_the_batch():
    x = np.random.default_rng(1).normal(size=(50, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert (embedding_dedup.buckets(x)[7:9] == embedding_dedup.buckets(x[7:9])).all()


def brute_warc(rows):
    first = {}
    for i, html in rows:
        if i is not None:
            raw = (html or "").encode()
            first[raw] = min(first.get(raw, i), i)
    out = Counter()
    for i, html in rows:
        raw = (html or "").encode()
        ref = first.get(raw) if i is not None and first[raw] != i else None
        out[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if ref is None else "revisit", ref] += 1
    return out


def test_warc_whole_table(spark):
    pages = queries.table(spark, SF, "pages")
    assert Counter(map(tuple, queries.op2_warc(spark, SF).collect())) == brute_warc([(r.page_id, r.html) for r in pages.collect()])


def test_warc_edges(spark):
    rows = [(5, "u\r\nX: y", "same"), (4, None, "same"), (9, "u", None), (8, "u", ""), (8, "u", ""), (None, "u", "same"), (1, "é", "ü" * 300000), (2, "u", "a\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "page_id long, url string, html string, refers_to int, payload_bytes string")
    assert Counter(map(tuple, warc.archive(df).collect())) == brute_warc([(r[0], r[2]) for r in rows])
    assert warc.archive(df.where("false")).count() == 0
    big = {r.page_id: r.record_type for r in warc.archive(df, least_bytes=5).collect()}
    assert big[5] == "response"


def test_bundle_frames_are_independent(tmp_path):
    path = str(tmp_path / "x.warc.zst")
    with open(path, "wb") as f:
        writer = warc.BundleWriter(f, frame_bytes=500)
        places = [writer.add(warc.record(k, "u", b"%d" % k * 40, "D", None)) for k in range(40)]
        writer.close()
    with pafs.LocalFileSystem().open_input_file(path) as f:
        reader = warc.BundleReader(f)
        assert len(reader.frames) == 1 + max(p[0] for p in places) > 3
        for k in random.Random(1).sample(range(40), 40):
            head, payload = reader.record(*places[k])
            assert payload == b"%d" % k * 40 and head["WARC-Record-ID"] == f"<{warc.record_id(k)}>"
    import zstandard

    with open(path, "rb") as f:  # a plain decoder reads it all and skips the table
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read().count(b"WARC/1.1") == 40


def infix(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, d in enumerate(item):
            new.append(min(row[i] + (c != d), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_edit_distance_is_exact():
    rng = random.Random(4)
    for _ in range(300):
        item = "".join(rng.choices("abc ", k=rng.randrange(1, 90)))
        text = "".join(rng.choices("abc ", k=rng.randrange(0, 120)))
        got = decontaminate.edit_distance_within(item, text, 10**6)
        assert got[0] == infix(item, text)


def test_contaminated_whole_table(spark):
    docs, items = queries.table(spark, SF, "documents"), queries.table(spark, SF, "benchmark")
    got = {(r.doc_id, r.item_id): r.edits for r in queries.op3_decontamination(spark, SF).collect()}
    # brute force: every document and item, windows of every size around the item's
    want = {}
    plain = {r.item_id: decontaminate.normal(r.text) for r in items.collect()}
    for r in docs.collect():
        text = decontaminate.normal(r.text)
        words = text.split()
        for i, item in plain.items():
            share = set(item.split())
            known = np.r_[0, np.cumsum([w in share for w in words])]
            n = min(len(words), len(item.split()))
            if n and (known[n:] - known[:-n]).max() >= 0.5 * len(item.split()):  # fewer words alike are too many edits
                got_one = decontaminate.edit_distance_within(item, text, len(item) // 5)
                if got_one:
                    want[r.doc_id, i] = got_one[0]
    assert got == want and len(want) > 0


def test_contaminated_recall_under_word_edits(spark):
    items = [(r.item_id, r.text) for r in queries.table(spark, "/root/testdata/sf0.01", "benchmark").collect()]
    vocab = [w for r in queries.table(spark, SF, "documents").limit(100).collect() for w in r.text.split()]
    rng, matcher = random.Random(8), decontaminate.Matcher(decontaminate.prepare(items))
    hit = total = 0
    for i, text in items * 3:
        words = text.split()
        for _ in range(int(0.18 * len(words))):
            p = rng.randrange(len(words))
            q = rng.random()
            words[p : p + (q < 0.75)] = [] if 0.5 < q < 0.75 else [rng.choice(vocab)]
        doc = " ".join(rng.choices(vocab, k=50) + words + rng.choices(vocab, k=50))
        item = decontaminate.normal(text)
        if decontaminate.edit_distance_within(item, decontaminate.normal(doc), len(item) // 5):
            total += 1
            hit += any(matcher.items.ids[k] == i for _, k, *_ in matcher.find_all([doc]))
    assert total > 60 and hit >= 0.95 * total


def test_contaminated_edges(spark):
    item = "One two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "x ONE two, three-four five six seven eight nine ten eleven TWELVE y", 0), (4, "z " * 100000 + item.upper(), 0), (4, "clean text", 0)], "doc_id long, text string, item_id int")
    got = Counter((r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(docs, items).collect())
    assert got == {(None, 1, 0): 2, (4, 1, 0): 2}
    assert decontaminate.contaminated(docs, items.where("false")).count() == 0
    assert decontaminate.contaminated(docs.where("false"), items).count() == 0
    assert sorted((r.doc_id or -1) for r in decontaminate.keep_clean(docs, items).collect()) == [1, 2, 4]  # each row by its own text


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: (r.lang, r.text) for r in queries.table(spark, sf, "documents").collect()}
    rows = queries.op8_language_id(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id][0] for r in held)
    assert right >= 0.95 * len(held), (right, len(held))


def test_language_edges(spark):
    rows = [(k, "the cat and the dog " * 3 if k % 2 else "le chat et la maison " * 3, "en" if k % 2 else "fr") for k in range(40)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !!", "fr"), (103, "the dog", None), (None, "la maison", None), (1, "and the cat", "en"), (104, "the dog " * 40000, None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, lang string, score int, lang_pred string")
    got = {(r.doc_id, r.lang_pred) for r in language_id.language_id(df).collect()}
    assert {(100, "und"), (101, "und"), (102, "und"), (103, "en"), (None, "fr"), (104, "en"), (1, "en")} <= got
    assert language_id.language_id(df.where("false")).count() == 0
    assert {r.lang_pred for r in language_id.language_id(df.where("lang is null")).collect()} == {"und"}
    kept = language_id.keep_known(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x @ np.array([1, -2, 0.5, 0, 1]) + 0.3 > 0, 1.0, -1.0)
    w = language_id.linear_svm(x, y, 100.0, 200)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97


KEY = b"k"


def test_surrogates_keep_kind_and_format():
    text = "Mail John.Smith@mail.example.com, +1 (799) 555-3432, 4111 1111 1111 1111, 10.2.3.4, Anna Schmidt; Frau Schmidt, Мария Иванова. DE89 3704 0044 0532 0130 00. 123-45-6789 ANNA"
    new, n, _ = pii.replace(text, KEY)
    assert n == {"email": 1, "phone": 1, "card": 1, "ip": 1, "given": 2, "surname": 3, "iban": 1, "ssn": 1}
    found = pii.entities(new)
    assert Counter(k for k, *_ in found) == Counter(k for k, *_ in pii.entities(text))
    was, now = {}, {}
    for (k, c, s, e), (_, d, s2, e2) in zip(pii.entities(text), found, strict=True):
        was.setdefault((k, c), set()).add(d)
        now.setdefault((k, d), set()).add(c)
        if k in ("phone", "card", "ssn", "iban"):
            assert [x.isdigit() for x in text[s:e]] == [x.isdigit() for x in new[s2:e2]]
    assert all(len(v) == 1 for v in [*was.values(), *now.values()])
    assert pii.luhn(next(d for k, d, *_ in found if k == "card")) == 0
    assert not {"Schmidt", "Иванова", "3432", "John"} & set(new.replace("-", " ").replace("@", " ").split())
    assert pii.script_of(new[new.index("Frau") + 5 :]) == "latin"
    for name, what in pii._OF_GIVEN.items():
        other = pii.surrogate(KEY, "given", name)
        assert other != name and pii._OF_GIVEN[other] == what


def test_pii_whole_table(spark):
    docs = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    rows = queries.op9_pii(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    back = {}
    for r in rows:
        want, n, _ = pii.replace(docs[r.doc_id], queries.pii_key(spark))
        assert r.n_entities == sum(n.values()) and r.kinds == ",".join(f"{k}:{v}" for k, v in sorted(n.items()))
        assert (r.text == docs[r.doc_id]) == (not n)
        for (k, c, *_), (_, d, *_) in zip(pii.entities(docs[r.doc_id]), pii.entities(r.text), strict=True):
            assert c != d and back.setdefault((k, d), c) == c
        del want
    assert sum(r.n_entities for r in rows) > 5


def test_pii_collisions_are_resolved(spark):
    # addresses in 127/8 have few surrogates that differ in the last number only: the shortest emails collide soonest
    rows = [(k, f"write {chr(97 + k % 26)}{chr(97 + k // 26)}@a.io now") for k in range(600)] + [(k, f"write {chr(97 + k % 26)}{chr(97 + k // 26)}@a.io now") for k in range(5)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kind string")
    got = pii.surrogates(df, KEY).collect()
    assert len(got) == 605
    new = {}
    for r in got:
        new.setdefault(r.doc_id, set()).add(r.text)
    assert all(len(v) == 1 for v in new.values()) and len({next(iter(v)) for v in new.values()}) == 600
    assert not {t for _, t in rows} & {r.text for r in got}


def test_pii_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "call +1 (799) 555-3432", 1), (3, "x " * 100000 + "a.b@c.example.com", 1)], "doc_id long, text string, kinds int")
    got = {r.doc_id: (r.text, r.n_entities) for r in pii.pii_report(df, KEY).collect()}
    assert got[1] == (None, 0) and got[2] == ("", 0) and got[None][1] == 1 and got[3][1] == 1
    assert "555-3432" not in got[None][0] and got[None][0].startswith("call +1 (")
    assert pii.pii_report(df.where("false"), KEY).count() == 0
    assert pii.surrogates(df, KEY).columns == ["doc_id", "text", "kinds"]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1001 + k) for k in range(500)] + [(5, 5), (None, 3), (2, 1), (2, 1)]
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1501)}


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = queries.table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    here = docs
    kept = set(rows)
    for name, stage in cp.STAGES:
        out = common.materialise(stage(spark, here, SF))
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= kept
        if name != "sequences":
            assert out.columns == docs.columns
        if name in ("personal data", "sequences"):
            assert ids == kept
        kept, here = ids, out
    leaks = {r.doc_id for r in decontaminate.contaminated(docs, queries.table(spark, SF, "benchmark")).collect()}
    assert leaks and not leaks & kept
    assert cp.run(spark, SF).count() == here.count()
