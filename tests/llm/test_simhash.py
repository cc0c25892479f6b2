import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from stellarframe.llm import simhash

DOCS = "/root/testdata/sf0.001/documents.parquet"


def brute(rows):
    fps = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        fps[i] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0
    return fps


def components(fps):
    at = {i: i for i in fps}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = sorted((root(a), root(b)))
            at[y] = x
    return {i: root(i) for i in fps}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(DOCS)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    fps = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    comp = components(fps)
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def test_edges_and_clashing_columns(spark):
    rows = [Row(doc_id=5, text=None, fp="x", component_id=1, cell=2), Row(doc_id=4, text="", fp="x", component_id=1, cell=2), Row(doc_id=9, text="a b c d", fp="x", component_id=1, cell=2)]
    rows += [Row(doc_id=9, text="a b c d", fp="x", component_id=1, cell=2), Row(doc_id=8, text="one", fp="x", component_id=1, cell=2), Row(doc_id=3, text="w " * 200000, fp="x", component_id=1, cell=2)]
    docs = spark.createDataFrame(rows)
    got = sorted((r.doc_id, r.component_id) for r in simhash.simhash_components(docs).collect())
    assert got == [(3, 3), (4, 4), (5, 4), (8, 8), (9, 9), (9, 9)]
    assert simhash.simhash_components(docs.where("false")).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [3, 4, 8, 9]


@pytest.mark.parametrize(("segments", "crowd"), [(16, 512), (16, 65), (2, 65), (64, 65)])
def test_crowded_cells_keep_components(spark, segments, crowd):
    base = 0x0123456789ABCDEF
    fps = {base} | {base ^ (1 << a) for a in range(64)} | {base ^ (1 << a) ^ (3 << 8) for a in range(12)} | {0xFFFF << 40}
    fps |= {sum(3 << 4 * (i + k) for i in range(8)) ^ (1 << k) for k in range(9)} | {int.from_bytes(bytes(8 * [k]), "big") for k in range(256)}
    rng = np.random.default_rng(4)
    for _ in range(200):  # words of the same segment counts, and neighbours of some
        w = sum(int(rng.choice([1, 2, 4, 8])) << 4 * i for i in range(16))
        fps |= {w, w ^ (1 << int(rng.integers(64)))}
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    found = {frozenset((r.u, r.v)) for r in simhash.fingerprint_links(df, segments, crowd).collect()}
    exact = {frozenset((simhash.signed(a), simhash.signed(b))) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2}

    def classes(links):
        at = {simhash.signed(f): simhash.signed(f) for f in fps}
        while True:
            before = dict(at)
            for a, b in map(tuple, links):
                at[a] = at[b] = min(at[a], at[b])
            if before == at:
                return at

    assert classes(found) == classes(exact)


def test_keep_one_with_null_and_repeated_ids(spark):
    near = " ".join(f"w{i}" for i in range(40))
    rows = [(5, near, "a"), (5, near, "a"), (None, near, "b"), (None, "other words here now", "c"), (None, "other words here now", "c"), (5, "nothing of the kind at all", "d"), (7, near, "e"), (3, "nothing of the kind at all", "f")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _fp string, component long, _pick int")
    assert sorted(((r.doc_id or 0), r._fp) for r in simhash.keep_one(docs).collect()) == [(0, "c"), (3, "f"), (5, "a")]
    assert simhash.keep_one(docs).columns == docs.columns


def test_long_texts_count_every_shingle():
    words = [f"w{i}" for i in range(150000)]
    assert simhash.fingerprint(" ".join(words)) != simhash.fingerprint(" ".join(words[:100000]))
    assert simhash.fingerprint("A b  C") == xxhash.xxh64_intdigest(b"a b c", seed=42)
