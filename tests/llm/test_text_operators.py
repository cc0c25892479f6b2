"""Secrets, sharding, token counts and packing against plain Python."""

import binascii
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Row

from stellarframe.llm import common, packing, queries, secrets, sharding, token_counts, tokens

SF = "/root/testdata/sf0.001"
TOKEN = "<|endoftext|>"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    texts = [(1, None), (2, ""), (3, "a" * 30000), (3, "a" * 30000), (None, "token = abcdefgh1 é AKIAABCDEFGHIJKL"), (7, "word " * 30000), (8, f"x{TOKEN} y  \n\n z's  \x1c 12345")]
    rows = [Row(doc_id=i, text=t, size=1, length=2, spans="s", block=3, bucket=4, shard=5, blob="b", slot=1) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, size int, length int, spans string, block int, bucket int, shard int, blob string, slot int")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def find(text):
    """Base spans by the contract's own patterns, then the further rules."""
    kinds = [
        ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
        ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), lambda m: True),
        ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), lambda m: True),
    ]
    return sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in p.finditer(text) if ok(m))


def report(text):
    spans = find(text or "")
    n = Counter(name for _, _, name, _ in spans)
    said = lambda xs: ",".join(f"{name}:{s}:{e}" for s, _, name, e in xs)
    base = said([x for x in spans if x[1] < 3])
    return n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(), said(spans)


def secret_rows(df):
    return sorted(((r.doc_id or -1, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in df.collect()), key=str)


def test_secrets_whole_table(spark):
    docs = queries.table(spark, SF, "documents")
    assert secret_rows(queries.op7_secrets(spark, SF)) == sorted(((i or -1, *report(t)) for i, t in pairs(docs)), key=str)


def test_secrets_edges(spark, odd):
    tricky = ["token=secret:abcdefgh", "PASSWORD='" + "x" * 9, "api-key=12345678 apikey : \"1234567", "AKIA" + "Z" * 11, "AKIA" * 8, "é" * 5 + "f" * 33 + "g" + "0" * 31, "token==abcdefg token = token=abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", "a" * 32 + "\n" + "b" * 40, "eyJ" + "a" * 9 + ("." + "b" * 9) * 2]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tricky * 2)], "doc_id long, text string")
    assert secret_rows(secrets.secret_report(df)) == sorted(((i or -1, *report(t)) for i, t in enumerate(tricky * 2)), key=str)
    assert secret_rows(secrets.secret_report(odd)) == sorted(((i or -1, *report(t)) for i, t in pairs(odd)), key=str)
    assert secrets.secret_report(odd.where("false")).count() == 0


def test_ledger_scans_only_unseen_pairs(spark):
    one = spark.createDataFrame([(1, "token = abcdefgh12"), (2, "token = abcdefgh12"), (3, "plain")], "doc_id long, text string")
    first = common.materialise(secrets.scan(one, rules=secrets.RULES[:2]))
    assert first.count() == 2
    assert secrets.scan(one, first, secrets.RULES[:2]).count() == 0
    more = one.union(spark.createDataFrame([(4, "f" * 32), (5, "plain")], "doc_id long, text string"))
    second = common.materialise(secrets.scan(more, first, secrets.RULES[:3]))
    rules = {bytes(r.blob): r.rules for r in second.collect()}
    assert rules[hashlib.sha256(b"plain").digest()] == ["hex@1"]
    assert rules[hashlib.sha256(b"f" * 32).digest()] == ["assign@1", "access@1", "hex@1"]
    got = {r.doc_id: r.spans for r in secrets.secret_report(more, first, secrets.RULES[:3]).collect()}
    assert got == {1: "assign:0:18", 2: "assign:0:18", 3: "", 4: "hex:0:32", 5: ""}


def test_shards(spark, odd):
    got = queries.op5_sharding(spark, SF).collect()
    want = {i: t for i, t in pairs(queries.table(spark, SF, "documents"))}
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        raw = (want[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, binascii.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 24)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    assert 0 < sum(r.grown_shard == 24 for r in got) < len(got) * 0.12
    rows = sharding.shard_documents(odd, [1.0, 0.0, 3.0]).collect()
    assert len(rows) == 7 and {r.shard for r in rows} <= {0, 2} and len({r.shard for r in rows if r.doc_id == 3}) == 1
    assert {r.size for r in rows if r.doc_id in (1, 2)} == {8}
    assert sharding.shard_documents(odd.where("false"), [1.0]).count() == 0


def test_shards_follow_weights(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "'x' as text")
    n = Counter(r.shard for r in sharding.shard_documents(df, [1.0, 2.0, 5.0]).collect())
    assert all(abs(n[s] / 20000 - w / 8) < 0.02 for s, w in enumerate((1, 2, 5)))


def count(tok, text):
    return len(tok.encode(text or "", add_special_tokens=False).ids)


def test_token_counts(spark, odd):
    tok = tokenizer()
    for df, kw in ((queries.table(spark, SF, "documents"), {}), (odd, {}), (odd, {"block_chars": 10})):
        got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, **kw).collect())
        assert got == Counter((i, len((t or "").encode()), n := count(tok, t), n > 512) for i, t in pairs(df))
    assert token_counts.token_counts(odd.where("false")).count() == 0


def test_pre_tokens_are_the_libraries(spark):
    tok, split, encode = tokenizer(), tokens.PreTokens(tokens.vocabulary_path()), tokens.Encoder(tokens.vocabulary_path())
    rng = random.Random(3)
    chars = list("ab c'stdrevm  \n\t1२٣") + [" ", " ", "\x1c", "\x85", "﻿", "​", "é", "́", "漢", "😀", "İ", TOKEN, "'ll", "\r\n", "ₐ", "²", "᠎"]
    for _ in range(400):
        text = "".join(rng.choices(chars, k=rng.randrange(40)))
        ids = tok.encode(text, add_special_tokens=False).ids
        assert encode(text) == b"".join(i.to_bytes(4, "little") for i in ids), repr(text)
        assert "".join(split(text)) == text
    latin = [chr(c) for c in range(256)]
    for k in range(2000):
        text = "".join(rng.choices(latin, k=rng.randrange(60))) if k % 2 else "".join(rng.choices(latin[:128] * 3 + [" "] * 90, k=200))
        assert encode(text) == b"".join(i.to_bytes(4, "little") for i in tok.encode(text, add_special_tokens=False).ids), repr(text)
    for text in ("a" * 50000, " " * 50000, "\n" * 9000 + "x", "ab" * 9000, "!" * 9000):
        assert encode(text) == b"".join(i.to_bytes(4, "little") for i in tok.encode(text, add_special_tokens=False).ids)


def unpack(rows, texts, room):
    tok = tokenizer()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for places in by_seq.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= room
    for i, t in texts.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length]))
            assert r.length == room or k == 0
            at += r.length
        assert at == len(ids)
    return len(by_seq)


def test_packing_round_trip(spark, odd):
    rows = queries.op4_packing(spark, SF).collect()
    n = unpack(rows, dict(pairs(queries.table(spark, SF, "documents"))), 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1
    once = odd.dropDuplicates(["doc_id", "text"])
    unpack(packing.pack(once, room=64).collect(), dict(pairs(once)), 64)
    assert packing.pack(odd).count() == 7 + sum(r.piece > 0 for r in packing.pack(odd).collect())
    assert packing.pack(odd.where("false")).count() == 0


def test_fullest_is_exact():
    rng = random.Random(5)
    for _ in range(300):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 7))}
        room = rng.randrange(1, 90)
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= room}
        used = packing.fullest(counts, room)
        assert sum(n * k for n, k in used.items()) == max(sums)
        assert all(k <= counts[n] for n, k in used.items())


def test_plan_places_everything():
    rng = random.Random(6)
    histogram = {n: rng.randrange(1, 2000) for n in rng.sample(range(1, 1025), 500)}
    placed = Counter()
    for times, used in packing.plan(histogram, 2048):
        assert sum(n * k for n, k in used.items()) <= 2048
        for n, k in used.items():
            placed[n] += times * k
    assert placed == histogram
    bins = sum(times for times, _ in packing.plan(histogram, 2048))
    assert bins <= -(-sum(n * c for n, c in histogram.items()) // 2048) * 1.001 + 1


def test_ranks_are_gapless_under_a_hot_group(spark):
    df = spark.range(3000).selectExpr("id", "if(id % 3 = 0, id % 5, 0) as g")
    got = defaultdict(list)
    for r in common.ranked(df, "g", df["id"], ["id"], "rank", 7).collect():
        got[r.g].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values())
