"""Long runs of one character, repeated ids over labels, bumped rules, dense ranges of surrogates, clashing columns."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from stellarframe.llm import embedding_dedup, language_id, packing, pii, secrets, sharding, token_counts, tokens

KEY = b"k"


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 2_000_000 + "x", "a" * 2_000_000, "é" * 500_000, "\x1c\x1d a\x1f b\x85\xa0 c<|endoftext|>d", "don't 12ab  \r\n\x0b it's"], ids=lambda t: repr(t[:6]))
def test_encoder_equals_the_library(text):
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path()
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert tokens.Encoder(path)(text) == np.array(want, "<u4").tobytes()


def test_long_runs_pass_through_the_queries(spark):
    rows = [(1, " " * 3_000_000), (2, "\n" * 1_000_001 + "x"), (3, "b" * 1_500_000), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    encode = tokens.Encoder(tokens.vocabulary_path())
    n = {i: len(encode(t or "")) // 4 for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df).collect()} == n
    got = Counter()
    for r in packing.pack(df).collect():
        got[r.doc_id] += r.length
    assert got == {i: k + 1 for i, k in n.items()}


def test_embeddings_with_one_id_in_two_labels(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(5, "a", a), (6, "a", a), (7, "a", a), (5, "b", b), (9, "b", b), (9, "b", [0.0, 0.0, 1.0, 0.0]), (4, "b", [0.0, 0.0, 0.99, 0.01])]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    got = Counter(map(tuple, embedding_dedup.embedding_components(df).collect()))
    assert got == Counter([(5, 2, 5, True), (6, 2, 5, False), (7, 2, 5, False), (5, 1, 5, True), (9, 1, 5, False), (9, 1, 4, False), (4, 1, 4, True)])


def test_embeddings_at_the_threshold(spark):
    side = np.sqrt(1 - 0.93**2)
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [0.93, float(side * (1 - 1e-12))]), (3, "a", [0.93, float(-side * (1 + 1e-9))])]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    assert {r.vec_id: r.n_links for r in embedding_dedup.embedding_components(df).collect()} == {1: 1, 2: 1, 3: 0}


def test_a_bumped_rule_replaces_its_findings(spark, tmp_path):
    docs = spark.createDataFrame([(1, "password=abcdefgh1 tail"), (2, None)], "doc_id long, text string")
    path = str(tmp_path / "ledger")
    old = secrets.secret_report(docs, ledger_path=path).collect()
    assert {r.doc_id: r.spans for r in old} == {1: "assign:0:18", 2: ""}
    rules = (secrets.RULES[0]._replace(version=2, pattern=secrets.RULES[0].pattern + r"(?:\x20tail)?"), *secrets.RULES[1:])
    new = secrets.secret_report(docs, rules=rules, ledger_path=path).collect()
    assert {r.doc_id: (r.spans, r.n_assign) for r in new} == {1: ("assign:0:23", 1), 2: ("", 0)}
    ledger = spark.read.parquet(path)
    assert sorted(x for r in ledger.collect() for x in r.rules if r.spans) == ["access@1", "assign@1", "assign@2", "hex@1", "jwt@1", "pem@1"]
    assert {r.doc_id: r.spans for r in secrets.secret_report(docs, ledger_path=path).collect()} == {1: "assign:0:18", 2: ""}  # the first version was never lost
    assert spark.read.parquet(path).count() == ledger.count()


def test_many_secrets_in_one_text(spark):
    text = "é".join(f"token={k:08d}x" for k in range(40_000))
    spans = [m.span() for m in re.finditer(r"token=\w{9}", text)]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = secrets.secret_report(df).first()
    base = ",".join(f"assign:{s}:{e}" for s, e in spans)
    assert r.n_assign == 40_000 and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_sharding_law_by_hand(spark):
    import xxhash

    df = spark.createDataFrame([(k, "x" * (k % 7)) for k in range(2000)] + [(None, "y")] * 3 + [(5, "z")] * 3, "doc_id long, text string")
    rows = sharding.shard_documents(df, [1.0] * 24).collect()

    def bids(key, n):
        out = []
        for s in range(n):
            seed = 42 if key is None else xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), 42)
            h = xxhash.xxh64_intdigest(s.to_bytes(4, "little"), seed)  # a 32-bit column after a 64-bit one
            out.append((-np.log(((h >> 11) + 0.5) / 2**53), s))
        return min(out)[1]

    for r in rows:
        assert (r.shard, r.grown_shard) == (bids(r.doc_id, 24), bids(r.doc_id, 25)) and r.grown_shard in (r.shard, 24)
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_permutations_fill_dense_ranges():
    net = [f"192.168.{a}.{b}" for a in range(256) for b in range(0, 256, 5)]
    out = [pii.surrogate(KEY, "ip", x) for x in net]
    assert len(set(out)) == len(net) and all(y.startswith("192.168.") and x != y for x, y in zip(net, out, strict=True))
    assert not pii._private([int(x) for x in pii.surrogate(KEY, "ip", "8.8.8.8").split(".")])
    phones = [f"+4930{k:05d}" for k in range(20_000)]
    out = [pii.surrogate(KEY, "phone", x) for x in phones]
    assert len(set(out)) == len(phones) and all(y.startswith("+49") and x != y for x, y in zip(phones, out, strict=True))
    for n, (a, b) in {6: (2, 3), 10: (1, 10), 1000: (10, 100)}.items():
        got = [pii.moved(KEY, "t", x, a, b) for x in range(n)]
        assert sorted(got) == list(range(n)) and all(x != y for x, y in enumerate(got))


def test_one_number_in_several_formats_keeps_the_reference():
    new, n, _ = pii.replace("+49 30 1234567 or +49301234567 or +49-30-123-45-67", KEY)
    assert n == {"phone": 3} and len({re.sub(r"\D", "", x) for x in new.split(" or ")}) == 1


def test_more_short_surnames_than_short_surrogates(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [a + b + c + d for a in letters for b in letters for c in letters for d in letters[:4]]  # 70,304 of 16,900 of two syllables
    found = spark.createDataFrame([("surname", n) for n in names], "kind string, canonical string")
    later = {r.canonical: r.attempt for r in pii.attempts(found, KEY).collect()}
    out = {pii.surrogate(KEY, "surname", n, later.get(n, 0)) for n in names}
    assert len(out) == len(names) and not out & set(names)


@pytest.mark.parametrize(
    ("text", "hidden"),
    [("Priya Raman wrote. Raman left.", "Raman"), ("My name is Kwame Osei, hello", "Osei"), ("Dear Ngozi Adeyemi,", "Adeyemi"), ("Mit freundlichen Grüßen\nJörg Öztürk", "Öztürk"), ("меня зовут Пётр Чайковский", "Чайковский"), ("Contact: Li Wei Zhang.", "Zhang")],
)
def test_names_by_their_surroundings(text, hidden):
    new, *_ = pii.replace(text, KEY)
    assert hidden not in new
    assert pii.replace("For For said the man. Der Vater schrieb. By To The.", KEY)[0] == "For For said the man. Der Vater schrieb. By To The."


def test_clashing_columns_keep_their_values(spark):
    rows = [(k, f"the quick brown fox {k} john.doe{k}@mail.example.com", "en" if k % 2 else "de", 777, "s", 5, k) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, lang_pred string, _entities int, _sha long")
    kept = language_id.keep_known(df)
    assert kept.schema == df.schema and sorted(map(tuple, kept.collect())) == rows
    out = pii.surrogates(df, KEY)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.score, r.lang_pred, r._entities, r._sha) for r in out.collect()) == [(k, 777, "s", 5, k) for k in range(40)]
    assert not [r for r in out.collect() if "john.doe" in r.text]


def test_training_sample_with_a_hot_id_and_null_ids(spark):
    rows = [(1, "ja und nein aber nicht", "de")] * 500 + [(None, "yes and no but not", "en")] * 500 + [(k, f"le chat et la souris {k}", "fr") for k in range(10, 60)] + [(k, f"the cat and the mouse {k}", "en") for k in range(60, 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, sample=30)
    assert sorted(x for names in model.families.values() for x in names) == ["de", "en", "fr"]
    assert language_id.predict(model, "la souris et le chat")[0] == "fr"
