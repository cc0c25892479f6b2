"""Decontamination against the plain edit distance, with no filter of words before it."""

import random

import pytest

from stellarframe.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"


def brute(matcher, texts):
    """{(text, item): edits} of each item within its edits anywhere in the text."""
    out = {}
    for row, text in enumerate(texts):
        for k, item in enumerate(matcher.items.texts):
            got = decontaminate.edit_distance_within(item, f" {decontaminate.normal(text or '')} ", matcher._most[k])
            if got:
                out[row, k] = got[0]
    return out


def strewn(rng, text, share, letters):
    """The text with that share of its characters replaced, left out or preceded by others, all over it."""
    chars = list(text)
    for _ in range(int(share * len(chars))):
        p, r = rng.randrange(len(chars)), rng.random()
        chars[p : p + (r < 0.7)] = [] if r < 0.35 else [rng.choice(letters)]
    return "".join(chars)


@pytest.mark.parametrize("letters", ["ab ", "abcdefgh ", "abcdefghijklmnopqrstuvwxyzé "])
def test_no_edit_of_characters_is_missed(letters):
    rng = random.Random(3)
    some = lambda n: "".join(rng.choices(letters, k=n))
    for _ in range(12):
        matcher = decontaminate.Matcher(decontaminate.prepare([(i, some(rng.choice([8, 12, 20, 33, 60, 150, 240, 400, 900]))) for i in range(6)]))
        texts = [some(rng.randrange(200)) + " " + strewn(rng, rng.choice(matcher.items.texts), rng.choice([0, 0.1, 0.15, 0.2, 0.22]), letters) + " " + some(rng.randrange(200)) for _ in range(6)]
        assert {(row, k): d for row, k, d, *_ in matcher.find_all(texts)} == brute(matcher, texts)


def test_typing_errors_in_most_words():
    items = [(i, f"{i} the quick brown fox number {i * 7919} jumps over another lazy dog and runs into the deep forest beyond hill {i * 31}") for i in range(20)]
    rng, matcher = random.Random(5), decontaminate.Matcher(decontaminate.prepare(items))
    for i, text in items:
        noisy = " ".join(w[: len(w) // 2] + "#q"[rng.randrange(1, 2)] + w[len(w) // 2 + 1 :] if len(w) > 3 else w for w in text.split())
        want = brute(matcher, [noisy])
        assert (0, i) in want and {(r, k): d for r, k, d, *_ in matcher.find_all([noisy])} == want


def test_tables_rows_against_all_pairs(spark):
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    texts = [r.text for r in queries.table(spark, SF, "documents").orderBy("doc_id").limit(40).collect()]
    rng, letters = random.Random(6), "etaoinshr "
    texts += [f"before it {strewn(rng, text, share, letters)} after it" for share in (0.1, 0.18) for _, text in items]
    matcher = decontaminate.Matcher(decontaminate.prepare(items))
    got = {(row, k): d for row, k, d, *_ in matcher.find_all(texts)}
    assert got == brute(matcher, texts) and len(got) > 70


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "Paris, France"), (2, "中国的首都是北京吗"), (3, "東京"), (4, "คำตอบคือกรุงเทพ"), (5, "42"), (6, "?!"), (7, "art")]
    docs = [
        (1, "He said: paris -- FRANCE!"), (2, "请问中国的首都是北京吗？是的"), (3, "中国的首都是上海吗"), (4, "私は東京に住んでいます"), (5, "ว่า คำตอบคือกรุงเทพ ครับ"),
        (6, "it was 42."), (7, "parisian france 421 party start"), (8, "pari france"), (9, "中国的首都是南京吗"),
    ]
    df = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, dict(docs)[r.doc_id].lower()[r.begin : r.end]) for r in decontaminate.contaminated(df(docs, "doc_id"), df(items, "item_id")).collect()}
    assert got == {
        (1, 1): (0, "paris -- france"), (2, 2): (0, "请问中国的首都是北京吗"), (4, 3): (0, "私は東京に住んでいます"), (5, 4): (0, "คำตอบคือกรุงเทพ"),
        (6, 5): (0, "42"), (9, 2): (1, "中国的首都是南京吗"),
    }
    assert sorted(r.doc_id for r in decontaminate.keep_clean(df(docs, "doc_id"), df(items, "item_id")).collect()) == [3, 7, 8]
