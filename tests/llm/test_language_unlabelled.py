"""The language stage on a table without any label."""

from stellarframe.llm import language_id


def test_lettered_documents_stay_when_nothing_was_learned(spark):
    rows = [(1, "the cat", None), (2, None, None), (3, "", None), (4, "12 !?", None), (None, "la maison", None), (1, "the cat", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = language_id.keep_known(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "la maison"), (1, "the cat"), (1, "the cat")]
