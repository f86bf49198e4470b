import numpy as np
from pyspark.sql import functions as F

from stratavane.llm import language


def test_models_count_every_labelled_row(spark, monkeypatch):
    """The models are those of all labelled rows: beyond a sample's rows, of long texts, of copies, and of more labels than a task holds."""
    rows = [(k, f"word{chr(97 + k % 26) * 3} {chr(97 + k // 26 % 26) * 3}", ["aa", "bb-XX", " cc "][k % 3]) for k in range(3000)]
    rows += [(1, "long " * 60_000, "dd"), (2, "12", "ee"), (3, "", "ff"), (4, "same", "aa"), (4, "same", "aa")]
    odd = [(5, None, "aa"), (6, "x", None), (7, "y", ""), (8, "z", "??"), (9, None, "gg")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").repartition(3)
    want = language.TextModel([(lang.strip()[:2], text) for _, text, lang in rows])
    for held in (64, 1):
        monkeypatch.setattr(language, "HELD_LABELS", held)
        got = language.learn(docs)
        assert got.languages == want.languages == ["aa", "bb", "cc", "dd", "ee", "ff"]
        assert (got.logs == want.logs).all()
    none = language.learn(docs.limit(0))
    assert none.languages == [] and none.logs.shape == (language.BUCKETS, 1) and np.isfinite(none.logs).all()


def test_queries_take_whole_documents(spark, tmp_path):
    """A language that only a text beyond a sample's length tells is known to every query."""
    docs = [(k, "the house and the garden", "en", "s") for k in range(4000)] + [(9000, "das haus und der garten " * 1000, "de", "s")]
    docs += [(9100 + k, "la casa y el jardin", "es", "s") for k in range(2500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(4)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    pages = [(1, "https://a.de/", "<html><p>der garten und das haus</p></html>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text_language for r in language.language_of_pages(spark, str(tmp_path)).collect()}
    assert got == {1: "de"}
    own = {r.doc_id: r.language for r in language.op3_language_id(spark, str(tmp_path)).where("doc_id = 9000").collect()}
    assert own == {9000: "de"}
    assert language.keep_identified(df).where(F.col("doc_id") == 9000).count() == 1
