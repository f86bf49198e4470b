from stratavane.llm import language


def test_query_takes_the_declared_language_as_evidence(spark, tmp_path):
    """Two rows that differ in nothing but their declared language differ in their posteriors."""
    rows = [(k, "the house and the garden of the old man" if k % 2 else "das haus und der garten des alten mannes", "en" if k % 2 else "de", "s") for k in range(60)]
    rows += [(100, "the garden und der man", "en", "s"), (101, "the garden und der man", "de", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.language, r.posterior) for r in language.op3_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == 62 and got[100] != got[101]
    assert got[100][0] == "en" and got[101][0] == "de"
