"""The pipeline's stages on odd, empty and clashing tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def staged(spark, docs, tmp_path):
    """Each stage's rows, written and read again."""
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs)
    return out


def test_odd_rows_and_clashing_columns(spark, odd_docs, odd_rows, tmp_path):
    """Nothing fails; what is left comes from the rows given, and columns keep their names and order."""
    docs = odd_docs.withColumns({"_id": F.lit(1), "a.b": F.lit("c"), "_row": F.lit(2), "hash": F.lit(None).cast("string")})
    found = staged(spark, docs, tmp_path)
    assert all(f.columns == docs.columns for f in found[:-1])
    sizes = [docs.count(), *(f.count() for f in found[:-1])]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    # rows of fewer than 50 words go, and one that repeats itself; 1 and 5 are near copies of -5
    ids = [r.doc_id for r in found[1].select("doc_id").collect()]
    assert not {1, 2, 3, 4, 5, 10, 11, 12} & set(ids) and {-5, 6, 8, 50} <= set(ids)
    texts = {r.doc_id: r.text for r in found[2].collect()}
    assert texts[50] == dict(r for r in odd_rows if r[0] == 50)[50]
    assert {r.doc_id for r in found[3].select("doc_id").collect()} == set(texts)


def test_empty_table(spark, no_docs, tmp_path):
    assert [f.count() for f in staged(spark, no_docs, tmp_path)] == [0, 0, 0, 0]


def test_tables_without_known_values(spark, tmp_path):
    """All texts, languages and sources missing: the rules reject every row, later stages have none."""
    docs = spark.createDataFrame([(k, None, None, None, None) for k in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [f.count() for f in staged(spark, docs, tmp_path)] == [0, 0, 0, 0]


@pytest.mark.parametrize("words", [1_000_000])
def test_very_long_text(spark, words, tmp_path):
    """A text of some 10 MB goes through every stage whole."""
    text = " ".join(f"w{k * 7919 % 1_000_003:08}" for k in range(words))
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "short of words", "en", "s", 14), (3, text + " more", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    found = staged(spark, docs, tmp_path)
    assert [(r.doc_id, len(r.text)) for r in found[2].collect()] == [(1, len(text))]
    pieces = found[3].agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens"), F.max("length").alias("longest")).first()
    assert pieces.longest == 4096 and pieces.n == -(-pieces.tokens // 4096) and pieces.tokens > words
