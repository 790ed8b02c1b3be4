"""The pipeline's stages on a small table with planted cases."""

from __future__ import annotations

import corpus_pipeline
from gatewatch.llm import queries
from gatewatch.llm.common import materialize, table


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(queries.queries()) <= set(names)


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").limit(300)
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.6 * seen[0] and seen[3] == seen[4]
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert tokens.count() == seen[-1]


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and repeated rows, one doc_id over different texts, clashing columns, and empty tables."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    plain = table(spark, sf, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (10**9, "", None, "s", 0), (10**9, "some words here", "en", "s", 15), (10**9 + 1, "token=abcdefgh " * 3, "en", "s", 45), (10**9 + 1, "token=abcdefgh " * 3, "en", "s", 45)], plain.schema)
    clashing = {"row": F.lit(1), "spans": F.lit("mine"), "node": F.lit("x"), "p_good": F.lit(0.0), "digest": F.lit("d"), "_text": F.lit("t"), "label": F.lit("l")}
    docs = materialize(plain.unionByName(odd).withColumns(clashing), "odd")
    nothing = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns == nothing.columns and 0 < docs.count() <= before
        assert stage(spark, nothing, sf).count() == 0
        assert docs.filter("spans = 'mine' and _text = 't'").count() == docs.count()
        if name == "near_duplicates":
            assert docs.filter("text is null or text = ''").count() <= 1 and docs.filter("text like 'token=%'").count() <= 1
        if name == "secrets":
            assert docs.count() == before and docs.filter("text like '%token=abcdefgh%'").count() == 0
    tokens = corpus_pipeline.STAGES[-1][1]
    assert tokens(spark, docs, sf).count() == docs.count() and tokens(spark, nothing, sf).count() == 0
