from __future__ import annotations

from quern.llm import toxicity


def test_repeated_keys_do_not_outweigh_the_sample(spark):
    rows = [(i, ("vile rotten words here " if i % 2 else "kind gentle words here ") + f"n{i}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    more = spark.createDataFrame([rows[0]] * 2000 + rows, "doc_id long, text string")
    assert toxicity.fit(more, labels) == toxicity.fit(docs, labels)
