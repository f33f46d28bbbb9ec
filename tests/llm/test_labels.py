"""What the classifiers share: samples stay bounded where keys repeat, stages keep columns of any name."""

from pyspark.sql import functions as F

from sparkloom.llm import quality, toxicity
from sparkloom.llm.common import labelled_sample


def test_a_repeated_key_is_drawn_once(spark):
    docs = spark.range(900).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    found = labelled_sample(docs, labels, "quality", 3000, 1000)
    assert len(found) == len({t for t, _ in found}) <= 3 and all(t.startswith("text ") for t, _ in found)


def test_stages_keep_clashing_columns_nulls_and_repeats(spark):
    good, bad = "The river runs along the old town and people walk there. " * 5, "$$$ !!! %%% &&& " * 10
    rows = [(i, good if i % 2 else bad, i, "s") for i in range(40)] + [(None, None, 1, None), (3, good, 2, "s"), (3, good, 2, "s"), (50, "", 3, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __score int, __SCORE_ string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    for stage in (quality.keep_good, toxicity.keep_clean):
        got = stage(docs, labels)
        assert got.schema == docs.schema and got.where("doc_id = 3").count() == 3
        assert {r.doc_id for r in got.where("text is not null and text != ''").collect()} == {i for i in range(40) if i % 2}
        assert stage(docs.limit(0), labels).collect() == []
