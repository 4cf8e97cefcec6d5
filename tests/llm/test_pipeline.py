import corpus_pipeline
from pyspark.sql import functions as F

from foldcast.llm.common import table


def test_stages_keep_the_columns_and_the_clean(spark, sf):
    docs = table(spark, sf, "documents")
    made = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, made, sf)
        assert made.columns == docs.columns
    assert 0 < made.count() < docs.count()


def test_odd_rows_pass_all_stages(spark, sf):
    """Which odd rows each stage keeps: rows without id or text, empty texts, repeated rows."""
    docs = table(spark, sf, "documents").limit(20).withColumn("extra", F.when(F.col("doc_id") >= 0, "x"))
    odd = [(None, None, None, None, None, None), (5001, None, None, None, None, "x"), (5002, "", "en", "s", 0, "x"), (5001, None, None, None, None, "x")]
    odd = spark.createDataFrame(odd, docs.schema)
    ids = lambda d: sorted((r["doc_id"] if r["doc_id"] is not None else -1 for r in d.where("doc_id is null or doc_id >= 5000").collect()))
    stages = dict(corpus_pipeline.STAGES)
    # an empty text is judged by its features, alike for all of them
    judged = ids(stages["quality"](spark, docs.unionByName(odd), sf))
    assert judged in ([], [-1, 5001, 5001, 5002])
    made = docs.unionByName(odd).select(*corpus_pipeline.COLUMNS)
    for name in ("line_dedup", "near_copies", "decontamination"):
        made = stages[name](spark, made, sf)
        assert made.columns == list(corpus_pipeline.COLUMNS) and ids(made) == [-1, 5001, 5001, 5002], name
    packed = stages["packing"](spark, made, sf)
    # each is its end token alone
    rows = packed.where("doc_id is null or doc_id >= 5000").collect()
    assert len(rows) == 4 and all(r["length"] == 1 and r["doc_tokens"] == 1 for r in rows)


def test_empty_table(spark, sf):
    made = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, made, sf)
    assert made.count() == 0
