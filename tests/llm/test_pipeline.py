"""The pipeline's stages on the smallest tables."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm import toxicity
from tarn.llm.common import Workspace

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    ws = Workspace(spark, "test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(ws.table(stage(spark, kept[-1], SF), name.replace(" ", "-")))
        assert kept[-1].columns == columns, name
    ids = [collections.Counter(r.doc_id for r in d.select("doc_id").collect()) for d in kept]
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.7").collect()}
    assert set(ids[0]) - set(ids[1]) == toxic
    assert set(ids[2]) <= set(ids[1]) and set(ids[3]) <= set(ids[2]) and set(ids[4]) <= set(ids[3])
    assert max(ids[3].values()) == 1 and max(ids[4].values()) <= 3
    packed = corpus_pipeline.packing_stage(spark, kept[-1], SF)
    assert packed.select("doc_id").distinct().count() == len(ids[4])


def test_run_is_registered(spark):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    assert sum(k.startswith("op") for k in __spark_entry__.queries()) == 10


def test_stages_on_odd_rows_and_no_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash, by value."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "plain words that nobody else has\nand a second line", "en", "a", 50), (4, "word " * 30_000, "en", "b", 150_000)]
    rows += [(5, "the same text here and there\nwith one more line of its own", "en", "c", 60)] * 3 + [(6, "The same text, here and there!", None, "c", 30), (None, "words of a document without an id", "en", None, 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in ("blank", "dropped", "node", "size", "row", "y", "label", "a", "key"):
        df = df.withColumn(c, F.lit("clash"))
    spark.createDataFrame([(3, 1, 0), (4, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    by_id = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    toxicity_out = stages["toxicity"](spark, df, str(tmp_path))
    assert by_id(toxicity_out) == by_id(df)
    lines_out = stages["line dedup"](spark, df, str(tmp_path))
    assert [i for i, _ in by_id(lines_out)] == [1, 2, 3, 4, 5, 5, 5, None] and {r.n_chars for r in lines_out.where("doc_id = 5").collect()} == {len(rows[4][1])}
    groups_out = stages["n-gram Jaccard join"](spark, df, str(tmp_path))
    assert [i for i, _ in by_id(groups_out)] == [1, 2, 3, 4, 5, 6, None]
    mixed = stages["mixing sources to target weights"](spark, df, str(tmp_path))
    assert {r.doc_id for r in mixed.collect()} <= {1, 2, 3, 4, 5, 6, None}
    assert all(d.columns == df.columns for d in (toxicity_out, lines_out, groups_out, mixed))
    packed = stages["packing"](spark, df, str(tmp_path))
    assert packed.where("doc_id = 1").count() == 1
    none = df.limit(0)
    assert [s(spark, none, str(tmp_path)).count() for s in stages.values()] == [0] * 5


def test_run(spark):
    """Whole: what run() packs is what the stages leave, and its own tables are gone but the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    want = collections.Counter((r.doc_id, r.doc_tokens) for r in docs.where("start = 0").collect())
    assert collections.Counter((r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, SF).where("start = 0").collect()) == want
