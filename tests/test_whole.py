"""Queries over whole tables."""

from tarn import plans

SF = "/root/testdata/sf0.001"


def test_setop_union_all_has_all_rows(spark):
    n = sum(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("orders", "customer"))
    assert plans.QUERIES["setop_union_all"](spark, SF).count() == n


def test_unnest_has_all_components(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("sum(size(embedding))").first()[0]
    assert plans.QUERIES["unnest"](spark, SF).count() == n


def test_age_has_all_orders(spark):
    assert plans.QUERIES["fn_age"](spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_bm25_scores_other_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(r"lower(text) RLIKE '(?<![a-z0-9])(onion|which|ther)(?![a-z0-9])'")
    assert {r.doc_id for r in plans.QUERIES["bm25"](spark, SF).collect()} == {r.doc_id for r in docs.collect()}


def test_sort_null_order_ends_with_nulls(spark):
    keys = [r.k for r in plans.QUERIES["sort_null_order"](spark, "/root/testdata/sf0.01").collect()]
    n = sum(k is not None for k in keys)
    assert len(keys) > 2000 and n < len(keys) and keys[:n] == sorted(k for k in keys if k is not None)


def test_misc_has_suppliers_from_10000_on(spark, tmp_path):
    spark.createDataFrame([(9,), (10_000,), (20_000,), (20_000_000,)], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.s_suppkey: r.z for r in plans.QUERIES["fn_misc"](spark, str(tmp_path)).collect()}
    assert got == {9: "9000 bytes", 10_000: "9766 kB", 20_000: "19 MB", 20_000_000: "19 GB"}


def test_hybrid_search_takes_other_languages(spark):
    from tarn.plans import operators

    both = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS doc_id"), "doc_id")
    assert operators._candidates(spark, SF).count() == both.count() > both.where("lang = 'en'").count()
