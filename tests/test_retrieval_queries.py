from pyspark.sql import functions as F

from inkweft.plans import retrieval as P

DATA = "/root/testdata/sf0.001"


def test_doubts_and_unknown_words_of_every_language(spark):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    every = {r.item_id for r in items.collect()}
    other = {r.item_id for r in items.where("lang is null or lang <> 'en'").collect()}
    assert other and {r.item_id for r in P.doubt_flags(spark, DATA).collect()} == every
    whole = P.unknown_words(spark, DATA).collect()
    # By hand: an item of another language has a row where one of its stems is in no fragment.
    terms = {r.token for r in P.fragment_index(spark, DATA).terms.select("token").collect()}
    tokens = P.benchmark_tokens(spark, DATA).where(F.col("qid").isin(list(other))).collect()
    assert {r.item_id for r in whole} & other == {r.qid for r in tokens if r.token not in terms}
