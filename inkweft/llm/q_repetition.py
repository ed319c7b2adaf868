"""Problem 10: repetition inside a text."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweft.llm.repetition import repeated_share, repetition_profile
from inkweft.runtime import table


def p10_found(spark, sf_dir):
    rows = repeated_share(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.where("n_words >= 20 and n_repeated >= 0.3 * n_words").select(F.col("_id").alias("doc_id")).distinct()


def p10_profile(spark, sf_dir):
    rows = repetition_profile(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    return rows.withColumnRenamed("_id", "doc_id").withColumn("share", F.round("share", 6))


QUERIES = {"p10_found": p10_found, "p10_profile": p10_profile}
SQL = {
    "p10_found": """
with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents where text is not null),
g as (select doc_id, p, array_to_string(w[p:p + 4], ' ') r from (select doc_id, w, unnest(range(1, len(w) - 3)) p from d where len(w) >= 20)),
again as (select doc_id, p from g qualify p > min(p) over (partition by doc_id, r)),
covered as (select doc_id, count(distinct p + i) n from again, (select unnest([0, 1, 2, 3, 4]) i) group by 1)
select doc_id from covered join (select doc_id, len(w) n_words from d) using (doc_id) where n >= 0.3 * n_words
"""
}
