"""Problem 8: evaluation passages in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweft.llm.leakage import leaked
from inkweft.runtime import table


def _leaks(spark, sf_dir):
    return leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def p8_found(spark, sf_dir):
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_by_item(spark, sf_dir):
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").cast("bigint").alias("n_docs"), F.max("n_words").cast("bigint").alias("longest"))


_RUNS = """
with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from benchmark where text is not null),
dr as (select distinct doc_id, hash(w[p:p + 11]) h from (select doc_id, w, unnest(range(1, len(w) - 10)) p from d)),
ir as (select distinct item_id, hash(w[p:p + 11]) h from (select item_id, w, unnest(range(1, len(w) - 10)) p from i))
"""
QUERIES = {"p8_found": p8_found, "p8_by_item": p8_by_item}
SQL = {"p8_found": _RUNS + "select distinct doc_id, item_id from dr join ir using (h)",
    # Matching runs of twelve words that follow each other on one diagonal are one shared run.
    "p8_by_item": """
with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from benchmark where text is not null),
dr as (select doc_id, p, hash(w[p:p + 11]) h from (select doc_id, w, unnest(range(1, len(w) - 10)) p from d)),
ir as (select item_id, q, hash(w[q:q + 11]) h from (select item_id, w, unnest(range(1, len(w) - 10)) q from i)),
m as (select distinct doc_id, item_id, p, p - q as diagonal from dr join ir using (h)),
g as (select *, p - row_number() over (partition by doc_id, item_id, diagonal order by p) run from m),
l as (select doc_id, item_id, count(*) + 11 n from g group by doc_id, item_id, diagonal, run)
select item_id, count(distinct doc_id) n_docs, max(n)::bigint longest from l group by 1
""",
}
