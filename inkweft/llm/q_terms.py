"""Problem 1: distinctive terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweft.llm.terms import top_terms
from inkweft.runtime import table


def _top(spark, sf_dir, by, k):
    return top_terms(table(spark, sf_dir, "fragments"), "fragment_id", "body_stems", "head_stems", by, k)


def p1_found(spark, sf_dir):
    return _top(spark, sf_dir, "weight", 3).select(F.col("_id").alias("fragment_id"), F.col("term").alias("stem"))


def p1_distinctive(spark, sf_dir):
    return _top(spark, sf_dir, "score", 5).select(
        F.col("_id").alias("fragment_id"), F.col("term").alias("stem"), F.col("tf").cast("bigint"), "df", "cf", "ridf", "score", F.col("rank").cast("bigint")
    )


_BASE = """
with recs as (select fragment_id, min(row(coalesce(body_stems, []), coalesce(head_stems, []))) r from fragments group by 1),
n as (select count(*)::double n from recs),
occ as (select fragment_id, unnest(r[1]) stem, false head from recs union all select fragment_id, unnest(r[2]), true from recs),
post as (select fragment_id, stem, count(*) tf, bool_or(head) in_head from occ where stem is not null group by 1, 2),
terms as (select stem, count(*) df, sum(tf)::bigint cf from post group by 1),
scored as (
  select fragment_id, stem, tf, df, cf,
    round(ln(1 + n / df) * case when in_head then 2 else 1 end, 9) weight,
    round(log2(n / df) + log2(1 - exp(-cf / n)), 9) ridf,
    round(tf * (log2(n / df) + log2(1 - exp(-cf / n))), 9) score
  from post join terms using (stem), n
)
"""
QUERIES = {"p1_found": p1_found, "p1_distinctive": p1_distinctive}
SQL = {
    "p1_found": _BASE + "select fragment_id, stem from scored qualify row_number() over (partition by fragment_id order by weight desc, stem) <= 3",
    "p1_distinctive": _BASE
    + "select fragment_id, stem, tf, df, cf, ridf, score, rank from (select *, row_number() over (partition by fragment_id order by score desc, stem) rank from scored) where rank <= 5",
}
