"""Problem 7: splitting oversized bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweft.llm.splitting import split_by_base
from inkweft.runtime import table


def p7_found(spark, sf_dir):
    pieces = split_by_base(table(spark, sf_dir, "docs"), table(spark, sf_dir, "bases"), with_text=False).where("n_chars > limit")
    forced = pieces.groupBy("doc_no").agg(F.bool_or(F.col("cut") == "forced").alias("_forced"))
    return forced.select("doc_no", F.when(F.col("_forced"), "forced").otherwise("natural").alias("cut"))


def p7_pieces(spark, sf_dir):
    pieces = split_by_base(table(spark, sf_dir, "docs"), table(spark, sf_dir, "bases"))
    return pieces.where("n_chars > limit").select("doc_no", "piece", "begin", "end", "cut", "text")


QUERIES = {"p7_found": p7_found, "p7_pieces": p7_pieces}
SQL = {
    "p7_found": """
select doc_no, case when list_max(list_transform(string_split_regex(body, '[ \\t\\r\\n]+'), lambda x: length(x))) > n then 'forced' else 'natural' end as cut
from (select doc_no, body, coalesce(b.search.chunk_chars, 420) n from docs left join bases b using (base_key))
where length(body) > n
"""
}
