"""Problem 3: near-duplicate bodies."""

from __future__ import annotations

from inkweft.llm.neardup import near_duplicate_classes, near_duplicate_pairs
from inkweft.runtime import table


def p3_found(spark, sf_dir):
    return near_duplicate_pairs(table(spark, sf_dir, "docs"), "doc_no", "body").toDF("doc_no_a", "doc_no_b")


def p3_classes(spark, sf_dir):
    return near_duplicate_classes(table(spark, sf_dir, "docs"), "doc_no", "body").withColumnRenamed("_id", "doc_no")


QUERIES = {"p3_found": p3_found, "p3_classes": p3_classes}
_PAIRS = """
w as (select doc_no, regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+') w from docs where body is not null),
s as (select distinct doc_no, array_to_string(w[p:p + 2], ' ') r from (select doc_no, w, unnest(range(1, len(w) - 1)) p from w where len(w) >= 20)),
n as (select doc_no, count(*) n from s group by 1),
common as (select a.doc_no a, b.doc_no b, count(*) c from s a join s b on a.r = b.r and a.doc_no < b.doc_no group by 1, 2),
pairs as (select a doc_no_a, b doc_no_b from common join n x on x.doc_no = a join n y on y.doc_no = b where c >= 0.6 * (x.n + y.n - c))
"""
SQL = {
    "p3_found": f"with {_PAIRS} select doc_no_a, doc_no_b from pairs",
    # Classes are what can be reached over pairs; a text's links lead to other sets of runs, each counted once.
    "p3_classes": f"""
with recursive {_PAIRS}, texts as (select doc_no, md5(string_agg(r, chr(10) order by r)) set_key from s group by 1),
edge as (select doc_no_a a, doc_no_b b from pairs union all select doc_no_b, doc_no_a from pairs),
reach as (select doc_no, doc_no far from texts union select reach.doc_no, edge.b from reach join edge on edge.a = reach.far),
label as (select doc_no, min(far) class_id from reach group by 1),
links as (select e.a doc_no, count(distinct y.set_key) n from edge e join texts x on x.doc_no = e.a join texts y on y.doc_no = e.b where x.set_key <> y.set_key group by 1)
select doc_no, class_id, coalesce(n, 0) n_links from label left join links using (doc_no)
""",
}
