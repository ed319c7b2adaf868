"""Queries on references that do not hold, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweft.operators.references import orphan_references
from inkweft.runtime import table


def _orphans(spark, sf_dir):
    return orphan_references(*(table(spark, sf_dir, t) for t in ("docs", "cards", "links", "registry", "bases")))


def p6_found(spark, sf_dir):
    return _orphans(spark, sf_dir).select("ref_table", "period", "ref_id", "field").distinct()


def p6_by_period(spark, sf_dir):
    kind = lambda s: F.count_if(F.col("status") == s).cast("bigint").alias(f"n_{s}")
    return _orphans(spark, sf_dir).groupBy("ref_table", "field", "period").agg(kind("missing"), kind("deleted"), kind("late"), F.count("*").cast("bigint").alias("n_dangling"))


_EDGE = "[\\s\"''`\u00a0‘’‚“”„«»]+"
_ID = lambda c: f"regexp_replace(regexp_replace({c}, '^{_EDGE}', ''), '{_EDGE}$', '')"
_ABS = "^(?i:https?)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?"


def _url(c, host):
    full = f"(case when starts_with(trim({c}), '/') then 'https://' || {host} || trim({c}) else trim({c}) end)"
    page = f"regexp_replace(regexp_extract(regexp_extract({full}, '{_ABS}', 3), '(?:^|&)pageId=([^&]*)', 1), '/+$', '')"
    return f"(case when regexp_extract({full}, '{_ABS}', 1) <> '' then lower(regexp_extract({full}, '{_ABS}', 1)) || regexp_replace(regexp_extract({full}, '{_ABS}', 2), '/+$', '') || case when {page} <> '' then '?pageId=' || {page} else '' end end)"


_STATE = f"""
with raw as (
  select 'docs' ref_table, doc_no ref_id, 'source_id' field, 'i:' || {_ID('frontmatter.source_id')} as k, synced_at as moment from docs where frontmatter.source_id is not null
  union all select 'cards', card_id, 'source_id', 'i:' || {_ID('source_id')}, written_at from cards where source_id is not null
  union all select 'docs', doc_no, 'source_url', 'u:' || {_url('frontmatter.source_url', 'b.host')}, synced_at from docs left join bases b using (base_key)
  union all select 'links', link_id, 'url', 'u:' || {_url('url', 'b.host')}, seen_at from links left join bases b using (base_key)
), refs as (
  select distinct * from raw where k is not null and (starts_with(k, 'i:') or split_part(split_part(substr(k, 3), '/', 1), '?', 1) in (select lower(host) from bases))
), parents as (
  select 'i:' || {_ID('page_id')} as k, registered_at, removed_at from registry where page_id is not null
  union all select 'u:' || {_url('url', "null")}, registered_at, removed_at from registry where url is not null
), first as (select k, min(registered_at) began from parents group by k),
held as (
  select distinct r.ref_table, r.ref_id, r.field, r.k, r.moment from refs r join parents p on p.k = r.k and p.registered_at <= r.moment and (p.removed_at is null or p.removed_at > r.moment)
), state as (
  select distinct r.ref_table, strftime(r.moment at time zone 'UTC', '%Y-%m') period, r.ref_id, r.field,
    case when f.began is null then 'missing' when r.moment is null or f.began > r.moment then 'late' else 'deleted' end status
  from refs r anti join held h on h.ref_table = r.ref_table and h.ref_id = r.ref_id and h.field = r.field and h.k = r.k and h.moment = r.moment left join first f on f.k = r.k
)
"""

QUERIES = {"p6_found": p6_found, "p6_by_period": p6_by_period}
SQL = {
    "p6_found": _STATE + "select distinct ref_table, period, ref_id, field from state",
    "p6_by_period": _STATE
    + "select ref_table, field, period, count(*) filter (where status = 'missing') n_missing, count(*) filter (where status = 'deleted') n_deleted, count(*) filter (where status = 'late') n_late, count(*) n_dangling from state group by ref_table, field, period",
}
