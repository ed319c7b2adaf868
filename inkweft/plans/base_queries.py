"""Queries on links, gates, claims, histories and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkweft.config import FOUR
from inkweft.functions import text as T
from inkweft.operators import history as H
from inkweft.operators import links as L
from inkweft.operators import quality as Q
from inkweft.operators import verify as V
from inkweft.runtime import table
from inkweft.sources.convert import convert_files
from inkweft.streaming.ingest import windowed_counts


def _docs(spark, sf_dir):
    f = "frontmatter."
    return table(spark, sf_dir, "docs").select("doc_no", "base_key", "name", "lang", F.col(f + "source_file").alias("source_file"), F.col(f + "source_id").alias("page_id"), F.col(f + "source_url").alias("url"), F.coalesce(f + "title", "name").alias("title"), "body", "synced_at", "loaded_at")


def _hosts(spark, sf_dir):
    """The hosts of the bases: a table of settings, one row for each base."""
    return sorted(r.host for r in table(spark, sf_dir, "bases").select("host").distinct().collect())


def _resolved(spark, sf_dir):
    links = table(spark, sf_dir, "links").dropDuplicates(["link_id"]).select("link_id", "name", F.col("pos"), F.coalesce("label", F.lit("")).alias("label"), "url").where("url is not null")
    return L.resolve(links, _docs(spark, sf_dir), _hosts(spark, sf_dir))


# ---------------------------------------------------------------- links
def url_parts(spark, sf_dir):
    urls = table(spark, sf_dir, "links").select("url").where("url is not null").distinct()
    host, path = T.url_parts(F.col("url"))
    return urls.select("url", F.lower(host).alias("host"), path.alias("path"), T.dashed(T.without_extension(T.url_tail(F.col("url")))).alias("slug"))


def link_kinds(spark, sf_dir):
    return table(spark, sf_dir, "links").where("url is not null").groupBy(L.link_kind(F.col("url")).alias("kind")).agg(F.count("*").cast("bigint").alias("n"))


def page_ids(spark, sf_dir):
    return table(spark, sf_dir, "links").where("url is not null").select("url", T.page_id(F.col("url")).alias("page_id")).where("page_id is not null").distinct()


def extracted_links(spark, sf_dir):
    own = table(spark, sf_dir, "originals").select(F.col("original_id").cast("string").alias("name"), "body")
    return L.extract_links(own).select("name", F.col("pos").cast("bigint"), "label", "url")


def resolved_links(spark, sf_dir):
    return _resolved(spark, sf_dir).select("link_id", "target", F.col("rule").cast("bigint"), "self")


def resolved_by_key(spark, sf_dir):
    """How many links each of the first two rules resolves."""
    r = _resolved(spark, sf_dir).where("rule in (1, 2)")
    return r.groupBy(F.col("rule").cast("bigint").alias("rule")).agg(F.count("*").cast("bigint").alias("n"), F.count_if("self").cast("bigint").alias("n_self"))


def edges(spark, sf_dir):
    return L.edges(_resolved(spark, sf_dir))


def missing_pages(spark, sf_dir):
    return L.missing_pages(_resolved(spark, sf_dir), _hosts(spark, sf_dir)).select("key", F.col("n_labels").cast("bigint"), F.col("n_links").cast("bigint"))


def missing_ranked(spark, sf_dir):
    return L.rank_missing(missing_pages(spark, sf_dir), FOUR.missing_limit)


def link_stats(spark, sf_dir):
    return L.link_stats(_resolved(spark, sf_dir))


def relinked(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    own = L.resolve(L.extract_links(docs), docs, _hosts(spark, sf_dir))
    return L.relink(docs, own).select("name", F.length("body").cast("bigint").alias("n_chars"), F.sha1(F.col("body").cast("binary")).alias("sha1"))


# ---------------------------------------------------------------- gates and names
def exact_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"))
    return d.groupBy("sha1").agg(F.count("*").cast("bigint").alias("n"), F.min("doc_id").alias("first_doc"))


def first_of_equal(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.sha1(F.col("text").cast("binary")).alias("sha1"))
    return Q.first_of_equal(d, name="doc_id").select("doc_id", "sha1")


def run_on_share(spark, sf_dir):
    return _docs(spark, sf_dir).where("body is not null").select("doc_no", F.round(Q.run_on_share(F.col("body")), 6).alias("share"))


def body_gate(spark, sf_dir):
    d = _docs(spark, sf_dir).where("body is not null")
    size = F.octet_length("body").cast("bigint")
    return d.select("doc_no", Q.body_length(F.col("body")).cast("bigint").alias("n_body"), Q.rejected(F.col("body"), size, FOUR).alias("rejected"))


def repeated_lines(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_no", F.explode(T.lines(F.col("body"))).alias("line")).where("line <> ''")
    return rows.groupBy("doc_no", "line").agg(F.count("*").cast("bigint").alias("n")).where("n >= 3")


def slugs(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_no", Q.slug(Q.transliterate(d, F.col("title")), F.col("title")).alias("slug"))


def dashed_titles(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_no", T.dashed(F.col("title")).alias("slug"))


def free_names(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return Q.free_names(d.select(F.col("doc_no").alias("id"), T.dashed(F.col("title")).alias("slug"))).select(F.col("id").alias("doc_no"), "name")


def document_names(spark, sf_dir):
    heading = F.regexp_extract("body", r"(?m)^# (.*)$", 1)
    d = table(spark, sf_dir, "docs").where("body is not null")
    return d.select("doc_no", Q.document_title(F.coalesce("frontmatter.title", F.lit("")), heading, F.col("frontmatter.source_file")).alias("title"))


def unexpanded_macros(spark, sf_dir):
    return table(spark, sf_dir, "originals").where("body is not null").select("original_id", Q.unexpanded_macros(F.col("body")).cast("bigint").alias("n")).where("n > 0")


def document_by_id(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return Q.document_by_id(d.select("page_id", "name"), d.select("page_id").where("page_id is not null"))


def converted_text(spark, sf_dir):
    """Plain-text originals through the text converter."""
    o = table(spark, sf_dir, "originals").where("body is not null and (lower(source_file) like '%.txt' or lower(source_file) like '%.md')")
    files = o.select(F.concat_ws("/", F.col("original_id").cast("string"), "source_file").alias("name"), F.col("body").cast("binary").alias("content"))
    return convert_files(files, extracted="2025-01-01").select("name", "source_id", "title", F.length("md").cast("bigint").alias("n_chars"), F.size("links").cast("bigint").alias("n_links"), "error")


# ---------------------------------------------------------------- claims
def _cards(spark, sf_dir):
    return table(spark, sf_dir, "cards").select(F.col("card_id").cast("string").alias("card"), "topic", F.col("source_id").alias("page_id"), "text")


def number_claims(spark, sf_dir):
    return V.number_claims(_cards(spark, sf_dir)).select("card", F.col("pos").cast("bigint"), "value", "unit")


def quote_claims(spark, sf_dir):
    own = table(spark, sf_dir, "originals").select(F.col("original_id").cast("string").alias("card"), F.col("body").alias("text"))
    return V.quote_claims(own).select("card", F.col("pos").cast("bigint"), "quote")


def confirmed_numbers(spark, sf_dir):
    cards, docs = _cards(spark, sf_dir), _docs(spark, sf_dir)
    by_id = docs.where("page_id is not null").groupBy("page_id").agg(F.min("name").alias("name"))
    sources = cards.join(by_id, "page_id").select("card", "name")
    claims = V.number_claims(cards)
    done = V.confirm_numbers(claims, sources, V.number_contexts(docs, ["en", "uk", "de", "fr"]), FOUR)
    return done.select("card", F.col("pos").cast("bigint"), "value", "unit", "confirmed")


def orphan_cards(spark, sf_dir):
    cards, docs = _cards(spark, sf_dir), _docs(spark, sf_dir)
    return V.orphan_cards(cards, cards.join(docs.select("page_id").distinct(), "page_id").select("card")).select("card")


# ---------------------------------------------------------------- histories and reports
def _snapshots(spark, sf_dir):
    """First and last export of every page that came with an id."""
    d = _docs(spark, sf_dir).where("page_id is not null and body is not null").select(F.col("page_id").alias("name"), "body", "synced_at", "doc_no")
    pick = lambda f: d.groupBy("name").agg(f("body", F.struct("synced_at", "doc_no")).alias("body"))
    return pick(F.min_by), pick(F.max_by)


def history_changes(spark, sf_dir):
    return H.unit_changes(*_snapshots(spark, sf_dir)).select("name", F.col("added").cast("bigint"), F.col("removed").cast("bigint"))


def history_diffs(spark, sf_dir):
    return H.unified_diffs(*_snapshots(spark, sf_dir)).select("name", F.col("added").cast("bigint"), F.col("removed").cast("bigint"), "diff")


def snapshot_changes(spark, sf_dir):
    before, now = _snapshots(spark, sf_dir)
    return H.snapshot_changes(before, now)


def incremental_new(spark, sf_dir):
    d = _docs(spark, sf_dir).select("name", F.sha1(F.col("body").cast("binary")).alias("sha1"), "loaded_at")
    cut = F.lit("2024-07-01").cast("timestamp")
    return d.where(F.col("loaded_at") >= cut).join(d.where(F.col("loaded_at") < cut).select("sha1"), "sha1", "left_anti").select("name")


def stale_topics(spark, sf_dir):
    rebuilt = _docs(spark, sf_dir).where("synced_at >= timestamp'2024-10-01 00:00:00'").select("page_id")
    return _cards(spark, sf_dir).join(rebuilt, "page_id", "left_semi").select("topic").distinct()


def pruned_history(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("base_key").alias("name"), F.col("synced_at").alias("ts"), "doc_no")
    return H.prune_history(d.groupBy("name", "ts").agg(F.min("doc_no").alias("doc_no"))).select("name", "doc_no")


def recent_changes(spark, sf_dir):
    d = _docs(spark, sf_dir).groupBy(F.col("base_key").alias("name"), F.col("synced_at").alias("ts")).agg(F.count("*").cast("bigint").alias("added"), F.lit(0).cast("bigint").alias("removed"))
    return H.recent_changes(d).select("name", "added", "removed")


def base_report(spark, sf_dir):
    """Pages by base and language with subtotals."""
    d = _docs(spark, sf_dir).select("base_key", F.coalesce("lang", F.lit("none")).alias("lang"), F.length("body").alias("n"))
    return d.rollup("base_key", "lang").agg(F.count("*").cast("bigint").alias("n_docs"), F.sum("n").cast("bigint").alias("n_chars"), F.grouping_id().cast("bigint").alias("depth"))


def late_rows(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("month", F.date_format("synced_at", "yyyy-MM"))
    return d.groupBy("month").agg(F.count("*").cast("bigint").alias("n"), F.count_if(F.col("loaded_at") > F.col("synced_at") + F.expr("interval 7 days")).cast("bigint").alias("n_late"))


def event_windows(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events"), "1 day").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", F.col("n").cast("bigint"), F.round("total", 3).alias("total"))


def order_report(spark, sf_dir):
    """A join over the star schema: revenue by nation and year."""
    o, li, c, n = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "nation"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name", F.year("o_orderdate").cast("bigint").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").cast("bigint").alias("n"))


def outcome_changes(spark, sf_dir):
    """Pages of the registry against the documents: in both, or only in one."""
    d, r = _docs(spark, sf_dir).select("page_id").where("page_id is not null").distinct(), table(spark, sf_dir, "registry").select("page_id").distinct()
    both = d.withColumn("_d", F.lit(True)).join(r.withColumn("_r", F.lit(True)), "page_id", "full")
    return both.select("page_id", F.when(F.col("_d").isNull(), "registry only").when(F.col("_r").isNull(), "documents only").otherwise("both").alias("state"))


QUERIES = {f.__name__: f for f in (
    url_parts, link_kinds, page_ids, extracted_links, resolved_links, resolved_by_key, edges, missing_pages, missing_ranked, link_stats, relinked,
    exact_duplicates, first_of_equal, run_on_share, body_gate, repeated_lines, slugs, dashed_titles, free_names, document_names, unexpanded_macros, document_by_id, converted_text,
    number_claims, quote_claims, confirmed_numbers, orphan_cards,
    history_changes, history_diffs, snapshot_changes, incremental_new, stale_topics, pruned_history, recent_changes, base_report, late_rows, event_windows, order_report, outcome_changes,
)}
_NORM = lambda u: f"lower(regexp_replace(regexp_replace(regexp_replace({u}, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '/+$', ''))"
_DASH = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"
_D = "d as (select doc_no, base_key, name, lang, frontmatter.source_file source_file, frontmatter.source_id page_id, frontmatter.source_url url, coalesce(frontmatter.title, name) title, body, synced_at, loaded_at from docs)"
_PAGE = lambda u, hosts: f"case when {u} like '/%' or regexp_matches({u}, {hosts}) then coalesce(nullif(regexp_extract({u}, '(?:/pages/(\\d+)/|[?&]pageId=(\\d+))', 1), ''), nullif(regexp_extract({u}, '(?:/pages/(\\d+)/|[?&]pageId=(\\d+))', 2), '')) end"
_HOSTS = "(select '(' || string_agg(replace(host, '.', '\\.'), '|') || ')/' from bases)"
_SNAP = f"{_D}, e as (select page_id as name, body, synced_at, doc_no from d where page_id is not null and body is not null), s as (select name, arg_min(body, (synced_at, doc_no)) a, arg_max(body, (synced_at, doc_no)) b from e group by name)"
_UNITS = lambda c, sign: f"select name, unnest(list_transform(flatten(list_transform(string_split(regexp_replace({c}, '\\n$', ''), chr(10)), lambda x: case when length(x) > 200 then string_split(regexp_replace(x, '([.!?:;])\\s+', '\\1' || chr(1), 'g'), chr(1)) else [x] end)), lambda u: u)) unit, {sign} n from s"
_URL_PATH = lambda u: f"regexp_replace(regexp_replace(regexp_replace({u}, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*:(//)', '\\1'), '^//[^/]*', '')"
_STEM = lambda x: f"regexp_replace({x}, '([^.])\\.[^./]*$', '\\1')"
_SUFFIXES = "('md', 'markdown', 'rst', 'txt', 'text', 'html', 'htm', 'pdf', 'doc', 'docx')"
#: Links with what they lead to, by page id, url and file name; no url of the tables carries a document number, so none is left to the fourth rule.
_RESOLVED = f"""
{_D}, l as (select distinct on (link_id) link_id, name, coalesce(label, '') as label, url from links where url is not null),
ids as (select page_id, max(name) target from d where page_id <> '' group by 1), urls as (select {_NORM('url')} u, max(name) target from d where url <> '' group by 1),
stems as (select key, min(name) target from (select name, unnest([{_DASH(_STEM('name'))}, {_DASH(_STEM("coalesce(source_file, '')"))}]) as key from d) where key <> '' group by 1),
x as (select l.*, l.url in (select name from d) as here, (regexp_matches(lower(l.url), '^https?://') or (not starts_with(l.url, '#') and not regexp_matches(l.url, '^(?i:[a-z][a-z0-9+.\\-]*):') and (contains(regexp_replace(l.url, '[#?].*$', ''), '/') or lower(regexp_extract(regexp_replace(l.url, '[#?].*$', ''), '[^/.]\\.([A-Za-z0-9]+)$', 1)) in {_SUFFIXES}))) as page from l),
y as (select x.*, case when page and not here then coalesce(i.target, u.target, n.target) end hit, case when not page or here then null when i.target is not null then 1 when u.target is not null then 2 when n.target is not null then 3 end rule
  from x left join ids i on i.page_id = {_PAGE('x.url', _HOSTS)} left join urls u on u.u = {_NORM('x.url')} left join stems n on n.key = {_DASH(_STEM("regexp_extract(" + _URL_PATH('x.url') + ", '([^/]*)$', 1)"))}),
res as (select link_id, name, label, url, here, page, case when hit <> name then hit end target, rule::bigint rule, coalesce(hit = name, false) as own from y)
"""
_TAIL = "regexp_extract(regexp_replace(" + _URL_PATH("url") + ", '/+$', ''), '([^/]*)$', 1)"
_MISSING = f"""
{_RESOLVED}, lost as (select url, label, {_PAGE('url', _HOSTS)} id, {_DASH(f"case when lower(regexp_extract({_TAIL}, '[^.]\\.([A-Za-z0-9]+)$', 1)) in {_SUFFIXES} then {_STEM(_TAIL)} else {_TAIL} end")} slug from res where target is null and not own and not here and page),
keyed as (select label, coalesce(id, case when (not regexp_matches(url, '^(?i:[a-z][a-z0-9+.\\-]*):') or exists (select 1 from bases b where contains(url, b.host))) and slug <> '' and not regexp_matches(slug, '^\\d+$') then substr(slug, 1, 60) end) as key from lost),
missing as (select key, count(distinct substr(label, 1, 60)) n_labels, count(*) n_links from keyed where key is not null group by 1)
"""


def _chain(x: str) -> str:
    """Letters of the transliteration tables replaced one by one in a lower-cased SQL text, accents taken off the rest."""
    for a, b in Q.LETTERS.items():
        x = f"replace({x}, '{a}', '{b}')"
    return f"strip_accents({x})"


_SLUG = lambda t: f"regexp_replace(substr({_DASH(_chain(f'lower({t})'))}, 1, 48), '-+$', '')"
SQL = {
    "resolved_links": f"with {_RESOLVED} select link_id, target, rule, own as self from res",
    "edges": f"with {_RESOLVED} select distinct name src, target dst from res where target is not null",
    "link_stats": f"with {_RESOLVED} select count(target) linked, count(*) filter (where own) self_links, count(distinct (name, target)) filter (where target is not null) n_edges from res",
    "missing_pages": f"with {_MISSING} select key, n_labels, n_links from missing",
    "missing_ranked": f"with {_MISSING} select key, n_labels, n_links from missing order by n_labels desc, key limit 40",
    "slugs": f"with {_D}, s as (select doc_no, title, {_SLUG('title')} slug from d) select doc_no, case when slug <> '' then slug when trim(title) <> '' then 'document-' || substr(sha1(trim(title)), 1, 8) else 'document' end slug from s",
    "extracted_links": """
with m as (select original_id::varchar as name, regexp_extract_all(body, '\\[([^\\]]*)\\]\\(([^)\\s]+)\\)', 1) a, regexp_extract_all(body, '\\[([^\\]]*)\\]\\(([^)\\s]+)\\)', 2) b from originals where body is not null)
select name, (p - 1)::bigint pos, a[p] as label, b[p] url from (select *, unnest(range(1, len(a) + 1)) p from m)
""",
    "link_kinds": """
select case when starts_with(url, '#') then 'anchor' when regexp_matches(url, '^(?i:[a-z][a-z0-9+.\\-]*):') and not regexp_matches(lower(url), '^https?://') then 'scheme'
  when regexp_matches(lower(url), '^https?://') or contains(regexp_replace(url, '[#?].*$', ''), '/') or lower(regexp_extract(regexp_replace(url, '[#?].*$', ''), '[^/.]\\.([A-Za-z0-9]+)$', 1)) in ('md', 'markdown', 'rst', 'txt', 'text', 'html', 'htm', 'pdf', 'doc', 'docx') then 'page' else 'code' end kind, count(*) n
from links where url is not null group by 1
""",
    "page_ids": "select distinct url, coalesce(nullif(regexp_extract(url, '(?:/pages/(\\d+)/|[?&]pageId=(\\d+))', 1), ''), nullif(regexp_extract(url, '(?:/pages/(\\d+)/|[?&]pageId=(\\d+))', 2), '')) page_id from links where regexp_matches(url, '/pages/\\d+/|[?&]pageId=\\d+')",
    "url_parts": f"""
with u as (select distinct url from links where url is not null), p as (select url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*:(//)', '\\1') r from u),
q as (select url, lower(regexp_extract(r, '^//([^/]*)', 1)) host, regexp_replace(r, '^//[^/]*', '') path from p)
select url, host, path, {_DASH("regexp_replace(regexp_extract(path, '([^/]*)$', 1), '([^.])\\.[^./]*$', '\\1')")} slug from q
""",
    "resolved_by_key": f"""
with {_D}, l as (select distinct link_id, name, url from links where url is not null and (regexp_matches(url, '^(?i:https?)://') or starts_with(url, '/'))),
ids as (select page_id, max(name) target from d where page_id <> '' group by 1), urls as (select {_NORM('url')} u, max(name) target from d where url <> '' group by 1),
r as (select l.name, coalesce(i.target, u.target) target, case when i.target is not null then 1 when u.target is not null then 2 end rule from l
  left join ids i on i.page_id = {_PAGE('l.url', _HOSTS)} left join urls u on u.u = {_NORM('l.url')} where l.url not in (select name from d))
select rule::bigint rule, count(*) n, count(*) filter (where name = target) n_self from r where rule is not null group by 1
""",
    "exact_duplicates": "select sha1(text) sha1, count(*) n, min(doc_id) first_doc from documents group by 1",
    "first_of_equal": "select min(doc_id) doc_id, sha1(text) sha1 from documents group by 2",
    "run_on_share": """
with w as (select doc_no, list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '') w from docs where body is not null)
select doc_no, round(case when len(w) < 200 then 0 else len(list_filter(w, lambda x: length(x) > 25 and not regexp_matches(x, '[/:%@=?#\\\\_+~|<>\\[\\]{}*\\p{Nd}]') and length(regexp_replace(x, '[^\\p{L}]', '', 'g')) >= 20))::double / len(w) end, 6) share from w
""",
    "body_gate": """
with b as (select doc_no, strlen(body) bytes, regexp_matches(body, '!\\[[^\\]]*\\]\\([^)]*assets/') pic,
  length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '(?s)\\A---\\n.*?\\n---\\n', ''), '(?s)\\n-{3,}\\s*\\n+#+ (?:Links found on this page|Links found in this document|Посилання, знайдені на цій сторінці|Посилання, знайдені в цьому документі).*', ''), '(?m)^#.*$', '', 'g'), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) n from docs where body is not null)
select doc_no, n n_body, bytes >= 8192 and not pic and n < 200 rejected from b
""",
    "repeated_lines": "select doc_no, line, count(*) n from (select doc_no, unnest(string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10))) line from docs) where line <> '' group by 1, 2 having count(*) >= 3",
    "dashed_titles": f"select doc_no, {_DASH('coalesce(frontmatter.title, name)')} slug from docs",
    "free_names": f"with s as (select doc_no, {_DASH('coalesce(frontmatter.title, name)')} slug from docs), r as (select *, row_number() over (partition by slug order by doc_no) - 1 k from s) select doc_no, slug || case when k > 0 then '-' || k else '' end || '.md' as name from r",
    "unexpanded_macros": "select original_id, len(regexp_extract_all(body, '\\$body\\b')) n from originals where body is not null and len(regexp_extract_all(body, '\\$body\\b')) > 0",
    "document_by_id": f"with {_D} select page_id, min(name) as name from d where page_id is not null group by 1",
    "orphan_cards": f"with {_D} select card_id::varchar card from cards where source_id is null or source_id not in (select page_id from d where page_id is not null)",
    "history_changes": f"""
with {_SNAP}, u as ({_UNITS('a', -1)} union all {_UNITS('b', 1)}), n as (select name, unit, sum(n) n from u group by 1, 2 having sum(n) <> 0)
select name, sum(greatest(n, 0))::bigint added, sum(greatest(-n, 0))::bigint removed from n group by 1
""",
    "snapshot_changes": f"with {_SNAP} select name, 'changed' change from s where a <> b",
    "incremental_new": "with h as (select name, sha1(body) h, loaded_at from docs) select name from h where loaded_at >= timestamptz '2024-07-01 00:00:00+00' and (h is null or h not in (select h from h where loaded_at < timestamptz '2024-07-01 00:00:00+00' and h is not null))",
    "stale_topics": f"with {_D} select distinct topic from cards where source_id in (select page_id from d where synced_at >= timestamptz '2024-10-01 00:00:00+00')",
    "pruned_history": "with g as (select base_key as name, synced_at, min(doc_no) doc_no from docs group by 1, 2) select name, doc_no from g qualify row_number() over (partition by name order by synced_at desc) <= 10",
    "recent_changes": "with g as (select base_key as name, synced_at, count(*) added from docs group by 1, 2), l as (select name, max(synced_at) s, arg_max(added, synced_at) added from g group by 1) select name, added, 0::bigint removed from l order by s desc, name limit 5",
    "base_report": "select base_key, lang, count(*) n_docs, sum(n)::bigint n_chars, grouping(base_key, lang) depth from (select base_key, coalesce(lang, 'none') lang, length(body) n from docs) group by rollup (base_key, lang)",
    "late_rows": "select strftime(synced_at at time zone 'UTC', '%Y-%m') as month, count(*) n, count(*) filter (where loaded_at > synced_at + interval 7 days) n_late from docs group by 1",
    "event_windows": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) n, round(sum(value), 3) total from events group by 1, 2",
    "order_report": "select n_name, year(o_orderdate) as year, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, count(*) n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2",
    "outcome_changes": f"with {_D} select coalesce(a.page_id, b.page_id) page_id, case when a.page_id is null then 'registry only' when b.page_id is null then 'documents only' else 'both' end state from (select distinct page_id from d where page_id is not null) a full join (select distinct page_id from registry) b on a.page_id = b.page_id",
}
