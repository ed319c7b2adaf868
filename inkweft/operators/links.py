"""The link graph: extraction, resolving by key tables, rewriting, edges and missing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweft.functions import text as T

# A markdown link that is no picture.
LINK = r"(?<!!)\[([^\]]*)\]\(([^)\s]+)\)"
# Extensions that name a document.
SUFFIXES = ["md", "markdown", "rst", "txt", "text", "html", "htm", "pdf", "doc", "docx"]


def extract_links(docs: DataFrame, name: str = "name", text: str = "body") -> DataFrame:
    """``name, pos, label, url``: markdown links in order; pictures are none."""
    labels, urls = (F.regexp_extract_all(F.col(text), F.lit(LINK), F.lit(i)) for i in (1, 2))
    return docs.select(F.col(name).alias("name"), F.posexplode(F.arrays_zip(labels.alias("label"), urls.alias("url"))).alias("pos", "l")).select("name", "pos", "l.label", "l.url")


def link_kind(url: Column) -> Column:
    """anchor, scheme (mailto and the like), code (text that only looks like a link), else page."""
    path = F.regexp_replace(url, "[#?].*$", "")
    ext = F.lower(F.regexp_extract(path, r"[^/.]\.([A-Za-z0-9]+)$", 1))
    web = F.lower(url).rlike("^https?://")
    return (
        F.when(url.startswith("#"), "anchor").when(url.rlike(r"^(?i:[a-z][a-z0-9+.\-]*):") & ~web, "scheme")
        .when(web | url.startswith("/") | path.contains("/") | ext.isin(SUFFIXES), "page").otherwise("code")
    )


def key_tables(registry: DataFrame) -> DataFrame:
    """``kind, key, target`` with one target for each key.

    registry: ``name, page_id, url, source_file, title``.  Of several documents with a page id or url the last name
    wins, with a file name the first; an identifier of several documents names none of them.
    """
    ids = registry.where("page_id <> ''").groupBy(F.col("page_id").cast("string").alias("key")).agg(F.max("name").alias("target")).withColumn("kind", F.lit(1))
    urls = registry.where("url <> ''").groupBy(T.normal_url(F.col("url")).alias("key")).agg(F.max("name").alias("target")).withColumn("kind", F.lit(2))
    stems = registry.select("name", F.explode(F.array("name", F.coalesce("source_file", F.lit("")))).alias("_f")).select("name", T.dashed(T.without_extension(F.col("_f"))).alias("key"))
    names = stems.where("key <> ''").groupBy("key").agg(F.min("name").alias("target")).withColumn("kind", F.lit(3))
    found = F.array_distinct(F.concat(*[T.identifiers(F.col(c)) for c in ("source_file", "title", "name")]))
    tokens = registry.select("name", F.explode(found).alias("key")).groupBy("key").agg(F.min("name").alias("target"), F.max("name").alias("_other")).where("target = _other").select("key", "target").withColumn("kind", F.lit(4))
    return ids.unionByName(urls).unionByName(names).unionByName(tokens).select("kind", "key", "target")


def url_keys(links: DataFrame, hosts: list[str] | None = None) -> DataFrame:
    """``url, kind, place, key``: what a url may be found by, in the order of trying."""
    url = F.col("url")
    longest = F.array_sort(T.identifiers(url), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).otherwise(1))
    keys = F.array(
        F.struct(F.lit(1).alias("kind"), F.lit(0).alias("place"), T.page_id(url, hosts).alias("key")),
        F.struct(F.lit(2).alias("kind"), F.lit(0).alias("place"), T.normal_url(url).alias("key")),
        F.struct(F.lit(3).alias("kind"), F.lit(0).alias("place"), T.dashed(T.without_extension(T.url_tail(url))).alias("key")),
    )
    rest = F.transform(longest, lambda t, i: F.struct(F.lit(4).alias("kind"), i.alias("place"), t.alias("key")))
    return links.select("url").distinct().select("url", F.explode(F.concat(keys, rest)).alias("k")).select("url", "k.kind", "k.place", "k.key").where("key <> ''")


def resolve(links: DataFrame, registry: DataFrame, hosts: list[str] | None = None) -> DataFrame:
    """Add ``target`` and ``rule`` (1 page id, 2 url, 3 file name, 4 identifier) to ``name, pos, label, url``.

    The first key that is known decides, even if it leads back to the document itself: ``self`` is true then and
    the target null.  Links that are no pages stay unresolved.
    """
    keys = key_tables(registry).hint("merge")
    found = url_keys(links.where(link_kind(F.col("url")) == "page"), hosts).join(keys, ["kind", "key"]).groupBy("url").agg(F.min_by(F.struct("target", "kind"), F.struct("kind", "place")).alias("f"))
    own = links.join(registry.select(F.col("name").alias("url"), F.lit(True).alias("_local")), "url", "left").join(found, "url", "left")
    hit = F.when(F.col("_local").isNull(), F.col("f.target"))
    return own.select(*[c for c in links.columns], F.when(hit != F.col("name"), hit).alias("target"), F.when(hit.isNotNull(), F.col("f.kind")).alias("rule"), F.coalesce(hit == F.col("name"), F.lit(False)).alias("self"), F.coalesce("_local", F.lit(False)).alias("local"))


def is_internal(url: Column, hosts: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(h) for h in hosts]), lambda h: F.contains(url, h)) if hosts else F.lit(False)


def missing_key(url: Column, hosts: list[str] | None = None) -> Column:
    """What to call a page the base does not hold: page id, else the name in the url, else an identifier."""
    relative = ~url.rlike(r"^(?i:[a-z][a-z0-9+.\-]*):")
    tail = F.regexp_extract(F.regexp_replace(T.url_parts(url)[1], "/+$", ""), r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(tail, r"[^.]\.([A-Za-z0-9]+)$", 1))
    slug = T.dashed(F.when(ext.isin(SUFFIXES), T.without_extension(tail)).otherwise(tail))
    longest = F.element_at(F.array_sort(T.identifiers(url), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).otherwise(1)), 1)
    named = F.when((slug != "") & ~slug.rlike(r"^\d+$"), F.substring(slug, 1, 60)).otherwise(F.when(F.size(T.identifiers(url)) > 0, longest))
    return F.coalesce(T.page_id(url, hosts), F.when(relative | is_internal(url, hosts or []), named))


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct ``src, dst``."""
    return resolved.where("target is not null").select(F.col("name").alias("src"), F.col("target").alias("dst")).distinct()


def missing_pages(resolved: DataFrame, hosts: list[str] | None = None) -> DataFrame:
    """``key, n_labels, n_links``: unresolved pages with how many distinct labels and links name them."""
    lost = resolved.where(F.col("target").isNull() & ~F.col("self") & ~F.col("local") & (link_kind(F.col("url")) == "page"))
    key = lost.withColumn("key", missing_key(F.col("url"), hosts)).where("key is not null")
    return key.groupBy("key").agg(F.count_distinct(F.substring("label", 1, 60)).alias("n_labels"), F.count("*").alias("n_links"))


def rank_missing(missing: DataFrame, limit: int) -> DataFrame:
    return missing.orderBy(F.col("n_labels").desc(), "key").limit(limit)


def link_stats(resolved: DataFrame) -> DataFrame:
    """One row ``linked, self_links, n_edges``."""
    return resolved.agg(F.count("target").alias("linked"), F.count_if("self").alias("self_links"), F.count_distinct(F.when(F.col("target").isNotNull(), F.struct("name", "target"))).alias("n_edges"))


def anchor_hint(url: Column) -> Column:
    """The fragment of a url as a readable hint of at most 60 characters."""
    raw = F.regexp_extract(T.url_decode(url), "#(.+)$", 1)
    bare = F.trim(F.regexp_replace(F.replace(F.regexp_replace(raw, "[:~].*$", ""), F.lit("id-"), F.lit("")), r"(?U)[^\w\s-]", " "))
    return F.substring(bare, 1, 60)


def relink(docs: DataFrame, resolved: DataFrame, name: str = "name", text: str = "body") -> DataFrame:
    """``name, body`` with resolved links pointing to their documents; a link to the document itself becomes its label.

    The text is parted at its links once and put together again, so nothing outside the links changes and a second
    pass changes nothing.
    """
    hint = anchor_hint(F.col("url"))
    new = F.when(F.col("self"), F.col("label")).otherwise(F.concat(F.lit("["), "label", F.lit("]("), "target", F.when(hint != "", F.concat(F.lit(' "'), hint, F.lit('"'))).otherwise(""), F.lit(")")))
    swaps = resolved.where("target is not null or self").groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("pos", new.alias("new")))).alias("swaps"))
    # The text with a mark in place of each link gives the pieces between links.
    mark = "\ue000"
    rows = docs.select(F.col(name).alias("name"), F.col(text).alias("body")).join(swaps, "name", "left")
    between = F.split(F.regexp_replace("body", LINK, mark), mark)
    whole = F.regexp_extract_all("body", F.lit(f"({LINK})"), F.lit(1))
    joined = F.array_join(F.transform(between, lambda p, i: F.concat(p, F.coalesce(F.try_element_at("swaps", i), F.get("whole", i), F.lit("")))), "")
    return rows.withColumn("whole", whole).select("name", F.when(F.col("swaps").isNull() | F.col("body").contains(mark), F.col("body")).otherwise(joined).alias("body"))


def unchanged(now: DataFrame, before: DataFrame, hosts_now: list[str], hosts_before: list[str]) -> bool:
    """Whether the link pass can be left out: same names, same hosts, no later change (``name, mtime``)."""
    if sorted(hosts_now) != sorted(hosts_before):
        return False
    both = now.select("name", F.col("mtime").alias("_now")).join(before.select("name", F.col("mtime").alias("_before")), "name", "full")
    return not both.where(F.col("_now").isNull() | F.col("_before").isNull() | (F.col("_now") > F.col("_before"))).limit(1).count()


def graph_nodes(edges_: DataFrame) -> DataFrame:
    """``name, node``: names with an id that diagram text accepts."""
    both = edges_.select(F.col("src").alias("name")).unionByName(edges_.select(F.col("dst").alias("name"))).distinct()
    return both.select("name", F.regexp_replace("name", "[^A-Za-z0-9]", "_").alias("node"))


def graph_text(edges_: DataFrame) -> DataFrame:
    """``line``: the graph of documents as diagram text, in order: a head and a line for each edge ``src, dst``."""
    node = lambda c: F.concat(F.regexp_replace(c, "[^A-Za-z0-9]", "_"), F.lit('["'), F.regexp_replace(c, r"\.md$", ""), F.lit('"]'))
    rows = edges_.select("src", "dst").distinct().select(F.lit(1).alias("_k"), "src", "dst", F.concat(F.lit("  "), node("src"), F.lit(" --> "), node("dst")).alias("line"))
    head = edges_.sparkSession.createDataFrame([(0, "", "", "graph LR")], "_k int, src string, dst string, line string")
    return head.unionByName(rows).orderBy("_k", "src", "dst").select("line")


def shipped_pictures(refs: DataFrame, attachments: DataFrame) -> DataFrame:
    """``archive, src`` of each picture with the attachment ``member`` it means: by flattened path, else by base name (the first one).

    refs: ``archive, src``; attachments: ``archive, member, path`` as archives are unpacked.
    """
    flat = lambda c: F.regexp_replace(F.array_join(F.filter(F.split(T.url_decode(F.regexp_replace(c, "[?#].*$", "")), "[/\\\\]+"), lambda p: ~p.isin("", ".", "..")), "-"), "^-+", "")
    base = lambda c: F.regexp_extract(c, r"([^/\\]*)$", 1)
    one = attachments.groupBy("archive", "member").agg(F.min("member").alias("_by_path"))
    two = attachments.groupBy("archive", base(F.col("path")).alias("_base")).agg(F.min("member").alias("_by_name"))
    own = refs.select("archive", "src").distinct().withColumn("_flat", flat(F.col("src"))).withColumn("_base", base(T.url_decode(F.regexp_replace("src", "[?#].*$", ""))))
    return own.join(one.withColumnRenamed("member", "_flat"), ["archive", "_flat"], "left").join(two, ["archive", "_base"], "left").select("archive", "src", F.coalesce("_by_path", "_by_name").alias("member"))
