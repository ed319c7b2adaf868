"""References to records that do not exist.

References and parent keys are put into the same partitions, sorted by key and time and merged in one pass
over both streams.  A parent row is valid in ``[start, end)``.  Running over the merged stream of a key, the
largest end among the starts seen so far tells whether a reference finds a valid parent, so no interval is
ever collected.

A key may hold a third of all rows.  Therefore a key's stream is cut into time segments (days): the largest
end of earlier segments is carried into each segment by a first pass over pre-aggregated rows, one per key
and day, after which the segments of one key merge independently of each other.  A segment with more references
than ``HOT`` (a bulk load, or references without a time, which all fall on the earliest day) is dealt to parts by
hash; each part merges with the segment's parent rows, of which it gets a copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweft.functions.urls import canonical_url, plain_id, url_host
from inkweft.runtime import small, stored

#: References of one key and day from which on they are dealt to parts of about this size.
HOT = 500_000
_FAR = "timestamp'9999-12-31 00:00:00'"
_EARLY = "timestamp'0001-01-02 00:00:00'"


def reference_status(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Add ``status`` to each reference: held, late, deleted or missing.

    refs: ``key`` STRING, ``at`` TIMESTAMP and any columns to carry.  parents: ``key``, ``start``, ``end``.

    * held: a parent row has start <= at and (end null or end > at);
    * missing: the key has no parent row at all;
    * late: every parent row of the key starts after ``at``;
    * deleted: some row had started, none is valid any more.

    A null key in refs is no reference and is left out.  Parent rows with a null key or start are ignored.  A
    null ``at`` precedes every start, so it is late or missing.  Repeated rows on either side change nothing
    but the number of output rows (one for each input reference).  Other columns of refs come through.
    """
    carried = [c for c in refs.columns if c not in ("key", "at")]
    day = lambda c: F.unix_date(F.to_date(c))
    ref = refs.where(F.col("key").isNotNull()).select(
        F.col("key").alias("_key"), F.coalesce("at", F.expr(_EARLY)).alias("_at"), F.col("at").alias("_own_at"), F.struct(*carried or [F.lit(1).alias("_one")]).alias("_row")
    ).withColumn("_day", day(F.col("_at")))
    own = parents.where(F.col("key").isNotNull() & F.col("start").isNotNull()).select(
        F.col("key").alias("_key"), F.col("start").alias("_at"), F.coalesce("end", F.expr(_FAR)).alias("_end")
    ).withColumn("_day", day(F.col("_at")))

    # First pass: one row for each key and day, whatever the number of rows behind it.
    days = stored(
        own.groupBy("_key", "_day").agg(F.max("_end").alias("_end"), F.min("_at").alias("_first"))
        .unionByName(ref.groupBy("_key", "_day").agg(F.count("*").alias("_n")), allowMissingColumns=True)
        .groupBy("_key", "_day").agg(F.max("_end").alias("_end"), F.min("_first").alias("_first"), F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"))
    )
    before = Window.partitionBy("_key").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carry = days.select(
        "_key", "_day", F.max("_end").over(before).alias("_carry"), F.min("_first").over(Window.partitionBy("_key")).alias("_first")
    )
    segment = ["_key", "_day"]
    hot = days.where(F.col("_n") > HOT).select("_key", "_day", F.ceil(F.col("_n") / HOT).cast("int").alias("_parts"))
    if hot.limit(1).count():
        segment = ["_key", "_day", "_part"]
        split = small(hot)
        copies = lambda df: df.join(split, ["_key", "_day"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        ref = ref.join(split, ["_key", "_day"], "left").withColumn("_part", F.pmod(F.xxhash64("_row", "_at"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
        own, carry = copies(own), copies(carry)

    # Second pass: linear merge of both streams inside each segment.
    merged = ref.withColumn("_kind", F.lit(1)).unionByName(own.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    run = Window.partitionBy(*segment).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = merged.join(carry.hint("merge"), segment)
    seen = merged.withColumn("_until", F.greatest(F.max("_end").over(run), "_carry")).where("_kind = 1")
    status = (
        F.when(F.col("_first").isNull(), "missing")
        .when(F.col("_until").isNull(), "late")
        .when(F.col("_until") > F.col("_at"), "held")
        .otherwise("deleted")
    )
    return seen.select(F.col("_key").alias("key"), F.col("_own_at").alias("at"), *[F.col(f"_row.`{c}`").alias(c) for c in carried], status.alias("status"))


def page_references(docs: DataFrame, cards: DataFrame, links: DataFrame, bases: DataFrame) -> DataFrame:
    """References of the document base: ``ref_table, ref_id, field, key, at``; ids and urls share no key."""
    host = small(bases.select(F.col("base_key").alias("_base"), F.lower("host").alias("_host")).where("_base is not null").dropDuplicates(["_base"]))
    known = small(bases.select(F.lower("host").alias("_known")).where("_known is not null").distinct())

    def ids(df, name, key, value, at):
        return df.select(F.lit(name).alias("ref_table"), F.col(key).cast("bigint").alias("ref_id"), F.lit("source_id").alias("field"), F.concat(F.lit("i:"), plain_id(value)).alias("key"), F.col(at).alias("at")).where("key is not null")

    def urls(df, name, key, value, field, at):
        own = df.select(F.lit(name).alias("ref_table"), F.col(key).cast("bigint").alias("ref_id"), F.lit(field).alias("field"), F.col("base_key").alias("_base"), F.trim(value).alias("_url"), F.col(at).alias("at")).where("_url is not null")
        own = own.join(host, "_base", "left").withColumn("key", canonical_url(F.col("_url"), F.col("_host")))
        own = own.where("key is not null").withColumn("_known", url_host(F.concat(F.lit("https://"), "key"))).join(known, "_known", "left_semi")
        return own.select("ref_table", "ref_id", "field", F.concat(F.lit("u:"), "key").alias("key"), "at")

    doc_id, doc_url = F.col("frontmatter.source_id"), F.col("frontmatter.source_url")
    return (
        ids(docs, "docs", "doc_no", doc_id, "synced_at")
        .unionByName(ids(cards, "cards", "card_id", F.col("source_id"), "written_at"))
        .unionByName(urls(docs, "docs", "doc_no", doc_url, "source_url", "synced_at"))
        .unionByName(urls(links, "links", "link_id", F.col("url"), "url", "seen_at"))
    )


def page_parents(registry: DataFrame) -> DataFrame:
    """Validity intervals of both kinds of key: ``key, start, end``."""
    period = [F.col("registered_at").alias("start"), F.col("removed_at").alias("end")]
    return registry.select(F.concat(F.lit("i:"), plain_id(F.col("page_id"))).alias("key"), *period).unionByName(
        registry.select(F.concat(F.lit("u:"), canonical_url(F.col("url"), F.lit(None).cast("string"))).alias("key"), *period)
    )


def orphan_references(docs: DataFrame, cards: DataFrame, links: DataFrame, registry: DataFrame, bases: DataFrame) -> DataFrame:
    """Dangling references: ``ref_table, period, ref_id, field, status``, each once; period is the UTC month."""
    state = reference_status(page_references(docs, cards, links, bases), page_parents(registry)).where("status <> 'held'")
    return state.select("ref_table", F.date_format("at", "yyyy-MM").alias("period"), "ref_id", "field", "status").distinct()
