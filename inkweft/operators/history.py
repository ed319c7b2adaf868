"""Change detection between snapshots, histories, stale topics and the status report."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweft.functions import text as T
from inkweft.runtime import arrow_rows


def work_list(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files to convert: neither name, time and size nor name and digest are as in the manifest."""
    same = manifest.select("name", "mtime_ns", "size")
    return files.join(same, ["name", "mtime_ns", "size"], "left_anti").join(manifest.select("name", "sha1"), ["name", "sha1"], "left_anti")


def snapshot_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """``name, change``: added, removed or changed between two snapshots (``name, body``)."""
    both = before.select("name", F.sha1(F.col("body").cast("binary")).alias("_a"), F.lit(True).alias("_was")).join(now.select("name", F.sha1(F.col("body").cast("binary")).alias("_b"), F.lit(True).alias("_is")), "name", "full")
    kind = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select("name", kind.alias("change")).where("change is not null")


def unit_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """``name, added, removed``: how many diff units came and went in each changed document, as multisets."""
    def units(df, sign):
        return df.select("name", F.explode(T.diff_units(F.col("body"))).alias("unit")).groupBy("name", "unit").agg(F.sum(F.lit(sign)).alias("n"))

    net = units(before, -1).unionByName(units(now, 1)).groupBy("name", "unit").agg(F.sum("n").alias("n")).where("n <> 0")
    return net.groupBy("name").agg(F.sum(F.greatest("n", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed"))


def unified_diffs(before: DataFrame, now: DataFrame) -> DataFrame:
    """``name, diff, added, removed`` of the documents in both snapshots whose text differs, one unit of context."""
    pairs = before.select("name", T.diff_units(F.col("body")).alias("a")).join(now.select("name", T.diff_units(F.col("body")).alias("b")), "name").where("a <> b")

    def run(batch: pa.RecordBatch) -> pa.Table:
        out: dict[str, list] = {"name": [], "diff": [], "added": [], "removed": []}
        for name, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rows = list(difflib.unified_diff(a, b, "before", "after", n=1, lineterm=""))
            body = rows[2:]
            out["name"].append(name)
            out["diff"].append("\n".join(rows))
            out["added"].append(sum(r.startswith("+") for r in body))
            out["removed"].append(sum(r.startswith("-") for r in body))
        return pa.table({"name": pa.array(out["name"], pa.string()), "diff": pa.array(out["diff"], pa.string()), "added": pa.array(out["added"], pa.int32()), "removed": pa.array(out["removed"], pa.int32())})

    return arrow_rows(pairs, run, "name string, diff string, added int, removed int")


def prune_history(history: DataFrame, keep: int = 10) -> DataFrame:
    """The newest entries of each document (``name, ts``)."""
    return history.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy(F.col("ts").desc()))).where(F.col("_r") <= keep).drop("_r")


def recent_changes(history: DataFrame, top: int = 5) -> DataFrame:
    """``name, ts, added, removed``: the newest entry of the documents changed last."""
    last = history.groupBy("name").agg(F.max_by(F.struct("ts", "added", "removed"), "ts").alias("h"))
    return last.select("name", "h.ts", "h.added", "h.removed").orderBy(F.col("ts").desc(), "name").limit(top)


def stale_topics(cards: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Topics with a card whose source, named in its first 400 characters, was rebuilt (``name``)."""
    source = F.regexp_extract(F.substring("text", 1, 400), r"source:\s*\S*?([\w.-]+\.md)", 1)
    return cards.withColumn("name", source).join(rebuilt.select("name"), "name", "left_semi").select("topic").distinct()


def heal_sources(cards: DataFrame, docs: DataFrame) -> DataFrame:
    """Cards with their ``source:`` line pointing to the current file of the declared id (docs: ``page_id, name``)."""
    by_id = docs.where("page_id <> ''").groupBy("page_id").agg(F.min("name").alias("_name"))
    head = F.substring("text", 1, 400)
    old = F.regexp_extract(head, r"source:\s*\S*?([\w.-]+\.md)", 1)
    own = cards.withColumn("_id", T.declared_id(head)).withColumn("_old", old)
    own = own.join(by_id.withColumnRenamed("page_id", "_id"), "_id", "left")
    moved = F.col("_name").isNotNull() & (F.col("_old") != "") & (F.col("_old") != F.col("_name"))
    return own.withColumn("text", F.when(moved, F.replace("text", F.col("_old"), F.col("_name"))).otherwise(F.col("text"))).select(*cards.columns)


def align_assets(docs: DataFrame, moves: DataFrame) -> DataFrame:
    """Texts with the picture folder of a renamed document (``name, old_folder, new_folder``) replaced; an empty old
    folder stands for pictures that lie in none yet."""
    own = docs.join(moves, "name", "left")
    old = F.concat(F.lit("](assets/"), F.when(F.col("old_folder") != "", F.concat("old_folder", F.lit("/"))).otherwise(""))
    new = F.replace("body", old, F.concat(F.lit("](assets/"), "new_folder", F.lit("/")))
    return own.withColumn("body", F.coalesce(new, "body")).select(*docs.columns)


def status(docs: DataFrame, manifest: DataFrame, stale: DataFrame, missing: DataFrame, top: int = 8, history: DataFrame | None = None) -> DataFrame:
    """``item, n, detail``: counts of documents, failures, stale topics, the pages missed most, and the documents changed
    last (n: units added and removed)."""
    count = lambda df, item: df.agg(F.lit(item).alias("item"), F.count("*").alias("n"), F.lit(None).cast("string").alias("detail"))
    lost = missing.orderBy(F.col("n_labels").desc(), "key").limit(top).select(F.lit("missing page").alias("item"), F.col("n_labels").alias("n"), F.col("key").alias("detail"))
    rows = count(docs, "documents").unionByName(count(manifest.where("failed is not null"), "failed")).unionByName(count(stale, "stale topics")).unionByName(lost)
    if history is None:
        return rows
    return rows.unionByName(recent_changes(history).select(F.lit("changed").alias("item"), (F.col("added") + F.col("removed")).cast("bigint").alias("n"), F.col("name").alias("detail")))


def first_lines(log: DataFrame, most: int = 12) -> DataFrame:
    """The first lines of a log (``pos, line``) and how many more there are."""
    more = log.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("n")).where("n > 0").select(F.lit(most + 1).alias("pos"), F.concat(F.lit("… and "), "n", F.lit(" more")).alias("line"))
    kept = log.orderBy("pos").limit(most)
    return kept.select(F.row_number().over(Window.orderBy("pos")).alias("pos"), "line").unionByName(more)
