"""Retrieval cases generated from the corpus, and how well the search does on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweft.config import Settings
from inkweft.functions import text as T
from inkweft.operators.index import Index
from inkweft.runtime import arrow_rows, durable, small


def pick_markers(passages: DataFrame) -> DataFrame:
    """Add ``marker, overlap``: of each passage the sentence (else the window) that has fewest of the words.

    passages: ``body, words`` and what else, which is kept.  Sentences of 25 to 200 characters come first; a passage without any is read in
    windows of 90 characters, 45 apart, of at least 40.  The first of equals wins; more than two words in common
    give no marker.
    """
    sentence = F.filter(F.transform(F.split("body", r"(?U)(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: (F.length(s) >= 25) & (F.length(s) <= 200))
    begins = F.sequence(F.lit(0), F.greatest(F.length("body") - 91, F.lit(0)), F.lit(45))
    window = F.filter(F.transform(begins, lambda b: F.trim(F.substr("body", b + 1, F.lit(90)))), lambda s: F.length(s) >= 40)
    own = F.when(F.size(sentence) > 0, sentence).otherwise(window)
    overlap = lambda s: F.size(F.filter("words", lambda w: F.contains(F.lower(s), w)))
    first = F.array_min(F.transform(own, lambda s, at: F.struct(overlap(s).alias("overlap"), at.alias("at"), s.alias("marker"))))
    return passages.withColumn("_m", first).withColumns({"marker": F.col("_m.marker"), "overlap": F.col("_m.overlap")}).drop("_m").where("overlap <= 2")


def _telling(index: Index) -> DataFrame:
    """``fid, name, seq, line_no, heading, density, weight, n, asked``: mean and sum of the stems' weights, how many there
    are, and the second to seventh most telling; by itself for each fragment, as all workers hold the terms."""
    terms = index.terms.select("token", "idf").toArrow().combine_chunks()
    words, idf = terms["token"].combine_chunks(), terms["idf"].to_numpy()
    place = np.empty(len(idf), np.int64)
    place[pc.sort_indices(terms, [("idf", "descending"), ("token", "descending")]).to_numpy()] = np.arange(len(idf))

    def run(batch: pa.RecordBatch) -> pa.Table:
        stems = batch["body_stems"]
        size = pc.list_value_length(stems).to_numpy(zero_copy_only=False).astype(np.int64)
        code, row = pc.index_in(pc.list_flatten(stems), words).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)
        weight = np.bincount(row, idf[code], len(size)) if len(row) else np.zeros(len(size))
        order = np.lexsort((place[code], row)) if len(row) else row
        rank = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        few = (rank >= 1) & (rank <= 6)
        ends = np.concatenate([[0], np.cumsum(np.clip(size - 1, 0, 6))]).astype(np.int32)
        asked = pa.ListArray.from_arrays(pa.array(ends), words.take(pa.array(code[order][few])))
        return pa.Table.from_batches([batch]).drop_columns(["body_stems"]).append_column("density", pa.array(weight / np.maximum(size, 1))).append_column("weight", pa.array(weight)).append_column("n", pa.array(size)).append_column("asked", asked)

    own = index.fragments.select("fid", "name", "seq", "line_no", "heading", "body_stems")
    told = arrow_rows(own, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[:-1]) + ", density double, weight double, n bigint, asked array<string>")
    return told.withColumns({"density": F.round("density", 9), "weight": F.round("weight", 9)})


def generate_cases(index: Index, settings: Settings, count: int = 20) -> DataFrame:
    """``question, marker, file, origin, heading``: cases from the most telling fragments.

    A fragment of at least 180 characters asks with its second to seventh most telling stems, in the words of its
    text; at least four words are needed.  Documents give a few cases each.
    """
    texts = index.texts.where(F.length("body") >= 180)
    # Texts come along with what is asked, never with each of their words.
    packed = _telling(index).where("n >= 6").join(texts, ["name", "seq"])
    short = F.transform(T.tokens(F.col("body")), lambda w: F.lower(w))
    words = F.slice(F.array_distinct(F.filter(short, lambda w: F.array_contains("asked", F.substring(w, 1, settings.stem_length)))), 1, 6)
    able = packed.withColumn("words", words).where(F.size("words") >= 4)
    marked = pick_markers(able).withColumn("_same", F.row_number().over(Window.partitionBy("name", "fid").orderBy("density"))).where("_same = 1")
    best = Window.partitionBy("name").orderBy(F.col("density").desc(), F.col("weight").desc(), F.col("fid"))
    most = max(2, count // max(index.titles.count(), 1) + 1)
    kept = marked.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= most).orderBy(F.col("density").desc(), F.col("weight").desc(), F.col("name").desc(), "fid").limit(count)
    return kept.select(F.array_join("words", " ").alias("question"), "marker", F.col("name").alias("file"), F.lit("generated").alias("origin"), F.substring("heading", 1, 70).alias("heading"))


def keep_handwritten(existing: DataFrame, generated: DataFrame) -> DataFrame:
    return existing.where(F.coalesce("origin", F.lit("")) != "generated").unionByName(generated, allowMissingColumns=True)


def markers_present(cases: DataFrame, docs: DataFrame, name: str = "name", text: str = "body") -> DataFrame:
    """Cases whose marker stands in their file, both flattened."""
    said = docs.select(F.col(name).alias("file"), T.plain(F.col(text), links=True).alias("_said"))
    return cases.join(said, "file").where(F.contains("_said", T.plain(F.col("marker"), links=True))).drop("_said")


def evaluate(cases: DataFrame, hits: DataFrame, texts: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """One row ``total, at1, at3, at5, any, right_document, pct1, tokens, skipped``: at which rank the marker is found.

    With ``docs`` (``name, body``) cases whose marker no longer stands in their file are skipped and only counted.

    cases: ``qid, marker, file``; hits: as the search gives them.  Percentages are whole numbers, rounded down.
    """
    every = cases.count()
    cases = cases if docs is None else durable(markers_present(cases, docs))
    shown = texts.join(small(hits), ["name", "seq"]).join(small(cases), "qid")
    found = F.contains(T.plain(F.col("body"), links=True), T.plain(F.col("marker"), links=True))
    per = shown.groupBy("qid").agg(F.min(F.when(found, F.col("rank"))).alias("rank"), F.max(F.when(F.col("rank") == 1, F.col("name") == F.col("file"))).alias("_doc"), F.sum(F.length("body")).alias("_chars"))
    own = cases.select("qid").join(per, "qid", "left")
    return own.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("rank") <= k).alias(f"at{k}") for k in (1, 3, 5)], F.count("rank").alias("any"), F.count_if(F.coalesce("_doc", F.lit(False))).alias("right_document"),
        F.expr("coalesce(count_if(rank <= 1) * 100 div nullif(count(*), 0), 0)").alias("pct1"), F.expr("coalesce(sum(_chars) div 4, 0)").alias("tokens"),
    ).withColumn("skipped", F.lit(every) - F.col("total"))
