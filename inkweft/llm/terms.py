"""How distinctive each term is for the record that holds it.

One pass gathers, for each term, the records that hold it (df) and its occurrences (cf).  From them come

* the observed inverse document frequency, log2(N / df);
* what a Poisson model expects of a term of that collection frequency, -log2(1 - exp(-cf / N));
* their difference, the residual idf, which multiplied by the term's frequency in the record is its score:
  it rewards terms that concentrate in few records;
* the smoothed weight ln(1 + N / df), doubled for a term of the record's heading.

Records are brought together by id once and written to the shared folder with their terms as arrays.  Batches of
them are counted term by term before anything is shuffled, and a record's best terms are picked in its own batch
against a term table of checked size, so no row for each record and term is ever shuffled or sorted.  A term table
beyond the bound is joined by sort-merge, where adaptive execution splits a hot term's postings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweft.runtime import BROADCAST_ROWS, arrow_rows, durable, fits, small, stored


def _records(df: DataFrame, id_col: str, body_col: str, head_col: str | None) -> DataFrame:
    """``_id, _r(b, h)``: each record once; rows that repeat an id are one record, the least row, so that the choice
    never depends on order.  Null arrays count as empty."""
    words = lambda c: F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")) if c else F.array().cast("array<string>")
    return df.select(F.col(id_col).alias("_id"), F.struct(words(body_col).alias("b"), words(head_col).alias("h")).alias("_r")).groupBy("_id").agg(F.min("_r").alias("_r"))


def postings(records: DataFrame) -> DataFrame:
    """``_id, term, tf, in_head``: each record's distinct terms.  Null terms count as absent; empty terms are terms."""
    marked = lambda c, head: F.transform(F.col(f"_r.{c}"), lambda w: F.struct(w.alias("term"), F.lit(head).alias("head")))
    rows = records.select("_id", F.explode(F.concat(marked("b", False), marked("h", True))).alias("w")).where("w.term is not null")
    return rows.groupBy("_id", F.col("w.term").alias("term")).agg(F.count("*").alias("tf"), F.bool_or("w.head").alias("in_head"))


def _distinct(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, term code, tf and in_head of each distinct term of each record of ``_id, b, h``, and the terms."""
    parts, rows, heads = [], [], []
    for k in (1, 2):
        own = batch.column(k)
        parts.append(own.flatten())
        rows.append(np.repeat(np.arange(len(own)), pc.list_value_length(own).to_numpy(zero_copy_only=False)))
        heads.append(np.full(len(parts[-1]), k == 2))
    words = pa.concat_arrays(parts).dictionary_encode()
    row, head, there = np.concatenate(rows), np.concatenate(heads), words.indices.is_valid().to_numpy(zero_copy_only=False)
    code = words.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    size = max(len(words.dictionary), 1)
    key, place, tf = np.unique(row[there] * size + code[there], return_inverse=True, return_counts=True)
    return key // size, key % size, tf, np.bincount(place, weights=head[there], minlength=len(key)) > 0, words.dictionary


def term_statistics(records: DataFrame) -> DataFrame:
    """``term, df, cf``: records that hold a term and its occurrences, summed up by batch before the shuffle."""

    def count(batch: pa.RecordBatch) -> pa.Table:
        _, code, tf, _, terms = _distinct(batch)
        df, cf = np.bincount(code, minlength=len(terms)), np.bincount(code, weights=tf, minlength=len(terms))
        return pa.table({"term": terms, "df": pa.array(df, pa.int64()), "cf": pa.array(cf.astype(np.int64), pa.int64())})

    return arrow_rows(records, count, "term string, df bigint, cf bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")


def _weighed(terms: DataFrame, n: int) -> DataFrame:
    """``term, df, cf, ridf`` (not rounded) ``, light, heavy``: the weights outside and inside headings."""
    observed, expected = F.log2(F.lit(float(n)) / F.col("df")), -F.log2(1 - F.exp(-F.col("cf") / F.lit(float(max(n, 1)))))
    weight = F.log(1 + F.lit(float(n)) / F.col("df"))
    return terms.select("term", "df", "cf", (observed - expected).alias("ridf"), F.round(weight, 9).alias("light"), F.round(weight * 2.0, 9).alias("heavy"))


SCORED = "term string, tf bigint, in_head boolean, df bigint, cf bigint, ridf double, score double, weight double"


def _tables(df: DataFrame, id_col: str, body_col: str, head_col: str | None) -> tuple[DataFrame, DataFrame]:
    records = stored(_records(df, id_col, body_col, head_col).select("_id", "_r.b", "_r.h"))
    return records, durable(_weighed(term_statistics(records), records.count()))


def _joined(records: DataFrame, terms: DataFrame) -> DataFrame:
    rows = postings(records.select("_id", F.struct("b", "h").alias("_r"))).join(small(terms), "term")
    return rows.select("_id", "term", "tf", "in_head", "df", "cf", F.round("ridf", 9).alias("ridf"), F.round(F.col("tf") * F.col("ridf"), 9).alias("score"), F.when(F.col("in_head"), F.col("heavy")).otherwise(F.col("light")).alias("weight"))


def term_scores(df: DataFrame, id_col: str, body_col: str, head_col: str | None = None) -> DataFrame:
    """``_id, term, tf, in_head, df, cf, ridf, score, weight`` for every term of every record.

    N counts all records, those without terms too; rows with a null id are one record.  A table without records
    gives no rows.
    """
    return _joined(*_tables(df, id_col, body_col, head_col))


def top_terms(df: DataFrame, id_col: str, body_col: str, head_col: str | None, by: str, k: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """The k terms of each record with the largest ``by`` (score or weight), with their rank; ties go to the smaller
    term in code point order.

    A term table of up to ``most`` rows goes to the workers; a larger one is joined.
    """
    records, terms = _tables(df, id_col, body_col, head_col)
    if not fits(terms, most):
        order = Window.partitionBy("_id").orderBy(F.col(by).desc(), F.col("term").asc())
        return _joined(records, terms).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    known = terms.toArrow()
    place = {t: i for i, t in enumerate(known.column("term").to_pylist())}
    told = records.sparkSession.sparkContext.broadcast((place, {c: known.column(c).to_numpy() for c in ("df", "cf", "ridf", "light", "heavy")}))

    def pick(batch: pa.RecordBatch) -> pa.Table:
        row, code, tf, in_head, words = _distinct(batch)
        own, (place, known) = words.to_pylist(), told.value
        at = np.fromiter((place[w] for w in own), dtype=np.int64, count=len(own))[code]
        score, weight = np.round(tf * known["ridf"][at], 9), np.where(in_head, known["heavy"][at], known["light"][at])
        name = np.empty(len(own), dtype=np.int64)
        name[sorted(range(len(own)), key=own.__getitem__)] = np.arange(len(own))
        order = np.lexsort((name[code], -(score if by == "score" else weight), row))
        rank = np.arange(len(order)) - np.searchsorted(row[order], row[order]) + 1
        best = order[rank <= k]
        return pa.table({
            "_id": batch.column(0).take(pa.array(row[best])), "term": words.take(pa.array(code[best])), "tf": pa.array(tf[best], pa.int64()), "in_head": pa.array(in_head[best]),
            "df": pa.array(known["df"][at[best]], pa.int64()), "cf": pa.array(known["cf"][at[best]], pa.int64()), "ridf": pa.array(known["ridf"][at[best]]),
            "score": pa.array(tf[best] * known["ridf"][at[best]]), "weight": pa.array(weight[best]), "rank": pa.array(rank[rank <= k], pa.int32()),
        })

    found = arrow_rows(records, pick, f"_id {records.schema['_id'].dataType.simpleString()}, {SCORED}, rank int")
    return found.withColumn("ridf", F.round("ridf", 9)).withColumn("score", F.round("score", 9))
