"""Evaluation passages inside training documents, by winnowed fingerprints.

Every text is cut into runs of ``k`` words; of each window of ``w`` successive runs the one with the least
hash is kept.  Two texts that share a run of at least ``k + w - 1`` words keep a common fingerprint inside it,
so joining fingerprints misses no such passage.  Each hit is then extended to both sides over equal words and
counts if the whole shared run is long enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweft.llm.words import WordHasher, flatten, grams, words
from inkweft.runtime import arrow_rows, durable, fits, small

K, WINDOW = 8, 5


def winnow(flat: np.ndarray, offsets: np.ndarray, k: int = K, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions kept, as indexes into the flat array, and the hash of each run.

    Ties in a window go to the rightmost run.  A text with fewer than ``w`` runs keeps the least of them.
    """
    h, whole = grams(flat, offsets, k)
    n = len(flat)
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    runs = np.add.reduceat(np.append(whole, False).astype(np.int64), offsets[:-1]) if len(offsets) > 1 else np.zeros(0, dtype=np.int64)
    runs = np.where(np.diff(offsets) > 0, runs, 0)
    best, at = h.copy(), np.arange(n)
    for j in range(1, w):
        if j >= n:
            break
        inside = np.zeros(n, dtype=bool)
        inside[: n - j] = whole[j:] & (own[: n - j] == own[j:])
        moved = np.zeros(n, dtype=np.uint64)
        moved[: n - j] = h[j:]
        better = inside & (moved <= best)
        best = np.where(better, moved, best)
        at = np.where(better, np.arange(n) + j, at)
    # A window begins where w runs still fit; a shorter text has one window at its first run.
    full = np.zeros(n, dtype=bool)
    if n >= w:
        full[: n - w + 1] = whole[w - 1 :] & (own[: n - w + 1] == own[w - 1 :])
    full &= whole
    first = offsets[:-1][(runs > 0) & (runs < w)]
    full[first] = True
    return np.unique(at[full]), h


def fingerprints(df: DataFrame, id_col: str, text_col: str, k: int = K, w: int = WINDOW) -> DataFrame:
    """``_id, hash``: the distinct winnowed fingerprints of each text; none for null or short texts."""
    hasher = WordHasher()

    def run(batch: pa.RecordBatch) -> pa.Table:
        texts = batch.column(1).to_pylist()
        flat, offsets = flatten([hasher(words(t)) for t in texts])
        kept, h = winnow(flat, offsets, k, w)
        own = np.searchsorted(offsets, kept, side="right") - 1
        pairs = np.unique(np.rec.fromarrays([own, h[kept].view(np.int64)], names="o,h")) if len(kept) else np.rec.fromarrays([own, np.zeros(0, np.int64)], names="o,h")
        return pa.table({"_id": batch.column(0).take(pa.array(pairs.o.astype(np.int64))), "hash": pa.array(pairs.h, pa.int64())})

    own = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return arrow_rows(own, run, f"_id {own.schema['_id'].dataType.simpleString()}, hash bigint")


def longest_shared_run(a: list[str], b: list[str], k: int, least: int) -> int:
    """Words of the longest common run that is at least ``least`` long, by extending hits of ``k`` words; else 0."""
    where: dict[tuple, list[int]] = {}
    for j in range(len(b) - k + 1):
        where.setdefault(tuple(b[j : j + k]), []).append(j)
    best, done = 0, {}
    for i in range(len(a) - k + 1):
        for j in where.get(tuple(a[i : i + k]), ()):
            if done.get(i - j, -1) >= i:  # this diagonal has been extended beyond here
                continue
            s, e = 0, k
            while i - s > 0 and j - s > 0 and a[i - s - 1] == b[j - s - 1]:
                s += 1
            while i + e < len(a) and j + e < len(b) and a[i + e] == b[j + e]:
                e += 1
            done[i - j] = i + e
            best = max(best, s + e)
    return best if best >= least else 0


def leaked(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, least: int = K + WINDOW - 1) -> DataFrame:
    """``doc_id, item_id, n_words``: documents that hold a run of at least ``least`` words of an item.

    ``least`` must be at least ``K + WINDOW - 1``, from which winnowing misses nothing.  Null texts, texts
    shorter than ``least`` words and empty tables give no rows; a repeated id counts as one text for each of
    its rows and comes out once, with the longest run.  Rows with a null id are left out, for they cannot be
    reported.
    """
    if least < K + WINDOW - 1:
        raise ValueError("winnowing does not guarantee such short runs")
    d = docs.select(F.col(doc_id).alias("_id"), F.col(doc_text).alias("_text")).where("_id is not null and _text is not null")
    t = items.select(F.col(item_id).alias("_item"), F.col(item_text).alias("_passage")).where("_item is not null and _passage is not null")
    marks = durable(fingerprints(t, "_item", "_passage").withColumnRenamed("_id", "_item").distinct())
    pairs = durable(fingerprints(d, "_id", "_text").join(small(marks), "hash").select("_id", "_item").distinct())
    # Only the texts of documents that met an item go on: where their ids are few, no text crosses the network.
    hit = pairs.select("_id").distinct()
    near = d.join(F.broadcast(hit), "_id", "left_semi").join(F.broadcast(pairs), "_id") if fits(pairs) else d.join(pairs, "_id")
    both = near.join(small(t), "_item")
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((d, "_id"), (t, "_item"))]

    def extend(batch: pa.RecordBatch) -> pa.Table:
        doc, item = batch.column(0), batch.column(1)
        text, passage = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        cut: dict[str, list[str]] = {}
        n = []
        for a, b in zip(text, passage):
            if b not in cut:
                if len(cut) > 5000:
                    cut.clear()
                cut[b] = words(b)
            n.append(longest_shared_run(words(a), cut[b], K, least))
        keep = pa.array([x > 0 for x in n], pa.bool_())
        return pa.table({"doc_id": doc, "item_id": item, "n_words": pa.array(n, pa.int32())}).filter(keep)

    return arrow_rows(both.select("_id", "_item", "_text", "_passage"), extend, f"doc_id {kinds[0]}, item_id {kinds[1]}, n_words int").groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))
