"""Splitting texts above a size limit at natural boundaries.

The possible cuts of a text are the beginnings of its white space: after a paragraph, a line, a sentence or a
word.  A sparse table over the strengths of these boundaries gives the strongest one of any window in two
lookups, the rightmost if several are as strong.  For each piece the window is the permissible second half of
the limit; if it holds no boundary, the first half is asked; if that holds none either, the overlap is given up
and the whole window asked again; only a stretch longer than the limit is cut inside, and keeps its overlap.  The next piece begins
at the first word within the overlap behind the cut.

All texts of a slice are cut in step: one sparse table over the slice and one round of lookups for each piece
number, so no Python loop runs over characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweft.runtime import arrow_rows, small

CUTS = np.array(["forced", "word", "sentence", "line", "paragraph", "end"])
_SPACE = (9, 10, 13, 32)
_STOPS = np.array([ord(c) for c in ".!?…:;"], dtype=np.uint32)
_CLOSERS = np.array([ord(c) for c in "\"'”’»)]"], dtype=np.uint32)
_SLICE = 1_000_000


class RangeMax:
    """Sparse table: index of the largest value of a range, the rightmost of equals."""

    def __init__(self, values: np.ndarray, longest: int):
        key = (values.astype(np.int64) << 40) | np.arange(len(values), dtype=np.int64)
        self.levels = [key]
        while (1 << len(self.levels)) <= min(longest, len(values)):
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.maximum(last[:-half], last[half:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each pair with lo <= hi the index; -1 for an empty range."""
        out = np.full(len(lo), -1, dtype=np.int64)
        length = hi - lo + 1
        level = np.where(length > 0, np.log2(np.maximum(length, 1)).astype(np.int64), -1)
        for k in np.unique(level[level >= 0]):
            at = np.flatnonzero(level == k)
            table = self.levels[k]
            out[at] = np.maximum(table[lo[at]], table[hi[at] - (1 << k) + 1]) & ((1 << 40) - 1)
        return out


def _boundaries(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin of each run of white space, its strength, and the run's end."""
    space = np.isin(code, _SPACE)
    edge = np.diff(space.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return begin, begin, end
    lines = np.add.reduceat(np.append(code == 10, False).astype(np.int64), np.ravel(np.column_stack([begin, end])))[::2]
    before = code[np.maximum(begin - 1, 0)]
    second = code[np.maximum(begin - 2, 0)]
    stop = np.isin(before, _STOPS) | (np.isin(before, _CLOSERS) & np.isin(second, _STOPS))
    return begin, np.select([lines >= 2, lines == 1, stop], [4, 3, 2], 1), end


def cut_slice(texts: list[str], limits: list[int], overlaps: list[int]) -> tuple[np.ndarray, ...]:
    """Pieces of the texts: text number, begin, end (in characters) and the kind of cut at the end."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(size + 1)])[:-1]  # a line break parts the texts
    code = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begin, strength, end = _boundaries(code)
    limit, overlap = np.array(limits, dtype=np.int64), np.array(overlaps, dtype=np.int64)
    index = RangeMax(strength, int(limit.max(initial=1)) + 1)
    stop = base + size

    def strongest(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        i, j = np.searchsorted(begin, lo, "left"), np.searchsorted(begin, hi, "right") - 1
        return index(i, j)

    def skip(at: np.ndarray) -> np.ndarray:
        """The first character at or after ``at`` that isn't white space."""
        i = np.searchsorted(end, at, "right")
        inside = (i < len(end)) & (begin[np.minimum(i, len(begin) - 1)] <= at) if len(begin) else np.zeros(len(at), dtype=bool)
        return np.where(inside, end[np.minimum(i, len(end) - 1)], at) if len(begin) else at

    own = np.arange(len(texts))
    start, cut = base.copy(), base.copy()
    out: list[tuple[np.ndarray, ...]] = []
    while len(own):
        top, most, last = stop[own], limit[own], start + limit[own]
        to, kind = top.copy(), np.full(len(own), 5)
        long = np.flatnonzero(last < top)
        if len(long):
            s, m, c = start[long], most[long], cut[long]
            got = strongest(np.maximum(c + 1, s + (m + 1) // 2), s + m)
            miss = np.flatnonzero(got < 0)
            got[miss] = strongest(np.maximum(c[miss], s[miss]) + 1, s[miss] + m[miss] // 2)
            miss = np.flatnonzero(got < 0)
            if len(miss):  # give up the overlap, unless that helps nothing
                bare = skip(np.maximum(c[miss], s[miss]))
                got[miss] = strongest(bare + 1, bare + m[miss])
                s[miss] = np.where((got[miss] >= 0) | (bare + m[miss] >= top[long][miss]), bare, s[miss])
            where = np.where(got >= 0, begin[got] if len(begin) else 0, s + m)
            what = np.where(got >= 0, strength[got] if len(begin) else 0, 0)
            ends = s + m >= top[long]  # without the overlap the rest fits
            start[long] = s
            to[long] = np.where(ends, top[long], where)
            kind[long] = np.where(ends, 5, what)
        rest = to > start
        out.append((own[rest], start[rest] - base[own[rest]], to[rest] - base[own[rest]], kind[rest]))
        go = to < top
        own, to, prior = own[go], to[go], start[go]
        back = np.maximum(to - overlap[own], prior + 1)
        # The first word that begins within the overlap; none: right behind the cut.
        i = np.searchsorted(end, back, "left")
        word = end[np.minimum(i, len(end) - 1)] if len(end) else to
        hit = (i < len(end)) & (word < to) & (overlap[own] > 0)
        inside = (overlap[own] > 0) & ~hit & (kind[go] == 0)  # within a forced stretch characters are repeated
        start = np.where(hit, word, np.where(inside, back, skip(to)))
        cut = to
        left = start < stop[own]
        own, start, cut = own[left], start[left], cut[left]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, dtype=np.int64) for _ in range(4))


def split_texts(df: DataFrame, id_col: str, text_col: str, limit_col: str, overlap_col: str, with_text: bool = True) -> DataFrame:
    """``_id, n_chars, limit, piece, begin, end, cut[, text]``: the pieces of each text.

    limit: characters of a piece at most, below 1 or null counts as 420.  overlap: share of the limit repeated,
    null counts as 0.25, else held to 0 .. 0.9.  Null and empty texts have no piece; a text of white space
    within the limit is one piece; one within the limit is one piece, whole.  ``cut`` says what the end of the
    piece is: end, paragraph, line, sentence, word or forced.  Repeated rows are split each by itself.
    """
    rows = df.select(
        F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"),
        F.when(F.col(limit_col) >= 1, F.col(limit_col)).otherwise(420).cast("bigint").alias("_limit"),
        F.least(F.greatest(F.coalesce(F.col(overlap_col).cast("double"), F.lit(0.25)), F.lit(0.0)), F.lit(0.9)).alias("_overlap"),
    ).where("_text <> ''")

    def run(batch: pa.RecordBatch) -> pa.Table:
        ids, texts, limits, shares = (batch.column(i).to_pylist() for i in range(4))
        tables, i = [], 0
        while i < len(ids):
            j, chars = i, 0
            while j < len(ids) and (j == i or chars + len(texts[j]) <= _SLICE):
                chars += len(texts[j])
                j += 1
            own, begin, end, kind = cut_slice(texts[i:j], limits[i:j], [int(n * s) for n, s in zip(limits[i:j], shares[i:j])])
            order = np.lexsort((begin, own))
            own, begin, end, kind = own[order], begin[order], end[order], kind[order]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            number = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
            at = own + i
            columns = {
                "_id": pa.array([ids[x] for x in at], pa.int64()), "n_chars": pa.array([len(texts[x]) for x in at], pa.int64()), "limit": pa.array([limits[x] for x in at], pa.int64()),
                "piece": pa.array(number, pa.int32()), "begin": pa.array(begin, pa.int64()), "end": pa.array(end, pa.int64()), "cut": pa.array(CUTS[kind].tolist(), pa.string()),
            }
            if with_text:
                columns["text"] = pa.array([texts[x][b:e] for x, b, e in zip(at, begin, end)], pa.string())
            tables.append(pa.table(columns))
            i = j
        return pa.concat_tables(tables)

    schema = "_id bigint, n_chars bigint, limit bigint, piece int, begin bigint, end bigint, cut string"
    return arrow_rows(rows, run, schema + ", text string" * with_text)


def split_by_base(docs: DataFrame, bases: DataFrame, with_text: bool = True) -> DataFrame:
    """Pieces of each docs.body under the settings of its base; a doc without a known base takes the defaults."""
    setting = bases.select(F.col("base_key").alias("_base"), F.col("search.chunk_chars").alias("_chars"), F.col("search.chunk_overlap").alias("_share")).where("_base is not null").groupBy("_base").agg(F.min("_chars").alias("_chars"), F.min("_share").alias("_share"))
    rows = docs.select("doc_no", "body", F.col("base_key").alias("_base")).join(small(setting), "_base", "left")
    return split_texts(rows, "doc_no", "body", "_chars", "_share", with_text).withColumnRenamed("_id", "doc_no")
