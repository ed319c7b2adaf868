"""Which documents hold nearly all stems of a passage: containment of sets, exact and without a shuffle of pairs.

Stems become numbers by rarity.  Documents are dealt to rows and passages to columns of a grid; each cell holds its
part of both and compares them by itself, so what is shuffled is the numbered texts and the pairs found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from inkweft.config import Settings
from inkweft.runtime import arrow_rows, ship

#: Fragments in a row of the grid and passages in a column.
ROW, COLUMN, LEAST_ROWS = 450_000, 2_500_000, 6
#: A token in fewer windows, or first in fewer chunks, has its windows looked through one by one.
FEW_WINDOWS, FEW_CHUNKS = 256, 32
#: Pairs, bytes and words handled at a time.
PAIRS, BYTES, WORDS = 1 << 21, 1 << 25, 1 << 16


def _distinct(key: np.ndarray) -> np.ndarray:
    """Sorted and distinct; np.unique hashes first, which takes longer."""
    key = np.sort(key)
    return key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key


def _numbered(stems: pa.Array, vocabulary: pa.Array) -> pa.Array:
    """Lists of distinct numbers, the rarest first; stems outside the vocabulary are left out."""
    stems = pa.concat_arrays([stems]) if stems.offset else stems
    size = np.nan_to_num(pc.list_value_length(stems).to_numpy(zero_copy_only=False)).astype(np.int64)
    code = pc.index_in(pc.list_flatten(stems), vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    row, v = np.repeat(np.arange(len(size)), size), max(len(vocabulary), 1)
    key = _distinct((row * v + code)[code >= 0])
    ends = np.concatenate([[0], np.cumsum(np.bincount(key // v, minlength=len(size)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array((key % v).astype(np.uint16 if v < 1 << 16 else np.uint32)))


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blobs: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs]).combine_chunks()


def _dealt(df: DataFrame, column: str, vocabulary: pa.Array, cells: list[list[int]]) -> DataFrame:
    """``cell, blob``: the rows of ``df`` with numbers for ``column``, packed, for each cell of their ``part``."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        own = pa.Table.from_batches([batch])
        part = own["part"].to_numpy()
        own = own.drop_columns(["part", column]).append_column("codes", _numbered(batch[column], vocabulary))
        rows = [(c, blob) for k in np.unique(part) for blob in [_packed(own.filter(pa.array(part == k)))] for c in cells[k]]
        return pa.table({"cell": pa.array([c for c, _ in rows], pa.int32()), "blob": pa.array([b for _, b in rows], pa.binary())})

    return arrow_rows(df, run, "cell int, blob binary")


def _lists(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and ends of an array of lists."""
    return codes.values.to_numpy()[codes.offsets[0].as_py(): codes.offsets[-1].as_py()], codes.offsets.to_numpy().astype(np.int64) - codes.offsets[0].as_py()


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers from each begin on, size of them."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)


def _slabs(size: np.ndarray, most: int):
    """Slices of which each holds about ``most`` in all, at least one element."""
    ends, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield slice(a, b)
        a = b


def _signatures(tok: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two sets of 64 bits for each list, none of which is empty."""
    mixed = tok.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [np.bitwise_or.reduceat(np.uint64(1) << ((mixed >> np.uint64(s)) & np.uint64(63)), ends[:-1]) for s in (58, 40)]


def contained(ptok: np.ndarray, pend: np.ndarray, miss: np.ndarray, wtok: np.ndarray, wend: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Passages and windows (their numbers) of all pairs where at most ``miss`` numbers of the passage are absent.

    Numbers are below ``v``, rising and distinct in each list; no list is empty.  A passage is cut into ``miss + 1``
    chunks, dealt round: one of them stands in the window whole.  The windows of a chunk's rarest number are looked
    through by signatures where they are few, else by bits of a number's windows, 64 windows at once.  What is left is counted.
    """
    none = np.zeros(0, np.int64)
    if not len(wend) - 1 or not len(pend) - 1:
        return none, none
    df, nw, np_ = np.bincount(wtok, minlength=v), len(wend) - 1, len(pend) - 1
    begin = np.concatenate([[0], np.cumsum(df)])
    wrow = np.repeat(np.arange(nw, dtype=np.int32), np.diff(wend))
    post = wrow[np.argsort(wtok, kind="stable")]
    psig, wsig, size = _signatures(ptok, pend), _signatures(wtok, wend), np.diff(pend)
    rows = [(r := np.flatnonzero(miss >= j), np.full(len(r), j)) for j in range(int(miss.max(initial=0)) + 1)]
    p, at = np.concatenate([r for r, _ in rows]), np.concatenate([j for _, j in rows])
    first = ptok[pend[p] + at].astype(np.int64)
    order = np.lexsort((p, first))
    order = order[df[first[order]] > 0]
    p, at, first = p[order], at[order], first[order]
    chunks = np.bincount(first, minlength=v)
    light = (df[first] <= FEW_WINDOWS) | (chunks[first] < FEW_CHUNKS)
    found = []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        for s, t in zip(psig, wsig):
            near = np.bitwise_count(s[a] & ~t[b]) <= miss[a]
            a, b = a[near], b[near]
        found.append(b.astype(np.int64) * np_ + a)

    lp, lf = p[light], first[light]
    for s in _slabs(df[lf], PAIRS):
        n = df[lf[s]]
        keep(np.repeat(lp[s], n), post[_ranges(begin[lf[s]], n)])
    hp, hj, hf = p[~light], at[~light], first[~light]
    where = np.full(v, -1)
    for g in np.split(np.arange(len(hf)), np.flatnonzero(np.diff(hf)) + 1) if len(hf) else []:
        own, j = hp[g], hj[g]
        step, begins = miss[own] + 1, pend[own] + j
        tests = np.arange(1, int(((size[own] - 1 - j) // step).max()) + 1)
        # Positions past the end of a chunk take its last number again.
        col = np.minimum(tests[None, :], ((size[own] - 1 - j) // step)[:, None]) * step[:, None] + begins[:, None]
        asked = ptok[col].astype(np.int64)
        used = _distinct(asked.ravel())
        where[used] = np.arange(len(used))
        every = post[begin[hf[g[0]]]: begin[hf[g[0]] + 1]]
        wide = max(64, BYTES // max(len(used), 1) // 64 * 64)
        for lo in range(0, len(every), wide):
            mine = every[lo: lo + wide]
            n = wend[mine + 1] - wend[mine]
            pos, at_ = where[wtok[_ranges(wend[mine], n)]], np.repeat(np.arange(len(mine)), n)
            dense = np.zeros((max(len(used), 1), -(-len(mine) // 64) * 64), np.uint8)
            dense[pos[pos >= 0], at_[pos >= 0]] = 1
            bits = np.packbits(dense, axis=1, bitorder="little").view(np.uint64)
            full = np.packbits(np.arange(dense.shape[1]) < len(mine), bitorder="little").view(np.uint64)
            much = max(1, WORDS // bits.shape[1])
            for k in range(0, len(own), much):
                who, test = np.arange(k, min(k + much, len(own))), where[asked[k: k + much]]
                left = np.repeat(full[None, :], len(who), axis=0)
                for t in range(test.shape[1]):
                    left &= bits[test[:, t]]
                    if t % 3 == 2:
                        some = left.any(axis=1)
                        left, test, who = left[some], test[some], who[some]
                        if not len(who):
                            break
                r, w = np.nonzero(left)
                one, bit = np.nonzero(np.unpackbits(left[r, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                keep(own[who[r[one]]], mine[w[one] * 64 + bit])
        where[used] = -1
    pairs = _distinct(np.concatenate(found)) if found else none
    a, b = pairs % np_, pairs // np_
    words, enough = np.repeat(np.arange(nw, dtype=np.int64), np.diff(wend)) * v + wtok, np.zeros(len(a), bool)
    for s in _slabs(size[a], PAIRS):
        n = size[a[s]]
        key = np.repeat(b[s], n) * v + ptok[_ranges(pend[a[s]], n)]
        hit = words[np.minimum(np.searchsorted(words, key), len(words) - 1)] == key
        enough[s] = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64) >= n - miss[a[s]]
    return a[enough], b[enough]


def _windows(own: pa.Table, following: bool, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Numbers and ends of the windows, each one's document, and the documents' names."""
    name = own["name"].combine_chunks().dictionary_encode(null_encoding="encode")
    doc, seq = name.indices.to_numpy(), own["seq"].fill_null(-(1 << 31)).to_numpy()
    order = np.lexsort((seq, doc))
    tok, ends = _lists(own["codes"].combine_chunks())
    doc, n, ends = doc[order], np.diff(ends)[order], ends[:-1][order]
    tok = tok[_ranges(ends, n)]
    row = np.repeat(np.arange(len(doc)), n)
    key = row * v + tok
    if following:
        more = (row > 0) & (doc[row] == doc[np.maximum(row - 1, 0)])
        key = _distinct(np.concatenate([key, key[more] - v]))
    row = key // v
    held = _distinct(row)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(doc))[held])]).astype(np.int64)
    return (key % v).astype(tok.dtype), ends, doc[held], name.dictionary


def passages_in(passages: DataFrame, fragments: DataFrame, settings: Settings, following: bool) -> DataFrame:
    """``pid, name``: documents in one of whose windows at least nine tenths of a passage's stems stand.

    passages: ``pid, stems``; fragments: ``name, seq, stems``; following: a window is a fragment with the next one of
    its document, else a fragment by itself.
    """
    own = passages.where(F.size("stems") >= settings.min_passage).select("pid", "stems", F.size("stems").alias("n"))
    # The passages' words, the rarest first; all workers hold them.
    counts = own.select(F.explode("stems").alias("token")).where("token is not null").groupBy("token").agg(F.count("*").alias("k")).toArrow()
    vocabulary = counts.sort_by([("k", "ascending"), ("token", "ascending")])["token"].combine_chunks()
    v = max(len(vocabulary), 1)
    rows, columns = max(LEAST_ROWS, -(-fragments.count() // ROW)), max(1, -(-own.count() // COLUMN))
    share = settings.same_passage
    pid = own.schema["pid"]
    empty = to_arrow_schema(StructType([pid, StructField("name", StringType())])).empty_table()

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        asked = _unpacked(left["blob"])
        n = asked["n"].to_numpy()
        need = n - np.floor(n * (1 - share) + 1e-9).astype(np.int64)
        held = pc.list_value_length(asked["codes"]).to_numpy()
        able = held >= need
        asked, miss = asked.filter(pa.array(able)).combine_chunks(), (held - need)[able]
        tok, ends = _lists(asked["codes"].combine_chunks())
        wtok, wends, doc, names = _windows(_unpacked(right["blob"]), following, v)
        a, b = contained(tok, ends, miss, wtok, wends, v)
        pairs = _distinct(a * max(len(names), 1) + doc[b])
        return pa.table({"pid": asked["pid"].take(pa.array(pairs // max(len(names), 1))), "name": names.take(pa.array(pairs % max(len(names), 1)))})

    ship(own.sparkSession)
    left = own.withColumn("part", F.pmod(F.xxhash64("pid"), F.lit(columns)).cast("int"))
    right = fragments.select("name", F.col("seq").cast("int").alias("seq"), "stems").withColumn("part", F.pmod(F.xxhash64("name"), F.lit(rows)).cast("int"))
    left = _dealt(left, "stems", vocabulary, [[r * columns + c for r in range(rows)] for c in range(columns)])
    right = _dealt(right, "stems", vocabulary, [[r * columns + c for c in range(columns)] for r in range(rows)])
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(compare, StructType([pid, StructField("name", StringType())]))
