"""Near-duplicate texts by a chosen-path set similarity join.

A text is the set of its word runs; texts with the same set are one set with several members from here on.
Each set has minwise tokens (one for each of ``T`` hash functions).  Every tree starts with all sets in its
root.  A node draws one position of the signature, a second one with some chance, and passes each of its sets
to the children named by the set's tokens there.  Draws depend only on the node's own key, so trees are
independent and any worker can walk a path by itself.  Nodes of up to ``LIMIT`` sets are compared exhaustively.
A larger one is compared in blocks at once if its sets are so alike that branching saves no work; else it branches
on by ``HEAVY`` draws, with which a similar pair stays together on some path however many levels follow.  The
number of trees follows from the levels and the recall ``TARGET`` at the threshold.  A bit sketch of the signature
screens the pairs of a node, the exact similarity of the word runs decides.

Where it runs: a walk of several levels is one pass without shuffle.  Its depth comes from how often two sets
share a token, measured over all sets.  Then one shuffle brings the nodes together; they are read as a sorted
stream, so a node is never held beyond ``LIMIT`` sets.  A node that holds a large share of all sets is found
beforehand by counts within batches and, unless dense, walks on before the shuffle.  Dense nodes and those that
stay large to the end are compared in blocks spread over tasks, so no pair is given up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweft.llm.words import WordHasher, flatten, grams, mix, words
from inkweft.runtime import arrow_rows, durable, fits, ship, small

RUN, LEAST, THRESHOLD = 3, 20, 0.6
T, TREES, SECOND, LIMIT = 128, 16, 0.25, 64
#: Sketches of T bits agree in (1 + s) / 2 of them on average; this many fewer are let through (over three deviations).
SLACK = 14
ROUNDS, PART = 5, 512
#: Recall at the threshold for which trees are added to the least number TREES; draws of a node above LIMIT.
TARGET, HEAVY = 0.996, 3
#: Share of agreeing tokens from which HEAVY draws save (almost) no comparisons; levels that all sets walk at most.
DENSE, DEEPEST, PROBES = 0.25, 6, 8
_SEED = np.uint64(0x5851F42D4C957F2D)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _factors() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, T + 1, dtype=np.uint64) * _K1 + _SEED) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens of each (non-empty) set, 16 bits each."""
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    flat = np.concatenate(sets)
    out = np.empty((len(sets), T), dtype=np.uint16)
    with np.errstate(over="ignore"):
        for i, f in enumerate(_factors()):
            out[:, i] = (mix(np.minimum.reduceat(flat * f, begin)) >> np.uint64(48)).astype(np.uint16)
    return out


def shingle_sets(texts: list[str | None], hasher: WordHasher, run: int, least: int) -> list[np.ndarray | None]:
    """Sorted distinct word runs of each text; None below ``least`` words."""
    tokens = [hasher(words(t)) for t in texts]
    flat, offsets = flatten(tokens)
    h, whole = grams(flat, offsets, run)
    out: list[np.ndarray | None] = []
    for i, own in enumerate(tokens):
        part = h[offsets[i] : offsets[i + 1]][whole[offsets[i] : offsets[i + 1]]]
        out.append(np.unique(part) if len(own) >= max(least, run) and len(part) else None)
    return out


def met(depth: int, heavy: int, s: float) -> float:
    """The chance that a pair of similarity ``s`` stays together in one tree over ``depth`` levels and ``heavy`` more
    levels of large nodes."""
    q = 1.0
    for _ in range(heavy):
        q = 1 - (1 - s * q) ** HEAVY
    for _ in range(depth):
        q = (1 - SECOND) * s * q + SECOND * (1 - (1 - s * q) ** 2)
    return q


def tree_count(depth: int, threshold: float) -> int:
    """Trees with which a pair at the threshold is found with the chance TARGET on the longest path."""
    q = met(depth, 2 * ROUNDS, threshold)
    return TREES if q >= 1 else max(TREES, math.ceil(math.log(1 - TARGET) / math.log(1 - q)))


def branch(own: np.ndarray, node: np.ndarray, sig: np.ndarray, large: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """One level: the children to which each set of each node goes; large nodes draw HEAVY different positions."""
    with np.errstate(over="ignore"):
        draw = mix(node * _K1 + _K2)
        first = (draw & np.uint64(T - 1)).astype(np.int64)
        second = ((draw >> np.uint64(8)) & np.uint64(T - 1)).astype(np.int64)
        more = (draw >> np.uint64(40)) < np.uint64(int(SECOND * (1 << 24)))
        more &= first != second
        every = np.arange(len(own))

        def child(rows, at):
            return mix(node[rows] * _K2 + mix(at.astype(np.uint64) * _K1 + sig[own[rows], at].astype(np.uint64)))

        if large:  # an odd step goes round all positions before it repeats one
            step = ((draw >> np.uint64(16)) & np.uint64(T - 1)).astype(np.int64) | 1
            return np.tile(own, HEAVY), np.concatenate([child(every, (first + k * step) % T) for k in range(HEAVY)])
        some = np.flatnonzero(more)
        return np.concatenate([own, own[some]]), np.concatenate([child(every, first), child(some, second[some])])


def _roots(trees: int = TREES) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, trees + 1, dtype=np.uint64) * _K2 + _SEED)


def walk(sig: np.ndarray, depth: int, hot: np.ndarray, deepest: int, trees: int = TREES) -> tuple[np.ndarray, np.ndarray]:
    """All (set, node) rows at ``depth``; rows of a hot node go on, down to ``deepest``."""
    own, node = np.repeat(np.arange(len(sig)), trees), np.tile(_roots(trees), len(sig))
    for _ in range(depth):
        own, node = branch(own, node, sig)
    level = depth
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(hot) and level < deepest:
        warm = np.isin(node, hot)
        if not warm.any():
            break
        done.append((own[~warm], node[~warm]))
        own, node = branch(own[warm], node[warm], sig, large=True)
        level += 1
    done.append((own, node))
    return np.concatenate([o for o, _ in done]), np.concatenate([x for _, x in done])


def _sketch(sig: np.ndarray) -> np.ndarray:
    return np.packbits((sig & 1).astype(np.uint8), axis=1).view(np.int64)


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    keys = batch.column("set_key").to_numpy()
    return keys, np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, T)


def set_table(df: DataFrame, id_col: str, text_col: str, run: int = RUN, least: int = LEAST) -> DataFrame:
    """``_id, set_key, size, sig`` of each text with at least ``least`` words."""
    hasher = WordHasher()

    def make(batch: pa.RecordBatch) -> pa.Table | None:
        ids = batch.column(0).to_pylist()
        sets = shingle_sets(batch.column(1).to_pylist(), hasher, run, least)
        kept = [(i, s) for i, s in zip(ids, sets) if s is not None]
        if not kept:
            return None
        with np.errstate(over="ignore"):
            keys = [int((mix(s * _K1).sum(dtype=np.uint64) ^ mix(np.array([len(s)], dtype=np.uint64))[0]).view(np.int64)) for _, s in kept]
        sig = signatures([s for _, s in kept])
        return pa.table({"_id": pa.array([i for i, _ in kept], pa.int64()), "set_key": pa.array(keys, pa.int64()), "size": pa.array([len(s) for _, s in kept], pa.int32()), "sig": pa.array([x.tobytes() for x in sig], pa.binary())})

    rows = df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).where("_id is not null and _text is not null")
    return arrow_rows(rows, make, "_id bigint, set_key bigint, size int, sig binary")


def _depth(sets: DataFrame, n: int) -> int:
    """Levels after which a usual node is well below the limit, from the share of sets with the same token."""
    at = [F.struct(F.lit(i).alias("i"), F.substring("sig", 2 * i + 1, 2).alias("v")) for i in range(0, T, T // 4)]
    counts = sets.select(F.explode(F.array(*at)).alias("x")).groupBy("x").count()
    c = F.col("count").cast("double")
    met = counts.agg(F.sum(c * c) / F.sum(c)).first()[0] or 1.0
    share = min(max(met / max(n, 1), 1e-6), 0.9)
    depth, size = 1, float(n)
    while size * share > LIMIT / 3 and depth < 24:
        size *= share
        depth += 1
    return min(depth, DEEPEST if share < DENSE else DEEPEST // 2)


def _thin(sets: DataFrame, new: np.ndarray, go) -> np.ndarray:
    """Those of the nodes ``new`` that aren't dense, by the pairs within batches; ``go`` walks to their level."""

    def count(batch: pa.RecordBatch) -> pa.Table:
        _, sig = _read(batch)
        own, node = go(sig)
        nodes, same, every = [], [], []
        for key in new:
            part = sig[own[node == key]][:, :: T // PROBES]
            c = np.concatenate([np.unique(part[:, i], return_counts=True)[1] for i in range(PROBES)]).astype(np.float64)
            nodes.append(key)
            same.append(float((c * (c - 1)).sum()))
            every.append(float(PROBES * len(part) * (len(part) - 1)))
        return pa.table({"node": pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), "same": pa.array(same), "every": pa.array(every)})

    found = arrow_rows(sets.select("set_key", "sig"), count, "node bigint, same double, every double").groupBy("node").agg(F.sum("same").alias("same"), F.sum("every").alias("every")).where(F.col("same") < DENSE * F.col("every")).select("node").collect()
    return np.array([r.node for r in found], dtype=np.int64).view(np.uint64)


def _hot_nodes(sets: DataFrame, depth: int, n: int, deepest: int, trees: int) -> np.ndarray:
    """Keys of nodes with at least a fiftieth of all sets that aren't dense; their number has a bound whatever the input."""
    hot = np.zeros(0, dtype=np.uint64)
    for level in range(depth, deepest):
        known = hot

        def count(batch: pa.RecordBatch, known=known, level=level) -> pa.Table:
            _, sig = _read(batch)
            _, node = walk(sig, depth, known, level, trees)
            keys, c = np.unique(node, return_counts=True)
            often = c >= max(2, len(sig) // 100)
            return pa.table({"node": pa.array(keys[often].view(np.int64), pa.int64()), "n": pa.array(c[often], pa.int64())})

        found = arrow_rows(sets.select("set_key", "sig"), count, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= max(LIMIT + 1, n // 50)).select("node").collect()
        new = np.setdiff1d(np.array([r.node for r in found], dtype=np.int64).view(np.uint64), hot)
        if len(new):
            new = _thin(sets, new, lambda sig, known=known, level=level: walk(sig, depth, known, level, trees))
        if not len(new):
            break
        hot = np.union1d(hot, new)
    return hot


def _leaf_pairs(frontier: DataFrame, bits: int) -> DataFrame:
    """``kind, a, b`` from a frontier ``node, set_key, s1, s2``: pairs of small nodes that pass the sketch (kind 0)
    and rows (node, set) of nodes above the limit (kind 1)."""
    ship(frontier.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        big = None  # the node above the limit that is being read

        def emit(rows: np.ndarray) -> pa.RecordBatch | None:
            node = rows[:, 0]
            edge = np.flatnonzero(np.diff(node)) + 1
            begin = np.concatenate([[0], edge])
            length = np.diff(np.concatenate([begin, [len(node)]]))
            size = np.repeat(length, length)
            heavy = size > LIMIT
            kind, a, b = [np.ones(int(heavy.sum()), dtype=np.int8)], [node[heavy]], [rows[heavy, 1]]
            rows = rows[~heavy & (size > 1)]
            for d in range(1, min(LIMIT, len(rows))):
                same = np.flatnonzero(rows[d:, 0] == rows[:-d, 0])
                if not len(same):
                    break
                x, y = rows[same], rows[same + d]
                differ = np.bitwise_count((x[:, 2:] ^ y[:, 2:]).view(np.uint64))  # unsigned: else it counts the bits of the absolute value
                agree = T - differ.sum(axis=1, dtype=np.int64)
                ok = (agree >= bits) & (x[:, 1] != y[:, 1])
                if ok.any():
                    lo, hi = np.minimum(x[ok, 1], y[ok, 1]), np.maximum(x[ok, 1], y[ok, 1])
                    kind.append(np.zeros(len(lo), dtype=np.int8))
                    a.append(lo)
                    b.append(hi)
            kind, a, b = np.concatenate(kind), np.concatenate(a), np.concatenate(b)
            if not len(kind):
                return None
            return pa.record_batch({"kind": pa.array(kind, pa.int8()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            if not len(rows):
                continue
            if held:
                rows = np.concatenate([*held, rows])
                held = []
            if big is not None:
                more = rows[:, 0] == big
                if more.any():
                    part = rows[more]
                    yield pa.record_batch({"kind": pa.array(np.ones(len(part), dtype=np.int8), pa.int8()), "a": pa.array(part[:, 0], pa.int64()), "b": pa.array(part[:, 1], pa.int64())})
                    rows = rows[~more]
                if not len(rows):
                    continue
                big = None
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0], "left"))
            if len(rows) - last > LIMIT:  # the node at the end is above the limit already
                big, last = rows[-1, 0], len(rows)
            held = [rows[last:]] if last < len(rows) else []
            if last and (out := emit(rows[:last])) is not None:
                yield out
        if held and (out := emit(np.concatenate(held))) is not None:
            yield out

    return frontier.repartition("node").sortWithinPartitions("node").mapInArrow(run, "kind tinyint, a bigint, b bigint")


def _frontier(sets: DataFrame, depth: int, hot: np.ndarray, deepest: int, trees: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.Table:
        keys, sig = _read(batch)
        own, node = walk(sig, depth, hot, deepest, trees)
        s = _sketch(sig)
        return pa.table({"node": pa.array(node.view(np.int64)), "set_key": pa.array(keys[own]), "s1": pa.array(s[own, 0]), "s2": pa.array(s[own, 1])})

    return arrow_rows(sets.select("set_key", "sig"), run, "node bigint, set_key bigint, s1 bigint, s2 bigint")


def _deeper(rows: DataFrame, sets: DataFrame, blocks: bool) -> DataFrame:
    """Children of the rows (node, set) of large nodes; or, at the end, the blocks of each node in pairs."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        keys, sig = _read(batch)
        node = batch.column("node").to_numpy().view(np.uint64)
        own, node = branch(np.arange(len(keys)), node, sig, large=True)
        s = _sketch(sig)
        return pa.table({"node": pa.array(node.view(np.int64)), "set_key": pa.array(keys[own]), "s1": pa.array(s[own, 0]), "s2": pa.array(s[own, 1])})

    heavy = rows.select(F.col("a").alias("node"), F.col("b").alias("set_key"))
    if not blocks:
        return arrow_rows(heavy.join(sets.select("set_key", "sig"), "set_key"), run, "node bigint, set_key bigint, s1 bigint, s2 bigint")
    # A dense node in blocks: every set goes to its own block's pair with each block.
    size = heavy.groupBy("node").agg(F.ceil(F.count("*") / F.lit(LIMIT // 2)).cast("int").alias("n_blocks"))
    own = heavy.join(size, "node").withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("n_blocks")).cast("int"))
    spread = own.select("node", "set_key", "block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"))
    return spread.select(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("node"), "set_key").distinct()


def _dense(heavy: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, dense``: of each large node whether its sets are too alike for branching."""
    at = [F.struct(F.lit(i).alias("i"), F.substring("sig", 2 * i + 1, 2).alias("v")) for i in range(0, T, T // PROBES)]
    tokens = heavy.join(sets.select(F.col("set_key").alias("b"), F.array(*at).alias("at")), "b").select("a", F.explode("at").alias("x"))
    c, n = F.col("count").cast("double"), F.col("n") / PROBES
    return tokens.groupBy("a", "x").count().groupBy("a").agg(F.sum(c * (c - 1)).alias("same"), F.sum(c).alias("n")).select("a", (F.col("same") >= DENSE * PROBES * n * (n - 1)).alias("dense"))


def candidate_pairs(sets: DataFrame, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct pairs (a < b) of set keys that meet in a node and pass the sketch."""
    bits = max(0, int(T * (1 + threshold) / 2) - SLACK)
    depth = _depth(sets, n)
    deepest = depth + ROUNDS
    trees = tree_count(depth, threshold)
    hot = _hot_nodes(sets, depth, n, deepest, trees)
    found, whole, step = [], [], durable(_leaf_pairs(_frontier(sets, depth, hot, deepest, trees), bits))
    for k in range(ROUNDS + 1):
        found.append(step.where("kind = 0").select("a", "b"))
        heavy = step.where("kind = 1").select("a", "b").distinct()
        if not heavy.limit(1).count():
            break
        if k == ROUNDS:
            whole.append(heavy)
            break
        told = durable(_dense(heavy, sets))
        if told.where("dense").limit(1).count():
            whole.append(heavy.join(told.where("dense"), "a", "left_semi"))
        step = durable(_leaf_pairs(_deeper(heavy.join(told.where("not dense"), "a", "left_semi"), sets, blocks=False), bits))
    # What is dense or stays together to the end is compared in full, block by block.
    found += [_blocks(_deeper(rows, sets, blocks=True), sets, bits) for rows in whole]
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def _blocks(rows: DataFrame, sets: DataFrame, bits: int) -> DataFrame:
    """All pairs within each block pair, as a join on its key; blocks are bounded, so is each key."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        keys, sig = _read(batch)
        s = _sketch(sig)
        return pa.table({"set_key": pa.array(keys), "s1": pa.array(s[:, 0]), "s2": pa.array(s[:, 1])})

    sketch = arrow_rows(sets.select("set_key", "sig"), run, "set_key bigint, s1 bigint, s2 bigint")
    own = rows.join(sketch, "set_key")
    left = own.select("node", F.col("set_key").alias("a"), F.col("s1").alias("a1"), F.col("s2").alias("a2"))
    right = own.select("node", F.col("set_key").alias("b"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    agree = F.lit(T) - F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) - F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
    return left.join(right, "node").where((F.col("a") < F.col("b")) & (agree >= bits)).select("a", "b")


def similar_sets(members: DataFrame, df: DataFrame, id_col: str, text_col: str, run: int = RUN, least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b, similarity``: pairs of different sets whose Jaccard similarity is at least ``threshold``, exactly."""
    sets = members.groupBy("set_key").agg(F.min_by("sig", "_id").alias("sig"), F.min("_id").alias("_id"))
    sets = durable(sets)
    pairs = durable(candidate_pairs(sets, sets.count(), threshold))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct().join(sets.select("set_key", "_id"), "set_key")
    text = df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).where("_id is not null and _text is not null")
    hasher = WordHasher()

    def make(batch: pa.RecordBatch) -> pa.Table:
        keys = batch.column(0).to_pylist()
        runs = shingle_sets(batch.column(1).to_pylist(), hasher, run, least)
        return pa.table({"set_key": pa.array(keys, pa.int64()), "runs": pa.array([None if r is None else r.tobytes() for r in runs], pa.binary())})

    runs = arrow_rows(text.join(small(needed), "_id").select("set_key", "_text"), make, "set_key bigint, runs binary").where("runs is not null")
    if not fits(needed):
        runs = durable(runs)
    both = pairs.join(runs.select(F.col("set_key").alias("a"), F.col("runs").alias("ra")), "a").join(runs.select(F.col("set_key").alias("b"), F.col("runs").alias("rb")), "b")

    def compare(batch: pa.RecordBatch) -> pa.Table:
        a, b = batch.column(0), batch.column(1)
        out = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(common / (len(x) + len(y) - common))
        return pa.table({"a": a, "b": b, "similarity": pa.array(out, pa.float64())})

    return arrow_rows(both.select("a", "b", "ra", "rb"), compare, "a bigint, b bigint, similarity double").where(F.col("similarity") >= threshold).dropDuplicates(["a", "b"])


def near_duplicates(df: DataFrame, id_col: str, text_col: str, run: int = RUN, least: int = LEAST, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members ``_id, set_key``, links ``a, b, similarity`` between different sets).

    Null ids and texts and texts below ``least`` words have no part in it.  An id on several rows is a member of
    the set of each of them.  Texts with the same word runs share a set and have no link of their own.
    """
    members = durable(set_table(df, id_col, text_col, run, least))
    return members.select("_id", "set_key").distinct(), similar_sets(members, df, id_col, text_col, run, least, threshold)


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, **kw) -> DataFrame:
    """``id_a, id_b`` (a < b) of all rows whose texts are similar, members of one set among them.

    Members of a set with many copies are dealt to parts of about ``PART``: a pair of sets meets part by part, and
    so does a set with itself, so no task holds more than a part against all members of the other side.
    """
    members, links = near_duplicates(df, id_col, text_col, **kw)
    both = [F.least("_x", "_y").alias("id_a"), F.greatest("_x", "_y").alias("id_b")]
    parts = durable(members.groupBy("set_key").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("_n")).where("_n > 1"))
    if not parts.limit(1).count():  # no set has more members than a part
        one, other = members.select(F.col("_id").alias("_x"), F.col("set_key").alias("a")), members.select(F.col("_id").alias("_y"), F.col("set_key").alias("b"))
        across = links.select("a", "b").join(one, "a").join(other, "b").where("_x <> _y")
        copies = one.join(other, F.col("a") == F.col("b")).where("_x < _y")
        return across.select(*both).unionByName(copies.select(*both)).distinct()
    parts = members.select("set_key").distinct().join(parts, "set_key", "left").select("set_key", F.coalesce("_n", F.lit(1)).alias("_n"))
    ends = links.select("a", "b").unionByName(parts.where("_n > 1").select(F.col("set_key").alias("a"), F.col("set_key").alias("b"))).join(parts.withColumnRenamed("set_key", "a"), "a")
    ends = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_part"))
    dealt = members.join(parts, "set_key").select(F.col("_id").alias("_x"), F.col("set_key").alias("a"), F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int").alias("_part"), "_n")
    left = ends.join(dealt.drop("_n"), ["a", "_part"])
    right = ends.join(members.select(F.col("_id").alias("_y"), F.col("set_key").alias("b")), "b")
    far = left.join(right, ["a", "b", "_part"]).where((F.col("a") != F.col("b")) & (F.col("_x") != F.col("_y")) | (F.col("_x") < F.col("_y")))
    # A set of one part has a bounded number of pairs.
    own = dealt.where("_n = 1")
    near = own.join(own.select(F.col("_x").alias("_y"), "a"), "a").where("_x < _y")
    return far.select(*both).unionByName(near.select(*both)).distinct()


def near_duplicate_classes(df: DataFrame, id_col: str, text_col: str, **kw) -> DataFrame:
    """``_id, class_id, n_links``: for each text its class (the least id in it) and the links of its set.

    Classes are the connected components of the links, found by passing the least label on and jumping ahead to
    the label's own label until nothing changes; each round is cut by a checkpoint.
    """
    members, links = near_duplicates(df, id_col, text_col, **kw)
    links = durable(links)
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = durable(members.groupBy("set_key").agg(F.min("_id").alias("label")))
    heads = labels
    while True:
        near = edges.join(labels.withColumnRenamed("set_key", "b"), "b").groupBy(F.col("a").alias("set_key")).agg(F.min("label").alias("_near"))
        moved = labels.join(near, "set_key", "left").select("set_key", "label", F.least("label", "_near").alias("_new"))
        # Jump: the label of the set whose least member is the label.
        ahead = moved.select(F.col("_new").alias("_ahead"), "set_key").join(heads.select(F.col("set_key"), F.col("label").alias("_own")), "set_key").groupBy("_own").agg(F.min("_ahead").alias("_ahead"))
        new = durable(moved.join(ahead.withColumnRenamed("_own", "_new"), "_new", "left").select("set_key", F.least("_new", "_ahead").alias("label"), "label").toDF("set_key", "label", "_before"))
        changed = new.where("label <> _before").limit(1).count()
        labels = new.select("set_key", "label")
        if not changed:
            break
    degree = edges.groupBy(F.col("a").alias("set_key")).agg(F.count("*").alias("n_links"))
    return members.join(labels, "set_key").join(degree, "set_key", "left").select("_id", F.col("label").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
