"""Mixing sources to target weights.

The tokens of each source are packed, in a pseudorandom order of its records, into blocks of fixed length.  The
mix has as many slots as the scarcest source allows.  The source counts of each output shard are drawn from the
multinomial law of the shares, conditioned on the quotas of the whole mix: the quotas are split over ever smaller
runs of shards by hypergeometric draws, whose seeds depend on the run only, so any worker finds the counts of its
shards, and what comes before them, by itself.  Unconditioned draws would miss the shares by chance and exceed the
scarcest source's cap in half of all mixes.

A slot's turn within its source runs through passes over the source's blocks, each pass in its own pseudorandom
permutation of their indexes, so no block, and no record in it, is used more often than there are passes.  Slots
and blocks are joined by source and index.

Positions of records within a source come from two prefix sums: over the buckets of a source, and within each
bucket, so a source that holds most of the input is never in one task.  Permutations are Feistel networks: any
worker can compute any place by itself.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkweft.llm.words import mix
from inkweft.runtime import arrow_rows, durable, small

BLOCK, SHARD, BUCKET_TOKENS = 256, 1024, 4_000_000
#: Vocabulary of a public tokenizer as ranks, and the pattern that parts text before the merges.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, loaded once in each process."""
    if path not in _encoders:
        import tiktoken

        with open(path if os.path.isfile(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def plain_source(c: Column) -> Column:
    """A source's name after trimming, lower-casing and reading hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), "-", "_")


def tokenise(df: DataFrame, id_col: str, text_col: str, source_col: str, ranks: str = RANKS) -> DataFrame:
    """``_id, source, tokens``; a null text has no tokens.  The rank file of the driver goes to workers without one."""
    df.sparkSession.sparkContext.addFile(ranks)

    def run(batch: pa.RecordBatch) -> pa.Table:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        tokens = [encoder(ranks).encode_ordinary(t) for t in texts]
        return pa.table({"_id": batch.column(0), "source": batch.column(2), "tokens": pa.array(tokens, pa.list_(pa.int32()))})

    own = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), plain_source(F.col(source_col)).alias("source"))
    return arrow_rows(own, run, f"_id {own.schema['_id'].dataType.simpleString()}, source string, tokens array<int>")


def permute(x: np.ndarray, size: np.ndarray | int, seed: np.ndarray | int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size - 1 for each seed, by a Feistel network with cycle walking."""
    size = np.broadcast_to(np.asarray(size, dtype=np.uint64), x.shape)
    seed = np.broadcast_to(np.asarray(seed, dtype=np.uint64), x.shape)
    bits = np.ceil(np.log2(np.maximum(size, 2).astype(np.float64)) / 2).astype(np.uint64)
    bits = np.where((np.uint64(1) << (bits * np.uint64(2))) < size, bits + np.uint64(1), bits)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, open_ = x.astype(np.uint64).copy(), np.arange(len(x))
    while len(open_):
        v, b, m, s = out[open_], bits[open_], mask[open_], seed[open_]
        left, right = v >> b, v & m
        with np.errstate(over="ignore"):
            for r in range(4):
                left, right = right, left ^ (mix(right * np.uint64(0x9E3779B97F4A7C15) + mix(s + np.uint64(r + 1))) & m)
        out[open_] = (left << b) | right
        open_ = open_[out[open_] >= size[open_]]
    return out.astype(np.int64)


def quotas(available: dict[str, int], targets: list[tuple[str, float, int]], block: int, total_tokens: int | None) -> list[dict]:
    """Blocks and slots of each target source.

    The shares of sources that have tokens are scaled to sum to 1; a source without tokens gets none and is
    reported with its target.  Slots: as many as every source can fill within its repeats, or fewer if
    ``total_tokens`` asks for less.  Largest remainders round the quotas.
    """
    rows = [{"source": s, "target": t, "passes": max(1, int(m or 1)), "tokens": available.get(s, 0), "blocks": -(-available.get(s, 0) // block)} for s, t, m in targets]
    live = [r for r in rows if r["blocks"] and r["target"] > 0]
    whole = sum(r["target"] for r in live)
    slots = min((int(r["passes"] * r["blocks"] / (r["target"] / whole)) for r in live), default=0)
    if total_tokens is not None:
        slots = min(slots, total_tokens // block)
    exact = [slots * r["target"] / whole for r in live]
    for r in rows:
        r["slots"] = 0
    for r, x in zip(live, exact):
        r["slots"] = int(x)
    spare = slots - sum(r["slots"] for r in live)
    for i in sorted(range(len(live)), key=lambda i: (int(exact[i]) - exact[i], live[i]["source"]))[:spare]:
        live[i]["slots"] += live[i]["slots"] < live[i]["passes"] * live[i]["blocks"]
    return rows


def place_tokens(tokens: DataFrame) -> DataFrame:
    """Add ``start``: the record's first token within its source, in pseudorandom record order."""
    n = F.size("tokens").cast("bigint")
    rows = tokens.where(n > 0).withColumn("n", n).withColumn("order", F.shiftrightunsigned(F.xxhash64("_id", F.lit(17)), 1))
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_TOKENS))
    # A record's bucket is by its place in the order, so buckets of a source follow each other.
    rows = rows.withColumn("bucket", F.expr(f"int(`order` div {(1 << 63) // buckets + 1 if buckets > 1 else (1 << 63) - 1})"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("n").alias("_sum"))
    before = sums.select("source", "bucket", F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy("source", "bucket").orderBy("order", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_run", F.sum("n").over(within)).join(small(before), ["source", "bucket"]).select("_id", "source", "tokens", "n", (F.col("_before") + F.col("_run") - F.col("n")).alias("start"))


def split_quota(quota: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``n`` slots each source gets out of ``quota``, drawn without replacement.

    Beyond the range of the exact generator each marginal is drawn from its normal limit, within what is possible.
    """
    if quota.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(quota, n, method="marginals")
    out, left, rest = np.zeros_like(quota), int(n), int(quota.sum())
    for i, k in enumerate(int(q) for q in quota):
        mean = left * (k / rest) if rest else 0.0
        spread = (mean * (1 - k / rest) * (rest - left) / max(rest - 1, 1)) ** 0.5 if rest else 0.0
        out[i] = min(max(round(mean + spread * rng.standard_normal()), left - (rest - k), 0), k, left)
        left, rest = left - int(out[i]), rest - k
    return out


def shard_counts(quota: np.ndarray, n_shards: int, wanted: np.ndarray, seed: int, size: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """Source counts of each of the (sorted) shards ``wanted``, and the counts of all shards before it."""
    counts, before = np.zeros((len(wanted), len(quota)), dtype=np.int64), np.zeros((len(wanted), len(quota)), dtype=np.int64)
    total = int(quota.sum())
    runs = [(0, n_shards, np.asarray(quota, dtype=np.int64), np.zeros(len(quota), dtype=np.int64))]
    while runs:
        lo, hi, own, done = runs.pop()
        a, b = np.searchsorted(wanted, [lo, hi])
        if a == b:
            continue
        if hi - lo == 1:
            counts[a:b], before[a:b] = own, done
            continue
        mid = (lo + hi) // 2
        left = split_quota(own, min(mid * size, total) - lo * size, np.random.default_rng([seed, lo, hi]))
        runs += [(lo, mid, left, done), (mid, hi, own - left, done + left)]
    return counts, before


def _slots(spark: SparkSession, plan: list[dict], seed: int) -> DataFrame:
    """``shard, slot, source, block, pass``: every slot of the mix with the block that fills it."""
    live = [r for r in plan if r["slots"]]
    quota = np.array([r["slots"] for r in live], dtype=np.int64)
    blocks = np.array([r["blocks"] for r in live], dtype=np.int64)
    names = np.array([r["source"] for r in live], dtype=object)
    n_shards = -(-int(quota.sum()) // SHARD)

    def run(batch: pa.RecordBatch) -> pa.Table:
        shards = np.sort(batch.column(0).to_numpy())
        counts, before = shard_counts(quota, n_shards, shards, seed)
        size = counts.sum(axis=1)
        shard, begin = np.repeat(shards, size), np.repeat(np.cumsum(size) - size, size)
        own = np.repeat(np.tile(np.arange(len(quota)), len(shards)), counts.ravel())
        at = np.arange(len(own))
        first = np.repeat(np.cumsum(counts.ravel()) - counts.ravel(), counts.ravel())
        turn = np.repeat(before.ravel(), counts.ravel()) + at - first
        lap = turn // blocks[own]
        with np.errstate(over="ignore"):
            key = mix(own.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + lap.astype(np.uint64) + np.uint64(seed))
            slot = permute(at - begin, np.repeat(size, size), mix(shard.astype(np.uint64) + np.uint64(seed)))
        return pa.table({"shard": pa.array(shard), "slot": pa.array(slot), "source": pa.array(names[own], pa.string()), "block": pa.array(permute(turn % blocks[own], blocks[own], key)), "pass": pa.array(lap)})

    return arrow_rows(spark.range(n_shards), run, "shard bigint, slot bigint, source string, block bigint, pass bigint")


def mix_sources(docs: DataFrame, id_col: str, text_col: str, source_col: str, targets: DataFrame, block: int = BLOCK, total_tokens: int | None = None, seed: int = 7, ranks: str = RANKS) -> tuple[DataFrame, DataFrame]:
    """(mix, shares).

    mix: ``shard, slot, source, block, pass, n_tokens, tokens``, one row for each slot; all blocks have ``block``
    tokens but the last of each source.  shares: ``source, target_share, available_tokens, mix_tokens,
    actual_share, max_passes, passes, unused_blocks`` for each target, also those without records.

    The source that runs out first at its target share, repeats counted, sets the size of the whole mix;
    ``total_tokens`` may ask for less.  unused_blocks says how many blocks of a source are in no slot.

    Records with a null source or one without a target, and records without tokens, are in no mix.  A target
    named twice after normalising counts once with the sum of its shares and the least of its repeats; null
    targets are left out, null repeats are 1.  Repeated records are records of their own.
    """
    spark = docs.sparkSession
    goal = targets.select(plain_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    wanted = [(r.source, float(r.target_share), r.max_repeats) for r in goal.orderBy("source").collect()]  # a table of settings: one row for each source
    if len(wanted) > 100_000:
        raise ValueError("too many target sources for a table of settings")
    tokens = durable(tokenise(docs, id_col, text_col, source_col, ranks).join(small(goal.select("source")), "source", "left_semi"))
    available = {r.source: int(r.n) for r in tokens.groupBy("source").agg(F.sum(F.size("tokens")).alias("n")).collect()}
    plan = quotas(available, wanted, block, total_tokens)
    slots = _slots(spark, plan, seed)
    first, last = F.floor(F.col("start") / block).cast("bigint"), F.floor((F.col("start") + F.col("n") - 1) / block).cast("bigint")
    parts = place_tokens(tokens).withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    parts = parts.select("source", "block", F.col("start"), F.slice("tokens", (begin + 1).cast("int"), (F.least((F.col("block") + 1) * block - F.col("start"), F.col("n")) - begin).cast("int")).alias("part"))
    # A block holds at most ``block`` tokens, so gathering its parts is bounded.
    whole = parts.groupBy("source", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"])).alias("tokens"))
    mixed = slots.join(whole, ["source", "block"]).select("shard", "slot", "source", "block", "pass", F.size("tokens").cast("bigint").alias("n_tokens"), "tokens")
    schema = "source string, target_share double, available_tokens bigint, max_passes int, blocks bigint, slots bigint"
    stated = spark.createDataFrame([(r["source"], r["target"], r["tokens"], r["passes"], r["blocks"], r["slots"]) for r in plan], schema)
    # What the shares came to, from the slots and the length of their blocks.
    length = F.least(F.lit(block).cast("bigint"), F.col("available_tokens") - F.col("block") * block)
    used = slots.join(small(stated.select("source", "available_tokens")), "source").groupBy("source").agg(F.sum(length).alias("mix_tokens"), (F.max("pass") + 1).cast("int").alias("passes"))
    total = Window.partitionBy(F.lit(1))
    shares = stated.join(small(used), "source", "left").select(
        "source", "target_share", "available_tokens", F.coalesce("mix_tokens", F.lit(0)).cast("bigint").alias("mix_tokens"),
        F.round(F.coalesce("mix_tokens", F.lit(0)) / F.sum("mix_tokens").over(total), 6).alias("actual_share"), "max_passes", F.coalesce("passes", F.lit(0)).alias("passes"),
        F.greatest(F.col("blocks") - F.col("slots"), F.lit(0)).alias("unused_blocks"),
    )
    return mixed, shares
