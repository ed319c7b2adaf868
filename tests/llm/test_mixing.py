from collections import Counter

import numpy as np

from inkweft.llm.mixing import mix_sources, permute, place_tokens, quotas, shard_counts, split_quota, tokenise


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        for seed in (1, 2):
            assert sorted(permute(np.arange(n), n, seed).tolist()) == list(range(n))
    assert permute(np.arange(50), 50, 1).tolist() != permute(np.arange(50), 50, 2).tolist()
    sizes = np.repeat([3, 10], [3, 10])
    assert sorted(permute(np.concatenate([np.arange(3), np.arange(10)]), sizes, 5).tolist()) == sorted([*range(3), *range(10)])


def test_quotas():
    rows = {r["source"]: r for r in quotas({"a": 1000, "b": 100}, [("a", 0.6, 1), ("b", 0.2, 2), ("none", 0.2, 3)], 10, None)}
    assert rows["b"]["slots"] <= 20 and rows["a"]["slots"] <= 100 and rows["none"]["slots"] == 0
    assert abs(rows["a"]["slots"] / (rows["a"]["slots"] + rows["b"]["slots"]) - 0.75) < 0.02
    assert quotas({}, [("a", 1.0, 1)], 10, None)[0]["slots"] == 0
    assert sum(r["slots"] for r in quotas({"a": 1000, "b": 1000}, [("a", 0.5, 1), ("b", 0.5, 1)], 10, 95)) == 9


def docs(spark):
    rows = [(i, f"alpha beta {i} gamma delta " * (i % 7 + 1), ["Wiki-Export ", "FAQ", "faq", None][i % 4], "k") for i in range(400)]
    rows += [(1000, None, "faq", "k"), (1001, "", "faq", "k"), (1002, "orphan", "unknown", "k"), (3, rows[3][1], "faq", "k"), (2000, "long " * 30_000, "wiki_export", "k")]
    return spark.createDataFrame(rows, "did int, txt string, src string, source string").withColumnRenamed("source", "block")


TARGETS = [("wiki_export", 0.5, 1), ("faq", 0.3, 3), ("empty", 0.2, 2), (None, 0.1, 1)]


def test_mix(spark):
    target = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixed, shares = mix_sources(docs(spark), "did", "txt", "src", target, block=64)
    rows = mixed.collect()
    by = {r.source: r for r in shares.collect()}
    assert set(by) == {"wiki_export", "faq", "empty"} and by["empty"].mix_tokens == 0
    total = sum(r.n_tokens for r in rows)
    for s, want in (("wiki_export", 0.625), ("faq", 0.375)):
        own = [r for r in rows if r.source == s]
        assert sum(r.n_tokens for r in own) == by[s].mix_tokens and abs(by[s].actual_share - want) < 0.01
        assert max(Counter(r.block for r in own).values()) <= by[s].max_passes
        assert abs(by[s].actual_share - by[s].mix_tokens / total) < 1e-5
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    stream = {}
    for r in rows:
        assert r.n_tokens == len(r.tokens) <= 64
        assert stream.setdefault((r.source, r.block), r.tokens) == r.tokens
    again = mix_sources(docs(spark), "did", "txt", "src", target, block=64)[0]
    assert sorted((r.shard, r.slot, r.source, r.block) for r in again.collect()) == sorted((r.shard, r.slot, r.source, r.block) for r in rows)


def test_blocks_hold_each_record_whole_and_once(spark, monkeypatch):
    import inkweft.llm.mixing as M

    monkeypatch.setattr(M, "BUCKET_TOKENS", 300)  # several buckets of a source
    tokens = tokenise(docs(spark), "did", "txt", "src")
    placed = place_tokens(tokens).collect()
    for s in {r.source for r in placed}:
        own = sorted((r.start, r.n) for r in placed if r.source == s)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))  # no gap, no overlap
    target = spark.createDataFrame([("faq", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixed = mix_sources(docs(spark), "did", "txt", "src", target, block=16)[0].collect()
    stream = [t for r in sorted(mixed, key=lambda r: r.block) for t in r.tokens]
    want = [t for r in sorted((r for r in placed if r.source == "faq"), key=lambda r: r.start) for t in r.tokens]
    assert stream == want


def test_empty_tables(spark):
    target = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixed, shares = mix_sources(docs(spark).where("false"), "did", "txt", "src", target)
    assert mixed.count() == 0 and shares.count() == 3
    mixed, shares = mix_sources(docs(spark), "did", "txt", "src", target.where("false"))
    assert mixed.count() == 0 and shares.count() == 0


def test_shards_split_the_quotas():
    """Counts meet the quotas, shards are full, any subset of shards sees the same, and counts vary as draws do."""
    quota, n = np.array([700, 250, 0, 61]), 11
    counts, before = shard_counts(quota, n, np.arange(n), 3, size=100)
    assert counts.sum(axis=0).tolist() == quota.tolist() and counts.sum(axis=1).tolist() == [100] * 10 + [11]
    assert (np.cumsum(counts, axis=0) - counts == before).all() and len(set(counts[:10, 0].tolist())) > 3
    some, ahead = shard_counts(quota, n, np.array([2, 7]), 3, size=100)
    assert (some == counts[[2, 7]]).all() and (ahead == before[[2, 7]]).all()


def test_quotas_beyond_the_exact_generator():
    quota = np.array([3_000_000_000, 1_000_000_000, 5])
    left = split_quota(quota, 2_000_000_000, np.random.default_rng(1))
    assert left.sum() == 2_000_000_000 and (left >= 0).all() and (left <= quota).all() and abs(left[0] / 2e9 - 0.75) < 1e-3
