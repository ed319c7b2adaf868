import random

import numpy as np
import pytest

from inkweft.llm import neardup as N
from inkweft.llm.words import words


def brute(rows, least=20, run=3, threshold=0.6):
    sets = [(i, {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}) for i, t in rows if i is not None and len(w := words(t)) >= least]
    out = set()
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if i != j and len(a & b) >= threshold * len(a | b):
                out.add((min(i, j), max(i, j)))
    return out


def corpus(r, n, edits):
    vocab = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.randint(25, 120))] for _ in range(n)]
    rows = []
    for k, b in enumerate(base):
        for c in range(r.choice([1, 1, 2, 3])):
            t = list(b)
            for _ in range(0 if c == 0 else r.randint(0, edits)):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append((k * 10 + c, " ".join(t)))
    return rows


def pairs(spark, rows):
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "did bigint, txt string, set_key string").withColumnRenamed("set_key", "_id")
    return {(r.id_a, r.id_b) for r in N.near_duplicate_pairs(df, "did", "txt").collect()}


def test_pairs_equal_brute_force(spark):
    rows = corpus(random.Random(11), 120, 7)
    got, want = pairs(spark, rows), brute(rows)
    assert len(want) > 60 and got <= want and len(got) >= 0.99 * len(want)


def test_copies_nulls_short_texts_and_repeats(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(1, text), (2, text.upper()), (3, text + " t0"), (4, None), (5, ""), (None, text), (6, "t0 t1 t2"), (1, text), (7, " ".join(f"u{i}" for i in range(5000)))]
    assert pairs(spark, rows) == {(1, 2), (1, 3), (2, 3)}
    assert pairs(spark, []) == set()


def test_a_dense_group_is_compared_in_blocks(spark, monkeypatch):
    """Nodes above the limit that never part: every pair still comes out."""
    monkeypatch.setattr(N, "LIMIT", 8)
    monkeypatch.setattr(N, "ROUNDS", 1)
    r = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(40):
        t = list(base)
        t[r.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(t)))
    assert pairs(spark, rows) == brute(rows)


def test_nodes_across_batches(spark):
    """The stream that reads sorted nodes gives the same for any size of batch."""
    rows = corpus(random.Random(5), 60, 5)
    want = pairs(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert pairs(spark, rows) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_classes(spark):
    base = [f"w{i}" for i in range(100)]
    step = lambda k: " ".join(base[: 100 - 6 * k] + [f"y{k}x{i}" for i in range(6 * k)])
    rows = [(10 + k, step(k)) for k in range(5)] + [(99, " ".join(f"z{i}" for i in range(50))), (5, step(4)), (3, "short")]
    df = spark.createDataFrame(rows, "did bigint, txt string")
    got = {r._id: (r.class_id, r.n_links) for r in N.near_duplicate_classes(df, "did", "txt").collect()}
    links = brute([r for r in rows if r[0] != 5])
    assert got[99] == (99, 0) and 3 not in got
    assert {got[i][0] for i in (10, 11, 12, 13, 14, 5)} == {5}  # chained together, the copy's id is the least
    assert all(got[i][1] == sum(i in p for p in links) for i in (10, 11, 12, 13, 14)) and got[5] == got[14]


def test_similar_sets_share_many_nodes():
    r = random.Random(9)
    a = np.unique(np.array([r.getrandbits(64) for _ in range(300)], dtype=np.uint64))
    b = np.unique(np.concatenate([a[:225], np.array([r.getrandbits(64) for _ in range(75)], dtype=np.uint64)]))  # 0.6 of the union
    sig = N.signatures([a, b])
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.15
    own, node = N.walk(sig, 3, np.zeros(0, np.uint64), 3)
    assert len(np.intersect1d(node[own == 0], node[own == 1])) > 0


@pytest.mark.parametrize("depth", [1, 4])
def test_hot_nodes_walk_on(depth):
    sig = N.signatures([np.arange(i, i + 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for i in range(3)])
    own, node = N.walk(sig, depth, np.zeros(0, np.uint64), depth)
    hot = np.unique(node)[:1]
    own2, node2 = N.walk(sig, depth, hot, depth + 1)
    assert not np.isin(node2, hot).any() and len(node2) >= len(node)


def test_a_dense_group_near_the_threshold_is_found_whole(spark):
    """Different texts that are all about as similar as the threshold part on no short path."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(400):
        t = list(base)
        for at in r.sample(range(300), 12):
            t[at] = f"x{k}-{at}"
        rows.append((k, " ".join(t)))
    got, want = pairs(spark, rows), brute(rows)
    assert len(want) > 20_000 and got <= want and len(got) >= 0.99 * len(want)


def test_trees_reach_the_target_on_the_longest_path():
    for depth in range(1, N.DEEPEST + 1):
        assert 1 - (1 - N.met(depth, 2 * N.ROUNDS, 0.6)) ** N.tree_count(depth, 0.6) >= N.TARGET


def test_many_copies_are_paired_in_parts(spark, monkeypatch):
    """A set with more copies than a part holds, linked to another one, gives every pair once."""

    monkeypatch.setattr(N, "PART", 4)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(base)) for i in range(23)] + [(100 + i, " ".join(base[:-1] + ["other"])) for i in range(9)] + [(500, "far " + " ".join(f"z{i}" for i in range(30)))]
    df = spark.createDataFrame(rows, "oid int, t string")
    got = sorted((r.id_a, r.id_b) for r in N.near_duplicate_pairs(df, "oid", "t").collect())
    ids = sorted(i for i, _ in rows[:-1])
    assert got == [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]]
