import math
import re

import pytest
from pyspark.sql import functions as F

from inkweft.config import Settings
from inkweft.operators import search as S
from inkweft.operators.index import build_index, load_index, save_index

SET = Settings(languages=("en",))
DOCS = [
    ("refunds.md", "# Refunds\n\nA refund is paid within 14 days. The buyer sends the parcel back first. Refund requests need a receipt.\n\n## Exceptions\n\nOpened software has no refund."),
    ("travel.md", "# Travel\n\nTravel claims need a receipt and a signature. Claims are paid monthly.\n\n## Hotels\n\nHotels above the limit need approval of the manager."),
    ("travel-copy.md", "# Journeys\n\nTravel claims need a receipt and a signature. Claims are paid monthly.\n\n## Hotels\n\nHotels above the limit need approval of the manager."),
    ("printers.md", "# Printers\n\nThe print queue is cleared at night. Paper is in the store room."),
]


@pytest.fixture(scope="module")
def base(spark):
    index = build_index(spark.createDataFrame(DOCS, "name string, body string"), SET)
    return index, [r.asDict() for r in index.fragments.collect()]


def stems(text):
    stop = set(SET.stopwords)
    words = [w for w in re.findall(r"[\w'’]+", text) if len(w) > 1 and w.lower() not in stop]
    return {w.lower().strip("«»\"'.,:;!?()[]–—-")[:6] for w in words}


def brute(question, frags, limit=8):
    n = len(frags)
    df = {}
    for f in frags:
        for t in {*f["body_stems"], *f["head_stems"]}:
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(1 + n / k) for t, k in df.items()}
    want = stems(question)
    if not want:
        return []
    budget = sum(idf.get(t, math.log(1 + n)) for t in want)
    known = sum(t in idf for t in want) / len(want)
    hits = []
    for f in frags:
        b, h = want & set(f["body_stems"]), want & set(f["head_stems"])
        if b or h:
            gain = sum(idf[t] for t in b) + 2 * sum(idf[t] for t in h)
            hits.append((round((gain / budget + 0.4 * len(b) / max(len(f["body_stems"]), 1)) * known, 9), f))
    hits.sort(key=lambda x: (-x[0], x[1]["name"], x[1]["line_no"], x[1]["seq"]))
    kept = []
    for s, f in hits:
        alike = lambda o: len(set(f["body_stems"]) & set(o["body_stems"])) >= 0.8 * len(set(f["body_stems"]) | set(o["body_stems"])) > 0
        if not any(alike(k) for _, k in kept):
            kept.append((s, f))
        if len(kept) == limit:
            break
    return [(round(s, 6), f["name"], f["seq"]) for s, f in kept]


QUESTIONS = [(1, "When is a refund paid?"), (2, "hotel approval of travel claims"), (3, "the and of"), (4, "zeppelin refund"), (5, "zeppelin"), (6, "")]


def test_search_equals_brute_force(spark, base):
    index, frags = base
    q = spark.createDataFrame(QUESTIONS, "qid int, question string")
    rows = S.search(q, index, SET).orderBy("qid", "rank").collect()
    for qid, text in QUESTIONS:
        assert [(round(r.score, 6), r.name, r.seq) for r in rows if r.qid == qid] == brute(text, frags), text
    two = S.search(q, index, SET, limit=2).groupBy("qid").count().collect()
    assert all(r["count"] <= 2 for r in two)
    assert S.search(q, index, SET, limit=-1).count() >= len(rows)


def test_the_fold_widens_when_copies_fill_it(spark):
    body = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda word."
    docs = [(f"c{i:03}.md", "# Same\n\n" + body) for i in range(120)] + [("z.md", "# Other\n\nAlpha stands here with quite different neighbours around.")]
    index = build_index(spark.createDataFrame(docs, "name string, body string"), SET)
    q = spark.createDataFrame([(1, "alpha beta gamma")], "qid int, question string")
    assert [r.name for r in S.search(q, index, SET, limit=2).orderBy("rank").collect()] == ["c000.md", "z.md"]


def test_no_python_and_no_text_in_scoring(spark, base):
    index, _ = base
    q = spark.createDataFrame([(1, "refund")], "qid int, question string")
    plan = S.score_fragments(q, index, SET)._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan


def test_unknown_words_and_closest(spark, base):
    index, _ = base
    q = spark.createDataFrame([(1, "Zeppelin refund zeppelins Unheard-of x")], "qid int, question string")
    assert [(r.pos, r.word) for r in S.unknown_words(q, index, SET).orderBy("pos").collect()] == [(1, "Zeppelin"), (2, "Unheard")]
    hits = S.search(spark.createDataFrame([(1, "travel claims receipt")], "qid int, question string"), index, SET)
    assert S.closest_documents(hits, 1).first().name == hits.where("rank = 1").first().name


def test_shown_fragments_keep_to_the_budget(spark):
    hits = spark.createDataFrame([(1, k, f"d{k}", 1, 0) for k in range(1, 15)], "qid int, rank int, name string, line_no int, seq int")
    texts = spark.createDataFrame([(f"d{k}", 0, "x" * 300 + "\n\n" + "y" * 900) for k in range(1, 15)], "name string, seq int, body string")
    rows = S.shown_fragments(hits, texts, SET).orderBy("rank").collect()
    assert [len(r.shown) for r in rows] == [620] * 9 + [420]


def test_passages_found_equals_brute_force(spark, base):
    import random

    r = random.Random(5)
    vocab = [f"t{i}" for i in range(60)]
    frags = [(n, s, r.sample(vocab, r.randint(5, 40))) for n in "abc" for s in range(5)]
    passages = [(i, r.sample(frags[r.randrange(15)][2], 5) if i % 4 == 0 else [*x[:22]]) for i, x in enumerate(r.choice(frags)[2] + r.sample(vocab, 3) for _ in range(40))]
    passages = [(i, list(dict.fromkeys(p))) for i, p in passages]
    f = spark.createDataFrame(frags, "name string, seq int, body_stems array<string>")
    got = {(x.pid, x.name) for x in S.passages_found(spark.createDataFrame(passages, "pid int, stems array<string>"), S.passage_windows(f), SET).collect()}
    want = set()
    for i, p in passages:
        for n in "abc":
            own = [set(b) for m, _, b in frags if m == n]
            if len(p) >= 20 and any(len(set(p) & (a | b)) >= 0.9 * len(p) for a, b in zip(own, own[1:] + [set()])):
                want.add((i, n))
    assert got == want and want


def test_passages_are_found_without_a_shuffle_of_pairs(spark):
    """Common words in many fragments: pairs that share no more than a word were joined and shuffled."""
    import random

    from inkweft.operators.passages import passages_in

    r = random.Random(3)
    common, rare = [f"c{i}" for i in range(120)], [f"r{i}" for i in range(300)]
    frags = [(f"d{d:04}" if d else None, s, r.sample(common, 24) + r.sample(rare, r.randint(0, 2))) for d in range(700) for s in range(3)]
    frags += [(f"copy{i}", 0, [*frags[i * 7][2][:-2], "other"]) for i in range(40)] + [("short", 0, common[:19]), ("long", 0, common[:60]), ("none", 0, [])]
    f = spark.createDataFrame(frags, "name string, seq int, body_stems array<string>")
    passages = spark.createDataFrame([((n, s), b) for n, s, b in frags], "pid struct<name: string, seq: int>, stems array<string>")
    found = passages_in(passages, f.select("name", "seq", F.col("body_stems").alias("stems")), SET, True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan
    by = {}
    for n, s, b in sorted(frags, key=lambda x: (x[0] or "", x[1])):
        by.setdefault(n, []).append(set(b))
    windows = [(n, a | b) for n, own in by.items() for a, b in zip(own, own[1:] + [set()])]
    want = {((n, s), m) for n, s, b in frags if len(b) >= 20 for m, w in windows if 10 * len(w.intersection(b)) >= 9 * len(b)}
    rows = [((x.pid.name, x.pid.seq), x.name) for x in found.collect()]
    assert set(rows) == want and len(rows) == len(want) > 2100 and any(p[0] != m for p, m in want)


def test_contained_by_bits_and_one_by_one(monkeypatch):
    import numpy as np

    from inkweft.operators import passages as P

    r = np.random.default_rng(2)
    draw = lambda k, n: [np.sort(r.choice(50, n, replace=False)) for _ in range(k)]
    p, w = draw(150, 8), draw(400, 30)
    flat = lambda x: (np.concatenate(x).astype(np.uint16), np.concatenate([[0], np.cumsum([len(y) for y in x])]))
    miss = r.integers(0, 3, 150)
    want = {(i, j) for i, a in enumerate(p) for j, b in enumerate(w) if len(a) - len(np.intersect1d(a, b)) <= miss[i]}
    for few, size, words in [(1000, 1 << 21, 1 << 16), (0, 1 << 25, 1 << 16), (0, 4000, 2)]:
        monkeypatch.setattr(P, "FEW_WINDOWS", few), monkeypatch.setattr(P, "FEW_CHUNKS", few and 32)
        monkeypatch.setattr(P, "BYTES", size), monkeypatch.setattr(P, "WORDS", words), monkeypatch.setattr(P, "PAIRS", size)
        a, b = P.contained(*flat(p), miss, *flat(w), 50)
        assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want) > 100


def test_rows_with_one_key_are_left_once(spark):
    from inkweft.runtime import once

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c"), (None, "c"), (3, None)], "k int, v string")
    left = once(rows, "k")
    assert sorted((tuple(x) for x in left.collect()), key=str) == sorted([(1, "a"), (2, "b"), (None, "c"), (3, None)], key=str)


def test_doubts(spark, base):
    index, _ = base
    q = spark.createDataFrame([(1, "refund paid receipt parcel buyer days"), (2, "xylophone"), (3, "travel claims receipt signature paid monthly"), (4, "zeppelin balloon above the night sky")], "qid int, question string")
    rows = {r.qid: r for r in S.doubts(q, S.search(q, index, SET), index, SET).collect()}
    assert rows[2].no_hits and not rows[1].no_hits
    assert not rows[3].close_race  # the rival is a copy of the same page
    assert rows[4].weak


def test_only_the_best_hits_leave_the_fragments(spark):
    """All pairs of question and fragment were shuffled; of each batch only those among the best are left, ties too."""
    docs = [(f"d{i:04}.md", f"# Page {i % 7}\n\nAlpha {'beta ' * (i % 3)} word{i % 11} gamma{i % 5}, something else number{i}.") for i in range(900)]
    index = build_index(spark.createDataFrame(docs, "name string, body string").coalesce(1), SET)
    q = spark.createDataFrame([(1, "alpha beta word3"), (2, "gamma2 alpha page"), (3, "number77"), (4, "nothing known")], "qid int, question string")
    every = {(r.qid, r.fid): r.score for r in S.score_fragments(q, index, SET).collect()}
    best = S._best_scores(S.question_weights(S.question_tokens(q, SET), index).where("idf is not null"), index, SET, 20)
    assert "Join" not in best._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.qid, r.fid): r.score for r in best.collect()}
    assert len(got) < len(every) / 2 and all(every[k] == v for k, v in got.items())
    for k in {k for k, _ in every}:
        own = sorted((v for (a, _), v in every.items() if a == k), reverse=True)
        assert {x for x, v in every.items() if x[0] == k and v >= own[min(20, len(own)) - 1]} <= set(got)


def test_spans_and_settling(spark):
    points = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 1)], "name string, at int")
    starts = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 8, "z")], "name string, start int, label string")
    assert {(r.name, r.at, r.label) for r in S.containing_span(points, starts).collect()} == {("a", 1, None), ("a", 5, "y"), ("a", 9, "z"), ("b", 1, None)}
    tries = spark.createDataFrame([("q", 0, True), ("q", 1, False), ("r", 0, True), ("r", 1, True)], "question string, attempt int, doubted boolean")
    assert {tuple(r) for r in S.settle(tries).collect()} == {("q", 1, True), ("r", 0, False)}


def test_index_is_saved_and_loaded(spark, base, tmp_path):
    index, frags = base
    save_index(index, str(tmp_path), SET)
    again = load_index(spark, str(tmp_path), SET)
    assert again.n == len(frags) and again.terms.count() == index.terms.count()
    assert load_index(spark, str(tmp_path), Settings(languages=("de",))) is None
    empty = build_index(spark.createDataFrame([], "name string, body string"), SET)
    assert S.search(spark.createDataFrame([(1, "refund")], "qid int, question string"), empty, SET).count() == 0


def test_saved_postings_are_read_by_bucket(spark, base, tmp_path):
    """A question's words name the buckets; the plan prunes the others, and the hits are those of the index in memory."""
    save_index(base[0], str(tmp_path / "ix"), SET)
    index = load_index(spark, str(tmp_path / "ix"), SET)
    q = spark.createDataFrame([(1, "refund receipt"), (2, "hotel approval")], "qid int, question string")
    plan = S.score_fragments(q, index, SET)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    keep = lambda df: sorted((r.qid, r.rank, r.name, r.seq, r.score) for r in df.collect())
    assert keep(S.search(q, index, SET)) == keep(S.search(q, base[0], SET))
    assert load_index(spark, str(tmp_path / "none"), SET) is None
