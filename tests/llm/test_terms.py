import math
from collections import Counter

from inkweft.llm.terms import term_scores, top_terms

SCHEMA = "rid bigint, body array<string>, head array<string>, term string, tf int, _id string, df int"


def frame(spark, rows):
    return spark.createDataFrame([(i, b, h, "clash", 7, "clash", 9) for i, b, h in rows], SCHEMA)


def brute(rows):
    recs = {}
    for i, b, h in rows:
        recs[i] = (b or [], h or [])
    n, df, cf = len(recs), Counter(), Counter()
    for b, h in recs.values():
        own = Counter(x for x in b + h if x is not None)
        for t, c in own.items():
            df[t] += 1
            cf[t] += c
    out = {}
    for i, (b, h) in recs.items():
        own = Counter(x for x in b + h if x is not None)
        for t, c in own.items():
            ridf = math.log2(n / df[t]) + math.log2(1 - math.exp(-cf[t] / n))
            out[i, t] = (c, df[t], cf[t], round(ridf, 9), round(c * ridf, 9), round(math.log(1 + n / df[t]) * (2 if t in h else 1), 9))
    return out


ROWS = [(1, ["a", "b", "b", None, ""], ["c"]), (2, ["a"], None), (3, None, None), (4, [], []), (5, ["a", "d"], ["a"]), (5, ["a", "d"], ["a"]), (None, ["a", "e"], []), (6, ["w%d" % (i % 50) for i in range(3000)], ["z"])]


def test_scores_equal_brute_force(spark):
    got = {(r._id, r.term): (r.tf, r.df, r.cf, r.ridf, r.score, r.weight) for r in term_scores(frame(spark, ROWS), "rid", "body", "head").collect()}
    want = brute(ROWS)
    assert got.keys() == want.keys()
    for k in want:
        assert all(abs(a - b) < 1e-6 for a, b in zip(got[k], want[k])), (k, got[k], want[k])


def test_top_terms_breaks_ties_by_code_point(spark):
    rows = [(1, ["é", "z", "Z", "a", "\U0001f600"], []), (2, ["q"], [])]
    for most in (400_000, 1):
        top = top_terms(frame(spark, rows), "rid", "body", "head", "weight", 3, most)
        assert [r.term for r in top.where("_id = 1").orderBy("rank").collect()] == ["Z", "a", "z"]
        assert top.where("_id = 2").count() == 1


def test_both_ways_pick_the_same(spark):
    for by in ("score", "weight"):
        got = [sorted((str(r._id), r.term, r.tf, r.in_head, r.df, r.cf, r.ridf, r.score, r.weight, r.rank) for r in top_terms(frame(spark, ROWS), "rid", "body", "head", by, 4, most).collect()) for most in (400_000, 0)]
        assert got[0] == got[1] and len(got[0]) > 8
    assert top_terms(frame(spark, []), "rid", "body", "head", "score", 3).count() == 0


def test_poisson_term_counts_little(spark):
    """Spread evenly a term is as a Poisson model expects; gathered in few records it scores."""
    rows = [(i, ["spread"] if i % 2 else ["x%d" % i], []) for i in range(100)] + [(200, ["dense"] * 50, [])]
    got = {r.term: r.ridf for r in term_scores(frame(spark, rows), "rid", "body", "head").where("term in ('spread', 'dense')").collect()}
    assert got["dense"] > 4 and abs(got["spread"]) < 0.5


def test_empty_table_and_no_heads(spark):
    assert term_scores(frame(spark, []), "rid", "body", "head").count() == 0
    assert term_scores(frame(spark, ROWS), "rid", "body").where("in_head").count() == 0


def test_large_vocabulary_is_joined_without_broadcast(spark, monkeypatch):
    from inkweft import runtime

    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 0)
    got = term_scores(frame(spark, ROWS), "rid", "body", "head")
    assert got.count() == len(brute(ROWS))
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
