from datetime import datetime

from inkweft.operators.references import orphan_references, page_references, reference_status

T = lambda d, h=0: datetime(2024, 1, d, h)
REF = "key string, at timestamp, rid int, start string"
PAR = "key string, start timestamp, end timestamp, rid int"


def brute(refs, parents):
    out = []
    for key, at, rid, _ in refs:
        if key is None:
            continue
        own = [(s, e) for k, s, e, _ in parents if k == key and s is not None]
        if not own:
            st = "missing"
        elif at is not None and any(s <= at and (e is None or e > at) for s, e in own):
            st = "held"
        elif at is None or all(s > at for s, _ in own):
            st = "late"
        else:
            st = "deleted"
        out.append((rid, st))
    return sorted(out)


def run(spark, refs, parents):
    got = reference_status(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR))
    assert "start" in got.columns  # a carried column whose name is also one of the parents
    return sorted((r.rid, r.status) for r in got.collect())


def test_kinds_ties_nulls_and_repeats(spark):
    parents = [("a", T(2), T(5), 0), ("a", T(9), None, 0), ("a", T(2), T(5), 0), ("b", T(3), T(4), 0), (None, T(1), None, 0), ("c", None, None, 0), ("d", T(4), T(4), 0)]
    refs = [(k, t, i, "x") for i, (k, t) in enumerate([("a", T(1)), ("a", T(2)), ("a", T(4, 23)), ("a", T(5)), ("a", T(9)), ("b", T(4)), ("b", T(3)), ("c", T(9)), (None, T(1)), ("d", T(4)), ("z", T(1)), ("a", None), ("", T(1))])]
    refs += refs[:3]
    assert run(spark, refs, parents) == brute(refs, parents)


def test_many_segments_and_a_hot_key(spark):
    import random

    r = random.Random(3)
    day = lambda: T(r.randint(1, 28), r.randint(0, 23))
    parents = [(r.choice("hhhab"), s, None if r.random() < 0.1 else max(s, day()), 0) for s in (day() for _ in range(60))]
    refs = [("h" if r.random() < 0.5 else r.choice("abc"), day(), i, None) for i in range(400)]
    assert run(spark, refs, parents) == brute(refs, parents)


def test_empty_tables(spark):
    assert run(spark, [], [("a", T(1), None, 0)]) == []
    assert run(spark, [("a", T(1), 1, None)], []) == [(1, "missing")]


def test_urls_and_ids_of_the_base(spark):
    docs = spark.createDataFrame([(1, "b1", (" '77' ", "HTTPS://KB.One.example/x/?src=1&pageId=5#top"), T(5)), (2, "b1", (None, "https://elsewhere.invalid/x"), T(5)), (3, None, ("", None), T(5))], "doc_no bigint, base_key string, frontmatter struct<source_id string, source_url string>, synced_at timestamp")
    cards = spark.createDataFrame([(9, "\t77", T(1))], "card_id bigint, source_id string, written_at timestamp")
    links = spark.createDataFrame([(4, "b1", "/guide/p/", T(5)), (4, "b1", "/guide/p/", T(5)), (5, None, "/guide/p", T(5)), (6, "b1", "http://kb.one.example/guide/q", T(5))], "link_id bigint, base_key string, url string, seen_at timestamp")
    bases = spark.createDataFrame([("b1", "kb.one.example"), (None, "x.example")], "base_key string, host string")
    registry = spark.createDataFrame([("77", "https://kb.one.example/x?pageId=5", T(2), None), ("78", "http://kb.one.example/guide/p#a", T(2), T(4))], "page_id string, url string, registered_at timestamp, removed_at timestamp")
    keys = sorted((r.ref_table, r.ref_id, r.key) for r in page_references(docs, cards, links, bases).collect())
    assert keys == [("cards", 9, "i:77"), ("docs", 1, "i:77"), ("docs", 1, "u:kb.one.example/x?pageId=5"), ("docs", 3, "i:"), ("links", 4, "u:kb.one.example/guide/p"), ("links", 4, "u:kb.one.example/guide/p"), ("links", 6, "u:kb.one.example/guide/q")]
    got = sorted(tuple(r) for r in orphan_references(docs, cards, links, registry, bases).collect())
    assert got == [("cards", "2024-01", 9, "source_id", "late"), ("docs", "2024-01", 3, "source_id", "missing"), ("links", "2024-01", 4, "url", "deleted"), ("links", "2024-01", 6, "url", "missing")]


def test_hot_segments_are_dealt_to_parts(spark, monkeypatch):
    """A day with a bulk of references, and references without a time, give the same in parts."""
    from inkweft.operators import references

    monkeypatch.setattr(references, "HOT", 10)
    parents = [("a", T(2, 5), T(2, 9), 0), ("a", T(2, 12), None, 0), ("b", T(3), T(4), 0)]
    refs = [("a", T(2, i % 24), i, "x") for i in range(60)] + [("a", None, 100 + i, "x") for i in range(25)] + [("b", T(5), 200, "x"), ("z", None, 201, "x")]
    assert run(spark, refs, parents) == brute(refs, parents)
