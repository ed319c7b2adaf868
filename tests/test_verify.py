import random

from inkweft.config import Settings
from inkweft.operators import evaluate as E
from inkweft.operators import history as H
from inkweft.operators import selftest as ST
from inkweft.operators import verify as V
from inkweft.operators.index import build_index

SET = Settings(languages=("en",))


def test_claims(spark):
    cards = spark.createDataFrame([("c", "---\nsource: a.md\n---\n1. Pay 1 000 EUR within 14 days (`a.md:12`).\n2) At 23:59 15 May, :48, 12.5 %\n\"two words\" `one` «a b c»")], "card string, text string")
    assert [(r.value, r.unit) for r in V.number_claims(cards).orderBy("pos").collect()] == [("1 000", "EUR"), ("14", "days"), ("23", ""), ("59", ""), ("15", "May"), ("12.5", "%")]
    assert [r.quote for r in V.quote_claims(cards).orderBy("pos").collect()] == ["two words", "a b c"]


def test_confirmation(spark):
    docs = spark.createDataFrame([("a.md", "1", "1. The refund takes 14 days after receipt of the parcel. It costs 1,000 euros. Fifteen working hours."), ("b.md", "2", "Deliveries take 96 hours.")], "name string, page_id string, body string")
    cards = spark.createDataFrame([("c", 'source_id: "1"\nThe refund takes 14 days.\nIt takes 14 weeks.\nCosts 1 000 euros\n15 hours\n1 day\n96 hours\n"after receipt of" "never said this"'), ("o", "no source"), ("m", "see b.md for 96 hours")], "card string, text string")
    sources = V.card_sources(cards, docs)
    assert {tuple(r) for r in sources.collect()} == {("c", "a.md"), ("m", "b.md")}
    assert [r.card for r in V.orphan_cards(cards, sources).collect()] == ["o"]
    ctx = V.number_contexts(docs, ["en"])
    claims = V.number_claims(cards).where("value <> '1' or unit <> ''")
    rows = {(r.card, r.value, r.unit): r.confirmed for r in V.confirm_numbers(claims, sources, ctx, SET).collect()}
    assert rows == {("c", "14", "days"): True, ("c", "14", "weeks"): False, ("c", "1 000", "euros"): True, ("c", "15", "hours"): True, ("c", "1", "day"): False, ("c", "96", "hours"): False, ("m", "96", "hours"): True}
    lost = V.found_elsewhere(V.confirm_numbers(claims, sources, ctx, SET).where("not confirmed"), ctx, SET)
    assert [(r.card, r.elsewhere) for r in lost.collect()] == [("c", "b.md")]
    quotes = {r.quote: r.confirmed for r in V.confirm_quotes(V.quote_claims(cards), sources, docs).collect()}
    assert quotes == {"after receipt of": True, "never said this": False}


def test_stale_marks(spark):
    stale = spark.createDataFrame([("t",), ("u",), ("v",)], "topic string")
    results = spark.createDataFrame([("t", "a", True), ("t", "b", True), ("u", "a", True), ("u", "a", False)], "topic string, card string, confirmed boolean")
    assert [r.topic for r in V.clear_stale(stale, results).collect()] == ["t"]


def test_histories(spark):
    before = spark.createDataFrame([("a", "one\ntwo\nthree"), ("b", "same"), ("gone", "x")], "name string, body string")
    now = spark.createDataFrame([("a", "one\n2\nthree\nfour"), ("b", "same"), ("new", "y")], "name string, body string")
    assert {tuple(r) for r in H.snapshot_changes(before, now).collect()} == {("a", "changed"), ("gone", "removed"), ("new", "added")}
    d = H.unified_diffs(before, now).first()
    assert (d.name, d.added, d.removed) == ("a", 2, 1) and "+2" in d.diff
    assert {r.name: (r.added, r.removed) for r in H.unit_changes(before, now).collect()} == {"a": (2, 1), "gone": (0, 1), "new": (1, 0)}
    log = spark.createDataFrame([(i, f"l{i}") for i in range(15)], "pos int, line string")
    assert [r.line for r in H.first_lines(log, 12).orderBy("pos").collect()][-1] == "… and 3 more"
    cards = spark.createDataFrame([("t", "c", 'source: old.md\nsource_id: "7"\nbody')], "topic string, card string, text string")
    docs = spark.createDataFrame([("7", "new.md")], "page_id string, name string")
    assert "source: new.md" in H.heal_sources(cards, docs).first().text
    assert [r.topic for r in H.stale_topics(cards, spark.createDataFrame([("old.md",)], "name string")).collect()] == ["t"]
    files = spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 1, "y"), ("c", 9, 1, "z")], "name string, mtime_ns bigint, size bigint, sha1 string")
    man = spark.createDataFrame([("a", 1, 1, "q"), ("b", 1, 1, "y")], "name string, mtime_ns bigint, size bigint, sha1 string")
    assert [r.name for r in H.work_list(files, man).collect()] == ["c"]


def test_markers(spark):
    rows = [(1, "This sentence has the word alpha in it. This other one is free of such things. Tiny.", ["alpha", "beta"]), (2, "x" * 20 + " " + "y" * 60 + " " + "z" * 60, ["none"]), (3, "short", ["a"])]
    got = {r.pid: (r.marker, r.overlap) for r in E.pick_markers(spark.createDataFrame(rows, "pid int, body string, words array<string>")).collect()}
    assert got[1] == ("This other one is free of such things.", 0) and got[2][1] == 0 and 3 not in got


def test_selftest(spark):
    docs = spark.createDataFrame([("a", "The quick brown fox jumps over the lazy dog near the river bank today."), ("b", "Other **text**.")], "name string, body string")
    passages = spark.createDataFrame([("a", "quick brown fox jumps over the lazy dog"), ("a", "none of these words stand anywhere in this page at all"), ("a", "too few words")], "name string, passage string")
    assert [r.passage[:4] for r in ST.missing_passages(passages, docs).collect()] == ["none"]
    facts = spark.createDataFrame([("Lazy dog", "a"), ("lazy dog", "b"), ("other text", None), ("nothing", None)], "fact string, document string")
    assert {(r.fact, r.document): r.held for r in ST.anchors(facts, docs).collect()} == {("Lazy dog", "a"): True, ("lazy dog", "b"): False, ("other text", None): True, ("nothing", None): False}
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(["# c", "? q1", "= a1", "= a2", "! q2", ""])], "file string, pos int, line string")
    assert [(r.kind, r.question, r.value) for r in ST.parse_cases(lines).orderBy("line").collect()] == [("question", "q1", None), ("answer", "q1", "a1"), ("answer", "q1", "a2"), ("absent", "q2", None)]
    q = spark.createDataFrame([("a", False, 0, False, False, False, False), ("b", True, 0, False, False, False, True), ("c", True, 0, False, False, False, False), ("d", False, 1, True, False, True, False), ("e", False, 1, False, True, True, False), ("f", False, 1, False, False, True, False), ("g", False, 1, False, False, False, False)], "question string, absent boolean, n_answers int, in_hits boolean, in_cards boolean, in_base boolean, doubted boolean")
    assert [r.outcome for r in ST.outcomes(q).orderBy("question").collect()] == ["broken", "honest", "confident", "search", "card", "dangerous", "missing"]
    was, now = (spark.createDataFrame(x, "question string, outcome string") for x in ([("a", "search"), ("b", "card"), ("c", "card")], [("a", "search"), ("b", "missing"), ("d", "search")]))
    assert {tuple(r) for r in ST.changed_outcomes(was, now).collect()} == {("b", "card", "missing"), ("c", "card", None), ("d", None, "search")}


def test_cases_never_carry_texts_with_each_word(spark):
    """Each word had its fragment's text with it, and the texts were shuffled again for their markers."""
    docs = [(f"d{i}.md", f"# Topic {i}\n\n" + " ".join(f"Sentence {k} about subject{i}x{k} tells of matter{k} and detail{i + k} here." for k in range(6))) for i in range(6)]
    index = build_index(spark.createDataFrame(docs, "name string, body string"), SET)
    cases = E.generate_cases(index, SET, 5)
    assert "Generate" not in cases._jdf.queryExecution().optimizedPlan().toString()
    idf = {r.token: r.idf for r in index.terms.collect()}
    told = {r.fid: r for r in E._telling(index).collect()}
    for f in index.fragments.collect():
        order = sorted(f.body_stems, key=lambda t: (idf[t], t.encode()), reverse=True)
        r = told[f.fid]
        assert (list(r.asked), r.n) == (order[1:7], len(order)) and abs(r.weight - sum(idf[t] for t in order)) < 1e-8


def test_hits_and_not_texts_are_sent_round(spark):
    """Whether a case is found: the texts were shuffled to meet a few hits."""
    index = build_index(spark.createDataFrame([("a.md", "# A\n\nThe marker stands in this sentence.")], "name string, body string"), SET)
    hits = spark.createDataFrame([(1, 1, "a.md", 0)], "qid int, rank int, name string, seq int")
    cases = spark.createDataFrame([(1, "marker stands", "a.md")], "qid int, marker string, file string")
    row = E.evaluate(cases, hits, index.texts)
    assert "strategy=broadcast" in row._jdf.queryExecution().optimizedPlan().toString() and row.first().at1 == 1
