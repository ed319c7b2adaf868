import json
import os
import zipfile

from pyspark.sql import functions as F

from inkweft import sql as own_sql
from inkweft.base import Base
from inkweft.config import Settings
from inkweft.sources import scan, sinks
from inkweft.streaming.ingest import ingest_stream, windowed_counts


def page(pid, title, body):
    return f'<html><head><meta name="ajs-page-id" content="{pid}"><title>{title}</title></head><body><div id="main-content"><h1>{title}</h1>{body}</div></body></html>'


def drop(base, name, text):
    with open(f"{base.path}/originals/{name}", "w", encoding="utf-8") as f:
        f.write(text)


def test_sync_search_verify(spark, tmp_path):
    base = Base.create(spark, str(tmp_path / "kb"), ("en",), ("wiki.site.example",))
    drop(base, "expenses.html", page(1001, "Expense reports", '<p>Receipts are needed within 14 days. See <a href="https://wiki.site.example/x?pageId=1002">travel</a>.</p>'))
    drop(base, "travel.html", page(1002, "Travel rules", "<p>Hotels above the limit need approval of the manager.</p>"))
    drop(base, "copy.html", page(1002, "Travel rules", "<p>Hotels above the limit need approval of the manager.</p>"))
    first = {r.name: (r.outcome, r.detail) for r in base.sync().collect()}
    assert first["expenses.html"] == ("written", "expense-reports.md") and "travel.html" not in first  # equal content: the first by name
    docs = {r.name: r.body for r in base.documents().collect()}
    assert "[travel](travel-rules.md)" in docs["expense-reports.md"]
    assert base.sync().count() == 0
    drop(base, "expenses.html", page(1001, "Expense reports", "<p>Receipts are needed within 30 days.</p>"))
    assert [(r.name, r.outcome) for r in base.sync().collect()] == [("expenses.html", "written")]
    assert base.spark.read.parquet(f"{base.path}/history").count() >= 1
    hits = base.search(spark.createDataFrame([(1, "hotel approval")], "qid int, question string"))
    assert hits.where("rank = 1").first().name == "travel-rules.md"
    assert base.outline("travel").where("heading = 'Travel rules'").count() == 1 and base.read("travel-rules.md", 1, 2).count() == 2
    cards = spark.createDataFrame([("t", "c", 'source_id: "1001"\nReceipts within 30 days'), ("t", "o", "nothing")], "topic string, card string, text string")
    rows = {(r.card, r.claim): r.confirmed for r in base.verify(cards).collect()}
    assert rows["c", "30 days"] is True and rows["o", None] is None
    asked = spark.createDataFrame([("who approves hotels above the limit", ["approval of the manager"], False), ("what of zeppelins", None, True)], "question string, answer array<string>, absent boolean")
    facts = spark.createDataFrame([("hotels above the limit", "travel-rules.md"), ("never said", None)], "fact string, document string")
    out, held = base.selftest(asked, facts)
    assert {r.question[:3]: r.outcome for r in out.collect()} == {"who": "search", "wha": "honest"} and sorted(r.held for r in held.collect()) == [False, True]
    assert base.find("hotel approval").first().name == "travel-rules.md"
    assert {r.item: r.n for r in base.status().collect()}["documents"] == 2
    assert Base.open(spark, f"{base.path}/originals").path == base.path and Base.open(spark, "/") is None


def png(width=300, height=200):
    return b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + width.to_bytes(4, "big") + height.to_bytes(4, "big") + b"x" * 9000


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def card(base, topic, source, pid, text=""):
    put(f"{base.path}/cards/{topic}/ask.md", f'---\nsource: kb/text/{source}\nsource_page_id: "{pid}"\n---\n\n# Card\n{text}\n')


def test_a_base_takes_in_what_is_dropped_and_keeps_its_cards_current(spark, tmp_path):
    root = str(tmp_path / "kb")
    put(f"{root}/languages/xx.json", json.dumps({"stopwords": ["zzq"], "translit": {"ǆ": "dz"}}))
    put(f"{root}/languages/bad.json", "{")
    base = Base.create(spark, root, ("en", "xx"), keep=("start here.txt",))
    assert "zzq" in base.settings.stopwords and dict(base.settings.letters) == {"ǆ": "dz"}
    for name in ("CLAUDE.md", "README.md", "START HERE.txt"):
        put(f"{root}/{name}", "# No document\n")
    put(f"{root}/Whatever Page.html", page(1, "Travel booking", "<p>Domestic trips need five days. <em>Ask the travel desk first of all</em></p>"))
    put(f"{root}/Copy.html", page(1, "Travel booking", "<p>Domestic trips need five days. <em>Ask the travel desk first of all</em></p>"))
    picture = page(7, "Kafka mirroring", '<p>The diagram.</p><img alt="the topology" src="download/attachments/27/mirror%20maker.png">')
    with zipfile.ZipFile(f"{root}/space.zip", "w") as z:
        z.writestr("K/Kafka_27.html", picture)
        z.writestr("K/download/attachments/27/mirror maker.png", png())
        z.writestr("K/styles/site.css", "body{}")
    rows = {r.name: (r.outcome, r.detail) for r in base.sync().collect()}
    assert rows["Copy.html"] == ("collected", "copy.html") and rows["Whatever Page.html"] == ("copy", None) and rows["space.zip"] == ("collected", "space.zip")
    assert sorted(os.listdir(f"{root}/originals")) == ["copy.html", "space.zip"] and {"CLAUDE.md", "README.md", "START HERE.txt"} <= set(os.listdir(root))
    docs = {r.name: r.body for r in base.documents().collect()}
    assert set(docs) == {"travel-booking.md", "kafka-mirroring.md"} and "![the topology](assets/kafka-mirroring/attachment-1.png)" in docs["kafka-mirroring.md"]
    assert [(r.name, r.file, len(r.content)) for r in base.assets().collect()] == [("kafka-mirroring.md", "attachment-1.png", len(png()))]
    assert base.integrity().count() == 0 and base.sync().count() == 0
    card(base, "travel", "travel-booking.md", "1", "Domestic trips need ten days")
    card(base, "moved", "old-name.md", "7")
    put(f"{root}/copy.html", page(1, "Travel booking", "<p>Domestic trips need 10 days.</p>"))
    rows = {r.name: r.outcome for r in base.sync().collect()}
    assert rows["moved/ask.md"] == "card bound anew"
    with open(f"{root}/cards/moved/ask.md") as f:
        assert "kb/text/kafka-mirroring.md" in f.read()
    assert [r.topic for r in base.stale().collect()] == ["travel"]
    told = {(r.item, r.detail): r.n for r in base.status().collect()}
    assert told["stale topics", None] == 1 and told["documents", None] == 2 and told["changed", "travel-booking.md"] >= 2
    card(base, "travel", "travel-booking.md", "1", "Domestic trips need 10 days")
    base.verify()
    assert base.stale().count() == 0  # every card of the topic holds
    lines = base.notice(spark.createDataFrame([(1, "crash the zeppelin")], "qid int, question string"), base.search(spark.createDataFrame([(1, "crash the zeppelin")], "qid int, question string"))).collect()
    assert {r.part for r in lines} >= {"reason", "unknown word"} and [r.text for r in lines if r.part == "unknown word"] == ["crash", "zeppelin"]
    asked = spark.createDataFrame([("q", 1, "crash the zeppelin"), ("q", 2, "domestic trips")], "question string, attempt int, asked string")
    assert [(r.attempt, r.settled, r.name) for r in base.ask(asked).collect()] == [(2, True, "travel-booking.md")]
    assert [r.line for r in base.graph().collect()] == ["graph LR"]


def test_a_pdf_of_a_page_in_another_format_is_left_out(spark):
    from inkweft.operators.quality import richer_format

    files = spark.createDataFrame([("a.html", "7"), ("a.pdf", "7"), ("b.pdf", "8"), ("c.pdf", "")], "name string, page_id string")
    assert sorted(r.name for r in richer_format(files).collect()) == ["a.html", "b.pdf", "c.pdf"]


def test_history_is_pruned(spark, tmp_path):
    path = str(tmp_path / "history")
    for k in range(4):
        sinks.append_history(spark.createDataFrame([("a.md", f"d{k}", 1, 1), *([("b.md", "d", 1, 1)] if k == 0 else [])], "name string, diff string, added int, removed int"), path, keep=2)
    assert sorted((r.name, r.diff) for r in spark.read.parquet(path).collect()) == [("a.md", "d2"), ("a.md", "d3"), ("b.md", "d")]


def test_json_cases(spark, tmp_path):
    put(f"{tmp_path}/cases/a.json", json.dumps({"document": "d.md", "anchors": [{"fact": "f"}, {"fact": "g", "document": "e.md"}], "questions": [{"question": "q", "answer": ["x"]}, {"question": "r", "absent": True}]}))
    put(f"{tmp_path}/cases/b.json", "{nope")
    questions, facts, broken = scan.scan_json_cases(spark, f"{tmp_path}/cases")
    assert sorted((r.question, r.answer, r.absent) for r in questions.collect()) == [("q", ["x"], False), ("r", [], True)]
    assert sorted((r.fact, r.document) for r in facts.collect()) == [("f", "d.md"), ("g", "e.md")] and [r.file for r in broken.collect()] == ["b.json"]


def test_own_letters_come_before_accents():
    from inkweft.operators.quality import transliterate_text

    assert transliterate_text("årsbasis Ødegård", {"å": "aa", "ø": "oe"}) == "aarsbasis OEdegaard" and transliterate_text("procédure", {"å": "aa"}) == "procedure"


def test_stream_takes_in_only_what_changed(spark, tmp_path):
    drop_folder, out, ck = (str(tmp_path / x) for x in ("drop", "docs", "ck"))
    os.makedirs(drop_folder)
    for i, text in enumerate(("# A\n\none", "# B\n\ntwo")):
        with open(f"{drop_folder}/f{i}.md", "w") as f:
            f.write(text)
    ingest_stream(spark, drop_folder, out, ck).awaitTermination()
    with open(f"{drop_folder}/f2.md", "w") as f:
        f.write("# C\n\nthree")
    ingest_stream(spark, drop_folder, out, ck).awaitTermination()
    assert sorted(r.title for r in sinks.latest(spark, out).collect()) == ["A", "B", "C"] and spark.read.parquet(out).count() == 3


def test_windows(spark):
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 1.5D value union all select timestamp'2024-01-01 00:50:00', 'a', 2D union all select timestamp'2024-01-01 01:00:00', 'a', 1D")
    assert [(r.n, r.total) for r in windowed_counts(rows).orderBy("window_start").collect()] == [(2, 3.5), (1, 1.0)]


def test_sql_functions(spark):
    own_sql.register(spark, Settings(languages=("en",)))
    own_sql.register_tables(spark, {"t_docs": spark.createDataFrame([("The refunds **are** [paid](x)",)], "x string")})
    r = spark.sql("select stems(x) s, flat_text(x) f, clean_markup(x) c, slug_of('A b!') g, number_forms('1,5') n from t_docs").first()
    assert r.s == ["refund", "paid"] and r.f == "therefundsarepaid" and r.c == "The refunds are paid" and r.g == "a-b" and sorted(r.n) == ["1,5", "1.5", "15"]


def test_scans_and_sinks(spark, tmp_path):
    root = str(tmp_path)
    for p, text in (("text/a.md", "x"), ("text/_skip.md", "x"), ("assets/a/descriptions.md", "pic"), ("cards/topic/card one.md", "c\nd"), ("cases/x.txt", "? q\n= a\n"), ("drop/A.html", "same"), ("drop/b.html", "same"), ("drop/README.md", "keep"), ("lang/xx.json", '{"stopwords": "a b"}'), ("lang/bad.json", "{")):
        os.makedirs(os.path.dirname(f"{root}/{p}"), exist_ok=True)
        with open(f"{root}/{p}", "w") as f:
            f.write(text)
    assert sorted(r.name for r in scan.scan_corpus(spark, root).collect()) == ["a.md", "assets/a/descriptions.md"]
    assert [(r.topic, r.text) for r in scan.scan_cards(spark, root).collect()] == [("topic", "c\nd")]
    assert [(r.file, r.pos, r.line) for r in scan.scan_cases(spark, f"{root}/cases").orderBy("pos").collect()][:2] == [("x.txt", 0, "? q"), ("x.txt", 1, "= a")]
    files = scan.scan_files(spark, f"{root}/drop")
    assert [r.name for r in scan.collect_dropped(files, files.where("false")).collect()] == ["A.html"]
    assert scan.language_files(spark, f"{root}/lang") == {"xx": {"stopwords": ["a", "b"], "letters": {}}}
    with open(f"{root}/ok.json", "w") as f:
        json.dump([{"question": "q", "extra": 1}], f)
    with open(f"{root}/broken.json", "w") as f:
        f.write("{nope")
    assert scan.read_json(spark, f"{root}/ok.json", "question string").first().question == "q"
    assert scan.read_json(spark, f"{root}/broken.json", "question string").count() == 0 and scan.read_json(spark, f"{root}/none.json", "question string").count() == 0
    assert sinks.read_snapshot(spark, f"{root}/snap") is None
    for n in (1, 2):
        sinks.write_snapshot(spark.range(n), f"{root}/snap")
    assert sinks.read_snapshot(spark, f"{root}/snap").count() == 2


def test_every_registered_query_runs(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if not n.startswith("p")]
    assert len(names) > 50 and set(entry.oracle_sql()) <= set(entry.queries())
    for n in ("token_counts", "resolved_by_key", "history_changes", "p6_found"):
        assert entry.queries()[n](spark, "/root/testdata/sf0.001").count() >= 0
    assert entry.entry(spark).count() > 0
