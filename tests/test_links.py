from inkweft.operators import links as L

REG = "name string, page_id string, url string, source_file string, title string"
ROWS = [
    ("expenses.md", "1001", "https://wiki.site.example/pages/1001/Expenses", "Expenses.html", "Expenses"),
    ("travel.md", "1002", "https://wiki.site.example/display/HR/Travel", "Travel rules.html", "Travel"),
    ("sp-800-63.md", "", "", "NIST.SP.800-63-3.pdf", "Digital identity 800-63-3"),
    ("one.md", "", "", "memo 100-7.txt", "One"),
    ("two.md", "", "", "memo 100-7.html", "Two"),
]
HOSTS = ["wiki.site.example"]


def table(spark, links):
    return spark.createDataFrame([("me.md", i, f"l{i}", u) for i, u in enumerate(links)], "name string, pos int, label string, url string")


def test_extraction(spark):
    docs = spark.createDataFrame([("a", "see [x](u1) and ![pic](p.png) [](u2) [b c](u3 t)"), ("b", None)], "name string, body string")
    assert [(r.pos, r.label, r.url) for r in L.extract_links(docs).orderBy("pos").collect()] == [(0, "x", "u1"), (1, "", "u2")]


def test_kinds(spark):
    urls = ["#a", "mailto:x@y", "tel:1", "http://a", "HTTPS://a", "/x", "../a/b.md", "b.md", "Sized", "?!bat$", "b.html#x"]
    got = [r.kind for r in table(spark, urls).select("pos", L.link_kind(L.F.col("url")).alias("kind")).orderBy("pos").collect()]
    assert got == ["anchor", "scheme", "scheme", "page", "page", "page", "page", "page", "code", "code", "page"]


def test_resolution(spark):
    reg = spark.createDataFrame(ROWS, REG)
    cases = {
        "https://wiki.site.example/x?pageId=1001": ("expenses.md", 1), "/pages/1002/": ("travel.md", 1), "https://else.example/x?pageId=1001": (None, None),
        "http://wiki.site.example/display/hr/travel/#top": ("travel.md", 2), "../hr/Travel%20rules.html": ("travel.md", 3), "https://nist.example/pubs/800-63-3/final": ("sp-800-63.md", 4),
        "https://nist.example/pubs/800-63/": ("sp-800-63.md", 4), "https://x.example/memo/100-7/": (None, None), "mailto:a@b.c": (None, None), "travel.md": (None, None), "https://x.example/docs/expenses.pdf": ("expenses.md", 3),
    }
    rows = {r.url: r for r in L.resolve(table(spark, list(cases)), reg, HOSTS).collect()}
    assert {u: (rows[u].target, rows[u].rule) for u in cases} == cases
    own = L.resolve(table(spark, ["/pages/1001/"]).withColumn("name", L.F.lit("expenses.md")), reg, HOSTS).first()
    assert own.target is None and own.self


def test_relink_edges_missing_and_idempotence(spark):
    reg = spark.createDataFrame(ROWS, REG)
    body = "See [travel](/pages/1002/#id-Rules%20here), [me](/pages/1001/), ![p](/pages/1002/), [gone](/display/HR/Gone+Page), [out](https://other.example/y), [n](/pages/77/)."
    docs = spark.createDataFrame([("expenses.md", body), ("plain.md", "no link"), ("none.md", None)], "name string, body string")
    found = L.resolve(L.extract_links(docs), reg, HOSTS)
    once = L.relink(docs, found)
    text = {r.name: r.body for r in once.collect()}
    assert text["expenses.md"] == body.replace("[travel](/pages/1002/#id-Rules%20here)", '[travel](travel.md "Rules here")').replace("[me](/pages/1001/)", "me")
    assert text["plain.md"] == "no link" and text["none.md"] is None
    twice = L.relink(once, L.resolve(L.extract_links(once), reg, HOSTS))
    assert {r.name: r.body for r in twice.collect()} == text
    assert [tuple(r) for r in L.edges(found).collect()] == [("expenses.md", "travel.md")]
    assert {(r.key, r.n_labels) for r in L.missing_pages(found, HOSTS).collect()} == {("gone-page", 1), ("77", 1)}
    assert tuple(L.link_stats(found).first()) == (1, 1, 1)


def test_pictures_and_nodes(spark):
    refs = spark.createDataFrame([("z", "download/attachments/7/a%20b.png?v=1"), ("z", "x/only.png"), ("z", "none.png")], "archive string, src string")
    att = spark.createDataFrame([("z", "download-attachments-7-a b.png", "download/attachments/7/a b.png"), ("z", "y-only.png", "y/only.png")], "archive string, member string, path string")
    assert {r.src: r.member for r in L.shipped_pictures(refs, att).collect()} == {"download/attachments/7/a%20b.png?v=1": "download-attachments-7-a b.png", "x/only.png": "y-only.png", "none.png": None}
    edges = spark.createDataFrame([("a b.md", "c.md")], "src string, dst string")
    assert {r.node for r in L.graph_nodes(edges).collect()} == {"a_b_md", "c_md"}
    assert [r.line for r in L.graph_text(edges).collect()] == ["graph LR", '  a_b_md["a b"] --> c_md["c"]']
