import random

from inkweft.llm.boilerplate import _BULLET, _DIGITS, furniture_flags, link_density, main_text, page_lines, page_runs, word_runs
from inkweft.llm.residue import Filler, fit_filler, is_filler, outside_samples, placeholders, residue, residue_kinds

PAGE = """Skip to content
Home · Search · Help
Home › Space › Rate card (Kaleb)
Child pages
Page ownership (Toler)
Link repair: Nadim
Rate card (Kaleb)
The desk, the owner and the clerk check each list, then print it.
Costs
* the price list
| a list | 12 |
Like · Watch · Share
The sign-in page shows the word Home above the list.

Recently viewed
* Import checklist: Vokos
Powered by Space Wiki 1.2 — Back to top
We use cookies to count visits. Read the cookie policy."""
OWN = {7, 8, 9, 10, 11, 13, 14}


def test_only_the_page_itself_stays():
    flags = furniture_flags(PAGE, "rate-card-kaleb.html")
    assert {i + 1 for i, f in enumerate(flags) if not f} == OWN
    odd = PAGE.replace("Home · Search", "Ηοme\u00a0·\u200b Ѕеаrсh").replace("Like", "Ｌｉｋｅ")
    assert furniture_flags(odd, "rate-card-kaleb.html") == flags


def test_title_without_help_of_the_file_name():
    flags = furniture_flags("\n".join(PAGE.split("\n")[3:]), "export.html")
    assert not flags[3] and flags[2]


def test_density():
    assert link_density("[A](/a) [B](/b)") == 1 and link_density("") == 0 and link_density("See [the list](/a) before the quarter ends") < 0.5
    assert link_density("Nadim — key cabinet") is None and link_density("Home · Search · Help") == 1 and link_density("x y", {("^", "x", "y"): 1.0, ("x", "y", "$"): 0.6}) == 0.8


GENERAL = """Products
Log in
We value your privacy. Accept cookies to continue.
Accept

# Baking bread at home
Mix the flour, the water and the salt, then wait for an hour before you knead it.

## Storage
- in a paper bag
Keep the loaf dry.

Related articles
How to keep yeast alive
Ten uses of old bread

Copyright 2024 Bread Ltd. All rights reserved."""


def test_a_page_by_itself():
    assert [k for k, f in enumerate(furniture_flags(GENERAL, "bread.html")) if not f] == [4, 5, 6, 7, 8, 9, 10, 11, 15]
    spanish = "Inicio\nProductos\nUsamos cookies para mejorar.\nAceptar\n\nCómo hacer pan\nMezcle la harina, el agua y la sal, y espere una hora.\n\nArtículos relacionados\nDiez usos del pan viejo\n\n© 2024 Pan SL."
    assert [k for k, f in enumerate(furniture_flags(spanish, "pan.html")) if not f] == [4, 5, 6, 7, 10]


def test_wording_that_no_list_has(spark):
    """Furniture in made-up words is told by the contrast of web pages with other files."""
    rng = random.Random(5)
    some = lambda pool, k: " ".join(rng.choice(pool) for _ in range(k))
    pool = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows, own = [], {}
    for i in range(900):
        body = [some(pool, 12).capitalize() + "." for _ in range(4)] + [f"- {some(pool[:20], 2)}" for _ in range(3)]
        web = i % 3 > 0
        if web:
            rng.shuffle(body)
            body[3:3] = ["Zib the trove of mokk and plim"]
            body = ["Glorp", "Snee", "Vark dolu", "Ploo quix the brell; see our snaffle.", *body, "Throg 17 mizz", "Frub by Wexo 4"]
            own[i] = [k + 1 for k in (0, 1, 2, 3, 7, len(body) - 2, len(body) - 1)]
        rows.append((i, "a.html" if web else "a.txt", "\n".join(body)))
    df = spark.createDataFrame(rows, "oid int, f string, b string")
    got: dict[int, list[int]] = {}
    for r in page_lines(df, "oid", "f", "b").collect():
        got.setdefault(r._id, []).append(r.line_no)
    right = sum(len(set(got.get(i, [])) & set(v)) for i, v in own.items())
    assert right >= 0.95 * sum(map(len, own.values())) and right >= 0.98 * sum(map(len, got.values()))


def test_error_text_is_the_page():
    page = "Home | Search\n404 Not Found The page you asked for does not exist or was moved.\nBack to top"
    assert furniture_flags(page, "x.htm") == [True, False, True]


def test_tables(spark):
    rows = [(1, "a.html", PAGE, 3), (2, "a.docx", PAGE, 3), (3, "a.html", None, 3), (4, "a.html", "", 3), (5, None, PAGE, 3), (1, "a.html", PAGE, 3)]
    df = spark.createDataFrame(rows, "oid int, f string, b string, line_no int")
    assert {r._id for r in page_lines(df, "oid", "f", "b").collect()} == {1}
    got = {r._id: r for r in main_text(df, "oid", "f", "b").collect()}
    assert got[2].text == PAGE and got[3].text is None and got[3].n_lines == 0 and got[1].n_dropped > 5 and "cookies" not in got[1].text
    assert page_lines(df.where("false"), "oid", "f", "b").count() == 0
    long = spark.createDataFrame([(9, "x.html", "Home · Help\n" + "A sentence of the page, with commas, goes on. " * 20_000)], "oid int, f string, b string")
    assert [r.line_no for r in page_lines(long, "oid", "f", "b").collect()] == [1]


PLACED = ["{{ owner }}", "{{owner.name}}", "${unit}", "{$unit}", "#{unit}", "$amount", "%%team%%", "@@unit@@", "???team???", "__title__", "<<DATE>>", "&lt;team&gt;", "<% page %>", "{% block x %}", "%(title)s", "{0} team", "[[TODO: unit]]", "[INSERT unit]", "[HIER unit EINFÜGEN]", "[вставте: unit]", "[à compléter : unit]", "[your name here]", "TBD_team", "XXXX-XX-XX", ":start_date:"]
CLEAN = ["The fee is $182 per copy [see note 270] in the set {spring, autumn}.", "Cells left empty [sic] in form 365/B", "площа {a, b} [примітка 145]", "at 10:20:30 or 3:4", "a__b snake__case", "50% of (a) s", "[Home](/home) [Help](/help)", "x << 2 >> 1"]


def test_placeholders():
    for p in PLACED:
        assert placeholders([f"The {p} of the page"]), p
    for c in CLEAN:
        assert not placeholders([c]), c


def test_samples_are_not_residue():
    text = "Write `{{ owner }}` here.\n```\n{{ x }}\nLorem ipsum dolor sit amet.\n```\n~~~\n$body\n~~~\nend"
    assert outside_samples(text) == ["Write   here.", "end"] and residue_kinds("guide.html", text) == ([], 0)
    assert residue_kinds("export_${VERSION}.html", "fine")[0] == ["placeholder"] and residue_kinds("export___last__.html", "fine")[0] == ["placeholder"]


def test_filler():
    for t in ("Lorem ipsum dolor sit amet, consectetur.", "- Text goes here. More text goes here.", "xxx xxx xxxx xx.", "Тут буде ваш текст.", "Enter a description.", "Vivamus sagittis lacus vel augue laoreet rutrum faucibus.", "Your company tagline here.", "Sample text, sample text".replace(",", "")):
        assert is_filler(t), t
    for t in ("Testers fill the form with lorem before the board sees it.", "", "The text goes here and there.", "XXX"):
        assert not is_filler(t), t


def test_error_pages():
    yes = ["Rate card (Kaleb)\nPage not found\nContact the duty desk.", "Home | Search\n502 Bad Gateway The server Kaleb did not answer in time. Try again in 3 minutes.\nBack to top", "You need to enable JavaScript to run this app.", "404\nНе вдалося завантажити документ.", "Ihr Browser führt keine Skripte aus. Lädt…", "Kaleb exige les scripts; la remise suit le badge."]
    assert [bool(residue_kinds("x.html", t)[0]) for t in yes] == [True] * 5 + [False]
    no = ["An access denied message from Kaleb means that the badge has expired.", "Rate card (Kaleb)\nPage not found\nThe desk prints the list.", "When the gateway answers 404 the import job tries again after 22 minutes.", "Rate card (Kaleb)", ""]
    assert not any(residue_kinds("x.html", t)[0] for t in no)


def test_residue_table(spark):
    rows = [(1, "a.html", "x {{ a }} y", "k"), (2, None, None, "k"), (3, "{0} t.html", None, "k"), (4, "a.txt", "Session expired", "k"), (1, "a.html", "x {{ a }} y", "k"), (5, "a.html", "ok " * 100_000, "k")]
    df = spark.createDataFrame(rows, "oid int, f string, b string, kinds string")
    assert sorted((r._id, tuple(r.kinds), r.n_placeholders) for r in residue(df, "oid", "f", "b").collect()) == [(1, ("placeholder",), 1), (1, ("placeholder",), 1), (3, ("placeholder",), 1), (4, ("error page",), 0)]
    assert residue(df.where("false"), "oid", "f", "b").count() == 0


def test_filler_needs_no_cue_word():
    learned = Filler(frozenset("quasi integra vestra pretium ultra lacus".split()))
    for line in ("Quasi integra vestra pretium ultra lacus.", "Dolor sit amet consectetur adipiscing elit.", "sed do ut"):
        assert residue_kinds("a.html", f"# Title\n\nThe desk keeps the list.\n\n{line}", None, learned) == (["filler"], 0)


def test_filler_words_are_learned(spark):
    rows = [(i, f"Lorem ipsum vomu grix tand.\nThe desk keeps list {i}.") for i in range(6)] + [(10 + i, "The desk keeps the list.") for i in range(20)] + [(40, None)]
    df = spark.createDataFrame(rows, "oid int, b string")
    assert fit_filler(df, "oid", "b") == {"lorem", "ipsum", "vomu", "grix", "tand"}
    assert fit_filler(df.where("oid > 9"), "oid", "b") == frozenset() and fit_filler(df.where("false"), "oid", "b") == frozenset()


def test_filler_words_are_counted_in_all_texts(spark):
    """A word that stands elsewhere too often, and more words than any bound on a model would hold."""
    other = spark.range(60_000).selectExpr("cast(id as int) as oid", "if(id % 2000 = 0, 'The desk keeps vomu.', 'The desk keeps the list.') as b")
    many = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) + "q" for i in range(20_500)]
    rows = [(70_000 + i, "Lorem ipsum vomu grix " + " ".join(many)) for i in range(5)]
    got = fit_filler(other.union(spark.createDataFrame(rows, "oid int, b string")), "oid", "b")
    assert got == {"lorem", "ipsum", "grix", *many}


def test_error_pages_are_told_by_all_files(spark):
    """Furniture on a dozen of many pages is known only if all of them are read."""
    files = spark.range(48_000).selectExpr("cast(id as int) as oid", "if(id % 2 = 0, 'a.html', 'a.txt') as f", "if(id < 22 and id % 2 = 0, 'Zib the trove of mokk.', 'The desk keeps the list.') as b")
    page = spark.createDataFrame([(50_000, "a.html", "Page not found\nZib the trove of mokk."), (50_001, "a.html", "Page not found\nThe desk keeps the list.")], "oid int, f string, b string")
    assert [(r._id, r.kinds) for r in residue(files.union(page), "oid", "f", "b").collect()] == [(50_000, ["error page"])]


def test_runs_of_a_page_are_those_of_its_lines():
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "Bc", "7", "42", " ", "  ", "\n", " • ", "- ", "* ", " | ", "/", " > ", ".", ":", "©", "\t", "Σ", "—", "^", "$", "_"]) for _ in range(rng.randrange(25)))
        runs = {tuple("\n" if w in ("^", "$") else w for w in r) for x in text.split("\n") for r in word_runs(_BULLET.sub("", x.strip()))}
        assert {r for r in page_runs(_DIGITS.sub("0", text.lower())) if r[1] != "\n"} == runs, text


def test_talked_about_is_not_residue():
    assert residue_kinds("a.html", "\n".join(["Write {{ name }} in the template and the engine fills it in."] * 20)) == ([], 0)
    assert residue_kinds("a.html", "The text “{{ name }}” stays.") == ([], 0)
    assert residue_kinds("a.html", "Hello {{ name }}, write {{ date }} there.") == (["placeholder"], 1)


def test_other_wordings():
    for t in ("Coming soon. This page is under construction.", "502 Bad Gateway nginx", "Sorry, we can't find that page.", "Please turn JavaScript on and reload the page.", "Necesita activar JavaScript para ver esta página."):
        assert residue_kinds("a.html", t)[0] == ["error page"], t
    for t in ("Hello [First Name]", "Dear %FIRSTNAME%,"):
        assert residue_kinds("a.html", t)[0] == ["placeholder"], t


def test_every_status_text_is_a_cue():
    for status in ("400 Bad Request", "401 Unauthorized", "403 Forbidden", "404 Not Found", "410 Gone", "500 Internal Server Error", "503 Service Unavailable", "504 Gateway Timeout"):
        assert residue_kinds("a.html", status) == (["error page"], 0)
