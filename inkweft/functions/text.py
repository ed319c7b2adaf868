"""Column expressions over text: words, stems, markup, numbers, names.

Everything here is built from Spark's own functions, so it stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkweft.functions.language import number_words

# What a word, a line break, a fence and a heading are.
WORD = r"[\p{L}\p{N}_'’]+"
#: Characters cut from both ends of a word before it is shortened.
EDGES = "«»\"'.,:;!?()[]–—-"
#: Line breaks of every kind.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
FENCE = r"^\s*(?:```|~~~)"
HEADING = r"^(#{1,6})\s+(.*)$"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def stem(word: Column, length: int) -> Column:
    return F.substring(F.btrim(F.lower(word), F.lit(EDGES)), 1, length)


def stems(text: Column, stop: list[str], length: int) -> Column:
    """Distinct stems: words of more than one character that are no stop words, trimmed and shortened."""
    out = F.array(*[F.lit(w) for w in stop]) if stop else F.array().cast("array<string>")
    kept = F.filter(tokens(text), lambda w: (F.length(w) > 1) & ~F.array_contains(out, F.lower(w)))
    return F.array_distinct(F.transform(kept, lambda w: stem(w, length)))


def clean(line: Column) -> Column:
    """Links become their labels; emphasis and code marks go."""
    return F.regexp_replace(F.regexp_replace(line, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"\*{1,3}|`", "")


def flat(text: Column) -> Column:
    """Letters and digits only, lower-case, links as their labels."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")), r"[^\p{L}\p{N}]+", "")


def plain(text: Column, links: bool = False, pipes: bool = False) -> Column:
    """Without emphasis marks, white space collapsed, lower-case."""
    if links:
        text = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, "[*_`~|]" if pipes else "[*_`~]", ""), r"(?U)\s+", " ")))


def lines(text: Column) -> Column:
    """Lines without their ends; a break at the very end opens no further line."""
    return F.split(F.regexp_replace(text, f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK)


def sentences(text: Column) -> Column:
    """Pieces between sentence ends and before list marks, without empty ones."""
    return F.filter(F.split(text, r"(?U)(?<=[.!?:])\s+|(?=[•▪✅❌⛔⚠])"), lambda s: s != "")


def diff_units(text: Column, longest: int = 200) -> Column:
    """Lines; those above ``longest`` characters by sentences."""
    return F.flatten(F.transform(lines(text), lambda x: F.when(F.length(x) > longest, F.split(x, r"(?U)(?<=[.!?:;])\s+")).otherwise(F.array(x))))


def number_forms(value: Column) -> Column:
    """The spellings of one quantity."""
    bare = F.regexp_replace(F.regexp_replace(value, r"(?U)\s", ""), "[.,]+$", "")
    return F.array_distinct(F.array(bare, F.replace(bare, F.lit(","), F.lit("")), F.replace(bare, F.lit(","), F.lit(".")), F.replace(bare, F.lit("."), F.lit(",")), F.replace(bare, F.lit("."), F.lit(""))))


def spelled_number(word: Column, languages: list[str]) -> Column:
    """Value of a spelled-out number, else null."""
    table = F.create_map(*[F.lit(x) for w, v in number_words(languages).items() for x in (w, v)])
    return F.element_at(table, F.lower(word))


def dashed(text: Column) -> Column:
    """Lower-case, every other run than a-z and 0-9 as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def identifiers(text: Column) -> Column:
    """Document numbers: digit groups joined by hyphens; a numeric revision also names its parent."""
    found = F.regexp_extract_all(dashed(text), F.lit(r"(\d{2,5}(?:-\d{1,4}){1,3}[a-z]?)(?![a-z0-9])"), F.lit(1))
    real = F.filter(found, lambda t: ~F.replace(t, F.lit("-"), F.lit("")).rlike(r"^(19|20)\d{2}$"))
    parents = F.transform(F.filter(real, lambda t: t.rlike(r"-.*-\d+$")), lambda t: F.regexp_replace(t, r"-\d+$", ""))
    return F.array_distinct(F.concat(real, parents))


def url_decode(url: Column) -> Column:
    """Percent escapes resolved; a plus sign stays, a malformed escape leaves the url as it is."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host with port, path) by pattern, so texts that are no valid urls have parts too."""
    bare = F.regexp_replace(url_decode(F.coalesce(url, F.lit(""))), r"[?#].*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*:(?=//)", "")
    host = F.regexp_extract(rest, r"^//([^/]*)", 1)
    return host, F.when(rest.startswith("//"), F.regexp_replace(rest, r"^//[^/]*", "")).otherwise(rest)


def normal_url(url: Column) -> Column:
    host, path = url_parts(url)
    return F.concat(F.lower(host), F.lower(F.regexp_replace(path, "/+$", "")))


def url_tail(url: Column) -> Column:
    """Last part of the path."""
    return F.regexp_extract(url_parts(url)[1], r"([^/]*)$", 1)


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^.])\.[^./]*$", "")


def page_id(url: Column, hosts: list[str] | None = None) -> Column:
    """Page id in a url: on the given hosts, on any host if none are given; rooted urls need no host."""
    tail = r"(?:/pages/(\d+)/|[?&]pageId=(\d+))"
    pattern = "(?:" + "|".join(h.replace(".", r"\.") for h in hosts) + r")/.*?" + tail if hosts else tail
    pick = lambda p: F.coalesce(F.nullif(F.regexp_extract(url, p, 1), F.lit("")), F.nullif(F.regexp_extract(url, p, 2), F.lit("")))
    return F.when(url.startswith("/"), pick(tail)).otherwise(pick(pattern))


def declared_id(text: Column) -> Column:
    """The id a text declares, empty if none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r'(?:source_id|confluence_page_id|source_page_id):\s*"?([\p{L}\p{N}_-]*)"?', 1)


def derived_id(*parts: Column) -> Column:
    return F.concat(F.lit("d"), F.substring(F.sha1(F.concat_ws("\x00", *parts)), 1, 11))


# Words that number the parts of a law or contract, by heading level.
PARTS = {
    2: ["teil", "kapitel", "abschnitt", "part", "chapter", "título", "capítulo", "titre", "chapitre", "titolo", "capo", "hoofdstuk", "afdeling", "dział", "rozdział", "розділ", "глава"],
    3: ["artikel", "§", "article", "section", "artículo", "articolo", "artykuł", "art.", "artigo", "підрозділ", "стаття"],
}


def structural_level(text: Column) -> Column:
    """Heading level of a paragraph that is a numbered part (article, chapter, section), else null."""
    words = sorted(PARTS[2] + PARTS[3], key=len, reverse=True)
    pattern = r"^(?iu:(" + "|".join(w.replace(".", r"\.") for w in words) + r"))(?U)\s*(\d+(?:[-–.]\d+)*|[IVXLCDM]+)\b\.?\s*(.*)$"
    whole = F.trim(text)
    bare = F.trim(F.replace(F.replace(whole, F.lit("**"), F.lit("")), F.lit("__"), F.lit("")))
    rest = F.trim(F.regexp_extract(bare, pattern, 3))
    bad = (whole == "") | (F.length(whole) > 160) | whole.rlike(r"^(?:[#|>`]|[-*+] )") | (rest.rlike(r"[.;:,]$") & (F.length(rest) > 40))
    word = F.lower(F.regexp_extract(bare, pattern, 1))
    return F.when(~bad & (word != ""), F.when(word.isin(PARTS[2]), 2).otherwise(3))
