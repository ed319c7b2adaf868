"""Gates on converted documents, identities and names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweft.config import Settings
from inkweft.functions import text as T
from inkweft.runtime import ship

# Letters that do not decompose to a base letter, and how they are written in Latin letters.
LATIN = {"ł": "l", "đ": "d", "ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "þ": "th", "ð": "d", "ħ": "h", "ı": "i", "ŋ": "n", "ĸ": "k"}
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "h", "ґ": "g", "д": "d", "е": "e", "є": "ie", "ж": "zh", "з": "z", "и": "y",
    "і": "i", "ї": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s",
    "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ь": "", "ю": "iu", "я": "ia",
}
GREEK = {
    "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l",
    "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f",
    "χ": "ch", "ψ": "ps", "ω": "o",
}
LETTERS = LATIN | CYRILLIC | GREEK


def fingerprint(content: Column) -> Column:
    return F.sha1(content)


def first_of_equal(files: DataFrame, name: str = "name", digest: str = "sha1") -> DataFrame:
    """Of files with the same digest the first by name; the digest's other rows are left out."""
    best = files.groupBy(digest).agg(F.min(name).alias(name))
    return files.join(best, [digest, name], "left_semi").dropDuplicates([digest, name])


def run_on_share(text: Column) -> Column:
    """Share of words that are whole lines run together; 0 below 200 words."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    bad = F.filter(words, lambda w: (F.length(w) > 25) & ~w.rlike(r"[/:%@=?#\\_+~|<>\[\]{}*\p{Nd}]") & (F.length(F.regexp_replace(w, r"[^\p{L}]", "")) >= 20))
    return F.when(F.size(words) < 200, 0.0).otherwise(F.size(bad) / F.size(words))


_TAIL = r"(?s)\n-{3,}\s*\n+#+ (?:Links found on this page|Links found in this document|Посилання, знайдені на цій сторінці|Посилання, знайдені в цьому документі).*\z"


def body_length(text: Column) -> Column:
    """Characters of prose: without frontmatter, generated links and heading lines."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", ""), _TAIL, "")
    return F.length(F.regexp_replace(F.regexp_replace(bare, "(?m)^#.*$", ""), r"(?U)^\s+|\s+$", ""))


def rejected(text: Column, source_bytes: Column, settings: Settings) -> Column:
    """Whether a large original gave next to no text and no picture."""
    return (source_bytes >= settings.suspicious_source_bytes) & ~text.rlike(r"!\[[^\]]*\]\([^)]*assets/") & (body_length(text) < settings.minimum_body_chars)


def document_title(declared: Column, first_heading: Column, file_name: Column) -> Column:
    """Name of a document: its declared title (cut to the heading if a site's name follows), else its first heading
    unless that is a numbered part, else its file name."""
    head = F.trim(F.replace(first_heading, F.lit("**"), F.lit("")))
    tail = F.ltrim(F.substr(declared, F.length(head) + 1))
    site = (head != "") & F.startswith(declared, head) & tail.rlike("^[-–|]")
    own = F.when((head != "") & ~head.rlike(r"^\d+(?:\.\d+)*\.?\s") & T.structural_level(head).isNull(), head)
    return F.coalesce(F.when(F.trim(declared) != "", F.when(site, head).otherwise(F.trim(declared))), own, T.without_extension(file_name))


def transliterate_text(text: str, own: dict[str, str] | None = None) -> str:
    """Latin letters for any text the tables and accents cover; ``own`` letters come before both."""
    letters = LETTERS | {k.lower(): v for k, v in (own or {}).items()}
    out = []
    for c in text:
        for part in (c,) if c.lower() in letters else (b for b in unicodedata.normalize("NFKD", c) if not unicodedata.combining(b)):
            low = part.lower()
            out.append((letters[low].upper() if part.isupper() else letters[low]) if low in letters else part)
    return "".join(out)


def transliterate(df: DataFrame, col: Column, own: dict[str, str] | None = None) -> Column:
    """``transliterate_text`` as a vectorised function (Spark has no Unicode normalisation)."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else transliterate_text(t, own))

    return run(col)


def slug(latin: Column, original: Column, fallback: str = "document") -> Column:
    """File name of a title: at most 48 characters a-z, 0-9 and hyphens, else a digest of the title."""
    name = F.regexp_replace(F.substring(T.dashed(latin), 1, 48), "-+$", "")
    digest = F.concat(F.lit(fallback + "-"), F.substring(F.sha1(F.trim(original)), 1, 8))
    return F.when(name != "", name).when(F.trim(original) != "", digest).otherwise(fallback)


def free_names(wanted: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """``id, slug, name``: file names that do not clash: slug.md, slug-1.md, slug-2.md and so on.

    wanted: ``id, slug``, by id; taken: ``name, id`` of existing files: a document keeps its file, other files' names
    are not given away.
    """
    own = wanted.select("id", "slug").distinct()
    if taken is None:
        n = F.row_number().over(Window.partitionBy("slug").orderBy("id")) - 1
        return own.select("id", "slug", F.concat("slug", F.when(n > 0, F.concat(F.lit("-"), n)).otherwise(""), F.lit(".md")).alias("name"))
    # An existing file stands for the slug in its name, with and without a trailing number.
    bare, cut = F.regexp_replace("name", r"\.md$", ""), F.regexp_replace("name", r"(?:-\d+)?\.md$", "")
    held = taken.select("name", F.col("id").alias("_owner"), F.explode(F.array_distinct(F.array(bare, cut))).alias("slug"))
    keeps = own.join(held, "slug").where(F.col("id") == F.col("_owner")).groupBy("id", "slug").agg(F.min("name").alias("name"))
    new = own.join(keeps, ["id", "slug"], "left_anti")
    number = lambda c: F.coalesce(F.regexp_extract(c, r"-(\d+)\.md$", 1).try_cast("int"), F.lit(0))
    busy = held.join(new.select("slug").distinct(), "slug", "left_semi").groupBy("slug").agg(F.array_sort(F.collect_set(F.when(F.concat("slug", F.lit(".md")) == F.col("name"), 0).otherwise(number(F.col("name"))))).alias("_busy"))
    place = F.row_number().over(Window.partitionBy("slug").orderBy("id"))
    rows = new.withColumn("_k", place).join(busy, "slug", "left").withColumn("_busy", F.coalesce("_busy", F.array().cast("array<int>")))
    open_ = F.filter(F.sequence(F.lit(0), F.col("_k") + F.size("_busy")), lambda i: ~F.array_contains("_busy", i))
    n = F.element_at(open_, F.col("_k"))
    return keeps.unionByName(rows.select("id", "slug", F.concat("slug", F.when(n > 0, F.concat(F.lit("-"), n)).otherwise(""), F.lit(".md")).alias("name")))


def richer_format(files: DataFrame) -> DataFrame:
    """Without the PDF files whose page exists in another format (``name, page_id``)."""
    pdf = F.lower("name").endswith(".pdf")
    other = files.where(~pdf & (F.col("page_id") != "")).select("page_id").distinct()
    return files.where(~pdf).unionByName(files.where(pdf).join(other, "page_id", "left_anti").select(*files.columns))


def skip_failed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Without the files that failed before and have not changed since (``name, mtime_ns, size``)."""
    return files.join(manifest.where("failed is not null").select("name", "mtime_ns", "size"), ["name", "mtime_ns", "size"], "left_anti")


def unexpanded_macros(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\$body\b"))


def document_by_id(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``page_id, name``: the first name with each wanted id."""
    return docs.join(ids.select("page_id").distinct(), "page_id", "left_semi").groupBy("page_id").agg(F.min("name").alias("name"))


def lint_skills(skills: DataFrame, paths: DataFrame, most: int = 150) -> DataFrame:
    """``folder, problem``: faults of instruction files (``folder, text``); paths holds the existing ``path`` values."""
    block = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n", 1)
    name = F.trim(F.regexp_extract(block, r"(?m)^name:\s*(.+)$", 1))
    about = F.trim(F.regexp_extract(block, r"(?m)^description:\s*(.+)$", 1))
    n = F.size(T.lines(F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n", "")))
    faults = F.array_compact(F.array(
        F.when(block == "", "no frontmatter"), F.when((block != "") & (name != F.col("folder")), "name differs from folder"),
        F.when((block != "") & (about == ""), "no description"), F.when(n > most, "too long"),
    ))
    own = skills.select("folder", F.explode(faults).alias("problem"))
    named = skills.select("folder", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(kb/[\w./-]+/[\w.-]*\w)"), F.lit(1)))).alias("path"))
    return own.unionByName(named.join(paths.select("path"), "path", "left_anti").select("folder", F.concat(F.lit("no such path: "), "path").alias("problem")))
