"""Scans: files, markdown corpora, cards, JSON tables, self-test cases, language files."""

from __future__ import annotations

import json
import unicodedata

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweft.functions import text as T
from inkweft.sources.store import Store

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
# Names that stay in the base's folder though they look like documents.
KEEP = [
    "claude.md", "claude.local.md", "agents.md", "gemini.md", "copilot.md",
    "readme", "readme.md", "readme.txt", "readme.rst",
    "license", "license.md", "license.txt", "changelog.md", "contributing.md",
    "requirements.txt",
]


def file_name(path: Column | str = "path") -> Column:
    return F.url_decode(F.replace(F.regexp_extract(path, r"([^/]*)$", 1), F.lit("+"), F.lit("%2B")))


def scan_files(spark: SparkSession, path: str, glob: str = "*", deep: bool = True) -> DataFrame:
    """``name, path, mtime, size, content, sha1``; with only name and size selected no content is read."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(deep).lower()).load(path)
    return raw.select(file_name().alias("name"), "path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content", F.sha1("content").alias("sha1"))


def collect_dropped(dropped: DataFrame, originals: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Dropped document files to take in: not on the list of kept names, not equal in content to an original, of
    equal ones the first by name, and of one slug and extension the latest (a page exported again)."""
    kept = [*KEEP, *(unicodedata.normalize(form, k).lower() for k in keep or [] for form in ("NFC", "NFD"))]
    own = dropped.where(~F.lower("name").isin(kept)).join(originals.select("sha1"), "sha1", "left_anti")
    one = own.groupBy("sha1").agg(F.min("name").alias("name"))
    own = own.join(one, ["sha1", "name"], "left_semi")
    slug, ext = T.dashed(T.without_extension(F.col("name"))), F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    last = own.groupBy(slug.alias("_s"), ext.alias("_e")).agg(F.max_by("name", F.struct("mtime", "name")).alias("name"))
    return own.join(last.select("name"), "name", "left_semi")


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """``name, body`` of the markdown documents of a base, and of the descriptions of its pictures."""
    parts = []
    for glob, folder in (("*.md", "text"), ("descriptions.md", "assets")):
        try:
            raw = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(f"{root}/{folder}", wholetext=True).select(F.col("value").alias("body"), F.input_file_name().alias("path"))
        except AnalysisException:
            continue
        name = file_name() if folder == "text" else F.concat(F.lit("assets/"), F.regexp_extract("path", r"([^/]*)/[^/]*$", 1), F.lit("/descriptions.md"))
        parts.append(raw.select(name.alias("name"), "body").where(~F.col("name").startswith("_")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else spark.createDataFrame([], "name string, body string")


def scan_cards(spark: SparkSession, root: str) -> DataFrame:
    """``topic, card, text`` of cards in two levels of folders."""
    raw = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(f"{root}/cards", wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("path"))
    parts = F.split("path", "/")
    return raw.select(F.element_at(parts, -2).alias("topic"), F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)).alias("card"), "text")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON table, leniently: a missing path is an empty table, broken files give no rows, unknown fields are ignored."""
    try:
        return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


CASE_JSON = "document string, anchors array<struct<fact: string, document: string, why: string>>, questions array<struct<question: string, answer: array<string>, absent: boolean>>"


def scan_json_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions ``file, question, answer, absent``; facts ``file, fact, document, why``; broken ``file``) of self-test
    cases in JSON.  A fact without a document is one of the file's document; a file that can't be read is broken."""
    raw = spark.read.text(path, wholetext=True).select(file_name(F.input_file_name()).alias("file"), F.from_json("value", CASE_JSON + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("c"))
    good = raw.where("c is not null and c._bad is null")
    questions = good.select("file", F.explode("c.questions").alias("q")).select("file", "q.question", F.coalesce("q.answer", F.array().cast("array<string>")).alias("answer"), F.coalesce("q.absent", F.lit(False)).alias("absent"))
    facts = good.select("file", "c.document", F.explode("c.anchors").alias("a")).select("file", "a.fact", F.coalesce("a.document", "document").alias("document"), "a.why")
    return questions, facts, raw.where("c is null or c._bad is not null").select("file")


def scan_cases(spark: SparkSession, path: str) -> DataFrame:
    """``file, pos, line`` of self-test cases in the line format."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    return raw.select(file_name().alias("file"), F.posexplode(T.lines(F.col("value"))).alias("pos", "line"))


def language_files(spark: SparkSession, folder: str) -> dict[str, dict]:
    """Stop words and letters of further languages, one small JSON file each; a broken file is left out."""
    out, store = {}, Store(spark, folder)
    for name in (n for n in store.names() if n.endswith(".json")):
        try:
            data = json.loads(store.read(name) or "")
        except ValueError:
            continue
        if isinstance(data, dict):
            words, letters = data.get("stopwords", []), data.get("translit", data.get("transliterate", {}))
            out[name[:-5]] = {"stopwords": words.split() if isinstance(words, str) else [str(w) for w in words], "letters": {str(k): str(v) for k, v in dict(letters).items()}}
    return out
