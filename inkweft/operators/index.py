"""The inverted index: fragments with their stems, postings, term weights and title stems."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweft.config import Settings
from inkweft.functions import text as T
from inkweft.operators.sections import document_titles, fragments


@dataclass
class Index:
    """fragments: ``fid, name, seq, line_no, heading, body_stems, head_stems``; terms: ``token, df, idf``;
    titles: ``name, title, title_stems``; texts: ``name, seq, body`` (read only for what is shown); saved: the postings
    as they were written, by bucket of tokens."""

    fragments: DataFrame
    terms: DataFrame
    titles: DataFrame
    texts: DataFrame | None
    n: int
    saved: DataFrame | None = None

    def postings_of(self, tokens: DataFrame) -> DataFrame:
        """The postings that may hold one of ``tokens`` (column ``token``): of a saved index only the tokens' buckets are read."""
        if self.saved is None:
            return self.postings
        buckets = [r.bucket for r in tokens.select(token_bucket().alias("bucket")).distinct().collect()]  # BUCKETS numbers at most
        return self.saved.where(F.col("bucket").isin(buckets)).drop("bucket")

    @property
    def postings(self) -> DataFrame:
        """``token, fid, in_body, in_head``; fragment texts never come along."""
        both = F.array_union("body_stems", "head_stems")
        return self.fragments.select("fid", "body_stems", "head_stems", F.explode(both).alias("token")).select(
            "token", "fid", F.array_contains("body_stems", F.col("token")).alias("in_body"), F.array_contains("head_stems", F.col("token")).alias("in_head")
        )


BUCKETS = 64


def token_bucket(token: str = "token") -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def term_weights(fragments: DataFrame, n: int) -> DataFrame:
    """``token, df, idf`` with idf = ln(1 + n / df), over distinct tokens of body and heading."""
    seen = fragments.select(F.explode(F.array_union("body_stems", "head_stems")).alias("token"))
    return seen.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.log(1 + F.lit(float(n)) / F.col("df")))


def index_fragments(stemmed: DataFrame, titles: DataFrame, texts: DataFrame | None = None) -> Index:
    """Index of fragments whose stems are known."""
    none = F.array().cast("array<string>")
    own = stemmed.withColumn("body_stems", F.array_compact(F.array_distinct(F.coalesce("body_stems", none)))).withColumn("head_stems", F.array_compact(F.array_distinct(F.coalesce("head_stems", none))))
    n = own.count()
    return Index(own, term_weights(own, n), titles, texts, n)


def build_index(docs: DataFrame, settings: Settings, name: str = "name", text: str = "body") -> Index:
    """Index of markdown documents."""
    parts = fragments(docs, settings, name, text)
    cut = lambda c: T.stems(F.col(c), settings.stopwords, settings.stem_length)
    titles = document_titles(docs, name, text).withColumn("title_stems", cut("title"))
    own = parts.select(F.xxhash64("name", "seq").alias("fid"), "name", "seq", "line_no", "heading", cut("body").alias("body_stems"), cut("heading").alias("head_stems"))
    if settings.title_in_sections:
        own = own.join(titles.select("name", "title_stems"), "name", "left").withColumn("head_stems", F.array_union("head_stems", F.coalesce("title_stems", F.array().cast("array<string>")))).drop("title_stems")
    return index_fragments(own, titles, parts.select("name", "seq", "body"))


def settings_key(settings: Settings, version: int = 1) -> str:
    return hashlib.sha1(json.dumps([version, asdict(settings)], sort_keys=True, default=str).encode()).hexdigest()[:16]


def save_index(index: Index, path: str, settings: Settings) -> None:
    """Write the tables under a folder named by the settings, so indexes of other settings are never read by mistake.

    Postings are written sorted by token into hash buckets of tokens: a reader prunes to the buckets of its
    question's words.
    """
    root = f"{path}/{settings_key(settings)}"
    own = {"fragments": index.fragments, "terms": index.terms, "titles": index.titles}
    if index.texts is not None:
        own["texts"] = index.texts
    for kind, df in own.items():
        df.write.mode("overwrite").parquet(f"{root}/{kind}")
    index.postings.withColumn("bucket", token_bucket()).repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings")


def load_index(spark: SparkSession, path: str, settings: Settings) -> Index | None:
    """The saved index, or None if there is none for these settings."""
    root = f"{path}/{settings_key(settings)}"
    def read(kind: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{root}/{kind}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    own = {k: read(k) for k in ("fragments", "terms", "titles", "postings")}
    if any(df is None for df in own.values()):
        return None
    return Index(own["fragments"], own["terms"], own["titles"], read("texts"), own["fragments"].count(), own["postings"])
