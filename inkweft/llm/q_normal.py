"""Problem 4: one form for text of the same look."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweft.llm.normal import normalise
from inkweft.runtime import table

FIELDS = ["body", "source_file"]


def p4_found(spark, sf_dir):
    return normalise(table(spark, sf_dir, "originals"), "original_id", FIELDS, with_text=False).where("changed").select(F.col("_id").alias("original_id"), "field")


def p4_normal(spark, sf_dir):
    return normalise(table(spark, sf_dir, "originals"), "original_id", FIELDS).withColumnRenamed("_id", "original_id")


QUERIES = {"p4_found": p4_found, "p4_normal": p4_normal}
SQL = {}
