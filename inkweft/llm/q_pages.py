"""Problems 2 and 5: page furniture, and pages without content."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweft.llm.boilerplate import main_text, page_lines
from inkweft.llm.residue import residue
from inkweft.runtime import table

_PAGE = ("original_id", "source_file", "body")


def p2_found(spark, sf_dir):
    return page_lines(table(spark, sf_dir, "originals"), *_PAGE).withColumnRenamed("_id", "original_id")


def p2_main_text(spark, sf_dir):
    return main_text(table(spark, sf_dir, "originals"), *_PAGE).withColumnRenamed("_id", "original_id")


def p5_found(spark, sf_dir):
    return residue(table(spark, sf_dir, "originals"), *_PAGE).select(F.col("_id").alias("original_id")).distinct()


def p5_reasons(spark, sf_dir):
    return residue(table(spark, sf_dir, "originals"), *_PAGE).withColumnRenamed("_id", "original_id").withColumn("density", F.round("density", 6))


QUERIES = {"p2_found": p2_found, "p2_main_text": p2_main_text, "p5_found": p5_found, "p5_reasons": p5_reasons}
SQL = {}
