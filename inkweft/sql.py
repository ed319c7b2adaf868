"""The scalar operators as SQL functions, and tables as views."""

from __future__ import annotations

from pyspark.sql import SparkSession

from inkweft.config import Settings


def register(spark: SparkSession, settings: Settings) -> None:
    """Temporary SQL functions over the settings of a base: stems, flat_text, clean_markup, slug_of, number_forms."""
    stop = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in settings.stopwords)
    edges = "«»\"\\'.,:;!?()[]–—-"
    spark.sql(f"""create or replace temporary function stems(t string) returns array<string> return
        array_distinct(transform(filter(regexp_extract_all(t, r"([\\p{{L}}\\p{{N}}_'’]+)", 1), w -> length(w) > 1 and not array_contains(array({stop or "''"}), lower(w))),
        w -> substring(trim(both '{edges}' from lower(w)), 1, {settings.stem_length})))""")
    spark.sql(r"""create or replace temporary function flat_text(t string) returns string return
        regexp_replace(lower(regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", r"$1")), r"[^\p{L}\p{N}]+", '')""")
    spark.sql(r"""create or replace temporary function clean_markup(t string) returns string return
        regexp_replace(regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", r"$1"), r"\*{1,3}|`", '')""")
    spark.sql(r"""create or replace temporary function slug_of(t string) returns string return
        regexp_replace(substring(regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-'), '^-+|-+$', ''), 1, 48), '-+$', '')""")
    spark.sql(r"""create or replace temporary function number_forms(v string) returns array<string> return
        array_distinct(transform(array(regexp_replace(regexp_replace(v, r"\s", ''), r"[.,]+$", '')), b -> b) ||
        transform(array(regexp_replace(regexp_replace(v, r"\s", ''), r"[.,]+$", '')), b -> replace(b, ',', '')) || transform(array(regexp_replace(regexp_replace(v, r"\s", ''), r"[.,]+$", '')), b -> replace(b, ',', '.')) ||
        transform(array(regexp_replace(regexp_replace(v, r"\s", ''), r"[.,]+$", '')), b -> replace(b, '.', ',')) || transform(array(regexp_replace(regexp_replace(v, r"\s", ''), r"[.,]+$", '')), b -> replace(b, '.', '')))""")


def register_tables(spark: SparkSession, tables: dict) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
