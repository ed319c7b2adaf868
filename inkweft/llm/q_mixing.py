"""Problem 9: a mix of sources at target weights."""

from __future__ import annotations

from inkweft.llm.mixing import mix_sources
from inkweft.runtime import table


def _mix(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "mix_targets"))


def p9_mix(spark, sf_dir):
    return _mix(spark, sf_dir)[0]


def p9_shares(spark, sf_dir):
    return _mix(spark, sf_dir)[1]


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
SQL = {}
