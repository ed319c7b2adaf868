"""Column expressions over URLs and page ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ABSOLUTE = r"^(?i:https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def plain_id(value: Column) -> Column:
    """An id without surrounding blanks, tabs and quote marks."""
    edge = "[\\\\s\"'`\u00a0‘’‚“”„«»]+"
    edge = edge.replace("\\\\", "\\")
    return F.regexp_replace(value, f"^{edge}|{edge}$", "")


def url_host(url: Column) -> Column:
    """Lower-case host of an http(s) url; empty if it is not one."""
    return F.lower(F.regexp_extract(url, _ABSOLUTE, 1))


def canonical_url(url: Column, own_host: Column) -> Column:
    """``host/path[?pageId=N]`` of an http(s) or rooted url, null for any other text.

    Scheme, letter case of the host, fragment, a final slash and every parameter but pageId do not count.
    ``own_host`` completes urls that start with a slash.
    """
    text = F.trim(url)
    full = F.when(text.startswith("/"), F.concat(F.lit("https://"), own_host, text)).otherwise(text)
    path = F.regexp_replace(F.regexp_extract(full, _ABSOLUTE, 2), "/+$", "")
    page = F.regexp_replace(F.regexp_extract(F.regexp_extract(full, _ABSOLUTE, 3), r"(?:^|&)pageId=([^&]*)", 1), "/+$", "")
    host = url_host(full)
    return F.when(host != "", F.concat(host, path, F.when(page != "", F.concat(F.lit("?pageId="), page)).otherwise("")))
