"""URL parts as columns, and the same in SQL: host, path, and a key whose order keeps a domain's captures together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
#: Tables without a fetch time of their own get one from the id: a second of the year 2024.
YEAR_START, YEAR_SECONDS, STEP = 1704067200, 31536000, 7919


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), HOST, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), PATH, 1)


def url_key(url: Column) -> Column:
    """Host labels from the top down, then path and query, in lower case; the fragment is left out. Null for null."""
    query = F.regexp_extract(F.lower(url), QUERY, 1)
    labels = F.array_join(F.reverse(F.split(host(url), r"\.")), ",")
    return F.concat(labels, F.lit(")"), path(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def fetch_seconds(page_id: Column) -> Column:
    """Seconds since 1970 at which a page counts as fetched."""
    return F.lit(YEAR_START) + F.pmod(F.coalesce(page_id, F.lit(0)) * STEP, F.lit(YEAR_SECONDS))


URL_KEY_SQL = rf"""array_to_string(list_reverse(string_split(regexp_extract(lower(url), '{HOST}', 1), '.')), ',') || ')'
  || regexp_extract(lower(url), '{PATH}', 1)
  || CASE WHEN regexp_extract(lower(url), '{QUERY}', 1) <> '' THEN '?' || regexp_extract(lower(url), '{QUERY}', 1) ELSE '' END"""
FETCH_SQL = f"({YEAR_START} + (coalesce(page_id, 0) * {STEP}) % {YEAR_SECONDS})"
