"""URL filters: a dated block list joined as of each capture's fetch time; DataFrame functions only.

A list is a table of dated changes (key, action, since): from its date on a key blocks, allows, or is removed. Changes of
a key become validity intervals, each ending where the next begins. A key is a domain, which covers its subdomains, or
a host with leading path segments. Every capture is looked up under all keys that could cover it (its host's suffixes,
its host with each leading part of its path), by an equi-join on the key with the fetch time inside the interval. The
longest active key decides; without one a capture is allowed.

The list is broadcast only below a checked size; beyond, both sides are shuffled by key and the engine splits keys that
hold too many captures. Captures that are the same in id, URL and time are evaluated once and returned as often as they
stand. Changes of one key at one instant: the greatest action name in code-point order holds. Null URLs match nothing and
are allowed; null keys, dates or actions in the list are left out. An empty table gives no rows, an empty list blocks
nothing; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import checked_broadcast, stash
from ledgerloom.llm.urls import HOST, FETCH_SQL, PATH, fetch_seconds, host, path

BLOCK, ALLOW, REMOVE = "block", "allow", "remove"

#: The query's list: (key, action, date from which it holds).
CHANGES = [
    ("example.net", BLOCK, "2024-02-01"),
    ("example.net", REMOVE, "2024-05-15"),
    ("example.net", BLOCK, "2024-09-01"),
    ("example.org", BLOCK, "2024-06-01"),
    ("example.org", ALLOW, "2024-11-01"),
    ("example.com/fr", BLOCK, "2024-01-10"),
    ("tionsh.example.net", ALLOW, "2024-03-01"),
    ("tionsh.example.net", BLOCK, "2024-07-04"),
    ("tionsh.example.net/en", ALLOW, "2024-08-01"),
    ("tionsh.example.net/en", REMOVE, "2024-10-01"),
    ("blog.tionble.example.com", BLOCK, "2024-04-01"),
    ("blog.tionble.example.com/de", ALLOW, "2024-04-20"),
    ("tiontion.example.com", BLOCK, "2023-12-01"),
    ("tiontion.example.com", REMOVE, "2024-03-15"),
    ("tiontion.example.com", BLOCK, "2024-03-15"),
    ("m.tiontion.example.com", ALLOW, "2024-06-30"),
    ("ththth.example.org", ALLOW, "2024-07-01"),
    ("ththth.example.org/es", BLOCK, "2024-07-15"),
    ("thther.example.org", BLOCK, "2024-01-01"),
    ("thther.example.org", ALLOW, "2024-12-24"),
]


def intervals(changes: DataFrame) -> DataFrame:
    """key, action, valid_from, valid_to (null: still valid) from dated changes (key, action, since in seconds)."""
    clean = changes.select(F.lower("key").alias("key"), "action", F.col("since").cast("long").alias("since")).where("key is not null and action is not null and since is not null")
    one = clean.groupBy("key", "since").agg(F.max("action").alias("action"))
    later = F.lead("since").over(Window.partitionBy("key").orderBy("since"))
    return one.select("key", "action", F.col("since").alias("valid_from"), later.alias("valid_to")).where(F.col("action") != REMOVE)


def keys(url: Column) -> Column:
    """Every list key that covers a URL: host suffixes, and the host with each leading part of the path."""
    labels, steps = F.split(host(url), r"\."), F.filter(F.split(path(url), "/"), lambda s: s != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    numbers = F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps))).otherwise(F.array().cast("array<int>"))
    paths = F.transform(numbers, lambda i: F.concat_ws("/", host(url), F.array_join(F.slice(steps, F.lit(1), i), "/")))
    return F.when(host(url) != "", F.concat(suffixes, paths))


def evaluate(captures: DataFrame, valid: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched) -> with verdict, rule (key), rule_since, n_active."""
    same = captures.groupBy("page_id", "url", "fetched").agg(F.count("*").alias("copies"))
    looked = same.select("page_id", "url", "fetched", F.explode_outer(keys(F.col("url"))).alias("key"))
    rules = checked_broadcast(stash(valid, "intervals"))
    active = looked.join(rules, "key").where("fetched >= valid_from and (valid_to is null or fetched < valid_to)")
    best = F.max(F.struct(F.length("key").alias("n"), "key", "valid_from", "action"))
    found = active.groupBy("page_id", "url", "fetched").agg(best.alias("best"), F.count("*").alias("n_active"))
    joined = same.alias("c").join(found.alias("f"), (F.col("c.page_id").eqNullSafe(F.col("f.page_id"))) & (F.col("c.url") == F.col("f.url")) & (F.col("c.fetched") == F.col("f.fetched")), "left")
    every = joined.select("c.*", "best", "n_active", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return every.select(
        "page_id", "url", "fetched",
        F.coalesce("best.action", F.lit(ALLOW)).alias("verdict"),
        F.col("best.key").alias("rule"), F.col("best.valid_from").alias("rule_since"),
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
    )


def default_list(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(CHANGES, "key string, action string, since string")
    return rows.withColumn("since", F.unix_timestamp(F.concat("since", F.lit(" 00:00:00"))))


def filter_pages(pages: DataFrame, changes: DataFrame) -> DataFrame:
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return evaluate(own.withColumn("fetched", fetch_seconds(F.col("page_id"))), intervals(changes))


def oracle() -> str:
    values = ", ".join(f"('{k}', '{a}', epoch(TIMESTAMP '{d} 00:00:00')::BIGINT)" for k, a, d in CHANGES)
    return f"""
WITH changes(key, action, since) AS (VALUES {values}),
one AS (SELECT key, since, max(action) AS action FROM changes GROUP BY key, since),
valid AS (SELECT * FROM (SELECT key, action, since AS valid_from, lead(since) OVER (PARTITION BY key ORDER BY since) AS valid_to FROM one) WHERE action <> 'remove'),
captures AS (SELECT page_id, url, {FETCH_SQL}::BIGINT AS fetched, row_number() OVER () AS n,
  string_split(regexp_extract(lower(url), '{HOST}', 1), '.') AS labels, regexp_extract(lower(url), '{HOST}', 1) AS host,
  [x for x in string_split(regexp_extract(lower(url), '{PATH}', 1), '/') if x <> ''] AS steps FROM pages),
looked AS (
  SELECT n, page_id, fetched, array_to_string(labels[i:], '.') AS key FROM captures, unnest(range(1, len(labels) + 1)) AS u(i)
  UNION ALL SELECT n, page_id, fetched, host || '/' || array_to_string(steps[1:i], '/') FROM captures, unnest(range(1, len(steps) + 1)) AS u(i)),
active AS (SELECT n, key, valid_from, action FROM looked JOIN valid USING (key) WHERE fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to)),
best AS (SELECT n, max({{'n': length(key), 'key': key, 'valid_from': valid_from, 'action': action}}) AS b, count(*) AS n_active FROM active GROUP BY n)
SELECT page_id, url, fetched, coalesce(b.action, 'allow') AS verdict, b.key AS rule, b.valid_from AS rule_since, coalesce(n_active, 0) AS n_active
FROM captures LEFT JOIN best USING (n)"""
