"""URL rules: a sort-merge range join over reversed-host keys.

The key of a rule is its path and its reversed host (``/es/`` and
``org.example.``), so the rule covers exactly the keys that start with its own: an
interval of the sorted keys, and two intervals are nested or apart. A URL has
one key for each length of rule paths. Rules and URL keys are sorted together;
the last rule at or before a key carries the stack of rules it is nested in, and
the longest of them that covers the key is the answer.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The rules of the registered query, as (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DEFAULT_VERDICT = "allow"
BREAK = "\x00"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    names = ("host", "path", "verdict")
    rows = [F.struct(*(F.lit(v).cast("string").alias(k) for k, v in zip(names, rule, strict=True))) for rule in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one or for a null url."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(after_scheme(url), "^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """``www.example.org`` as ``org.example.www.``; empty for an empty host."""
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.when(host == "", "").otherwise(F.concat(F.array_join(labels, "."), F.lit(".")))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    default: str = DEFAULT_VERDICT,
    buckets: int | None = None,
    rules_per_block: int = 200_000,
) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): host, path, rule and verdict.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains
    when the path of the url starts with the rule's path; the rule with the
    longest host and path wins, of equally long ones the one with the longer
    host. ``verdict`` is ``default`` where no rule fits; ``rule`` is null there.

    A null url, or one without ``://``, has an empty host and path. A rule with a
    null or empty host or a null path fits nothing; of rules alike in host and
    path, block wins. Repeated rows of ``pages`` give a row each, whatever is
    null; extra columns are not read.

    URL keys are dealt by a hash of the row, so a host that owns a third of all
    urls is spread over all tasks. The rules are repeated per bucket; a task sorts
    at most ``rules_per_block`` of them with its keys, and larger rule sets are
    swept in more blocks.
    """
    spark = pages.sparkSession
    if buckets is None:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes, blocks, lengths = _rule_nodes(rules, buckets, rules_per_block)
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).select(
        "*",
        reversed_host(F.col("host")).alias("reversed"),
        F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(buckets)).alias("bucket"),
    )
    probes = rows.select(
        "*",
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    ).select("*", F.explode(_probe_keys(lengths)).alias("key"))
    swept = _sweep(nodes, probes)
    best = swept.groupBy("bucket", "page_id", "host", "path").agg(
        F.max("found").alias("found"),
        F.sum(((F.col("key") == "") & (F.col("block") == 0)).cast("int")).alias("copies"),
    )
    return best.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def _probe_keys(lengths: list[int]) -> Column:
    """The keys of a url: one that stands for the row, and one per path length."""
    keys = [
        F.when(
            (F.length("path") >= n) & (F.col("reversed") != ""),
            F.concat(F.substring("path", 1, n), F.lit(BREAK), F.col("reversed")),
        )
        for n in lengths
    ]
    return F.array_compact(F.array(F.lit(""), *keys))


def _rule_nodes(rules: DataFrame, buckets: int, per_block: int) -> tuple[DataFrame, int, list[int]]:
    """Every rule with the stack of rules it is nested in; blocks; lengths of rule paths."""
    host = F.translate("host", string.ascii_uppercase, string.ascii_lowercase)
    usable = (
        rules.where("host <> '' AND path IS NOT NULL")
        .select(host.alias("host"), "path", "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("reversed", reversed_host(F.col("host")))
        .withColumn("key", F.concat("path", F.lit(BREAK), "reversed"))
    )
    # One row comes to the driver; the lengths are at most as many as the longest path has characters.
    facts = usable.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("path")).alias("lengths")).first()
    blocks = max(1, -(-facts["n"] // per_block))
    labels = F.split("host", r"\.", -1)
    depth = F.explode(F.sequence(F.lit(1), F.size(labels)))
    above = usable.select("key", "path", "host", depth.alias("depth")).select(
        "key",
        F.concat(
            "path", F.lit(BREAK), F.array_join(F.slice(F.reverse(labels), 1, F.col("depth")), "."), F.lit(".")
        ).alias("above"),
    )
    entry = F.struct(
        (F.length("host") + F.length("path")).alias("length"),
        F.length("host").alias("host_length"),
        F.concat("host", "path").alias("rule"),
        "verdict",
        "reversed",
        "path",
    )
    stacks = (
        above.join(usable.select(F.col("key").alias("above"), entry.alias("entry")), "above")
        .groupBy("key")
        .agg(F.collect_list("entry").alias("stack"))
    )
    nodes = stacks.select(
        "key",
        "stack",
        F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"),
    )
    return nodes, blocks, sorted(facts["lengths"])


def _sweep(nodes: DataFrame, probes: DataFrame) -> DataFrame:
    """Every probe with the best rule of its block that covers it, if there is one."""
    both = probes.withColumn("is_probe", F.lit(True)).unionByName(
        nodes.withColumn("is_probe", F.lit(False)), allowMissingColumns=True
    )
    order = (
        Window.partitionBy("bucket", "block")
        .orderBy("key", "is_probe")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    active = F.filter(
        F.last("stack", ignorenulls=True).over(order),
        lambda one: F.startswith(F.col("reversed"), one["reversed"]) & F.startswith(F.col("path"), one["path"]),
    )
    return both.select(
        "bucket", "block", "page_id", "host", "path", "key", "is_probe", F.array_max(active).alias("found")
    ).where("is_probe")


ORACLE = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host) + length(rule_path)) AS rule,
         arg_max(verdict, length(rule_host) + length(rule_path)) AS verdict
  FROM split JOIN rules
    ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path)
  GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN fits USING (page_id, host, path)
"""
