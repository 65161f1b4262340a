"""URL filter: a blocked Bloom filter in front of an exact hash join.

The listed canonical URLs are rules ``host + path`` that hold for the host, all
its subdomains and every path that starts with theirs.  A URL is probed under
each key that could be listed: every suffix of its host at a dot, followed by
its path cut to each length that some listed path has.  Keys that fail the
Bloom filter are gone before anything is joined with the list itself; the exact
join then removes the filter's false positives and the longest rule decides.

The filter has blocks of 256 bits in four words; a key sets two bits in each
word of one block, so a probe reads one row.  Filter and list are broadcast only
while their counted size is below ``broadcast_bytes``, and are joined by
shuffled hash keys beyond it.  Different (host, path) pairs are judged once
each, so a frequent URL costs one probe.

Everything is DataFrame expressions.  Defined results: a null URL or one without
``://`` has an empty host and path, fits no rule and gets the default verdict;
of equal rules with both verdicts ``block`` holds; columns other than the id and
the URL are not read, so their names cannot clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.runtime import tuned

BITS_PER_KEY = 16
BLOCK_BITS = 256
BROADCAST_BYTES = 16 << 20
#: Bytes that one block's row takes at most when broadcast.
BLOCK_ROW_BYTES = 64

RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("long")


def _mask(key: Column, word: int) -> Column:
    """The two bits that a key sets in a word of its block."""
    second = F.xxhash64(key, F.lit(word))
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftright(second, shift).bitwiseAND(63).cast("int")) for shift in (0, 6)]
    return bits[0].bitwiseOR(bits[1])


WORDS = range(BLOCK_BITS // 64)


def blocked_bloom(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, w0..w3): one row for each block with a key."""
    masks = [_mask(F.col(key), w).alias(f"w{w}") for w in WORDS]
    return keys.select(_block(F.col(key), n_blocks).alias("block"), *masks).groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in WORDS])


def _sized(df: DataFrame, size: int, limit: int) -> DataFrame:
    return F.broadcast(df) if size <= limit else df


def _keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key under which a URL can be listed."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    cuts = F.array(*[F.lit(n) for n in lengths])
    fitting = F.filter(cuts, lambda n: n <= F.char_length(path))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.substring(path, F.lit(1), n))))))


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per page: id, host, path, rule (null without one), verdict. ``rules``: host, path, verdict."""
    tuned(pages.sparkSession)
    listed = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & (F.col("host") != "")).groupBy(F.concat("host", "path").alias("rule"), F.char_length("path").alias("cut")).agg(F.max("verdict").alias("verdict"))
    size = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("rule") + 32), F.lit(0)).alias("bytes"), F.collect_set("cut").alias("cuts")).first()
    judged = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not size["n"]:
        return judged.select(F.col("_id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    n_blocks = -(-size["n"] * BITS_PER_KEY // BLOCK_BITS)
    bloom = blocked_bloom(listed, "rule", n_blocks)
    probes = judged.where("host != ''").select("host", "path").distinct().select("host", "path", F.explode(_keys(F.col("host"), F.col("path"), sorted(size["cuts"]))).alias("key"))
    probes = probes.withColumn("block", _block(F.col("key"), n_blocks)).join(_sized(bloom, n_blocks * BLOCK_ROW_BYTES, broadcast_bytes), "block")
    possible = probes
    for w in WORDS:
        mask = _mask(F.col("key"), w)
        possible = possible.where(F.col(f"w{w}").bitwiseAND(mask) == mask)
    exact = possible.select("host", "path", "key").join(_sized(listed, size["bytes"], broadcast_bytes), F.col("key") == F.col("rule"))
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.char_length("rule").alias("n"), "rule", "verdict")).alias("best"))
    return judged.join(best, ["host", "path"], "left").select(
        F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages under the five rules."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE = r"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
best AS (SELECT p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
         FROM (SELECT DISTINCT host, path FROM p) p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""
