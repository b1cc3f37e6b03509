"""URL filter: path rules by host, then a blocked Bloom filter before an exact join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import fresh, table
from tapeloom.storage import cut

#: (verdict, host and path prefix); a rule holds for its host and all subdomains.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A block is eight words of 32 bits; every listed URL sets one bit in each word.
WORDS = 8
BITS_PER_URL = 16
#: Blocks are broadcast up to this many (32 bytes each, some 16 million listed URLs); larger filters are joined by shuffle.
MAX_BROADCAST_BLOCKS = 1 << 20


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without www. or m., and the path without index or extension and final slashes."""
    bare = F.regexp_replace(host, r"^(?:www|m)\.", "")
    return F.concat(bare, F.regexp_replace(path, r"(?:/index)?(?:\.html?)?/*$", ""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for said, prefix in sorted(rules, key=lambda r: len(r[1])):
        at = prefix.index("/")
        fits = ((host == prefix[:at]) | host.endswith("." + prefix[:at])) & path.startswith(prefix[at:])
        rule = F.when(fits, F.lit(prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _bit(key: Column, word: int) -> Column:
    at = F.pmod(F.xxhash64(key, F.lit(word)), F.lit(32)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks).cast("long"))


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """One row for each block in use: its number and its words, two to a long, from the column ``key``."""
    high = lambda w: F.call_function("shiftleft", _bit(F.col("key"), w), F.lit(32))
    pairs = [_bit(F.col("key"), w).bitwiseOR(high(w + 1)).alias(f"pair{w // 2}") for w in range(0, WORDS, 2)]
    bits = keys.select(_block(F.col("key"), blocks).alias("block"), *pairs)
    return bits.groupBy("block").agg(*[F.bit_or(f"pair{k}").alias(f"pair{k}") for k in range(WORDS // 2)])


def listed_hits(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """``pages`` (with a column key) plus possible_hit (Bloom filter) and listed (exact).

    ``listed`` has a column key; repeats and nulls in it do no harm. The filter
    has ``BITS_PER_URL`` bits for each distinct listed URL. Only possible hits
    take part in the exact join; all other rows bypass it (as nulls of an outer
    join they would all go to one task).
    """
    listed = cut(listed.where("key IS NOT NULL").select("key").distinct())
    blocks = max(1, math.ceil(listed.count() * BITS_PER_URL / (32 * WORDS)))
    near = F.broadcast if blocks <= MAX_BROADCAST_BLOCKS else (lambda x: x)
    pages = pages.drop("listed", "possible_hit")
    names = fresh(pages, "_block", *[f"_pair{k}" for k in range(WORDS // 2)])
    probe = pages.withColumn(names[0], _block(F.col("key"), blocks))
    probe = probe.join(near(bloom_blocks(listed, blocks).toDF(*names)), names[0], "left")
    every = F.lit(True)
    for w in range(0, WORDS, 2):
        bits = _bit(F.col("key"), w).bitwiseOR(F.call_function("shiftleft", _bit(F.col("key"), w + 1), F.lit(32)))
        every = every & (F.coalesce(F.col(names[1 + w // 2]), F.lit(0)).bitwiseAND(bits) == bits)
    probe = probe.withColumn("possible_hit", every & F.col("key").isNotNull()).drop(*names)
    tested = probe.where("possible_hit").join(listed.withColumn("listed", F.lit(True)), "key", "left")
    tested = tested.withColumn("listed", F.coalesce("listed", F.lit(False)))
    return tested.unionByName(probe.where("NOT possible_hit").withColumn("listed", F.lit(False)))


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` plus host, path, rule, listed, possible_hit and verdict.

    A null URL, or one without ``://``, has an empty host and path, fits no
    rule and is on no list: it is allowed. Repeated rows are judged alike and
    all returned. ``listed`` has a column url, in any of its spellings. Input
    columns with the names of the result are replaced, and so is ``key``.
    """
    key = lambda df: df.withColumn("key", canonical(F.col("host"), F.col("path")))
    split = lambda df: df.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    names = key(split(listed)).where("host <> ''")
    found = listed_hits(key(split(pages)).withColumn("key", F.when(F.col("host") != "", F.col("key"))), names)
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return found.withColumn("rule", rule).withColumn("verdict", F.coalesce(said, own)).drop("key")


def syndicated(pages: DataFrame) -> DataFrame:
    """The list that the query uses: URLs that some page gives with a feed's tracking parameter."""
    return pages.where(F.col("url").rlike(r"[?&]utm_source=feed(?:[&#]|$)")).select("url")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge_urls(pages, syndicated(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict", "listed")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
k AS (
  SELECT *, regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(path, '(?:/index)?(?:\.html?)?/*$', '') AS key FROM p),
l AS (SELECT DISTINCT key FROM k WHERE host <> '' AND regexp_matches(url, '[?&]utm_source=feed(?:[&#]|$)')),
r(said, rule, h, f) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'),
  ('block', 'com/de/', 'com', '/de/')),
j AS (
  SELECT k.*, k.host <> '' AND k.key IN (SELECT key FROM l) AS listed,
    (SELECT max_by(struct_pack(rule := r.rule, said := r.said), length(r.rule)) FROM r
     WHERE (k.host = r.h OR ends_with(k.host, '.' || r.h)) AND starts_with(k.path, r.f)) AS best FROM k)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.said, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM j
"""
