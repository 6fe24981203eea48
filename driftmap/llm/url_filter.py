"""URL filter: host and path rules, then a blocked Bloom filter of listed URLs.

The filter is a table of 256-bit blocks made by a bitwise-or aggregate. A URL looks at one
block only; what the filter passes goes to an exact join with the list, so that its false
positives fall out. All expressions are built in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.llm.tables import settle

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Parts of host names that put a page's URL on the list of op1.
LISTED_WORDS = ("cheap-pills", "free-bets", "adult-x")

BITS_PER_URL = 24
WORDS_PER_BLOCK = 4
BLOCK_BYTES = 64
#: Largest filter that is sent to every executor; a larger one is joined by block number.
BROADCAST_BYTES = 8 << 20
#: Rules that are one expression; more of them are joined as a table.
EXPRESSION_RULES = 200
_SALTS = (0x47B6137B, 0x44974D91, 0x5824AD5B, 0x62B7289D)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and where no :// stands."""
    host, path = (F.coalesce(F.regexp_extract(url, _URL, i), F.lit("")) for i in (1, 2))
    return _lower(host), path


def canonical(host: Column, path: Column) -> Column:
    """Host without www. or m. and path without .html or a final slash; query and fragment go."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)$", ""))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits, as one expression.

    Of rules of one length the last by code point decides, and of equal rules allow.
    """
    name = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2], r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def match_rules(base: DataFrame, rules: DataFrame) -> DataFrame:
    """base, distinct hosts and paths, with columns rule and _verdict as match_rule gives them, by a join of every end of a host with the rules. rules: verdict, host, path. Hosts aren't empty."""
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    asked = base.select("host", "path", F.explode(ends).alias("_end"))
    rules = rules.select("verdict", F.col("host").alias("_end"), F.col("path").alias("_begin"), F.concat("host", "path").alias("rule"))
    fits = asked.join(rules, "_end").filter(F.col("path").startswith(F.col("_begin")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", (F.col("verdict") == "allow").alias("allow"), "verdict")).alias("best"))
    return base.join(best, ["host", "path"], "left").select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("_verdict"))


def _block(h: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(h, 32) % F.lit(blocks)


def _masks(h: Column) -> list[Column]:
    """Two bits of each 64-bit word of a block."""
    low, one = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(1).cast("long")
    spread = [low * F.lit(s) for s in _SALTS]
    shifted = lambda x, by: F.call_function("shiftleft", one, F.shiftrightunsigned(x, by).bitwiseAND(F.lit(63)).cast("int"))
    return [shifted(x, 20).bitwiseOR(shifted(x, 27)) for x in spread]


def bloom_table(listed: DataFrame, blocks: int) -> DataFrame:
    """One row for each block that has a bit: _block, _w0 to _w3. listed: column canonical."""
    h = listed.select(F.xxhash64("canonical").alias("_h"))
    rows = h.select(_block(F.col("_h"), blocks).alias("_block"), *(m.alias(f"_w{i}") for i, m in enumerate(_masks(F.col("_h")))))
    return rows.groupBy("_block").agg(*(F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS_PER_BLOCK)))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Judge each page's URL. Returns page_id, host, path, canonical, rule, listed, verdict.

    listed: column canonical; nulls and repeats don't matter. One row for each input row,
    repeats kept. A null URL, an empty one and one without :// have empty host and path; no
    rule fits them and the empty canonical form is never listed. Other columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"), canonical(host, path).alias("canonical"))
    # the host decides first: URLs without one, which share one key, fit no rule and are on no list
    none, base = base.filter("host = ''").withColumn("rule", F.lit(None).cast("string")).withColumn("_verdict", F.lit(None).cast("string")), base.filter("host <> ''")
    if len(rules) <= EXPRESSION_RULES:
        name, verdict = match_rule(F.col("host"), F.col("path"), rules)
        base = base.withColumn("rule", name).withColumn("_verdict", verdict)
    else:
        table = pages.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
        base = base.join(match_rules(base.select("host", "path").distinct(), table), ["host", "path"])
    keep = ["page_id", "host", "path", "canonical", "rule", "_verdict"]
    asked = base.withColumn("_h", F.xxhash64("canonical"))
    listed = settle(listed.select("canonical").filter("canonical is not null and canonical <> ''").distinct(), "listed")
    count = listed.count()
    blocks = max(1, 1 << (max(1, count * BITS_PER_URL // (64 * WORDS_PER_BLOCK)) - 1).bit_length())
    bloom = bloom_table(listed, blocks)
    if blocks * BLOCK_BYTES <= BROADCAST_BYTES:
        bloom = F.broadcast(bloom)
    probed = asked.withColumn("_block", _block(F.col("_h"), blocks)).join(bloom, "_block", "left")
    passes = F.lit(True)
    for i, m in enumerate(_masks(F.col("_h"))):
        passes = passes & (F.coalesce(F.col(f"_w{i}"), F.lit(0).cast("long")).bitwiseAND(m) == m)
    probed = probed.withColumn("_maybe", passes)
    out = probed.filter(~F.col("_maybe")).select(*keep, F.lit(False).alias("listed"))
    hits = probed.filter("_maybe").select(*keep)
    exact = hits.join(listed.withColumn("_in", F.lit(True)), "canonical", "left").select(*keep, F.coalesce("_in", F.lit(False)).alias("listed"))
    out = out.unionByName(exact).unionByName(none.select(*keep, F.lit(False).alias("listed")))
    return out.select("page_id", "host", "path", "canonical", "rule", "listed", F.coalesce("_verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def listed_by_host(pages: DataFrame, words: Sequence[str] = LISTED_WORDS) -> DataFrame:
    """Canonical URLs of pages whose host name has one of the words between its dots."""
    host, path = url_parts(F.col("url"))
    parts = pages.select(host.alias("host"), path.alias("path"))
    has = F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, words)))
    return parts.filter(has).select(canonical(F.col("host"), F.col("path")).alias("canonical"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, listed_by_host(pages))


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
c AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/)$', '') AS canonical FROM parts),
l AS (SELECT DISTINCT canonical FROM c WHERE host <> '' AND canonical <> '' AND list_has_any(string_split(host, '.'), ['cheap-pills', 'free-bets', 'adult-x'])),
r AS (SELECT c.*, l.canonical IS NOT NULL AS listed,
  CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM c LEFT JOIN l ON c.host <> '' AND c.canonical = l.canonical)
SELECT page_id, host, path, canonical, rule, listed,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
