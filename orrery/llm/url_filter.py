"""URL rules by a blocked Bloom filter over canonical keys and an exact join of what passes it.

A rule (host, path, verdict) covers its host, all subdomains, and every path that begins with its own. Its canonical
key is host + path; hosts hold no slash, so keys are unambiguous. A URL can match only keys cut from itself: for each
*shape* (labels of the host, characters of the path) that the list has, its last labels and its path's beginning. Keys
that a blocked Bloom filter rules out go no further; the rest meet the list in a join, which removes the false hits.

Functions of DataFrames only: no Python runs on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

# The production rules.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: What holds for a URL that no rule covers: the filter's list does not name it.
UNLISTED = "allow"
#: A block is a cache line: eight words, in each of which a key sets one bit.
WORDS, WORD_BITS = 8, 64
BITS_A_KEY = 16
#: Blocks at most, 8 MB; a longer list makes more false hits, which the exact join removes.
MOST_BLOCKS = 1 << 17
#: Lists up to so many rules are broadcast to the join; longer ones are joined by key, with the URLs' side salted.
BROADCAST_RULES = 100_000
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, lower-cased from A to Z, and the path after it; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column, word: int) -> Column:
    """The key's bit in one word of its block, chosen by six bits of a second hash."""
    bit = F.shiftrightunsigned(F.xxhash64(F.lit(word // 10), key), 6 * (word % 10)).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bloom_filter(keys: DataFrame, count: int) -> tuple[DataFrame, int]:
    """(block, w0..w7), a row for each block that has bits, and the number of blocks."""
    blocks = max(1, min(MOST_BLOCKS, -(-count * BITS_A_KEY // (WORDS * WORD_BITS))))
    masks = [F.bit_or(_mask(F.col("key"), w)).alias(f"w{w}") for w in range(WORDS)]
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*masks), blocks


def might_hold(key: Column) -> Column:
    """Whether the key's bit is set in each word of its block."""
    found = F.lit(True)
    for w in range(WORDS):
        found &= F.col(f"w{w}").bitwiseAND(_mask(key, w)) != 0
    return found


def filter_urls(pages: DataFrame, rules: DataFrame, unlisted: str = UNLISTED, id_col: str = "page_id", url_col: str = "url", most_broadcast: int = BROADCAST_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page by the longest rule that covers it.

    ``rules`` has host, path and verdict (``allow`` or ``block``). A rule covers its host and all subdomains where the
    URL's path begins with the rule's, so a URL without a path is covered by no rule with one. The rule with the
    longest host and path wins; of equal rules with two verdicts ``block`` wins. Pages that no rule covers get
    ``unlisted`` and a null rule. Null URLs and those without ``://`` have empty hosts and paths; repeated rows are
    judged each; null ids are kept; other columns are ignored, whatever their names; empty tables and empty lists do
    no harm.
    """
    spark = pages.sparkSession
    listed = rules.select(F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    listed = listed.groupBy(F.concat("host", "path").alias("key"), "host", "path").agg(F.max("verdict").alias("_verdict"))
    facts = listed.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.struct(_labels(F.col("host")).alias("labels"), F.length("path").alias("size"))).alias("shapes")).head()
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("_row"))
    if not facts["n"]:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(unlisted).alias("verdict"))
    # numbered rows are written, so that both readers and every repeated task see the same numbers
    scratch = Scratch(spark, "url-filter")
    rows = scratch.table(rows)
    bloom, blocks = bloom_filter(listed, facts["n"])
    shape = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("size")) for a, b in sorted((s["labels"], s["size"]) for s in facts["shapes"])])
    fits = F.filter(shape, lambda s: (_labels(F.col("host")) >= s["labels"]) & (F.length("path") >= s["size"]))
    keys = F.transform(fits, lambda s: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.substring("path", F.lit(1), s["size"])))
    asked = rows.select("_row", F.explode(keys).alias("key")).withColumn("block", _block(F.col("key"), blocks))
    # at most MOST_BLOCKS rows of nine numbers, whatever the list's length
    asked = asked.join(F.broadcast(bloom), "block").where(might_hold(F.col("key"))).select("_row", "key")
    named = listed.select("key", F.length("key").alias("_size"), "_verdict")
    if facts["n"] <= most_broadcast:
        hits = asked.join(F.broadcast(named), "key")
    else:
        salts = F.array(*[F.lit(s) for s in range(SALTS)])
        hits = asked.withColumn("_salt", F.pmod("_row", F.lit(SALTS)).cast("int")).join(named.withColumn("_salt", F.explode(salts)), ["key", "_salt"])
    best = hits.groupBy("_row").agg(F.max_by(F.struct("key", "_verdict"), "_size").alias("_best"))
    judged = rows.join(best, "_row", "left")
    return judged.select("page_id", "host", "path", F.col("_best.key").alias("rule"), F.coalesce(F.col("_best._verdict"), F.lit(unlisted)).alias("verdict"))


def production_rules(spark: SparkSession) -> DataFrame:
    rules = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES]
    return spark.range(1).select(F.inline(F.array(*rules)))


def oracle() -> str:
    """DuckDB text of the query over ``pages``."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""WITH ru(rh, rp, rv) AS (VALUES {rules}),
a AS (SELECT page_id, row_number() OVER () AS i, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS t FROM pages),
b AS (SELECT page_id, i, translate(regexp_extract(t, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT i, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict FROM b JOIN ru ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(verdict, '{UNLISTED}') AS verdict FROM b LEFT JOIN c USING (i)"""
