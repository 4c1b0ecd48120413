"""URL filter: a blocked Bloom filter of listed keys, then an exact hash join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lupaspark.llm.common import looked_up, written

BLOCK_BITS = 512
HASHES = 8
BITS_A_KEY = 16
#: The filter never takes more memory than this; a longer list only raises the share of false positives.
MAX_FILTER_BYTES = 8 << 20
#: Shapes of rules (labels in the host, characters in the path) up to which keys of all shapes are made for each URL.
MAX_SHAPES = 256

#: Rules up to which they are broadcast to the exact join; common ones, such as a top-level domain, then never bring their URLs to one task.
MAX_RULES = 100_000

#: The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: A host with one of these words in a label is unwanted; its URLs make the list of the registered query.
UNWANTED = ["spam-farm", "free-bets", "cheap-pills", "casino-win", "adult-x", "ads-track"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host lower-cased A-Z; both empty where the URL is null or has no '://'."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """host/path without a leading www., m. or blog., a final .html and final slashes; scheme, query and fragment don't count."""
    return F.concat(F.regexp_replace(host, r"^(www|m|blog)\.", ""), F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), "/+$", ""))


def bloom(keys: DataFrame) -> np.ndarray:
    """Filter of keys(key): blocks of 8 longs. The longs are made on the executors; at most MAX_FILTER_BYTES reach the driver."""
    wanted = max(1, keys.count()) * BITS_A_KEY
    blocks = 1 << max(0, int(np.ceil(np.log2(wanted / BLOCK_BITS))))
    blocks = min(blocks, MAX_FILTER_BYTES * 8 // BLOCK_BITS)
    h = F.col("h")
    block = F.pmod(F.shiftrightunsigned(h, 40), F.lit(blocks))
    spots = F.array(*[_spot(h, i) for i in range(HASHES)])
    longs = (
        keys.select(F.xxhash64("key").alias("h"))
        .select((block * F.lit(BLOCK_BITS // 64)).alias("at"), F.explode(spots).alias("spot"))
        .groupBy((F.col("at") + F.shiftright("spot", 6)).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, spot & 63)")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(blocks * (BLOCK_BITS // 64), dtype=np.uint64)
    out[longs["word"].to_numpy(dtype=np.int64)] = longs["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _spot(h: Column, i: int) -> Column:
    """Bit of the block that hash i sets: nine bits of the key's hash, mixed once for i >= 4."""
    return F.shiftrightunsigned(h if i < 4 else F.xxhash64(h), 9 * (i % 4)).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")


def may_be_listed(words: np.ndarray, spark: SparkSession):
    """UDF of (hashes, mixed hashes): is any of the row's keys in the filter?"""
    sent = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def check(hashes: pd.Series, mixed: pd.Series) -> pd.Series:
        bits, blocks = sent.value, len(sent.value) // (BLOCK_BITS // 64)
        sizes = hashes.map(len).to_numpy(dtype=np.int64)
        if not sizes.sum():
            return pd.Series(np.zeros(len(sizes), dtype=bool))
        h, m = (np.concatenate(list(x)).astype(np.int64).view(np.uint64) for x in (hashes, mixed))
        at = (h >> np.uint64(40)) % np.uint64(blocks) * np.uint64(BLOCK_BITS // 64)
        hit = np.ones(len(h), dtype=bool)
        for i in range(HASHES):
            spot = ((h if i < 4 else m) >> np.uint64(9 * (i % 4))) & np.uint64(BLOCK_BITS - 1)
            word = bits[(at + (spot >> np.uint64(6))).astype(np.int64)]
            hit &= (word >> (spot & np.uint64(63))) & np.uint64(1) == 1
        rows = np.repeat(np.arange(len(sizes)), sizes)
        return pd.Series(np.bincount(rows, weights=hit, minlength=len(sizes)) > 0)

    return check


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for every row of pages.

    rules(host, path, verdict): a rule fits its host and all subdomains where the URL's path starts with the rule's; the
    longest host and path wins, the longer host among equals. listed(url_key): canonical URLs to block where no rule fits. A URL that neither
    names is allowed. Null, empty and malformed URLs have an empty host and path, which no rule fits and no list may
    name. Repeated rows are judged each; rows with a null page_id stay.

    Keys of every URL (its canonical form, and its host suffixes with path prefixes in the shapes that rules have) meet the
    Bloom filter in place; only possible hits are shuffled, once for each distinct host and path, to the exact join.
    """
    spark = pages.sparkSession
    rules = rules.select(F.lower("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict").where("rule_host <> ''").dropDuplicates(["rule_host", "rule_path"])
    shapes = rules.select(F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("chars")).distinct().limit(MAX_SHAPES + 1).collect()
    if len(shapes) > MAX_SHAPES:  # paths of too many lengths: keys are hosts alone, and the join compares paths
        shapes = [(r[0], None) for r in rules.select(F.size(F.split("rule_host", r"\."))).distinct().collect()]
    by_host = any(s[1] is None for s in shapes)
    rule_key = F.concat(F.lit("r:"), "rule_host", F.lit("") if by_host else F.col("rule_path"))
    entries = rules.select(rule_key.alias("key"), F.concat("rule_host", "rule_path").alias("rule"), "rule_path", "verdict", F.length("rule_host").alias("host_chars")).unionByName(
        listed.where("url_key <> ''").select(F.concat(F.lit("u:"), "url_key").alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("").alias("rule_path"), F.lit("block").alias("verdict"), F.lit(0).alias("host_chars")).dropDuplicates(["key"])
    )
    check = may_be_listed(bloom(entries.select("key")), spark)

    host, path = url_parts(F.col("url"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    labels, size = F.split("host", r"\."), F.size(F.split("host", r"\."))
    keys = [F.when(F.col("host") != "", F.concat(F.lit("u:"), canonical(F.col("host"), F.col("path"))))]
    for n, chars in shapes:
        fits = (size >= n) & (F.col("host") != "")
        if chars is not None:
            fits = fits & (F.length("path") >= chars)
        suffix = F.array_join(F.slice(labels, F.greatest(size - n + 1, F.lit(1)), n), ".")
        keys.append(F.when(fits, F.concat(F.lit("r:"), suffix, F.lit("") if chars is None else F.substring("path", 1, chars))))
    urls = urls.withColumn("keys", F.array_compact(F.array(*keys)))
    hashes, mixed = F.transform("keys", lambda k: F.xxhash64(k)), F.transform("keys", lambda k: F.xxhash64(F.xxhash64(k)))
    # Written once: the filter and its scan would run for each of the uses below.
    urls = written(urls.select("page_id", "host", "path", F.when(check(hashes, mixed), F.col("keys")).alias("keys")), "urls")

    possible = urls.where("keys is not null")
    each = possible.groupBy("host", "path").agg(F.count("*").alias("n"), F.first("keys").alias("keys"))
    asked = each.select("host", "path", F.explode("keys").alias("key"))
    by_rule = entries.where("key like 'r:%'")
    if rules.count() <= MAX_RULES:
        by_rule = F.broadcast(by_rule)
    met = asked.where("key like 'r:%'").join(by_rule, "key").unionByName(asked.where("key like 'u:%'").join(entries.where("key like 'u:%'"), "key"))
    found = (
        met.where(F.startswith("path", "rule_path")).groupBy("host", "path")
        .agg(F.max(F.struct(F.col("rule").isNotNull().alias("by_rule"), F.coalesce(F.length("rule"), F.lit(0)).alias("chars"), "host_chars", "rule", "verdict")).alias("best"))
    )
    told = each.join(found, ["host", "path"], "left").select("host", "path", "n", "best.rule", F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), F.coalesce(~F.col("best.by_rule"), F.lit(False)).alias("listed"))
    # A popular URL has many rows: looked up, they never meet in one task.
    judged = looked_up(possible.select("page_id", "host", "path"), written(told, "urls-told"), ["host", "path"], "page_id")
    clear = urls.where("keys is null").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(False).alias("listed"))
    return judged.unionByName(clear)


def listed_urls(pages: DataFrame, words: list[str], url_col: str = "url") -> DataFrame:
    """(url_key): canonical URLs of the pages whose host has one of the words as a label."""
    host, path = url_parts(F.col("url"))
    urls = pages.select(F.col(url_col).alias("url")).select(host.alias("host"), path.alias("path"))
    unwanted = F.exists(F.split("host", r"\."), lambda x: x.isin(words))
    return urls.where(unwanted).select(canonical(F.col("host"), F.col("path")).alias("url_key")).distinct()
