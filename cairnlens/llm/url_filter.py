"""URL filter: host and path rules, then exact list membership by a filter cascade.

Level 1 is a Bloom filter of the listed keys. Level 2 holds the unlisted keys of the
corpus that level 1 wrongly accepts, level 3 the listed keys that level 2 wrongly
accepts, and so on until a level accepts nothing wrongly. As the levels are built
over all keys of the corpus, a key's answer is exact: listed if the first level that
rejects it has an even number. Pages then need no join, only bit tests on constants.
DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlens.llm.common import written

# (host, path, verdict); a host stands for itself and its subdomains.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
BUCKET_BITS = 32768  # of one bitmap aggregate
# A cascade of more bits than this (8 MB) is not put into the plan; see ``judge``.
MAX_BITS = 1 << 26
MAX_LEVELS = 64


@dataclass(frozen=True)
class Level:
    bits: bytes
    hashes: int


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without '://' or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits.

    Of equally long ones the first given counts.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: len(r[0] + r[1]), reverse=True)[::-1]:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, rule_verdict).otherwise(verdict)
    return name, verdict


def _place(key: Column, level: int, i: int, n_bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(n_bits))


def accepted(key: Column, level: Level, number: int) -> Column:
    """Whether all bits of the key are set."""
    n_bits, result = 8 * len(level.bits), F.lit(True)
    bits = F.lit(bytearray(level.bits))
    for i in range(level.hashes):
        place = _place(key, number, i, n_bits)
        byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10)
        result = result & (F.getbit(byte.cast("bigint"), (place % 8).cast("int")) == 1)
    return result


def _bloom(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    bits = max(1, math.ceil(n * math.log2(1 / rate) / math.log(2)))
    buckets = math.ceil(bits / BUCKET_BITS)
    hashes = max(1, round(math.log2(1 / rate)))
    # Small levels keep whole bytes only; the bitmap of the last bucket is cut.
    n_bits = 8 * math.ceil(bits / 8)
    places = keys.select(
        F.explode(F.array(*[_place(F.col("key"), number, i, n_bits) for i in range(hashes)])).alias("place")
    ).withColumn("place", F.col("place") + 1)
    rows = (
        places.groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        .collect()
    )
    data = bytearray(buckets * BUCKET_BITS // 8)
    for r in rows:
        at = (r["bucket"] - 1) * BUCKET_BITS // 8
        data[at : at + len(r["bits"])] = r["bits"]
    return Level(bytes(data[: n_bits // 8]), hashes)


def cascade(keys: DataFrame, max_bits: int = MAX_BITS) -> list[Level] | None:
    """Levels for ``keys`` (key, listed: distinct keys of the whole corpus).

    None if the cascade would take more than ``max_bits``. A null key is no key.
    """
    keys = keys.where("key IS NOT NULL")
    counts = {r["listed"]: r["count"] for r in keys.groupBy("listed").count().collect()}
    inside, outside = counts.get(True, 0), counts.get(False, 0)
    if not inside:
        return []
    # First level: few enough wrong keys that the second is no larger than needed.
    rate = min(0.5, max(1e-6, inside / (max(1, outside) * math.sqrt(2))))
    if inside * (math.log2(1 / rate) / math.log(2) + 6) > max_bits:
        return None
    levels, holds, n, left = [], True, inside, keys
    while n:
        if len(levels) == MAX_LEVELS:
            raise ValueError("filter cascade does not end; keys must be distinct")
        number = len(levels) + 1
        level = _bloom(left.where(F.col("listed") == holds), n, rate if number == 1 else 0.5, number)
        levels.append(level)
        # Still open: the keys held here, and those wrongly accepted.
        left = left.where((F.col("listed") == holds) | accepted(F.col("key"), level, number))
        holds = not holds
        n = left.where(F.col("listed") == holds).count()
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Exact for keys of the corpus."""
    result = F.lit(len(levels) % 2 == 1)
    for number in range(len(levels), 0, -1):
        result = F.when(accepted(key, levels[number - 1], number), result).otherwise(number % 2 == 0)
    return F.coalesce(result, F.lit(False))


def listed_hosts(pages: DataFrame) -> DataFrame:
    """key, listed: each host of ``pages`` (host, ruled); listed are the hosts of
    whose ruled pages at least half are blocked."""
    blocked = F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0))
    allowed = F.sum(F.when(F.col("ruled") == "allow", 1).otherwise(0))
    return (
        pages.groupBy(F.col("host").alias("key")).agg(blocked.alias("b"), allowed.alias("a"))
        .select("key", ((F.col("b") > 0) & (F.col("b") >= F.col("a"))).alias("listed"))
    )


def judge(pages: DataFrame, keys: DataFrame | None = None, rules=RULES, max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per input row.

    A page that no rule fits is blocked if its host is listed in ``keys`` (key,
    listed; default ``listed_hosts``). The key of a page without host is the empty
    host, a key like others. Where the cascade would exceed ``max_bits`` the hosts
    are joined instead, with the same verdicts. Only page_id and url are read.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("ruled", ruled)
    keys = written(listed_hosts(parsed) if keys is None else keys, "url-keys")
    levels = cascade(keys, max_bits)
    if levels is None:
        names = keys.where("listed").select(F.col("key").alias("host"), F.lit(True).alias("in_list"))
        marked = parsed.join(names, "host", "left").withColumn("in_list", F.coalesce("in_list", F.lit(False)))
    else:
        marked = parsed.withColumn("in_list", member(F.col("host"), levels))
    verdict = F.coalesce("ruled", F.when(F.col("in_list"), "block").otherwise("allow"))
    return marked.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
