"""URL rules looked up in a cascade of Bloom filters that is exact over the corpus's own keys."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import join_counted, keep, letters_a_to_z_lower

#: The rules that the query is asked to apply.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
_URL = r"(?s)://([^/?#]*)([^?#]*)"
#: Filters of more bytes, and more rules, are not sent to the executors with the plan: then rules are joined, with the same result.
MOST_FILTER_BYTES, MOST_RULES = 4 << 20, 10_000


def host_of(url: Column) -> Column:
    return letters_a_to_z_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All keys that a rule for this url could have: the last n labels of the host, then the path's first k characters."""
    parts = F.split(host, r"\.", -1)
    keys = []
    for n in labels:
        suffix = F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), "."))
        for k in lengths:
            keys.append(F.when(F.char_length(path) >= k, F.concat(suffix, F.substring(path, 1, k))))
    return F.array_compact(F.array(*keys))


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    data: bytes


@dataclass(frozen=True)
class Cascade:
    """Levels 1, 3, ... hold listed keys, levels 2, 4, ... the keys of the universe that the level before took for listed."""

    levels: tuple[Level, ...]

    def listed(self, key: Column) -> Column:
        """Whether the key is listed; exact for every key of the universe that the cascade was built over."""
        answer: Column = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(_might_hold(self.levels[i], key, i), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def _places(level: int, bits: int, hashes: int, key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(k), key), F.lit(bits)) for k in range(hashes)]


def _might_hold(level: Level, key: Column, number: int) -> Column:
    data, found = F.lit(level.data), F.lit(True)
    for place in _places(number, level.bits, level.hashes, key):
        byte = F.conv(F.hex(F.substring(data, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        found = found & (F.call_function("shiftrightunsigned", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return found


def _shape(n: int, rate: float) -> tuple[int, int]:
    """Bits and hashes of a filter over n keys."""
    return max(64, 64 * math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64)), max(1, round(-math.log2(rate)))


def first_rate(n: int, total: int) -> float:
    """The rate of the first filter: what it takes wrongly for listed should be about as long as the list."""
    return min(0.5, max(1e-6, n * math.sqrt(0.5) / max(1, total)))


def _level(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    """A Bloom filter over n keys. Words are combined on the executors; the driver gets the filter itself."""
    bits, hashes = _shape(n, rate)
    one = F.expr("shiftleft(1, cast(place % 8 as int))")
    rows = (
        keys.select(F.explode(F.array(*_places(number, bits, hashes, F.col("key")))).alias("place"))
        .groupBy(F.shiftright("place", 3).alias("byte"))
        .agg(F.bit_or(one).alias("bits"))
        .collect()
    )
    data = bytearray(bits // 8)
    for r in rows:
        data[r["byte"]] = r["bits"]
    return Level(bits, hashes, bytes(data))


def build_cascade(listed: DataFrame, universe: DataFrame, most_levels: int = 60, most_bytes: int = MOST_FILTER_BYTES) -> Cascade | None:
    """Build levels until no key of the universe (column key) is mistaken. `listed` has a column key.

    The universe is read once: only what the first filter takes wrongly for listed goes on, and its rate is
    set so that this is about as long as the list. From then on levels hold half of the level two before.
    An empty list gives a cascade that lists nothing; None where a filter would be longer than `most_bytes`.
    """
    yes = keep(listed.select("key").where("key is not null").distinct())
    n = yes.count()
    if n == 0:
        return Cascade(())
    total = universe.count()
    if _shape(n, first_rate(n, total))[0] // 8 > most_bytes:
        return None
    levels = [_level(yes, n, first_rate(n, total), 0)]
    wrong = universe.select("key").where(_might_hold(levels[0], F.col("key"), 0)).distinct().join(yes, "key", "left_anti")
    holds, other = yes, keep(wrong)  # what the last level holds; what it takes wrongly for held
    while (left := other.count()) > 0:
        if len(levels) == most_levels:
            raise RuntimeError("the cascade does not end; change the hash seeds")
        number = len(levels)
        if _shape(left, 0.5)[0] // 8 > most_bytes:
            return None
        levels.append(_level(other, left, 0.5, number))
        holds, other = other, keep(holds.where(_might_hold(levels[-1], F.col("key"), number)))
    return Cascade(tuple(levels))


def _by_join(keyed: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """What judge() returns, from a join of all candidate keys with the rules; common keys are joined by broadcast."""
    spark = keyed.sparkSession
    rows = keep(keyed.withColumn("_row", F.monotonically_increasing_id()))
    listed = spark.createDataFrame([(r, v, k) for k, (r, v) in enumerate(rules)], "key string, verdict string, place long").groupBy("key").agg(F.min_by("verdict", "place").alias("verdict"))
    keys = rows.select("_row", F.explode("_keys").alias("key"))
    counted = keep(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(listed, "key"))
    hits = join_counted(keys, counted, "key", rows.count())
    best = hits.groupBy("_row").agg(F.max(F.struct(F.char_length("key").alias("n"), "key", "verdict")).alias("m"))
    return rows.join(best, "_row", "left").select("page_id", "host", "path", F.col("m.key").alias("rule"), F.coalesce("m.verdict", F.lit(default)).alias("verdict"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, default: str = "allow", most_bytes: int = MOST_FILTER_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (columns page_id, url).

    A rule is host and path prefix in one string. It fits its host, all subdomains and paths that start with
    its path; of several the longest wins (then the first in order). Without a rule the verdict is `default`:
    the cascade says that no listed key fits the url. Null urls and those without `://` have an empty host
    and path, and fit no rule. Repeated rows are judged each; null ids too; an empty table gives no rows; of
    rules that repeat a prefix the first counts; other columns are ignored, whatever their names. A list whose
    filters would be too long to send is joined instead.
    """
    spark = pages.sparkSession
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not rules:
        return parsed.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hosts = [r.partition("/")[0] for r, _ in rules]
    labels = sorted({h.count(".") + 1 for h in hosts})
    lengths = sorted({len(r) - len(h) for (r, _), h in zip(rules, hosts)})
    keyed = parsed.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), labels, lengths))
    listed = spark.createDataFrame([(r,) for r, _ in rules], "key string")
    cascade = None if len(rules) > MOST_RULES else build_cascade(listed, keyed.select(F.explode("_keys").alias("key")), most_bytes=most_bytes)
    if cascade is None:
        return _by_join(keyed, rules, default)
    fits = F.filter("_keys", cascade.listed)
    longest = F.array_max(F.transform(fits, lambda k: F.struct(F.char_length(k).alias("n"), k.alias("key"))))["key"]
    verdicts = F.create_map(*(F.lit(x) for r in dict(reversed(rules)).items() for x in r))
    return keyed.withColumn("rule", longest).select(
        "page_id", "host", "path", "rule", F.coalesce(F.element_at(verdicts, F.col("rule")), F.lit(default)).alias("verdict")
    )
