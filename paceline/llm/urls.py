"""URL filters by a cascade of Bloom filters.

The keys of a corpus are known in full: every (host suffix, path beginning) that a rule could name and every host.
The first level encodes the listed keys; the second those keys of the corpus that are not listed but pass the
first; the third the listed keys that pass the second; and so on until none passes. A key of the corpus is listed
exactly if the first level that it doesn't pass is an even one (counting from 1), or it passes all of an odd
number. So membership of all rows is exact and needs no join, only constant arrays of bits in the plan.

Only DataFrame functions are used. A list is a DataFrame of hosts of any length; it meets the distinct hosts of the corpus
once, while the cascade is built. A level has BITS_PER_KEY bits for each key it encodes. Beyond MAX_KEYS keys, the hosts are dealt into
groups by a hash and each group has a cascade of its own; the rows of each group are judged in a pass of theirs, so
neither the plan's constants nor the filters' errors grow with the list.

Nulls: a null url, or one without "://", has an empty host and an empty path, which no rule fits and no list holds; nulls in a list are
not used. Ties: of rules that fit, the longest wins, then the one with the longer host. Repeated rows are judged each; repeated
entries of a list count once. Empty tables and empty lists give empty filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.store import materialize

BITS_PER_KEY = 12
HASHES = 4
MIN_BITS = 1 << 12
#: Most keys that the first level, or those expected at the second, of one cascade encode: 2 MB of bits.
MAX_KEYS = 1_000_000
#: More than the share of other keys that pass a level.
PASSING = 0.02
_SEP = "\n"  # between host and path; neither kind of rule has it


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    rest = F.coalesce(F.substring_index(F.substring_index(rest, "#", 1), "?", 1), F.lit(""))
    slash = F.instr(rest, "/")
    host = F.translate(F.substring_index(rest, "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.when(slash > 0, F.substr(rest, slash)).otherwise("")


def positions(key: Column, level: int, bits: int) -> list[Column]:
    """The bits of a key at a level."""
    return [F.pmod(F.xxhash64(key, F.lit(1000 * level + i)), F.lit(bits)) for i in range(HASHES)]


class Cascade:
    """Exact membership over a universe of keys."""

    def __init__(self, levels: list[tuple[int, list[int]]]):
        self.levels = levels

    @classmethod
    def build(cls, universe: DataFrame) -> Cascade:
        """universe: key, listed (boolean), one row a key."""
        levels: list[tuple[int, list[int]]] = []
        inside = True
        left = universe
        while True:
            encoded = left.filter(F.col("listed") == inside).select("key")
            n = encoded.count()
            if not n:
                break
            bits = MIN_BITS
            while bits < n * BITS_PER_KEY:
                bits *= 2
            at = encoded.select(F.explode(F.array(*positions(F.col("key"), len(levels), bits))).alias("at"))
            words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("w")).collect()
            table = [0] * (bits // 64)
            for r in words:
                table[r["word"]] = r["w"]
            levels.append((bits, table))
            # the other kind of keys that this level lets through
            passing = left.filter((F.col("listed") == inside) | cls._passes(F.col("key"), len(levels) - 1, bits, table))
            left = materialize(passing, "cascade")
            inside = not inside
        return cls(levels)

    @staticmethod
    def _passes(key: Column, level: int, bits: int, table: list[int]) -> Column:
        words = F.from_json(F.lit(str(table)), "array<bigint>")  # a constant
        tests = [F.call_function("shiftrightunsigned", F.get(words, (at / 64).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1 for at in positions(key, level, bits)]
        out = tests[0]
        for t in tests[1:]:
            out &= t
        return out

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self._passes(key, i, *self.levels[i]), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def group_count(hosts: DataFrame) -> int:
    """Groups that hosts (key, listed) are dealt into."""
    listed, n = hosts.agg(F.count_if("listed"), F.count("*")).first()
    return max(1, -(-max(listed, int(PASSING * n)) // MAX_KEYS))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages (page_id, url).

    rules: (verdict, host, path). listed: the blocklist, a DataFrame with a column host, of any size; a url that no rule
    fits is blocked if its host is listed.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    shapes = sorted({(len(p), h.count(".") + 1) for _, h, p in rules}, key=lambda s: (s[0], s[1]))

    def candidate(length: int, labels: int) -> Column:
        return F.concat(_suffix(F.col("host"), labels), F.lit(_SEP), F.substring("path", 1, length))

    keys = parsed.select("host", "path").select("host", F.explode(F.array(*(candidate(*s) for s in shapes)) if shapes else F.array().cast("array<string>")).alias("key")).select("key").distinct()
    named = {verdict: [h.lower() + _SEP + p for v, h, p in rules if v == verdict] for verdict in ("allow", "block")}
    cascades = {}
    for verdict, names in named.items():
        cascades[verdict] = Cascade.build(materialize(keys.withColumn("listed", F.col("key").isin(names) if names else F.lit(False)), "keys"))
    names = listed.select(F.col("host").cast("string").alias("key")).filter("key <> ''").distinct().withColumn("named", F.lit(True))
    hosts = materialize(parsed.select(F.col("host").alias("key")).distinct().join(names, "key", "left").select("key", F.coalesce("named", F.lit(False)).alias("listed")), "hosts")
    groups = group_count(hosts)

    found = []
    for length, labels in shapes:
        key = candidate(length, labels)
        verdict = F.when(cascades["allow"].contains(key), "allow").when(cascades["block"].contains(key), "block")
        found.append(F.when(verdict.isNotNull(), F.struct(F.length(key).alias("size"), F.length(_suffix(F.col("host"), labels)).alias("own"), F.translate(key, _SEP, "").alias("rule"), verdict.alias("verdict"))))
    best = F.array_max(F.array(*found)) if found else F.lit(None).cast("struct<size:int,own:int,rule:string,verdict:string>")
    x = parsed.withColumn("best", best)

    def of_group(group: int) -> DataFrame:
        mine = (lambda host: F.pmod(F.xxhash64(host, F.lit(-1)), F.lit(groups)) == group) if groups > 1 else (lambda host: F.lit(True))
        blocked = Cascade.build(hosts.filter(mine(F.col("key"))))
        other = F.when(blocked.contains(F.col("host")), "block").otherwise("allow")
        return x.filter(mine(F.col("host"))).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), other).alias("verdict"))

    out = of_group(0)
    for group in range(1, groups):
        out = out.unionByName(of_group(group))
    return out
