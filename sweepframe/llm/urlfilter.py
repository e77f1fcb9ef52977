"""URL filters by a Bloom filter cascade, in DataFrame functions.

A filter is built for a set of listed keys and the universe of all keys that
the corpus can ask for. Level 0 encodes the listed keys; the other keys of the
universe that it wrongly accepts are encoded in level 1; listed keys that level
1 wrongly accepts in level 2; and so on until no key is wrong. For every key of
the universe the first level that rejects it then decides exactly: an even
level says no, an odd one yes. Level 0 gets as many bits as make
its false positives about as few as the listed keys, so that all levels follow
the list, whatever the universe. A level of many bits is split into pieces by a
hash of the key. Bits reach the tasks as scalar subqueries, not through a join:
about 1.2 to 5 bytes for a listed key.

Defined results: a null url, or one without ``://``, has an empty host and
path and fits no rule; an empty list accepts nothing; an empty table gives an
empty result; repeated rows each get a verdict. Extra columns pass through
``judge``, but for one of the name of the struct column that it adds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepframe.functions.scratch import materialise

#: Share of keys that a level wrongly accepts, at most about this, and at least what level 0 may go down to.
FALSE_RATE, LEAST_RATE = 0.01, 1e-9
#: Bits of one piece of a level (32 MB): more keys make more pieces.
MAX_BITS = 1 << 28
#: Levels of bits; keys that are wrong still (none, as a rule) are held as they are.
MOST_LEVELS = 40


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _probe(key: Column, number: int, bits: int, i) -> Column:
    """The i-th bit number of a key, by double hashing; every level hashes anew."""
    n = F.lit(bits).cast("long")
    a, b = F.pmod(F.xxhash64(F.lit(2 * number), key), n), F.pmod(F.xxhash64(F.lit(2 * number + 1), key), n)
    return (a + b * i) % n


class Level:
    """One Bloom filter: 64-bit words by piece, in a table that is read as one scalar subquery for each piece."""

    def __init__(self, keys: DataFrame, n: int, number: int, rate: float):
        self.number = number
        need = max(64.0, -n * math.log(rate) / math.log(2) ** 2)
        self.pieces = max(1, math.ceil(need / MAX_BITS))
        self.bits = 64 * math.ceil(need / self.pieces / 64)
        self.hashes = max(1, min(30, round(self.bits * self.pieces / max(1, n) * math.log(2))))
        at = keys.select(self._piece(F.col("key")).alias("piece"), F.explode(F.array(*[_probe(F.col("key"), number, self.bits, i) for i in range(self.hashes)])).alias("bit"))
        words = at.groupBy("piece", F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))
        per = self.bits // 64
        every = keys.sparkSession.range(self.pieces * per).select(F.expr(f"cast(id div {per} as int)").alias("piece"), F.expr(f"cast(id % {per} as int)").alias("word")).join(words, ["piece", "word"], "left")
        ordered = F.array_sort(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))))
        self.words = materialise(every.groupBy("piece").agg(ordered["mask"].alias("words")))

    def _piece(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1 - self.number), key), F.lit(self.pieces)).cast("int") if self.pieces > 1 else F.lit(0)

    def column(self) -> Column:
        """The words of all pieces."""
        return F.array(*[self.words.where(F.col("piece") == i).select("words").scalar() for i in range(self.pieces)])

    def has(self, key: Column, words: Column) -> Column:
        # one mention of the words for all probes: the optimiser copies the subquery to every mention
        def hit(i):
            bit = _probe(key, self.number, self.bits, i)
            return F.getbit(F.get(F.get(words, self._piece(key)), F.floor(bit / 64).cast("int")), (bit % 64).cast("int")) == 1

        return F.forall(F.sequence(F.lit(0), F.lit(self.hashes - 1)), hit)


class Listed:
    """The last level, where keys are wrong after MOST_LEVELS: the keys as they are."""

    def __init__(self, keys: DataFrame):
        self.words = materialise(keys.agg(F.collect_list("key").alias("words")))

    def column(self) -> Column:
        return self.words.scalar()

    def has(self, key: Column, words: Column) -> Column:
        return F.array_contains(words, key)


class Cascade:
    """Exact membership of a list, for all keys of a universe (a DataFrame with a column key; distinct)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, most: int | None = None):
        listed = materialise(listed.select("key").where("key is not null").distinct())
        inside, outside = listed, materialise(universe.select("key").where("key is not null").distinct().join(listed, "key", "left_anti"))
        self.levels: list[Level | Listed] = []
        n, others = inside.count(), outside.count()
        while n:
            number = len(self.levels)
            if number >= (MOST_LEVELS if most is None else most):
                self.levels.append(Listed(inside))
                break
            rate = max(LEAST_RATE, min(FALSE_RATE, 0.7 * n / max(1, others))) if number == 0 else FALSE_RATE
            level = Level(inside, n, number, rate)
            self.levels.append(level)
            inside, outside = materialise(outside.withColumn("__words", level.column()).where(level.has(F.col("key"), F.col("__words"))).select("key")), inside
            n = inside.count()

    def bits(self) -> Column:
        """What the levels hold: a struct that a row takes along."""
        return F.struct(*[level.column().alias(f"l{i}") for i, level in enumerate(self.levels)]) if self.levels else F.struct(F.lit(0).alias("none"))

    def has(self, key: Column, bits: Column) -> Column:
        found = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            found = F.when(~self.levels[i].has(key, bits[f"l{i}"]), F.lit(i % 2 == 1)).otherwise(found)
        return F.coalesce(found, F.lit(False))


def candidates(host_: Column, path_: Column, depths: list[int], lengths: list[int]) -> Column:
    """All keys a page can ask for: every suffix of its host in whole labels with so many labels, with every prefix of its path of such a length."""
    labels = F.split(host_, r"\.")
    suffixes = F.array(*[F.when((F.size(labels) >= d) & (host_ != ""), F.array_join(F.slice(labels, -d, d), ".")) for d in depths])
    prefixes = F.array(*[F.when(F.length(path_) >= n, F.substring(path_, 1, n)) for n in lengths])
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.array_compact(pairs)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], blocked_hosts: list[str], url: str = "url", into: str = "judged") -> DataFrame:
    """pages with a struct: host, path, rule, verdict.

    rules: (host, path prefix, allow or block); the longest rule that fits wins.
    Where none fits, a page is blocked if its host or a parent of it is in
    blocked_hosts. Rules and hosts are each one cascade over the keys of all pages.
    """
    spark: SparkSession = pages.sparkSession
    table = lambda rows: spark.createDataFrame([(x,) for x in rows], "key string")
    verdicts = {}
    for h, p, v in rules:
        verdicts.setdefault(v, []).append(h + p)
    depths = sorted({h.count(".") + 1 for h, _, _ in rules})
    lengths = sorted({len(p) for _, p, _ in rules})
    host_depths = sorted({h.count(".") + 1 for h in blocked_hosts})
    split = pages.withColumn("__h", host(F.col(url))).withColumn("__p", path(F.col(url)))
    for_rules = lambda h, p: candidates(h, p, depths, lengths)
    for_hosts = lambda h: F.transform(candidates(h, F.lit(""), host_depths, [0]), lambda k: F.concat(F.lit("//"), k))
    universe = materialise(split.select("__h", "__p").distinct().select(F.explode(F.concat(for_rules(F.col("__h"), F.col("__p")), for_hosts(F.col("__h")))).alias("key")).distinct())
    sides = {v: Cascade(table(keys), universe) for v, keys in verdicts.items()}
    hosts = Cascade(table(["//" + h for h in blocked_hosts]), universe)

    split = split.withColumns({f"__bits_{v}": c.bits() for v, c in sides.items()} | {"__hosts": hosts.bits()})

    def fits(verdict, cascade):
        listed = F.filter(for_rules(F.col("__h"), F.col("__p")), lambda k: cascade.has(k, F.col(f"__bits_{verdict}")))
        return F.transform(listed, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("rule"), F.lit(verdict).alias("verdict")))

    found = split.withColumn("__r", F.array_min(F.concat(*[fits(v, c) for v, c in sides.items()])) if sides else F.lit(None).cast("struct<n:int,rule:string,verdict:string>"))
    blocked = F.exists(for_hosts(F.col("__h")), lambda k: hosts.has(k, F.col("__hosts")))
    found = found.withColumn("__v", F.when(F.col("__r").isNotNull(), F.col("__r.verdict")).when(blocked, F.lit("block")).otherwise(F.lit("allow")))
    return found.withColumn(into, F.struct(F.col("__h").alias("host"), F.col("__p").alias("path"), F.col("__r.rule").alias("rule"), F.col("__v").alias("verdict"))).select(*[c for c in pages.columns if c != into], into)
