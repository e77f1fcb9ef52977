"""SimHash near-duplicates by the generalised pigeonhole principle.

Search: all pairs of 64-bit fingerprints within tau bits. Bits that go together
are grouped into m partitions; every partition gets its own threshold t_i with
sum(t_i + 1) = tau + 1, so a pair within tau bits is within t_i in at least one
partition. Dynamic programming chooses the thresholds (and m) by the estimated
numbers of probes and of candidates, from bit statistics over all fingerprints.
A fingerprint then probes an index with every value within t_i of its own in
partition i, and candidates are verified in the join itself.

Dense groups don't make all their pairs: first each fingerprint is held only
against the least and the greatest one that agrees with it in two partitions;
that ties most of a group together, and the full search then only looks for
links between different components. Its result is a superset of a spanning
forest of all links, so components lose none of them.

Defined results: a null or empty text, or one of blanks alone, has fingerprint
zero and is linked like any other; equal texts have equal fingerprints; a null
id belongs to a component but can't be its smallest id; an empty table gives an
empty result. Whole texts are read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepframe.functions.scratch import join_small, materialise, new_path, scope
from sweepframe.llm.components import tied
from sweepframe.llm.words import free_names

SEED = 42
#: Items of a text that are hashed at a time.
BLOCK = 1 << 16
#: Relative cost of one probe row (shuffled) to one candidate (compared).
PROBE_COST = 20.0


def words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case (bytes.lower and bytes.split know ASCII alone)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(tokens: list[bytes], size: int) -> Iterator[bytes]:
    """All runs of `size` words, repeats included; the whole sequence if there are fewer; none without a word. They are made one by one."""
    if len(tokens) <= size:
        return iter([b" ".join(tokens)] if tokens else [])
    return map(b" ".join, zip(*[itertools.islice(tokens, i, None) for i in range(size)]))


def hashes(items) -> Iterator[np.ndarray]:
    """The items' XXH64 values, in blocks: of a very long text, never all items are held."""
    digest, items = xxhash.xxh64_intdigest, iter(items)
    while len(block := np.array([digest(x, SEED) for x in itertools.islice(items, BLOCK)], "<u8")):
        yield block


def simhash(items) -> int:
    """Bit i is 1 if it is set in over half of the items' XXH64 values; 0 for no items."""
    votes, n = np.zeros(64, np.uint64), 0
    for values in hashes(items):
        votes += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint64)
        n += len(values)
    return int(np.packbits(votes * np.uint64(2) > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, size: int = 3, distinct: bool = False) -> Column:
    """64-bit fingerprint (as a signed long) of the text's word shingles, repeats included or not."""

    @F.pandas_udf("long")
    def compute(texts: pd.Series) -> pd.Series:
        found = (shingles(words(t), size) for t in texts)
        return pd.Series(np.array([simhash(set(x) if distinct else x) for x in found], np.uint64).view(np.int64))

    return compute(text)


# ---------------------------------------------------------------- the search plan


def bit_statistics(prints: DataFrame, fp: str = "fp") -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for all pairs of bits, how often both are set: 64 x 64 sums, added up from all rows."""

    def sums(batches):
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        yield pd.DataFrame({"cell": np.arange(4097, dtype=np.int32), "n": np.append(total.ravel(), n).astype(np.int64)})

    rows = prints.select(F.col(fp).alias("fp")).mapInPandas(sums, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(4097)
    flat[rows["cell"]] = rows["n"]
    return int(flat[4096]), flat[:4096].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of the 64 bits, near equal in size, with correlated bits together: each starts at the freest bit left and takes the bits most correlated with it."""
    mean = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    corr = np.abs((both / max(1, n) - np.outer(mean, mean)) / np.outer(spread, spread))
    left, out = list(range(64)), []
    for i in range(m):
        width = (64 - sum(map(len, out))) // (m - i)
        part = [max(left, key=lambda b: (spread[b], -b))]
        left.remove(part[0])
        while len(part) < width:
            b = max(left, key=lambda b: (corr[b, part].mean(), -b))
            part.append(b)
            left.remove(b)
        out.append(sorted(part))
    return out


def costs(n: int, mean: np.ndarray, part: list[int], tau: int) -> list[float]:
    """For thresholds -1 to tau: estimated cost of this partition for each fingerprint: probes, and others within the threshold if bits differ independently."""
    chance = np.zeros(len(part) + 1)
    chance[0] = 1
    for b in part:
        differ = 2 * mean[b] * (1 - mean[b])
        chance[1:] = chance[1:] * (1 - differ) + chance[:-1] * differ
        chance[0] *= 1 - differ
    out, probes, near = [0.0], 0, 0.0
    for t in range(tau + 1):
        probes += math.comb(len(part), t)
        near += chance[t] if t < len(chance) else 0
        out.append(PROBE_COST * (probes + 1) + n * near)
    return out


def allocate(table: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """Thresholds with sum(t_i + 1) = tau + 1 of least total cost, by dynamic programming; table[i][t + 1] is the cost of threshold t in partition i."""
    best = {0: (0.0, [])}
    for row in table:
        best = {k: min(((best[k - s][0] + c, [*best[k - s][1], s - 1]) for s, c in enumerate(row) if k - s in best), key=lambda x: x[0]) for k in range(tau + 2) if any(k - s in best for s in range(len(row)))}
    return best[tau + 1]


def search_plan(prints: DataFrame, tau: int, fp: str = "fp") -> list[tuple[list[int], int]]:
    """(bits, threshold) of every partition."""
    n, both = bit_statistics(prints, fp)
    mean = np.diag(both) / max(1, n)
    plans = []
    for m in range(2, min(tau + 1, 8) + 1) if tau else [1]:
        parts = group_bits(n, both, m)
        cost, thresholds = allocate([costs(n, mean, p, tau) for p in parts], tau)
        plans.append((cost, m, list(zip(parts, thresholds))))
    return min(plans, key=lambda x: x[:2])[2]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _mask(bits) -> int:
    return _signed(sum(1 << b for b in bits))


def near(a: Column, b: Column, tau: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= tau


def _keys(parts: list[list[int]]) -> Column:
    """One row for each bit group: its number g and the fingerprint's value v there."""
    return F.explode(F.array(*[F.struct(F.lit(i).alias("g"), F.col("fp").bitwiseAND(F.lit(_mask(p)).cast("long")).alias("v")) for i, p in enumerate(parts)]))


def anchors(rows: DataFrame, plan: list[tuple[list[int], int]], tau: int) -> DataFrame:
    """Pairs (a, b) of each key with the least and the greatest key that share all bits, or the value of two partitions, with it: rows in proportion to the keys, whatever the size of a group."""
    groups = [p for p, _ in plan]
    parts = [list(range(64)), *([sorted(x + y) for x, y in itertools.combinations(groups, 2)] if len(groups) > 2 else groups)]
    spread = rows.select("key", "fp", _keys(parts).alias("k")).select("key", "fp", "k.g", "k.v")
    ends = spread.groupBy("g", "v").agg(F.min("key").alias("lo"), F.min_by("fp", "key").alias("lo_fp"), F.max("key").alias("hi"), F.max_by("fp", "key").alias("hi_fp")).where("lo < hi")
    tied = spread.join(ends, ["g", "v"]).select("key", "fp", F.explode(F.array(F.struct(F.col("lo").alias("other"), F.col("lo_fp").alias("ofp")), F.struct(F.col("hi").alias("other"), F.col("hi_fp").alias("ofp")))).alias("x"))
    tied = tied.where((F.col("key") != F.col("x.other")) & near(F.col("fp"), F.col("x.ofp"), tau))
    return tied.select(F.least("key", "x.other").alias("a"), F.greatest("key", "x.other").alias("b")).distinct()


def across(rows: DataFrame, plan: list[tuple[list[int], int]], tau: int) -> DataFrame:
    """All pairs (a, b) of keys within tau bits whose components (column root) differ: each fingerprint probes the index of every partition, and the join verifies."""
    index, probes = [], []
    for i, (bits, t) in enumerate(plan):
        if t < 0:
            continue
        own = F.col("fp").bitwiseAND(F.lit(_mask(bits)).cast("long"))
        index.append(F.struct(F.lit(i).alias("g"), own.alias("v")))
        flips = [_mask(c) for d in range(t + 1) for c in itertools.combinations(bits, d)]
        probes += [F.struct(F.lit(i).alias("g"), own.bitwiseXOR(F.lit(x).cast("long")).alias("v")) for x in flips]
    left = rows.select(F.col("key").alias("a"), F.col("fp").alias("fa"), F.col("root").alias("ra"), F.explode(F.array(*probes)).alias("k")).select("a", "fa", "ra", "k.g", "k.v")
    right = rows.select(F.col("key").alias("b"), F.col("fp").alias("fb"), F.col("root").alias("rb"), F.explode(F.array(*index)).alias("k")).select("b", "fb", "rb", "k.g", "k.v")
    found = left.join(right, (left["g"] == right["g"]) & (left["v"] == right["v"]) & (F.col("ra") != F.col("rb")) & near(F.col("fa"), F.col("fb"), tau))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link(rows: DataFrame, tau: int) -> DataFrame:
    """(key, fp, root) for rows (key, fp) with distinct, non-null long keys: components under "within tau bits"."""
    rows = materialise(rows)
    plan = search_plan(rows.select("fp").distinct(), tau)
    first = materialise(anchors(rows, plan, tau))
    rooted = materialise(_rooted(rows, first))
    second = materialise(across(rooted, plan, tau))
    if second.isEmpty():
        return rooted
    return materialise(_joined(rooted, second))


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows (key, ...) with the root of each key under the links (a, b)."""
    return join_small(rows, tied(links).withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def _joined(rooted: DataFrame, links: DataFrame) -> DataFrame:
    """rooted (key, root, ...) with the roots under more links, a written table: only roots are tied anew, each stands for all its keys."""
    ends = links
    for x in "ab":
        own = rooted.select(F.col("key").alias(x), F.col("root").alias("root" + x))
        # the links are the small side here
        ends = materialise(join_small(own, ends, x))
    more = tied(ends, "roota", "rootb").select(F.col("node").alias("root"), F.col("root").alias("further"))
    return join_small(rooted, more, "root", "left").withColumn("root", F.coalesce("further", "root")).select(*rooted.columns)


def near_duplicates(docs: DataFrame, tau: int = 2, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id): one row per row of docs; component_id is the smallest doc_id reachable over links."""
    rows = materialise(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), size).alias("fp")))
    ids = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = link(rows.select(F.col("fp").alias("key"), "fp").distinct(), tau)
    least = roots.join(ids, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- verified near-duplicates

#: Texts whose shingles are counted (one in SAMPLE_ONE_IN, SAMPLE_TEXTS at least), and the most shingles known as frequent.
SAMPLE_ONE_IN, SAMPLE_TEXTS, FREQUENT = 32, 4_000, 100_000
#: Bits of the parity sketch of a set that goes with every prefix, and of the one by which single pairs are held.
SKETCH, WIDE = 512, 8192


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct XXH64 values of the text's shingles."""
    return _hashed(shingles(words(text), size))


def _hashed(items) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.int64), *[np.unique(x).view(np.int64) for x in hashes(items)]]))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def shingle_sets(text: Column, size: int) -> Column:
    return F.arrow_udf(lambda texts: _lists([shingle_set(t.as_py(), size) for t in texts]), "array<long>")(text)


def wide_sketches(text: Column, size: int) -> Column:
    return F.arrow_udf(lambda texts: _lists([sketch(shingle_set(t.as_py(), size), WIDE) for t in texts]), "array<long>")(text)


def frequent_shingles(docs: DataFrame, size: int, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Sorted values and counts of the commonest shingles of a sample of docs. They only order prefixes: any choice gives the same pairs."""
    one_in = max(1, min(SAMPLE_ONE_IN, docs.count() // SAMPLE_TEXTS))
    sample = docs.where(F.pmod(F.xxhash64(text), F.lit(one_in)) == 0)
    counts = sample.select(F.explode(shingle_sets(F.col(text), size)).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    found = counts.where("n > 1").orderBy(F.desc("n"), "t").limit(FREQUENT).toPandas().sort_values("t")
    return found["t"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def prefix(values: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first values of a set, rare ones first, of which two sets that are similar enough share at least one."""
    if not len(values):
        return values
    known, counts = frequent
    weight = np.zeros(len(values), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        weight = np.where(known[at] == values, counts[at], 0)
    most = len(values) - math.ceil(similarity * len(values) - 1e-6) + 1
    return values[np.lexsort((values, weight))[:most]]


def sketch(values: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """Bit b is the parity of the number of values that are b modulo bits: two sets differ in at least as many values as their sketches in bits."""
    parity = (np.bincount(values & (bits - 1), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view("<i8")


def signatures(spark: SparkSession, frequent: tuple[np.ndarray, np.ndarray], similarity: float, size: int):
    """A column function: text -> struct of fp (SimHash of the distinct words), digest (of the sequence of words), and of the set of shingles its size n, sketch and prefix t."""
    sent = spark.sparkContext.broadcast(frequent)

    @F.arrow_udf("struct<fp: long, digest: binary, n: int, sketch: array<long>, t: array<long>>")
    def compute(texts: pa.Array) -> pa.Array:
        prints, digests, counts, sketches, starts = [], [], [], [], []
        for text in texts:
            tokens = words(text.as_py())
            found = _hashed(shingles(tokens, size))
            prints.append(simhash(set(tokens)))
            digests.append(hashlib.md5(b" ".join(tokens)).digest())
            counts.append(len(found))
            sketches.append(sketch(found))
            starts.append(prefix(found, sent.value, similarity))
        parts = [pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(digests, pa.binary()), pa.array(counts, pa.int32()), _lists(sketches), _lists(starts)]
        return pa.StructArray.from_arrays(parts, ["fp", "digest", "n", "sketch", "t"])

    return compute


def _can_be_similar(a: str, b: str, similarity: float, kind: str = "sketch") -> Column:
    """Whether sets of these sizes (columns n) and sketches can be similar enough."""
    na, nb = F.col("n" + a), F.col("n" + b)
    if "sketch" == kind:
        differ = sum((F.bit_count(F.get(kind + a, F.lit(i)).bitwiseXOR(F.get(kind + b, F.lit(i)))) for i in range(SKETCH // 64)), F.lit(0))
    else:
        differ = F.aggregate(F.zip_with(kind + a, kind + b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (F.least(na, nb) >= F.greatest(na, nb) * F.lit(similarity) - 1e-6) & (differ <= (na + nb) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6)


_START = ("key", "root", "n", "sketch", "place")


def shared_starts(texts: DataFrame) -> DataFrame:
    """(key, place, t): the prefix values of texts (key, t array) that stand in several texts."""
    rows = texts.select("key", F.posexplode("t").alias("place", "t"))
    several = rows.groupBy("t").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("t")
    return materialise(join_small(rows, materialise(several), "t").select("key", "place", "t"))


def _enough(a: str, b: str, similarity: float) -> Column:
    """Whether at a value that two prefixes share, first or not, enough is left of both sets, and their sizes and sketches agree."""
    na, nb = F.col("n" + a), F.col("n" + b)
    most = F.least(na - F.col("place" + a), nb - F.col("place" + b))
    return (most >= (na + nb) * F.lit(similarity / (1 + similarity)) - 1e-6) & _can_be_similar(a, b, similarity)


def star_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each of the rows (key, root, n, sketch, place, t) with one row of its value t, chosen by a hash of key and value, if it is of another group: as many as rows, and different partners for different values."""
    ends = rows.groupBy("t").agg(F.min_by(F.struct(*_START), F.xxhash64("key", "t")).alias("x"))
    ends = ends.select("t", *[F.col(f"x.{c}").alias(c + "b") for c in _START])
    found = rows.select("t", *[F.col(c).alias(c + "a") for c in _START]).join(ends, "t")
    return _pairs(found.where((F.col("roota") != F.col("rootb")) & _enough("a", "b", similarity)))


def prefix_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of keys in different groups whose sets can be similar enough, for rows (key, root, n, sketch, place, t) of their prefixes.

    Two sets that are similar enough share a value of their prefixes, and at the
    first such value, enough must be left of both for the overlap that is needed.
    Of a value that one group has most rows of, only the rows of other groups
    look for partners, so a large group isn't held against itself.
    """
    main = materialise(rows.groupBy("t", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("t").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots"))
    rows = join_small(rows, main, "t")
    left, right = (rows.select("t", "main", *[F.col(c).alias(c + side) for c in _START]) for side in "ab")
    once = (F.col("rootb") == F.col("main")) | (F.col("keya") < F.col("keyb"))
    return _pairs(left.where("roota != main").drop("main").join(right, "t").where(once & (F.col("roota") != F.col("rootb")) & _enough("a", "b", similarity)))


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("keya", "keyb").alias("a"), F.greatest("keya", "keyb").alias("b")).distinct()


def similar_of(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets (key, s) are similar enough."""
    rows = pairs.join(sets.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    rows = rows.select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("n"))
    return rows.where(F.col("both") >= F.lit(similarity) * (F.col("n") - F.col("both"))).select("a", "b")


def near_pairs(rows: DataFrame, tau: int) -> DataFrame:
    """(a, b): pairs of the fingerprints (key, fp; both distinct) within tau bits: those with the ends of each probed group, then those between groups that these leave apart. Their number follows the rows, not the square of a group."""
    plan = search_plan(rows.select("fp"), tau)
    first = materialise(anchors(rows, plan, tau))
    rooted = materialise(_rooted(rows, first))
    return first.unionAll(across(rooted, plan, tau))


def keep_one(docs: DataFrame, similarity: float = 0.8, size: int = 5, tau: int = 7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one row (the smallest id; a null id only if there is no other) of each group of near duplicates.

    Rows are linked if their sets of `size`-word shingles have a Jaccard
    similarity of `similarity` or more. Texts with the same sequence of words are
    one from the start. Candidates are pairs within tau bits of a SimHash over
    the distinct words, which changes less under scattered edits than one over
    shingles; their sets are compared. Similar pairs of groups that are apart
    still, because the bits miss them, are found by prefixes of the sets,
    whatever tau is (up to collisions of 64-bit hashes). No step makes all pairs
    of a group. Texts without a word are one group. Rows that repeat both id and
    text leave one row; an empty table stays empty; extra columns pass through.
    """
    row = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))))
    path = new_path(docs.sparkSession)
    with scope(docs.sparkSession):
        kept = materialise(_kept(docs, row, similarity, size, tau, doc_id, text), path)
    mine, theirs = free_names(docs, "row", "id")
    rows = docs.withColumn(mine, row).join(kept.select(F.col("row").alias(mine), F.col("id").alias(theirs)).hint("merge"), mine).where(F.col(doc_id).eqNullSafe(F.col(theirs)))
    # rows that repeat both id and text are copies, too
    return rows.dropDuplicates([mine]).select(*docs.columns)


def _kept(docs: DataFrame, row: Column, similarity: float, size: int, tau: int, doc_id: str, text: str) -> DataFrame:
    """(row, id) of the rows that keep_one keeps."""
    known = frequent_shingles(docs, size, text)
    slim = docs.select(F.col(doc_id).alias("id"), row.alias("row"), signatures(docs.sparkSession, known, similarity, size)(F.col(text)).alias("x"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    texts = slim.groupBy("x.digest").agg(best, *[F.any_value(f"x.{c}").alias(c) for c in ("fp", "n", "sketch", "t")])
    # one row for each different text, numbered once and for all by writing it
    texts = materialise(texts.select(F.monotonically_increasing_id().alias("key"), "best", "fp", "n", "sketch", "t"))
    sizes = texts.select("key", "n", "sketch")

    def ends(pairs: DataFrame, held: DataFrame) -> DataFrame:
        """The pairs with the columns of a table of keys, for both ends."""
        for x in "ab":
            pairs = pairs.join(held.select(*[F.col(c).alias(x if c == "key" else c + x) for c in held.columns]), x)
        return pairs

    def made(pairs: DataFrame, column, name: str) -> DataFrame:
        """(key, name): a column made of the texts of all ends."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(texts, "key").select("key", F.col("best.row").alias("__row"))
        bodies = join_small(docs.select(row.alias("__row"), F.col(text).alias("__text")), materialise(wanted), "__row")
        return materialise(bodies.select("key", column(F.col("__text"), size).alias(name)).dropDuplicates(["key"]))

    def similar(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose sets are similar enough: by their sketches, then by wide ones, and what is left by the sets themselves."""
        pairs = materialise(ends(pairs, sizes).where(_can_be_similar("a", "b", similarity)).select("a", "b", "na", "nb"))
        pairs = materialise(ends(pairs, made(pairs, wide_sketches, "wide")).where(_can_be_similar("a", "b", similarity, "wide")).select("a", "b"))
        return materialise(similar_of(pairs, made(pairs, shingle_sets, "s"), similarity))

    # texts with one fingerprint are held against the first of them
    prints = materialise(texts.groupBy("fp").agg(F.min("key").alias("key")))
    same = texts.join(prints.withColumnRenamed("key", "a"), "fp").where("a < key").select("a", F.col("key").alias("b"))
    roots = materialise(_rooted(texts.select("key"), similar(materialise(near_pairs(prints.select("key", "fp"), tau).unionAll(same)))))
    # what the bits miss: first one partner for each value of a prefix, then all pairs between groups that are apart still
    starts = shared_starts(texts.select("key", "t"))
    for find in (star_pairs, prefix_pairs):
        more = materialise(find(starts.join(sizes, "key").join(roots, "key"), similarity))
        if not more.isEmpty():
            roots = materialise(_joined(roots, similar(more)))
    best = texts.join(roots, "key").groupBy("root").agg(F.min("best").alias("best"))
    return best.select("best.row", "best.id")
