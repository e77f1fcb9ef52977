"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions.

A text is a multiset of paragraphs: lines, cut further after each full stop
and blank, and long ones after words that their own content chooses, so that a
small change costs little of a text with few paragraphs, wherever it is. The MD5 of a paragraph gives a wide vector: two numbers of 60 bits,
and 108 of its bits as lanes of their own. A fingerprint is the sum of the
vectors of all paragraphs, each number modulo 2^60 and each lane modulo 2^20,
with the count of paragraphs in front. Equal multisets have equal
fingerprints in any order; fingerprints add up and subtract as texts gain and
lose paragraphs. The lanes, read as sums of signs, are a random projection, so
their cosine estimates how much of two texts is the same (to about 0.1).

Defined results: a null text counts as empty; an empty text has the zero
fingerprint; two equal fingerprints have likeness 1, and zero against another
0. Beyond 2^19 paragraphs a lane can wrap, which blurs the likeness of such texts,
not their equality. A null doc_id comes first; rows with equal ids are ordered
by a hash of the text; repeated rows follow each other; a single row is its own
next. An empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweepframe.functions.scratch import join_small, materialise

NUMBER = (1 << 60) - 1
#: Lanes are kept three to a long, 21 bits apart: bit k + 21 j of the hash is lane j of packed long k.
SPREAD = 1 | 1 << 21 | 1 << 42
LANE = (1 << 20) - 1
LANES = LANE | LANE << 21 | LANE << 42
STEPS = 18
#: A paragraph of more than LONG code points is cut after every word whose first and last code point and length say so, one of ENDS words.
LONG, ENDS = 120, 8
#: What is longer still is cut after LONG code points, or up to MORE later where that completes a word. The pattern matches at every place of a line, so it never looks back.
MORE = 40
PART = rf"([^\n]{{1,{LONG}}}[^\n ]{{0,{MORE}}} ?)"
#: Rows of a range of ids that a task orders, and the most ranges.
RANGE_ROWS = 2_000
MAX_RANGES = 1 << 16


def ends_part(word: Column) -> Column:
    """Whether a long paragraph is cut after a word: it depends on the word alone, so parts are the same wherever they stand."""
    return (F.ascii(word) * 7 + F.ascii(F.right(word, F.lit(1))) * 3 + F.length(word)) % ENDS == 0


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text that aren't empty, long ones in parts. A part that begins after a cut is the same in every text."""
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit(". "), F.lit(".\n")), "\n")
    cut = lambda line: F.array_join(F.transform(F.split(line, " "), lambda w: F.when(ends_part(w), F.concat(w, F.lit("\n"))).otherwise(w)), " ")
    parts = F.array_join(F.transform(lines, lambda line: F.when(F.length(line) > LONG, cut(line)).otherwise(line)), "\n")
    return F.filter(F.split(F.regexp_replace(parts, PART, "$1\n"), "\n"), lambda p: p != "")


def _sum(values: Column, mask: int, part=lambda x: x) -> Column:
    zero, m = F.lit(0).cast("long"), F.lit(mask).cast("long")
    return F.aggregate(values, zero, lambda total, x: (total + part(x)).bitwiseAND(m))


def fingerprint(text: Column) -> Column:
    """array<long>: count, two sums modulo 2^60, then the packed lanes of both numbers."""
    digests = F.transform(paragraphs(text), F.md5)
    half = lambda at: F.transform(digests, lambda d: F.conv(F.substring(d, at, 15), 16, 10).cast("long"))
    both = F.array(half(1), half(16))
    spread = F.lit(SPREAD).cast("long")
    lanes = lambda half: F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda k: _sum(half, LANES, lambda x: F.call_function("shiftrightunsigned", x, k).bitwiseAND(spread)))
    # the transform over a one-element array names the hashed paragraphs once, so they are hashed once
    return F.element_at(F.transform(F.array(both), lambda b: F.concat(F.array(F.size(b[0]).cast("long"), _sum(b[0], NUMBER), _sum(b[1], NUMBER)), lanes(b[0]), lanes(b[1]))), 1)


def _combined(a: Column, b: Column, sign: int) -> Column:
    """Number-wise sum or difference, each modulo its power."""

    def one(x, y, i):
        mask = F.when(i == 0, F.lit(0x7FFFFFFFFFFFFFFF)).when(i < 3, F.lit(NUMBER)).otherwise(F.lit(LANES))
        guard = F.when(i == 0, F.lit(0)).when(i < 3, F.lit(NUMBER + 1)).otherwise(F.lit((LANE + 1) * SPREAD))
        return (x + y if sign > 0 else x + guard - y).bitwiseAND(mask)

    at = F.sequence(F.lit(0), F.size(a) - 1)
    return F.transform(at, lambda i: one(F.get(a, i), F.get(b, i), i))


def insert(fp: Column, more: Column) -> Column:
    """The fingerprint after the paragraphs of another fingerprint came in."""
    return _combined(fp, more, 1)


def delete(fp: Column, less: Column) -> Column:
    """The fingerprint after the paragraphs of another fingerprint went."""
    return _combined(fp, less, -1)


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _signs(fp: Column) -> Column:
    n = F.element_at(fp, 1)
    lane = lambda x, j: (F.shiftright(x, 21 * j).bitwiseAND(F.lit(LANE).cast("long")) * 2 - n)
    return F.flatten(F.transform(F.slice(fp, 4, 2 * STEPS), lambda x: F.array(lane(x, 0), lane(x, 1), lane(x, 2))))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x).cast("double")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of the lanes as signs, 1 for equal fingerprints."""
    signs = F.array(_signs(a), _signs(b))
    cosine = F.element_at(F.transform(F.array(signs), lambda s: _dot(s[0], s[1]) / F.sqrt(F.greatest(_dot(s[0], s[0]), F.lit(1.0)) * F.greatest(_dot(s[1], s[1]), F.lit(1.0)))), 1)
    return F.when(a == b, F.lit(1.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(cosine, F.lit(1.0))), 6))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp) of all rows in ascending order of doc_id; the first follows the last.

    Ids are cut into ranges of about RANGE_ROWS rows by their quantiles, and an id
    that fills several ranges (a null one counts as the smallest) into as many
    by the hash of the text; each range is ordered on its own, with the first row
    of the next range as its guard.
    """
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)).cast("long"))
    body = F.coalesce(F.col(text), F.lit(""))
    ids = docs.select(key.alias("k"), F.xxhash64(body).alias("h"))
    n = ids.count()
    ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    side = math.isqrt(ranges) + 1
    cuts = [i / ranges for i in range(1, ranges)] or [0.5]
    bounds = ids.agg(F.percentile_approx("k", cuts, max(10_000, 4 * ranges)).alias("all"))
    bounds = bounds.select(F.posexplode_outer(F.array_sort(F.coalesce("all", F.array().cast("array<bigint>")))).alias("i", "v")).groupBy("v").agg(F.count(F.lit(1)).alias("m")).where("v is not null")
    bounds = materialise(bounds.agg(F.array_sort(F.collect_list(F.struct("v", "m"))).alias("all")))  # at most MAX_RANGES
    # two levels of bounds: a row is held against about 2 sqrt(ranges) of them
    coarse = F.transform(F.filter("all", lambda x, i: i % side == side - 1), lambda x: x["v"])
    fine = F.transform(F.sequence(F.lit(0), F.floor(F.size("all") / side).cast("int")), lambda g: F.slice("all", g * side + 1, side))
    bounds = materialise(bounds.select(coarse.alias("coarse"), fine.alias("fine")))
    outer, inner = bounds.select("coarse").scalar(), bounds.select("fine").scalar()
    below = lambda xs, k: F.aggregate(xs, F.lit(0), lambda s, x: s + F.when(x < k, 1).otherwise(0))
    place = ["range", "part"]

    def in_range(rows):
        rows = rows.withColumns({"__outer": outer, "__inner": inner}).withColumn("__o", below(F.col("__outer"), F.col("k")))
        rows = rows.withColumn("__f", F.get("__inner", F.col("__o"))).withColumn("__i", F.aggregate("__f", F.lit(0), lambda s, x: s + F.when(x["v"] < F.col("k"), 1).otherwise(0)))
        bound = F.get("__f", F.col("__i"))
        parts = F.when(bound["v"] == F.col("k"), bound["m"]).otherwise(1)
        part = F.when(parts > 1, F.least(parts - 1, F.floor((F.col("h") / float(1 << 64) + 0.5) * parts))).otherwise(0)
        return rows.withColumns({"range": F.col("__o") * side + F.col("__i"), "part": F.coalesce(part, F.lit(0)).cast("int")}).drop("__o", "__f", "__i", "__outer", "__inner")

    # the first row of every range, and the range before (the last one's guard is the first of all)
    firsts = in_range(ids).groupBy(*place).agg(F.min(F.struct("k", "h")).alias("first"))
    order, here = Window.orderBy(*place), F.struct(*place)
    firsts = materialise(firsts.select(F.coalesce(F.lag(here).over(order), F.max(here).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("guarded"), F.col("first.k").alias("fk"), F.col("first.h").alias("fh")))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), key.alias("k"), F.xxhash64(body).alias("h"))
    guards = join_small(rows, firsts, (F.col("k") == F.col("fk")) & (F.col("h") == F.col("fh")), most=MAX_RANGES + 1).select("doc_id", "text", "k", "h", "guarded.*", F.lit(1).alias("guard"))
    every = in_range(rows).select("doc_id", "text", "k", "h", *place, F.lit(0).alias("guard")).unionByName(guards)
    every = every.withColumn("fp", fingerprint(F.col("text")))
    ordered = Window.partitionBy(*place).orderBy("guard", "k", "h")
    after = every.withColumn("next_text", F.lead("text").over(ordered)).withColumn("next_fp", F.lead("fp").over(ordered))
    return after.where("guard = 0").select("doc_id", "text", "fp", "next_text", "next_fp")


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last quarter (in code points, rounded down) replaced by as much of the start of the next text."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(next_text, F.lit(1), quarter))
