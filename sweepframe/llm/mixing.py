"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A source first takes whole copies of all
its documents as often as the target allows; the rest is a sample of documents
without replacement, of a fixed number of words. A document of n words should be
in it with probability min(1, c sqrt(n)), where c makes the expected words equal
the rest: documents for which that is 1 are certain and taken first. The others
are ranked by random odds divided by inclusion odds; in that order each is taken
if its words still fit, so a source ends within its smallest document not taken
of its target.

No group is sorted in one task: the rank is cut into 2^13 cells by source, the
cell in which the words run out is cut again, and only the documents of that
fine cell are ordered. Documents beyond it that still fit are found in the same
way, round by round, as the gap shrinks. What is left for each source is a short
list of rounds, which any row can be held against.

Defined results: a null text has size 0 and takes nothing; a null source is a
source of its own, last in order; rows that repeat id and text are taken or
left together, other rows of one id are documents of their own; equal ranks go
by id (null first), then size; an empty table gives an empty result. Extra
columns pass through ``take``; the column it adds is named by the caller and
replaces one of that name. A row for each source goes through single tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweepframe.functions.scratch import few_rows, join_small, materialise, new_path, scope
from sweepframe.llm.words import free_names, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2
_CELLS = 1 << 13


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) from id and text, the same in every run."""
    whole = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return (F.conv(F.substring(F.md5(whole), 1, 12), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 48))


def rank(u: Column, size: Column, factor: Column) -> Column:
    """Random odds divided by inclusion odds: small ranks are taken first."""
    p = factor * F.sqrt(size.cast("double"))
    return (u / (1 - u)) / (p / (1 - p))


def _cell(q: Column) -> Column:
    return F.least(F.floor(q / (1 + q) * (_CELLS * _CELLS)), F.lit(_CELLS * _CELLS - 1))


def measure(docs: DataFrame, seed: str = "mix", doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(source, id, size, u) of every document: all that the mix needs to know of it."""
    return docs.select(F.col(source).alias("source"), F.col(doc_id).alias("id"), word_count(F.col(text)).alias("size"), uniform(F.col(doc_id), F.col(text), seed).alias("u"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) -> with weight and target.

    Weights repeat over the sources in code point order, null last. A target
    stops at most x source_size; the excess goes to the others by weight. With
    the sources in the order of cap / weight, those below the common level are
    full, and one pass of running sums finds the level.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % n + 1))
    x = x.withColumn("cap", F.col("source_size").cast("double") * most).withColumn("level", F.col("cap") / F.col("weight"))
    x = x.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
    x = x.withColumn("here", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    x = x.withColumn("full", F.col("level") <= F.col("here"))
    # the level at the first source that isn't full; further on it only falls
    x = x.withColumn("common", F.max(F.when(~F.col("full"), F.col("here"))).over(whole))
    return x.select("source", "source_size", "weight", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("common") * F.col("weight"))).alias("target"))


def inclusion(histogram: DataFrame, rests: DataFrame, few: bool) -> DataFrame:
    """(source, certain_from, factor, gap) from (source, size, n) and (source, rest): documents of certain_from words or more are certain, factor is the c of the others, and gap what they must bring.

    With all longer documents certain, a size is certain if its probability would
    still be 1 or more; a row for each different size of a source is ordered.
    """
    order = Window.partitionBy("source").orderBy(F.desc("size"))
    words = F.col("size") * F.col("n")
    x = _with_source(histogram.where("size > 0"), rests.where("rest > 0"), few)
    x = x.withColumn("longer", F.coalesce(F.sum(words).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("tail", F.sum(words * F.sqrt(F.col("size").cast("double"))).over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("certain", (F.col("rest") - F.col("longer")) * F.sqrt(F.col("size").cast("double")) >= F.col("tail"))
    x = x.groupBy("source", "rest").agg(F.min(F.when(F.col("certain"), F.col("size"))).alias("certain_from"), F.sum(F.when(F.col("certain"), words).otherwise(0)).alias("sure"), F.max(F.when(~F.col("certain"), F.col("tail"))).alias("tail"))
    return x.select("source", "certain_from", ((F.col("rest") - F.col("sure")) / F.col("tail")).alias("factor"), (F.col("rest") - F.col("sure")).alias("gap"))


_UNITS = "array<struct<u:double,size:bigint,id:{0}>>"


def _round(slim: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """One round for every source (source, certain_from, factor, gap, from): how far in the ranks it comes.

    Documents that are ranked beyond `from` and fit into the gap are added up by
    cells. Those of the cells before the one in which the gap is filled are all
    taken; of that one's, each is taken if it fits. Gives end, units (those of the last
    cell that are taken) and left; end is null where all fit.
    """
    q = rank(F.col("u"), F.col("size"), F.col("factor"))
    fits = (F.col("size") > 0) & (F.col("size") <= F.col("gap")) & F.coalesce(F.col("size") < F.col("certain_from"), F.lit(True))
    rows = _with_source(slim, state, few).withColumn("q", F.when(fits, q)).withColumn("cell", _cell(F.col("q"))).where(F.col("cell") > F.col("from"))
    level = None
    for step in (_CELLS, 1):
        inside = rows if level is None else _with_source(rows.select("source", "size", "cell"), level, few).where(F.floor(F.col("cell") / _CELLS) == F.col("at"))
        before = F.lit(0).cast("long") if level is None else F.any_value("before")
        gap = F.any_value("gap") if level is None else F.any_value("open")
        sums = inside.groupBy("source", F.floor(F.col("cell") / step).alias("here")).agg(F.sum("size").alias("words"), gap.alias("open"), before.alias("before"))
        sums = sums.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("here")))
        # the first cell in which the gap is filled; no row where all that fits leaves it open
        first = sums.where("upto >= open").groupBy("source").agg(F.min_by(F.struct("here", (F.col("upto") - F.col("words")).alias("before"), "open"), "here").alias("x"))
        level = materialise(first.select("source", F.col("x.here").alias("at"), "x.before", "x.open"))
    ends = level.select("source", F.col("at").alias("end"), "before", "open")
    tail = _with_source(rows.select("source", "q", "id", "size", "u", "cell"), ends, few).where(F.col("cell") == F.col("end"))
    tail = tail.groupBy("source", "end", "before", "open", "q", "id", "size", "u").agg(F.sum("size").alias("words"))
    ordered = tail.groupBy("source", "end", "before", "open").agg(F.array_sort(F.collect_list(F.struct("q", "id", "size", "u", "words"))).alias("all"))
    kind = slim.schema["id"].dataType.simpleString()
    start = F.struct((F.col("open") - F.col("before")).alias("left"), F.array().cast(_UNITS.format(kind)).alias("units"))
    take_if_fits = lambda s, x: F.when(x["words"] <= s["left"], F.struct((s["left"] - x["words"]).alias("left"), F.concat(s["units"], F.array(F.struct(x["u"].alias("u"), x["size"].alias("size"), x["id"].alias("id")))).alias("units"))).otherwise(s)
    found = ordered.select("source", "end", F.aggregate("all", start, take_if_fits).alias("x")).select("source", "end", "x.left", "x.units")
    return _with_source(state, found, few, "left")


def _plan(slim: DataFrame, weights, share: float, most: int) -> DataFrame:
    histogram = materialise(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    sources = sources.withColumn("copies", F.least(F.lit(most), F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).cast("int"))
    sources = materialise(sources.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")))
    few = few_rows(sources)
    chances = materialise(inclusion(histogram, sources.select("source", "rest"), few))
    state = chances.where("factor is not null and gap > 0").withColumn("from", F.lit(-1).cast("long"))
    rounds = None
    while not (state := materialise(state)).isEmpty():
        done = materialise(_round(slim, state, few))
        this = done.select("source", F.struct("from", F.coalesce("end", F.lit(_CELLS * _CELLS).cast("long")).alias("end"), F.col("gap").alias("most"), "units").alias("round"))
        rounds = this if rounds is None else rounds.unionAll(this)
        state = done.where("end is not null").select("source", "certain_from", "factor", F.col("left").alias("gap"), F.col("end").alias("from"))
    kind = slim.schema["id"].dataType.simpleString()
    empty = F.array().cast(f"array<struct<from:bigint,end:bigint,most:double,units:{_UNITS.format(kind)}>>")
    x = sources.drop("rest", "weight")
    for more in [chances.drop("gap"), *([] if rounds is None else [rounds.groupBy("source").agg(F.array_sort(F.collect_list("round")).alias("rounds"))])]:
        x = _with_source(x, more, few, "left")
    return x.withColumn("rounds", empty if rounds is None else F.coalesce("rounds", empty))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: str = "mix", doc_id: str = "doc_id", source: str = "source", text: str = "text", measured: DataFrame | None = None) -> DataFrame:
    """One row for each source: source, source_size, target, copies (whole copies of every document), certain_from, factor and rounds, which tell the documents that get one more. measured: a written measure(docs), if there is one."""
    path = new_path(docs.sparkSession)
    with scope(docs.sparkSession):
        slim = materialise(measure(docs, seed, doc_id, source, text)) if measured is None else measured
        return materialise(_plan(slim, weights, share, most), path)


def _with_source(rows: DataFrame, small: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """rows with the columns of a table of one row for each source, sent to all tasks if the counted sources are few."""
    other = small.withColumnRenamed("source", "__of")
    return rows.join(F.broadcast(other) if few else other, rows["source"].eqNullSafe(other["__of"]), how).drop("__of")


def _copies(size: Column, u: Column, doc_id: Column, p) -> Column:
    """How often a document is taken by the plan p of its source."""
    q = rank(u, size, p("factor"))

    def taken(r):
        listed = F.exists(r["units"], lambda x: (x["u"] == u) & (x["size"] == size) & x["id"].eqNullSafe(doc_id))
        return (size > 0) & (size <= r["most"]) & (((_cell(q) > r["from"]) & (_cell(q) < r["end"])) | ((_cell(q) == r["end"]) & F.coalesce(listed, F.lit(False))))

    certain = F.coalesce(size >= p("certain_from"), F.lit(False))
    return (p("copies") + F.when(certain | F.coalesce(F.exists(p("rounds"), taken), F.lit(False)), 1).otherwise(0)).cast("int")


def take_measured(measured: DataFrame, planned: DataFrame) -> DataFrame:
    """(source, id, size, u) -> with source_size, target and copies."""
    held = planned.select(F.struct(*[F.col(c) for c in planned.columns]).alias("__plan"))
    rows = join_small(measured, held, measured["source"].eqNullSafe(held["__plan.source"]), "left")
    p = lambda name: F.col(f"__plan.{name}")
    return rows.select(*measured.columns, p("source_size").alias("source_size"), p("target").alias("target"), _copies(F.col("size"), F.col("u"), F.col("id"), p).alias("copies"))


def take(docs: DataFrame, planned: DataFrame, into: str = "copies", seed: str = "mix", doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs with a struct column `into` (replaced, if there is one): size, source_size, target, copies (0 to the most allowed)."""
    plan_, size, u = free_names(docs, "plan", "size", "u", but=into)
    held = planned.select(F.struct(*[F.col(c) for c in planned.columns]).alias(plan_))
    rows = docs.withColumns({size: word_count(F.col(text)), u: uniform(F.col(doc_id), F.col(text), seed)})
    rows = join_small(rows, held, rows[source].eqNullSafe(held[f"{plan_}.source"]), "left")
    p = lambda name: F.col(f"{plan_}.{name}")
    copies = _copies(F.col(size), F.col(u), F.col(doc_id), p)
    made = F.struct(F.col(size).alias("size"), p("source_size").alias("source_size"), p("target").alias("target"), copies.alias("copies"))
    return rows.withColumn(into, made).select(*[c for c in docs.columns if c != into], into)


def mixed(docs: DataFrame, planned: DataFrame, **columns) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken."""
    taken, again = free_names(docs, "taken", "again")
    rows = take(docs, planned, into=taken, **columns).where(F.col(f"{taken}.copies") > 0)
    return rows.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(f"{taken}.copies")))).select(*docs.columns)
