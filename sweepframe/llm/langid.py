"""Language identification as multilingual mixture inference.

Character trigrams (hashed into a fixed number of buckets) have one smoothed
distribution per language. Expectation-maximisation estimates the proportions
of the languages in a document; the set of languages grows while the penalised
likelihood rises. The gain of a document is its log likelihood for each trigram
over that of trigrams drawn evenly from all buckets: below 0, no mixture of the
learned languages explains the text better than chance does.

Defined results: a null text, an empty text and a text without a letter give
``und`` with score 0, no proportions and no gain. Rows with a null or empty label, a null text, or no letter,
teach nothing. All labels are learned, however many: the model is made and held in blocks of languages. Without any labelled row every text is ``und``. Ties go to the
language whose name sorts first. Repeated rows each count and each get a
result. Extra columns of the input pass through ``identify`` untouched.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sweepframe.functions.scratch import materialise
from sweepframe.functions.worker import kept

#: Buckets of the trigram hash; the model has one row of this width per language.
BUCKETS = 1 << 15
#: Languages of one block of the model (26 MB); a task that counts, the driver and a worker that infers hold about one block at a time.
BLOCK = 200
#: Texts that go through the blocks together, where there are several (their counts: 16 MB).
TOGETHER = 64
SMOOTHING = 0.5
#: Trigrams overlap, so a text has about a third as many independent observations.
OVERLAP = 3.0
EM_STEPS = 12

RESULT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("proportions", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("gain", T.DoubleType()),
    ]
)


def _classes() -> np.ndarray:
    """For every code point: 2 letter, 1 mark (kept inside words), 0 other."""
    kinds = np.zeros(0x110000, np.uint8)
    for i in range(0x32400):  # no letters or marks beyond, but for the variation selectors
        kind = unicodedata.category(chr(i))[0]
        kinds[i] = 2 if kind == "L" else kind == "M"
    return kinds


def trigram_counts(text: str | None) -> np.ndarray | None:
    """Counts by bucket of the trigrams of the lower-cased words; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = kept("letters and marks", _classes)[points]
    if not (kinds == 2).any():
        return None
    spaced = np.concatenate(([0], np.where(kinds > 0, points, 0), [0])).astype(np.uint32)
    keep = np.ones(len(spaced), bool)
    keep[1:] = (spaced[1:] != 0) | (spaced[:-1] != 0)
    x = spaced[keep]
    mixed = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return np.bincount(mixed >> np.uint32(32 - 15), minlength=BUCKETS)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict:
    """The names of all labelled languages in order, and their trigram distributions in broadcast blocks of BLOCK languages.

    Trigrams are counted in the tasks and summed by (language, bucket) into a
    table sorted by language, from which the driver makes one block at a time.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and lang != '' and text is not null")
    most = BLOCK

    def parts(sums):
        for name, found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(found[at])], ["lang", "bucket", "n"])

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, body in zip(batch.column("lang"), batch.column("text")):
                found = trigram_counts(body.as_py())
                if found is None:
                    continue
                name = name.as_py()
                if name in sums:
                    sums[name] += found
                    continue
                if len(sums) == most:
                    yield from parts(sums)
                    sums = {}
                sums[name] = found.astype(np.int64)
        yield from parts(sums)

    table = materialise(rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).orderBy("lang"))
    names = sorted(r.lang for r in table.select("lang").distinct().collect())
    blocks = []
    for first in range(0, len(names), BLOCK):
        own = names[first : first + BLOCK]
        counts, place = np.full((len(own), BUCKETS), SMOOTHING), {name: i for i, name in enumerate(own)}
        seen = table.where(F.col("lang").between(own[0], own[-1])).toPandas()
        counts[seen["lang"].map(place).to_numpy(), seen["bucket"].to_numpy()] += seen["n"].to_numpy()
        blocks.append(spark.sparkContext.broadcast((counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)))
    return {"names": names, "blocks": blocks}


def _em(counts: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the given languages and the log likelihood."""
    share = np.full(len(p), 1.0 / len(p))
    total = counts.sum()
    for _ in range(EM_STEPS):
        joint = share[:, None] * p
        share = (joint / joint.sum(axis=0)) @ counts / total
    return share, float(counts @ np.log(share @ p))


class _Growing:
    """The language set of one text while it grows: what is chosen, and the best addition seen so far in this pass over the blocks."""

    def __init__(self, counts: np.ndarray, languages: int):
        self.at = np.flatnonzero(counts)
        self.c = counts[self.at].astype(float)
        self.total = self.c.sum()
        self.penalty = OVERLAP * (0.5 * np.log(self.total + 1) + np.log(languages + 1))
        self.chosen, self.share, self.p, self.best = [], np.empty(0), np.empty((0, len(self.at))), -np.inf
        self.next, self.languages, self.held = None, languages, None

    def look(self, block: np.ndarray, first: int) -> None:
        """Takes the languages of one block, numbered from first, into account."""
        p = self.held if self.held is not None else block[:, self.at].astype(float)
        if len(block) == self.languages:  # one block is all there is, so the next pass needn't pick from it again
            self.held = p
        if self.chosen:
            # the likelihood is concave in the shares, so its slope towards a language bounds what adding it can gain
            slope = (p * (self.c / (self.share @ self.p))).sum(axis=1) - self.total
            for k in np.flatnonzero(slope > self.penalty):
                if first + int(k) not in self.chosen:
                    share, value = _em(self.c, np.vstack([self.p, p[k]]))
                    self._offer(value, first + int(k), share, p[k])
        else:
            alone = (np.log(p) * self.c).sum(axis=1)  # row by row, so equal languages of different blocks are equal here
            k = int(alone.argmax())
            self._offer(float(alone[k]), first + k, np.ones(1), p[k])

    def _offer(self, value: float, k: int, share: np.ndarray, p: np.ndarray) -> None:
        if self.next is None or value > self.next[0]:  # blocks come in the order of names, so the first of equals stays
            self.next = value, k, share, p.copy()

    def grow(self) -> bool:
        """Makes the best addition of the pass if it is worth the penalty, and says whether there may be another."""
        found, self.next = self.next, None
        if found is None or (self.chosen and found[0] - self.best <= self.penalty):
            return False
        self.best, k, self.share, p = found
        self.chosen, self.p = [*self.chosen, k], np.vstack([self.p, p])
        return True


def infer_all(texts: list[np.ndarray], languages: int, blocks) -> list[tuple[dict[int, float], float]]:
    """For the trigram counts of each text the proportion by language number of the set with the best penalised likelihood, grown one language at a time, and the log likelihood. blocks() gives the blocks of the model in order; each pass over them adds at most one language to each text."""
    every = [_Growing(counts, languages) for counts in texts]
    open_ = every
    while open_:
        first = 0
        for block in blocks():
            for text in open_:
                text.look(block, first)
            first += len(block)
        open_ = [text for text in open_ if text.grow() and len(text.chosen) < languages]
    return [(dict(zip(x.chosen, x.share / x.share.sum())), x.best) for x in every]


def infer(counts: np.ndarray, p: np.ndarray) -> tuple[dict[int, float], float]:
    """infer_all for one text and a model of one block."""
    return infer_all([counts], len(p), lambda: [p])[0]


def _each(sent):
    """The values of broadcasts, one after another; where there are several, a worker lets each go when it has the next."""
    for block in sent:
        yield block.value
        if len(sent) > 1:
            vars(block).pop("_value", None)


def identifier(model: dict):
    """A column function: text -> struct(lang_pred, score, proportions, gain)."""
    names, sent, most = model["names"], model["blocks"], TOGETHER if len(model["blocks"]) > 1 else 1

    # texts are taken out of the Arrow batch one by one, so a worker never holds them all as objects
    @F.arrow_udf(RESULT)
    def predict(texts: pa.Array) -> pa.Array:
        found: list = [({}, None)] * len(texts)
        totals, group = [0] * len(texts), {}

        def close():
            found_now = infer_all(list(group.values()), len(names), lambda: _each(sent))
            for i, one in zip(group, found_now):
                found[i] = one
            group.clear()

        for i, text in enumerate(texts):
            counts = trigram_counts(text.as_py()) if names else None
            if counts is None:
                continue
            totals[i], group[i] = counts.sum(), counts
            if len(group) == most:
                close()
        if group:
            close()
        best, scores, proportions, gains = [], [], [], []
        for total, (shares, likelihood) in zip(totals, found):
            top = min(shares, key=lambda k: (-shares[k], k)) if shares else None
            best.append("und" if top is None else names[top])
            scores.append(0.0 if top is None else float(min(1.0, shares[top])))
            proportions.append([(names[k], float(v)) for k, v in shares.items()])
            gains.append(None if top is None else float(likelihood / total + np.log(BUCKETS)))
        parts = [pa.array(best, pa.string()), pa.array(scores, pa.float64()), pa.array(proportions, pa.map_(pa.string(), pa.float64())), pa.array(gains, pa.float64())]
        return pa.StructArray.from_arrays(parts, ["lang_pred", "score", "proportions", "gain"])

    return predict


def identify(docs: DataFrame, model: dict, text: str = "text", into: str = "language") -> DataFrame:
    """docs and a struct column `into` (replaced, if there is one) with lang_pred, score, proportions and gain. The whole text is read."""
    return docs.withColumn(into, identifier(model)(F.col(text)))


def has_letter(text: Column) -> Column:
    """Whether the text has a letter, so that a language could be told."""
    return F.arrow_udf(lambda texts: pa.array([trigram_counts(t.as_py()) is not None for t in texts], pa.bool_()), "boolean")(text)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by folds (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0
