"""Filter audit, hard negatives and token counts against brute force."""

import itertools
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sweepframe.llm import filteraudit, hardnegatives, queries, tokencount

SF = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- token counts


def odd_texts():
    rng = random.Random(4)
    kinds = [(32, 127), (160, 1000), (0x300, 0x370), (0x3000, 0x9000), (0x1F300, 0x1F600)]
    mixed = ["".join(chr(rng.choice([rng.randrange(*rng.choice(kinds)), 10, 13, 11, 0x85, 0xA0, 0x2028, 0x1C])) for _ in range(1500)) for _ in range(20)]
    unbroken = ["a" * 30_001, "これは日本語" * 4000, "".join(chr(rng.randrange(97, 123)) for _ in range(20_000)), "ab" * 5000 + "a"]
    marks = ["", " ", "x" * 70 + " " + "x" * 70, "it's 2nd 'll <|endoftext|> x<|STARTOFTEXT|>y<|startoftext|>", "İstanbul ΣΑΣ é ́   ́", "  a b c   d"]
    return mixed + unbroken + marks


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_counts_are_the_library_s(name, monkeypatch):
    path = public_tokenizers.path(name)
    counter, library = tokencount.Counter(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    texts = odd_texts()
    expected = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter([t.encode() for t in texts]) == expected
    assert counter([t.encode() for t in reversed(texts)]) == expected[::-1]  # remembered pieces
    monkeypatch.setattr(tokencount, "REMEMBERED", 500)
    monkeypatch.setattr(tokencount, "CHUNK", 1000)
    counter = tokencount.Counter(open(path, encoding="utf-8").read())
    assert counter([t.encode() for t in texts]) == expected and counter.held < 500 + tokencount.PIECE + 2 * tokencount.ENTRY


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcdeith", min_size=1, max_size=60), min_size=1, max_size=20))
def test_both_ways_of_merging_agree(words):
    global _merges
    _merges = globals().get("_merges") or tokencount.Counter(open(WORD_BPE, encoding="utf-8").read()).merges
    many = _merges.count(words)
    ids = [_merges.places[[ord(c) for c in w]] for w in words]
    for i in ids:
        i[-1] += 256
    assert many.tolist() == [_merges._by_rank(i) for i in ids]


def test_long_pieces_take_no_memory():
    counter = tokencount.Counter(open(WORD_BPE, encoding="utf-8").read())
    counter([("日本" * 50_000).encode()] * 3)
    assert counter.known == {} and counter.held == 0


def test_token_counts_of_odd_tables(spark):
    library = Tokenizer.from_file(WORD_BPE)
    texts = [None, "", "some words", "some words", "word " * 3000]
    docs = spark.createDataFrame([(i if i else None, t, None, -1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, tokens int")
    found = tokencount.token_counts(docs, WORD_BPE)
    assert found.columns == ["doc_id", "text", "n_tokens", "tokens"] and found.where("false").count() == 0
    got = [tuple(r.tokens) for r in found.collect()]
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert got == [(len(t or ""), k, k > 2048) for t, k in zip(texts, n)] and got[-1][2]
    assert tokencount.token_counts(docs.where("false"), WORD_BPE, into="more").count() == 0


def test_token_counts_query(spark):
    library = Tokenizer.from_file(WORD_BPE)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_token_counts(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)


def test_vocabularies_that_cant_be_counted(spark, tmp_path):
    source = open(WORD_BPE, encoding="utf-8").read()
    (tmp_path / "other.json").write_text(source.replace('"dropout":null', '"dropout":0.1').replace('"dropout": null', '"dropout": 0.1'))
    with pytest.raises(ValueError):
        tokencount.token_counts(spark.createDataFrame([("a",)], "text string"), str(tmp_path / "other.json"))


# ---------------------------------------------------------------- hard negatives


def mined(rows, every, positives=5, negatives=3, low=50, high=95):
    """rows: (id, label, vector); of each id the least."""
    best = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None:
            best[i] = min(best.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in best.items():
        if a % every:
            continue
        score = {i: max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(v, w)))) for i, (_, w) in best.items()}
        order = sorted(best, key=lambda i: (-score[i], i))
        for p in [i for i in order if best[i][0] == label and i != a][:positives]:
            hard = [i for i in order if best[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(hard[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("scale", [3, 1 << 20, 1 << 31, 1 << 50])
def test_hard_negatives_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(hardnegatives, "ROW_BLOCK", 40)
    monkeypatch.setattr(hardnegatives, "ANCHOR_BLOCK", 15)
    monkeypatch.setattr(hardnegatives, "HELD", 2000)
    rng = random.Random(scale)
    rows = [(i - 20, rng.randrange(3), [rng.randrange(-scale // 2, scale + 1) for _ in range(3)]) for i in range(150)]
    rows += rows[:20] + [(7, 0, [1]), (8, 1, []), (None, 1, [1, 2, 3]), (500, None, [1, 2, 3]), (501, 1, None), (600, 77, [scale, scale, scale])]
    frame = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], "id long, label int, v array<long>, i int, j int, best string")
    found = hardnegatives.mine(frame, F.col("id") % 5 == 0)
    assert sorted(map(tuple, found.collect())) == mined(rows, 5)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_of_equal_vectors_and_empty_tables(spark):
    rows = [(i, i % 2, [2, 1]) for i in range(30)] + [(100 + i, 1, [1, 2]) for i in range(10)]
    frame = spark.createDataFrame(rows, "id long, label int, v array<long>")
    assert sorted(map(tuple, hardnegatives.mine(frame, F.col("id") % 10 == 0).collect())) == mined(rows, 10)
    assert hardnegatives.mine(frame.where("false"), F.col("id") % 10 == 0).count() == 0
    assert hardnegatives.mine(frame, F.lit(False)).count() == 0


def test_usable_vectors(spark):
    odd = [[1.0], [], None, [None], [float("nan"), 1.0], [float("inf")], [-float("inf")], [1e300]]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i int, v array<double>")
    assert {r.i for r in frame.where(hardnegatives.usable(F.col("v"))).collect()} == {0, 1, 7}


def test_hard_negatives_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vectors = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256 * float(x))) for x in r.embedding]) for r in rows]
    expected = mined(vectors, 50)
    assert expected and sorted(map(tuple, queries.op12_hard_negatives(spark, SF).collect())) == expected


# ---------------------------------------------------------------- filter audit


def fails(docs):
    """(part, failures) of (doc_id, source, text)."""
    least = {}
    for i, _, t in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, source, text in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and i > least[text]]
        out.append((source or "", {f for f, yes in zip("ABCDE", tests) if yes}))
    return out


def audited(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    out = defaultdict(Counter)
    for (i, _, _), (part, failed) in zip(docs, fails(docs)):
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                c = out[part, order, step]
                c["redundant"] += gone and f in failed
                c["unique_fails"] += failed == {f}
                c["removed"] += not gone and f in failed
                c["good_lost"] += not gone and f in failed and i in good
                c["toxic_lost"] += not gone and f in failed and i in toxic
                gone = gone or f in failed
                c["kept"] += not gone
    whole = Counter()
    for (part, order, step), c in out.items():
        whole[part, order[step - 1]] += c["removed"]
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return sorted((*k, *[c[n] for n in names], whole[k[0], k[1][k[2] - 1]]) for k, c in out.items())


def corpus():
    rng = random.Random(9)
    many = " ".join(f"word{k}" for k in range(80))
    texts = [many, many + " x", "few words", None, "", "CAPS ARE LOUD " * 20, "a | b", "same " * 60, many + " #", many.upper()]
    docs = [(rng.choice([None, *range(60)]), rng.choice(["a", "b", "", None]), rng.choice(texts)) for _ in range(120)]
    return docs + docs[:15], [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 60, 2), *range(0, 60, 5), None]]


@pytest.mark.parametrize("few", [True, False])
def test_audit_takes_back_earlier_masks(spark, tmp_path, monkeypatch, few):
    """A file a batch, larger ids first, so that nearly every file brings smaller ids of known texts."""
    monkeypatch.setattr(filteraudit, "few_rows", lambda df: few)
    monkeypatch.setattr(filteraudit, "TEXTS", 2)
    monkeypatch.setattr(filteraudit, "MOST_BATCHES", 1 << 30)
    docs, labels = corpus()
    ordered = sorted(docs, key=lambda d: -1 if d[0] is None else d[0], reverse=True)
    for at in range(0, len(ordered), 23):
        part = spark.createDataFrame([(*d, 1, "m", 2) for d in ordered[at : at + 23]], "doc_id long, source string, text string, n int, digest string, mask int")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    frame = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, good int")
    found = filteraudit.audit(spark, str(tmp_path / "docs"), frame, batch_bytes=1)
    assert sorted(map(tuple, found.collect())) == audited(docs, labels)


class State:
    def __init__(self):
        self.exists, self.get = False, None

    def update(self, value):
        self.exists, self.get = True, value


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "y", "z"]), st.integers(-4, 9), st.sampled_from("ab"), st.booleans(), st.integers(1, 3)), max_size=25), st.integers(1, 6))
def test_retractions_end_at_the_right_counts(rows, step):
    """Any order of arrival, any batches."""
    import pandas as pd

    rows = [(d, i, p, ord(d) % 16, i % 2 == 0, toxic, n) for d, i, p, toxic, n in rows]
    names = ["digest", "doc_id", "part", "mask", "good", "toxic", "n"]
    state, sums = State(), Counter()
    for at in range(0, len(rows), step):
        for change in filteraudit.retracted((0,), iter([pd.DataFrame(rows[at : at + step], columns=names)]), state):
            for part, mask, good, toxic, n in change.itertuples(index=False):
                sums[part, mask, good, toxic] += n
    least = {}
    for d, i, *_ in rows:
        least[d] = min(least.get(d, i), i)
    expected = Counter()
    for d, i, part, mask, good, toxic, n in rows:
        expected[part, mask | 16 * (i > least[d]), good, toxic] += n
    assert {k: n for k, n in sums.items() if n} == dict(expected)


def test_masks_of_long_texts():
    words = [f"w{k % 9}" for k in range(900_000)]
    assert filteraudit.mask_of(" ".join(words).encode()) == 2
    assert filteraudit.mask_of(b"") == 1 and filteraudit.mask_of("ÄÖÜ ".encode() * 60) == 2
    assert filteraudit.mask_of(b"A" + b" b" * 10) & 4 == 0 and filteraudit.mask_of(b"A" + b" b" * 9) & 4


def test_shares_of_all_orders():
    for k in range(1, 6):
        assert Fraction(120, k).denominator == 1
    assert len(filteraudit.orders()) == 600 and len({o for o, *_ in filteraudit.orders()}) == 120


def test_audit_of_empty_tables_and_single_files(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    empty.write.parquet(str(tmp_path / "none"))
    assert filteraudit.audit(spark, str(tmp_path / "none"), labels).count() == 0
    docs, _ = corpus()
    spark.createDataFrame(docs, "doc_id long, source string, text string").coalesce(1).write.parquet(str(tmp_path / "one"))
    file = next((tmp_path / "one").glob("*.parquet"))
    assert sorted(map(tuple, filteraudit.audit(spark, str(file), labels).collect())) == audited(docs, [])


def test_many_labels_stay_out_of_the_driver(spark, tmp_path, monkeypatch):
    """Their join is a sorted one, however small the file of labels is; ids with many rows are spread."""
    monkeypatch.setattr(filteraudit, "few_rows", lambda df: False)
    monkeypatch.setattr(filteraudit, "REPEATS", 2)
    docs, labels = corpus()
    frame = spark.createDataFrame([(i, p or "", (t or "").encode()) for i, p, t in docs], "doc_id long, part string, text binary")
    known = spark.createDataFrame([(i, q == 1, t == 1) for i, q, t in labels[:30]], "doc_id long, good boolean, toxic boolean")
    plan = filteraudit.folded(frame, known, 4, frame.select("doc_id"))._jdf.queryExecution().executedPlan().toString()
    salted = [line for line in plan.splitlines() if "Join [" in line and "salt" in line]
    assert salted and all("SortMergeJoin" in line for line in salted)
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "docs"))
    found = filteraudit.audit(spark, str(tmp_path / "docs"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, found.collect())) == audited(docs, labels)
