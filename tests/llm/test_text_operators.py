"""Language ID, mixing, token blocks, chat formatting, packing and fingerprints against brute force."""

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sweepframe.llm import chatformat, langid, mixing, multisethash, packing, queries, tokenbin
from sweepframe.llm.words import word_count

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, copies int"


def frame(spark, texts, schema=DOCS):
    """Rows with extra columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if (i or 0) % 5 else None, len(t or ""), -1, -2) for i, t in texts], schema)


# ---------------------------------------------------------------- language ID


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, langid.learn(docs.where(~langid.held_out()))


def test_held_out_accuracy(spark, model):
    docs, learned = model
    rows = langid.identify(docs, learned).where(langid.held_out()).select("lang", "language.*").collect()
    assert len(rows) > 20
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixture_and_empty_texts(spark, model):
    docs, learned = model
    best = {r.lang: r.text for r in docs.where("length(text) > 3000").groupBy("lang").agg(F.max_by("text", "n_chars").alias("text")).collect()}
    half = best["fr"][:3000] + " " + best["de"][:1500]
    rows = langid.identify(frame(spark, [(0, half), (1, None), (2, ""), (3, "12 -- 34"), (4, half)]), learned, into="size").orderBy("doc_id").collect()
    mixed = rows[0]["size"]
    assert mixed.lang_pred == "fr" and set(mixed.proportions) == {"fr", "de"} and abs(mixed.proportions["de"] - 1 / 3) < 0.1
    assert [r["size"].lang_pred for r in rows[1:4]] == ["und"] * 3 and rows[1]["size"].score == 0
    assert rows[4]["size"] == mixed


def plain_em(counts, p, steps=langid.EM_STEPS):
    share = [1 / len(p)] * len(p)
    for _ in range(steps):
        new = [0.0] * len(p)
        for b, n in counts.items():
            whole = sum(s * float(row[b]) for s, row in zip(share, p))
            for k, row in enumerate(p):
                new[k] += n * share[k] * float(row[b]) / whole
        share = [x / sum(counts.values()) for x in new]
    return share, sum(n * np.log(sum(s * float(row[b]) for s, row in zip(share, p))) for b, n in counts.items())


def test_inference_against_all_language_sets(spark, model):
    docs, learned = model
    best = {r.lang: r.text for r in docs.where("length(text) > 2000").groupBy("lang").agg(F.max_by("text", "n_chars").alias("text")).collect()}
    texts = [best["en"][:400], best["fr"][:60], best["fr"][:700] + " " + best["de"][:500], best["es"][:900] + " " + best["en"][:100], "the house", best["de"][:300] + best["es"][:300] + best["fr"][:300]]
    p, names = np.concatenate([block.value for block in learned["blocks"]]), learned["names"]
    for text in texts:
        found = langid.trigram_counts(text)
        counts = {int(b): int(found[b]) for b in np.flatnonzero(found)}
        total = sum(counts.values())
        tried = []
        for size in (1, 2, 3):
            for group in itertools.combinations(range(len(names)), size):
                share, value = plain_em(counts, [p[k] for k in group]) if size > 1 else ([1.0], sum(n * np.log(float(p[group[0]][b])) for b, n in counts.items()))
                tried.append((value - langid.OVERLAP * (0.5 * np.log(total + 1) + np.log(len(names) + 1)) * (size - 1), dict(zip(group, share)), value))
        _, shares, value = max(tried, key=lambda x: x[0])
        got, likelihood = langid.infer(found, p)
        assert set(got) == set(shares) and all(abs(got[k] - shares[k]) < 1e-6 for k in got) and abs(likelihood - value) < 1e-3 * abs(value)


def test_gain_tells_languages_from_noise(spark, model):
    docs, learned = model
    noise = ["ZGVhZGJlZWY4f3a9 QmFzZTY0IGdpYmJlcmlzaA xK9qZ77bWvP0 aGVsbG8td29ybGQ", "これは日本語のテキストです。言語は学習されていません。", "Привет мир, это русский текст", "jkq wzx pfgh zzq vbnm qwx"]
    assert all(r.language.gain < 0 for r in langid.identify(frame(spark, list(enumerate(noise))), learned).collect())
    rows = langid.identify(docs.where("n_chars > 200"), learned).select("language.gain").collect()
    assert min(r.gain for r in rows) > 0


def test_every_label_is_learned_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    # 500 languages with letters of their own, some labels with one short text only
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 8))) for _ in range(30)] for _ in range(500)]
    text = lambda k, n: " ".join(rng.choice(words[k], n))
    rows = [(k, text(k, 40 if k % 3 else 15), f"l{k:03d}") for k in range(500)] + [(500, "12 34", "digits"), (501, None, "nothing"), (502, "words", None), (503, "words", "")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = frame(spark, [(k, text(k, 25)) for k in range(500)] + [(1000, text(3, 60) + " " + text(420, 50)), (1001, ""), (1002, None), (1003, text(499, 30) * 200)])
    found = {}
    for size, together in ((1000, 64), (100, 64), (60, 16)):
        monkeypatch.setattr(langid, "BLOCK", size)
        monkeypatch.setattr(langid, "TOGETHER", together)
        model = langid.learn(labelled)
        assert model["names"] == [f"l{k:03d}" for k in range(500)] and len(model["blocks"]) == -(-500 // size)
        assert all(block.value.shape[0] <= size for block in model["blocks"])
        found[size] = {r.doc_id: r.language for r in langid.identify(asked, model).collect()}
    assert found[100] == found[1000] and found[60] == found[1000]
    assert sum(found[100][k].lang_pred == f"l{k:03d}" for k in range(500)) >= 495 and found[100][1003].lang_pred == "l499"
    assert set(found[100][1000].proportions) == {"l003", "l420"}
    assert found[100][1001].lang_pred == found[100][1002].lang_pred == "und"


def test_no_labels(spark):
    empty = frame(spark, []).where("false")
    learned = langid.learn(empty)
    assert langid.identify(frame(spark, [(1, "words")]), learned).first().language.lang_pred == "und"
    assert langid.identify(empty, learned).count() == 0


# ---------------------------------------------------------------- mixing


def brute_mix(rows, weights=mixing.WEIGHTS, share=mixing.SHARE, most=mixing.MOST_COPIES):
    """rows: (row, id, source, size, u) -> words taken by row, targets and inclusion probabilities."""
    total, names = defaultdict(int), sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    for _, _, s, n, _ in rows:
        total[s] += n
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(total.values())
    while open_:
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) >= most * total[s]}
        if not over:
            for s in open_:
                target[s] = left * weight[s] / sum(weight[x] for x in open_)
            break
        for s in over:
            target[s] = most * total[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    taken, chance = {}, {}
    for s in names:
        copies = min(most, int(target[s] // total[s])) if total[s] else 0
        rest, mine = target[s] - copies * total[s], [r for r in rows if r[2] == s]
        taken |= {r[0]: copies * r[3] for r in mine}
        units = sorted((r for r in mine if r[3] > 0), key=lambda r: -r[3]) if rest > 0 else []
        while units:  # the longest documents are certain while their probability would be 1 or more
            c = rest / sum(r[3] ** 1.5 for r in units)
            if c * units[0][3] ** 0.5 < 1 - 1e-12:
                break
            longest = units[0][3]
            for r in [r for r in units if r[3] == longest]:
                taken[r[0]] += r[3]
                chance[r[0]] = 1.0
                rest -= r[3]
            units = [r for r in units if r[3] < longest]
        lumps = defaultdict(list)
        for r in units:
            p = chance[r[0]] = c * r[3] ** 0.5
            lumps[(r[4] / (1 - r[4]) / (p / (1 - p)), r[1] is not None, r[1] or 0, r[3])].append(r)
        for _, lump in sorted(lumps.items()):
            words = sum(r[3] for r in lump)
            if words <= rest:
                rest -= words
                for r in lump:
                    taken[r[0]] += r[3]
    return taken, target, chance


def mix_rows(docs, planned, seed="mix"):
    rows = mixing.take(docs, planned, into="x", seed=seed).select("doc_id", "source", "text", "x.*", mixing.uniform(F.col("doc_id"), F.col("text"), seed).alias("u")).collect()
    return [(k, r.doc_id, r.source, r["size"], r.u) for k, r in enumerate(rows)], rows


def test_mix_against_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(["w"] * int(rng.integers(0, 60))) if i % 11 else None) for i in range(400)] + [(7, "x y z"), (7, "x y z"), (7, "x y"), *[(None, "a " * k) for k in (5, 5, 9)]]
    docs = frame(spark, texts)
    slim, rows = mix_rows(docs, mixing.plan(docs))
    taken, target, _ = brute_mix(slim)
    assert {k: r["size"] * r.copies for k, r in enumerate(rows)} == taken
    for s, t in target.items():
        mine = [r for r in rows if r.source == s]
        assert all(abs(r.target - t) < 1e-6 for r in mine)
        off = t - sum(r["size"] * r.copies for r in mine)
        not_taken = [r["size"] for r in mine if r["size"] and r.copies < max(x.copies for x in mine)]
        assert 0 <= off and off < min(not_taken, default=1)
    assert all(0 <= r.copies <= 2 for r in rows)
    key = lambda r: (r.doc_id, r.text, r.copies)
    again = mixing.take(docs.repartition(7), mixing.plan(docs.repartition(5)), into="copies").select("doc_id", "text", "copies.copies").collect()
    assert sorted(map(str, map(key, again))) == sorted(map(str, map(key, rows)))
    whole = mixing.mixed(docs, mixing.plan(docs))
    assert whole.columns == docs.columns and whole.count() == sum(r.copies for r in rows)


def test_inclusion_follows_the_probabilities(spark):
    """Over many seeds, every document is in the sample about as often as its probability says."""
    sizes = [1 + i * 7 % 40 for i in range(1500)] + [400]
    docs = frame(spark, [(i, " ".join([f"w{i}"] * n)) for i, n in enumerate(sizes)] + [(9999, "w " * 120)]).withColumn("source", F.when(F.col("doc_id") == 9999, F.lit("b")).otherwise(F.lit("a")))
    slim, rows = mix_rows(docs, mixing.plan(docs, weights=(1.0, 4.0), share=0.6))
    _, target, chance = brute_mix(slim, weights=(1.0, 4.0), share=0.6)
    mine = [k for k, r in enumerate(rows) if r.source == "a"]
    last = next(k for k, r in enumerate(rows) if r["size"] == 400)
    assert 0.2 < target["a"] / sum(sizes) < 1 and chance[last] == 1.0
    times, rng = np.zeros(len(rows)), np.random.default_rng(0)
    for _ in range(1000):
        taken, _, _ = brute_mix([(*r[:4], rng.uniform()) for r in slim], weights=(1.0, 4.0), share=0.6)
        times += [taken[k] > 0 for k in range(len(rows))]
    assert max(abs(times[k] / 1000 - chance[k]) for k in mine) < 0.08 and times[last] == 1000


def test_rows_that_repeat_id_and_text_are_taken_together(spark):
    docs = frame(spark, [(i, f"t{i} " * 20) for i in range(61)] + [(None, "same " * 20)] * 29).withColumn("source", F.lit("one"))
    slim, rows = mix_rows(docs, mixing.plan(docs))
    taken, target, _ = brute_mix(slim)
    assert {k: r["size"] * r.copies for k, r in enumerate(rows)} == taken and target == {"one": 2700.0}
    assert len({r.copies for r in rows if r.doc_id is None}) == 1 and sum(taken.values()) == 2700


def test_mix_of_nothing(spark):
    empty = frame(spark, []).where("false")
    assert mixing.mixed(empty, mixing.plan(empty)).count() == 0
    blank = frame(spark, [(1, None), (2, ""), (2, "")])
    assert all(r.x.copies == 0 or r.x["size"] == 0 for r in mixing.take(blank, mixing.plan(blank), into="x").collect())


# ---------------------------------------------------------------- token blocks


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=400))
@settings(deadline=None, max_examples=80)
def test_elias_fano(steps):
    values = np.cumsum(steps)
    coded = tokenbin.ef_encode(values)
    at = np.arange(len(values))[::-1]
    assert (tokenbin.ef_select(*coded, at) == values[at]).all()
    assert sum(map(len, coded[1:3])) * 8 <= len(values) * (2 + max(0, np.log2(max(1, values[-1] / len(values)))) + 1) + 16


def test_token_blocks(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenbin, "BLOCK_TOKENS", 50)
    path = public_tokenizers.path("word_bpe_49k.json")
    known = Tokenizer.from_file(path)
    texts = ["The cat, don't sit. 12 été İstanbul Áb", None, "", "x\x1cy \x1f z w", "<|endoftext|> a<|startoftext|>b", "Word's. ?!,. (ok) 你好 " * 40, "ALL caps; done!", "ΣΣ 가."]
    docs = frame(spark, [(i * 3 - 4, t) for i, t in enumerate(texts)] + [(None, "none")])
    got = tokenbin.read(spark, tokenbin.write(docs, path, 1)).collect()
    start = 0
    expected = []
    for i, t in [(None, "none"), *[(i * 3 - 4, t) for i, t in enumerate(texts)]]:
        ids = [*known.encode(t or "", add_special_tokens=False).ids, 1]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    assert tokenbin.read(spark, tokenbin.write(docs.where("false"), path, 1)).count() == 0


def test_tokens_of_given_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    known = Tokenizer.from_file(path)
    coder = tokenbin.WordCoder(Tokenizer.from_file(path), "<u2")
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect():
        assert np.frombuffer(coder(r.text), "<u2").tolist() == known.encode(r.text, add_special_tokens=False).ids


# ---------------------------------------------------------------- chat


@given(st.text(alphabet="#\\ab: </turn>\n", max_size=40), st.sampled_from(["user", "", "a: b", "###", "x\\c:", "</turn>"]))
@settings(deadline=None, max_examples=300)
def test_round_trip(text, role):
    assert chatformat.parse(chatformat.render(role, text)) == [(role, text)]


def test_conversations(spark):
    turns = [(1, 1, "assistant", "b ### </turn> \\###"), (1, 0, "user", "a"), (2, 0, None, None), (1, 2, "assistant", "\\"), (2, 0, "assistant", ""), (None, 5, "assistant", "z"), (1, 0, "user", "a")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, rendered string")
    formatted = chatformat.format_turns(df)
    got = {r.conv_id: r for r in chatformat.read_back(formatted).collect()}
    for c in (1, 2, None):
        mine = sorted(((t or 0, r or "", x or "") for k, t, r, x in turns if k == c))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[c].n_turns == len(mine)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(chatformat.render(r, x)) for _, r, x in mine)
    assert chatformat.read_back(chatformat.format_turns(df.where("false"))).count() == 0


# ---------------------------------------------------------------- packing


@given(st.lists(st.integers(1, 4096), min_size=1, max_size=200))
@settings(deadline=None, max_examples=60)
def test_pack(sizes):
    sizes = np.array(sizes)
    bins, offsets, ends = packing.pack_jointly(sizes)
    for b, end in enumerate(ends):
        mine = np.flatnonzero(bins == b)
        order = mine[np.argsort(offsets[mine])]
        assert offsets[order].tolist() == [0, *np.cumsum(sizes[order])[:-1]]
        assert sizes[mine].sum() <= end and end == min(x for x in packing.LENGTHS if x >= sizes[mine].sum())
    alone = sum(packing.cost(min(x for x in packing.LENGTHS if x >= s)) for s in sizes)
    assert sum(map(packing.cost, ends)) <= alone


def plain_pack(sizes, lengths=packing.LENGTHS, cost=packing.cost):
    """Best fit by looking at every open bin: the cheapest over all shortest lengths, as the lists of sizes in the bins."""
    best = None
    for shortest in lengths:
        bins, left, time = [], sum(sizes), 0
        for size in sorted(sizes, reverse=True):
            time += 1
            fitting = [b for b in bins if b["room"] >= size]
            if fitting:
                b = min(fitting, key=lambda b: (b["room"], -b["time"]))
            else:
                room = min((x for x in lengths if x >= max(size, shortest)), key=lambda x: (cost(x) / min(x, left), x))
                bins.append(b := {"room": room, "held": []})
            b["room"] -= size
            b["time"] = time
            b["held"].append(size)
            left -= size
        total = sum(cost(min(x for x in lengths if x >= sum(b["held"]))) for b in bins)
        if best is None or total < best[0]:
            best = total, [b["held"] for b in bins]
    return best


def least_cost(sizes):
    """The cost of the best of all packings."""
    sums = [sum(n for i, n in enumerate(sizes) if m >> i & 1) for m in range(1 << len(sizes))]
    price = [packing.cost(min(x for x in packing.LENGTHS if x >= s)) if 0 < s <= 4096 else float("inf") for s in sums]
    best = [0.0] * len(sums)
    for m in range(1, len(sums)):
        low, part, best[m] = m & -m, m, float("inf")
        while part:
            if part & low:
                best[m] = min(best[m], price[part] + best[m ^ part])
            part = (part - 1) & m
    return best[-1]


def test_pack_against_all_packings():
    rng = np.random.default_rng(5)
    ratios = []
    for _ in range(60):
        sizes = [int(x) for x in np.minimum(4096, rng.lognormal(6, 1.2, rng.integers(1, 9)) + 1)]
        bins, _, ends = packing.pack_jointly(np.array(sizes))
        total, held = plain_pack(sizes)
        assert sum(map(packing.cost, ends)) == pytest.approx(total)
        assert sorted(sorted(sizes[i] for i in np.flatnonzero(bins == b)) for b in range(len(ends))) == sorted(map(sorted, held))
        ratios.append(total / least_cost(sizes))
    assert min(ratios) >= 1 - 1e-9 and max(ratios) < 1.35 and np.mean(ratios) < 1.06


def test_pack_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 3)
    big = (1 << 60) + 1
    docs = frame(spark, [(1, "a " * 9000), (2, None), (3, ""), *[(4, "b " * 10)] * 8, (None, "c"), (None, "c"), (big, "d d")])
    rows = packing.pack_documents(docs, word_count(F.col("text")), shard=3).collect()
    by = defaultdict(int)
    for r in rows:
        by[r.doc_id] += r.length
        assert (r.bin_id is None) == (r.length == 0)
    assert by == {1: 9000, 2: 0, 3: 0, 4: 80, None: 2, big: 2}
    assert sorted(r.copy for r in rows if r.doc_id == 4) == list(range(8)) and sorted((r.piece, r.start) for r in rows if r.doc_id == 1) == [(0, 0), (1, 4096), (2, 8192)]
    for b in {r.bin_id for r in rows if r.length}:
        spans = sorted((r.bin_start, r.bin_start + r.length) for r in rows if r.bin_id == b)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] <= next(r.bin_length for r in rows if r.bin_id == b)
    again = packing.pack_documents(docs.repartition(7), word_count(F.col("text")), shard=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert packing.pack_documents(docs.where("false"), word_count(F.col("text"))).count() == 0


def test_whole_query_against_plain_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [n - k * 4096 if n - k * 4096 < 4096 else 4096 for (n,) in docs.select(word_count(F.col("text"))).collect() for k in range(max(1, -(-n // 4096)))]
    total, held = plain_pack([n for n in sizes if n])
    bins = defaultdict(list)
    for r in queries.op9_best_fit(spark, SF).collect():
        bins[r.bin_id, r.bin_length].append(r.length)
    assert sorted(map(sorted, bins.values())) == sorted(map(sorted, held))
    assert sum(packing.cost(end) for _, end in bins) == pytest.approx(total)


def test_coder_remembers_no_long_pieces_and_asks_the_library(monkeypatch):
    from tokenizers import Tokenizer, normalizers

    path = public_tokenizers.path("word_bpe_49k.json")
    coder = tokenbin.WordCoder(Tokenizer.from_file(path), "<u2")
    assert coder.plain
    rng = np.random.default_rng(3)
    unbroken = ["".join(chr(c) for c in rng.integers(0x3041, 0x3097, 20_000)) for _ in range(3)] + ["a" * 50_000 + "."]
    library = Tokenizer.from_file(path)
    ids = lambda tokenizer, t: np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes()
    assert [coder(t) for t in unbroken] == [ids(library, t) for t in unbroken] and coder.held < 1000
    monkeypatch.setattr(tokenbin, "REMEMBERED", 2000)
    texts = [f"some Words{i} here, and there. E\u0301t\u00c9 w{i}x" for i in range(50)]
    assert [coder(t) for t in texts] == [ids(library, t) for t in texts] and coder.held < 4000
    cased = Tokenizer.from_file(path)
    cased.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(r" ", " ")])
    other = tokenbin.WordCoder(cased, "<u2")
    assert not other.plain and [other(t) for t in texts] == [ids(cased, t) for t in texts] and other(texts[0]) != ids(library, texts[0])


# ---------------------------------------------------------------- multiset hash


def fps(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    return [r.f for r in rows.select("i", multisethash.fingerprint(F.col("text")).alias("f")).orderBy("i").collect()]


def brute_fp(text):
    units = []
    for paragraph in (text or "").replace(". ", ".\n").split("\n"):
        lines = [paragraph]
        if len(paragraph) > 120:
            lines, words = [""], paragraph.split(" ")
            for i, w in enumerate(words):
                lines[-1] += w
                if not w or (ord(w[0]) * 7 + ord(w[-1]) * 3 + len(w)) % 8 == 0:
                    lines.append("")
                lines[-1] += " " if i + 1 < len(words) else ""
        for line in lines:
            while line:
                end = min(120, len(line))
                while end < min(160, len(line)) and line[end] != " ":
                    end += 1
                end += line[end : end + 1] == " "
                units, line = [*units, line[:end]], line[end:]
    out = [len(units), 0, 0] + [0] * (2 * multisethash.STEPS)
    for u in units:
        d = hashlib.md5(u.encode()).hexdigest()
        for h, at in ((0, 0), (1, 15)):
            v = int(d[at : at + 15], 16)
            out[1 + h] = (out[1 + h] + v) % (1 << 60)
            for k in range(multisethash.STEPS):
                out[3 + h * multisethash.STEPS + k] += (v >> k) & multisethash.SPREAD
    return out


def test_fingerprints(spark):
    a, b, both, turned, none, empty = fps(spark, ["one\ntwo. three", "four\ntwo", "four\ntwo\none\ntwo. three", " three"[1:] + "\ntwo.\none", None, ""])
    assert a == brute_fp("one\ntwo. three") and a == turned and none == empty == [0] * 39 and both == brute_fp("four\ntwo\none\ntwo. three")
    row = spark.createDataFrame([(a, b, both)], "a array<bigint>, b array<bigint>, c array<bigint>")
    got = row.select(multisethash.insert(F.col("a"), F.col("b")).alias("i"), multisethash.delete(F.col("c"), F.col("b")).alias("d")).first()
    assert got.i == both and got.d == a


def test_long_paragraphs_are_cut(spark):
    """Runs of words, texts without blanks, blanks in a row, and characters beyond 16 bits."""
    texts = [" ".join("abcdefghijklmnopqrstuvwxyzabcdefghijk"), "一" * 500, "a  b c   d e f g", "\U0001f600" * 330 + " x y z " * 30, "y" * 100_000, "w " * 5 + "\n" + "w " * 3, "\t\r\n x", "z" * 70 + " a b c d" * 9]
    found = fps(spark, texts)
    assert found == [brute_fp(t) for t in texts] and found[0][0] == 1 and found[1][0] == 4
    # a paragraph on a line of its own comes in and goes as a whole
    one, two, both = fps(spark, ["p q r s t u", "v w x y z", "p q r s t u\nv w x y z"])
    row = spark.createDataFrame([(one, two)], "a array<bigint>, b array<bigint>")
    assert row.select(multisethash.insert(F.col("a"), F.col("b")).alias("i")).first().i == both


def test_one_paragraph_is_like_its_edit(spark):
    """Three quarters of one long paragraph stay, the rest is new."""
    words = [f"w{i * i}" for i in range(400)]
    a, b, c = fps(spark, [" ".join(words), " ".join(words[:300] + [f"n{i * i}" for i in range(100)]), " ".join(f"n{i}" for i in range(400))])
    near, far = spark.createDataFrame([(a, b), (a, c)], "a array<bigint>, b array<bigint>").select(multisethash.likeness(F.col("a"), F.col("b")).alias("x")).collect()
    assert 0.5 < near.x < 0.95 and far.x < 0.35


def test_a_word_in_front_changes_one_part(spark):
    """One long paragraph, with a word put in front, in the middle, and taken away."""
    words = [f"{chr(97 + i * i % 26)}w{i * i}{chr(97 + i * 7 % 26)}" for i in range(400)]
    texts = [" ".join(x) for x in (words, ["new", *words], words[:200] + ["new"] + words[200:], words[1:], words[::-1])]
    a, *others = fps(spark, texts)
    near = [r.x for r in spark.createDataFrame([(a, b) for b in others], "a array<bigint>, b array<bigint>").select(multisethash.likeness(F.col("a"), F.col("b")).alias("x")).collect()]
    assert min(near[:3]) >= 0.8 and near[3] < 0.5
    assert fps(spark, ["x " * 100, "x " * 100 + " "])[0] != fps(spark, ["x " * 100 + " "])[0]


def test_next_of_ids_that_fill_ranges(spark, monkeypatch):
    """Null ids and one other id on a third of the rows each are ordered by text, in ranges of their own."""
    monkeypatch.setattr(multisethash, "RANGE_ROWS", 5)
    rows = [(None, f"null {i}") for i in range(60)] + [(7, f"seven {i}") for i in range(60)] + [(i, f"one {i}") for i in range(20, 80)] + [(7, "seven 1")] * 9
    found = multisethash.with_next(frame(spark, rows))
    got = Counter((r.doc_id, r.text, r.next_text) for r in found.collect())
    hashed = {r.text: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    assert got == Counter((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))


def test_next_and_edit(spark):
    texts = [(9, "nine nine"), (None, "null id"), (3, "three\n" * 40), (5, None), (3, "also three"), (12, "last. " * 9)]
    rows = multisethash.with_next(frame(spark, texts))
    rows = rows.withColumn("edited", multisethash.edited(F.col("text"), F.col("next_text"))).collect()
    order = sorted({r.doc_id for r in rows}, key=lambda i: (i is not None, i or 0))
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        n = len(r.text) // 4
        assert r.edited == r.text[: len(r.text) - n] + r.next_text[:n]
        assert r.next_fp == brute_fp(r.next_text)
    assert {r.next_text for r in by[order[-1]]} == {"null id"} and {r.next_text for r in by[9]} == {"last. " * 9} and len(rows) == 6
    assert multisethash.with_next(frame(spark, [(1, "alone")])).first().next_text == "alone"
    assert multisethash.with_next(frame(spark, []).where("false")).count() == 0


def test_next_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(multisethash, "RANGE_ROWS", 3)
    ids = [i * i % 1009 for i in range(1, 400)]
    ids = sorted(set(ids))
    rows = multisethash.with_next(frame(spark, [(i, f"t{i}") for i in ids])).collect()
    follow = dict(zip(ids, [*ids[1:], ids[0]]))
    assert {r.doc_id: r.next_text for r in rows} == {i: f"t{n}" for i, n in follow.items()}


def test_likeness_grows_with_what_is_shared(spark):
    lines = [f"line number {i} of this text" for i in range(200)]
    texts = ["\n".join(lines), "\n".join(lines[:150] + [f"other {i}" for i in range(50)]), "\n".join(f"none {i}" for i in range(200)), ""]
    f = fps(spark, texts)
    pairs = spark.createDataFrame([(f[0], x) for x in f], "a array<bigint>, b array<bigint>")
    same, most, none, empty = [r[0] for r in pairs.select(multisethash.likeness(F.col("a"), F.col("b"))).collect()]
    assert same == 1.0 and 0.5 < most < 0.95 and none < 0.35 and empty == 0.0
