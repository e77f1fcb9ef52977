"""SimHash, URL filters, GIF and line dedup against brute force; the stages of the pipeline."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from sweepframe.llm import gifmedia, linededup, queries, simhash, urlfilter
from sweepframe.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp int, root int, digest int, id int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0, 0, 0, 0) for i, t in texts], DOCS)


def roots_of(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# ---------------------------------------------------------------- components and SimHash


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, k) for k in range(301, 340)]
    rows = [*pairs, (5, 5), (7, None), *pairs[:9]]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    expected = roots_of(400, pairs)
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: expected[x] for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_thresholds_follow_the_generalised_pigeonhole():
    n, both = 100_000, np.full((64, 64), 25_000.0) + np.eye(64) * 25_000
    for tau in (0, 2, 7):
        for m in range(1, 9):
            parts = simhash.group_bits(n, both, m)
            assert sorted(b for p in parts for b in p) == list(range(64))
            if m <= tau + 1:
                _, t = simhash.allocate([simhash.costs(n, np.diag(both) / n, p, tau) for p in parts], tau)
                assert sum(x + 1 for x in t) == tau + 1 and min(t) >= -1


@pytest.mark.parametrize("tau", [0, 2, 5])
def test_links_against_brute_force(spark, tau):
    rng = random.Random(tau)
    prints = [0, (1 << 64) - 1]
    for _ in range(40):
        base = rng.getrandbits(64)
        prints.append(base)
        for _ in range(rng.randrange(6)):
            x = base
            for b in rng.sample(range(64), rng.randrange(1, tau + 4)):
                x ^= 1 << b
            prints.append(x)
    # a dense group: a chain of fingerprints, each near the one before
    for _ in range(80):
        prints.append(prints[-1] ^ (1 << rng.randrange(64)))
    prints = sorted({simhash._signed(x) for x in prints})
    rows = spark.createDataFrame([(x, x) for x in prints], "key long, fp long")
    got = {r.key: r.root for r in simhash.link(rows, tau).collect()}
    near = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if ((prints[i] ^ prints[j]) & ((1 << 64) - 1)).bit_count() <= tau]
    expected = roots_of(len(prints), near)
    assert len(got) == len(prints)
    groups = lambda f: {frozenset(k for k in prints if f(k) == f(x)) for x in prints}
    assert groups(got.get) == groups(lambda k: expected[prints.index(k)])


def test_near_duplicates(spark):
    body = " ".join(f"w{i}" for i in range(300))
    texts = [(7, body), (4, body.upper()), (5, body + " more"), (1, None), (2, ""), (3, " \n "), (8, "One"), (6, "one"), (None, body), (9, "a  b"), (9, "a b")]
    got = simhash.near_duplicates(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    fps = [plain_votes(t) for _, t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2]
    roots = roots_of(len(texts), pairs)
    least = {r: min(t[0] for t, x in zip(texts, roots) if x == r and t[0] is not None) for r in set(roots)}
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((t[0], f"{f:016x}", least[r]) for t, f, r in zip(texts, fps, roots))
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1} and simhash.simhash([]) == 0
    assert simhash.near_duplicates(frame(spark, []).where("false")).count() == 0


def plain_votes(text, size=3):
    """The fingerprint of a text by counting, apart from the operator's own functions."""
    lower = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    tokens = re.findall(r"[^\x20\x09-\x0D]+", lower)
    runs = [" ".join(tokens[i : i + size]) for i in range(max(1, len(tokens) - size + 1))] if tokens else []
    values = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(v >> bit & 1 for v in values) > len(values))


def test_fingerprints_of_long_texts_and_the_query(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice(["Alpha", "beta", "\u00c9t\u00e9", "x\u00a0y", f"n{rng.randrange(500)}"]) for _ in range(70_000))
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(frame(spark, [(1, long), (2, "A b"), (3, None)])).collect()}
    assert got == {1: f"{plain_votes(long):016x}", 2: f"{plain_votes('A b'):016x}", 3: "0" * 16}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_simhash_components(spark, SF).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{plain_votes(t):016x}" for i, t in texts.items()}


def shingle_set(t, n=5):
    return set(simhash.shingles(simhash.words(t), n))


def jaccard_groups(texts, at_least=0.8):
    sets = [shingle_set(t) for t in texts]
    alike = lambda a, b: (len(a & b) >= at_least * len(a | b))
    return roots_of(len(texts), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if alike(sets[i], sets[j])])


def test_prefix_pairs_find_all_similar_pairs_of_different_groups(spark):
    rng = random.Random(8)
    base = list(range(100))
    sets = [np.unique(rng.sample(base, 100 - rng.randrange(0, 25)) + [rng.randrange(1000, 10_000) for _ in range(rng.randrange(0, 12))]) for _ in range(60)]
    roots = [rng.choice([0, 0, 0, 1, k]) for k in range(60)]
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    rows = [(k, roots[k], len(x), simhash.sketch(x).tolist(), [int(v) for v in simhash.prefix(x, nothing, 0.8)]) for k, x in enumerate(sets)]
    texts = spark.createDataFrame(rows, "key long, root long, n int, sketch array<long>, t array<long>")
    starts = simhash.shared_starts(texts.select("key", "t")).join(texts.drop("t"), "key")
    got = {(r.a, r.b) for r in simhash.prefix_pairs(starts, 0.8).collect()}
    assert {(r.a, r.b) for r in simhash.star_pairs(starts, 0.8).collect()} <= got
    alike = {(i, j) for i, j in itertools.combinations(range(60), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert {(i, j) for i, j in alike if roots[i] != roots[j]} <= got and all(roots[i] != roots[j] for i, j in got)
    held = spark.createDataFrame([(k, [int(v) for v in x]) for k, x in enumerate(sets)], "key long, s array<long>")
    every = spark.createDataFrame(list(itertools.combinations(range(60), 2)), "a long, b long")
    assert {(r.a, r.b) for r in simhash.similar_of(every, held, 0.8).collect()} == alike


def test_keep_one(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(60, 300))]
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 12, 40):
            copy = list(base)
            for at in rng.sample(range(len(base)), min(edits, len(base))):
                copy[at] = word()
            texts.append(" ".join(copy))
    texts += ["", None, "  ", "short", "Short", "short\n"]
    kept = {r.doc_id for r in simhash.keep_one(frame(spark, list(enumerate(texts)))).select("doc_id").collect()}
    expected = set(jaccard_groups(texts))
    assert kept == expected
    twice = frame(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "other")])
    assert sorted((r.doc_id or 0) for r in simhash.keep_one(twice).collect()) == [0, 1]
    assert simhash.keep_one(twice.where("false")).count() == 0


def test_keep_one_beyond_the_bits(spark):
    """Similar texts count as one though their fingerprints are far apart: short texts and edits at the threshold."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    notice = [word() for _ in range(12)]
    texts = []
    for i in range(60):
        base = [word() for _ in range(20)] if i % 2 else [*notice, *[word() for _ in range(rng.randrange(10, 50))]]
        texts += [" ".join(base), " ".join([*base, word()])]
        texts.append(" ".join([*base[:-1], *[word() for _ in range(rng.randrange(1, 9))]]))
    fps = [simhash.simhash(set(simhash.words(t))) for t in texts]
    sets = [shingle_set(t) for t in texts]
    alike = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert any((fps[i] ^ fps[j]).bit_count() > 7 for i, j in alike)
    kept = {r.doc_id for r in simhash.keep_one(frame(spark, list(enumerate(texts)))).select("doc_id").collect()}
    assert kept == set(jaccard_groups(texts))


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    for _ in range(300):
        base = rng.choice(10_000, rng.integers(1, 60), replace=False)
        other = np.concatenate([base[: max(1, int(len(base) * rng.uniform(0.8, 1)))], rng.choice(np.arange(10_000, 20_000), rng.integers(0, 8), replace=False)])
        a, b = np.unique(base), np.unique(other)
        known = np.unique(rng.choice(10_000, 3_000))
        frequent = (known, rng.integers(2, 9, len(known)))
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert len(np.intersect1d(simhash.prefix(a, frequent, 0.8), simhash.prefix(b, frequent, 0.8)))


# ---------------------------------------------------------------- URL filters


def test_judge_against_brute_force(spark):
    rng = random.Random(2)
    hosts = ["a.example.org", "EXAMPLE.org", "org", "xorg", "b.c.com", "com", "spam-farm.example.com", "m.ads-track.example.net", "", "net", "notexample.org", "q.spam-farm.example.com:80"]
    paths = ["", "/", "/es/1", "/en/1", "/en/12", "/en/2", "/fr/x", "/de/", "/DE/"]
    tails = ["", "?q=/es/", "#/fr/", "?://x"]
    urls = [f"https://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(tails)}" for _ in range(300)] + [None, "", "no scheme", "://", "x://y://z/fr/"]
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")

    def expected(url):
        if not url or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
        fits = [(h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return host, path, *max(fits, key=lambda x: len(x[0]))
        return host, path, None, "block" if any(host == h or host.endswith("." + h) for h in queries.BLOCKED_HOSTS) else "allow"

    got = urlfilter.judge(rows, queries.RULES, queries.BLOCKED_HOSTS).select("page_id", "judged.*").collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {i: expected(u) for i, u in enumerate(urls)}
    again = urlfilter.judge(rows.withColumn("judged", F.lit(1)), queries.RULES, queries.BLOCKED_HOSTS)
    assert again.columns == ["page_id", "url", "host", "judged"]
    assert urlfilter.judge(rows.where("false"), queries.RULES, queries.BLOCKED_HOSTS).count() == 0
    assert urlfilter.judge(rows, [], []).where("judged.verdict != 'allow'").count() == 0


@pytest.mark.parametrize("rate, least, bits, levels", [(0.4, 0.4, 1 << 28, 40), (0.01, 1e-9, 512, 40), (0.5, 0.5, 128, 3)])
def test_cascade_is_exact(spark, monkeypatch, rate, least, bits, levels):
    """Also where levels are often wrong, split into pieces, or fewer than needed."""
    for name, value in (("FALSE_RATE", rate), ("LEAST_RATE", least), ("MAX_BITS", bits), ("MOST_LEVELS", levels)):
        monkeypatch.setattr(urlfilter, name, value)
    listed = spark.createDataFrame([(f"k{i}",) for i in range(0, 3000, 7)], "key string")
    every = spark.createDataFrame([(f"k{i}",) for i in range(3000)], "key string")
    cascade = urlfilter.Cascade(listed, every)
    assert rate < 0.1 or len(cascade.levels) > 2
    assert (cascade.levels[0].pieces > 1) == (bits < 1 << 28) and isinstance(cascade.levels[-1], urlfilter.Listed) == (levels == 3)
    got = every.withColumn("b", cascade.bits()).select("key", cascade.has(F.col("key"), F.col("b")).alias("in")).collect()
    assert {r.key for r in got if r["in"]} == {f"k{i}" for i in range(0, 3000, 7)}


# ---------------------------------------------------------------- GIF


def slow_lzw(stream, bits):
    """A decoder that reads one bit at a time."""
    clear, end, out = 1 << bits, (1 << bits) + 1, []
    value = [b >> i & 1 for b in stream for i in range(8)]
    at, width, table, before = 0, bits + 1, None, None
    while at + width <= len(value):
        code = sum(value[at + i] << i for i in range(width))
        at += width
        if code == clear:
            table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, None
            continue
        if code == end:
            break
        word = table[code] if code < len(table) else before + before[:1]
        out.append(word)
        if before is not None and len(table) < 4096:
            table.append(before + word[:1])
        before = word
        width = min(12, max(width, len(table).bit_length()))
    return b"".join(out)


@given(st.one_of(st.binary(min_size=1, max_size=300), st.lists(st.sampled_from(b"ab "), min_size=1, max_size=3000).map(bytes)))
@settings(deadline=None, max_examples=60)
def test_gif_keeps_any_bytes(data):
    data = gifmedia.padded(data)
    stream = gifmedia.pack_codes(gifmedia.lzw_codes(data))
    assert slow_lzw(stream, 8) == data == gifmedia.lzw_decode(stream, 8, len(data))
    assert b"".join(x[4].tobytes() for x in gifmedia.decode(gifmedia.encode(data))) == data


def test_gif_of_long_data():
    data = np.random.default_rng(0).integers(0, 256, 64 * 900, np.uint8).tobytes() + b"the same words again and again " * 64 * 40
    assert b"".join(x[4].tobytes() for x in gifmedia.decode(gifmedia.encode(data))) == data
    many = bytes(64 * (gifmedia.LINES + 5))
    shapes = [x[4].shape for x in gifmedia.decode(gifmedia.encode(many, delay=7))]
    assert shapes == [(gifmedia.LINES, 64), (5, 64)]


def test_damaged_images_give_the_frames_before_the_damage():
    rng = np.random.default_rng(2)
    data = gifmedia.padded(b"some text that repeats, some text that repeats " * 40)
    image = gifmedia.encode(data)
    many = small_gif([(1, None, 5, 0, 0, 2, 2, [1, 1, 2, 3], False)] * 4)
    for good in (image, many):
        frames = [x[4].tobytes() for x in gifmedia.decode(good)]
        for _ in range(400):
            bad = bytearray(good)
            for at in rng.integers(6, len(bad), rng.integers(1, 4)):
                bad[at] = rng.integers(0, 256)
            for _ in gifmedia.decode(bytes(bad[: rng.integers(6, len(bad) + 1)])):
                pass
        for cut in range(0, len(good), 7):
            found = [x[4].tobytes() for x in gifmedia.decode(good[:cut])]
            assert found == frames[: len(found)]


def test_a_full_table_without_a_clear_code():
    data = np.random.default_rng(1).integers(0, 3, 30_000, np.uint8).tobytes()
    codes, table, word = [4], {bytes([i]): i for i in range(4)}, b""
    for i in range(len(data)):
        if word + data[i : i + 1] in table:
            word += data[i : i + 1]
            continue
        codes.append(table[word])
        if len(table) + 2 < 4096:
            table[word + data[i : i + 1]] = len(table) + 2
        word = data[i : i + 1]
    codes += [table[word], 5]
    assert max(codes) > 4000 and len(codes) > 4300
    widths = [3, *gifmedia._width_run(2, len(codes) - 1).tolist()]
    value = sum(code << at for code, at in zip(codes, itertools.accumulate([0, *widths[:-1]])))
    stream = value.to_bytes(sum(widths) // 8 + 2, "little")
    assert slow_lzw(stream, 2) == data == gifmedia.lzw_decode(stream, 2, len(data))


def small_gif(frames):
    """2 x 2 screen, palette black, red, green, blue; frames: (disposal, clear index or None, delay, left, top, w, h, indices, interlaced)."""
    out = b"GIF89a" + bytes([2, 0, 2, 0, 0x91, 0, 0]) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    for disposal, clear, delay, left, top, w, h, indices, interlaced in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), delay, 0, clear or 0, 0])
        out += b"\x2c" + bytes([left, 0, top, 0, w, 0, h, 0, 0x40 if interlaced else 0, 2]) + gifmedia._blocks(gifmedia.pack_codes(gifmedia.lzw_codes(bytes(indices), 2), 2))
    return out + b"\x3b"


def test_disposal_transparency_and_time(spark):
    image = small_gif([(1, None, 5, 0, 0, 2, 2, [1, 1, 1, 1], False), (2, 0, 10, 0, 0, 2, 1, [2, 0], False), (3, None, 1, 1, 1, 1, 1, [3], False), (0, None, 0, 0, 0, 1, 2, [2, 3], True)])
    screens = [(start, delay, screen.copy()) for start, delay, _, _, _, screen in gifmedia.decode(image)]
    assert [s[:2] for s in screens] == [(0, 50), (50, 100), (150, 10), (160, 0)]
    red, green, blue, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    cells = [[tuple(int(v) for v in p) for p in s[2].reshape(-1, 4)] for s in screens]
    assert cells == [[red] * 4, [green, red, red, red], [none, none, red, blue], [green, none, blue, red]]
    rows = gifmedia.frames(spark.createDataFrame([(1, bytearray(image)), (2, None), (3, bytearray(b"not a gif")), (4, bytearray(image[:60]))], "k long, image binary"), "k", "image").collect()
    assert [r.frame for r in rows if r.key == 1] == [0, 1, 2, 3] and {r.key for r in rows} <= {1, 4}
    assert sum(rows[0].histogram) == 12 and rows[0].histogram[7] == 4


def test_payload_features(spark):
    texts = [(1, None), (2, ""), (3, "é" * 33), (4, "x" * 64), (5, "long text " * 30_000), (6, "x" * 64)]
    df = frame(spark, texts)
    images = df.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), gifmedia.stored(F.col("text")).alias("image"))
    got = {r.doc_id: r for r in gifmedia.payload_features(images).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        data = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert got[i].n_bytes == len(raw) and got[i].payload_bytes == len(data) and got[i].payload_sha256 == hashlib.sha256(data).hexdigest()
        assert sum(map(int, got[i].feature.split(","))) == len(data) and (got[i].n_frames, got[i].duration_ms) == (1, 0)
    assert tuple(got[4])[1:] == tuple(got[6])[1:]


# ---------------------------------------------------------------- line dedup


def windows_of(text):
    lines = text.split("\n") if text is not None else []
    return [(k, w) for k in range(len(lines) - 2) if "".join(w := tuple(lines[k : k + 3])).strip(" ")]


def brute_lines(docs):
    times = Counter(w for _, t in docs for _, w in windows_of(t))
    seen, gone, stays = set(), defaultdict(set), defaultdict(set)
    for i, t in sorted(docs, key=lambda d: d[0]):
        for k, w in windows_of(t):
            if times[w] > 1:
                (gone if w in seen else stays)[i] |= {k, k + 1, k + 2}
                seen.add(w)
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i] - stays[i]) for i, t in docs}


def test_line_dedup(spark):
    rng = random.Random(1)
    docs = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randrange(1, 25)))) for i in range(60)] + [(60, None), (61, ""), (62, "\n\n\n\n"), (63, "one\ntwo"), (64, "u\nv\nw\nu\nv\nw"), (65, "u\nv\nw")]
    got = linededup.dedup_lines(frame(spark, docs)).collect()
    assert {r.doc_id: r.text for r in got} == brute_lines(docs) and len(got) == len(docs)
    times = Counter(w for _, t in docs for _, w in windows_of(t))
    left = {w for r in got for _, w in windows_of(r.text)}
    assert all(w in left for w, n in times.items() if n > 1)
    overlap = linededup.dedup_lines(frame(spark, [(1, "x\nx\nx\nx"), (2, "x\nx\nx\ny\nz"), (3, "x\nx\ny")]).withColumn("line_dedup", F.lit(1))).orderBy("doc_id").collect()
    assert [r.text for r in overlap] == ["x\nx\nx", "x\nx\ny\nz", ""] and [r.line_dedup.n_removed for r in overlap] == [1, 1, 3]
    both = linededup.dedup_lines(frame(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc\nd")])).collect()
    assert Counter((r.doc_id, r.text) for r in both) == Counter([(1, ""), (1, ""), (None, "a\nb\nc\nd")])
    assert linededup.dedup_lines(frame(spark, docs).where("false")).count() == 0


# ---------------------------------------------------------------- the pipeline


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, "123 ... 45", "en", "src0", 10), (9002, None, None, None, None), (9003, "", "en", "src1", 0), (9004, "ZGVhZGJlZWY4f3a9 QmFzZTY0IGdpYmJlcmlzaA xK9qZ77bWvP0", None, "src1", 50), (9005, "\u3053\u308c\u306f\u65e5\u672c\u8a9e\u306e\u30c6\u30ad\u30b9\u30c8\u3067\u3059", None, "src1", 14)], docs.schema)
    docs = docs.unionByName(extra)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "best_fit"]
    step = spark.createDataFrame(stages["language_id"](spark, docs, SF).collect(), docs.schema)
    rows = docs.collect()
    assert {r.doc_id for r in step.collect()} == {r.doc_id for r in rows if r.text and any(c.isalpha() for c in r.text)} - {9004, 9005}

    before = [(r.doc_id, r.text) for r in step.collect()]
    step = spark.createDataFrame(stages["line_dedup"](spark, step, SF).collect(), docs.schema)
    expected = brute_lines(before)
    old = dict(before)
    assert {r.doc_id: r.text for r in step.collect()} == {i: t for i, t in expected.items() if t or t == old[i]}
    assert all(r.n_chars == len(r.text) for r in step.collect())

    before = sorted((r.doc_id, r.text) for r in step.collect())
    step = spark.createDataFrame(stages["near_dedup"](spark, step, SF).collect(), docs.schema)
    roots = jaccard_groups([t for _, t in before])
    assert {r.doc_id for r in step.collect()} == {before[r][0] for r in set(roots)}

    mixed = stages["mix_sources"](spark, step, SF)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(copies.values()) <= {1, 2}
    words = {r.doc_id: len(simhash.words(r.text)) for r in step.collect()}
    assert abs(sum(words[i] * n for i, n in copies.items()) / sum(words.values()) - 1.5) < 0.1

    packed = stages["best_fit"](spark, mixed, SF).collect()
    total = defaultdict(int)
    for r in packed:
        total[r.doc_id] += r.length
    assert total == {i: words[i] * n for i, n in copies.items()}


def test_language_id_without_labels(spark):
    rows = [(1, "some words", None, "s", 10), (2, "12 -- 34", None, "s", 8), (3, None, None, "s", 0), (4, "\u00e9", "", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.lang) for r in kept.collect()) == [(1, None), (4, "")]


def test_language_id_fills_missing_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = docs.where("n_chars > 300 and lang is not null").select("doc_id", "text", "lang").collect()
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 4 == 0, F.lit(None)).when(F.col("doc_id") % 4 == 1, F.lit("")).otherwise(F.col("lang")))
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, hidden, SF).collect()}
    unlabelled = [r for r in long if r.doc_id % 4 < 2]
    assert all(got.values()) and sum(got[r.doc_id] == r.lang for r in unlabelled) > 0.9 * len(unlabelled)
    assert all(got[r.doc_id] == r.lang for r in long if r.doc_id % 4 > 1)


def test_stages_on_odd_tables(spark):
    """Empty tables, nulls in every column, repeated rows, and other columns with the names that stages and operators use inside: they keep their values."""
    clashing = ["row", "copies", *[f"__{n}{k}" for n in ("row", "id", "of", "gone", "x", "lines", "plan", "size", "u", "taken", "again", "language") for k in ("", 0, 1)], "__LINES2", "key", "digest", "root", "fp"]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clashing)
    real = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").collect()
    more = lambda k: tuple(range(k, k + len(clashing)))
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, *more(10 * r.doc_id)) for r in real] + [(None,) * (5 + len(clashing))] * 3 + [(1, real[1].text, None, None, None, *more(10))] * 4
    odd = spark.createDataFrame(rows, kind)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, odd, SF)
        got = found.collect()
        assert got and stage(spark, odd.where("false"), SF).count() == 0
        if name != "best_fit":
            assert found.dtypes == odd.dtypes
            assert all(tuple(r)[5:] == (more(10 * r.doc_id) if r.doc_id is not None else (None,) * len(clashing)) for r in got)


def test_run_leaves_no_tables_of_its_stages(spark, tmp_path, monkeypatch):
    from sweepframe.functions import scratch

    monkeypatch.setattr(scratch, "shared_dir", lambda session: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, SF).count() > 100
    assert len(list(tmp_path.iterdir())) < 6
