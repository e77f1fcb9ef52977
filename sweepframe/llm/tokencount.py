"""Token counts of whole texts under a byte-level BPE vocabulary, by merging arrays.

Nothing is encoded: pre-tokens are held as ragged numpy arrays of symbols, every
round applies to each sequence all merges of the pair that has its lowest rank,
and the symbols that survive are counted. A sequence is cut first where no
token of the vocabulary holds the two bytes that meet, since no merge can cross
there. What still is longer than LONG keeps its places by rank, so a round
touches only the places that merge.

The library normalises and splits (in pieces between white space, if the
vocabulary drops white space), and encodes pieces that hold an added token's
string. Counts of short pieces are remembered in each worker, within bounds of
their number and bytes.

Defined results: a null text counts as empty and has no bytes and no token;
a text of any length is counted whole, CHUNK bytes at a time; equal texts have
equal counts; an empty table gives an empty result; other columns stay, except
one that has the name of the new column.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from sweepframe.functions.worker import kept
from sweepframe.llm.words import word_lists

#: Symbols from which a sequence keeps its places by rank.
LONG = 256
#: Bytes of text that are cut into pieces at a time.
CHUNK = 4 << 20
#: Longest piece whose count is remembered, and bytes that the remembered pieces may take (with about ENTRY bytes for each).
PIECE, REMEMBERED, ENTRY = 64, 96 << 20, 120
#: Pieces that go to the library together.
TOGETHER = 1 << 15
_NONE = np.int64(1 << 40)
#: White space that bytes.split() leaves in a piece.
_OTHER_SPACE = re.compile("[^\\S ]|[\u180e\u200b\ufeff]")


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it is printable Latin-1, else the next unused one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Merges:
    """The merges of a byte-level BPE vocabulary as arrays: symbols 0 to 255 are bytes, 256 to 511 bytes at the end of a word, 512 + r what the merge of rank r makes."""

    def __init__(self, model: dict):
        letters, self.suffix = byte_letters(), model.get("end_of_word_suffix") or ""
        if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("not a plain BPE vocabulary")
        known = {c: b for b, c in enumerate(letters)} | ({c + self.suffix: 256 + b for b, c in enumerate(letters)} if self.suffix else {})
        if any(s not in model["vocab"] for s in known):
            raise ValueError("a byte has no token")
        n = len(model["merges"])
        left, right = np.empty(n, np.int64), np.empty(n, np.int64)
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            # a part that isn't known yet would be made by a later merge, and then a round could not take the lowest rank for good
            if a not in known or b not in known or a + b in known:
                raise ValueError("the merges don't make each token once, from earlier ones")
            left[r], right[r], known[a + b] = known[a], known[b], 512 + r
        self.width = 512 + n
        keys = left * self.width + right
        self.rank_of = np.argsort(keys)
        self.keys = keys[self.rank_of]
        # bytes that stand side by side within a token
        last, first = np.arange(self.width) % 256, np.arange(self.width) % 256
        for r in range(n):
            first[512 + r], last[512 + r] = first[left[r]], last[right[r]]
        self.joined = np.zeros((256, 256), bool)
        self.joined[last[left], first[right]] = True
        self.first = np.full((512, 512), _NONE)  # ranks of pairs of bytes, which most look-ups are for
        low = (left < 512) & (right < 512)
        self.first[left[low], right[low]] = np.flatnonzero(low)
        self.places = np.zeros(512, np.int64)
        self.places[[ord(c) for c in letters]] = np.arange(256)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(a), _NONE)
        wanted = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank_of[at], _NONE)

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token, given in byte letters and not empty."""
        out = np.zeros(len(words), np.int64)
        if not words:
            return out
        ids = self.places[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        cut = np.zeros(len(ids), bool)
        cut[0] = True
        cut[1:] = ~self.joined[ids[:-1], ids[1:]]
        cut[ends[:-1]] = True
        if self.suffix:
            ids[ends - 1] += 256
        starts = np.flatnonzero(cut)
        owner = np.searchsorted(ends, starts, "right")
        lengths = np.diff(np.append(starts, len(ids)))
        long = lengths > LONG
        for s, n, o in zip(starts[long], lengths[long], owner[long]):
            out[o] += self._by_rank(ids[s : s + n])
        np.add.at(out, owner[~long], self._by_sequence(ids[np.repeat(~long, lengths)], lengths[~long]))
        return out

    def _by_sequence(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Surviving symbols of each sequence; a round merges every sequence's pair of lowest rank."""
        out = lengths.copy()
        alive = np.flatnonzero(lengths > 1)
        ids, lengths = ids[np.repeat(lengths > 1, lengths)], lengths[alive]
        if not len(ids):
            return out
        rank = np.full(len(ids), _NONE)
        rank[:-1] = self.first[ids[:-1], ids[1:]]
        rank[np.cumsum(lengths) - 1] = _NONE
        while len(ids):
            starts = np.cumsum(lengths) - lengths
            best = np.minimum.reduceat(rank, starts)
            going = best < _NONE
            if not going.all():
                out[alive[~going]] = lengths[~going]
                kept_ = np.repeat(going, lengths)
                ids, rank, alive, lengths, best = ids[kept_], rank[kept_], alive[going], lengths[going], best[going]
                if not len(ids):
                    break
            of = np.repeat(np.arange(len(lengths)), lengths)
            at = _apart(np.flatnonzero(rank == best[of]))
            ids[at] = 512 + rank[at]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            last = np.cumsum(np.bincount(of[stays], minlength=len(lengths))) - 1
            place = np.cumsum(stays) - 1
            lengths = lengths - np.bincount(of[at], minlength=len(lengths))
            ids, rank = ids[stays], rank[stays]
            changed = np.concatenate([place[at], np.maximum(place[at] - 1, 0)])
            rank[changed] = self.ranks(ids[changed], ids[np.minimum(changed + 1, len(ids) - 1)])
            rank[last] = _NONE
        return out

    def _by_rank(self, ids: np.ndarray) -> int:
        """Surviving symbols of one long sequence; a round takes the places that have its lowest rank."""
        ids, n = ids.copy(), len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.append(self.ranks(ids[:-1], ids[1:]), _NONE)
        waiting: dict[int, list] = {}
        heap: list[int] = []
        left = n

        def wait(places):
            ranks = rank[places]
            places, ranks = places[ranks < _NONE], ranks[ranks < _NONE]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            edges = np.flatnonzero(np.diff(ranks, prepend=-1))
            for r, own in zip(ranks[edges].tolist(), np.split(places, edges[1:])):
                if r in waiting:
                    waiting[r].append(own)
                else:
                    waiting[r] = [own]
                    heapq.heappush(heap, r)

        wait(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            at = _apart(at, after)
            gone = after[at]
            ids[at], rank[gone], after[at] = 512 + r, _NONE, after[gone]
            inner = at[after[at] < n]
            before[after[inner]] = inner
            left -= len(at)
            changed = np.unique(np.concatenate([at, before[at]]))
            changed = changed[changed >= 0]
            beyond = after[changed] >= n
            rank[changed] = np.where(beyond, _NONE, self.ranks(ids[changed], ids[np.minimum(after[changed], n - 1)]))
            wait(changed)
        return left


def _apart(at: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """Of ascending places of one pair, those that merge: in a run of overlapping pairs every second one, from the left."""
    meets = at[1:] == (at[:-1] + 1 if after is None else after[at[:-1]])
    if not meets.any():
        return at
    k = np.arange(len(at))
    run = np.maximum.accumulate(np.where(np.append(True, ~meets), k, 0))
    return at[(k - run) % 2 == 0]


class Counter:
    """Token counts of texts given as bytes, as the tokenizer of a file counts them."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        told = json.loads(source)
        told["truncation"] = told["padding"] = None
        self.tokenizer = Tokenizer.from_str(json.dumps(told))
        self.merges = Merges(told["model"])
        if not _is_byte_level(told["pre_tokenizer"]):
            raise ValueError("not a byte-level vocabulary")
        added = [t["content"] for t in told["added_tokens"] or []]
        self.added = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        self.by_pieces = _drops_space(told) and not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in told["added_tokens"] or [])
        self.known: dict[bytes, int] = {}
        self.held = 0

    def _pieces(self, body: bytes):
        if not self.by_pieces:
            yield [body]
            return
        yield from word_lists(body, CHUNK)

    def _split(self, pieces: list[bytes]) -> tuple[list[str], list[np.ndarray]]:
        """Pre-tokens of all pieces, and the places of the pieces that they are of. Pieces go to the library together, parted by blanks, unless one of them has white space or gets some."""
        raw = b" ".join(pieces).decode("utf-8", "replace")
        text = self.tokenizer.normalizer.normalize_str(raw) if self.tokenizer.normalizer else raw
        if len(pieces) == 1:
            words = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text) if w]
            return words, [np.zeros(len(words), np.int64)]
        parts = text.split(" ")
        if len(parts) != len(pieces) or _OTHER_SPACE.search(raw):
            half = len(pieces) // 2
            (words, at), (more, more_at) = self._split(pieces[:half]), self._split(pieces[half:])
            return words + more, at + [x + half for x in more_at]
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        return [w for w, _ in found], [np.searchsorted(ends, np.fromiter((at for _, (at, _) in found), np.int64, len(found)), "right")]

    def _new(self, pieces: list[bytes]) -> dict[bytes, int]:
        """Counts of pieces that aren't remembered."""
        found = {}
        if self.added:
            for piece in pieces:
                if self.added.search(text := piece.decode("utf-8", "replace")):
                    found[piece] = len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        plain = [p for p in pieces if p not in found] if found else pieces
        together = TOGETHER if self.by_pieces else 1
        for at in range(0, len(plain), together):
            part = plain[at : at + together]
            words, owners = self._split(part)
            distinct = dict.fromkeys(words)
            of = dict(zip(distinct, self.merges.count(list(distinct)).tolist()))
            sums = np.bincount(np.concatenate(owners), np.fromiter(map(of.__getitem__, words), np.float64, len(words)), len(part))
            found.update(zip(part, sums.astype(np.int64).tolist()))
        for piece, n in found.items():
            if len(piece) <= PIECE:
                if self.held > REMEMBERED:
                    self.known, self.held = {}, 0
                self.known[piece] = n
                self.held += len(piece) + ENTRY
        return found

    def __call__(self, bodies: list[bytes | None]) -> list[int]:
        totals, missing, size = [0] * len(bodies), [], 0
        for i, body in enumerate(bodies):
            for pieces in self._pieces(body or b""):
                counts = list(map(self.known.get, pieces))
                if None in counts:
                    new = [p for p, n in zip(pieces, counts) if n is None]
                    missing.append((i, new))
                    size += sum(map(len, new))
                    totals[i] += sum(filter(None, counts))
                else:
                    totals[i] += sum(counts)
                if size > CHUNK:
                    self._settle(totals, missing)
                    missing, size = [], 0
        self._settle(totals, missing)
        return totals

    def _settle(self, totals: list[int], missing: list) -> None:
        found = self._new(list(dict.fromkeys(p for _, new in missing for p in new)))
        for i, new in missing:
            totals[i] += sum(map(found.__getitem__, new))


def _is_byte_level(pre: dict | None) -> bool:
    steps = (pre or {}).get("pretokenizers", [pre])
    return bool(steps[-1]) and steps[-1]["type"] == "ByteLevel" and all(s["type"] == "Split" for s in steps[:-1])


def _drops_space(told: dict) -> bool:
    """Whether texts can be cut at white space: words are matched by a pattern and all else is removed, and no step before joins what white space parts."""
    from tokenizers import Tokenizer

    steps = told["pre_tokenizer"].get("pretokenizers", [])
    before = told["normalizer"] or {"normalizers": []}
    plain = all(s["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in before.get("normalizers", [before]))
    if not plain or len(steps) != 2 or steps[0].get("behavior") != "Removed" or not steps[0].get("invert") or steps[1].get("add_prefix_space") or steps[1].get("use_regex"):
        return False
    tokenizer = Tokenizer.from_str(json.dumps(told))
    ids = lambda s: tokenizer.encode(s, add_special_tokens=False).ids
    return not ids(" ") and not ids(" \t\v\f\r\n ") and all(ids(f"{a} \n{b} ") == ids(a) + ids(b) for a in "a1.'" for b in "s1.'")


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, text: str = "text", into: str = "tokens") -> DataFrame:
    """docs with a struct column (n_bytes, n_tokens, over_limit): bytes of the UTF-8 text, tokens without special ones, and whether these are more than limit. The vocabulary file is read once and sent to the tasks."""
    import pyarrow as pa

    with open(tokenizer_path, encoding="utf-8") as file:
        source = file.read()
    Counter(source)  # a vocabulary that can't be counted is refused here
    sent, digest = docs.sparkSession.sparkContext.broadcast(source), f"{zlib.crc32(source.encode())} {len(source)}"
    found = StructType([StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])
    others = [c for c in docs.columns if c != into]
    rows = docs if into not in docs.columns or into == text else docs.drop(into)
    schema = StructType([docs.schema[c] for c in others] + [StructField(into, found)])

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = kept(f"counter {digest}", lambda: Counter(sent.value))
        for batch in batches:
            bodies = batch.column(text).cast(pa.large_binary()).to_pylist()
            n = counter(bodies)
            new = pa.StructArray.from_arrays([pa.array([len(b or b"") for b in bodies], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["n_bytes", "n_tokens", "over_limit"])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], new], [*others, into])

    return rows.mapInArrow(run, schema)
