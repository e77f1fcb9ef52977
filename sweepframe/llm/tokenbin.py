"""Token ids as binary blocks with Elias-Fano encoded document boundaries.

File format: a Parquet table of blocks in document order. A block holds whole
documents (about BLOCK_TOKENS ids) and has
  part, seq      place of the block; blocks are ordered by (part, seq)
  n_docs, n_tokens
  doc_ids        ids of the documents in order
  width          bytes of one id: 2 if the vocabulary has at most 65,536 ids, else 4
  ids            the concatenated ids, little-endian
  low_bits, low, high, hints
                 the n_docs + 1 boundaries within the block, from 0 to n_tokens, in
                 Elias-Fano form: low_bits low bits of each boundary in `low`, a
                 unary code of the rest in `high`, and in `hints` the place of every
                 64th one bit of `high`, from which select finds the others
No 64-bit table of offsets is stored: n documents over u ids take about
n (2 + log2(u / n)) bits. Parquet on the shared store lets any task write its
blocks and lets a lost task be run again.

Defined results: a null or empty text has the end id alone; null doc_ids come
first; rows that repeat an id stand next to each other, ordered by a hash of
the text; a very long text makes one long block; an empty table has no blocks.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sweepframe.functions.scratch import join_small, new_path
from sweepframe.functions.worker import kept

BLOCK_TOKENS = 1 << 20
#: Longest piece whose ids a task remembers, and bytes that the remembered ones may take (with about ENTRY bytes for each).
PIECE, REMEMBERED, ENTRY = 64, 160 << 20, 150
_HINT = 64

BLOCKS = (
    "part int, seq int, n_docs int, n_tokens long, doc_ids array<bigint>, width int, ids binary, "
    "low_bits int, low binary, high binary, hints binary"
)


def ef_encode(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """low_bits, low, high and hints of an ascending sequence that starts at 0 or more."""
    values = np.asarray(values, np.int64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    low_bits = max(0, (top // max(1, n)).bit_length() - 1)
    low = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
    ones = (values >> low_bits) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    return low_bits, np.packbits(low.reshape(-1), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::_HINT].astype("<u4").tobytes()


def ef_select(low_bits: int, low: bytes, high: bytes, hints: bytes, at) -> np.ndarray:
    """The values at the given places."""
    at = np.asarray(at, np.int64)
    starts = np.frombuffer(hints, "<u4").astype(np.int64)
    bits = np.frombuffer(high, np.uint8)
    out = np.empty(len(at), np.int64)
    groups = at // _HINT
    for g in np.unique(groups):
        first = starts[g]
        last = starts[g + 1] if g + 1 < len(starts) else len(bits) * 8
        window = np.unpackbits(bits[first // 8 : -(-last // 8)], bitorder="little")
        ones = np.flatnonzero(window[first % 8 :])  # the first of them is number g * _HINT
        mine = groups == g
        out[mine] = first + ones[at[mine] - g * _HINT] - at[mine]
    if low_bits:
        spots = at[:, None] * low_bits + np.arange(low_bits)
        lows = (np.frombuffer(low, np.uint8)[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1
        out = (out << low_bits) | (lows.astype(np.int64) << np.arange(low_bits)).sum(axis=1)
    return out


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it is printable Latin-1, else the next unused one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordCoder:
    """Ids of whole texts through a tokenizer that drops white space and never merges across it.

    The distinct pieces between blanks are encoded by the tokenizers library and
    remembered, as words repeat far more often than the library can encode them.
    """

    def __init__(self, tokenizer, dtype: str):
        self.tokenizer, self.model, self.known, self.held = tokenizer, tokenizer.model, {}, 0
        self.kind = {"<u2": "H", "<u4": "I"}[dtype]
        self.letters = _byte_letters()
        self.plain = self._is_plain()

    def _is_plain(self) -> bool:
        """Whether words of Latin letters can be asked of the model directly: texts are composed and lower-cased, split by a pattern that parts letters from punctuation, and written in byte letters."""
        told = json.loads(self.tokenizer.to_str())
        before, steps = told["normalizer"] or {}, (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        kinds = [s["type"] for s in before.get("normalizers", [before]) if s.get("type") != "Replace"]
        if kinds != ["NFC", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            return False
        self.plain, words = True, ["Word", "h\u00c9las", "stra\u00dfe", "end.", "So...", "Ah!?", "a,b", "x;"]
        found = [self._piece(w) == self._encode(w) for w in words]
        self.known, self.held = {}, 0
        return all(found)

    def _keep(self, piece: str, ids: bytes) -> bytes:
        if len(piece) <= PIECE and piece not in self.known:
            self.known[piece] = ids
            self.held += 2 * len(piece) + len(ids) + ENTRY
        return ids

    def _bytes(self, ids) -> bytes:
        coded = array(self.kind, ids)
        if sys.byteorder == "big":
            coded.byteswap()
        return coded.tobytes()

    def _encode(self, piece: str) -> bytes:
        return self._bytes(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def _letters(self, stem: str) -> bytes:
        """Ids of a word of letters alone."""
        if max(stem) >= "\u0250":
            return self._encode(stem)
        # Latin letters in lower case pass normaliser and splitter as one word, so the model can be asked directly
        word = unicodedata.normalize("NFC", stem).lower()
        found = self.known.get(word)
        if found is None:
            if not word.isalpha():  # a dotted capital I becomes two characters
                return self._encode(stem)
            found = self._keep(word, self._bytes([t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))]))
        return found

    def _piece(self, piece: str) -> bytes:
        stem = piece.rstrip(".,;:!?")
        if not self.plain or not stem.isalpha():
            return self._keep(piece, self._encode(piece))
        found = self._letters(stem)
        if len(stem) < len(piece):  # a run of punctuation is always a token group of its own
            tail = piece[len(stem) :]
            found += self.known[tail] if tail in self.known else self._keep(tail, self._encode(tail))
        return self._keep(piece, found)

    def __call__(self, text: str) -> bytes:
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        # str.split also cuts at four separators that are ordinary characters to the vocabulary
        pieces = text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else re.split("[ \t\n\r]+", text)
        found = list(map(self.known.get, pieces))
        if None in found:
            found = [self._piece(p) if f is None else f for p, f in zip(pieces, found)]
        return b"".join(found)


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of all documents in ascending order of doc_id. The tokenizer must drop white space, as word vocabularies do; its file is read once and sent to the tasks."""
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    tokenizer = Tokenizer.from_str(sent.value)
    if tokenizer.encode(" \n\t ", add_special_tokens=False).ids:
        raise ValueError("the tokenizer keeps white space, so texts can't be cut at it")
    digest = f"{zlib.crc32(sent.value.encode())} {len(sent.value)}"
    width = 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4

    def blocks(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        coder = kept(f"coder {digest}", lambda: WordCoder(Tokenizer.from_str(sent.value), f"<u{width}"))
        end = np.array([end_id], f"<u{width}").tobytes()
        part, seq, ids, held, bounds = TaskContext.get().partitionId(), 0, [], [], [0]

        def block():
            low_bits, low, high, hints = ef_encode(bounds)
            return pd.DataFrame([(part, seq, len(held), bounds[-1], held, width, b"".join(ids), low_bits, low, high, hints)], columns=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for name, body in zip(batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None), batch["text"]):
                coded = (coder(body) if body else b"") + end
                ids.append(coded)
                held.append(None if name is None else int(name))
                bounds.append(bounds[-1] + len(coded) // width)
                if bounds[-1] >= BLOCK_TOKENS:
                    yield block()
                    seq, ids, held, bounds = seq + 1, [], [], [0]
        if held:
            yield block()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return ranged.mapInPandas(blocks, BLOCKS)


def write(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, **columns) -> str:
    """Writes the blocks and returns their folder (a new one in the shared folder, if none is given)."""
    path = path or new_path(docs.sparkSession, "tokens")
    encode(docs, tokenizer_path, end_id, **columns).write.parquet(path)
    return path


def read(spark, path: str) -> DataFrame:
    """The documents of a written folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Blocks get their offset from running sums within parts and over the parts,
    so no task sees more than one part's block headers or one row for each part.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    heads = blocks.select("part", "seq", "n_tokens")
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq")
    heads = heads.withColumn("inside", F.sum("n_tokens").over(inside) - F.col("n_tokens")).drop("n_tokens")
    offsets = heads.join(parts, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("offset"))

    def documents(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                n = row.n_docs
                at = ef_select(row.low_bits, row.low, row.high, row.hints, np.arange(n + 1))
                ids = np.frombuffer(row.ids, f"<u{row.width}").astype("<u4")
                whole = memoryview(ids.tobytes())
                crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
                yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], "Int64"), "start": at[:-1] + row.offset, "n_tokens": np.diff(at), "ids_crc32": np.array(crc, np.int64)})

    return join_small(blocks, offsets, ["part", "seq"]).mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
