"""Media columns: GIF images read into timed frames with colour histograms.

``decode`` reads the blocks of a GIF, decodes its LZW code streams, applies
global and local palettes, interlacing, transparency and the disposal of each
frame, and gives the composed frames in order with their time. ``encode`` writes
samples as 8-bit indices of a palette, which stores any bytes without loss.

Defined results: a null or empty image, and bytes that aren't a GIF, have no
frames; a truncated or damaged image has the frames before the damage, and one
that claims more than MAX_PIXELS has none; a delay of 0 stays 0; repeated rows each give their frames; an empty table gives an empty result.
Payloads that don't fit one frame (65,535 lines) take several.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepframe.functions.worker import kept

WIDTH = 64
#: Lines of one frame; longer payloads take several frames.
LINES = 65_535
BINS = 8
#: A screen of more pixels can't be held in a task; the widest one of 65,535 lines that encode() writes has 4,194,240.
MAX_PIXELS = 1 << 26
_GREY = bytes(x for i in range(256) for x in (i, i, i))
_FULL = 4096


def lzw_codes(data: bytes, bits: int = 8) -> list[int]:
    """Codes of a GIF code stream: clear first, again when the table is full, end last."""
    clear = 1 << bits
    out = [clear]
    if data:
        put, free = out.append, clear + 2
        # a node maps the next byte to the node of the longer word, and -1 to the code of its own
        roots: dict[int, dict] = {}
        node = roots[data[0]] = {-1: data[0]}
        for byte in memoryview(data)[1:]:
            longer = node.get(byte)
            if longer is not None:
                node = longer
                continue
            put(node[-1])
            if free < _FULL:
                node[byte] = {-1: free}
                free += 1
            else:
                put(clear)
                roots = {}
                free = clear + 2
            node = roots.get(byte)
            if node is None:
                node = roots[byte] = {-1: byte}
        put(node[-1])
    out.append(clear + 1)
    return out


def _widths(bits: int) -> np.ndarray:
    free = np.minimum((1 << bits) + 2 + np.maximum(np.arange(2 * _FULL) - 1, 0), _FULL - 1)
    return np.maximum(bits + 1, np.floor(np.log2(free)).astype(np.int64) + 1)


def _width_run(bits: int, n: int) -> np.ndarray:
    """Widths of the first n codes after a clear code: a code is one bit wider once the reader's table has reached a power of two."""
    run = kept(("code widths", bits), lambda: _widths(bits))
    return run[:n] if n <= len(run) else np.append(run, np.full(n - len(run), 12))


def pack_codes(codes: list[int], bits: int = 8) -> bytes:
    """Codes as a string of bits, least bit first."""
    codes = np.array(codes, np.int64)
    starts = np.flatnonzero(codes == 1 << bits) + 1
    widths = np.full(len(codes), bits + 1, np.int64)
    run = _width_run(bits, int(np.diff(np.append(starts, len(codes))).max(initial=0)))
    for a, b in zip(starts, np.append(starts[1:], len(codes))):
        widths[a:b] = run[: b - a]
    starts = np.cumsum(widths) - widths
    # a code touches three bytes at most, and no bit has two codes, so bytes are sums
    spread, at, n = codes << (starts & 7), starts >> 3, int(starts[-1] + widths[-1] + 7) >> 3
    total = sum(np.bincount(at + i, (spread >> (8 * i)) & 255, n + 2) for i in range(3))
    return total[:n].astype(np.uint8).tobytes()


def _codes_at(stream: np.ndarray, starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Codes of the given widths at the given bits; the stream has three bytes more than it holds."""
    at = starts >> 3
    three = stream[at] | stream[at + 1] << 8 | stream[at + 2] << 16
    return three >> (starts & 7) & ((1 << widths) - 1)


def lzw_decode(stream: bytes, bits: int, most: int) -> bytes:
    """At most so many indices of a code stream. Codes are cut out in runs up to the next clear code, and expanded with the table of the run."""
    clear, end = 1 << bits, (1 << bits) + 1
    held, n_bits = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(3, np.uint8)]).astype(np.int64), 8 * len(stream)
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    at, parts, size = 0, [], 0
    while at < n_bits and size < most:
        run = _width_run(bits, min(_FULL, (n_bits - at) // (bits + 1) + 1))
        ends = at + np.cumsum(run)
        whole = int(np.searchsorted(ends, n_bits, "right"))
        codes = _codes_at(held, (ends - run)[:whole], run[:whole])
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else whole
        table = roots[:]
        put, grow, new = parts.append, table.append, codes[:stop].tolist()
        room, first = 1 + _FULL - len(table), len(parts)
        if new:
            before = table[new[0]]
            put(before)
        for code in new[1:room]:
            try:
                word = table[code]
            except IndexError:
                if code != len(table):
                    raise ValueError("a code that isn't in the table") from None
                word = before + before[:1]
            grow(before + word[:1])
            put(word)
            before = word
        parts += map(table.__getitem__, new[room:])
        size += sum(map(len, parts[first:]))
        if len(stops):
            if codes[stop] == end:
                break
            at = int(ends[stop])
        elif whole < len(run):
            break
        else:
            # a full table without a clear code: the reader goes on with it
            at = int(ends[whole - 1])
            starts = np.arange(at, n_bits - 11, 12)
            rest = _codes_at(held, starts, np.full(len(starts), 12))
            stops = np.flatnonzero((rest == clear) | (rest == end))
            more = [table[code] for code in rest[: int(stops[0]) if len(stops) else len(rest)].tolist()]
            parts += more
            size += sum(map(len, more))
            if not len(stops) or rest[stops[0]] == end:
                break
            at = int(starts[stops[0]]) + 12
    return b"".join(parts)[:most]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode(samples: bytes, width: int = WIDTH, delay: int = 0) -> bytes:
    """A GIF whose frames hold the samples as indices of a grey palette, line after line; their number must be a positive multiple of the width."""
    if not samples or len(samples) % width:
        raise ValueError("the samples must fill whole lines")
    lines = len(samples) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(lines, LINES), 0xF7, 0, 0), _GREY]
    for first in range(0, lines, LINES):
        n = min(LINES, lines - first)
        out += [b"\x21\xf9\x04\x04", struct.pack("<H", delay), b"\0\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, n, 0), b"\x08"]
        out.append(_blocks(pack_codes(lzw_codes(samples[first * width : (first + n) * width]))))
    return b"".join([*out, b"\x3b"])


def decode(image: bytes | None):
    """Yields (start_ms, delay_ms, left, top, indices as lines x columns, pixels as lines x columns x RGBA of the whole composed screen) of each frame, up to the end or the first damage."""
    try:
        yield from _decode(image)
    except (ValueError, IndexError, struct.error):
        return


def _decode(image: bytes | None):
    if not image or image[:6] not in (b"GIF87a", b"GIF89a") or len(image) < 13:
        return
    wide, high, flags, _, _ = struct.unpack_from("<HHBBB", image, 6)
    at = 13

    def palette(flags):
        nonlocal at
        n = 3 << ((flags & 7) + 1) if flags & 0x80 else 0
        colours = np.frombuffer(image[at : at + n], np.uint8).reshape(-1, 3)
        at += n
        return colours

    def sub_blocks():
        nonlocal at
        parts = []
        while at < len(image) and image[at]:
            parts.append(image[at + 1 : at + 1 + image[at]])
            at += 1 + image[at]
        at += 1
        return b"".join(parts)

    shared = palette(flags)
    if wide * high > MAX_PIXELS:
        return
    screen = np.zeros((high, wide, 4), np.uint8)
    delay, clear_index, disposal, now = 0, None, 0, 0
    while at < len(image):
        kind = image[at]
        at += 1
        if kind == 0x21:
            label = image[at] if at < len(image) else 0
            at += 1
            body = sub_blocks()
            if label == 0xF9 and len(body) >= 4:
                delay, disposal = struct.unpack_from("<H", body, 1)[0], body[0] >> 2 & 7
                clear_index = body[3] if body[0] & 1 else None
        elif kind == 0x2C and at + 9 <= len(image):
            left, top, w, h, flags = struct.unpack_from("<HHHHB", image, at)
            at += 9
            colours = palette(flags) if flags & 0x80 else shared
            if at >= len(image):
                return
            bits = image[at]
            at += 1
            stream = sub_blocks()
            if not 1 <= bits <= 11 or w * h > MAX_PIXELS:
                return
            raw = lzw_decode(stream, bits, w * h)
            if len(raw) < w * h:
                return
            indices = np.frombuffer(raw, np.uint8).reshape(h, w)
            if flags & 0x40:
                order = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
                straight = np.empty_like(indices)
                straight[order] = indices
                indices = straight
            kept = screen.copy() if disposal == 3 else None
            table = np.zeros((256, 4), np.uint8)
            table[: len(colours), :3] = colours
            table[:, 3] = 255
            box = screen[top : top + h, left : left + w]
            inside = indices[: box.shape[0], : box.shape[1]]
            if clear_index is None:
                box[...] = table.view("<u4")[:, 0][inside].view(np.uint8).reshape(*inside.shape, 4)
            else:
                shown = inside != clear_index
                box[shown] = table[inside[shown]]
            yield now * 10, delay * 10, left, top, indices, screen
            now += delay
            if disposal == 2:
                screen[top : top + h, left : left + w] = 0
            elif disposal == 3:
                screen = kept
            delay, clear_index, disposal = 0, None, 0
        else:
            return


def histogram(pixels: np.ndarray, bins: int = BINS) -> list[int]:
    """Counts of the visible pixels by red, then green, then blue, in equal ranges; bins is a power of two."""
    seen = pixels[..., 3] > 0
    visible = pixels.reshape(-1, 4) if seen.all() else pixels[seen]
    step = (256 // bins).bit_length() - 1
    return [int(x) for c in range(3) for x in np.bincount(visible[:, c] >> step, minlength=bins)]


FRAMES = "frame int, start_ms long, delay_ms long, width int, height int, left int, top int, indices binary, histogram array<long>"


def frames(images: DataFrame, key: str, image: str) -> DataFrame:
    """One row for each frame of each image: the key, its time and place, its palette indices, and the colour histogram of the composed screen."""

    def rows(batches):
        for batch in batches:
            for name, body in zip(batch["key"], batch["image"]):
                for i, (start, delay, left, top, indices, screen) in enumerate(decode(body)):
                    yield pd.DataFrame([(name, i, start, delay, indices.shape[1], indices.shape[0], left, top, indices.tobytes(), histogram(screen))], columns=["key", *[c.split()[0] for c in FRAMES.split(", ")]])

    kind = images.schema[key].dataType.simpleString()
    return images.select(F.col(key).alias("key"), F.col(image).alias("image")).mapInPandas(rows, f"key {kind}, {FRAMES}")


def stored(payload: Column) -> Column:
    """The GIF that stores the payload: the bytes of a text, with bytes 0 up to a positive multiple of 64."""

    @F.pandas_udf("binary")
    def image(texts: pd.Series) -> pd.Series:
        return pd.Series([encode(padded((t or "").encode("utf-8", "surrogatepass"))) for t in texts])

    return image(payload)


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    return data + bytes((-len(data)) % unit or (0 if data else unit))


def payload_features(images: DataFrame, doc_id: str = "doc_id", n_bytes: str = "n_bytes", image: str = "image") -> DataFrame:
    """Of stored payloads, read back through decode: sizes, digests, the grey histogram as the feature, and number and time of the frames."""

    def rows(batches):
        for batch in batches:
            out = []
            for name, size, body in zip(batch["doc_id"], batch["n_bytes"], batch["image"]):
                whole, counts, n_frames, ends = [], np.zeros(3 * BINS, np.int64), 0, 0
                for start, delay, _, _, indices, screen in decode(body):
                    whole.append(indices.tobytes())
                    n_frames, ends = n_frames + 1, start + delay
                    counts += histogram(screen[: indices.shape[0]])
                data = b"".join(whole)
                out.append((name, size, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(body), hashlib.sha256(body).hexdigest(), ",".join(map(str, counts[:BINS])), n_frames, ends))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_ms"]).astype({"doc_id": "Int64"})

    picked = images.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(n_bytes).alias("n_bytes"), F.col(image).alias("image"))
    return picked.mapInPandas(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long")
