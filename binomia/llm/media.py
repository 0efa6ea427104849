"""Media columns: baseline JPEG made from bytes, parsed, Huffman-decoded, and fingerprinted.

The decoder handles baseline scans (8-bit samples, any Huffman tables, grey or YCbCr with
any sampling factors, one scan or several, optional restart intervals) and keeps the
luminance. What it can't read (progressive, RGB, CMYK, damaged) gives nulls. It runs over many images at once: every restart interval of
every image is a lane, and all lanes decode their k-th coefficient in the same numpy step.
Only DC values are turned into samples: a thumbnail has one sample per 8x8 block.

The encoder stores bytes losslessly as quantised coefficients: value b becomes the
coefficient of size category 8 whose magnitude bits are b (b - 255 below 128, else b), 64
to a block, in zigzag order, with a restart marker after each block.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payloads are padded to a positive multiple of this.
UNIT = 576
#: Blocks along an edge, at most (65535 samples).
EDGE = 8191
#: Bytes of images decoded in one go, about.
CHUNK = 4 << 20


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


#: One code each: DC category 8 is "0"; AC run 0, category 8 is "0", end of block "10".
_DHT = _segment(0xC4, bytes([0x00, 1, *[0] * 15, 8])) + _segment(0xC4, bytes([0x10, 1, 1, *[0] * 14, 0x08, 0x00]))
_DQT = _segment(0xDB, bytes([0, *[1] * 64]))


def layout(n_bytes: int) -> tuple[int, int]:
    """Blocks per row and rows for a padded payload."""
    triples = n_bytes // 192
    k = -(-triples // EDGE)
    return 3 * k, -(-triples // k)


def encode(payload: bytes) -> bytes:
    """A grey baseline JPEG whose coefficients are ``payload`` (a positive multiple of 576 bytes)."""
    wide, high = layout(len(payload))
    b = np.frombuffer(payload, np.uint8)
    if wide * high * 64 > len(b):
        b = np.concatenate([b, np.full(wide * high * 64 - len(b), 255, np.uint8)])
    n = len(b) // 64
    bits = np.zeros((n * 64, 9), np.uint8)
    bits[:, 1:] = np.unpackbits(b).reshape(-1, 8)
    coded = np.packbits(bits.reshape(-1))  # 72 bytes a block, aligned
    full = coded == 255
    at = np.arange(len(coded)) + 2 * (np.arange(len(coded)) // 72)
    if full.any():
        at += np.cumsum(full) - full
    out = np.zeros(at[-1] + 1 + int(full[-1]), np.uint8)
    out[at] = coded
    ends = at[71::72][:-1] + full[71::72][:-1] + 1  # a stuffed zero may follow the last byte
    out[ends] = 255
    out[ends + 1] = 0xD0 + np.arange(n - 1) % 8
    head = b"\xff\xd8" + _segment(0xFE, b"bytes=%d" % len(payload)) + _DQT
    head += _segment(0xC0, bytes([8]) + (high * 8).to_bytes(2, "big") + (wide * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    head += _DHT + _segment(0xDD, (1).to_bytes(2, "big")) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    return head + out.tobytes() + b"\xff\xd9"


@dataclass
class Image:
    width: int
    height: int
    blocks: tuple[int, int]
    interval: int
    #: Minimum coded units per row and rows; per block of one: its component and Huffman tables.
    units: tuple[int, int]
    mcu: tuple[tuple[int, tuple[bytes, bytes], tuple[bytes, bytes]], ...]
    #: Luminance blocks per row and rows of a unit.
    own: tuple[int, int]
    quant: int
    comment: bytes
    scan: np.ndarray


def _entropy(data: bytes, at: int) -> np.ndarray:
    """Entropy-coded bytes from ``at`` up to the next marker that isn't a restart."""
    s = np.frombuffer(data, np.uint8, len(data) - at, at)
    ff = np.flatnonzero(s[:-1] == 255)
    code = s[ff + 1]
    stop = ff[(code != 0) & (code != 255) & ((code < 0xD0) | (code > 0xD7))]
    return s[: stop[0]] if len(stop) else s


def parse(data: bytes) -> Image:
    """Headers of a baseline JPEG and the entropy-coded bytes of the scan with its luminance."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, tables, quants, comment, interval, frame, adobe = 2, {}, {}, b"", 0, None, None
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise ValueError("segment cut short")
        at += 2 + size
        if marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDB:
            while body:
                step = 65 if body[0] < 16 else 129
                quants[body[0] & 15] = body[1] if step == 65 else int.from_bytes(body[1:3], "big")
                body = body[step:]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("only samples of 8 bits")
            parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            frame = int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), parts
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xFE:
            comment = body
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("scan without a frame")
            asked = {body[k]: (tables.get(body[k + 1] >> 4), tables.get(16 | body[k + 1] & 15)) for k in range(1, 1 + 2 * body[0], 2)}
            if frame[2][0][0] in asked:
                break
            at += len(_entropy(data, at))
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("only baseline frames")
        elif marker == 0xD9:
            raise ValueError("no scan of the luminance")
    w, h, parts = frame
    if len(parts) not in (1, 3) or len(parts) == 3 and (adobe == 0 or bytes(p[0] for p in parts) == b"RGB"):
        raise ValueError("only grey and YCbCr")
    if not w or not h or any(not 1 <= f <= 4 for p in parts for f in p[1:3]):
        raise ValueError("no such size")
    most = max(p[1] for p in parts), max(p[2] for p in parts)
    wide, high = (-(-(-(-n * f // m)) // 8) for n, f, m in zip((w, h), parts[0][1:3], most, strict=True))
    here = [(k, p) for k, p in enumerate(parts) if p[0] in asked]
    if len(here) == 1:
        units, own, mcu = (wide, high), (1, 1), [(0, *asked[parts[0][0]])]
    else:
        units, own = (-(-w // (8 * most[0])), -(-h // (8 * most[1]))), parts[0][1:3]
        mcu = [(k, *asked[p[0]]) for k, p in here for _ in range(p[1] * p[2])]
    if any(t is None for m in mcu for t in m[1:]):
        raise ValueError("no such Huffman table")
    scan = _entropy(data, at)
    if 2 * units[0] * units[1] * len(mcu) > 8 * len(scan):  # a block takes two bits at least
        raise ValueError("scan cut short")
    return Image(w, h, (wide, high), interval, units, tuple(mcu), own, quants[parts[0][3]], comment, scan)


def _lookup(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code length and symbol for every 16-bit prefix."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, k = 0, 0
    for bits, count in enumerate(table[0], 1):
        for _ in range(count):
            a = code << (16 - bits)
            length[a : a + (1 << (16 - bits))], symbol[a : a + (1 << (16 - bits))] = bits, table[1][k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


_KNOWN: dict[tuple[bytes, bytes], tuple[np.ndarray, np.ndarray]] = {}


def _lut(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    if table not in _KNOWN:
        if len(_KNOWN) >= 16:
            _KNOWN.clear()
        _KNOWN[table] = _lookup(table)
    return _KNOWN[table]


def _lanes(images: list[Image]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scans without stuffing and markers, each lane's first byte, and its blocks."""
    parts, starts, sizes, base = [], [], [], 0
    for m in images:
        s = m.scan
        after = np.flatnonzero(s[:-1] == 255) + 1
        code = s[after]
        stuffed = after[code == 0]
        marks = after[(code >= 0xD0) & (code <= 0xD7)]
        keep = np.ones(len(s), bool)
        keep[stuffed] = keep[marks] = keep[marks - 1] = False
        shift = np.cumsum(keep)
        n = m.units[0] * m.units[1] * len(m.mcu)
        each = m.interval * len(m.mcu) or n
        if len(marks) != -(-n // each) - 1:
            raise ValueError("restart markers don't fit the image")
        starts.append(base + np.concatenate([[0], shift[marks]]))
        sizes.append(np.minimum(each, n - np.arange(len(marks) + 1) * each))
        parts.append(s[keep])
        base += len(parts[-1])
    return np.concatenate([*parts, np.zeros(16, np.uint8)]), np.concatenate(starts), np.concatenate(sizes)


def coefficients(images: list[Image]) -> list[np.ndarray]:
    """Quantised luminance (blocks x 64, zigzag order, DC undone) of images with equal units and tables."""
    raw, starts, sizes = _lanes(images)
    word = raw.astype(np.uint64)
    win = np.zeros(len(raw) - 4, np.uint64)
    for k in range(5):
        win |= word[k : k + len(win)] << np.uint64(8 * (4 - k))  # 40 bits from each byte
    mcu = [(k, _lut(dc), _lut(ac)) for k, dc, ac in images[0].mcu]
    top = len(win) - 1
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    out = np.zeros((int(sizes.sum()), 64), np.int32)
    pos, past = starts * 8, np.zeros((1 + max(k for k, _, _ in mcu), len(starts)), np.int64)

    def take(lanes: np.ndarray, lut: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Run, category and value of the next code of ``lanes``; moves them on."""
        p = pos[lanes]
        w = win[np.minimum(p >> 3, top)] >> (24 - (p & 7)).astype(np.uint64)
        size, symbol = (x[(w & np.uint64(0xFFFF)).astype(np.int64)] for x in lut)
        if (size == 0).any():
            raise ValueError("no such Huffman code")
        p = p + size
        cat = symbol & 15
        w = win[np.minimum(p >> 3, top)] >> (24 - (p & 7)).astype(np.uint64)
        v = (w & np.uint64(0xFFFF)).astype(np.int64) >> (16 - cat)
        v = np.where((v >> np.maximum(cat - 1, 0)) & 1 | (cat == 0), v, v - (1 << cat) + 1)
        pos[lanes] = p + cat
        return symbol >> 4, cat, np.where(cat == 0, 0, v)

    for block in range(int(sizes.max(initial=0))):
        lanes = np.flatnonzero(sizes > block)
        row = first[lanes] + block
        part, dc, ac = mcu[block % len(mcu)]
        _, _, v = take(lanes, dc)
        past[part, lanes] += v
        out[row, 0] = past[part, lanes]
        k = np.ones(len(lanes), np.int64)
        while len(lanes):
            run, cat, v = take(lanes, ac)
            k += run
            live = (cat > 0) & (k < 64)
            if live.all():
                out[row, k] = v
            else:
                out[row[live], k[live]] = v[live]
            k += 1
            on = ((cat > 0) | (run == 15)) & (k < 64)
            if not on.all():
                lanes, row, k = lanes[on], row[on], k[on]
    if (pos > np.append(starts[1:], len(raw) - 16) * 8).any():
        raise ValueError("scan cut short")
    cuts = np.cumsum([m.units[0] * m.units[1] * len(m.mcu) for m in images])[:-1]
    return [_raster(m, c) for m, c in zip(images, np.split(out, cuts), strict=True)]


def _raster(m: Image, coef: np.ndarray) -> np.ndarray:
    """The luminance blocks row by row, from all blocks in coded order."""
    if len(m.mcu) == 1:
        return coef
    (ux, uy), (h, v) = m.units, m.own
    grid = coef.reshape(uy, ux, len(m.mcu), 64)[:, :, : h * v].reshape(uy, ux, v, h, 64)
    return grid.transpose(0, 2, 1, 3, 4).reshape(uy * v, ux * h, 64)[: m.blocks[1], : m.blocks[0]].reshape(-1, 64)


#: What damaged or foreign bytes may raise.
_BROKEN = (ValueError, IndexError, KeyError, TypeError, OverflowError)


def decode(data: list[bytes | None]) -> list[tuple[Image, np.ndarray] | None]:
    """Images and their coefficients, None for unreadable ones; images with the same tables share their steps."""
    groups: dict[tuple, list[tuple[int, Image]]] = {}
    for k, d in enumerate(data):
        try:
            m = parse(d)
        except _BROKEN:
            continue
        groups.setdefault(m.mcu, []).append((k, m))
    out: list[tuple[Image, np.ndarray] | None] = [None] * len(data)
    for group in groups.values():
        try:
            found = coefficients([m for _, m in group])
        except _BROKEN:  # each for itself, so that only the damaged ones are lost
            found = []
            for _, m in group:
                try:
                    found += coefficients([m])
                except _BROKEN:
                    found.append(None)
        for (k, m), c in zip(group, found, strict=True):
            out[k] = None if c is None else (m, c)
    return out


def thumbnail(m: Image, coef: np.ndarray) -> np.ndarray:
    """One luminance sample per block, from its DC value alone."""
    dc = coef[:, 0].astype(np.int64) * m.quant
    return np.clip((dc + 4 >> 3) + 128, 0, 255).astype(np.uint8).reshape(m.blocks[1], m.blocks[0])


def thumbnail_hash(t: np.ndarray) -> str:
    """64 bits: cells of an 8x8 grid of means against the mean of all samples."""
    sums = np.zeros((t.shape[0] + 1, t.shape[1] + 1), np.int64)
    sums[1:, 1:] = t.astype(np.int64).cumsum(0).cumsum(1)
    y0, x0 = np.arange(8) * t.shape[0] // 8, np.arange(8) * t.shape[1] // 8
    y1, x1 = np.maximum(np.arange(1, 9) * t.shape[0] // 8, y0 + 1), np.maximum(np.arange(1, 9) * t.shape[1] // 8, x0 + 1)
    cell = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    bright = cell * t.size > sums[-1, -1] * area
    return np.packbits(bright.ravel()).tobytes().hex()


def payload(m: Image, coef: np.ndarray) -> bytes | None:
    """The bytes that :func:`encode` stored; None for images of other writers."""
    size, v = m.comment.removeprefix(b"bytes="), coef.ravel()
    if size == m.comment or not size.isdigit() or int(size) > len(v):
        return None
    return (np.where(v < 0, v + 255, v).astype(np.uint8))[: int(size)].tobytes()


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            made = [padded(t) for t in part.column(1).to_pylist()]
            media = pa.array([encode(p) for _, p in made], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), media], ["doc_id", "n_bytes", "media"])


def _chunks(media: list[bytes]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for k, m in enumerate(media):
        if k > start and size + len(m or b"") > CHUNK:
            yield start, k
            start, size = k, 0
        size += len(m or b"")
    if start < len(media):
        yield start, len(media)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        media = b.column(2).to_pylist()
        for lo, hi in _chunks(media):
            rows = []
            for data, seen in zip(media[lo:hi], decode(media[lo:hi]), strict=True):
                own = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                if seen is None:
                    rows.append((None, None, None, *own, None, None, None, None))
                    continue
                m, coef = seen
                back, t = payload(m, coef), thumbnail(m, coef)
                kept = (None, None, None) if back is None else (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]))
                rows.append((*kept, *own, m.width, m.height, hashlib.sha256(t.tobytes()).hexdigest(), thumbnail_hash(t)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            part = b.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "thumbnail_sha256", "thumbnail_hash"])


def media_column(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text (null: empty) as a grey baseline JPEG.

    Repeated rows are kept, equal texts give equal images, other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """What stored images (doc_id, n_bytes, media) show when read back.

    ``width, height`` in samples, SHA-256 and 64-bit hash of the DC thumbnail, and the
    payload that :func:`media_column` stored, recovered from the coefficients: null for
    images of other writers. Unreadable images have nulls but for their bytes and SHA-256.
    """
    return media.mapInArrow(
        _features,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumbnail_sha256 string, thumbnail_hash string",
    )
