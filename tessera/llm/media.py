"""Media columns: baseline JPEG encoding of payloads, and features from DC-only thumbnails.

``jpeg_column`` stores a payload as grey baseline JPEG frames, one 8x8 block for each byte.  With every quantiser at
8 a flat block of sample v has the single coefficient DC = v - 128, so a byte is exactly one DC value and the frame's
DC-only luminance thumbnail *is* the payload: the form is lossless.  A frame is ``TILE`` (24) blocks wide for every
576 bytes of a row of tiles; payloads beyond a frame's 65,535 lines continue in further frames, one after another.

``media_features`` knows only the stored bytes.  It parses the markers, Huffman-decodes the scan, rebuilds the
thumbnail in numpy and derives dimensions and a difference hash.  Any baseline scan is decoded (1 or 3 components,
sampling factors, restart intervals, AC coefficients skipped).  Where the tables give all symbols of a one-component,
DC-only scan the same total width - ours do, 12 bits a block - bit positions are known beforehand and the decoding
is a vectorised table lookup; otherwise codes are followed one by one.

Defined cases: null text counts as empty, an empty payload is 576 bytes of 255; repeated rows give equal values; other
columns are ignored; an empty table gives no rows; broken bytes raise ValueError.  Rows are handled one by one, without
a shuffle, so no group of copies can heat a task; a long text is held whole, with a few numpy arrays of its size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

TILE, UNIT, FILL = 24, 576, 255
ROWS = 65_535 // 8 // TILE * TILE  # thumbnail rows in a frame
#: DC code lengths by category 0..8: code plus extra bits are 11 bits for each; the end-of-block code is one bit more.
DC_LENGTHS = [11, 10, 9, 8, 7, 6, 5, 4, 3]
MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _codes(counts: list[int], symbols: bytes) -> list[tuple[int, int, int]]:
    """Canonical Huffman codes as (code, length, symbol)."""
    out, code, i = [], 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[i: i + n]:
            out.append((code, length, s))
            code += 1
        i += n
        code <<= 1
    return out


def _dht(kind: int, lengths: list[tuple[int, int]]) -> bytes:
    """A DHT segment from (length, symbol) pairs."""
    lengths = sorted(lengths)
    counts = [sum(1 for n, _ in lengths if n == k) for k in range(1, 17)]
    body = bytes([kind, *counts, *(s for _, s in lengths)])
    return b"\xff\xc4" + struct.pack(">H", 2 + len(body)) + body


_DC = [(n, c) for c, n in enumerate(DC_LENGTHS)]
_TABLES = b"\xff\xdb\x00\x43\x00" + bytes([8] * 64) + _dht(0x00, _DC) + _dht(0x10, [(1, 0)])


def _symbol_table() -> np.ndarray:
    """By difference + 255: the 12 bits of DC code, extra bits and end of block (code 0)."""
    code = {s: (c, n) for c, n, s in _codes([sum(1 for n, _ in _DC if n == k) for k in range(1, 17)], bytes(s for _, s in sorted(_DC)))}
    out = np.zeros(511, np.uint32)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << cat) - 1
        c, n = code[cat]
        out[d + 255] = ((c << cat) | extra) << 1
    return out


_SYMBOLS = _symbol_table()


def encode_payload(payload: bytes) -> bytes:
    """JPEG frames for a payload whose length is a positive multiple of 576."""
    out = []
    for at in range(0, len(payload), ROWS * TILE):
        v = np.frombuffer(payload[at: at + ROWS * TILE], np.uint8)
        w = _SYMBOLS[np.diff(v.astype(np.int16), prepend=np.int16(128)) + 255]
        a, b = w[0::2], w[1::2]
        scan = np.empty((len(a), 3), np.uint8)
        scan[:, 0], scan[:, 1], scan[:, 2] = a >> 4, (a & 15) << 4 | b >> 8, b & 255
        sof = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, len(v) // TILE * 8, TILE * 8, 1) + b"\x01\x11\x00"
        out += [b"\xff\xd8", _TABLES, sof, b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00", scan.tobytes().replace(b"\xff", b"\xff\x00"), b"\xff\xd9"]
    return b"".join(out)


class _Frame:
    def __init__(self):
        self.quant: dict[int, np.ndarray] = {}
        self.huff: dict[int, list[tuple[int, int, int]]] = {}
        self.restart = 0
        self.width = self.height = 0
        self.parts: list[dict] = []


def _frames(data: bytes) -> Iterator[tuple[_Frame, bytes]]:
    """Each frame's headers and its entropy-coded segment, restart markers included."""
    at, n, frame = 0, len(data), _Frame()
    while at < n:
        if data[at] != 0xFF or at + 1 >= n:
            raise ValueError(f"no marker at byte {at}")
        mark = data[at + 1]
        at += 2
        if mark == 0xD8:
            frame = _Frame()
            continue
        if mark == 0xD9 or mark == 0xFF:
            at -= mark == 0xFF
            continue
        size = struct.unpack_from(">H", data, at)[0]
        body = data[at + 2: at + size]
        at += size
        if mark == 0xDB:
            while body:
                wide, key = body[0] >> 4, body[0] & 15
                step = 128 if wide else 64
                frame.quant[key] = np.frombuffer(body[1: 1 + step], ">u2" if wide else np.uint8).astype(int)
                body = body[1 + step:]
        elif mark == 0xC4:
            while body:
                counts = list(body[1:17])
                frame.huff[body[0]] = _codes(counts, body[17: 17 + sum(counts)])
                body = body[17 + sum(counts):]
        elif mark == 0xDD:
            frame.restart = struct.unpack(">H", body)[0]
        elif mark == 0xC0:
            precision, frame.height, frame.width, parts = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("baseline has 8-bit samples")
            frame.parts = [{"id": body[6 + 3 * k], "h": body[7 + 3 * k] >> 4, "v": body[7 + 3 * k] & 15, "q": body[8 + 3 * k]} for k in range(parts)]
        elif mark in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a baseline frame")
        elif mark == 0xDA:
            for k in range(body[0]):
                part = next(p for p in frame.parts if p["id"] == body[1 + 2 * k])
                part["dc"], part["ac"] = body[2 + 2 * k] >> 4, 0x10 | body[2 + 2 * k] & 15
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= n:
                    raise ValueError("the scan does not end")
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            yield frame, data[at:end]
            at = end


_luts: dict[tuple, np.ndarray | None] = {}


def _even(dc: list, ac: list) -> tuple[int, np.ndarray] | None:
    """(bits a block, difference by those bits), if all DC symbols with their end of block are equally wide."""
    key = (tuple(dc), tuple(ac))
    if key not in _luts:
        _luts[key] = None
        stop = next(((c, n) for c, n, s in ac if s == 0), None)
        widths = {n + s for _, n, s in dc}
        if len(ac) == 1 and stop and len(widths) == 1 and (width := widths.pop() + stop[1]) <= 16:
            lut = np.full(1 << width, -32768, np.int16)
            for c, _, s in dc:
                extra = np.arange(1 << s)
                lut[((c << s | extra) << stop[1]) | stop[0]] = np.where(extra >> max(s - 1, 0) & 1, extra, extra - (1 << s) + 1) if s else 0
            _luts[key] = (width, lut)
    return _luts[key]


def _bits(scan: bytes, width: int, n: int) -> np.ndarray:
    """The scan's first n words of ``width`` bits."""
    raw = np.frombuffer(scan, np.uint8)
    if width == 12:
        raw = raw[: (3 * n + 1) // 2].astype(np.uint16)
        raw = np.r_[raw, np.zeros(-len(raw) % 3, np.uint16)].reshape(-1, 3)
        out = np.empty((len(raw), 2), np.uint16)
        out[:, 0], out[:, 1] = raw[:, 0] << 4 | raw[:, 1] >> 4, (raw[:, 1] & 15) << 8 | raw[:, 2]
        return out.ravel()[:n]
    bits = np.unpackbits(raw, count=width * n).reshape(n, width)
    return bits @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))


def _walk(frame: _Frame, scan: bytes) -> list[np.ndarray]:
    """DC values of any baseline scan, code by code."""
    hmax, vmax = max(p["h"] for p in frame.parts), max(p["v"] for p in frame.parts)
    single = len(frame.parts) == 1
    across, down = -(-frame.width // (8 * hmax)), -(-frame.height // (8 * vmax))
    if single:
        across, down = -(-frame.width // 8), -(-frame.height // 8)
    books = {k: {(n, c): s for c, n, s in v} for k, v in frame.huff.items()}
    grids = [np.zeros((down * (1 if single else p["v"]), across * (1 if single else p["h"])), int) for p in frame.parts]
    pieces, at = [], 0
    for i in range(len(scan) - 1):
        if scan[i] == 0xFF and 0xD0 <= scan[i + 1] <= 0xD7:
            pieces.append(scan[at:i])
            at = i + 2
    pieces.append(scan[at:])
    mcu, per = 0, frame.restart or across * down
    for piece in pieces:
        raw = piece.replace(b"\xff\x00", b"\xff")
        value, left = int.from_bytes(raw, "big"), 8 * len(raw)

        def take(k: int) -> int:
            nonlocal left
            left -= k
            if left < 0:
                raise ValueError("the scan is cut short")
            return value >> left & ((1 << k) - 1)

        def symbol(book: dict) -> int:
            code = 0
            for n in range(1, 17):
                code = code << 1 | take(1)
                if (n, code) in book:
                    return book[n, code]
            raise ValueError("no such code")

        before = [0] * len(frame.parts)
        for m in range(mcu, min(mcu + per, across * down)):
            for k, p in enumerate(frame.parts):
                h, v = (1, 1) if single else (p["h"], p["v"])
                for b in range(h * v):
                    s = symbol(books[p["dc"]])
                    e = take(s)
                    before[k] += e if s and e >> (s - 1) else e - (1 << s) + 1 if s else 0
                    grids[k][m // across * v + b // h, m % across * h + b % h] = before[k]
                    z = 1
                    while z < 64:
                        rs = symbol(books[p["ac"]])
                        if rs == 0:
                            break
                        take(rs & 15)
                        z += (rs >> 4) + 1
        mcu += per
    return grids


def thumbnail(data: bytes) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, DC-only luminance thumbnail) of each frame."""
    out = []
    for frame, scan in _frames(data):
        luma = frame.parts[0]
        even = _even(frame.huff[luma["dc"]], frame.huff[luma["ac"]]) if len(frame.parts) == 1 and not frame.restart else None
        if even:
            across, down = -(-frame.width // 8), -(-frame.height // 8)
            d = even[1][_bits(scan.replace(b"\xff\x00", b"\xff"), even[0], across * down)]
            if len(d) < across * down or (d == -32768).any():
                raise ValueError("broken scan")
            dc = np.cumsum(d, dtype=np.int32).reshape(down, across)
        else:
            dc = _walk(frame, scan)[0]
        level = np.clip(np.rint(dc * frame.quant[luma["q"]][0] / 8 + 128), 0, 255) if frame.quant[luma["q"]][0] != 8 else np.clip(dc + 128, 0, 255)
        out.append((frame.width, frame.height, level.astype(np.uint8)))
    return out


def difference_hash(thumb: np.ndarray) -> int:
    """64 bits: whether each of 8x9 area means is below its right neighbour."""
    rows = np.linspace(0, thumb.shape[0], 9).astype(int)
    cols = np.linspace(0, thumb.shape[1], 10).astype(int)
    sums = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), np.minimum(rows[:-1], thumb.shape[0] - 1), axis=0), np.minimum(cols[:-1], thumb.shape[1] - 1), axis=1)
    areas = np.maximum(np.diff(rows), 1)[:, None] * np.maximum(np.diff(cols), 1)[None, :]
    mean = sums / areas
    return int.from_bytes(np.packbits(mean[:, 1:] > mean[:, :-1]).tobytes(), "big")


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary())
        for at in range(0, len(ids), 256):
            raw = texts.slice(at, 256).to_pylist()
            media = [encode_payload(t + b"\xff" * (-len(t) % UNIT if t else UNIT)) for t in raw]
            yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for n, scalar in zip(batch.column("n_bytes").to_pylist(), batch.column("media")):
            media = scalar.as_py()
            frames = thumbnail(media)
            payload = b"".join(t.tobytes() for _, _, t in frames)
            feature = ";".join(f"{w}x{h}:{difference_hash(t):016x}" for w, h, t in frames)
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        cols = list(zip(*rows)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], [c.split()[0] for c in FEATURES.split(", ")])


def jpeg_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as JPEG frames."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_encode, MEDIA)


def media_features(media: DataFrame) -> DataFrame:
    """Features of a (doc_id, n_bytes, media) table, from the stored bytes alone."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, FEATURES)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(jpeg_column(table(spark, sf_dir, "documents")))
