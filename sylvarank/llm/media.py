"""Media columns: baseline JPEG written and read in numpy, with DC-only thumbnails."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: A tile of 24 x 24 samples is nine blocks of 64 coefficients, and a restart interval.
TILE, TILE_BLOCKS = 576, 9
TALLEST = 65_535 // 24
BATCH_BYTES = 4 << 20
#: Fewer restart intervals than this are decoded one by one, more side by side.
SIDE_BY_SIDE = 48

#: Code lengths of the categories of DC differences.
DC_LENGTHS = {0: 3, 1: 4, 2: 4, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 8: 5}
#: AC symbols have no zeros before them and a category of 1 to 8; frequent bytes have short codes.
AC_LENGTHS = {1: 2, 2: 2, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 8: 7}
#: Bytes that are frequent in texts and in what fills them up, most frequent first; fixed values.
FREQUENT = b" \xffeatoinsrlhducmpgfybvkw,.\nzqjx-'\"TAISCMHEWNBPRDLFOG0123456789"


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, bits), in the order in which a DHT segment lists symbols."""
    code, last, out = 0, 0, {}
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        out[symbol], last, code = (code, n), n, code + 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    by = sorted(lengths.items(), key=lambda x: x[1])
    return _segment(0xC4, bytes([kind]) + bytes(sum(n == k for _, n in by) for k in range(1, 17)) + bytes(s for s, _ in by))


def _value_bits(value: int) -> tuple[int, int]:
    """Category and value bits of a coefficient."""
    size = abs(value).bit_length()
    return size, value if value > 0 else value + (1 << size) - 1


@lru_cache(1)
def byte_coefficients() -> np.ndarray:
    """The AC coefficient of each byte: 1, -1, 2, -2, ... by frequency, never 0."""
    order = [*FREQUENT, *(b for b in range(256) if b not in FREQUENT)]
    out = np.zeros(256, np.int16)
    out[order] = [(k // 2 + 1) * (1 if k % 2 == 0 else -1) for k in range(256)]
    return out


@lru_cache(1)
def _tokens() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code and value bits, and their number, of DC differences from -255 to 255 and of AC bytes."""
    tables, out = (canonical(DC_LENGTHS), canonical(AC_LENGTHS)), []
    for table, values in zip(tables, (range(-255, 256), byte_coefficients().tolist())):
        told = [(*table[size], size, bits) for size, bits in map(_value_bits, values)]
        out += [np.asarray([code << size | bits for code, _, size, bits in told], np.int64), np.asarray([n + size for _, n, size, _ in told], np.int64)]
    return tuple(out)


def _scans(tiles: np.ndarray) -> list[bytes]:
    """The entropy-coded bytes of each tile, filled up with ones, all tiles at once."""
    dc_bits, dc_n, ac_bits, ac_n = _tokens()
    bits, n = ac_bits[tiles], ac_n[tiles]
    dc = np.diff(tiles[:, ::64].astype(np.int64) - 128, axis=1, prepend=0) + 255
    bits[:, ::64], n[:, ::64] = dc_bits[dc], dc_n[dc]
    total = n.sum(1)
    stops = np.cumsum(-(-total // 8))
    starts = np.concatenate([[0], stops[:-1]])
    fill = -total % 8
    bits, n = np.concatenate([bits, ((1 << fill) - 1)[:, None]], 1), np.concatenate([n, fill[:, None]], 1)
    at = (np.cumsum(n, axis=1) - n + 8 * starts[:, None]).ravel()
    # a token of at most 16 bits touches two words of 16 bits; tokens do not overlap, so sums are unions
    field = bits.ravel() << (32 - (at & 15) - n.ravel())
    words, last = at >> 4, int(stops[-1]) // 2 + 2 if len(stops) else 2
    out = np.bincount(words, field >> 16, last) + np.bincount(words + 1, field & 0xFFFF, last)
    raw = out.astype(">u2").tobytes()
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(starts.tolist(), stops.tolist())]


def encode_jpegs(payloads: list[bytes]) -> list[bytes]:
    """Grey baseline JPEGs whose quantised coefficients stand for the payloads' bytes.

    A payload is a positive multiple of 576 bytes.  64 bytes make a block: the
    first, less 128, is the DC coefficient (quantiser 8, so it is the block's
    mean luminance), each other one the AC coefficient that stands for the byte.
    Nine blocks are a restart interval, so a decoder can read many at once.  A
    comment holds the payload's length.
    """
    flat = []
    shapes = []
    for payload in payloads:
        tiles = len(payload) // TILE
        columns = -(-tiles // TALLEST)
        rows = -(-tiles // columns)
        shapes.append((rows, columns))
        flat += [payload, bytes(rows * columns * TILE - len(payload))]
    scans, out, at = _scans(np.frombuffer(b"".join(flat), np.uint8).reshape(-1, TILE)), [], 0
    for payload, (rows, columns) in zip(payloads, shapes):
        n = rows * columns
        parts = [scans[at]]
        for k in range(1, n):
            parts += [_RESTARTS[(k - 1) % 8], scans[at + k]]
        at += n
        out.append(b"".join([
            b"\xff\xd8", _segment(0xFE, b"payload=%d" % len(payload)), _FIXED[0],
            _segment(0xC0, struct.pack(">BHHB", 8, rows * 24, columns * 24, 1) + b"\x01\x11\x00"), _FIXED[1], *parts, b"\xff\xd9",
        ]))
    return out


def encode_jpeg(payload: bytes) -> bytes:
    return encode_jpegs([payload])[0]


_RESTARTS = [bytes([0xFF, 0xD0 + k]) for k in range(8)]
_FIXED = (
    _segment(0xDB, b"\x00\x08" + b"\x01" * 63),
    _dht(0x00, DC_LENGTHS) + _dht(0x10, AC_LENGTHS) + _segment(0xDD, struct.pack(">H", TILE_BLOCKS)) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
)


def parse_markers(data: bytes) -> dict:
    """Dimensions, components, tables, comment and scan of a baseline JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    out, at = {"dht": {}, "dqt": {}, "comment": b"", "restart": 0}, 2
    while True:
        marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xC0:
            _, out["height"], out["width"], k = struct.unpack_from(">BHHB", body)
            out["components"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["dqt"][body[0] & 15] = struct.unpack_from(">64H" if wide else ">64B", body, 1)
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                symbols = body[17 : 17 + sum(counts)]
                sizes = [n for n, c in enumerate(counts, 1) for _ in range(c)]
                out["dht"][body[0]] = dict(zip(symbols, sizes))
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            out["comment"] = body
        elif marker == 0xDA:
            out["scan_tables"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            out["scan"] = data[at : data.rindex(b"\xff\xd9")]
            return out


@lru_cache(64)
def _lookup(lengths: tuple[tuple[int, int], ...]) -> np.ndarray:
    """Of each 16 bits: the number of code bits times 256, plus the symbol; 0 where no code begins them."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, (code, n) in canonical(dict(lengths)).items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
    return out


class _Layout:
    """How a scan's restart intervals are to be read: the tables of the blocks of a unit, and the units of each interval."""

    def __init__(self, jpeg: dict):
        parts = [c for c in jpeg["components"] if c[0] in jpeg["scan_tables"]]
        h, v = (max(c[k] for c in jpeg["components"]) for k in (1, 2))
        self.single = len(parts) == 1
        step = (8, 8) if self.single else (8 * h, 8 * v)
        self.wide, self.high = -(-jpeg["width"] // step[0]), -(-jpeg["height"] // step[1])
        self.cells = [(1, 1) if self.single else c[1:3] for c in parts]
        #: Of each block of a unit its component, and that component's tables.
        self.turns = tuple(i for i, (a, b) in enumerate(self.cells) for _ in range(a * b))
        key = lambda k: tuple(jpeg["dht"][k].items())
        self.tables = tuple((key(jpeg["scan_tables"][c[0]][0]), key(16 + jpeg["scan_tables"][c[0]][1])) for c in parts)
        units = self.wide * self.high
        per = jpeg["restart"] or units
        self.units = [min(per, units - k) for k in range(0, units, per)]
        pieces = re.split(rb"\xff[\xd0-\xd7]", jpeg["scan"]) if jpeg["restart"] else [jpeg["scan"]]
        self.pieces = [p.replace(b"\xff\x00", b"\xff") for p in pieces[: len(self.units)]]
        if len(self.pieces) < len(self.units):
            raise ValueError("the scan is cut off")

    def luminance(self, blocks: np.ndarray) -> np.ndarray:
        """The first component's coefficients as rows x columns x 64, from all blocks in scan order."""
        a, b = self.cells[0]
        mine = blocks.reshape(-1, len(self.turns), 64)[:, : a * b].reshape(self.high, self.wide, b, a, 64)
        return mine.transpose(0, 2, 1, 3, 4).reshape(self.high * b, self.wide * a, 64)


def _words(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 32 bits that begin at each byte of the pieces, and each piece's first byte and end; zeros follow a piece."""
    raw = np.frombuffer(b"".join([x for p in pieces for x in (p, b"\0\0\0\0\0\0")] + [b"\0" * 4]), np.uint8).astype(np.int64)
    sizes = np.asarray([len(p) for p in pieces], np.int64)
    starts = np.cumsum(sizes + 6) - sizes - 6
    return raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:], np.stack([starts, starts + sizes], 1)


def _read_side_by_side(words: np.ndarray, spans: np.ndarray, counts: np.ndarray, tables, turns: tuple[int, ...], out: np.ndarray) -> None:
    """Decodes many intervals at once, a symbol of each at a time; ``out`` gets DC differences and AC coefficients."""
    lut = np.concatenate([_lookup(t) for pair in tables for t in pair])
    unit = np.asarray(turns, np.int64)
    place = (np.cumsum(counts) - counts) * 64
    pos, last, base, left, k, block = spans[:, 0] * 8, spans[:, 1] * 8, place, counts.copy(), np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    flat = out.reshape(-1)
    while len(pos):
        w = words[pos >> 3] >> (16 - (pos & 7)) & 0xFFFF
        table = 2 * unit[block % len(unit)] + (k > 0) if len(unit) > 1 else (k > 0).astype(np.int64)
        entry = lut[(table << 16) + w]
        if (entry == 0).any():
            raise ValueError("a code that the tables do not have, or a scan that is cut off")
        pos = pos + (entry >> 8)
        symbol = entry & 255
        ac = k > 0
        size = np.where(ac, symbol & 15, symbol)
        v = (words[pos >> 3] >> (7 - (pos & 7)) & 0x1FFFFFF) >> (25 - size)
        pos = pos + size
        v = np.where(v >> np.maximum(size - 1, 0) == 0, v - (1 << size) + 1, v)
        ended = ac & (symbol == 0)
        k = np.where(ended, 64, k + np.where(ac, symbol >> 4, 0))
        if (k[~ended] > 63).any() or (pos > last).any():
            raise ValueError("the scan is cut off or damaged")
        live = ~ended if ended.any() else slice(None)
        flat[(base + k)[live]] = v[live]
        k = np.where(ended, 64, k + 1)
        over = k > 63
        if over.any():
            block, base, left, k = block + over, base + 64 * over, left - over, np.where(over, 0, k)
            if (left == 0).any():
                go = left > 0
                pos, last, base, left, k, block = (x[go] for x in (pos, last, base, left, k, block))


def _read_one(words: list[int], start: int, end: int, count: int, tables, turns: tuple[int, ...], out: np.ndarray) -> None:
    """Decodes one interval symbol by symbol, each by one look at the next 16 bits."""
    luts = [[_lookup(t).tolist() for t in pair] for pair in tables]
    pos, last = 8 * start, 8 * end
    for n in range(count):
        dc, ac = luts[turns[n % len(turns)]]
        row, k, lut = [0] * 64, 0, dc
        while k < 64:
            entry = lut[words[pos >> 3] >> 16 - (pos & 7) & 0xFFFF]
            if not entry or pos > last:
                raise ValueError("a code that the tables do not have, or a scan that is cut off")
            pos += entry >> 8
            symbol = entry & 255
            if k:
                if not symbol:
                    break
                k += symbol >> 4
                symbol &= 15
            if symbol:
                if k > 63:
                    raise ValueError("the scan is cut off or damaged")
                v = (words[pos >> 3] >> 7 - (pos & 7) & 0x1FFFFFF) >> 25 - symbol
                pos += symbol
                row[k] = v if v >> symbol - 1 else v - (1 << symbol) + 1
            k += 1
            lut = ac
        out[n] = row
    if pos > last:
        raise ValueError("the scan is cut off")


def read_jpegs(images: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """Markers and quantised luminance coefficients (rows x columns x 64) of baseline JPEGs.

    Restart intervals of all images with the same tables are decoded together.
    """
    jpegs = [parse_markers(data) for data in images]
    layouts = [_Layout(j) for j in jpegs]
    alike: dict[tuple, list[int]] = {}
    for i, x in enumerate(layouts):
        alike.setdefault((x.tables, x.turns), []).append(i)
    out: list = [None] * len(images)
    for (tables, turns), group in alike.items():
        pieces = [p for i in group for p in layouts[i].pieces]
        counts = np.asarray([u * len(turns) for i in group for u in layouts[i].units], np.int64)
        blocks = np.zeros((int(counts.sum()), 64), np.int16)
        words, spans = _words(pieces)
        starts = np.cumsum(counts) - counts
        if len(pieces) >= SIDE_BY_SIDE:
            _read_side_by_side(words, spans, counts, tables, turns, blocks)
        else:
            listed = words.tolist()
            for (a, b), n, at in zip(spans.tolist(), counts.tolist(), starts.tolist()):
                _read_one(listed, a, b, n, tables, turns, blocks[at : at + n])
        _add_differences(blocks, starts, counts, turns)
        at = 0
        for i in group:
            n = sum(layouts[i].units) * len(turns)
            out[i] = jpegs[i], layouts[i].luminance(blocks[at : at + n])
            at += n
    return out


def _add_differences(blocks: np.ndarray, starts: np.ndarray, counts: np.ndarray, turns: tuple[int, ...]) -> None:
    """DC coefficients from their differences, per component and from 0 in each interval."""
    of = np.repeat(np.arange(len(counts)), counts)
    component = np.asarray(turns)[(np.arange(len(blocks)) - starts[of]) % len(turns)]
    for c in set(turns):
        mine = np.flatnonzero(component == c)
        sums = np.cumsum(blocks[mine, 0].astype(np.int64))
        first = np.flatnonzero(np.diff(of[mine], prepend=-1))
        before = np.concatenate([[0], sums])[first]
        blocks[mine, 0] = sums - np.repeat(before, np.diff(np.append(first, len(mine))))


def luminance_coefficients(data: bytes) -> tuple[dict, np.ndarray]:
    return read_jpegs([data])[0]


def decode_payload(jpeg: dict, coefficients: np.ndarray) -> bytes:
    """The bytes that ``encode_jpegs`` stored."""
    of = np.zeros(257, np.uint8)
    of[byte_coefficients().astype(np.int64) + 128] = np.arange(256)
    flat = coefficients.reshape(-1, 64)
    out = of[np.clip(flat, -128, 128) + 128]
    out[:, 0] = flat[:, 0] + 128
    return out.tobytes()[: int(jpeg["comment"].removeprefix(b"payload="))]


def thumbnail(jpeg: dict, coefficients: np.ndarray) -> np.ndarray:
    """Mean luminance of each block, from the DC coefficients alone."""
    q = jpeg["dqt"][jpeg["components"][0][3]][0]
    return np.clip(np.rint(coefficients[:, :, 0].astype(np.float64) * q / 8 + 128), 0, 255).astype(np.uint8)


def thumbnail_hash(image: np.ndarray, side: int = 8) -> str:
    """Average hash: which cells of a ``side`` x ``side`` reduction lie above their mean."""
    edges = [np.arange(side) * n // side for n in image.shape]
    stops = [np.maximum(np.arange(1, side + 1) * n // side, e + 1) for n, e in zip(image.shape, edges)]
    sums = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    sums[1:, 1:] = image.astype(np.int64).cumsum(0).cumsum(1)
    (top, left), (bottom, right) = np.ix_(*edges), np.ix_(*stops)
    cells = (sums[bottom, right] - sums[top, right] - sums[bottom, left] + sums[top, left]) / ((bottom - top) * (right - left))
    return np.packbits(cells > cells.mean()).tobytes().hex()


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b"\xff" * (TILE - len(raw) if len(raw) < TILE else -len(raw) % TILE)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text as a JPEG.  Null texts are empty ones; rows keep their multiplicity.

    Texts are handled in batches of some 4 MB; a longer one is a batch of its
    own and takes some forty bytes of memory for each of its own.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

        def made(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array(encode_jpegs([h[2] for h in held]), pa.binary())], schema=schema)

        held, weight = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                n, payload = padded(text.as_py())
                if held and weight + len(payload) > BATCH_BYTES // 4:
                    yield made(held)
                    held, weight = [], 0
                held.append((doc.as_py(), n, payload))
                weight += len(payload)
        if held:
            yield made(held)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(write), "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumbnail_hash string"


def media_features(media: DataFrame) -> DataFrame:
    """Reads the media back: payload digests, dimensions and the thumbnail's hash.

    A damaged media value fails the task with the reason.  An empty table gives
    no rows.  ``feature`` is the dimensions and the hash of the DC-only
    thumbnail; equal payloads give equal features.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[k]) for n, k in (c.split(" ") for c in FEATURES.split(", "))])

        def told(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            rows = []
            for (doc, n, data), (jpeg, coefficients) in zip(held, read_jpegs([h[2] for h in held])):
                payload = decode_payload(jpeg, coefficients)
                small = thumbnail_hash(thumbnail(jpeg, coefficients))
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), f"{jpeg['width']}x{jpeg['height']}:{small}", jpeg["width"], jpeg["height"], small))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        held, weight = [], 0
        for batch in batches:
            for doc, n, data in zip(*batch.columns):
                data = data.as_py()
                if held and weight + len(data) > BATCH_BYTES:
                    yield told(held)
                    held, weight = [], 0
                held.append((doc.as_py(), n.as_py(), data))
                weight += len(data)
        if held:
            yield told(held)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(read), FEATURES)
