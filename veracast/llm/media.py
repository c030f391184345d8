"""Media columns for baseline JPEG.

Markers are parsed, entropy-coded scans are Huffman-decoded, and of each
luminance block only the DC coefficient is dequantised: it is the block's mean
level, so the DC coefficients are the picture at an eighth of its size. AC
coefficients have to be decoded to find the next block, but are thrown away,
and no inverse transform is made. As their values don't matter, a table tells
of any 16 bits ahead how many bits and coefficients all the AC codes take that
begin in them, up to the block's end: several symbols a look-up.

Stored are the picture's dimensions and components, the thumbnail, and two
hashes of it: an exact one and a 64-bit difference hash for near matches.

encode() writes grey baseline JPEG, for tests and for tables that hold no media.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Rows

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


class Corrupt(ValueError):
    """Not a JPEG, or one that breaks off or contradicts itself."""


class Unsupported(ValueError):
    """A JPEG, but not a baseline (sequential, Huffman-coded, 8-bit) one."""


def _symbols(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(code length, symbol) by the next 16 bits; length 0 where no code fits."""
    length, symbol = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8)
    code = k = 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            first, span = code << (16 - bits), 1 << (16 - bits)
            if first + span > 65536 or k >= len(symbols):
                raise Corrupt("Huffman table")
            length[first : first + span] = bits
            symbol[first : first + span] = symbols[k]
            code += 1
            k += 1
        code <<= 1
    return length, symbol


@lru_cache(64)
def _dc_lookup(counts: bytes, symbols: bytes) -> tuple[bytes, bytes]:
    length, symbol = _symbols(counts, symbols)
    return length.tobytes(), symbol.tobytes()


#: added to a block's place where its end is reached
_END = 1 << 10


@lru_cache(64)
def _ac_lookup(counts: bytes, symbols: bytes) -> tuple[list[int], list[int], list[int], list[int]]:
    """By the next 16 bits: (bits, coefficients) of the first symbol, 0 bits where no code fits, then
    (bits, coefficients) of all symbols whose codes lie within them, up to
    and with an end of block; this counts as _END coefficients."""
    length, symbol = (x.astype(np.int64) for x in _symbols(counts, symbols))
    size = symbol & 15
    step = np.where(length > 0, length + size, 0)
    skip = np.where(size > 0, (symbol >> 4) + 1, np.where(symbol == 0xF0, 16, _END))
    ahead = np.arange(65536)
    used, passed = step.copy(), np.where(length > 0, skip, 0)
    live = np.flatnonzero((length > 0) & (passed < _END) & (used < 16))
    while len(live):
        rest = (ahead[live] << used[live]) & 0xFFFF
        whole = (length[rest] > 0) & (length[rest] + used[live] <= 16)
        live, rest = live[whole], rest[whole]
        used[live] += step[rest]
        passed[live] += skip[rest]
        live = live[(passed[live] < _END) & (used[live] < 16)]
    return step.tolist(), skip.tolist(), used.tolist(), passed.tolist()


class _Component:
    def __init__(self, id_: int, h: int, v: int, quant: int):
        self.id, self.h, self.v, self.quant = id_, h, v, quant
        self.dc: tuple[bytes, bytes] = (b"", b"")
        self.ac: tuple[list[int], ...] = ()
        self.across = self.down = 0
        self.values = np.zeros((0, 0), np.int32)


def _decode(data: bytes, parts: list[_Component], single: bool, mcus: int, across: int, restart: int) -> None:
    """Fill the components' DC values from a scan, with byte stuffing undone
    between restart markers."""
    segments: list[bytes] = []
    start = at = 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            segments.append(data[start:])
            break
        if 0xD0 <= data[at + 1] <= 0xD7:
            segments.append(data[start:at])
            start = at + 2
        at += 2
    per = restart or mcus
    # the blocks of an MCU: which component, its tables, and where in it the block lies
    blocks = [(p, *c.dc, *c.ac, y, x) for p, c in enumerate(parts) for y in range(1 if single else c.v) for x in range(1 if single else c.h)]
    for n, first in enumerate(range(0, mcus, per)):
        if n >= len(segments):
            raise Corrupt("scan ends early")
        raw = segments[n].replace(b"\xff\x00", b"\xff")
        total = len(raw) * 8
        # any 32 bits from a byte on, so that a look-up needs no slice
        padded = np.frombuffer(raw + b"\xff" * 12, np.uint8).astype(np.int64)
        word = ((padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]).tolist()
        pos = 0
        before = [0] * len(parts)
        levels: list[int] = []
        try:
            for _ in range(min(per, mcus - first)):
                for p, dc_length, dc_symbol, step, skip, used, passed, _y, _x in blocks:
                    ahead = (word[pos >> 3] >> (16 - (pos & 7))) & 0xFFFF
                    bits, size = dc_length[ahead], dc_symbol[ahead]
                    if not bits or size > 11:
                        raise Corrupt("DC code")
                    pos += bits
                    if size:
                        value = (word[pos >> 3] >> (32 - (pos & 7) - size)) & ((1 << size) - 1)
                        pos += size
                        before[p] += value if value >> (size - 1) else value - (1 << size) + 1
                    levels.append(before[p])
                    k = 1
                    while k < 64:
                        ahead = (word[pos >> 3] >> (16 - (pos & 7))) & 0xFFFF
                        more = passed[ahead]
                        if k + (more & (_END - 1)) < 64 and more:
                            pos += used[ahead]
                            k += more
                        elif step[ahead]:  # the block may end within these symbols: one at a time
                            pos += step[ahead]
                            k += skip[ahead]
                        else:
                            raise Corrupt("AC code")
                    if 64 < k < _END:
                        raise Corrupt("AC run")
                    if pos > total:
                        raise Corrupt("scan ends early")
        except IndexError:
            raise Corrupt("scan ends early") from None
        # place them: MCU by MCU, block by block
        mcu = np.arange(first, first + len(levels) // len(blocks))
        table = np.array(levels, np.int32).reshape(-1, len(blocks))
        for i, (p, *_, y, x) in enumerate(blocks):
            h, v = (1, 1) if single else (parts[p].h, parts[p].v)
            parts[p].values[mcu // across * v + y, mcu % across * h + x] = table[:, i]


def decode(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """(width, height, components, thumbnail as uint8 rows) of a baseline JPEG."""
    if data[:2] != b"\xff\xd8":
        raise Corrupt("no start of image")
    quant: dict[int, int] = {}
    huffman: dict[int, tuple] = {}
    frame: list[_Component] = []
    width = height = restart = 0
    seen: set[int] = set()
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise Corrupt("marker expected")
        marker = data[at + 1]
        if marker == 0xFF:  # fill
            at += 1
            continue
        if marker == 0xD9:
            break
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise Corrupt("segment ends early")
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide, id_ = body[k] >> 4, body[k] & 15
                end = k + 1 + (128 if wide else 64)
                if end > len(body):
                    raise Corrupt("quantisation table")
                quant[id_] = struct.unpack(">H", body[k + 1 : k + 3])[0] if wide else body[k + 1]
                k = end
        elif marker == 0xC4:
            k = 0
            while k + 17 <= len(body):
                counts = body[k + 1 : k + 17]
                end = k + 17 + sum(counts)
                if end > len(body):
                    raise Corrupt("Huffman table")
                huffman[body[k]] = (_ac_lookup if body[k] >> 4 else _dc_lookup)(bytes(counts), bytes(body[k + 17 : end]))
                k = end
        elif marker in (0xC0, 0xC1):
            if len(body) < 6 or len(body) < 6 + 3 * body[5]:
                raise Corrupt("frame")
            if body[0] != 8:
                raise Unsupported("12-bit samples")
            height, width = struct.unpack(">HH", body[1:5])
            if not height or not width or not body[5]:
                raise Unsupported("size given later") if width and body[5] else Corrupt("frame")
            frame = [_Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            if any(not 1 <= c.h <= 4 or not 1 <= c.v <= 4 for c in frame):
                raise Corrupt("sampling factors")
            hmax, vmax = max(c.h for c in frame), max(c.v for c in frame)
            mcus_across, mcus_down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
            if mcus_across * mcus_down * hmax * vmax > 64 * len(data):  # a block takes 2 bits at least, a scan can't hold so many
                raise Corrupt("more blocks than data")
            for c in frame:
                c.values = np.zeros((mcus_down * c.v, mcus_across * c.h), np.int32)
                c.across = -(-(-(-width * c.h // hmax)) // 8)
                c.down = -(-(-(-height * c.v // vmax)) // 8)
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise Unsupported("not a baseline frame")
        elif marker == 0xCC:
            raise Unsupported("arithmetic coding")
        elif marker == 0xDD:
            if len(body) < 2:
                raise Corrupt("restart interval")
            restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            if not frame:
                raise Corrupt("scan before frame")
            if not body or len(body) < 1 + 2 * body[0]:
                raise Corrupt("scan header")
            parts = []
            for k in range(1, 1 + 2 * body[0], 2):
                c = next((c for c in frame if c.id == body[k]), None)
                tables = body[k + 1]
                if c is None or (tables >> 4) not in huffman or 0x10 + (tables & 15) not in huffman:
                    raise Corrupt("scan header")
                c.dc, c.ac = huffman[tables >> 4], huffman[0x10 + (tables & 15)]
                parts.append(c)
                seen.add(c.id)
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    end = len(data)
                    break
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                elif data[end + 1] == 0xFF:
                    end += 1
                else:
                    break
            single = len(parts) == 1
            across, down = (parts[0].across, parts[0].down) if single else (mcus_across, mcus_down)
            _decode(data[at:end], parts, single, across * down, across, restart)
            at = end
            if frame[0].id in seen:
                break  # the rest is colour
    if not frame or frame[0].id not in seen:
        raise Corrupt("no luminance scan")
    c = frame[0]
    if c.quant not in quant:
        raise Corrupt("no quantisation table")
    level = c.values[: c.down, : c.across] * quant[c.quant]
    return width, height, len(frame), np.clip((level + 4 * 257) // 8, 0, 255).astype(np.uint8)


def difference_hash(thumb: np.ndarray) -> int:
    """64 bits: is a cell of a 9 x 8 grid over the thumbnail brighter than the one to its left?"""
    y = np.arange(8) * thumb.shape[0] // 8
    x = np.arange(9) * thumb.shape[1] // 9
    grid = thumb[y][:, x].astype(np.int16)
    return int.from_bytes(np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes(), "big", signed=True)


def media_columns(media: DataFrame, id_column: str = "media_id", data_column: str = "data") -> DataFrame:
    """media_id, status, width, height, components, thumb_width, thumb_height,
    thumb (a byte a cell, in rows), thumb_md5 and thumb_dhash of every row.

    status is "ok", "missing" (null), "empty", "unsupported" (a JPEG that isn't
    baseline) or "corrupt"; the other columns are null unless it is "ok". A
    null id is carried along, repeated rows are decoded one by one, and pictures
    of any size are decoded whole. Other
    columns aren't looked at; an empty table gives an empty result."""
    rows = Rows(media)
    asked = rows.df.select(rows[id_column].cast("long").alias("media_id"), rows[data_column].cast("binary").alias("data"))
    fields = [("media_id", pa.int64()), ("status", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("components", pa.int32()), ("thumb_width", pa.int32()), ("thumb_height", pa.int32()), ("thumb", pa.binary()), ("thumb_md5", pa.string()), ("thumb_dhash", pa.int64())]

    def one(data: bytes | None) -> tuple:
        none = (None,) * 8
        if not data:
            return ("missing" if data is None else "empty", *none)
        try:
            width, height, components, thumb = decode(data)
        except Unsupported:
            return ("unsupported", *none)
        except Corrupt:
            return ("corrupt", *none)
        raw = thumb.tobytes()
        return ("ok", width, height, components, thumb.shape[1], thumb.shape[0], raw, hashlib.md5(raw, usedforsecurity=False).hexdigest(), difference_hash(thumb))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(x) for x in batch.column("data").to_pylist()]
            columns = [batch.column("media_id"), *(pa.array([r[i] for r in got], kind) for i, (_, kind) in enumerate(fields[1:]))]
            yield pa.RecordBatch.from_arrays(columns, [n for n, _ in fields])

    return asked.mapInArrow(run, "media_id long, status string, width int, height int, components int, thumb_width int, thumb_height int, thumb binary, thumb_md5 string, thumb_dhash long")


# --- encoding ---------------------------------------------------------------

_QUANT = np.array([16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99])  # ITU T.81, table K.1
_DCT = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: code lengths for symbols in this order; any complete prefix code serves
_DC_CODE = (bytes([0, 0, 7, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0]), bytes([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]))
_AC_SYMBOLS = bytes([0, 0xF0, *(r * 16 + s for r in range(16) for s in range(1, 11))])
_AC_CODE = (bytes([0, 1, 0, 0, 0, 0, 0, 80, 81, 0, 0, 0, 0, 0, 0, 0]), bytes([0, *sorted(_AC_SYMBOLS[1:], key=lambda x: ((x >> 4) + 2 * (x & 15), x))]))


def _codes(table: tuple[bytes, bytes]) -> dict[int, tuple[int, int]]:
    out, code, k = {}, 0, 0
    for bits in range(1, 17):
        for _ in range(table[0][bits - 1]):
            out[table[1][k]] = (code, bits)
            code += 1
            k += 1
        code <<= 1
    return out


_DC, _AC = _codes(_DC_CODE), _codes(_AC_CODE)
_DC_BITS, _AC_BITS = (np.array([table.get(i, (0, 0)) for i in range(256)], np.int64) for table in (_DC, _AC))


def _scans(coefficients: np.ndarray, per: int) -> list[bytes]:
    """Entropy-coded blocks, rows of 64 coefficients in zigzag order, as runs of
    ``per`` blocks that can be decoded by themselves, padded with ones and stuffed."""
    n = len(coefficients)
    dc = np.diff(coefficients[:, 0], prepend=0)
    dc[::per] = coefficients[::per, 0]
    block, at = np.nonzero(coefficients[:, 1:])
    value, at = coefficients[block, at + 1], at + 1
    same = np.concatenate([[False], block[1:] == block[:-1]])
    run = at - np.where(same, np.concatenate([[0], at[:-1]]), 0) - 1
    long = np.repeat(np.flatnonzero(run > 15), run[run > 15] // 16)  # zero runs of sixteen
    open_ = np.ones(n, bool)
    open_[block[at == 63]] = False
    ends = np.flatnonzero(open_)
    size = lambda v: np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)  # bit length
    none = lambda x: np.zeros(len(x), np.int64)
    dc_size, ac_size = size(dc), size(value)
    tokens = [  # order, code and its bits, value and its bits
        (np.arange(n) * 66, *_DC_BITS[dc_size].T, dc, dc_size),
        (block[long] * 66 + at[long], *_AC_BITS[none(long) + 0xF0].T, none(long), none(long)),
        (block * 66 + at, *_AC_BITS[run % 16 * 16 + ac_size].T, value, ac_size),
        (ends * 66 + 64, *_AC_BITS[none(ends)].T, none(ends), none(ends)),
    ]
    order, code, bits, value, sizes = (np.concatenate(x) for x in zip(*tokens))
    bits += sizes
    filled = np.bincount(order // 66 // per, bits, -(-n // per)).astype(np.int64)
    pad = -filled % 8
    order = np.concatenate([order, np.minimum(np.arange(1, len(pad) + 1) * per, n) * 66 - 1])
    whole = np.concatenate([(code << sizes) | np.where(value >= 0, value, value + (1 << sizes) - 1), (1 << pad) - 1])
    bits = np.concatenate([bits, pad])
    turn = np.argsort(order, kind="stable")
    whole, bits = whole[turn], bits[turn]
    end = np.cumsum(bits)
    each = np.repeat(np.arange(len(bits)), bits)
    out = np.packbits(((whole[each] >> (end[each] - 1 - np.arange(end[-1]))) & 1).astype(np.uint8)).tobytes()
    cuts = np.concatenate([[0], np.cumsum((filled + pad) // 8)]).tolist()
    return [out[i:j].replace(b"\xff", b"\xff\x00") for i, j in zip(cuts, cuts[1:])]


def encode(grey: np.ndarray, quality: int = 75, restart: int = 0) -> bytes:
    """A grey picture, uint8 rows, as baseline JPEG."""
    return encode_all(grey[None], quality, restart)[0]


def encode_all(grey: np.ndarray, quality: int = 75, restart: int = 0) -> list[bytes]:
    """Grey pictures of one size, (pictures, rows, columns) of uint8, each as baseline JPEG."""
    count, height, width = grey.shape
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    quant = np.clip((_QUANT * scale + 50) // 100, 1, 255)
    padded = np.pad(grey, ((0, 0), (0, -height % 8), (0, -width % 8)), mode="edge").astype(np.float64) - 128
    tiles = padded.reshape(count, padded.shape[1] // 8, 8, -1, 8).swapaxes(2, 3).reshape(-1, 8, 8)
    coefficients = np.rint((_DCT @ tiles @ _DCT.T).reshape(-1, 64) / quant).astype(np.int64)[:, ZIGZAG]
    blocks = len(coefficients) // count
    if restart:
        scans = [b"".join(s + bytes([0xFF, 0xD0 + i % 8]) for i, s in enumerate(_scans(own, restart)))[:-2] for own in coefficients.reshape(count, blocks, 64)]
    else:
        scans = _scans(coefficients, blocks)
    part = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    head = b"\xff\xd8" + part(0xDB, b"\0" + bytes(quant[ZIGZAG].astype(np.uint8)))
    head += part(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0")
    head += part(0xC4, b"\0" + b"".join(_DC_CODE)) + part(0xC4, b"\x10" + b"".join(_AC_CODE))
    if restart:
        head += part(0xDD, struct.pack(">H", restart))
    return [head + part(0xDA, b"\1\1\0\0\x3f\0") + scan + b"\xff\xd9" for scan in scans]


def embedding_media(embeddings: DataFrame) -> DataFrame:
    """media_id and data: each embedding drawn as a JPEG, a row of blocks for
    eight numbers, from -3 (black) to 3 (white), with a ramp inside each block.
    It stands in for a table of media, which the test data has none of. A null
    or empty embedding has no picture; of a very long one the picture is as
    tall. Null ids are carried along, repeated rows are drawn one by one, other columns aren't
    looked at, and an empty table gives an empty one."""
    rows = Rows(embeddings)
    asked = rows.df.select(rows["vec_id"].cast("long").alias("media_id"), rows["embedding"].cast("array<float>").alias("e"))
    ramp = np.tile(np.linspace(-8, 8, 8), (8, 1))

    def draw(some: np.ndarray) -> list[bytes]:
        """Pictures of embeddings of one length, rows of numbers."""
        v = np.nan_to_num(np.pad(some, ((0, 0), (0, -some.shape[1] % 8))).reshape(len(some), -1, 8))
        level = np.clip((v + 3) / 6 * 255, 0, 255)
        return encode_all(np.clip(np.rint(np.kron(level, np.ones((1, 8, 8))) + np.tile(ramp, v.shape[1:])), 0, 255).astype(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                values = part.column("e").to_pylist()
                data: list[bytes | None] = [None] * len(values)
                for n in {len(x) for x in values if x}:
                    at = [i for i, x in enumerate(values) if x and len(x) == n]
                    for i, drawn in zip(at, draw(np.array([[np.nan if y is None else y for y in values[i]] for i in at], np.float64))):
                        data[i] = drawn
                yield pa.RecordBatch.from_arrays([part.column("media_id"), pa.array(data, pa.binary())], ["media_id", "data"])

    return asked.mapInArrow(run, "media_id long, data binary")
