"""Progressive JPEG: a numpy decoder for coefficient scans, and a writer that stores bytes as coefficients.

Decoder
    ``decode`` collects every scan of a progressive file (spectral selection and successive approximation,
    restart intervals included) in one coefficient array per component.  ``to_rgb`` multiplies the arrays by the
    quantisers, inverse-transforms them with one exact integer-valued matrix product, upsamples the chroma planes to
    full resolution and converts to RGB.

Writer
    ``encode_payload`` keeps one payload byte in each quantised coefficient: a coefficient of size category 8 has
    exactly 256 values and its eight amplitude bits are the byte.  All quantisers are 1, so nothing is lost.  Blocks go
    to a 4:2:0 picture (four luma, two chroma blocks per unit), written as nine scans: DC at reduced precision and its
    refinement, AC at reduced precision (luma in two spectral bands) and one AC refinement for each component.

Where a scan has the same symbol for each coefficient, the scan is read with array operations; the check for that is
exact, and any other scan takes the bit-by-bit path.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_SCALE = 13


def _basis() -> np.ndarray:
    """Row k: the 64 samples of zigzag coefficient k, times 2**13, as whole numbers (so sums in float64 are exact)."""
    x = np.arange(8)
    c = np.where(x == 0, np.sqrt(0.125), 0.5)
    one = c[:, None] * np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16)
    full = np.einsum("uy,vx->uvyx", one, one).reshape(64, 64)[_ZIGZAG]
    return np.rint(full * (1 << _SCALE))


_BASIS = _basis()


def huffman_codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length) for a table in the file format's form."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Table:
    def __init__(self, counts, symbols):
        self.codes = huffman_codes(counts, symbols)
        self._look = None

    @property
    def look(self) -> list:
        """For each 16-bit prefix: length << 8 | symbol, or 0."""
        if self._look is None:
            table = np.zeros(1 << 16, dtype=np.int32)
            for s, (code, n) in self.codes.items():
                table[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
            self._look = table.tolist()
        return self._look


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data + b"\xff\xff\xff\xff", 0

    def peek(self) -> int:
        i = self.at >> 3
        d = self.data
        if i + 3 > len(d):
            raise ValueError("scan data ends early")
        return ((d[i] << 16 | d[i + 1] << 8 | d[i + 2]) >> (8 - (self.at & 7))) & 0xFFFF

    def symbol(self, look) -> int:
        v = look[self.peek()]
        if not v:
            raise ValueError("unknown code in scan data")
        self.at += v >> 8
        return v & 255

    def take(self, n: int) -> int:
        if not n:
            return 0
        v = self.peek() >> (16 - n)
        self.at += n
        return v


def _signed(v: int, size: int) -> int:
    return v if not size or v >> (size - 1) else v - (1 << size) + 1


@lru_cache
def _amplitudes(size: int, low: int) -> np.ndarray:
    """The coefficient that the last ``size`` bits of each byte stand for."""
    return np.array([_signed(v & ((1 << size) - 1), size) * (1 << low) for v in range(256)], dtype=np.int32)


class Picture:
    """Coefficients (zigzag order, one array of blocks for each component) and what is needed to turn them into RGB."""

    def __init__(self):
        self.quant, self.dc, self.ac, self.parts, self.restart, self.comment = {}, {}, {}, [], 0, b""
        self.width = self.height = 0

    def frame(self, body: bytes) -> None:
        self.height, self.width, n = struct.unpack(">HHB", body[1:6])
        parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        self.hmax, self.vmax = max(p[1] for p in parts), max(p[2] for p in parts)
        self.mcus = (-(-self.height // (8 * self.vmax)), -(-self.width // (8 * self.hmax)))
        for ident, h, v, q in parts:
            own = (-(-(-(-self.height * v // self.vmax)) // 8), -(-(-(-self.width * h // self.hmax)) // 8))
            grid = np.zeros((self.mcus[0] * v, self.mcus[1] * h, 64), dtype=np.int32)
            self.parts.append({"id": ident, "h": h, "v": v, "q": q, "own": own, "c": grid})

    def order(self, chosen: list[dict]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each component of a scan: rows and columns of its blocks, in the order of the scan's units."""
        if len(chosen) == 1:
            rows, cols = chosen[0]["own"]
            return [np.divmod(np.arange(rows * cols), cols)]
        return [_unit_order(*self.mcus, p["v"], p["h"]) for p in chosen]


@lru_cache(maxsize=512)
def _unit_order(rows: int, cols: int, v: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    row, col = np.divmod(np.arange(rows * cols), cols)
    inner_row, inner_col = np.divmod(np.arange(v * h), h)
    return (row[:, None] * v + inner_row).reshape(-1), (col[:, None] * h + inner_col).reshape(-1)


def _dc_scan(pic: Picture, chosen, tables, high: int, low: int, parts: list[bytes]) -> None:
    orders, per = pic.order(chosen), [1 if len(chosen) == 1 else p["h"] * p["v"] for p in chosen]
    units = len(orders[0][0]) // per[0]
    step = pic.restart or units
    for k, data in enumerate(parts):
        n = min(step, units - k * step)
        if high:
            bits = np.unpackbits(np.frombuffer(data, np.uint8))[: n * sum(per)].reshape(n, sum(per)).astype(np.int32)
            at = 0
            for p, o, m in zip(chosen, orders, per, strict=True):
                own = slice(k * step * m, (k * step + n) * m)
                p["c"][o[0][own], o[1][own], 0] |= bits[:, at : at + m].reshape(-1) << low
                at += m
            continue
        src = _Bits(data)
        found = [[] for _ in chosen]
        last = [0] * len(chosen)
        plan = [(i, tables[i].look) for i, m in enumerate(per) for _ in range(m)]
        d, at, end = src.data, 0, len(src.data) - 3
        for _ in range(n):
            for i, look in plan:
                b = at >> 3
                if b > end:
                    raise ValueError("scan data ends early")
                v = look[((d[b] << 16 | d[b + 1] << 8 | d[b + 2]) >> (8 - (at & 7))) & 0xFFFF]
                if not v:
                    raise ValueError("unknown code in scan data")
                at += v >> 8
                size = v & 255
                if size:
                    b = at >> 3
                    x = ((d[b] << 16 | d[b + 1] << 8 | d[b + 2]) >> (24 - size - (at & 7))) & ((1 << size) - 1)
                    at += size
                    last[i] += x if x >> (size - 1) else x - (1 << size) + 1
                found[i].append(last[i])
        for p, o, m, values in zip(chosen, orders, per, found, strict=True):
            own = slice(k * step * m, (k * step + n) * m)
            p["c"][o[0][own], o[1][own], 0] = np.array(values, dtype=np.int32) << low


def _ac_first(blocks: np.ndarray, table: _Table, first: int, last: int, low: int, data: bytes) -> None:
    width = last - first + 1
    if len(data) == len(blocks) * width > 0:
        got = table.look[data[0] << 8]
        size = got & 15
        if got and not got >> 4 & 15 and size and (got >> 8) + size == 8:
            raw = np.frombuffer(data, np.uint8)
            if raw.min() >> size == raw.max() >> size:
                blocks[:, first : last + 1] = _amplitudes(size, low)[raw].reshape(-1, width)
                return
    src, run, look = _Bits(data), 0, table.look
    for block in blocks:
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            s = src.symbol(look)
            r, size = s >> 4, s & 15
            if size:
                k += r
                block[k] = _signed(src.take(size), size) * (1 << low)
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + src.take(r) - 1
                break


def _ac_refine(blocks: np.ndarray, table: _Table, first: int, last: int, low: int, data: bytes) -> None:
    width, part = last - first + 1, blocks[:, first : last + 1]
    code = table.codes.get(0)
    if code and len(data) * 8 - 7 <= len(blocks) * (code[1] + width) <= len(data) * 8 and part.all():
        bits = np.unpackbits(np.frombuffer(data, np.uint8))[: len(blocks) * (code[1] + width)].reshape(len(blocks), -1)
        if (bits[:, : code[1]] == [code[0] >> (code[1] - 1 - i) & 1 for i in range(code[1])]).all():
            part += np.sign(part) * (bits[:, code[1] :].astype(np.int32) << low)
            return
    src, run, look, one = _Bits(data), 0, table.look, 1 << low

    def correct(block, k):
        if src.take(1):
            block[k] += one if block[k] > 0 else -one

    for block in blocks:
        k = first
        if not run:
            while k <= last:
                s = src.symbol(look)
                r, size, new = s >> 4, s & 15, 0
                if size:
                    new = one if src.take(1) else -one
                elif r < 15:
                    run = (1 << r) + src.take(r)
                    break
                while k <= last:
                    if block[k]:
                        correct(block, k)
                    elif r == 0:
                        if new:
                            block[k] = new
                        k += 1
                        break
                    else:
                        r -= 1
                    k += 1
        if run:
            for j in range(k, last + 1):
                if block[j]:
                    correct(block, j)
            run -= 1


def decode(data: bytes) -> Picture:
    """All scans of a progressive file, collected in coefficient arrays.  Raises ``ValueError`` for any other file."""
    pic, at = Picture(), 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while at + 4 <= len(data):
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        if kind == 0xD9:
            break
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                pic.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                counts = list(body[1:17])
                n = sum(counts)
                (pic.ac if body[0] >> 4 else pic.dc)[body[0] & 15] = _table(tuple(counts), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif kind == 0xC2:
            pic.frame(body)
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a progressive file")
        elif kind == 0xDD:
            pic.restart = int.from_bytes(body[:2], "big")
        elif kind == 0xFE:
            pic.comment = bytes(body)
        elif kind == 0xDA:
            found = _NEXT_MARKER.search(data, at)
            end = found.start() if found else len(data)
            raw = data[at:end]
            pieces = _RESTART.split(raw) if pic.restart else [raw]
            _scan(pic, body, [p.replace(b"\xff\x00", b"\xff") for p in pieces])
            at = end
    return pic


_TABLES: dict = {}


def _table(counts: tuple, symbols: bytes) -> _Table:
    if len(_TABLES) > 64:
        _TABLES.clear()
    if (counts, symbols) not in _TABLES:
        _TABLES[counts, symbols] = _Table(list(counts), list(symbols))
    return _TABLES[counts, symbols]


def _scan(pic: Picture, body: bytes, pieces: list[bytes]) -> None:
    n = body[0]
    by_id = {p["id"]: p for p in pic.parts}
    chosen = [by_id[body[1 + 2 * i]] for i in range(n)]
    first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    if first == 0:
        _dc_scan(pic, chosen, [pic.dc.get(body[2 + 2 * i] >> 4) for i in range(n)], high, low, pieces)
        return
    part, table = chosen[0], pic.ac[body[2] & 15]
    rows, cols = part["own"]
    blocks = part["c"][:rows, :cols].reshape(-1, 64)
    step = pic.restart or len(blocks)
    for k, data in enumerate(pieces):
        (_ac_refine if high else _ac_first)(blocks[k * step : (k + 1) * step], table, first, last, low, data)
    part["c"][:rows, :cols] = blocks.reshape(rows, cols, 64)


def to_rgb(pic: Picture) -> np.ndarray:
    """Full-resolution picture, uint8, height x width x 3.  Whole-number arithmetic: equal files give equal bytes."""
    planes = []
    for p in pic.parts:
        rows, cols, _ = p["c"].shape
        flat = (p["c"] * pic.quant[p["q"]]).reshape(-1, 64).astype(np.float64) @ _BASIS
        px = np.clip(((flat.astype(np.int64) + (1 << (_SCALE - 1))) >> _SCALE) + 128, 0, 255).astype(np.int32)
        plane = px.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        plane = plane.repeat(pic.vmax // p["v"], 0).repeat(pic.hmax // p["h"], 1)
        planes.append(plane[: pic.height, : pic.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
    half = 1 << 15
    out = np.stack([y + 91881 * cr + half, y - 22554 * cb - 46802 * cr + half, y + 116130 * cb + half], 2) >> 16
    return np.clip(out, 0, 255).astype(np.uint8)


def pack_bits(codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """Codes of the given bit lengths, one after another, padded with ones and with stuffed zero bytes."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    which = np.repeat(np.arange(len(codes)), lengths)
    shift = ends[which] - 1 - np.arange(total)
    bits = np.ones(-(-total // 8) * 8, dtype=np.uint8)
    bits[:total] = codes[which] >> shift & 1
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _huffman(kind: int, ident: int, by_length: dict[int, list[int]]) -> bytes:
    counts = bytes(len(by_length.get(n, [])) for n in range(1, 17))
    return _segment(0xC4, bytes([kind << 4 | ident]) + counts + bytes(s for n in sorted(by_length) for s in by_length[n]))


_SIZE = np.array([v.bit_length() for v in range(512)])
_HEAD = _segment(0xDB, b"\0" + b"\1" * 64)
_TABLES_OUT = _huffman(0, 0, {4: list(range(9))}) + _huffman(1, 0, {1: [0x07], 2: [0x00]}) + _huffman(1, 1, {1: [0x00], 2: [0x01]})


def _start(parts: list[tuple[int, int]], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(parts), *(x for p in parts for x in p), first, last, high << 4 | low]))


def encode_payload(payload: bytes) -> bytes:
    """A progressive file that holds ``payload`` (a positive multiple of 64 bytes) in its coefficients."""
    blocks = len(payload) // 64
    if not blocks or len(payload) % 64:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    units = -(-blocks // 6)
    wide = int(np.ceil(np.sqrt(units)))
    high = -(-units // wide)
    raw = np.zeros(high * wide * 384, dtype=np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    mcu = raw.reshape(high, wide, 6, 64)
    luma = mcu[:, :, :4].reshape(high, wide, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    planes = [luma, mcu[:, :, 4].reshape(-1, 64), mcu[:, :, 5].reshape(-1, 64)]
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _HEAD]
    out += [_segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), _TABLES_OUT]
    dc = mcu[:, :, :, 0].reshape(-1, 6).astype(np.int32)
    dc -= np.where(dc < 128, 255, 0)
    top = dc >> 1
    diff = np.empty_like(top)
    diff[:, :4] = np.diff(top[:, :4].reshape(-1), prepend=0).reshape(-1, 4)
    diff[:, 4:] = np.diff(top[:, 4:], axis=0, prepend=0)
    flat = diff.reshape(-1)
    size = _SIZE[np.abs(flat)]
    amp = np.where(flat < 0, flat + (1 << size) - 1, flat)
    every = [(1, 0x00), (2, 0x00), (3, 0x00)]
    out += [_start(every, 0, 0, 0, 1), pack_bits(size << size | amp, size + 4)]
    bits = (dc & 1).reshape(-1)
    out += [_start(every, 0, 0, 1, 0), pack_bits(bits, np.ones(len(bits), dtype=np.int64))]
    for ident, plane in enumerate(planes, 1):
        for a, b in ((1, 5), (6, 63)) if ident == 1 else ((1, 63),):
            out += [_start([(ident, 0)], a, b, 0, 1), (plane[:, a : b + 1] >> 1).tobytes()]
    for ident, plane in enumerate(planes, 1):
        low = np.zeros((len(plane), 64), dtype=np.uint8)
        low[:, 1:] = (plane[:, 1:] ^ (plane[:, 1:] < 128)) & 1
        out += [_start([(ident, 1)], 1, 63, 1, 0), np.packbits(low).tobytes().replace(b"\xff", b"\xff\x00")]
    return b"".join(out) + b"\xff\xd9"


def read_payload(pic: Picture) -> bytes:
    """The bytes that ``encode_payload`` stored."""
    high, wide = pic.mcus
    c = np.empty((high, wide, 6, 64), dtype=np.int32)
    c[:, :, :4] = pic.parts[0]["c"].reshape(high, 2, wide, 2, 64).transpose(0, 2, 1, 3, 4).reshape(high, wide, 4, 64)
    c[:, :, 4], c[:, :, 5] = pic.parts[1]["c"], pic.parts[2]["c"]
    n = int(pic.comment.split()[1])
    return np.where(c < 0, c + 255, c).astype(np.uint8).reshape(-1)[:n].tobytes()
