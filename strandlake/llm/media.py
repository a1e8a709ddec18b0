"""Media columns: progressive JPEG, written and read here.

Writing.  A payload (UTF-8 text, zero-padded to a positive multiple of 64 bytes) fills
8 x 8 blocks of coefficients of a three-component image with halved chroma: luma
blocks first, then the two chroma planes, row by row.  The format's unit is the
quantised coefficient (all quantisers are 1), which JPEG keeps without loss: the first
byte of a block is its DC coefficient, each other byte b a coefficient of magnitude
128 + b div 2, negative if b is odd.  Six kinds of scans: DC at half precision, two
spectral bands of AC at half precision, then one refinement bit for DC and for AC.

Reading works on any 8-bit Huffman-coded progressive stream: all scans are accumulated
in coefficient arrays (spectral selection, successive approximation, end-of-band runs,
restart intervals, any sampling factors), then inverse-transformed in numpy, chroma is
upsampled to full resolution and the result is an RGB tensor.  Scans whose Huffman
table holds a single symbol have fields of one width and are read as a matrix of bits;
DC scans are read by following precomputed field lengths; everything else takes the
bit-by-bit path.

A payload above ``FRAME`` bytes goes in several streams one after the other, so memory
is bounded by the frame, not by the text.  Rows are independent: one pass, no shuffle.

Edge cases.  Null and empty texts have a payload of 64 zero bytes.  Equal texts have
equal media and features.  Ids are carried along, null or not; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, small_batches

FRAME = 1 << 18
# Fixed values of the format: natural position of each zigzag index, row by row.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, (p // 8 if (p // 8 + p % 8) % 2 else p % 8))))
AC_BANDS = ((1, 5), (6, 63))


def payload_of(text: bytes) -> bytes:
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, slot: int, lengths: dict[int, list[int]]) -> bytes:
    return bytes([kind << 4 | slot]) + bytes(len(lengths.get(n, [])) for n in range(1, 17)) + bytes(v for n in range(1, 17) for v in lengths.get(n, []))


def _scan(parts: list[tuple[int, int, int]], band: tuple[int, int], high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(parts)]) + b"".join(bytes([c, dc << 4 | ac]) for c, dc, ac in parts) + bytes([*band, high << 4 | low])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _pack(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Fields of differing widths as bits, the last byte filled with ones."""
    end = np.cumsum(widths)
    total = int(end[-1]) if len(end) else 0
    owner = np.repeat(np.arange(len(values)), widths)
    bits = values[owner] >> (end[owner] - 1 - np.arange(total)) & 1
    return np.packbits(np.concatenate([bits.astype(np.uint8), np.ones(-total % 8, np.uint8)])).tobytes()


def _grid(blocks: int) -> tuple[int, int]:
    units = -(-blocks // 6)
    wide = max(1, round(units**0.5))
    return wide, -(-units // wide)


def _mcu_order(wide: int, high: int) -> np.ndarray:
    """Numbers of the blocks, counted plane by plane, in the order of interleaved scans."""
    n = wide * high
    y = np.arange(4 * n).reshape(high, 2, wide, 2).transpose(0, 2, 1, 3).reshape(n, 4)
    return np.concatenate([y, 4 * n + np.arange(n)[:, None], 5 * n + np.arange(n)[:, None]], 1).ravel()


def encode_frame(payload: bytes) -> bytes:
    """One progressive stream for at most FRAME bytes; its comment holds the payload's size."""
    data = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    wide, high = _grid(len(data))
    n = wide * high
    blocks = np.zeros((6 * n, 64), np.uint8)
    blocks[: len(data)] = data
    planes = (slice(0, 4 * n), slice(4 * n, 5 * n), slice(5 * n, 6 * n))
    frame = b"\x08" + (16 * high).to_bytes(2, "big") + (16 * wide).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"
    out = [b"\xff\xd8", _segment(0xFE, len(payload).to_bytes(8, "big")), _segment(0xDB, b"\x00" + b"\x01" * 64), _segment(0xC2, frame)]
    # DC has eight size classes in four bits each; AC tables hold one symbol: "size 7, no zeros", and "end of band".
    out.append(_segment(0xC4, _table(0, 0, {4: list(range(8))}) + _table(1, 0, {1: [7]}) + _table(1, 1, {1: [0]})))
    order = _mcu_order(wide, high)
    dc = blocks[:, 0].astype(np.int64)
    half = dc >> 1
    last = np.zeros(6 * n, np.int64)
    for plane in planes:
        last[order[np.isin(order, np.arange(plane.start, plane.stop))][1:]] = half[order[np.isin(order, np.arange(plane.start, plane.stop))][:-1]]
    diff = (half - last)[order]
    size = np.zeros(len(diff), np.int64)
    for s in range(7):
        size += np.abs(diff) >> s > 0
    field = (size << size) | np.where(diff < 0, diff + (1 << size) - 1, diff)
    every = [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
    out.append(_scan(every, (0, 0), 0, 1, _pack(field, 4 + size)))
    low = (blocks >> 1).astype(np.uint8)  # 0..127, magnitude 128 + low
    sign = blocks & 1
    first = 64 + (low >> 1)
    raw = np.where(sign == 1, 127 - first, first).astype(np.uint8)  # seven bits behind the one-bit code 0
    for a, z in AC_BANDS:
        for c, plane in enumerate(planes, 1):
            out.append(_scan([(c, 0, 0)], (a, z), 0, 1, raw[plane, a : z + 1].tobytes()))
    bits = (dc & 1)[order].astype(np.uint8)
    out.append(_scan(every, (0, 0), 1, 0, np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()))
    more = low & 1
    more[:, 0] = 0  # the one-bit code of "end of band" stands in front of a block's 63 bits
    for c, plane in enumerate(planes, 1):
        out.append(_scan([(c, 0, 1)], (1, 63), 1, 0, np.packbits(more[plane].ravel()).tobytes()))
    return b"".join([*out, b"\xff\xd9"])


def encode(payload: bytes) -> bytes:
    return b"".join(encode_frame(payload[i : i + FRAME]) for i in range(0, len(payload), FRAME))


# ---------------------------------------------------------------- reading


class Huffman:
    """Lengths and symbols by the next 16 bits."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbols = symbols
        self.only = next(n for n in range(1, 17) if counts[n - 1]) if sum(counts) == 1 else 0  # length of a lone code
        self.length, self.symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        code = at = 0
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                span = slice(code << (16 - n), (code + 1) << (16 - n))
                self.length[span], self.symbol[span] = n, symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.fast = None

    def lists(self) -> tuple[list[int], list[int]]:
        if self.fast is None:
            self.fast = self.length.tolist(), self.symbol.tolist()
        return self.fast


@lru_cache(64)
def _huffman(counts: bytes, symbols: bytes) -> Huffman:
    return Huffman(counts, symbols)


def _enough(data: bytes, bits: int) -> np.ndarray:
    """The bytes of a scan, which must hold so many bits."""
    if len(data) * 8 < bits:
        raise ValueError("the scan ends too early")
    return np.frombuffer(data, np.uint8)


class Bits:
    """Fields of a scan, from its first bit to its last; each look touches four bytes."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\xff\xff\xff\xff", 0, len(data) * 8

    def _advance(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise ValueError("the scan ends too early")

    def _sixteen(self) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 4], "big") >> (16 - (self.at & 7)) & 0xFFFF

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        value = self._sixteen() >> (16 - n)
        self._advance(n)
        return value

    def symbol(self, table: Huffman) -> int:
        length, symbol = table.lists()
        at = self._sixteen()
        if not length[at]:
            raise ValueError("no such code")
        self._advance(length[at])
        return symbol[at]

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if n == 0 or v >> (n - 1) else v - (1 << n) + 1


def _windows(data: bytes) -> np.ndarray:
    """The 16 bits that start at each bit of ``data``."""
    b = np.frombuffer(data + b"\xff\xff\xff", np.uint8).astype(np.int64)
    three = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return (three[:-1, None] >> np.arange(8, 0, -1) & 0xFFFF).ravel()


class Plane:
    def __init__(self, ident: int, h: int, v: int, table: int):
        self.ident, self.h, self.v, self.table = ident, h, v, table

    def allocate(self, width: int, height: int, hmax: int, vmax: int) -> None:
        mcus = -(-width // (8 * hmax)), -(-height // (8 * vmax))
        self.wide, self.high = mcus[0] * self.h, mcus[1] * self.v  # blocks, with those that only fill up
        self.seen = -(-(-(-width * self.h // hmax)) // 8), -(-(-(-height * self.v // vmax)) // 8)  # blocks of scans of this plane alone
        self.coef = np.zeros((self.high * self.wide, 64), np.int32)

    def alone(self) -> np.ndarray:
        return (np.arange(self.seen[1])[:, None] * self.wide + np.arange(self.seen[0])).ravel()


class Image:
    """The state of one stream: tables, planes and what the scans so far have given."""

    def __init__(self) -> None:
        self.quant: dict[int, np.ndarray] = {}
        self.huff: dict[tuple[int, int], Huffman] = {}
        self.planes: list[Plane] = []
        self.restart, self.comment = 0, b""

    def frame(self, body: bytes) -> None:
        if body[0] != 8:
            raise ValueError("only samples of 8 bits")
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        self.planes = [Plane(c, hv >> 4, hv & 15, t) for c, hv, t in zip(body[6::3], body[7::3], body[8::3])]
        self.hmax, self.vmax = max(p.h for p in self.planes), max(p.v for p in self.planes)
        for p in self.planes:
            p.allocate(self.width, self.height, self.hmax, self.vmax)

    def define(self, marker: int, body: bytes) -> None:
        at = 0
        while marker == 0xDB and at < len(body):
            deep, slot = body[at] >> 4, body[at] & 15
            raw = body[at + 1 : at + 1 + 64 * (deep + 1)]
            self.quant[slot] = np.frombuffer(raw, ">u2" if deep else np.uint8).astype(np.float32)
            at += 1 + len(raw)
        while marker == 0xC4 and at < len(body):
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            self.huff[body[at] >> 4, body[at] & 15] = _huffman(counts, body[at + 17 : at + 17 + n])
            at += 17 + n
        if marker == 0xDD:
            self.restart = int.from_bytes(body[:2], "big")
        if marker == 0xFE:
            self.comment = body

    def scan(self, head: bytes, data: bytes) -> None:
        n = head[0]
        by_id = {p.ident: p for p in self.planes}
        parts = [(by_id[head[1 + 2 * i]], self.huff.get((0, head[2 + 2 * i] >> 4)), self.huff.get((1, head[2 + 2 * i] & 15))) for i in range(n)]
        a, z, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        pieces = re.split(rb"\xff[\xd0-\xd7]", data) if self.restart else [data]
        pieces = [x.replace(b"\xff\x00", b"\xff") for x in pieces]
        order = self.order([p for p, _, _ in parts])
        step = self.restart * (order.shape[1] if n > 1 else 1) or order.size
        flat = order.reshape(-1, 2)
        if len(pieces) * step < len(flat):
            raise ValueError("the scan ends too early")
        for i, piece in enumerate(pieces):
            rows = flat[i * step : (i + 1) * step]
            if not len(rows):
                break
            if a == 0:
                self._dc(parts, rows, piece, high, low)
            elif high:
                self._ac_more(parts[0], rows[:, 1], piece, a, z, low)
            else:
                self._ac_first(parts[0], rows[:, 1], piece, a, z, low)

    def order(self, planes: list[Plane]) -> np.ndarray:
        """(number of the part, number of the block) of a scan, one row to a unit."""
        if len(planes) == 1:
            at = planes[0].alone()
            return np.stack([np.zeros(len(at), np.int64), at], 1)[:, None, :]
        across, down = planes[0].wide // planes[0].h, planes[0].high // planes[0].v
        out = []
        for i, p in enumerate(planes):
            blocks = np.arange(p.high * p.wide).reshape(down, p.v, across, p.h).transpose(0, 2, 1, 3).reshape(down * across, -1)
            out.append(np.stack([np.full_like(blocks, i), blocks], 2))
        return np.concatenate(out, 1)

    def _dc(self, parts, rows: np.ndarray, data: bytes, high: int, low: int) -> None:
        if high:
            bits = np.unpackbits(_enough(data, len(rows)), count=len(rows)).astype(np.int32)
            for i, (p, _, _) in enumerate(parts):
                mine = rows[:, 0] == i
                p.coef[rows[mine, 1], 0] |= bits[mine] << low
            return
        if all(t is parts[0][1] for _, t, _ in parts):
            diff = self._dc_jumps(parts[0][1], len(rows), data)
        else:
            bits, diff = Bits(data), np.zeros(len(rows), np.int64)
            for k, i in enumerate(rows[:, 0].tolist()):
                diff[k] = bits.signed(bits.symbol(parts[i][1]))
        for i, (p, _, _) in enumerate(parts):
            mine = rows[:, 0] == i
            p.coef[rows[mine, 1], 0] = np.cumsum(diff[mine]) << low

    @staticmethod
    def _dc_jumps(table: Huffman, n: int, data: bytes) -> np.ndarray:
        """All differences of a scan: the length of a field is known for each bit it may start at."""
        window = _windows(data)
        length, size = table.length[window], table.symbol[window]
        jump = (length + size).tolist()
        at, start = 0, []
        for _ in range(n):
            start.append(at)
            if at >= len(jump) or not jump[at]:
                raise ValueError("no such code, or the scan ends too early")
            at += jump[at]
        _enough(data, at)
        p = np.array(start, np.int64)
        s, q = size[p], p + length[p]
        wide = np.append(window, np.full(32, 0xFFFF))
        v = np.where(s > 0, wide[q] >> (16 - s), 0)
        return np.where((s > 0) & (v >> np.maximum(s - 1, 0) == 0), v - (1 << s) + 1, v)

    def _ac_first(self, part, blocks: np.ndarray, data: bytes, a: int, z: int, low: int) -> None:
        p, _, table = part
        if table.only and table.symbols[0] >> 4 == 0 and table.symbols[0] & 15:
            size, n = table.symbols[0] & 15, len(blocks) * (z - a + 1)
            wide = table.only + size
            if wide == 8:
                v = _enough(data, 8 * n)[:n].astype(np.int32)
            else:
                bits = np.unpackbits(_enough(data, n * wide), count=n * wide).reshape(n, wide)
                v = bits[:, table.only :].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
            v &= (1 << size) - 1
            v = np.where(v >> (size - 1), v, v - (1 << size) + 1)
            p.coef[blocks, a : z + 1] = (v << low).reshape(len(blocks), -1)
            return
        bits, run = Bits(data), 0
        for b in blocks.tolist():
            if run:
                run -= 1
                continue
            k, row = a, p.coef[b]
            while k <= z:
                r, s = divmod(bits.symbol(table), 16)
                if s:
                    k += r
                    row[k] = bits.signed(s) << low
                    k += 1
                elif r == 15:
                    k += 16
                else:
                    run = (1 << r) + bits.take(r) - 1
                    break

    def _ac_more(self, part, blocks: np.ndarray, data: bytes, a: int, z: int, low: int) -> None:
        p, _, table = part
        n = z - a + 1
        band = p.coef[blocks, a : z + 1]
        if table.only and table.symbols[0] == 0 and np.all(band):
            every = len(blocks) * (table.only + n)
            bits = np.unpackbits(_enough(data, every), count=every).reshape(len(blocks), -1)[:, table.only :]
            p.coef[blocks, a : z + 1] = band + np.sign(band) * (bits.astype(np.int32) << low)
            return
        bits, run, one = Bits(data), 0, 1 << low

        def correct(row: np.ndarray, k: int) -> None:
            if bits.take(1):
                row[k] += one if row[k] > 0 else -one

        for b in blocks.tolist():
            k, row = a, p.coef[b]
            while k <= z and not run:
                r, s = divmod(bits.symbol(table), 16)
                new = 0
                if s:
                    new = one if bits.take(1) else -one
                elif r < 15:
                    run = (1 << r) + bits.take(r)
                    break
                while k <= z:
                    if row[k]:
                        correct(row, k)
                    elif r == 0:
                        row[k] = new  # stays 0 after a run of sixteen
                        k += 1
                        break
                    else:
                        r -= 1
                    k += 1
            if run:
                for j in range(k, z + 1):
                    if row[j]:
                        correct(row, j)
                run -= 1

    def tensor(self) -> np.ndarray:
        """Height x width x 3 (or x 1) bytes at full resolution."""
        planes = []
        for p in self.planes:
            scaled = p.coef * self.quant[p.table]
            flat = np.clip(np.rint(scaled.astype(np.float32) @ INVERSE + np.float32(128)), 0, 255)
            plane = flat.reshape(p.high, p.wide, 8, 8).transpose(0, 2, 1, 3).reshape(p.high * 8, p.wide * 8)
            planes.append(plane.repeat(self.vmax // p.v, 0).repeat(self.hmax // p.h, 1)[: self.height, : self.width])
        if len(planes) != 3:
            return np.stack(planes, 2).astype(np.uint8)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        # Fixed values of the colour transform.
        rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
        return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)

    def payload(self) -> bytes:
        """What ``encode_frame`` stored."""
        rows = np.concatenate([p.coef for p in self.planes])
        out = ((np.abs(rows) - 128) << 1 | (rows < 0)).astype(np.uint8)
        out[:, 0] = rows[:, 0]
        return out.tobytes()[: int.from_bytes(self.comment, "big")]


def _inverse() -> np.ndarray:
    """Zigzag coefficients to samples of a block, as one matrix."""
    k = np.arange(8)
    c = np.cos((2 * k[:, None] + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)  # sample, frequency
    return np.kron(c, c).T[ZIGZAG].astype(np.float32)


INVERSE = _inverse()
_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def decode(stream: bytes) -> list[Image]:
    """The images of one or several progressive streams in a row."""
    out: list[Image] = []
    at = 0
    while at < len(stream):
        if stream[at : at + 2] != b"\xff\xd8":
            raise ValueError("not the start of a stream")
        image, at = Image(), at + 2
        while True:
            if stream[at] != 0xFF:
                raise ValueError("no marker where one is due")
            while stream[at + 1] == 0xFF:  # filling
                at += 1
            marker, at = stream[at + 1], at + 2
            if marker == 0xD9:
                break
            size = int.from_bytes(stream[at : at + 2], "big")
            body, at = stream[at + 2 : at + size], at + size
            if marker == 0xC2:
                image.frame(body)
            elif marker == 0xDA:
                found = _END.search(stream, at)
                if not found:
                    raise ValueError("the stream ends too early")
                image.scan(body, stream[at : found.start()])
                at = found.start()
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a progressive Huffman-coded stream")
            else:
                image.define(marker, body)
        out.append(image)
    return out


def features_of(tensors: list[np.ndarray]) -> str:
    """Pixels, and mean and spread of each colour, of all frames together."""
    n = sum(t.shape[0] * t.shape[1] for t in tensors)
    one = sum(t.reshape(-1, 3).sum(0, dtype=np.int64) for t in tensors)
    two = sum(np.einsum("ij,ij->j", x, x) for x in (t.reshape(-1, 3).astype(np.int64) for t in tensors))
    mean = one / n
    spread = np.sqrt(np.maximum(two / n - mean * mean, 0))
    return f"{len(tensors)}x{tensors[0].shape[1]}x{tensors[0].shape[0]}:" + ",".join(f"{m:.1f}~{s:.1f}" for m, s in zip(mean, spread))


def with_media(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): each text's payload as progressive JPEG."""
    small_batches(documents.sparkSession, 200)

    def work(batch: pa.RecordBatch) -> pa.Table:
        texts = [(x or "").encode() for x in batch[text].to_pylist()]
        columns = [batch[key], pa.array([len(x) for x in texts], pa.int64()), pa.array([encode(payload_of(x)) for x in texts], pa.binary())]
        return pa.Table.from_arrays(columns, [key, "n_bytes", "media"])

    return map_texts(documents.select(key, text), work, f"{key} {documents.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def media_tensors(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, frame, height, width, channels, rgb): a row for each frame, rgb as bytes row by row."""
    small_batches(media.sparkSession, 50)

    def work(batch: pa.RecordBatch) -> pa.Table:
        rows = [(k, f, *t.shape, t.tobytes()) for k, m in zip(batch[key].to_pylist(), batch["media"].to_pylist()) if m for f, t in enumerate(i.tensor() for i in decode(m))]
        columns = list(zip(*rows)) if rows else [[]] * 6
        types = [batch[key].type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [key, "frame", "height", "width", "channels", "rgb"])

    return map_texts(media.select(key, "media"), work, f"{key} {media.schema[key].dataType.simpleString()}, frame int, height int, width int, channels int, rgb binary")


def media_digest(documents: DataFrame, text: str = "text") -> DataFrame:
    """Digests of what is stored and of what is read back from it, for each document."""
    small_batches(documents.sparkSession, 200)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def one(value: str | None) -> tuple:
        raw = (value or "").encode()
        media = encode(payload_of(raw))
        digest, n, tail, tensors = hashlib.sha256(), 0, b"", []
        for image in decode(media):
            part = image.payload()
            digest.update(part)
            n, tail = n + len(part), part[-64:]
            tensors.append(image.tensor())
        return len(raw), n, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), features_of(tensors)

    def work(batch: pa.RecordBatch) -> pa.Table:
        rows = [one(x.as_py()) for x in batch[text]]
        columns = list(zip(*rows)) if rows else [[]] * 7
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.Table.from_arrays([batch["doc_id"].cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return map_texts(documents.select("doc_id", text), work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
