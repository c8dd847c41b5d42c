"""Payloads in baseline JPEG files: written, parsed and decoded in numpy.

The unit of storage is the quantised coefficient: 64 bytes make a block of 8 x 8, each byte is one coefficient (-128 to -1 and
1 to 128) in zigzag order, the DC coefficient as the difference that baseline JPEG stores. Restart markers after every 16 blocks
make runs that can be decoded side by side: the decoder keeps one bit position for each run and takes a symbol of every
run in one step. It parses markers, quantisation and Huffman tables, and scans of any baseline JPEG of 8 bits (grey or
colour, any sampling); the DC-only luminance thumbnail has a pixel for each block.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm.common import slices

RUN = 16  # blocks between restart markers
WIDTH = 64  # blocks in a row of the picture, more if it would be too high
SIDE = 8191  # blocks of the longest side that the format's 16 bits can name
CHUNK = RUN * 1024  # blocks worked on at once: a multiple of 8 runs
#: Huffman code lengths of our files: DC categories 0-11 in 4 bits, AC sizes 0-8 without a run in 4 bits.
_DC = ([0, 0, 0, 12] + [0] * 12, list(range(12)))
_AC = ([0, 0, 0, 9] + [0] * 12, list(range(9)))


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of a magnitude of up to 11 bits."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _coefficients(raw: np.ndarray) -> np.ndarray:
    """Bytes as coefficients -128 to 128 without 0: a zero has no code of its own in a block."""
    return raw.astype(np.int64) - 128 + (raw >= 128)


def encode(payload: bytes) -> bytes:
    """A grey baseline JPEG that holds the payload (a positive multiple of 64 bytes)."""
    n = len(payload) // 64
    # a picture is whole rows of blocks; those added at its end have DC unchanged and all other coefficients 1
    wide = min(n, max(WIDTH, -(-n // SIDE)))
    high = -(-n // wide)
    raw, last = np.frombuffer(payload, np.uint8), _coefficients(np.frombuffer(payload, np.uint8, 1, 64 * (n - 1)))[0]
    # runs do not depend on each other, so that chunks of them are written one after the other
    scan = [_scan(raw[64 * at : 64 * (at + CHUNK)], min(CHUNK, wide * high - at), last) for at in range(0, wide * high, CHUNK)]
    tables = lambda cls, t: bytes([cls << 4]) + bytes(t[0]) + bytes(t[1])
    frame = bytes([8]) + (8 * high).to_bytes(2, "big") + (8 * wide).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    head = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, frame) + _segment(0xC4, tables(0, _DC)) + _segment(0xC4, tables(1, _AC))
    return head + _segment(0xDD, RUN.to_bytes(2, "big")) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + b"\xff\xd7".join(scan) + b"\xff\xd9"


def _scan(raw: np.ndarray, blocks: int, last: int) -> bytes:
    """Runs of the blocks that hold raw and of those added after them, with DC ``last``."""
    own = len(raw) // 64
    value = np.ones((blocks, 64), np.int64)
    value[:own] = _coefficients(raw).reshape(own, 64)
    value[own:, 0] = last
    heads = value[:, 0].copy()
    value[1:, 0] -= np.where(np.arange(1, blocks) % RUN == 0, 0, heads[:-1])
    flat = value.reshape(-1)
    size = _size(flat)
    low = np.where(flat < 0, flat + (1 << size) - 1, flat)
    bits, length = (size << size) | low, size + 4  # 4-bit codes are the sizes themselves: tables in natural order
    runs = -(-blocks // RUN)
    # bits of each run, padded with ones to a byte
    per = np.add.reduceat(length, np.arange(0, 64 * blocks, 64 * RUN))
    room = -(-per // 8) * 8
    begin = np.concatenate([[0], np.cumsum(room)])
    at = np.cumsum(length) - length
    run = np.arange(64 * blocks) // (64 * RUN)
    at += (begin[:-1] - (np.cumsum(per) - per))[run]
    # a symbol has at most 15 bits: it lies in three bytes
    word = bits << (24 - length - (at & 7))
    out = np.zeros(begin[-1] // 8 + 3, np.int64)
    for k in range(3):
        out += np.bincount((at >> 3) + k, (word >> (16 - 8 * k)) & 0xFF, len(out)).astype(np.int64)
    ends = begin[1:] // 8
    out[ends - 1] |= (1 << (room - per)) - 1
    data = out[: begin[-1] // 8].astype(np.uint8)
    # bytes FF are stuffed with 00; restart markers stand between runs
    stuffed = np.flatnonzero(data == 0xFF) + 1
    marks = np.repeat(ends[:-1], 2)
    kind = np.empty(2 * (runs - 1), np.uint8)
    kind[0::2], kind[1::2] = 0xFF, 0xD0 + np.arange(runs - 1) % 8
    where = np.concatenate([stuffed, marks])
    what = np.concatenate([np.zeros(len(stuffed), np.uint8), kind])
    order = np.argsort(where, kind="stable")
    return np.insert(data, where[order], what[order]).tobytes()


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits to come: length << 8 | symbol; 0: no code."""
    table, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


class Picture:
    """Parsed markers of a baseline JPEG; ``runs`` are byte ranges of the scan between restart markers."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        at, self.quant, self.huffman, self.restart = 2, {}, {}, 0
        while True:
            while data[at + 1] == 0xFF:
                at += 1
            marker, body = data[at + 1], data[at + 4 : at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")]
            at += 4 + len(body)
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xC0:
                if body[0] != 8:
                    raise ValueError("baseline has 8 bits")
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not baseline")
            elif marker == 0xDA:
                picked = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                if len(picked) != len(self.parts):
                    raise ValueError("one scan of all components is read")
                break
        raw = np.frombuffer(data, np.uint8)[at:]
        mark = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] != 0))
        stops = [int(m) for m in mark]
        self.runs, begin = [], 0
        for stop in stops:
            self.runs.append((at + begin, at + stop))
            begin = stop + 2
            if raw[stop + 1] == 0xD9:
                break
        self.most_h, self.most_v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:
            self.most_h = self.most_v = 1
            self.parts = [(self.parts[0][0], 1, 1, self.parts[0][3])]
        self.mcu_wide, self.mcu_high = -(-self.width // (8 * self.most_h)), -(-self.height // (8 * self.most_v))
        #: blocks of a minimum coded unit: (component, DC table, AC table)
        self.unit = [(i, picked[p[0]] >> 4, picked[p[0]] & 15) for i, p in enumerate(self.parts) for _ in range(p[1] * p[2])]
        self.tables = tuple(self.huffman[k] for k in sorted({t for _, d, a in self.unit for t in (d, 16 + a)}))
        self.shape = (tuple(self.unit), tuple(sorted(self.huffman.items())))


def decode(pictures: list[bytes]) -> list[tuple[Picture, np.ndarray]]:
    """Each picture with its quantised coefficients (blocks x 64, zigzag order, scan order); all runs step together."""
    parsed = [Picture(p) for p in pictures]
    out: list = [None] * len(parsed)
    groups: dict = {}
    for i, p in enumerate(parsed):
        groups.setdefault(p.shape, []).append(i)
    for own in groups.values():
        for i, value in zip(own, _decode_alike([parsed[i] for i in own], [pictures[i] for i in own])):
            out[i] = (parsed[i], value)
    return out


def _decode_alike(parsed: list[Picture], pictures: list[bytes]) -> list[np.ndarray]:
    unit = parsed[0].unit
    keys = sorted({t for _, d, a in unit for t in (d, 16 + a)})
    tables = np.stack([_lookup(*parsed[0].huffman[k]) for k in keys])
    dc = np.array([keys.index(d) for _, d, _ in unit])
    ac = np.array([keys.index(16 + a) for _, _, a in unit])
    # chunks of whole runs: (bytes, blocks) of each run
    chunks, held = [[]], 0
    for p, data in zip(parsed, pictures):
        left = p.mcu_wide * p.mcu_high
        for lo, hi in p.runs:
            if left <= 0:
                break
            take = min(left, p.restart or left)
            if held and held + take * len(unit) > 2 * CHUNK:
                chunks.append([])
                held = 0
            chunks[-1].append((data, lo, hi, take * len(unit)))
            held += take * len(unit)
            left -= take
        if left > 0:
            raise ValueError("the scan ends early")
    value = np.concatenate([_decode_runs(runs, unit, tables, dc, ac) for runs in chunks])
    out, at = [], 0
    for p in parsed:
        n = p.mcu_wide * p.mcu_high * len(unit)
        out.append(value[at : at + n])
        at += n
    return out


def _decode_runs(runs: list[tuple], unit: list, tables: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """Coefficients (blocks x 64) of runs (data, begin, end, blocks)."""
    body = [data[lo:hi].replace(b"\xff\x00", b"\xff") for data, lo, hi, _ in runs]
    begin = np.cumsum([0, *map(len, body)])[:-1]
    blocks = [r[3] for r in runs]
    flat = np.frombuffer(b"".join(body) + b"\xff" * 8, np.uint8).astype(np.int64)
    # 24 bits from each byte on
    window = flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]
    window = window[:-1] << 8 | flat[3:]
    blocks = np.array(blocks, np.int64)
    first = np.cumsum(blocks) - blocks
    value = np.zeros(int(blocks.sum()) * 64, np.int64)
    bit = np.array(begin, np.int64) * 8
    block, k, lane = first.copy(), np.zeros(len(blocks), np.int64), first
    last = first + blocks
    one = len(unit) == 1
    while len(bit):
        which = (dc[0] if one else dc[(block - lane) % len(unit)])
        table = np.where(k == 0, which, ac[0] if one else ac[(block - lane) % len(unit)])
        ahead = window[bit >> 3] >> (16 - (bit & 7)) & 0xFFFF
        got = tables[table, ahead]
        length, symbol = got >> 8, got & 0xFF
        if not length.all():
            raise ValueError("no such code")
        size, run = symbol & 15, np.where(k == 0, 0, symbol >> 4)
        bit = bit + length
        ahead = window[bit >> 3] >> (16 - (bit & 7)) & 0xFFFF
        bits = ahead >> (16 - size)
        bit += size
        coefficient = np.where(bits >> np.maximum(size - 1, 0) == 0, bits - (1 << size) + 1, bits)
        k += run
        some = size > 0
        value[(block * 64 + np.minimum(k, 63))[some]] = coefficient[some]
        # size 0 after the DC: 16 zeros, or the end of the block
        end = (size == 0) & (run == 0) & (k > 0)
        k = np.where(end, 64, k + 1)
        done = k >= 64
        block += done
        k[done] = 0
        alive = block < last
        if not alive.all():
            bit, block, k, lane, last = bit[alive], block[alive], k[alive], lane[alive], last[alive]
    value = value.reshape(-1, 64)
    # DC differences add up within a run and component
    comp = np.array([c for c, _, _ in unit])
    run_of = np.repeat(np.arange(len(blocks)), blocks)
    for c in set(comp.tolist()):
        mine = np.flatnonzero(comp[(np.arange(len(value)) - np.repeat(first, blocks)) % len(unit)] == c)
        total = np.cumsum(value[mine, 0])
        heads = np.searchsorted(run_of[mine], np.arange(len(blocks)))
        before = np.concatenate([[0], total])[heads]
        value[mine, 0] = total - before[run_of[mine]]
    return value.astype(np.int32)


def thumbnail(picture: Picture, value: np.ndarray) -> np.ndarray:
    """DC-only luminance: the mean of each 8 x 8 block, 0 to 255, rows of blocks from the top."""
    _, h, v, quant = picture.parts[0]
    per = len(picture.unit)
    luma = value.reshape(picture.mcu_high, picture.mcu_wide, per, 64)[:, :, : h * v, 0]
    mean = np.clip(np.rint(luma * picture.quant[quant][0] / 8.0 + 128), 0, 255).astype(np.uint8)
    return mean.reshape(picture.mcu_high, picture.mcu_wide, v, h).transpose(0, 2, 1, 3).reshape(picture.mcu_high * v, picture.mcu_wide * h)


def payload_of(value: np.ndarray, blocks: int) -> bytes:
    """The bytes that ``encode`` stored in the first blocks."""
    own = value[:blocks]
    return (own + 128 - (own > 0)).astype(np.uint8).tobytes()


def stored_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary) of every row: each text's bytes, padded, as a JPEG. Null text is empty."""

    def rows(batches):
        for batch in slices(batches, "text", 1 << 20):
            raw = [t.encode() for t in batch.column("text").to_pylist()]
            media = [encode(r + bytes(-len(r) % 64 or (0 if r else 64))) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(rows, f"doc_id {kind}, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Read back ``stored_media``: payload and file digests, and the feature: WxH of the picture and a thumbnail hash.

    feature is ``<width>x<height>:<64-bit average hash>:<crc32 of the thumbnail>``; equal texts have equal values.
    """

    def rows(batches):
        for batch in slices(batches, "media", 5 << 20):
            files, sizes = batch.column("media").to_pylist(), batch.column("n_bytes").to_pylist()
            found = []
            for (picture, value), size, file in zip(decode(files), sizes, files):
                payload = payload_of(value, max(1, -(-size // 64)))
                thumb = thumbnail(picture, value)
                cells = thumb.reshape(-1)
                means = np.array([c.mean() for c in np.array_split(cells, 64) if len(c)])
                average = int("".join("1" if m > means.mean() else "0" for m in means), 2)
                feature = f"{picture.width}x{picture.height}:{average:016x}:{zlib.crc32(thumb.tobytes()):08x}"
                found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature))
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], ["doc_id", "n_bytes", *names])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(rows, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
