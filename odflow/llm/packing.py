"""Packing of token ids into windows: best fit decreasing (op 3) and sum of squares (op 4).

Both run inside the partitions of one map over the table, so no row is shuffled; window numbers hold the partition's
number in their upper half. Memory is one block of documents and a bounded number of open windows of a partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm.bpe import library_encoder
from odflow.llm.common import slices

Piece = tuple[int, int, int]  # document's number in the block, start in it, length


def topped_up(windows: list[list[tuple]], size: int) -> list[list[tuple]]:
    """The fewest windows that hold the same pieces (..., start, length, ids, ...): the fullest stay as they are and their
    room is filled, from the fullest on, with what the emptiest held, cut where a window ends. All but the last are full.

    A piece is (document, start, length, tokens, ids); tokens is carried along.
    """
    fill = lambda w: sum(p[2] for p in w)
    windows = sorted(windows, key=fill, reverse=True)
    keep = -(-sum(map(fill, windows)) // size)
    spare = [p for w in reversed(windows[keep:]) for p in w]
    # the last window kept takes what is left over; if it is the only one with room, nothing is cut for it
    for k, window in enumerate(windows[:keep]):
        room = size - fill(window)
        while room:
            if not spare:
                if k + 1 == keep:
                    break
                spare = windows[keep - 1]  # the emptiest kept one gives its pieces to those before it
                windows[keep - 1] = []
            doc, start, length, tokens, ids = spare.pop()
            take = min(room, length)
            window.append((doc, start, take, tokens, ids[:take]))
            room -= take
            if take < length:
                spare.append((doc, start + take, length - take, tokens, ids[take:]))
        if k + 1 == keep:
            break
    if spare:
        windows[keep - 1] += reversed(spare)
    return [w for w in windows[:keep] if w]


class CapacityTree:
    """Segment tree over room left (0 to size): how many open windows have that room, and the least room that fits."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.count = [0] * (2 * self.base)

    def add(self, room: int, n: int) -> None:
        i = room + self.base
        while i:
            self.count[i] += n
            i >>= 1

    def best(self, need: int) -> int:
        """The least room of at least ``need`` that an open window has; -1: none."""
        i, count = need + self.base, self.count
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[Piece]]:
    """Windows of pieces: documents longer than a window are split into full windows and a rest, longest rest first."""
    windows: list[list[Piece]] = []
    rests = []
    for k, n in enumerate(lengths):
        whole = n // size * size
        windows += [[(k, at, size)] for at in range(0, whole, size)]
        if n > whole:
            rests.append((k, whole, n - whole))
    rests.sort(key=lambda p: (-p[2], p[0]))
    tree, by_room = CapacityTree(size), {}
    for piece in rests:
        room = tree.best(piece[2])
        if room < 0:
            windows.append([])
            room, window = size, windows[-1]
        else:
            window = by_room[room].pop()
            tree.add(room, -1)
        window.append(piece)
        left = room - piece[2]
        if left:
            tree.add(left, 1)
            by_room.setdefault(left, []).append(window)
    return windows


class SumOfSquares:
    """Online packing: a document goes to the fill level that leaves the least sum of squared counts of open windows.

    ``count[h]`` is the number of open windows filled to h. Putting a document of s into level h takes one from h and
    adds one to h + s (none if that fills the window), so the change of the sum is 2 (count[h + s] - count[h]) + 2, or
    1 - 2 count[h] if it fills; a new window is level 0. Ties take the highest level.
    """

    def __init__(self, size: int):
        self.size, self.count = size, np.zeros(size + 1, np.int64)
        self.open: dict[int, list] = {}

    def level(self, length: int) -> int:
        top = self.size - length
        count = self.count
        change = 2 * (count[length : self.size + 1] - count[: top + 1]) + 2
        change[top] = 1 - 2 * count[top] if top else 0
        if top:
            change[0] = 2 * count[length] + 1
        used = count[: top + 1] > 0
        used[0] = True
        change[~used] = np.iinfo(np.int64).max
        return int(top - np.argmin(change[::-1]))

    def put(self, piece) -> list | None:
        """Place a piece (document, start, length, ...); the window if it is full now."""
        length = piece[2]
        level = self.level(length)
        window = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
        window.append(piece)
        level += length
        if level == self.size:
            return window
        self.count[level] += 1
        self.open.setdefault(level, []).append(window)
        return None

    def head(self, length: int) -> int:
        """Where to cut a document longer than a window first, so that head and rest leave the least sum of squares; 0: nowhere.

        A head of a fills level h = size - a; between head and rest lie full windows. What both change the sum by is worked out
        for all levels at once; a rest fills a window that waits for it, or opens one. Ties take the highest level.
        """
        size, levels = self.size, np.arange(1, self.size)
        here = self.count[1:size]
        rest = (length - (size - levels)) % size
        fits = np.where(rest, self.count[(size - rest) % size] - (size - rest == levels), 0)  # the head may take the same level
        change = 1 - 2 * here + np.where(rest == 0, 0, np.where(fits > 0, 1 - 2 * fits, 2 * self.count[rest] + 1))
        change[here == 0] = np.iinfo(np.int64).max
        at = size - 2 - int(np.argmin(change[::-1]))
        return size - int(levels[at]) if here[at] and change[at] < self.cost(length % size) else 0

    def cost(self, length: int) -> int:
        """What the sum of squares changes by when a piece shorter than a window is placed."""
        if not length:
            return 0
        level, count = self.level(length), self.count
        if level + length == self.size:
            return 1 - 2 * int(count[level])
        return 2 * int(count[length]) + 1 if not level else 2 * int(count[level + length] - count[level]) + 2

    def again(self) -> list[list]:
        """Place all pieces of the open windows anew, longest first, as long as a round fills a sixteenth of them; the windows filled."""
        full, enough = [], True
        while enough and self.open:
            windows = self.flush()
            pieces = sorted((p for w in windows for p in w), key=lambda p: p[2], reverse=True)
            made = [w for w in map(self.put, pieces) if w]
            full += made
            enough = 16 * len(made) >= len(windows)
        return full

    def reopen(self, window: list) -> None:
        """Take a window that is not full."""
        level = sum(p[2] for p in window)
        self.count[level] += 1
        self.open.setdefault(level, []).append(window)

    def flush(self) -> list[list]:
        """The open windows, fullest first; afterwards none is open."""
        out = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self.count[:] = {}, 0
        return out


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _ids(batch: pa.RecordBatch, encode: Callable, end: int) -> Iterator[tuple[int | None, np.ndarray]]:
    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        yield doc, np.append(encode(text), np.uint32(end)).astype("<u4")


def pack_sum_of_squares(docs: DataFrame, path: str, pattern: str, size: int = 1024, end: int = 0, most_open: int = 4096) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and the id ``end``; null text is empty, so each row has a piece. One longer than a window is cut into a
    head, full windows and a rest, at the place that leaves the least sum of squares; head and rest, or a shorter document
    whole, are placed by sum of squares. When more than ``most_open`` windows are open, and at a partition's end, the pieces of the
    open windows are placed anew, longest first. Of what then is open (while more than half of ``most_open`` are, or at the
    end) the fullest are topped up with the pieces of the emptiest, cut to fit, so a partition pads one window.
    Repeated rows are packed each; null doc_id stays null; doc_id is returned as a long. An empty table gives no row.
    """

    def pieces(batches):
        encode, packer, number = library_encoder(path, pattern), SumOfSquares(size), TaskContext.get().partitionId() << 32
        out: list[tuple] = []

        def close(window: list) -> None:
            nonlocal number
            at = 0
            for doc, start, length, tokens, ids in window:
                out.append((doc, start, length, zlib.crc32(ids.tobytes()), tokens, number, at))
                at += length
            number += 1

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in slices(batches, "text"):
            for doc, ids in _ids(batch, encode, end):
                head = packer.head(len(ids)) if len(ids) > size else 0
                for at in ([0] if head else []) + list(range(head, len(ids), size)):
                    part = ids[at : head if at < head else at + size]
                    full = packer.put((doc, at, len(part), len(ids), part))
                    if full:
                        close(full)
                    elif packer.count.sum() > most_open:
                        for window in packer.again():
                            close(window)
                        if 2 * packer.count.sum() > most_open:
                            for window in topped_up(packer.flush(), size):
                                if sum(p[2] for p in window) == size:
                                    close(window)
                                else:
                                    packer.reopen(window)
            yield rows()
        for window in packer.again():
            close(window)
        for window in topped_up(packer.flush(), size):
            close(window)
        yield rows()

    return _source(docs).mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


_PACKED = "sequence_id long, ids binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"
_MATRIX = "sequence_id long, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"


def _windows(path: str, pattern: str, size: int, end: int, block: int) -> Callable:
    """The work of ``pack_best_fit`` on a partition's batches."""

    def windows(batches):
        encode, number = library_encoder(path, pattern), TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []  # (doc, start, length, tokens, ids)

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, waiting
            rows, back = [], []

            def close(own: list[tuple]) -> None:
                nonlocal number
                ids = np.concatenate([p[4] for p in own])
                rows.append((number, ids.tobytes(), [0, *np.cumsum([p[2] for p in own]).tolist()], [p[0] for p in own], [p[1] for p in own]))
                number += 1

            for window in best_fit_decreasing([p[2] for p in waiting], size):
                own = [(waiting[k][0], waiting[k][1] + at, n, waiting[k][3], waiting[k][4][at : at + n]) for k, at, n in window]
                if sum(p[2] for p in own) * 32 < size * 31:
                    back.append(own)
                else:
                    close(own)
            if last or 4 * sum(p[2] for w in back for p in w) > block:
                topped, back = topped_up(back, size), []
                for own in topped:
                    if last or sum(p[2] for p in own) == size:
                        close(own)
                    else:
                        back.append(own)
            waiting = [p for w in back for p in w]
            c = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            made = pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(c, kinds)], ["sequence_id", "ids", "cu_seqlens", "doc_ids", "starts"])
            return (made.slice(at, 512) for at in range(0, max(1, made.num_rows), 512))

        held = 0
        for batch in slices(batches, "text"):
            for doc, ids in _ids(batch, encode, end):
                waiting.append((doc, 0, len(ids), len(ids), ids))
                held += len(ids)
                if held >= block:
                    yield from emit(False)
                    held = 0
        yield from emit(True)

    return windows


def pack_best_fit(docs: DataFrame, path: str, pattern: str, size: int = 1024, end: int = 0, block: int = 1 << 22) -> DataFrame:
    """One row a window: sequence_id, ids (binary, little-endian unsigned 32-bit, without padding), cu_seqlens
    (cumulative segment lengths from 0), doc_ids and starts of the segments.

    Documents are taken in blocks of about ``block`` ids; within a block by best fit decreasing. Windows less than
    31/32 full go back to the next block as pieces; if those hold more than a quarter of a block, or at a partition's end,
    the fullest are topped up with the pieces of the emptiest, cut to fit. So memory is a block and a quarter, and only a
    partition's last window stays part full. Null text is empty: one id, ``end``. Repeated rows are packed each, null
    doc_id stays null, doc_id is returned as a long; an empty table gives no row. A token-id matrix and position resets follow
    by ``matrix``.
    """

    return _source(docs).mapInArrow(_windows(path, pattern, size, end, block), _PACKED)


def pack_matrix(docs: DataFrame, path: str, pattern: str, size: int = 1024, end: int = 0, block: int = 1 << 22, pad: int = 0) -> DataFrame:
    """``matrix`` of ``pack_best_fit`` in one pass: one Python worker a task packs and pads."""
    windows, padded = _windows(path, pattern, size, end, block), _padded(size, pad)
    return _source(docs).mapInArrow(lambda batches: padded(windows(batches)), _MATRIX)


def _padded(size: int, pad: int) -> Callable:
    """The work of ``matrix`` on batches."""

    def rows(batches):
        for batch in batches:
            ids, places = [], []
            for raw, ends in zip(batch.column("ids"), batch.column("cu_seqlens")):
                own, ends = np.frombuffer(raw.as_py(), "<u4"), np.array(ends.as_py())
                row, place = np.full(size, pad, "<u4"), np.zeros(size, "<u4")
                row[: len(own)] = own
                place[: len(own)] = np.arange(len(own)) - np.repeat(ends[:-1], np.diff(ends))
                ids.append(row.tobytes())
                places.append(place.tobytes())
            columns = [batch.column("sequence_id"), pa.array(ids, pa.binary()), pa.array(places, pa.binary()), *(batch.column(c) for c in ("cu_seqlens", "doc_ids", "starts"))]
            yield pa.RecordBatch.from_arrays(columns, ["sequence_id", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "starts"])

    return rows


def matrix(packed: DataFrame, size: int = 1024, pad: int = 0) -> DataFrame:
    """packed with ids as a row of the id matrix: input_ids (padded to ``size``) and position_ids (from 0 again in each
    segment, 0 in the padding), both binary, little-endian unsigned 32-bit; cu_seqlens, doc_ids and starts as they are."""
    return packed.mapInArrow(_padded(size, pad), _MATRIX)


def digest(rows: DataFrame) -> DataFrame:
    """Rows of ``matrix`` with counts and digests beside them: n_tokens, n_segments, ids_sha256 (without padding),
    input_sha256 and position_sha256; ids are the row's without padding."""
    own = F.expr("substring(input_ids, 1, 4 * element_at(cu_seqlens, -1))")
    return rows.select(
        "sequence_id", F.element_at("cu_seqlens", -1).cast("long").alias("n_tokens"), F.size("doc_ids").cast("long").alias("n_segments"),
        F.sha2(own, 256).alias("ids_sha256"), F.sha2("input_ids", 256).alias("input_sha256"), F.sha2("position_ids", 256).alias("position_sha256"),
        own.alias("ids"), "input_ids", "position_ids", "cu_seqlens", "doc_ids", "starts",
    )
