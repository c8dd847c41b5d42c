"""Repeated passages by prefix doubling over a sparse suffix array.

A suffix's rank among equal-length prefixes is kept as a *name*: equal strings, equal names. Names double in
length (8, 16, 32 bytes inside a task, by pairing the name at a position with the name one length further on); then
Spark groups names at growing lengths, and what is unique at one length leaves before the next:

1. length 32: of the 69 strings of 32 bytes in a 100-byte window, the least name is its *anchor*. Equal windows have
   the same anchor at the same offset, so one suffix in about 31 stands for all. Anchors that occur once leave.
2. the *cell* of an anchor (all windows that choose it, 100 to 168 bytes): the first of equal cells stays,
   every window of a later one repeats an earlier window.
3. length 83: of anchors with several different cells, blocks of 83 bytes at four offsets. Unique blocks leave.
4. length 100: the windows that hold a repeated block are grouped; the first of each group stays.

Survivors of a length reach the next as a bit filter of fixed size; a false positive only adds a row to an exact
grouping. Names are pairs of 64 bits (anchor, string). Groups of any size are pre-aggregated to their first member
before and during the shuffle, so a passage in a third of all documents makes no heavy task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm.common import BitFilter, slices, stored, string_bytes

ANCHOR = 32
#: Bytes worked on at once: small arrays stay in a core's cache.
BLOCK = 1 << 17
#: A longer document is worked on in parts that overlap by a window; positions in a block take 24 bits.
PART = 1 << 22
U = np.uint64


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = a * U(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    x += U(salt * 0x94D049BB133111EB & (2**64 - 1))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(31)
    return x


def _fold(names: np.ndarray, start: np.ndarray, length, salt: int) -> np.ndarray:
    """Names of the strings of ``length`` bytes (an array or number, at least 32) at ``start``."""
    length = np.broadcast_to(np.asarray(length, np.int64), start.shape)
    out = length.astype(U) * U(salt * 2 + 1)
    for step in range(0, int(length.max(initial=0)), ANCHOR):
        out = _mix(out, names[start + np.minimum(step, length - ANCHOR)], salt + step)
    return out


class Cells:
    """The cells of some texts: anchor name, document's index, start in it, windows less one, offset of the anchor."""

    def __init__(self, body: np.ndarray, ends: np.ndarray, window: int):
        self.window, self.ends, self.body = window, ends, body
        found = [self._block(lo, hi, first, last) for lo, hi, first, last in self._blocks()]
        cat = lambda k, kind: np.concatenate([f[k] for f in found]) if found else np.empty(0, kind)
        self.anchor, self.cell, self.doc, self.start, self.more, self.offset = (cat(k, t) for k, t in enumerate((U, U, np.int64, np.int64, np.int64, np.int64)))

    def _blocks(self) -> Iterator[tuple[int, int, int, int]]:
        """Byte range of a block and the documents in it."""
        ends, n, i = self.ends, len(self.ends) - 1, 0
        while i < n:
            if ends[i + 1] - ends[i] > PART:
                for lo in range(int(ends[i]), int(ends[i + 1]) - self.window + 1, PART):
                    yield lo, min(int(ends[i + 1]), lo + PART + self.window - 1), i, i + 1
                i += 1
                continue
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK, "right")) - 1)
            while j > i + 1 and ends[j] - ends[i] > PART:
                j -= 1
            yield int(ends[i]), int(ends[j]), i, j
            i = j

    def _names(self, lo: int, hi: int) -> np.ndarray:
        """Names of the 32-byte strings from lo on: 8 bytes as they are, then doubled twice."""
        text = np.zeros(hi - lo + ANCHOR + 8, np.uint8)
        text[: hi - lo] = self.body[lo:hi]
        n8 = np.lib.stride_tricks.as_strided(text[:8].view(U), (hi - lo + ANCHOR,), (1,)) * U(1)
        n16 = _mix(n8[:-8], n8[8:], 1)
        return _mix(n16[:-16], n16[16:], 2)

    def _block(self, lo: int, hi: int, first: int, last: int):
        window, ends = self.window, self.ends
        empty = (np.empty(0, U), np.empty(0, U)) + (np.empty(0, np.int64),) * 4
        count = hi - lo - window + 1
        if count <= 0:
            return empty
        names = self._names(lo, hi)
        # the leftmost least name of each window: doubled sliding minimum of (top 40 bits, position)
        width = window - ANCHOR + 1
        least = (names[: count + width - 1] & U(0xFFFFFFFFFF000000)) | np.arange(count + width - 1, dtype=U)
        span = 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: count], least[width - span : width - span + count])
        anchor = (least & U(0xFFFFFF)).astype(np.int64)
        # windows that cross the end of a document are void
        valid = np.ones(count, bool)
        for i in range(first, last):
            a, b = max(ends[i + 1] - lo - window + 1, 0), ends[i + 1] - lo
            valid[max(a, ends[i] - lo, 0) : b] = False
        change = np.empty(count, bool)
        change[0] = True
        change[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        start = np.flatnonzero(change & valid)
        if not len(start):
            return empty
        final = np.empty(count, bool)
        final[-1] = True
        final[:-1] = change[1:] | ~valid[1:]
        more = np.flatnonzero(final & valid) - start
        doc = np.searchsorted(ends, start + lo, "right") - 1
        at = anchor[start]
        return names[at], _fold(names, start, more + window, 3), doc, start + lo - ends[doc], more, at - start

    def take(self, keep: np.ndarray) -> "Cells":
        out = object.__new__(Cells)
        out.window, out.ends, out.body = self.window, self.ends, self.body
        for k in ("anchor", "cell", "doc", "start", "more", "offset"):
            setattr(out, k, getattr(self, k)[keep])
        return out

    def _local(self, keep_per: int = 4096) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Names of only the cells' own bytes: (cells, names of their bytes end to end, each cell's place there)."""
        for lo in range(0, len(self.start), keep_per):
            part = slice(lo, lo + keep_per)
            size = self.more[part] + self.window
            place = np.cumsum(size) - size
            where = np.arange(int(size.sum())) + np.repeat(self.ends[self.doc[part]] + self.start[part] - place, size)
            own = Cells.__new__(Cells)
            own.body = self.body[where]
            yield part, own._names(0, len(where)), place

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(cell's index, name of the block at the offset, the offset): the strings of round 3."""
        step, length = block_shape(self.window)
        for part, names, place in self._local():
            base = np.arange(part.start, part.start + len(place))
            for offset in range(0, self.window - ANCHOR + 1, step):
                # windows of offset d hold the block if offset <= d < offset + step
                has = (self.offset[part] >= offset) & (self.offset[part] - self.more[part] < offset + step)
                at = place[has] + self.offset[part][has] - offset
                yield base[has], _mix(self.anchor[part][has], _fold(names, at, length, 5), offset + 7), offset

    def windows(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell's index, start in the document, name) of the windows that hold a wanted block (cells x offsets)."""
        step, _ = block_shape(self.window)
        out = []
        for part, names, place in self._local():
            count = self.more[part] + 1
            cell = np.repeat(np.arange(len(place)), count)
            shift = np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)
            keep = wanted[part][cell, (self.offset[part][cell] - shift) // step]
            cell, shift = cell[keep], shift[keep]
            out.append((cell + part.start, self.start[part][cell] + shift, _fold(names, place[cell] + shift, self.window, 6)))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U))


def block_shape(window: int) -> tuple[int, int]:
    """Step between the offsets of round 3 and the length of its strings."""
    step = -(-(window - ANCHOR + 1) // 4)
    return step, window - step + 1


def _cells(batch: pa.RecordBatch, window: int) -> tuple[np.ndarray, Cells]:
    body, ends = string_bytes(batch.column("text"))
    return batch.column("key").to_numpy(), Cells(body, ends, window)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Indexes of the first row of each group of the two last keys, in the order of the others."""
    order = np.lexsort(keys)
    a, b = keys[-1][order], keys[-2][order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order[new]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _wanted(cells: Cells, repeated_blocks: BitFilter) -> np.ndarray:
    step, _ = block_shape(cells.window)
    wanted = np.zeros((len(cells.start), -(-(cells.window - ANCHOR + 1) // step)), bool)
    for index, name, offset in cells.blocks():
        wanted[index, offset // step] = repeated_blocks.has(name)
    return wanted


def repeated_spans(docs: DataFrame, min_bytes: int = 100, filter_bits: int = 1 << 26, text: str = "text") -> DataFrame:
    """Each row of ``docs`` as (doc_id, text, spans): spans of bytes to remove, sorted and apart.

    A byte is in a span if a string of ``min_bytes`` (64 to 4096) bytes over it also starts earlier: in a row of smaller
    doc_id, or earlier in the same one; overlaps count. Null text is empty; null doc_id sorts first. Rows that repeat a
    doc_id with the same text are one document: neither removes the other. Rows that repeat it with different texts count as
    versions of one document, ordered by start alone: a string that two versions hold at the same start stays in both, and a
    repeated one may stay in a version where another keeps a first one at the same start. An empty table gives no row. Other
    columns are ignored. ``filter_bits`` (a power of two) bounds each of three broadcast filters.
    """
    if not 64 <= min_bytes <= 4096 or filter_bits & (filter_bits - 1) or not 1 << 10 <= filter_bits <= 1 << 31:
        raise ValueError("min_bytes is 64 to 4096, filter_bits a power of two of at most 2**31")
    sc, window = docs.sparkSession.sparkContext, min_bytes
    source = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )

    def anchors(batches):
        for batch in slices(batches, "text"):
            _, cells = _cells(batch, window)
            yield pa.RecordBatch.from_arrays([_signed(cells.anchor)], ["name"])

    repeated = lambda names: BitFilter.of(names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name"), filter_bits)
    first_filter = sc.broadcast(repeated(source.mapInArrow(anchors, "name long")))

    def cells_of(batches):
        for batch in slices(batches, "text"):
            key, cells = _cells(batch, window)
            cells = cells.take(first_filter.value.has(cells.anchor))
            doc = key[cells.doc]
            i = _firsts(cells.start, doc, cells.cell, cells.anchor)
            yield pa.RecordBatch.from_arrays([_signed(cells.anchor[i]), _signed(cells.cell[i]), pa.array(doc[i]), pa.array(cells.start[i])], ["anchor", "cell", "doc", "start"])

    # each batch gives one row a document and cell at most, so that min_by has no ties
    firsts = (
        source.mapInArrow(cells_of, "anchor long, cell long, doc long, start long")
        .groupBy("anchor", "cell")
        .agg(F.min("doc").alias("doc"), F.min_by("start", "doc").alias("start"))
    )
    firsts = stored(firsts)
    mixed = sc.broadcast(repeated(firsts.select(F.col("anchor").alias("name"))))

    def blocks_of(batches):
        for batch in slices(batches, "text"):
            _, cells = _cells(batch, window)
            cells = cells.take(first_filter.value.has(cells.anchor) & mixed.value.has(cells.anchor))
            cells = cells.take(_firsts(cells.start, cells.cell, cells.anchor))
            for index, name, _ in cells.blocks():
                yield pa.RecordBatch.from_arrays([_signed(name), _signed(cells.cell[index])], ["name", "cell"])

    shared_blocks = (
        source.mapInArrow(blocks_of, "name long, cell long")
        .groupBy("name")
        .agg(F.min("cell").alias("a"), F.max("cell").alias("b"))
        .filter("a <> b")
        .select("name")
    )
    block_filter = sc.broadcast(BitFilter.of(shared_blocks, filter_bits))

    def candidates(cells: Cells) -> Cells:
        return cells.take(first_filter.value.has(cells.anchor) & mixed.value.has(cells.anchor))

    def windows_of(batches):
        for batch in slices(batches, "text"):
            key, cells = _cells(batch, window)
            cells = candidates(cells)
            cells = cells.take(_firsts(cells.start, key[cells.doc], cells.cell, cells.anchor))
            index, start, name = cells.windows(_wanted(cells, block_filter.value))
            anchor, doc = cells.anchor[index], key[cells.doc[index]]
            i = _firsts(start, doc, name, anchor)
            yield pa.RecordBatch.from_arrays([_signed(anchor[i]), _signed(name[i]), pa.array(doc[i]), pa.array(start[i])], ["anchor", "name", "doc", "start"])

    kept_windows = (
        source.mapInArrow(windows_of, "anchor long, name long, doc long, start long")
        .groupBy("anchor", "name")
        .agg(F.min("doc").alias("key"), F.min_by("start", "doc").alias("start"))
    )
    # what a document keeps: its first cells and first windows; at most one of each a byte
    keeps = (
        firsts.select(F.col("doc").alias("key"), (F.col("start") * 2).alias("at"))
        .unionByName(kept_windows.select("key", (F.col("start") * 2 + 1).alias("at")))
        .groupBy("key")
        .agg(F.collect_list("at").alias("keeps"))
    )

    def spans_of(batches):
        for batch in slices(batches, "text"):
            yield spans_in(batch)

    def spans_in(batch):
        key, cells = _cells(batch, window)
        keeps = batch.column("keeps")
        flat = keeps.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        many = np.diff(np.asarray(keeps.offsets.to_numpy(), np.int64)) if len(keeps) else np.empty(0, np.int64)
        many = np.where(np.asarray(keeps.is_valid()), many, 0)
        flat = (np.repeat(np.arange(len(key)), many) << 40) | flat
        cells = cells.take(first_filter.value.has(cells.anchor))
        code = (cells.doc << 40) | (cells.start * 2)
        first = np.isin(code, flat)
        later = cells.take(~first)
        lo, hi, doc = [later.start], [later.start + later.more + window], [later.doc]
        cells = candidates(cells.take(first))
        index, start, _ = cells.windows(_wanted(cells, block_filter.value))
        own = cells.doc[index]
        again = ~np.isin((own << 40) | (start * 2 + 1), flat)
        lo, hi, doc = (np.concatenate(x) for x in zip((lo[0], hi[0], doc[0]), (start[again], start[again] + window, own[again])))
        order = np.lexsort((lo, doc))
        lo, hi, doc = lo[order], hi[order], doc[order]
        # merge overlapping and touching spans: every window and cell is at least `window` long, so ends rise with starts almost;
        # a running maximum in one number line per document makes them rise
        line = doc << 40
        top = np.maximum.accumulate(line + hi) if len(lo) else lo
        new = np.ones(len(lo), bool)
        new[1:] = (line + lo)[1:] > top[:-1]
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(lo)) - 1 if len(lo) else begin
        count = np.bincount(doc[begin], minlength=len(key)) if len(begin) else np.zeros(len(key), np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
        pairs = pa.StructArray.from_arrays([pa.array(lo[begin]), pa.array((top[last] - line[last]) if len(begin) else lo)], ["begin", "end"])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.ListArray.from_arrays(offsets, pairs)], ["doc_id", "text", "spans"])

    joined = (
        docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .join(keeps, "key", "left")
        .select("key", "doc_id", "text", "keeps")
    )
    return joined.mapInArrow(spans_of, "doc_id long, text string, spans array<struct<begin:long,end:long>>")


def removal_digests(spans: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of ``repeated_spans``."""

    def digests(batches):
        for batch in slices(batches, "text"):
            rows = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
            for text, gaps in zip(batch.column("text"), batch.column("spans")):
                raw, gaps = text.as_py().encode(), gaps.as_py()
                digest, at = hashlib.sha256(), 0
                for gap in gaps:
                    digest.update(raw[at : gap["begin"]])
                    at = gap["end"]
                digest.update(raw[at:])
                for k, v in zip(rows, (len(raw), sum(g["end"] - g["begin"] for g in gaps), len(gaps), digest.hexdigest())):
                    rows[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(rows[k], pa.int64()) for k in list(rows)[:3]), pa.array(rows["kept_sha256"], pa.string())], ["doc_id", *rows])

    return spans.mapInArrow(digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, min_bytes: int = 100) -> DataFrame:
    """docs with the repeated passages cut from ``text`` (``n_chars`` renewed, other columns as they were).

    A cut keeps whole characters: it starts after and ends before a character that only partly repeats. Documents
    that are empty afterwards leave, as do those that were empty.
    """
    found = repeated_spans(docs, min_bytes)

    def cut(batches):
        for batch in slices(batches, "text"):
            out = []
            for text, gaps in zip(batch.column("text"), batch.column("spans")):
                gaps = gaps.as_py()
                if not gaps:
                    out.append(text.as_py())
                    continue
                raw, kept, at = text.as_py().encode(), [], 0
                for gap in gaps:
                    begin, end = gap["begin"], gap["end"]
                    while begin < end and raw[begin] & 0xC0 == 0x80:
                        begin += 1
                    while end > begin and end < len(raw) and raw[end] & 0xC0 == 0x80:
                        end -= 1
                    kept.append(raw[at:begin])
                    at = end
                out.append((b"".join(kept) + raw[at:]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    # only changed texts travel back
    cut_texts = found.filter(F.size("spans") > 0).mapInArrow(cut, "doc_id long, text string").dropDuplicates(["doc_id"])
    cut_texts = cut_texts.select(F.col("doc_id").alias("cut_id"), F.col("text").alias("cut_text"))
    left = F.coalesce(cut_texts["cut_text"], docs["text"])
    renewed = {"text": left}
    if "n_chars" in docs.columns:
        renewed["n_chars"] = F.length(left).cast(docs.schema["n_chars"].dataType)
    out = docs.join(cut_texts, docs["doc_id"].cast("long").eqNullSafe(cut_texts["cut_id"]), "left").filter(left != "")
    return out.select(*(renewed.get(c, docs[c]).alias(c) for c in docs.columns))
