"""How far the sources of a language differ in their words: smoothed frequencies of common terms, compared exactly.

Counting: in each task ("shard"), the texts' Arrow buffers are one run of bytes, and every term is a pointer to its first byte
there. Pointers of whole documents, in slices of bounded bytes and ordered by (lang, source), are sorted by the bytes they point
at with a stable multikey quicksort whose characters are words of eight bytes. A run of equal pointers is a term; since equal
pointers keep their order, its changes of group and of document give counts and document frequencies of each source.
Spark adds up the runs, keeps common terms, and compares.

Terms are runs of ASCII letters and of code points from U+0080; only A to Z are lower-cased. Null text, lang and source are ''.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflow.llm.common import slices, stored, string_bytes

#: A term is kept in a language if so many of its documents have it.
LEAST_DOCUMENTS = 30
SMOOTHING, SCALE, TOP = 5, 1_000_000_000, 50
#: Texts of a slice, a segment that is sorted without further pivots, terms of a bucket, and sources of a block.
SLICE_BYTES, SEGMENT, BUCKET_TERMS, BLOCK_SOURCES = 16 << 20, 1 << 14, 1024, 64
SALTS = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def term_pointers(body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and length of every term; ends are the n + 1 offsets of the texts, which no term crosses."""
    inside = np.zeros(len(body) + 2, bool)
    inside[1:-1] = _TERM[body]
    first = inside[1:] & ~inside[:-1]  # first[i]: byte i begins a run; where the run ended before, last[i]
    last = ~inside[1:] & inside[:-1]
    cut = ends[(ends > 0) & (ends < len(body))]
    joined = cut[inside[cut] & inside[cut + 1]]
    first[joined] = last[joined] = True
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) - starts


class _Words:
    """Words of eight bytes of the terms, big-endian and padded by zeros, so that numbers are ordered as bytes are."""

    def __init__(self, body: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        padded = np.concatenate([body, np.zeros(8, np.uint8)])
        self.view = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(body) + 1,), (1,))
        self.starts, self.lengths = starts, lengths

    def at(self, pointers: np.ndarray, depth: int) -> np.ndarray:
        rest = self.lengths[pointers] - 8 * depth
        here = np.minimum(self.starts[pointers] + 8 * depth, len(self.view) - 1)
        word = self.view[here].byteswap()
        short = rest < 8
        word[short] &= ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * np.maximum(rest[short], 0)).astype(np.uint64))
        return word


def sorted_runs(body: np.ndarray, starts: np.ndarray, lengths: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): pointers by their terms' bytes, equal ones as they came, and where in the order each term's run begins.

    A segment is split by a pivot word into smaller, equal and larger pointers; the equal ones go on with the next word, or are
    a run if their term ends there. A short segment is sorted as a whole, word by word, within runs that are equal so far.
    """
    words, order = _Words(body, starts, lengths), np.arange(len(starts))
    firsts: list[np.ndarray] = []
    waiting = [(0, len(order), 0)]
    while waiting:
        lo, hi, depth = waiting.pop()
        if lo == hi:
            continue
        part = order[lo:hi]
        word = words.at(part, depth)
        if hi - lo <= segment:
            place, first = _sorted_short(words, part, word, depth)
            order[lo:hi] = part[place]
            firsts.append(lo + first)
            continue
        pivot = np.sort(word[np.linspace(0, len(word) - 1, 33).astype(np.int64)])[16]
        less, equal = word < pivot, word == pivot
        a, b = int(less.sum()), int(equal.sum())
        order[lo:hi] = np.concatenate([part[less], part[equal], part[~(less | equal)]])
        waiting += [(lo, lo + a, depth), (lo + a + b, hi, depth)]
        if pivot & np.uint64(0xFF):
            waiting.append((lo + a, lo + a + b, depth + 1))
        else:
            firsts.append(np.array([lo + a]))
    return order, np.sort(np.concatenate(firsts)) if firsts else np.empty(0, np.int64)


def _sorted_short(words: _Words, part: np.ndarray, word: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    place = np.argsort(word, kind="stable")
    word = word[place]
    new = np.concatenate([[True], word[1:] != word[:-1]])
    run = np.cumsum(new)
    # only runs of several pointers whose word is full may still differ
    while len(open_ := np.flatnonzero((word & np.uint64(0xFF) != 0) & ~(new & np.concatenate([new[1:], [True]])))):
        depth += 1
        deeper = words.at(part[place[open_]], depth)
        by = np.lexsort((deeper, run[open_]))
        place[open_], deeper = place[open_[by]], deeper[by]
        word = np.zeros(len(place), np.uint64)
        word[open_] = deeper
        new[open_[1:]] |= deeper[1:] != deeper[:-1]
        run = np.cumsum(new)
    return place, np.flatnonzero(new)


def shard_counts(text, group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(terms, groups, counts, documents) of an Arrow string array, one entry a term and group that has it.

    group: a number for each document. Documents are taken in the groups' order.
    """
    by = np.argsort(group, kind="stable")
    body, ends = string_bytes(text.take(by))
    body, group = _LOWER[body], group[by]
    starts, lengths = term_pointers(body, ends)
    order, first = sorted_runs(body, starts, lengths)
    document = (np.searchsorted(ends, starts, "right") - 1)[order]
    own = group[document]
    new_term = np.zeros(len(order), bool)
    new_term[first] = True
    changed = lambda x: np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.empty(0, bool)
    new = new_term | changed(own)
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(order)))
    documents = np.add.reduceat((new | changed(document)).astype(np.int64), at) if len(at) else counts
    raw = body.tobytes()
    begin, length = starts[order[at]], lengths[order[at]]
    return [raw[s : s + n] for s, n in zip(begin.tolist(), length.tolist())], own[at], counts, documents


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, documents: how often a group has a term and in how many of its documents.

    Every (lang, source) that occurs has a row for the term '' with 0 and 0. Rows are documents: repeated ids count each.
    """
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in slices(batches, "text", SLICE_BYTES):
            keys = pa.table({c: batch.column(c) for c in ("lang", "source")})
            key = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
            names = keys.group_by(["lang", "source"]).aggregate([])
            number = {pair: i for i, pair in enumerate(zip(names["lang"].to_pylist(), names["source"].to_pylist()))}
            group = np.fromiter((number[k["lang"], k["source"]] for k in key.to_pylist()), np.int64, len(key))
            terms, own, n, documents = shard_counts(batch.column("text"), group)
            every = np.concatenate([own, np.arange(len(number))])
            none = np.zeros(len(number), np.int64)
            term = pc.cast(pa.array(terms + [b""] * len(number), pa.binary()), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(names[c].combine_chunks().take(pa.array(every)) for c in ("lang", "source")), term, pa.array(np.concatenate([n, none])), pa.array(np.concatenate([documents, none]))],
                ["lang", "source", "term", "n", "documents"],
            )

    counted = rows.mapInArrow(count, "lang string, source string, term string, n long, documents long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def frequencies(counts: DataFrame, least_documents: int = LEAST_DOCUMENTS, smoothing: int = SMOOTHING, scale: int = SCALE) -> tuple[DataFrame, DataFrame]:
    """(groups, rows) of ``term_counts``.

    groups: lang, source, buckets, blocks, size, total, everywhere, vocabulary, absent (p of a kept term that the group lacks).
    rows: lang, source, term, bucket, n, p, q of the kept terms that a group has: its frequency and its language's.
    p = 1 + floor(scale * (n + smoothing) / (N + smoothing * V)) in decimals of 38 digits, so it is exact.
    """
    counts = stored(counts)
    kept = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("everywhere"), F.sum("documents").alias("documents"))
    kept = stored(kept.filter(F.col("documents") >= least_documents).drop("documents"))
    langs = kept.groupBy("lang").agg(F.sum("everywhere").alias("everywhere"), F.count(F.lit(1)).alias("vocabulary"))
    marked = counts.filter("term = ''").select("lang", "source")
    found = stored(counts.filter("term <> ''").drop("documents").join(kept, ["lang", "term"]))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = marked.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    groups = marked.join(totals, ["lang", "source"], "left").join(sources, "lang").join(langs, "lang", "left").fillna(0, ["total", "everywhere", "vocabulary"])
    size = lambda n: (F.col(n) + smoothing * F.col("vocabulary")).cast("decimal(20,0)")
    p = lambda n, of: F.expr(f"cast({n} + {smoothing} as decimal(20,0)) * {scale}BD div {of}") + 1
    groups = groups.select(
        "lang", "source", "total", "everywhere", "vocabulary", size("total").alias("size"), size("everywhere").alias("whole"),
        F.ceil(F.greatest(F.col("vocabulary"), F.lit(1)) / BUCKET_TERMS).cast("int").alias("buckets"), F.ceil(F.col("sources") / BLOCK_SOURCES).cast("int").alias("blocks"),
    )
    groups = stored(groups.withColumn("absent", F.when(F.col("vocabulary") > 0, p("0", "size"))))
    # what a group is, once for each bucket of terms: the rows of a group are spread over them
    wide = groups.select("lang", "source", "size", "whole", "buckets", "blocks", F.explode(F.expr("sequence(0, buckets - 1)")).alias("bucket"))
    # a language's number of buckets comes with its terms; salted, for a language may hold most of the rows
    buckets = F.ceil(F.col("vocabulary") / BUCKET_TERMS).cast("int").alias("buckets")
    per_lang = langs.select("lang", buckets, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = found.withColumn("salt", F.pmod(F.hash("term"), F.lit(SALTS))).join(per_lang, ["lang", "salt"])
    found = found.withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int")).drop("buckets", "salt")
    rows = found.join(wide, ["lang", "source", "bucket"])
    return groups, rows.select("lang", "source", "term", "bucket", "blocks", "n", p("n", "size").alias("p"), p("everywhere", "whole").alias("q"))


def term_part(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The terms that a group has above its language, by the excess, ``top`` for each group: lang, source, item, value, rank."""
    above = rows.filter("p > q").select("lang", "source", "bucket", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = [F.desc("value"), F.asc("item")]
    # first within the buckets of terms, so that the last sort has few rows a group
    few = above.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "bucket").orderBy(*order))).filter(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).filter(F.col("rank") <= top).drop("bucket")


def _block_sums(key, table):
    """Sums of |p - q| over a bucket of terms between the sources of two blocks: rows (lang, a, b, value), a before b."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lang, one, two = (k.as_py() for k in key[:3])
    sources = {}
    marks = table.filter(pc.equal(table["term"], ""))
    for s, block, absent in zip(*(marks[c].to_pylist() for c in ("source", "own", "p"))):
        sources[s] = (len(sources), block, absent or 0)
    found = table.filter(pc.not_equal(table["term"], ""))
    column = np.fromiter((sources[s][0] for s in found["source"].to_pylist()), np.int64, found.num_rows)
    terms = found["term"].combine_chunks().dictionary_encode()
    line = terms.indices.to_numpy()
    names = list(sources)
    absent = np.array([sources[s][2] for s in names], np.int64)
    grid = np.tile(absent, (len(terms.dictionary), 1))
    grid[line, column] = found["p"].to_numpy()
    rows = {"lang": [], "a": [], "b": [], "value": []}
    for i, a in enumerate(names):
        value = np.abs(grid - grid[:, i : i + 1]).sum(axis=0)
        for j, b in enumerate(names):
            if a < b and {sources[a][1], sources[b][1]} == {one, two}:
                for c, v in zip(rows, (lang, a, b, int(value[j]))):
                    rows[c].append(v)
    return pa.table({**{c: pa.array(rows[c], pa.string()) for c in ("lang", "a", "b")}, "value": pa.array(rows["value"], pa.int64()), "present": pa.array([len(terms.dictionary)] * len(rows["a"]), pa.int64())})


def pair_part(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """Every ordered pair of sources of a language by the sum of |p - q| over its kept terms: lang, source, item, value, rank.

    Sources are cut into blocks and terms into buckets; a group is a bucket for two blocks, a matrix of at most some thousand
    terms by twice a block's sources. Its sums of pairs are added up by Spark. Terms that neither block has are added by number.
    """
    own = lambda blocks: F.pmod(F.xxhash64("source"), F.col(blocks)).cast("int")
    marks = groups.select("lang", "source", F.lit("").alias("term"), F.explode(F.expr("sequence(0, buckets - 1)")).alias("bucket"), "blocks", F.col("absent").alias("p"))
    cells = rows.select("lang", "source", "term", "bucket", "blocks", "p").unionByName(marks).withColumn("own", own("blocks"))
    other = F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    cells = cells.select("lang", "source", "term", "bucket", "p", "own", other)
    cells = cells.select("lang", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "bucket", "source", "term", "p", "own")
    sums = cells.groupBy("lang", "one", "two", "bucket").applyInArrow(_block_sums, "lang string, a string, b string, value long, present long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("present").alias("present"))
    side = lambda c: groups.select("lang", F.col("source").alias(c), F.col("absent").alias(f"absent_{c}"), "vocabulary")
    sums = sums.join(side("a"), ["lang", "a"]).join(side("b").drop("vocabulary"), ["lang", "b"])
    rest = F.abs(F.col("absent_a") - F.col("absent_b")) * (F.col("vocabulary") - F.col("present"))
    value = F.col("value") + F.coalesce(rest, F.lit(0))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), value.alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return both.select("lang", "x.source", "x.item", "value").withColumn("rank", F.row_number().over(w))


def source_divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` of ``pair_part`` and part ``term`` of ``term_part``.

    Without kept terms a language's pairs have the value 0 and are ranked by name. An empty table gives no row.
    """
    groups, rows = frequencies(term_counts(docs), least_documents)
    rows = stored(rows)
    pairs, terms = (df.withColumn("part", F.lit(part)) for df, part in ((pair_part(groups, rows), "pair"), (term_part(rows, top), "term")))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
