"""Near-duplicates by fast similarity sketching, banding and exact verification.

1. Each document's set of word shingles is hashed to 64 bits and sketched: round i < t throws every element into a
   random bin with value (i, hash), round t + j throws all into bin j, until all t bins hold their least value. Every
   bin fills, and equal bins estimate the Jaccard similarity with a concentration bound.
2. Documents of equal sets form a class, a node of the graph; its name is 64 bits of the set.
3. 51 bands of 5 bins: two sets of similarity 0.8 share none with probability (1 - 0.8^5)^51 = 2e-9. Members of a bucket
   whose sizes allow a link and whose 256 one-bit bins differ by at most six standard deviations from the threshold touch;
   buckets of more than ``large`` members touch as a whole. What touches, directly or over others, is a family: no link
   leaves one.
4. Families are verified on full sets, each of which is shipped once: a family of one block has all its pairs compared, save
   those joined already. Larger ones are dealt into blocks; those that stand for the components found there meet in
   new blocks, and then members of components that are still apart meet, block against block, until every pair of
   different components has been compared. Tasks return components and links between them, never pairs of members.

What a family costs is its members times the blocks of members that stay apart from its large components: a
template of which a third of all documents are variants just below the threshold takes quadratic work in tasks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm.common import BitFilter, drop, slices, stored, string_bytes, whole_groups

BINS, ROWS = 256, 5
BANDS = BINS // ROWS
U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_ROUND = _RNG.integers(0, 2**63, 2 * BINS, dtype=np.uint64) * U(2) + U(1)
_POWER = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray, y) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9) + y
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(body: np.ndarray, ends: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``words`` words; A-Z lower-cased."""
    n = len(ends) - 1
    # a space after each text keeps words apart
    text = np.full(len(body) + n, 0x20, np.uint8)
    shift = np.repeat(np.arange(n), np.diff(ends))
    text[np.arange(len(body)) + shift] = _LOWER[body]
    stop = ends[1:] + np.arange(1, n + 1)
    solid = ~_SPACE[text]
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return [np.empty(0, U)] * n
    at = np.flatnonzero(solid)
    within = at - np.repeat(begin, end - begin)
    value = _BYTE[text[at]] * _POWER[within & 0xFFF] + (within.astype(U) >> U(12)) * U(0xD6E8FEB86659FD93)
    word = _mix(np.add.reduceat(value, np.cumsum(end - begin) - (end - begin)), (end - begin).astype(U))
    first = np.searchsorted(begin, np.concatenate([[0], stop]))
    rolled = word.copy()
    for k in range(1, words):
        rolled[: len(word) - k] = _mix(rolled[: len(word) - k], word[k:])
    out = []
    for lo, hi in zip(first[:-1], first[1:]):
        count = hi - lo
        if count >= words:
            out.append(np.unique(rolled[lo : hi - words + 1]))
        elif count:
            whole = word[lo : lo + 1]
            for k in range(1, count):
                whole = _mix(whole, word[lo + k])
            out.append(whole ^ U(int(count) * 0x5851F42D4C957F2D & (2**64 - 1)))
        else:
            out.append(np.empty(0, U))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Fast similarity sketches (sets x BINS) of sets that are not empty."""
    out = np.full(len(sets) * BINS, 2**64 - 1, np.uint64)
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    open_sets = np.ones(len(sets), bool)
    for i in range(2 * BINS):
        h = _mix(flat ^ _ROUND[i], _ROUND[i])
        bin_ = ((h >> U(32)) * U(BINS) >> U(32)).astype(np.int64) if i < BINS else np.full(len(h), i - BINS)
        np.minimum.at(out, owner * BINS + bin_, (U(i) << U(48)) | (h & U(0xFFFFFFFFFFFF)))
        full = (out.reshape(-1, BINS) != U(2**64 - 1)).all(axis=1)
        if full.all():
            break
        if (open_sets & full).any():
            keep = ~full[owner]
            flat, owner, open_sets = flat[keep], owner[keep], ~full
    return out.reshape(-1, BINS)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _names(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name of each set: equal sets, equal names."""
    sums = lambda of: np.array([of(s).sum() if len(s) else 0 for s in sets], U)
    return _mix(sums(lambda s: s) ^ np.array([len(s) for s in sets], U), sums(lambda s: _mix(s, U(77))))


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    """(doc, n, node, bits array<long>, keys array<long>) of every row; node names the set."""

    def rows(batches):
        for batch in slices(batches, "text"):
            body, ends = string_bytes(batch.column("text"))
            sets = shingle_sets(body, ends, words)
            some = [i for i, s in enumerate(sets) if len(s)]
            bits, keys = np.zeros((len(sets), 4), U), np.zeros((len(sets), BANDS), U)
            if some:
                got = sketches([sets[i] for i in some])
                bits[some] = np.packbits((_mix(got, U(5)) & U(1)).astype(np.uint8), axis=1).view(U)
                key = np.broadcast_to(_ROUND[:BANDS], (len(some), BANDS))
                for r in range(ROWS):
                    key = _mix(got[:, r : BANDS * ROWS : ROWS], key)
                keys[some] = key
            lists = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a.reshape(-1).view(np.int64)), a.shape[1]).cast(pa.list_(pa.int64()))
            columns = [batch.column("doc"), pa.array([len(s) for s in sets], pa.int64()), pa.array(_names(sets).view(np.int64)), lists(bits), lists(keys)]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "node", "bits", "keys"])

    return _source(docs).mapInArrow(rows, "doc long, n long, node long, bits array<long>, keys array<long>")


def _sets(docs: DataFrame, reps: DataFrame, words: int, filter_bits: int) -> DataFrame:
    """(node, shingles binary) of the documents in reps (column rep) and perhaps some others."""
    wanted = docs.sparkSession.sparkContext.broadcast(BitFilter.of(reps.select(F.xxhash64("rep").alias("name")), filter_bits))

    def sets_of(batches):
        for batch in batches:
            kept = pa.Table.from_batches([batch]).filter(pa.array(wanted.value.has(batch.column("name").to_numpy())))
            for part in slices(kept.to_batches(), "text"):
                sets = shingle_sets(*string_bytes(part.column("text")), words)
                yield pa.RecordBatch.from_arrays([pa.array(_names(sets).view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    return _source(docs).withColumn("name", F.xxhash64("doc")).mapInArrow(sets_of, "node long, shingles binary").dropDuplicates(["node"])


def _words(bits) -> np.ndarray:
    return bits.combine_chunks().flatten().to_numpy().view(U).reshape(-1, 4)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1)


def touching(key: np.ndarray, n: np.ndarray, bits: np.ndarray, percent: int, most: float) -> np.ndarray:
    """For rows sorted by key: the first row that each one is joined to by pairs of its key with alike sizes and bins.

    Turn r compares the r-th member of every bucket with those after it that are not joined to it yet.
    """
    label = np.arange(len(key))
    start = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    size = np.diff(np.append(start, len(key)))
    for turn in range(int(size.max(initial=1)) - 1):
        left = size - turn - 1
        start, size, left = start[left > 0], size[left > 0], left[left > 0]
        pivot = np.repeat(start + turn, left)
        other = pivot + 1 + np.arange(len(pivot)) - np.repeat(np.cumsum(left) - left, left)
        go = label[pivot] != label[other]
        pivot, other = pivot[go], other[go]
        near = (100 * np.minimum(n[pivot], n[other]) >= percent * np.maximum(n[pivot], n[other])) & (_apart(bits[pivot], bits[other]) <= most)
        pivot, other = pivot[near], other[near]
        # a bucket has one pivot a turn: what it joins takes the least of their labels
        least, to = label.copy(), np.arange(len(label))
        np.minimum.at(least, pivot, label[other])
        to[label[pivot]], to[label[other]] = least[pivot], least[pivot]
        label = to[label]
    return label


class _Unit:
    """Members with their full sets: ``near`` compares one with many."""

    def __init__(self, table: pa.Table, percent: int, most: float):
        self.n, self.bits, self.percent, self.most = table["n"].to_numpy(), _words(table["bits"]), percent, most
        flat, place, count = np.unique(np.concatenate([np.frombuffer(s.as_py(), U) for s in table["shingles"]]), return_inverse=True, return_counts=True)
        # a shingle of one member only is in no intersection
        self.ids = [x[count[x] > 1] for x in np.split(place, np.cumsum(self.n)[:-1])]
        self.size, self.mark = np.array([len(x) for x in self.ids]), np.zeros(len(flat), bool)

    def near(self, i: int, js: np.ndarray) -> np.ndarray:
        """Which of js have 100 * intersection >= percent * union with i; those whose bins differ too much are none."""
        n, size, percent = self.n, self.size, self.percent
        out = np.zeros(len(js), bool)
        enough = lambda both, at: 100 * both >= percent * (n[i] + n[js[at]] - both)
        some = np.flatnonzero((_apart(self.bits[i], self.bits[js]) <= self.most) & enough(np.minimum(size[i], size[js]), slice(None)))
        if len(some):
            self.mark[self.ids[i]] = True
            total = np.concatenate([[0], np.cumsum(self.mark[np.concatenate([self.ids[j] for j in js[some]])])])
            self.mark[self.ids[i]] = False
            ends = np.cumsum(size[js[some]])
            out[some] = enough(total[ends] - total[ends - size[js[some]]], some)
        return out

    def join(self, label: np.ndarray, left: np.ndarray, right: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Unite labels by the links between left and right (within left); pairs of one label are not compared."""
        found = []
        for at, i in enumerate(left):
            js = left[at + 1 :] if right is None else right
            js = js[label[js] != label[i]]
            js = js[self.near(i, js)] if len(js) else js
            if len(js):
                gone = np.unique(label[js])
                found += [(int(label[i]), int(g)) for g in gone]
                label[np.isin(label, gone)] = label[i]
        return found


def _rooted(members: DataFrame, percent: int, most: float) -> DataFrame:
    """(node, root, family, blocks) of members (node, n, bits, shingles, family, block, blocks): all pairs of a block are
    compared on full sets, and each member gets one member that stands for those it reaches there."""

    def roots(batches):
        for table, starts in whole_groups(batches, ["family", "block"]):
            node = table["node"].to_numpy()
            root = node.copy()
            for lo, hi in zip(starts[:-1], starts[1:]):
                if hi - lo > 1:
                    label = np.arange(hi - lo)
                    _Unit(table.slice(lo, hi - lo), percent, most).join(label, np.arange(hi - lo))
                    root[lo:hi] = node[lo:hi][label]
            yield from pa.table({"node": node, "root": root, "family": table["family"], "blocks": table["blocks"]}).to_batches()

    dealt = members.select("node", "n", "bits", "shingles", "family", "block", "blocks").repartition("family", "block").sortWithinPartitions("family", "block")
    return dealt.mapInArrow(roots, "node long, root long, family long, blocks long")


def _dealt(members: DataFrame, block: int, shingles: int, salt: int) -> DataFrame:
    """members (family, node, n, ...) with blocks, the number of blocks of their family, and their own one by chance."""
    many = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / shingles)).cast("long")
    large = stored(members.groupBy("family").agg(many.alias("blocks")).filter("blocks > 1"))
    rows = members.join(large, "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    return rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(salt)), F.col("blocks")))


def _able(members: DataFrame, percent: int, filter_bits: int) -> DataFrame:
    """The members (family, node, n, shingles, ...) that may be linked with another one of their family; linear in their shingles.

    Only shingles that another member has too can be in an intersection. With s of them, sets of n and m shingles are alike only if
    (100 + percent) s >= percent (n + m), and so for the other one; m is between percent and 100 / percent of n. So a member is left
    out if no size near its own leaves room for that. The filter of repeated shingles may let others through, never the
    reverse: what is left out has no link.
    """

    def names(batch):
        sets = [np.frombuffer(x.as_py(), U) for x in batch.column("shingles")]
        size = np.array([len(x) for x in sets], np.int64)
        family = np.repeat(batch.column("family").to_numpy().view(U), size)
        flat = np.concatenate(sets) if len(sets) else np.empty(0, U)
        return _mix(flat, _mix(family, family ^ U(0x51ED2701))), size

    def named(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(names(batch)[0].view(np.int64))], ["name"])

    seen = members.select("family", "shingles").mapInArrow(named, "name long").groupBy("name").agg(F.count(F.lit(1)).alias("k"))
    repeated = members.sparkSession.sparkContext.broadcast(BitFilter.of(seen.filter("k > 1").select("name"), filter_bits))

    def counted(batches):
        for batch in batches:
            name, size = names(batch)
            shared = np.concatenate([[0], np.cumsum(repeated.value.has(name.view(np.int64)))])
            ends = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("family"), batch.column("n"), pa.array(shared[ends] - shared[ends - size])], ["node", "family", "n", "s"])

    rows = stored(members.select("node", "family", "n", "shingles").mapInArrow(counted, "node long, family long, n long, s long"))
    step = F.floor(F.log("n") / float(np.log(1.001 * 100 / percent)))  # sizes that may be alike are one step apart at most
    room = (100 + percent) * F.col("s") - percent * F.col("n")
    rows = rows.withColumns({"step": step, "room": room})
    near = rows.groupBy("family", "step").agg(F.max("room").alias("most"), F.min("n").alias("least"))
    near = near.withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    near = near.groupBy("family", "step").agg(F.max("most").alias("most"), F.min("least").alias("least"))
    smallest = F.greatest(F.col("least"), F.ceil(percent * F.col("n") / 100 - 1e-9))
    kept = rows.join(near, ["family", "step"]).filter((F.col("most") >= percent * F.col("n")) & (F.col("room") >= percent * smallest))
    return members.join(kept.select("node"), "node", "left_semi")


def _across(members: DataFrame, percent: int, most: float, block: int, shingles: int) -> DataFrame:
    """Links (a, b) between components of members (node, n, bits, shingles, family, component), enough of them to join all
    components of a family that any two members join. Large components have blocks of their own, the others share some; each
    two blocks of a family meet in a unit, unless they are of one component."""
    weight = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    weight = stored(weight.withColumn("own", F.ceil(F.greatest(F.col("m") / block, F.col("s") / shingles)).cast("long")).withColumn("big", (2 * F.col("m") > block) | (2 * F.col("s") > shingles)))
    mixed = weight.filter("not big").groupBy("family").agg(F.ceil(F.greatest(F.sum("m") / block, F.sum("s") / shingles)).cast("long").alias("mixed"))
    weight = stored(weight.join(mixed, "family", "left"))
    index = F.when(F.col("big"), F.pmod(F.xxhash64("node", F.lit(13)), F.col("own"))).otherwise(F.pmod(F.xxhash64("component", F.lit(13)), F.col("mixed")))
    owner = F.when(F.col("big"), F.col("component"))
    placed = members.join(weight.select("family", "component", "own", "big", "mixed"), ["family", "component"]).withColumn("owner", owner).withColumn("part", F.xxhash64("big", "owner", index))
    count = F.explode(F.sequence(F.lit(0).cast("long"), F.col("own") - 1))
    parts = (
        weight.filter("big").select("family", owner.alias("owner"), count.alias("index")).withColumn("part", F.xxhash64(F.lit(True), "owner", "index"))
        .unionByName(weight.filter("not big").select("family", F.col("mixed").alias("own")).distinct().select("family", F.lit(None).cast("long").alias("owner"), count.alias("index")).withColumn("part", F.xxhash64(F.lit(False), "owner", "index")))
        .select("family", "owner", "part")
    )
    a, b = (parts.select("family", F.col("owner").alias(f"owner_{x}"), F.col("part").alias(x)) for x in "ab")
    met = a.join(b, "family").filter("a <= b and coalesce(owner_a <> owner_b, true) and (a <> b or owner_a is null)").withColumn("unit", F.xxhash64("family", "a", "b"))
    sides = met.select("family", "unit", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("part"))
    shipped = placed.join(stored(sides), ["family", "part"]).withColumn("first", F.col("part") == F.col("a")).withColumn("alone", F.col("a") == F.col("b"))

    def links(batches):
        for table, starts in whole_groups(batches, ["unit"]):
            out = []
            for lo, hi in zip(starts[:-1], starts[1:]):
                unit = table.slice(lo, hi - lo)
                names, label = np.unique(unit["component"].to_numpy(), return_inverse=True)
                first = unit["first"].to_numpy(zero_copy_only=False)
                if len(names) > 1:
                    sides = (np.arange(hi - lo),) if unit["alone"][0].as_py() else (np.flatnonzero(first), np.flatnonzero(~first))
                    out += [(names[i], names[j]) for i, j in _Unit(unit, percent, most).join(label, *sides)]
            yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    columns = ["node", "n", "bits", "shingles", "component", "unit", "first", "alone"]
    return shipped.select(columns).repartition("unit").sortWithinPartitions("unit").mapInArrow(links, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): each node of links (a, b) with the smallest node it reaches. Alternating large and small stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that the join below has plain shuffles on both sides and Spark splits a node of many edges
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        old, edges = edges, stored(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        drop(old, least)
        # the same edges again: count and sum of hashes tell
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, block: int = 512, shingles: int = 1 << 18, large: int = 1024, filter_bits: int = 1 << 26) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: sets of similarity percent / 100 or more are linked.

    A text of fewer than ``words`` words is one shingle; without words, or null, it is empty and linked with nothing.
    Null doc_id is treated as the least number and returned as null. Rows that share a doc_id count each by its own text.
    component_id is the smallest doc_id reachable; of ties and exact copies the smallest doc_id is kept. Other columns are
    ignored. ``block`` and ``shingles`` bound what a task compares at once, ``large`` the buckets whose pairs are looked at
    before families are formed; neither changes a result.
    """
    all_docs = stored(_sketched(docs, words))
    classes = stored(all_docs.filter("n > 0").groupBy("node").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("n", "bits", "keys"))))
    # one-bit bins of sets at the threshold differ with probability (1 - percent / 100) / 2
    chance = (100 - percent) / 200
    far = lambda deviations: BINS * chance + deviations * (BINS * chance * (1 - chance)) ** 0.5

    banded = classes.select("node", F.explode("keys").alias("key"))
    # stored, so that the join's sides are plain shuffles, whose hot keys Spark splits
    shared = stored(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least")).filter("size > 1"))
    buckets = stored(banded.join(shared, "key"))

    def touch(batches):
        for table, _ in whole_groups(batches, ["key"]):
            node = table["node"].to_numpy()
            label = touching(table["key"].to_numpy(), table["n"].to_numpy(), _words(table["bits"]), percent, far(6))
            joined = label != np.arange(len(node))
            yield pa.RecordBatch.from_arrays([pa.array(node[joined]), pa.array(node[label[joined]])], ["a", "b"])

    small = buckets.filter(F.col("size") <= large).join(classes.select("node", "n", "bits"), "node").select("key", "node", "n", "bits")
    links = small.repartition("key").sortWithinPartitions("key").mapInArrow(touch, "a long, b long")
    families = components(links.unionByName(buckets.filter(F.col("size") > large).select(F.col("node").alias("a"), F.col("least").alias("b"))))

    drop(shared, buckets)
    grouped = stored(families.withColumnRenamed("component", "family").join(classes.select("node", "rep", "n", "bits"), "node"))
    dealt = _dealt(grouped, block, shingles, 11)
    sets = stored(dealt.join(_sets(docs, grouped, words, filter_bits), "node"))
    most = far(8)
    first = stored(_rooted(sets, percent, most))
    named = first.filter("blocks = 1").select("node", F.col("root").alias("component"))
    several = first.filter("blocks > 1")
    if several.take(1):
        # those that stand for a block's components meet in new blocks, then members of components still apart meet
        held = sets.filter("blocks > 1").select("node", "n", "bits", "shingles")
        heads = several.select(F.col("root").alias("node"), "family").distinct().join(held, "node")
        second = stored(_rooted(_dealt(heads, block, shingles, 12), percent, most)).select(F.col("node").alias("root"), F.col("root").alias("component"))
        labels = stored(several.join(second, "root").select("node", "family", "component"))
        apart = labels.groupBy("family").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("family")
        open_ = stored(labels.join(apart, "family").join(held, "node"))
        found = stored(_across(stored(_able(open_, percent, filter_bits)), percent, most, block, shingles).distinct()) if open_.take(1) else open_
        if found.take(1):
            ends = components(found).select(F.col("node").alias("component"), F.col("component").alias("last"))
            labels = labels.join(ends, "component", "left").select("node", F.coalesce("last", "component").alias("component"))
        named = named.unionByName(labels.select("node", "component"))

    # the smallest doc_id of each component, for classes with copies or links
    known = stored(classes.select("node", "rep", "copies").join(named, "node", "left").filter("copies > 1 or component is not null").select("node", "rep", F.coalesce("component", "node").alias("component")))
    least = stored(known.groupBy("component").agg(F.min("rep").alias("least")))
    final = stored(known.join(least, "component").select("node", "least"))
    # rows without a set have a key of their own, so that they do not meet in one task
    rows = all_docs.select("doc", "n", F.when(F.col("n") > 0, F.col("node")).otherwise(F.xxhash64("doc")).alias("node")).join(final, "node", "left")
    component = F.when(F.col("n") > 0, F.coalesce("least", "doc")).otherwise(F.col("doc"))
    null = F.lit(-(2**63))
    return rows.select(
        F.when(F.col("doc") != null, F.col("doc")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(component != null, component).alias("component_id"),
        (F.col("doc") == component).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is kept; rows that share one stay together."""
    kept = near_duplicates(docs.select("doc_id", "text"), words, percent).filter("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
