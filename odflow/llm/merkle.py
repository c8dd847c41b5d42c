"""A Merkle manifest of a dataset: leaves of rows, a tree of threes per source, a tree of threes over the sources.

A node is the lowercase hex SHA-256 of its inputs end to end, digests as hex text. A row's leaf takes doc_id, source, lang,
n_chars and text, each ``-`` if null, else its UTF-8 byte count, a colon and the value. In each source leaves ascend by
doc_id; while more than one node remains, every three consecutive ones become their parent (the last run may be shorter, one
node included). The subroots, ordered by source, are reduced alike to the root.

How: a rank's base-3 digits name the way from the top to a leaf. Ranks are cut into blocks of 3**DIGITS. Inside a block the
lowest digit is grouped away first, the children nested as structs in their parent, then the next one, until one row holds the
block as a nested struct of at most 3**DIGITS leaves; after one shuffle by (tree, block) all these groups stay in their
partition. Roots of blocks are the leaves of the next round, so no row ever holds more than one block, whatever a source's
size. Proofs come back by transforming and exploding the nested structs, top down; a block's way above it meets its row by
one more group, not by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odflow.llm.common import stored

#: Levels of the tree inside a block: 729 leaves.
DIGITS = 6

PATH = "array<struct<left: string, right: string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(column: str | Column) -> Column:
    """A value as the leaf takes it: ``-`` for null, else byte count, colon, value."""
    value = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(text: str | Column = "text") -> Column:
    return F.sha2(F.concat(*(encoded(c) for c in FIELDS[:-1]), encoded(text)), 256)


def ranked(rows: DataFrame, tree: list[str], order: list[str]) -> DataFrame:
    """rows with rank (from 0 in its tree by ``order``, nulls first) and total (rows of the tree); all ties are broken by row.

    Rows are sorted over all machines by (tree, order), so a tree may be longer than any partition. A row's rank is its place
    in its partition plus what the tree has in earlier ones: a table of one row for each tree and partition.
    """
    keys = [*tree, *order]
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in (*keys, "_row")]
    spread = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    spread = stored(spread.select(*rows.columns, F.spark_partition_id().alias("_part"), place.alias("_place")).drop("_row"))
    # one row a tree and partition; the first place of a tree there is subtracted, what it has before is added
    runs = spread.groupBy(*tree, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    runs = runs.select(*(F.col(c).alias(f"_of_{c}") for c in tree), F.col("_part").alias("_of_part"), "_n", "_first")
    w = Window.partitionBy(*(f"_of_{c}" for c in tree)) if tree else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(w.orderBy("_of_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("*", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("total"))
    same = F.col("_part") == F.col("_of_part")
    for c in tree:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    out = spread.join(runs, same)
    return out.withColumn("rank", F.col("_place") + F.col("_shift")).drop("_part", "_place", "_of_part", "_n", "_first", "_shift", *(f"_of_{c}" for c in tree))


def _parent(level: int) -> Column:
    """Hash of a node from its children: where the tree has one node left below, that one is passed on."""
    alone = F.col("total") <= F.lit(3**level)
    kids = F.transform("kids", lambda k: k["hash"])
    return F.when(alone, kids[0]).otherwise(F.sha2(F.array_join(kids, ""), 256))


def _blocks(nodes: DataFrame, tree: list[str], below: int, digits: int) -> DataFrame:
    """tree, block, total, hash and the block as nested structs.

    nodes: tree, rank, total, hash, item (a struct that is carried along). ``below`` is the number of levels under the nodes.
    """
    rank = F.col("rank")
    digit = lambda d: F.pmod(F.floor(rank / F.lit(3**d)), F.lit(3)).cast("int")
    out = nodes.select(
        *tree, "total", F.floor(rank / F.lit(3**digits)).alias("block"), *(digit(d).alias(f"d{d}") for d in range(digits)), "hash", "item"
    ).repartition(*tree, "block")
    body: tuple[str, ...] = ("hash", "item")
    for d in range(digits):
        left = [f"d{x}" for x in range(d + 1, digits)]
        kid = F.struct(F.col(f"d{d}").alias("digit"), *body)
        out = out.groupBy(*tree, "block", "total", *left).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        out = out.withColumn("hash", _parent(below + d))
        body = ("hash", "kids")
    return out


def _steps(kids: Column, total: Column, level: int) -> Column:
    """For each child: itself, and what stands left and right of it among its siblings (no step where it is passed on)."""
    hashes = F.transform(kids, lambda k: k["hash"])

    def step(kid: Column, at: Column) -> Column:
        left, right = F.array_join(F.slice(hashes, F.lit(1), at), ""), F.array_join(F.slice(hashes, at + 2, F.lit(3)), "")
        here = F.array(F.struct(left.alias("left"), right.alias("right")))
        return F.struct(kid.alias("node"), F.when(total > F.lit(3**level), here).otherwise(F.array().cast(PATH)).alias("step"))

    return F.transform(kids, step)


def _unnested(blocks: DataFrame, tree: list[str], below: int, digits: int) -> DataFrame:
    """tree, total, hash, item, path and root of every node of a block; path lists the steps from the node up to the root."""
    keep = [F.col(c) for c in (*tree, "total", "root")]
    out = blocks.select(*keep, "path", "kids")
    for d in reversed(range(digits)):
        out = out.select(*keep, "path", F.explode(_steps(F.col("kids"), F.col("total"), below + d)).alias("x"))
        path = F.concat("x.step", "path").alias("path")
        out = out.select(*keep, path, "x.node.kids") if d else out.select(*keep, path, "x.node.hash", "x.node.item")
    return out


def _reduced(nodes: DataFrame, tree: list[str], longest: int, digits: int) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of blocks, lowest first, and (tree, hash) of the tops. Each round is written: its roots feed the next one."""
    rounds: list[DataFrame] = []
    while True:
        blocks = stored(_blocks(nodes, tree, digits * len(rounds), digits))
        rounds.append(blocks)
        if longest <= 3 ** (digits * len(rounds)):
            return rounds, blocks.select(*tree, "hash")
        nodes = blocks.select(*tree, F.col("block").alias("rank"), "total", "hash", F.struct(F.col("block")).alias("item"))


def _with_way(blocks: DataFrame, way: DataFrame, keys: list[str]) -> DataFrame:
    """blocks with the path above each and the root. Both have one row a key, so one group brings them together."""
    empty = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    carried = blocks.select(*keys, "total", "kids", empty(way, "path"), empty(way, "root"))
    above = way.select(*keys, empty(blocks, "total"), empty(blocks, "kids"), "path", "root")
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    return carried.unionByName(above).groupBy(*keys).agg(*(first(c) for c in ("total", "kids", "path", "root")))


def _proofs(rounds: list[DataFrame], tree: list[str], way: DataFrame, digits: int) -> DataFrame:
    """tree, hash, item, path, root of every leaf. way: tree, path, root above each tree's top."""
    way = way.withColumn("block", F.lit(0).cast("long"))
    for k in reversed(range(len(rounds))):
        nodes = _unnested(_with_way(rounds[k], way, [*tree, "block"]), tree, digits * k, digits)
        if k:
            way = nodes.select(*tree, F.col("item.block").alias("block"), "path", "root")
    return nodes


def manifest(docs: DataFrame, changed: Column | None = None, digits: int = DIGITS) -> DataFrame:
    """One row a row of docs: doc_id, source, leaf, changed, subroot, root, path.

    path: array of (left, right), the siblings' hashes end to end on either side, from the leaf's level to the root's.
    changed: a column of docs that is carried along, such as the leaf of a tampered row; null if none is given.
    Rows of one doc_id in one source are ordered by leaf; equal rows give equal leaves at consecutive places. A null doc_id
    stands first, and so does the null source; the empty source is another one. An empty table gives no row.
    """
    rows = docs.select("doc_id", "source", leaf_hash().alias("hash"), (F.lit(None).cast("string") if changed is None else changed).alias("changed"))
    nodes = ranked(stored(rows), ["source"], ["doc_id", "hash"])
    nodes = stored(nodes.select("source", "rank", "total", "hash", F.struct("doc_id", "changed").alias("item")))
    longest = nodes.agg(F.max("total")).first()[0] or 0
    rounds, tops = _reduced(nodes, ["source"], longest, digits)
    subroots = stored(ranked(tops, [], ["source"]).select("rank", "total", "hash", F.struct("source").alias("item")))
    upper, root = _reduced(subroots, [], subroots.count(), digits)
    sources = _proofs(upper, [], root.select(F.array().cast(PATH).alias("path"), F.col("hash").alias("root")), digits)
    # a source's subroot is known here, and goes down to its leaves with the root
    way = sources.select("item.source", "path", F.struct("root", F.col("hash").alias("subroot")).alias("root"))
    leaves = _proofs(rounds, ["source"], way, digits)
    return leaves.select("item.doc_id", "source", F.col("hash").alias("leaf"), "item.changed", "root.subroot", "root.root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_hash(path: Column) -> Column:
    """One hash over all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def without_newlines(docs: DataFrame) -> Column:
    """The leaf after deleting the text's line feeds, for rows of an even unsigned CRC-32 of the decimal doc_id; else null."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, leaf_hash(F.translate("text", "\n", "")))


def verified_proofs(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row, tampered as ``without_newlines`` says.

    A null doc_id has no CRC-32: its row is left as it is.
    """
    rows = manifest(docs, without_newlines(docs), digits)
    rows = rows.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
