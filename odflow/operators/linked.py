"""Suppression in a flow matrix whose margins are published too.

Whoever knows a row's or a column's total and all of its cells but one knows that one. More generally, hidden cells are edges
between the margins of their row and their column, and the published totals tell a cell exactly if its edge is a bridge: if it lies
on no cycle, then the cells on one side of it have no room to move. Margins that are withheld tell nothing; all of them count as one
node. So further cells are hidden, or margins withheld, until the graph of hidden cells has no bridge.

Every step is a few joins and groups over the hidden cells, and is written; what reaches the driver are counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.operators.flows import seed_blocks
from odflow.operators.release import passes
from odflow.sources.store import cut
from odflow.spec import Limits

#: Name of the one node that stands for all withheld margins: no unit's name is empty.
_OPEN = ""


def bridges(edges: DataFrame) -> DataFrame:
    """(id) of the bridges of a graph between origins and destinations; edges: id, o, d, parallel ones allowed.

    A tree by breadth is grown from the least origin of every block. Each edge outside of it has a label of 64 bits, and a tree edge
    the exclusive or of the labels of all edges that span it, summed up from the leaves: a bridge is spanned by none, so its label
    is 0. Another edge's label is 0 by chance only, once in 2^64.
    """
    name = lambda side, c: F.concat(F.lit(side), F.col(c))
    both = edges.select("id", F.explode(F.array(F.struct(name("o", "o").alias("node"), name("d", "d").alias("other")), F.struct(name("d", "d").alias("node"), name("o", "o").alias("other")))).alias("x"))
    arcs = cut(both.select("id", "x.*"))
    roots = seed_blocks(edges).select(F.concat(F.lit("o"), F.col("block")).alias("node")).distinct()
    none = F.lit(None).cast("string")
    levels = [cut(roots.select("node", none.alias("parent"), none.alias("via")))]
    while True:
        step = levels[-1].select(F.col("node").alias("from")).join(arcs.withColumnRenamed("node", "from"), "from").groupBy(F.col("other").alias("node")).agg(F.min(F.struct("from", "id")).alias("x"))
        # neighbours of a level are in the one before it or not yet reached: the graph has two sides
        fresh = step.join(levels[-2].select("node"), "node", "left_anti") if len(levels) > 1 else step
        fresh = cut(fresh.select("node", F.col("x.from").alias("parent"), F.col("x.id").alias("via")))
        if not fresh.limit(1).count():
            break
        levels.append(fresh)
    tree = levels[0].select("via")
    for level in levels[1:]:
        tree = tree.unionByName(level.select("via"))
    spanning = arcs.join(tree.select(F.col("via").alias("id")).filter("id is not null"), "id", "left_anti").groupBy("node").agg(F.bit_xor(F.xxhash64("id")).alias("own"))
    spanning = cut(spanning)
    found, above = None, None
    for level in reversed(levels[1:]):
        labels = level.join(spanning, "node", "left")
        if above is not None:
            labels = labels.join(above, "node", "left")
        label = F.coalesce(F.col("own"), F.lit(0).cast("long"))
        if above is not None:
            label = label.bitwiseXOR(F.coalesce(F.col("below"), F.lit(0).cast("long")))
        labels = cut(labels.select("parent", "via", label.alias("label")))
        above = labels.groupBy(F.col("parent").alias("node")).agg(F.bit_xor("label").alias("below"))
        mine = labels.filter("label = 0").select(F.col("via").alias("id"))
        found = mine if found is None else found.unionByName(mine)
    return found if found is not None else edges.select("id").filter(F.lit(False))


def protect_margins(cells: DataFrame, keys: Sequence[str] = (), limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(cells, margins) that may be published together, for tables (keys, o, d, total, n, n_psu) whose margins by o and by d are too.

    cells: as given, with hidden: null, ``floor`` (too few persons or households) or ``linked`` (hidden so that others cannot be worked
    out). margins: keys, side (o or d), unit, published. No hidden cell follows from the published cells and margins. Pairs that
    are not in the table are taken to be known zeros, and totals over rows and columns to be known where they are sums of these margins.

    In each round a cell that could be worked out takes with it the smallest shown cell of the one of its two margins that
    has fewer hidden cells, one whose other margin has hidden cells already going first; where neither has a cell left to show,
    both margins are withheld. Rounds end, for each hides a cell or withholds a margin.
    """
    named = lambda c: F.concat_ws("|", *keys, c)
    all_ = cut(cells.select(named("o").alias("o"), named("d").alias("d"), F.col("total"), passes(limits).alias("ok")))
    hidden = cut(all_.filter(~F.col("ok")).select("o", "d", F.lit("floor").alias("hidden")))
    withheld = all_.select(F.lit("o").alias("side"), F.col("o").alias("name")).filter(F.lit(False))
    while True:
        graph = cut(_graph(hidden, withheld))
        told = cut(bridges(graph).join(graph, "id").filter("real").select("id", F.col("own_o").alias("o"), F.col("own_d").alias("d")))
        if not told.limit(1).count():
            break
        more, shut = _next(all_, hidden, told)
        hidden = cut(hidden.unionByName(more.withColumn("hidden", F.lit("linked"))))
        withheld = cut(withheld.unionByName(shut).distinct())
    marks = hidden.withColumnsRenamed({"o": "_o", "d": "_d"})
    out = cells.withColumns({"_o": named("o"), "_d": named("d")}).join(marks, ["_o", "_d"], "left").select(*cells.columns, "hidden")
    side = lambda c: cells.select(*keys, F.lit(c).alias("side"), F.col(c).alias("unit"), named(c).alias("name")).distinct()
    shut = withheld.withColumn("_shut", F.lit(True))
    margins = side("o").unionByName(side("d")).join(shut, ["side", "name"], "left").select(*keys, "side", "unit", F.col("_shut").isNull().alias("published"))
    return out, margins


def _graph(hidden: DataFrame, withheld: DataFrame) -> DataFrame:
    """Edges id, o, d, own_o, own_d, real: hidden cells between margins, all withheld margins as one node.

    That node has a name on either side; an edge that is no cell joins the two.
    """
    edges = hidden.select("o", "d")
    for c in ("o", "d"):
        shut = withheld.filter(F.col("side") == c).select(F.col("name").alias(c), F.lit(_OPEN).alias(f"to_{c}"))
        edges = edges.join(shut, c, "left")
    at = lambda c: F.coalesce(f"to_{c}", c).alias(c)
    real = edges.select(F.concat_ws("\x00", "o", "d").alias("id"), at("o"), at("d"), F.col("o").alias("own_o"), F.col("d").alias("own_d"), F.lit(True).alias("real"))
    joint = withheld.select(F.lit("\x00").alias("id"), *(F.lit(_OPEN).alias(c) for c in ("o", "d", "own_o", "own_d")), F.lit(False).alias("real")).distinct()
    return real.unionByName(joint)


def _next(all_: DataFrame, hidden: DataFrame, told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(o, d) to hide and (side, name) to withhold for the cells that could be worked out.

    Every margin offers its best shown cell once, so no margin's cells meet all of its told ones.
    """
    degree = {c: hidden.groupBy(c).agg(F.count(F.lit(1)).alias(f"deg_{c}")) for c in ("o", "d")}
    shown = all_.join(hidden.select("o", "d"), ["o", "d"], "left_anti").join(degree["o"], "o", "left").join(degree["d"], "d", "left").fillna(0, ["deg_o", "deg_d"])
    offers = told.join(degree["o"], "o").join(degree["d"], "d")
    for c, other in (("o", "d"), ("d", "o")):
        best = F.min(F.struct((F.col(f"deg_{other}") == 0).alias("fresh"), "total", F.col("o").alias("to_o"), F.col("d").alias("to_d"))).alias(f"best_{c}")
        offers = offers.join(shown.join(told.select(c).distinct(), c, "left_semi").groupBy(c).agg(best), c, "left")
    first_o = F.col("deg_o") <= F.col("deg_d")
    pick = F.when(first_o, F.coalesce("best_o", "best_d")).otherwise(F.coalesce("best_d", "best_o"))
    picked = cut(offers.select("o", "d", pick.alias("pick")))
    more = picked.filter("pick is not null").select(F.col("pick.to_o").alias("o"), F.col("pick.to_d").alias("d")).distinct()
    shut = picked.filter("pick is null").select(F.explode(F.array(F.struct(F.lit("o").alias("side"), F.col("o").alias("name")), F.struct(F.lit("d").alias("side"), F.col("d").alias("name")))).alias("x")).select("x.*")
    return more, shut
