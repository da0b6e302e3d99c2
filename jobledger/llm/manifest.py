"""Merkle manifest of a dataset: nested-interval labels, ancestors by containment joins, siblings by interval difference.

Every node of a tree carries the interval [lo, hi) of leaf ranks it covers. A node is an ancestor of a leaf if its
interval holds the leaf's rank, and the siblings on a leaf's path are the children of an ancestor whose intervals don't.
No node stores a pointer or a position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobledger.llm.shared import saved

#: A run of nodes that become one, and levels that a bucket of the containment join holds: buckets of FANOUT ** BAND nodes.
FANOUT, BAND = 2, 6
#: Leaves that meet their tree's own proof in one key.
BLOCK = 4096


def framed(c: Column) -> Column:
    """``-`` for null, else the UTF-8 length in bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*[framed(c) for c in columns]), 256)


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with ``tree`` and the columns ``order`` -> also lo (rank in the tree from 0) and n (leaves of the tree).

    Leaves are range-sorted by tree and order and written with the number of their range. Ranks are places within
    (range, tree) plus the leaves of earlier ranges, of which there is a row for each range and tree: a tree with most of all leaves
    spreads over the ranges. Equal rows, of which any may come first, are told apart by where they were read, so they spread too.
    """
    tie = leaves.withColumn("tie", F.monotonically_increasing_id())
    keys = [F.col("tree").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("tie")]
    ranges = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = saved(tie.repartitionByRange(ranges, *keys).withColumn("range", F.spark_partition_id()))
    counts = sorted_.groupBy("range", "tree").agg(F.count("*").alias("here"))
    of_tree = Window.partitionBy("tree")
    base = F.coalesce(F.sum("here").over(of_tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("range").alias("o_range"), F.col("tree").alias("o_tree"), base.alias("base"), F.sum("here").over(of_tree).alias("n"))
    place = F.row_number().over(Window.partitionBy("range", "tree").orderBy(*keys[1:])) - 1
    met = sorted_.withColumn("place", place).hint("merge").join(offsets, (F.col("range") == F.col("o_range")) & F.col("tree").eqNullSafe(F.col("o_tree")))
    return met.withColumn("lo", (F.col("base") + F.col("place")).cast("long")).drop("tie", "range", "o_range", "o_tree", "base", "place")


def depth_of(n: Column) -> Column:
    """Levels over the leaves: the least d with FANOUT ** d >= n."""
    out = F.lit(0)
    for d in range(1, 60):
        out = out + (n > FANOUT ** (d - 1)).cast("int")
    return out


def _parents(nodes: Column, level: int) -> Column:
    """An array of nodes of one level, in order -> the nodes over them, with their children."""
    child = lambda c: F.struct(c["lo"].alias("lo"), c["hi"].alias("hi"), c["digest"].alias("digest"))

    def over(i: Column) -> Column:
        run = F.slice(nodes, i * FANOUT + 1, F.lit(FANOUT))
        digest = F.sha2(F.array_join(F.transform(run, lambda c: c["digest"]), ""), 256)
        return F.struct(F.lit(level).alias("level"), F.element_at(run, 1)["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"), digest.alias("digest"), F.transform(run, child).alias("children"))

    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(nodes) / FANOUT).cast("int") - 1), over)


def band_of(nodes: DataFrame, base: int) -> DataFrame:
    """Nodes of level ``base`` -> the inner nodes of the next BAND levels: tree, n, bucket, level, lo, hi, digest, children.

    Intervals of level l are multiples of FANOUT ** l wide but for the last one's end, so the nodes below one node of the band's
    top lie in one bucket: at most FANOUT ** BAND rows meet. A tree has no level over that of its root.
    """
    bucket = F.floor(F.col("lo") / FANOUT ** (base + BAND)).cast("long")
    members = nodes.groupBy("tree", "n", bucket.alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("level_0"))
    empty = F.lit(None)
    for i in range(1, BAND + 1):
        members = members.withColumn(f"level_{i}", F.when(depth_of(F.col("n")) >= base + i, _parents(F.col(f"level_{i - 1}"), base + i)).otherwise(empty))
    inner = F.flatten(F.array_compact(F.array(*[F.col(f"level_{i}") for i in range(1, BAND + 1)])))
    return members.select("tree", "n", "bucket", F.inline(inner))


def node_labels(leaves: DataFrame) -> list[DataFrame]:
    """Ranked leaves (tree, n, lo, digest) -> inner nodes of all trees, a table for each band of levels from below.

    Each has tree, n, bucket, level, lo, hi, digest and children (lo, hi, digest of each). The number of bands comes
    from the largest tree.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    now, base, out = leaves.select("tree", "n", "lo", (F.col("lo") + 1).alias("hi"), "digest"), 0, []
    while FANOUT**base < most:
        band = saved(band_of(now.where(F.col("n") > FANOUT**base), base))
        out.append(band)
        base += BAND
        now = band.where(F.col("level") == base).select("tree", "n", "lo", "hi", "digest")
    return out


#: What one ancestor adds to a proof: digests of the siblings left and right of the path, each side concatenated.
STEP = "struct<level:int,left:string,right:string>"


def _joined(children: Column, keep) -> Column:
    return F.array_join(F.transform(F.filter(children, keep), lambda c: c["digest"]), "")


def proofs(leaves: DataFrame, bands: list[DataFrame]) -> DataFrame:
    """Ranked leaves -> (tree, lo, steps, root): siblings on the way up and the tree's root.

    From the top band down, the nodes under a band (for the lowest, the leaves) meet the band's nodes of their bucket,
    those whose interval contains them are their ancestors, and children of an ancestor that don't contain them are siblings. What
    the bucket's top needs further up comes with a join of its own, one row a bucket. Each join is keyed by (tree, bucket).
    """
    above = None
    for k in reversed(range(len(bands))):
        base = k * BAND
        width = FANOUT ** (base + BAND)
        items = leaves.select("tree", "n", "lo", "digest") if k == 0 else bands[k - 1].where(F.col("level") == base).select("tree", "n", "lo", "digest")
        items = items.where(F.col("n") > FANOUT**base).select(F.col("tree").alias("i_tree"), F.floor(F.col("lo") / width).cast("long").alias("i_bucket"), F.col("lo").alias("i_lo"))
        inside = (F.col("lo") <= F.col("i_lo")) & (F.col("i_lo") < F.col("hi"))
        met = items.hint("shuffle_hash").join(bands[k].select("tree", "n", "bucket", "level", "lo", "hi", "digest", "children"), F.col("i_tree").eqNullSafe(F.col("tree")) & (F.col("i_bucket") == F.col("bucket")) & inside)
        # of the ancestor's interval, what the path's own child doesn't cover
        left = _joined(F.col("children"), lambda c: c["hi"] <= F.col("i_lo"))
        right = _joined(F.col("children"), lambda c: c["lo"] > F.col("i_lo"))
        top = F.max(F.struct("level", F.col("digest").alias("digest")))
        own = met.groupBy("i_tree", "i_bucket", "i_lo").agg(F.array_sort(F.collect_list(F.struct("level", left.alias("left"), right.alias("right")))).alias("steps"), top["digest"].alias("root"))
        if above is None:
            above = own.select(F.col("i_tree").alias("tree"), F.col("i_lo").alias("lo"), "steps", "root")
        else:
            higher = above.select(F.col("tree").alias("a_tree"), F.floor(F.col("lo") / width).cast("long").alias("a_bucket"), F.col("steps").alias("a_steps"), F.col("root").alias("a_root"))
            met = own.hint("merge").join(higher, F.col("i_tree").eqNullSafe(F.col("a_tree")) & (F.col("i_bucket") == F.col("a_bucket")), "left")
            steps = F.concat("steps", F.coalesce("a_steps", F.array().cast(f"array<{STEP}>")))
            above = met.select(F.col("i_tree").alias("tree"), F.col("i_lo").alias("lo"), steps.alias("steps"), F.coalesce("a_root", "root").alias("root"))
        if k:
            above = saved(above)
    single = leaves.where("n = 1").select("tree", "lo", F.array().cast(f"array<{STEP}>").alias("steps"), F.col("digest").alias("root"))
    return single if above is None else above.union(single)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def merkle(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """``leaves`` with ``tree``, ``digest`` and the columns ``order`` -> every leaf with lo, n, steps and root of its tree; the inner nodes.

    Rows with equal tree and order may come in any order; put the digest last to make only equal leaves equal. Null trees are a tree.
    No leaves give empty tables.
    """
    placed = saved(ranked(leaves, order))
    bands = node_labels(placed)
    found = proofs(placed, bands).select(F.col("tree").alias("p_tree"), F.col("lo").alias("p_lo"), "steps", "root")
    return placed.hint("merge").join(found, F.col("tree").eqNullSafe(F.col("p_tree")) & (F.col("lo") == F.col("p_lo"))).drop("p_tree", "p_lo"), bands


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tree: str = "lang", order: str = "doc_id", forged: dict[str, Column] | None = None) -> DataFrame:
    """Every row of ``docs`` as a leaf of a two-stage Merkle tree: ``order`` and ``tree`` as given, leaf, forged_leaf, steps, subroot, root.

    The leaf is a digest over ``columns``, framed. Leaves of each value of ``tree`` ascend by ``order`` (nulls first) and then by
    digest; the subroots ascend by ``tree``, null first, and form one tree over them. ``steps`` holds the siblings on the way from the leaf
    to the root: :func:`folded` gives the root again. ``forged`` replaces columns for a second digest of the row.

    Texts are read once and leave their task as digests only. Null columns are written as ``-``; a null tree value is a tree of its own; rows
    that repeat a key, or are equal, are leaves each for itself; other columns don't count. An empty table gives no rows.
    """
    value = {c: F.col(f"`{c}`") for c in columns}
    leaves = docs.select(F.col(f"`{tree}`").cast("string").alias("tree"), F.col(f"`{order}`").alias("at"), row_digest(*value.values()).alias("digest"), row_digest(*(value | (forged or {})).values()).alias("forged_leaf"))
    lower, _ = merkle(leaves, ["at", "digest"])
    lower = saved(lower)
    subroots = lower.where("lo = 0").select(F.lit(0).alias("tree"), F.col("tree").alias("name"), F.col("n").alias("size"), F.col("root").alias("digest"))
    upper, _ = merkle(subroots, ["name"])
    # a row for each block of a tree's leaves, so that those of a tree with most of all rows meet it in many tasks
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / BLOCK).cast("long")))
    upper = upper.select(F.col("name").alias("u_name"), blocks.alias("u_block"), F.col("steps").alias("u_steps"), F.col("root").alias("u_root"))
    met = lower.withColumn("block", F.floor(F.col("lo") / BLOCK).cast("long")).hint("merge").join(upper, F.col("tree").eqNullSafe(F.col("u_name")) & (F.col("block") == F.col("u_block")))
    return met.select(F.col("at").alias(order), F.col("tree").alias(tree), F.col("digest").alias("leaf"), "forged_leaf", F.concat("steps", "u_steps").alias("steps"), F.col("root").alias("subroot"), F.col("u_root").alias("root"))


def proof_digest(steps: Column) -> Column:
    """One digest over all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)
