"""Merkle manifest of a table: a tree of digests a group, one tree over the groups' roots, and a proof for every row by pointer jumping.

1. Leaves are ordered by a range shuffle and written; a row's place in the order is its index in the sorted part plus the sizes of the parts
   before, so no task sees a whole group.
2. A tree is climbed STEP levels at once: 2 ** STEP consecutive nodes meet, and each keeps the siblings on its way up to their common ancestor, its
   *segment*. The number of nodes falls by 2 ** STEP each time.
3. Pointer jumping: a node whose segment reaches `d` levels up is joined with the ancestor it ends at, whose own segment goes on from there. The two are
   concatenated, so the distance doubles with each self-join until every leaf reaches the root. An ancestor that is d levels up has at
   most 2 ** d rows; it stands in several lanes where that is many, unless the ancestors are so few, as counted, that they are broadcast.
4. Which levels have a sibling, and on which side, follows from a node's place and the number of leaves, so a segment is bare digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, meet, written

STEP = 4
#: Ancestors are broadcast if they are no more than this; a segment of 64 levels has 2 KB.
FEW_NODES = 2_000
#: Rows that may meet at one ancestor before it is given lanes.
FEW_ROWS = 4_096


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the length in bytes, a colon and the value, so that no two rows have the same concatenation."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*map(field, values)))


def levels(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves: the bits of n - 1."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, str]:
    """Rows with `place`, 0, 1, 2 ... in this order over the whole table, and where they are written. Rows that tie in all columns of the order
    must be alike in all others."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_, path = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    before, offsets = 0, []
    for p, size in sorted(tuple(r) for r in sorted_.groupBy(part).count().collect()):  # a row a part of the shuffle, however large the table
        offsets.append((p, before))
        before += size
    if not offsets:
        return sorted_, path
    shift = F.broadcast(spark.createDataFrame(offsets, "part long, before long"))
    return sorted_.withColumn("part", part).join(shift, "part").withColumn("place", F.col("before") + F.col("place").bitwiseAND(F.lit(2**33 - 1))).drop("part", "before"), path


def _pairs(nodes: str) -> Column:
    """Digests of every two neighbours in a list."""
    one = lambda j: digest(F.concat(F.get(nodes, 2 * j), F.coalesce(F.get(nodes, 2 * j + 1), F.lit(""))))
    return F.transform(F.sequence(F.lit(0), ((F.size(nodes) + 1) / 2).cast("int") - 1), one)


def _climb(nodes: DataFrame, height: int) -> DataFrame:
    """Families of 2 ** STEP consecutive nodes (grp, pos, n, hash, more) that are `height` levels up: members with their segments, and the top digest."""
    fam = nodes.groupBy("grp", "n", F.shiftright("pos", STEP).alias("up")).agg(F.array_sort(F.collect_list(F.struct("pos", "hash", "more"))).alias("kids"))
    fam = fam.withColumn("l0", F.transform("kids", lambda k: k["hash"]))
    for i in range(STEP):
        fam = fam.withColumn(f"l{i + 1}", F.when(levels(F.col("n")) > height + i, _pairs(f"l{i}")).otherwise(F.col(f"l{i}")))

    def segment(k: Column) -> Column:
        at = k["pos"].bitwiseAND(F.lit(2**STEP - 1)).cast("int")
        beside = [F.when(levels(F.col("n")) > height + i, F.get(f"l{i}", F.shiftright(at, i).bitwiseXOR(F.lit(1)))) for i in range(STEP)]
        return F.unhex(F.concat(*[F.coalesce(b, F.lit("")) for b in beside]))

    members = F.transform("kids", lambda k: F.struct(k["pos"].alias("pos"), segment(k).alias("seg"), k["more"].alias("more")))
    return fam.select("grp", "n", "up", members.alias("members"), F.element_at(f"l{STEP}", 1).alias("top"))


def grow(leaves: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Trees over leaves (grp, pos, n, hash, more), n being the leaves of the group: (roots: grp, root; leaves: grp, pos, n, seg, more; paths
    of tables that only the roots still need)."""
    spark, paths = leaves.sparkSession, []
    least = lambda height: F.lit(1).cast("long") * 2**height  # noqa: E731  more leaves than this have several nodes at that height
    now, height, nodes, roots = leaves, 0, None, []
    while True:
        alone = now.filter(F.col("n") <= least(height))
        roots.append(alone.select("grp", F.col("hash").alias("root")))
        if height == 0:
            bottom = alone.select("grp", "pos", "n", F.lit(b"").alias("seg"), "more")
        some, path = written(_climb(now.filter(F.col("n") > least(height)), height))
        paths.append(path)
        if some.isEmpty():
            break
        own = some.select("grp", "n", F.lit(height // STEP).alias("step"), F.explode("members").alias("m")).select("grp", "n", "step", "m.*")
        nodes = own if nodes is None else nodes.unionByName(own)
        now = some.select("grp", F.col("up").alias("pos"), "n", F.col("top").alias("hash"), F.lit(None).cast(leaves.schema["more"].dataType).alias("more"))
        height += STEP
    rooted = roots[0]
    for r in roots[1:]:
        rooted = rooted.unionByName(r)
    if nodes is None:
        return rooted, bottom, paths
    distance = 1
    while distance < height // STEP:
        before = [path] if distance > 1 else []
        nodes, path = _jump(nodes, distance)
        forget(spark, *before)
        distance *= 2
    return rooted, nodes.filter("step = 0").select("grp", "pos", "n", "seg", "more").unionByName(bottom), paths if distance > 1 else []


def _jump(nodes: DataFrame, distance: int) -> tuple[DataFrame, str]:
    """One self-join: segments of `distance` steps become twice as long."""
    reach = distance * STEP
    far = nodes.filter(F.col("step") >= distance).select("grp", F.col("step").alias("a_step"), F.col("pos").alias("a_pos"), F.col("seg").alias("a_seg"))
    far, path = written(far)
    rows = nodes.withColumns({"a_step": F.col("step") + distance, "a_pos": F.shiftright("pos", reach) if reach < 63 else F.lit(0).cast("long")})
    both = meet(rows, far, ["grp", "a_step", "a_pos"], "left", "pos", FEW_NODES, 64 if 2**reach > FEW_ROWS else 1)
    out, to = written(both.select("grp", "n", "step", "pos", F.concat("seg", F.coalesce("a_seg", F.lit(b""))).alias("seg"), "more"))
    forget(nodes.sparkSession, path)
    return out, to


def fold(start: Column, seg: Column, ways: list[tuple[Column, Column]]) -> Column:
    """The root that a digest and its siblings give; `ways` has the place and the number of leaves in each tree on the way up."""
    at = F.struct(start.alias("h"), F.lit(1).alias("used"))
    for pos, n in ways:
        steps = F.when(n > 1, F.sequence(F.lit(0), levels(n) - 1)).otherwise(F.array().cast("array<int>"))
        at = F.aggregate(steps, at, _level_up(seg, pos, n))
    return at["h"]


def _level_up(seg: Column, pos: Column, n: Column):
    def up(acc: Column, level: Column) -> Column:
        node = F.call_function("shiftright", pos, level)
        other = node.bitwiseXOR(F.lit(1).cast("long"))
        there = other <= F.call_function("shiftright", n - 1, level)
        sibling = F.lower(F.hex(F.substring(seg, acc["used"], F.lit(32))))
        both = F.when(~there, acc["h"]).when(other < node, F.concat(sibling, acc["h"])).otherwise(F.concat(acc["h"], sibling))
        return F.struct(digest(both).alias("h"), (acc["used"] + F.when(there, 32).otherwise(0)).alias("used"))

    return up


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             tampered: tuple[str, Column] | None = None) -> DataFrame:
    """One row per row: id, leaf, subroot, root, siblings (binary digests, leaf to root), proof_sha256, folded_root, verified.

    Leaves are the digests of `fields`; in each value of `group_col` (null is one) they ascend by id, a null id first, rows of equal id by their leaf. While
    several nodes remain, every two neighbours become their digest, a last one alone becomes its own. The groups' roots, by group with null
    first, then bytewise, give the root in the same way. `tampered` = (column, its value in a forged copy) says for what rows the proof is
    replayed with a forged leaf: `folded_root` is what leaf and siblings give, `verified` whether that is the root. Repeated rows are leaves of their own. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    forged = leaf(*[tampered[1] if tampered and c == tampered[0] else F.col(c) for c in fields])
    group = F.coalesce(F.concat(F.lit("g"), F.col(group_col).cast("string")), F.lit(""))
    told, p1 = written(docs.select(F.col(id_col).alias("id"), group.alias("grp"), leaf(*map(F.col, fields)).alias("hash"), forged.alias("forged")))
    told = told.withColumn("forged", F.when(F.col("forged") != F.col("hash"), F.unhex("forged")))
    leaves, p2 = placed(told, ["grp", "id", "hash"])
    groups, p3 = written(leaves.groupBy("grp").agg(F.min("place").alias("first"), F.count("*").alias("n")))
    more = F.struct("id", F.unhex("hash").alias("leaf"), "forged").alias("more")
    leaves = meet(leaves, groups, ["grp"], "inner", "place", FEW_NODES).select("grp", (F.col("place") - F.col("first")).alias("pos"), "n", "hash", more)
    roots, low, paths = grow(leaves)

    tops, p4 = placed(roots, ["grp", "root"])
    n_groups = groups.count()
    trees = tops.select(F.lit("").alias("grp"), F.col("place").alias("pos"), F.lit(n_groups).cast("long").alias("n"), F.col("root").alias("hash"), F.struct("grp", "root").alias("more"))
    top, high, more_paths = grow(trees)
    first = top.first()
    root = F.lit(first["root"] if first else None).cast("string")
    high, p5 = written(high.select("more.grp", F.col("more.root").alias("subroot"), F.col("pos").alias("t_pos"), F.col("n").alias("t_n"), F.col("seg").alias("t_seg")))
    out = meet(low, high, ["grp"], "inner", "pos", FEW_NODES).withColumn("siblings", F.concat("seg", "t_seg"))
    begin = F.lower(F.hex(F.coalesce("more.forged", "more.leaf")))
    out = out.select(F.col("more.id").alias(id_col), F.lower(F.hex("more.leaf")).alias("leaf"), "subroot", root.alias("root"), "siblings", digest(F.lower(F.hex("siblings"))).alias("proof_sha256"),
                     fold(begin, F.col("siblings"), [(F.col("pos"), F.col("n")), (F.col("t_pos"), F.col("t_n"))]).alias("folded_root"))
    out = out.withColumn("verified", F.col("folded_root") == F.col("root"))
    forget(spark, p1, p4, *paths, *more_paths)  # the roots and the segments above are written
    return out
