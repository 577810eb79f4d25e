"""Similarity join of documents by the Jaccard index of their word shingles, with a count-vector R-tree.

1. Each set of shingles is hashed into GROUPS groups; the counts are a point. Equal sets become one class.
2. Routing. Sets that may link differ in at most d shingles, d being fixed by their sizes. Of m = d + 1 + t disjoint parts of a set, at least
   t + 1 are then equal in both. In whatever order parts are ranked, two such sets share one of their first d + 1. Sets meet where one of
   those is equal; the largest parts come first. (A tree alone can't route: the distance allowed is above the spread of every single
   coordinate, so each point would go to each node.)
3. In each meeting place every set is paired with the first one. The shared size is bounded by the sum of coordinate minima
   of the two points; pairs that pass are verified on their shingles. A part that very many sets of a batch share pairs them within the batch,
   and the batch's first goes on to the common place, so no task gets all of them.
4. Places that still hold more than one component get an R-tree over the points. Two nodes are joined only if the summed minima of
   their upper corners reach what their smallest sizes ask for and they aren't one component already; then leaves are joined point
   by point, and pairs that pass by points of FINE coordinates. Where very many pass they are kept as clusters of sets, whose links are found
   on their shingles; so a place returns no more than two rows a set. Clusters with the same smallest id, which one family of texts makes in
   each place where it meets, become one. Their sets are moved in slices of no more than half of all shingles; between slices, clusters that
   the links so far made one component are left out.
5. A place of over BLOCK sets that is still open holds what many documents share, such as boilerplate. Its part goes to the end of the ranking,
   and its sets meet by the parts that move up instead. Only sets of which more than t parts are such stay in it; they are compared by pairs of blocks.
6. Components of the links.

Shingles are compared as 64-bit hashes. No bucket, candidate list or number of partners has a cap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, forget, give_back, let_go, likely, meet, small, spread, written
from .components import components
from .shingles import U, batch_slices, in_slices, mix, shingle_sets

GROUPS, SLICE, LEAF, FAN, BLOCK, CROWD, HEAVY, FINE = 128, 2_000_000, 64, 12, 1024, 64, 4_000_000, 512
STEP = 250_000  # so many shingles and parts, or bytes of texts and of their points, are worked on at once
SLICES, SHARE = 256, 2  # clusters are dealt to so many slices; as many are compared at once as hold one shingle in SHARE of all texts
FULL = 255  # the largest coordinate; a set with more in one group has no point but FULL in all, and the bound lets it pass


def bounds(limit: int) -> np.ndarray:
    """Size classes: each ends half as high again as it begins."""
    b = [1, 10]
    while b[-1] <= limit:
        b.append(b[-1] * 3 // 2)
    return np.array(b)


def differing(below: int, num: int, den: int) -> int:
    """Most shingles in which two linked sets of fewer than `below` shingles differ: S (den - num) / (den + num) for sizes of sum S."""
    return 2 * (below - 1) * (den - num) // (den + num)


def parts_of(hashes: np.ndarray, owner: np.ndarray, sizes: np.ndarray, num: int, den: int, every: bool = False) -> tuple[np.ndarray, ...]:
    """(set, part) rows: the hashes of the largest parts of each set, in its own size class and in the next if it can link there.

    With `every`, all parts: also the size class, the rank in it (from 0), and how many ranks count."""
    ends = bounds(int(sizes.max(initial=0)))
    cls = np.searchsorted(ends, sizes, "right") - 1
    out_owner, out_part, out_rank = [], [], []
    at = np.cumsum(sizes) - sizes
    for c in range(len(ends) - 1):
        mine = np.flatnonzero((sizes > 0) & ((cls == c) | (cls == c - 1) & (den * sizes >= num * ends[c])))
        if not len(mine):
            continue
        d = differing(int(ends[c + 1]), num, den)
        m = d + 1 + ((d + 3) // 4 if d else 0)
        for lo, hi in in_slices([int(s) + m for s in sizes[mine]], STEP):
            some = mine[lo:hi]
            n = sizes[some]
            row = np.repeat(np.arange(len(some)), n)
            h = hashes[np.repeat(at[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            cell = row * m + (mix(h ^ U(0x5851F42D4C957F2D)) >> U(33)).astype(np.int64) % m
            code = mix(h + U((c + 1) * 0xD6E8FEB86659FD93 % 2**64))
            count = np.bincount(cell, minlength=len(some) * m)
            low, high = (np.bincount(cell, x.astype(np.float64), len(some) * m).astype(np.uint64) for x in (code & U(0xFFFFFFFF), code >> U(32)))
            part = mix((low + (high << U(32))) ^ (np.tile(np.arange(m, dtype=np.uint64), len(some)) * U(0xA0761D6478BD642F)) ^ (count.astype(np.uint64) << U(48)) ^ U(c))
            rank = ((np.minimum(count, 2**20).astype(np.uint64) << U(43)) | (part >> U(21))).reshape(len(some), m)
            if every:
                best = np.argsort(~rank, axis=1, kind="stable")
                out_rank.append(np.stack((np.full(best.size, c), np.tile(np.arange(m), len(some)), np.full(best.size, d + 1))))
            else:
                best = np.argpartition(rank, m - d - 1, axis=1)[:, m - d - 1:] if m > d + 1 else np.tile(np.arange(m), (len(some), 1))
            out_part.append(np.take_along_axis(part.reshape(len(some), m), best, 1).ravel())
            out_owner.append(np.repeat(some, best.shape[1]))
    none = np.zeros(0, np.int64)
    owner, part = (np.concatenate(x) for x in (out_owner, out_part)) if out_part else (none, none.astype(np.uint64))
    order = np.argsort(owner, kind="stable")
    ranks = (np.concatenate(out_rank, 1) if out_rank else np.zeros((3, 0), np.int64))[:, order] if every else ()
    return owner[order], part[order], *ranks


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for x in batches:
            for i, j in batch_slices(x["text"], STEP, GROUPS + FINE):
                h, owner = shingle_sets([(t or "").encode() for t in x["text"].slice(i, j - i).to_pylist()], size)
                n = np.bincount(owner, minlength=j - i)
                points = np.bincount(owner * GROUPS + (h >> U(56)).astype(np.int64) % GROUPS, minlength=(j - i) * GROUPS).reshape(-1, GROUPS)
                points[(points >= FULL).any(1)] = FULL
                fine = np.bincount(owner * FINE + (h >> U(40)).astype(np.int64) % FINE, minlength=(j - i) * FINE).reshape(-1, FINE)
                fine[(fine >= FULL).any(1)] = FULL
                starts = np.append(np.cumsum(n) - n, len(h))
                h1, h2 = (np.array([np.add.reduce(k[a:b]) for a, b in zip(starts, starts[1:], strict=False)], np.uint64).astype(np.int64) for k in (h, mix(h ^ U(77))))
                yield pa.RecordBatch.from_pydict({"id": x["id"].slice(i, j - i), "n": pa.array(n, pa.int64()), "h1": pa.array(h1), "h2": pa.array(h2),
                                                  "point": pa.array([p.tobytes() for p in points.astype(np.uint8)], pa.binary()), "fine": pa.array([p.tobytes() for p in fine.astype(np.uint8)], pa.binary())})
        give_back()

    return run


def enough(n1, n2, num: int, den: int):
    """Shared shingles that two sets of these sizes need: num / (num + den) of the sum of sizes, rounded up; no more than two full points show."""
    return np.minimum(-(-(n1 + n2) * num // (num + den)), FULL * GROUPS)


def _may_link(num: int, den: int):
    """Pairs whose summed coordinate minima reach what they need."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            p, q = (np.frombuffer(b"".join(x[c].to_pylist()), np.uint8).reshape(-1, GROUPS) for c in ("pa", "pb"))
            n, m = x["na"].to_numpy(), x["nb"].to_numpy()
            ok = (np.minimum(p, q).sum(1, dtype=np.int64) >= enough(n, m, num, den)) & (den * np.minimum(n, m) >= num * np.maximum(n, m))
            yield x.select(["a", "b"]).filter(pa.array(ok))

    return run


def tree_pairs(points: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (indices) of different components, and of different sides where there are two, that the bound lets pass."""
    two = len(np.unique(side)) > 1
    order = np.lexsort((points[:, :GROUPS // 2].sum(1), n // max(1, len(n) // 8), comp, side))
    leaves = [order[i:i + LEAF] for i in range(0, len(order), LEAF)]

    def node(children: list, ids: np.ndarray):
        return {"kids": children, "ids": ids, "top": points[ids].max(0), "lo": int(n[ids].min()), "hi": int(n[ids].max()),
                "comp": comp[ids[0]] if (comp[ids] == comp[ids[0]]).all() else None, "side": side[ids[0]] if (side[ids] == side[ids[0]]).all() else None}

    level = [node([], ids) for ids in leaves]
    while len(level) > 1:
        level = [node(level[i:i + FAN], np.concatenate([k["ids"] for k in level[i:i + FAN]])) for i in range(0, len(level), FAN)]
    stack = [(level[0], level[0])]
    while stack:
        a, b = stack.pop()
        if a["comp"] is not None and a["comp"] == b["comp"] or two and a["side"] is not None and a["side"] == b["side"]:
            continue
        if den * min(a["hi"], b["hi"]) < num * max(a["lo"], b["lo"]) or int(np.minimum(a["top"], b["top"]).sum(dtype=np.int64)) < enough(a["lo"], b["lo"], num, den):
            continue
        if a is b and a["kids"]:
            stack += [(k, m) for i, k in enumerate(a["kids"]) for m in a["kids"][i:]]
        elif a["kids"] or b["kids"]:
            wide, other = (a, b) if len(a["ids"]) >= len(b["ids"]) else (b, a)
            stack += [(k, other) for k in wide["kids"]]
        else:
            i, j = a["ids"], b["ids"]
            shared = np.minimum(points[i][:, None, :], points[j][None, :, :]).sum(2, dtype=np.int64)
            s, t = n[i][:, None], n[j][None, :]
            ok = (shared >= enough(s, t, num, den)) & (den * np.minimum(s, t) >= num * np.maximum(s, t)) & (comp[i][:, None] != comp[j][None, :])
            if two:
                ok &= side[i][:, None] != side[j][None, :]
            if a is b:
                ok = np.triu(ok, 1)
            x, y = np.nonzero(ok)
            if len(x):
                yield i[x], j[y]


def clusters_of(k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of those that pairs (i, j) connect, for each of k."""
    label = np.arange(k)
    while len(i):
        low, high = sorted((label[i[0]], label[j[0]]))
        label[label == high] = low
        left = label[i] != label[j]
        i, j = i[left], j[left]
    return label


def _join_place(num: int, den: int):
    """What the bounds let link in a place, as rows (cluster, a, b): pairs (cluster 0), or where a cluster of sets has over two pairs a set, its sets and
    their components. So there are no more than two rows a set, however many pairs pass. A cluster is named by its smallest id, so those that a family of
    texts makes in many places become one; a cluster of over HEAVY shingles is dealt by pairs of chunks, named by all their ids."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if not rows["id"].is_unique:
            rows = rows.drop_duplicates(["id", "n", "point"])
        points = np.frombuffer(b"".join(rows["point"]), np.uint8).reshape(-1, GROUPS)
        ids, comp, n = rows["id"].to_numpy(), rows["comp"].to_numpy(), rows["n"].to_numpy()
        found, fine = [], None
        for i, j in tree_pairs(points, n, comp, rows["block"].to_numpy(), num, den):
            fine = np.frombuffer(b"".join(rows["fine"]), np.uint8).reshape(-1, FINE) if fine is None else fine
            ok = np.minimum(fine[i], fine[j]).sum(1, dtype=np.int64) >= np.minimum(enough(n[i], n[j], num, den), FULL * FINE)
            if ok.any():
                found.append((i[ok], j[ok]))
        if not found:
            return pd.DataFrame({"cluster": np.zeros(0, np.int64), "a": ids[:0], "b": ids[:0]})
        i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        label = clusters_of(len(rows), i, j)
        many = np.bincount(label[i], minlength=len(rows)) > 2 * np.bincount(label, minlength=len(rows))
        few = ~many[label[i]]
        out = [pd.DataFrame({"cluster": 0, "a": np.minimum(ids[i[few]], ids[j[few]]), "b": np.maximum(ids[i[few]], ids[j[few]])})]
        for c in np.flatnonzero(many):
            mine = np.flatnonzero(label == c)
            mine = mine[np.argsort(ids[mine], kind="stable")]  # one name wherever the cluster meets
            chunk = np.cumsum(n[mine]) * 2 // HEAVY
            chunks = [mine[chunk == k] for k in np.unique(chunk)]
            for some in [mine] if len(chunks) <= 2 else [np.concatenate((x, y)) for k, x in enumerate(chunks) for y in chunks[k + 1:]]:
                name = hashlib.blake2b("\0".join(map(str, ids[some[:1]] if len(some) == len(mine) else ids[some])).encode(), digest_size=8).digest()
                out.append(pd.DataFrame({"cluster": int.from_bytes(name, "big", signed=True) or 1, "a": ids[some], "b": comp[some]}))
        return pd.concat(out).drop_duplicates().astype({"cluster": np.int64, "a": rows["id"].dtype, "b": rows["id"].dtype})

    return run


def _join_cluster(num: int, den: int):
    """Links (a, b) that make up the components of a cluster, by its sets of shingles; those within a component known before are left out."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, n = rows["id"].to_numpy(), rows["shingles"].map(len).to_numpy()
        label, starts = pd.factorize(rows["comp"])[0], np.cumsum(n) - n
        code = np.unique(np.concatenate(rows["shingles"].to_list()), return_inverse=True)[1]
        mark, links = np.zeros(code.max() + 1, np.int8), []
        for i in range(len(ids) - 1):
            j = np.flatnonzero(label[i + 1:] != label[i]) + i + 1
            if len(j):
                own = code[starts[i]:starts[i] + n[i]]
                mark[own] = 1
                if 4 * len(j) < len(ids) - i:  # most are in one component already
                    at = np.cumsum(n[j]) - n[j]
                    shared = np.add.reduceat(mark[code[np.repeat(starts[j] - at, n[j]) + np.arange(int(n[j].sum()))]], at, dtype=np.int64)
                else:
                    shared = np.add.reduceat(mark[code[starts[i + 1]:]], starts[i + 1:] - starts[i + 1], dtype=np.int64)[j - i - 1]
                mark[own] = 0
                for k in j[(num + den) * shared >= num * (n[i] + n[j])]:
                    if label[k] != label[i]:
                        links.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
                        label[label == label[k]] = label[i]
        return pd.DataFrame(links, columns=["a", "b"]).astype({"a": rows["id"].dtype, "b": rows["id"].dtype})

    return run


def slices_within(volume: dict[int, int], most: int) -> list[int]:
    """The slices, from the first on, that together hold no more than `most`; one at least."""
    slices = sorted(volume)
    held = np.cumsum([volume[k] for k in slices])
    return slices[:max(1, int(np.searchsorted(held, most, "right")))]


def semi(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Rows with these ids (a written table); the ids are broadcast where they are few, as counted, and never else."""
    return rows.join(small(ids), col, "left_semi")


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, part, sub) rows of lists of parts. Sets of a batch of which CROWD or more share a part meet in a place of their own (sub > 0), and
    the first of them is sent to the common one (sub = -1)."""
    for x in batches:
        parts, n = x["parts"].flatten().to_numpy(zero_copy_only=False), x["parts"].value_lengths().to_numpy(zero_copy_only=False)
        ids = x["id"].to_numpy(zero_copy_only=False)
        if not len(parts):
            continue
        owner = np.repeat(np.arange(len(ids)), n)
        _, index, count = np.unique(parts, return_inverse=True, return_counts=True)
        sub = np.where(count[index] >= CROWD, 1 + abs(hash((ids[0], ids[-1], len(ids), len(parts)))) % (2**31 - 2), 0)
        crowd = np.flatnonzero(sub)
        crowd = crowd[np.lexsort((ids[owner[crowd]], index[crowd]))]
        first = crowd[np.concatenate(([True], index[crowd][1:] != index[crowd][:-1]))] if len(crowd) else crowd
        rows = np.concatenate((np.arange(len(parts)), first))
        yield pa.RecordBatch.from_pydict({"id": x["id"].take(pa.array(owner[rows])), "part": pa.array(parts[rows]), "sub": pa.array(np.append(sub, np.full(len(first), -1)), pa.int32())})


def _parts(size: int, num: int, den: int):
    """Lists of the parts by which sets meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i, j in batch_slices(x["text"], SLICE):
                h, owner = shingle_sets([(t or "").encode() for t in x["text"].slice(i, j - i).to_pylist()], size)
                of, part = parts_of(h, owner, np.bincount(owner, minlength=j - i), num, den)
                cuts = np.searchsorted(of, np.arange(j - i + 1))
                yield pa.RecordBatch.from_pydict({"id": x["id"].slice(i, j - i), "parts": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(part.astype(np.int64)))})
        give_back()

    return run


def _spare(size: int, num: int, den: int):
    """All parts of each text's set with their ranks; `own` tells sets of one id apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i, j in batch_slices(x["text"], SLICE // 4):
                h, owner = shingle_sets([(t or "").encode() for t in x["text"].slice(i, j - i).to_pylist()], size)
                n = np.bincount(owner, minlength=j - i)
                o, part, cls, rank, keep = parts_of(h, owner, n, num, den, True)
                own = np.bincount(owner, (h >> U(20)).astype(np.float64), j - i)[o]
                yield pa.RecordBatch.from_pydict({"id": x["id"].slice(i, j - i).take(pa.array(o)), "part": pa.array(part.astype(np.int64)), "own": pa.array(own), "cls": pa.array(cls, pa.int32()),
                                                  "rank": pa.array(rank, pa.int32()), "keep": pa.array(keep, pa.int32())})
        give_back()

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i, j in batch_slices(x["text"], STEP):
                h, owner = shingle_sets([(t or "").encode() for t in x["text"].slice(i, j - i).to_pylist()], size)
                cuts = np.searchsorted(owner, np.arange(j - i + 1))
                yield pa.RecordBatch.from_pydict({"id": x["id"].slice(i, j - i), "shingles": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(h.view(np.int64)))})
        give_back()

    return run


class Join:
    """The steps on one table of texts, rows (id, text); `points` has id, n, point and fine (a point of FINE coordinates) of each."""

    def __init__(self, rows: DataFrame, points: DataFrame, size: int, num: int, den: int):
        self.rows, self.points, self.size, self.num, self.den = rows, points, size, num, den
        self.spark, self.kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
        self.pair = f"a {self.kind}, b {self.kind}"

    def _ids(self, pairs: DataFrame) -> tuple[DataFrame, str]:
        return written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) whose points may link and whose sets of shingles do."""
        pairs, p1 = written(pairs.distinct())
        if not (k := pairs.count()):
            return pairs
        ids, p2 = self._ids(pairs)
        near, p3 = written(semi(self.points.select("id", "n", "point"), ids, "id"))
        near = spread(near, k)
        both = pairs.join(near.toDF("a", "na", "pa"), "a").join(near.toDF("b", "nb", "pb"), "b")
        pairs, p4 = written(both.mapInArrow(_may_link(self.num, self.den), self.pair))
        if not (k := pairs.count()):
            return pairs
        ids, p5 = self._ids(pairs)
        sets, p6 = written(likely(self.rows, ids, _sets(self.size), f"id {self.kind}, shingles array<long>").filter(F.size("shingles") > 0))
        sets = spread(sets, k)
        both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        shared, sizes = F.size(F.array_intersect("sa", "sb")), F.size("sa").cast("long") + F.size("sb")
        links = cut(both.filter((self.num + self.den) * shared.cast("long") >= self.num * sizes).select("a", "b").distinct())
        forget(self.spark, p1, p2, p3, p4, p5, p6)
        return links

    def places(self, dealt: DataFrame) -> tuple[DataFrame, str]:
        """(id, part, sub, first) of rows (id, part, sub): all that meet another; and where it is written."""
        met = dealt.select("id", "part", "sub")
        place = W.partitionBy("part", F.greatest("sub", F.lit(0)))
        met = met.select("id", "part", "sub", F.count("*").over(place).alias("size"), F.min("id").over(place).alias("first"))
        return written(met.filter("size > 1 OR sub > 0").drop("size"))

    def stars(self, met: DataFrame) -> DataFrame:
        return self.verified(met.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")))

    def open(self, met: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(members with their components, places of more than two sets that hold several components)."""
        member = met.filter("sub >= 0").select("id", "part").join(known, "id", "left").select("id", "part", F.coalesce("component", "id").alias("comp"))
        per = member.groupBy("part").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"), F.count("*").alias("k"))
        return member, cut(per.filter("lo <> hi AND k > 2").select("part", "who", "k"))

    def trees(self, member: DataFrame, wide: DataFrame) -> DataFrame:
        """Links within open places; of places with the same members one is enough."""
        keep, p1 = written(wide.groupBy("who", "k").agg(F.min("part").alias("part")).select("part", "k"))
        member, p2 = written(meet(member, keep, ["part"], "inner"))
        ids, p3 = written(member.select("id").distinct())
        near, p4 = written(semi(self.points, ids, "id"))
        member = member.join(spread(near, member.count()), "id")
        blocks = F.ceil(F.col("k") / BLOCK).cast("int")
        member = member.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        member = member.select("id", "n", "point", "fine", "comp", "block", "part", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
        # the places are few bytes and much work, so they are dealt to a stated number of tasks, which adaptive execution does not merge
        member = member.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "part", "p", "q")
        found, p5 = written(member.groupBy("part", "p", "q").applyInPandas(_join_place(self.num, self.den), f"cluster long, {self.pair}").distinct())
        links, many = self.verified(found.filter("cluster = 0").select("a", "b")), found.filter("cluster <> 0").toDF("cluster", "id", "comp")
        if not many.isEmpty():
            links = links.unionByName(self.clusters(many, near))
        forget(self.spark, p1, p2, p3, p4, p5)
        return links

    def clusters(self, many: DataFrame, near: DataFrame) -> DataFrame:
        """Links that make up the components of clusters (cluster, id, comp), found on the shingles. `near` has id and n. What moves at once is no more than
        a share of all shingles (or one slice), in however many clusters a set is."""
        sized, p1 = written(many.join(spread(near.groupBy("id").agg(F.sum("n").alias("n")), many.count()), "id"))
        heavy, p2 = written(sized.groupBy("cluster").agg(F.sum("n").alias("total")).filter(F.col("total") > HEAVY))
        left = meet(sized, heavy, ["cluster"], "left").withColumn("chunks", F.coalesce(F.ceil(2 * F.col("total") / HEAVY), F.lit(1)).cast("int"))
        left = left.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: (x != F.col("chunk")) | (F.col("chunks") == 1))
        left = left.withColumn("other", F.explode(others)).withColumns({"p": F.least("chunk", "other"), "q": F.greatest("chunk", "other")})
        left = left.withColumn("slice", F.pmod(F.xxhash64("cluster", "p", "q"), F.lit(SLICES)).cast("int"))
        left, path = written(left.select("cluster", "p", "q", "slice", "id", "comp", "n"))
        most = max((self.points.agg(F.sum("n")).first()[0] or 0) // SHARE, 4 * HEAVY)
        links, paths = None, [p1, p2]
        while True:
            told = left.groupBy("slice").agg(F.sum("n"), F.count("*")).collect()
            volume = {k: n for k, n, _ in told}
            now = slices_within(volume, most)
            some = left.filter(F.col("slice").isin(now))
            ids, p3 = written(some.select("id").distinct())
            sets = likely(self.rows, ids, _sets(self.size), f"id {self.kind}, shingles array<long>").filter(F.size("shingles") > 0)
            sets = spread(sets, sum(rows for k, _, rows in told if k in now))
            found = cut(some.select("cluster", "p", "q", "id", "comp").join(sets, "id").groupBy("cluster", "p", "q").applyInPandas(_join_cluster(self.num, self.den), self.pair))
            links = found if links is None else links.unionByName(found)
            paths += [path, p3]
            if len(now) == len(volume):
                break
            known = components(links.unionByName(left.select(F.col("id").alias("a"), F.col("comp").alias("b")).distinct()))
            rest = left.filter(~F.col("slice").isin(now)).join(known, "id", "left").withColumn("comp", F.coalesce("component", "comp")).drop("component")
            open_ = rest.groupBy("cluster", "p", "q").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("cluster", "p", "q")
            left, path = written(rest.join(open_, ["cluster", "p", "q"], "left_semi"))
            if left.isEmpty():
                paths.append(path)
                break
        forget(self.spark, *paths)
        return links

    def around(self, member: DataFrame, hot: DataFrame, dealt: DataFrame, links: DataFrame) -> DataFrame:
        """Links of sets in hot places, which meet by other parts where they have them."""
        ids = cut(meet(member, hot.select("part"), ["part"], "left_semi").select("id").distinct())
        spare = likely(self.rows, ids, _spare(self.size, self.num, self.den), f"id {self.kind}, part long, own double, cls int, rank int, keep int")
        spare = meet(spare, hot.select("part", F.lit(True).alias("hot")), ["part"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        order = W.partitionBy("id", "own", "cls").orderBy("hot", "rank")  # the parts of one set
        chosen = spare.withColumn("place", F.row_number().over(order)).filter("place <= keep")
        chosen = cut(chosen.filter("hot OR rank >= keep").select("id", "part", "hot"))
        moved = chosen.filter("NOT hot").select("id", "part")
        own = dealt.filter("sub >= 0").select("id", "part")
        both = moved.unionByName(semi(own, cut(moved.select("part").distinct()), "part")).distinct()
        met, path = self.places(both.withColumn("sub", F.lit(0)))  # what many sets share has left these
        links = links.unionByName(self.stars(met))
        rest = chosen.filter("hot").select("id", "part", F.lit(0).alias("sub"))
        links = cut(links.unionByName(self.trees(*self.open(met.select("id", "part", "sub").unionByName(rest), components(links)))))
        forget(self.spark, path)
        return links


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 90, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(described rows: id, n and representative of their class; links between representatives that make up the components)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    told = cut(rows.mapInArrow(_describe(size), f"id {kind}, n long, h1 long, h2 long, point binary, fine binary"))
    some, equal = told.filter("n > 0 AND id IS NOT NULL"), ["n", "h1", "h2"]
    reps = some.groupBy(*equal).agg(F.min("id").alias("rep"), F.count("*").alias("rows")).filter("rows > 1")  # other rows stand for themselves
    members = meet(some.select("id", *equal), cut(reps.drop("rows")), equal, "left").withColumn("rep", F.coalesce("rep", "id"))
    copies = cut(members.groupBy("id").agg(F.bool_and(F.col("id") != F.col("rep")).alias("copy")).filter("copy").select("id"))
    one = rows.filter("id IS NOT NULL").join(small(copies), "id", "left_anti")  # a row or more of each class
    parts = _parts(size, num, den)
    dealt = one.mapInArrow(lambda batches: _crowded(parts(batches)), f"id {kind}, part long, sub int")

    join = Join(rows, some.select("id", "n", "point", "fine"), size, num, den)
    met, path = join.places(dealt)
    links = join.stars(met)
    member, wide = join.open(met, components(links))
    links = cut(links.unionByName(join.trees(member, wide.filter(F.col("k") <= BLOCK))))
    hot = cut(wide.filter(F.col("k") > BLOCK))
    if hot.limit(1).count():
        links = join.around(member, hot, dealt, links)
    forget(docs.sparkSession, path)
    return members.select("id", "n", "rep").unionByName(told.filter("NOT (n > 0 AND id IS NOT NULL)").select("id", "n", F.col("id").alias("rep"))), links


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per row: id, n_shingles, component_id (smallest id reachable by links of Jaccard index num / den or more).

    Documents without words, or with a null text, have no shingles and are linked with nothing; rows with a null id have a null
    component. Rows that repeat an id are one document in the links, each with its own number of shingles. Extra columns are ignored.
    """
    members, links = jaccard_links(docs, id_col, text_col, size, num, den)
    known = components(links).withColumnsRenamed({"id": "rep"})
    # a class's representative is its smallest id, but a component's smallest id is that of one of its classes
    return members.join(known, "rep", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
