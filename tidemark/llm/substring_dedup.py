"""Removal of repeated strings of bytes across all documents, with suffix arrays by induced sorting.

Every window of `LENGTH` bytes has an anchor: of its grams of `GRAM` bytes the one with the smallest hash, the leftmost of equals. Equal
windows have equal anchors at equal offsets, so windows whose anchors have one hash form a shard of their own and shards are
independent. Anchors are sparse (about one in 41 bytes) and go first, without text. Neighbouring windows of one anchor are a
fragment; equal fragments are combined, first inside each batch of a task and then after the shuffle, and the earliest stands for all. Only fragments that share an anchor with a different
fragment bring their bytes: a shard's fragments are laid end to end, its suffix array is induced, and the permuted common prefixes tell which
windows are equal.

A passage that stands in very many documents doesn't gather its rows in one task: copies of a fragment within a batch leave it at once, and an anchor
that has WIDE different fragments in one batch is known to need a shard, so those fragments meet by anchor and content, and one row a batch
tells the others so. Equal fragments that then stand twice in a shard are no harm: the suffix array finds them.
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

from .common import cut
from .shingles import BYTE_CODE, STEP, STEP_INVERSE, U, in_slices, mix
from .suffix_array import common_prefixes, induced_suffix_array

LENGTH, GRAM = 100, 20
SPREAD = LENGTH - GRAM + 1
SLICE, SHARD, HOT, WIDE = 1_500_000, 1_500_000, 20_000, 8
NO_ID = -(2**63)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on; the last places are of no use."""
    h = {1: BYTE_CODE[raw]}
    for k in (1, 2, 4, 8):
        g = h[k] * U(2 * k + 0x9E3779B97F4A7C15)
        g[:-k] += h[k][k:]
        h[2 * k] = mix(g) if k == 8 else g
    out = h[16] * U(0xC2B2AE3D27D4EB4F)
    out[:-16] += h[4][16:]
    return mix(out)


class Prefixes:
    """Hashes of any stretch of a buffer, from running sums."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        powers, self.back = np.full(n + 1, STEP, np.uint64), np.full(n + 1, STEP_INVERSE, np.uint64)
        powers[0] = self.back[0] = 1
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(BYTE_CODE[raw] * powers[:-1])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def fragments(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All fragments: text, anchor place, first window, last window (places in the text), hash of the anchor and of the fragment."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(n) - n
    key = (gram_hashes(raw) & ~U(0xFFFFFFFF)) | np.arange(len(raw), dtype=np.uint64)
    low, width = key.copy(), 1
    while width * 2 <= SPREAD:
        low[:-width] = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = SPREAD - width
    low[:-rest] = np.minimum(low[:-rest], low[rest:])
    windows = np.maximum(n - LENGTH + 1, 0)
    start = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    owner = np.repeat(np.arange(len(texts)), windows)
    anchor = (low[start] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(start)) - 1
    owner, lo, hi, anchor = owner[at], start[at], start[last], anchor[at]
    p = Prefixes(raw)
    return {"owner": owner, "place": anchor - begin[owner], "lo": lo - begin[owner], "hi": hi - begin[owner], "hash": p.of(anchor, anchor + GRAM),
            "whole": mix(p.of(lo, hi + LENGTH) ^ (anchor - lo).astype(np.uint64)), "texts": p.of(begin, begin + n)}


def pack(place, lo, hi, digest):
    """Anchor, reach to the left, number of windows and 17 bits of the text in one number, ordered by the anchor; two bits are free for marks."""
    return place << 33 | (place - lo) << 26 | (hi - lo) << 19 | digest


def unpack(x):
    place, lo = x >> 33, (x >> 33) - (x >> 26 & 127)
    return place, lo, lo + (x >> 19 & 127)


DIGEST, WIDELY, COPY, SIGN = (1 << 17) - 1, 1 << 17, 1 << 18, -1


def combined(f: dict[str, np.ndarray], wide_from: int = WIDE) -> dict[str, np.ndarray]:
    """Mark fragments that start later than the earliest of their equals as copies; those that are as early (repeated rows) stay. Copies need no
    shard, so they are dealt out evenly instead of by their hash.

    The other fragments of an anchor with `wide_from` different ones are marked and dealt by anchor and content (hash ^ whole, so the anchor can be had
    back); a row with packed = SIGN stands in for them where the anchor's other rows meet."""
    order = np.lexsort((f["packed"], f["id"], f["whole"], f["hash"]))
    h, w, i, place = f["hash"][order], f["whole"][order], f["id"][order], f["packed"][order] >> 33
    anchor = np.ones(len(order), bool)
    anchor[1:] = h[1:] != h[:-1]
    new = anchor.copy()
    new[1:] |= w[1:] != w[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (i != i[first]) | (place != place[first])
    group = np.cumsum(anchor) - 1
    kinds = np.bincount(group[new])
    again, wide = order[later], order[~later & (kinds[group] >= wide_from)]
    signs = h[anchor][kinds >= wide_from]
    f["packed"][again] |= COPY
    f["hash"][again] = mix(f["id"][again].astype(np.uint64) * STEP + f["packed"][again].astype(np.uint64)).astype(np.int64)
    f["packed"][wide] |= WIDELY
    f["hash"][wide] ^= f["whole"][wide]
    rest = {"hash": signs, "whole": np.full(len(signs), NO_ID), "id": np.full(len(signs), NO_ID), "packed": np.full(len(signs), SIGN)}
    return {k: np.concatenate((v, rest[k])) for k, v in f.items()} if len(signs) else f


def _anchors(wide_from: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            texts, found = [(t or "").encode() for t in x["text"].to_pylist()], []
            ids = x["id"].to_numpy()
            for i, j in in_slices([len(t) for t in texts], SLICE):
                if any(len(t) >= LENGTH for t in texts[i:j]):
                    f = fragments(texts[i:j])
                    digest = (f["texts"] >> U(47)).astype(np.int64)[f["owner"]]
                    found.append((f["hash"].astype(np.int64), f["whole"].astype(np.int64), ids[i:j][f["owner"]], pack(f["place"], f["lo"], f["hi"], digest)))
            if found:
                yield pa.RecordBatch.from_pydict(combined(dict(zip(("hash", "whole", "id", "packed"), map(np.concatenate, zip(*found, strict=True)), strict=True)), wide_from))

    return run


def digest_of(text: bytes) -> int:
    raw = np.frombuffer(text, np.uint8)
    return int(Prefixes(raw).of(np.array([0]), np.array([len(raw)]))[0] >> U(47))


def _bring_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        out = {"hash": [], "id": [], "packed": [], "bytes": []}
        for i, text, hashes, packed in zip(x["id"].to_pylist(), x["text"].to_pylist(), x["hashes"].to_pylist(), x["packeds"].to_pylist(), strict=True):
            raw = (text or "").encode()
            digest = digest_of(raw)
            for h, p in zip(hashes, packed, strict=True):
                if p & DIGEST == digest:
                    _, lo, hi = unpack(p)
                    out["hash"].append(h), out["id"].append(i), out["packed"].append(p), out["bytes"].append(raw[lo:hi + LENGTH])
        yield pa.RecordBatch.from_pydict({"hash": pa.array(out["hash"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "packed": pa.array(out["packed"], pa.int64()), "bytes": pa.array(out["bytes"], pa.binary())})


def repeated_windows(parts: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part, offset) of windows that equal one with a smaller (part's order, place). `first` gives each part's rows of order: an id and the
    place of its first window."""
    n = np.array([len(p) + 1 for p in parts])
    t = np.frombuffer(b"\xff".join(parts) + b"\xff\xff", np.uint8).astype(np.int16) + 2
    t[np.cumsum(n) - 1] = 1  # no byte of UTF-8 is 0xff; these end a fragment
    t[-1] = 0
    sa = induced_suffix_array(t, 2 * LENGTH)
    shared = common_prefixes((t & 0xFF).astype(np.uint8), sa, LENGTH)
    run = np.cumsum(shared[sa] < LENGTH)
    owner = np.searchsorted(np.cumsum(n), sa, "right")
    fine = owner < len(parts)
    sa, run, owner = sa[fine], run[fine], owner[fine]
    offset = sa - (np.cumsum(n) - n)[owner]
    size = np.bincount(run)
    many = (size[run] > 1) & (offset <= n[owner] - 1 - LENGTH)
    run, owner, offset = run[many], owner[many], offset[many]
    order = np.lexsort((first[owner, 1] + offset, first[owner, 0], run))
    run, owner, offset = run[order], owner[order], offset[order]
    where = np.stack((first[owner, 0], first[owner, 1] + offset))
    head = np.ones(len(run), bool)
    head[1:] = run[1:] != run[:-1]
    group = np.cumsum(head) - 1
    later = (where != where[:, np.flatnonzero(head)[group]]).any(0) if len(run) else head
    return owner[later], offset[later]


def as_runs(owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered stretches (owner, start, end) of windows, neighbours joined."""
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + LENGTH)
    at = np.flatnonzero(new)
    return owner[at], start[at], start[np.append(at[1:], len(start)) - 1] + LENGTH if len(at) else start[:0]


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    ids, packed = rows["id"].to_numpy(), rows["packed"].to_numpy()
    _, lo, _ = unpack(packed)
    owner, offset = repeated_windows(list(rows["bytes"]), np.stack((ids, lo), 1))
    owner, start, end = as_runs(owner, lo[owner] + offset)
    return pd.DataFrame({"id": ids[owner], "digest": (packed & DIGEST)[owner], "start": start, "end": end})


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a fragment by itself, for anchors with more fragments than a task should hold."""
    for x in batches:
        for i, p, b in zip(x["id"].to_pylist(), x["packed"].to_pylist(), x["bytes"].to_pylist(), strict=True):
            _, lo, hi = unpack(p)
            n = hi - lo + 1
            yield pa.RecordBatch.from_pydict({"window": pa.array([b[k:k + LENGTH] for k in range(n)], pa.binary()), "id": pa.array([i] * n, pa.int64()),
                                              "digest": pa.array([p & DIGEST] * n, pa.int64()), "start": pa.array(range(lo, hi + 1), pa.int64())})


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        removed, spans, sha, sizes, runs = [], [], [], [], []
        for text, found in zip(x["text"].to_pylist(), x["found"].to_pylist(), strict=True):
            raw, own = (text or "").encode(), []
            if found:
                digest = digest_of(raw)
                for s in sorted((f["start"], f["end"]) for f in found if f["digest"] == digest):
                    if own and s[0] <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], s[1])
                    else:
                        own.append([*s])
            kept, at = [], 0
            for a, b in own:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            sizes.append(len(raw)), removed.append(sum(b - a for a, b in own)), spans.append(len(own))
            sha.append(hashlib.sha256(b"".join(kept)).hexdigest()), runs.append([{"start": a, "end": b} for a, b in own])
        yield pa.RecordBatch.from_pydict({"id": x["id"], "null_id": x["null_id"], "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
                                          "kept_sha256": pa.array(sha, pa.string()), "removed": pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_bytes, n_removed, n_spans, kept_sha256, removed (byte spans start, end).

    A byte goes if a string of LENGTH bytes over it also starts earlier: in a smaller id, or in the same id at a smaller place. Rows that repeat an
    id and start at the same place are equally early, so neither goes on account of the other. A null id is the smallest. A null text is
    empty; texts below LENGTH bytes stay whole; other columns are ignored; an empty table gives an empty table.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(id_col).isNull().alias("null_id"), F.col(text_col).alias("text"))
    anchors = rows.select("id", "text").mapInArrow(_anchors(WIDE), "hash long, whole long, id long, packed long")
    shard = W.partitionBy("hash")
    real, copy, widely = F.col("packed") != SIGN, F.col("packed").bitwiseAND(F.lit(COPY)) != 0, F.col("packed").bitwiseAND(F.lit(WIDELY)) != 0
    met = anchors.select("*", F.count("*").over(shard).alias("n"), F.min("whole").over(shard).alias("low"), F.max("whole").over(shard).alias("high"))
    met = met.filter(real & ((F.col("n") > 1) | copy | widely))
    stands = F.min(F.struct("id", "packed")).over(W.partitionBy("hash", "whole"))
    first = ~copy & (F.col("id") == F.col("stands.id")) & (F.shiftright("packed", 33) == F.shiftright("stands.packed", 33))
    anchor = F.when(widely, F.col("hash").bitwiseXOR(F.col("whole"))).otherwise(F.col("hash"))
    met = cut(met.withColumn("stands", stands).select(anchor.alias("hash"), "id", "packed", first.alias("first"), (widely | (F.col("low") != F.col("high"))).alias("mixed")))

    lo = F.shiftright("packed", 33) - F.shiftright("packed", 26).bitwiseAND(F.lit(127))
    copies = met.filter("NOT first").select("id", F.col("packed").bitwiseAND(F.lit(DIGEST)).alias("digest"), lo.alias("start"), (lo + F.shiftright("packed", 19).bitwiseAND(F.lit(127)) + LENGTH).alias("end"))

    stand = met.filter("first AND mixed")
    lists = stand.groupBy("id").agg(F.collect_set(F.struct("hash", "packed")).alias("own")).select("id", F.col("own.hash").alias("hashes"), F.col("own.packed").alias("packeds"))
    parts = cut(rows.select("id", "text").join(lists, "id").mapInArrow(_bring_bytes, "hash long, id long, packed long, bytes binary"))
    hot = cut(parts.groupBy("hash").count().filter(F.col("count") > HOT).select("hash"))
    total = parts.agg(F.sum(F.length("bytes"))).first()[0] or 0
    n_shards = max(1, -(-total // SHARD))
    found = parts.join(hot, "hash", "left_anti").withColumn("shard", F.pmod(F.xxhash64("hash"), F.lit(n_shards)))
    found = found.groupBy("shard").applyInPandas(_shard, "id long, digest long, start long, end long")
    if hot.limit(1).count():
        windows = parts.join(hot, "hash", "left_semi").mapInArrow(_windows, "window binary, id long, digest long, start long")
        one = windows.groupBy("window").agg(F.min(F.struct("id", "start")).alias("least"))
        late = windows.join(one, "window").filter(F.struct("id", "start") > F.col("least"))
        found = found.unionByName(late.select("id", "digest", "start", (F.col("start") + LENGTH).alias("end")))
    spans = copies.unionByName(found).groupBy("id").agg(F.collect_list(F.struct("digest", "start", "end")).alias("found"))
    out = rows.join(spans, "id", "left").mapInArrow(_remove, "id long, null_id boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>")
    return out.select(F.when(~F.col("null_id"), F.col("id")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")
