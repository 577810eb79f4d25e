"""Removal of passages of words that stand more than once, by seed and extend.

Seeds: of the grams of SEED words in each window of LENGTH words the one with the smallest hash, the leftmost of equals, is the window's anchor
(winnowing). Equal windows have equal anchors at equal offsets, so every repeat of LENGTH words or more is found from its anchors.
Join: occurrences of one seed meet. The *reach* of an occurrence is the stretch of text whose windows all have it for their anchor.
Extend: first at once over the whole reach, left and right: occurrences with equal reaches repeat each other all the way. Where a seed has
different reaches, each of them is extended step by step: so many words to the left, the rest of the window to the right; reaches that
agree so far extend each other there. Overlapping extensions of neighbouring seeds are joined to maximal repeats.

Nothing is compared pair by pair: occurrences meet as groups that are counted before the shuffle, so a passage that very many documents share costs a row a task.
Seed and extension are separate 64-bit hashes; two stretches count as equal if both are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, give_back, meet, written
from .shingles import STEP, STEP_INVERSE, U, batch_slices, mix, word_hashes

LENGTH, SEED = 35, 8
REACH = LENGTH - SEED  # words beside the seed in a window
SLICE = 1_500_000
#: A group with more rows than this isn't left to one task.
HOT = 2_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bits of the check beside a row's 64-bit key, of the number of windows and of the reach to the left.
CHECK = (1 << 13) - 1


class Stretches:
    """Hashes of any stretch of a list of numbers, from running sums."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        powers, self.back = np.full(n + 1, STEP, np.uint64), np.full(n + 1, STEP_INVERSE, np.uint64)
        powers[0] = self.back[0] = 1
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(mix(codes) * powers[:-1])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def winnow(words: np.ndarray, n: np.ndarray) -> tuple[Stretches, dict[str, np.ndarray]]:
    """Reaches of all anchors: text, place of the anchor, first and last window (all places in the list of words), seed and content."""
    s, begin = Stretches(words), np.cumsum(n) - n
    grams = np.arange(max(0, len(words) - SEED + 1))
    key = np.full(len(words), ~U(0), np.uint64)
    key[grams] = (s.of(grams, grams + SEED) & ~U(0xFFFFFFFF)) | grams.astype(np.uint64)
    low, width, most = key.copy(), 1, REACH + 1
    while width * 2 <= most:
        low[:-width] = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = most - width
    if rest:
        low[:-rest] = np.minimum(low[:-rest], low[rest:])
    windows = np.maximum(n - LENGTH + 1, 0)
    start = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    owner = np.repeat(np.arange(len(n)), windows)
    anchor = (low[start] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(start)) - 1 if len(at) else at
    owner, lo, hi, anchor = owner[at], start[at], start[last], anchor[at]
    return s, {"owner": owner, "anchor": anchor, "lo": lo, "hi": hi, "begin": begin[owner], "seed": s.of(anchor, anchor + SEED),
               "reach": mix(s.of(lo, hi + LENGTH) ^ (anchor - lo).astype(np.uint64))}


def pack(place, left, windows, check):
    """Place of the anchor, reach to the left, windows less one, check of the row."""
    return place << 23 | left << 18 | (windows - 1) << 13 | check


def _texts(x: pa.RecordBatch, i: int, j: int) -> list[bytes]:
    return [(t or "").encode() for t in x["text"].slice(i, j - i).to_pylist()]


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words, owner = word_hashes(texts, fold=False)
    return words, np.bincount(owner, minlength=len(texts))


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        key, check = x["key"].to_numpy(), x["check"].to_numpy()
        for i, j in batch_slices(x["text"], SLICE):
            words, n = _words(_texts(x, i, j))
            if (n >= LENGTH).any():
                _, f = winnow(words, n)
                packed = pack(f["anchor"] - f["begin"], f["anchor"] - f["lo"], f["hi"] - f["lo"] + 1, check[i:j][f["owner"]])
                yield pa.RecordBatch.from_pydict({"seed": pa.array(f["seed"].astype(np.int64)), "reach": pa.array(f["reach"].astype(np.int64)), "key": pa.array(key[i:j][f["owner"]]), "packed": pa.array(packed)})
    give_back()


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the reaches listed beside each text: all their extensions to windows, as (seed, extension, key, at), at being the window's place, whether the
    reach is alone, and the row's check."""
    for x in batches:
        for i, j in batch_slices(x["text"], SLICE):
            words, n = _words(_texts(x, i, j))
            if not len(words):
                continue
            s, begin = Stretches(words), np.cumsum(n) - n
            own = x["own"].slice(i, j - i)
            flat, owner = own.flatten(), np.repeat(np.arange(j - i), own.value_lengths().to_numpy(zero_copy_only=False))
            packed, alone = flat.field("packed").to_numpy(zero_copy_only=False), flat.field("alone").to_numpy(zero_copy_only=False)
            check, key = x["check"].slice(i, j - i).to_numpy(), x["key"].slice(i, j - i).to_numpy()
            fits = (packed & CHECK) == check[owner]
            packed, alone, owner = packed[fits], alone[fits], owner[fits]
            count = (packed >> 13 & 31) + 1
            of = np.repeat(np.arange(len(packed)), count)
            step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            anchor = begin[owner[of]] + (packed[of] >> 23)
            left = (packed[of] >> 18 & 31) - step  # words to the left in this extension
            a, b = s.of(anchor - left, anchor), s.of(anchor + SEED, anchor - left + LENGTH)
            at = (anchor - left - begin[owner[of]]) << 14 | alone[of].astype(np.int64) << 13 | check[owner[of]]
            yield pa.RecordBatch.from_pydict({"seed": pa.array(s.of(anchor, anchor + SEED).astype(np.int64)), "extension": pa.array(mix(a + mix(b ^ left.astype(np.uint64))).astype(np.int64)),
                                              "key": pa.array(key[owner[of]]), "at": pa.array(at)})
    give_back()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        n_words, n_removed, sha, runs = [], [], [], []
        for text, check, found in zip(x["text"].to_pylist(), x["check"].to_pylist(), x["found"].to_pylist(), strict=True):
            words, own = WORD.findall((text or "").encode()), []
            for a, b in sorted((f["start"], f["end"]) for f in found or () if f["check"] == check):
                if own and a <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], b)
                else:
                    own.append([a, b])
            kept, at = [], 0
            for a, b in own:
                kept += words[at:a]
                at = b
            kept += words[at:]
            n_words.append(len(words)), n_removed.append(len(words) - len(kept)), sha.append(hashlib.sha256(b" ".join(kept)).hexdigest()), runs.append([{"start": a, "end": b} for a, b in own])
        yield pa.RecordBatch.from_pydict({"id": x["id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()),
                                          "removed": pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})
    give_back()


def _listed(rows: DataFrame, groups: DataFrame, on: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows whose group is listed in a written table of groups and their sizes `n`. Groups of over HOT rows, which are few, meet theirs by broadcast or lanes."""
    hot, path = written(groups.filter(F.col("n") > HOT).drop("n"))
    if hot.isEmpty():
        return rows.join(groups.drop("n"), on), [path]
    cold = meet(rows, hot, on, "left_anti", "key").join(groups.filter(F.col("n") <= HOT).drop("n"), on)
    return cold.unionByName(meet(rows, hot, on, "inner", "key")), [path]


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_words, n_removed, kept_sha256 (kept words joined by a space), removed (spans of words start, end).

    A word goes if a window of LENGTH words over it has a word sequence that also starts elsewhere, in any document or in the same one; windows are judged on
    the input, and no copy stays. Words are runs of bytes other than ASCII white space, unchanged. Repeated rows, also of one id, are documents of their own and
    repeat each other. A null id is kept; a null text has no words; texts below LENGTH words stay whole; other columns are ignored; an
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("id", "text").alias("key"), F.crc32(F.col("text").cast("binary")).bitwiseAND(F.lit(CHECK)).alias("check"), "text")
    seeds, p1 = written(rows.select("key", "check", "text").mapInArrow(_seeds, "seed long, reach long, key long, packed long"))
    reaches, p2 = written(seeds.groupBy("seed", "reach").agg(F.count("*").alias("n"), F.min(F.struct("key", "packed")).alias("one")))
    equal = reaches.filter("n > 1").select("seed", "reach", "n")
    whole, paths = _listed(seeds, equal, ["seed", "reach"])
    anchor, left = F.shiftright("packed", 23), F.shiftright("packed", 18).bitwiseAND(F.lit(31))
    start = anchor - left
    check = F.col("packed").bitwiseAND(F.lit(CHECK)).alias("check")
    found = whole.select("key", check, start.alias("start"), (start + F.shiftright("packed", 13).bitwiseAND(F.lit(31)) + LENGTH).alias("end"))

    several, p3 = written(reaches.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1"))
    differ, more = _listed(reaches.select("seed", F.col("one.key").alias("key"), F.col("one.packed").alias("packed"), (F.col("n") == 1).alias("alone")), several, ["seed"])
    lists = differ.groupBy("key").agg(F.collect_set(F.struct("packed", "alone")).alias("own"))
    steps, p4 = written(rows.select("key", "check", "text").join(lists, "key").mapInArrow(_extended, "seed long, extension long, key long, at long"))
    alone = F.shiftright("at", 13).bitwiseAND(F.lit(1)) == 1
    agree, p5 = written(steps.groupBy("seed", "extension").agg(F.count("*").alias("n"), F.max(alone).alias("asked")).filter("n > 1 AND asked").drop("asked"))
    extended, last = _listed(steps.filter(alone), agree, ["seed", "extension"])
    start = F.shiftright("at", 14)
    found = found.unionByName(extended.select("key", F.col("at").bitwiseAND(F.lit(CHECK)).alias("check"), start.alias("start"), (start + LENGTH).alias("end")))
    spans, p6 = written(found.groupBy("key").agg(F.collect_set(F.struct("check", "start", "end")).alias("found")))
    forget(spark, p1, p2, p3, p4, p5, *paths, *more, *last)
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.join(spans, "key", "left").mapInArrow(_remove, f"id {kind}, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)
