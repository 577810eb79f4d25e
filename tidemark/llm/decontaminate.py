"""Benchmark decontamination: one Aho-Corasick automaton over the windows of the benchmark items, one scan of each text.

Every word that stands in an item is a number of three digits (code points; each digit has an alphabet of its own), all other words are one
number more. So a text becomes a string, the automaton has three nodes a word instead of one a character, matches are whole words, and
a match's place is a word's number times three. Hit words map back to code points of the original text. Documents are never shuffled.

The automaton goes to every executor, so its nodes are counted beforehand: windows are dealt to blocks of at most about `block_nodes`
nodes (40 bytes each, some 90 while it is built), and each block has its own automaton and its own pass over the documents, whose result is written before the next
block is read. One block is the usual case. An item of any length is cut into chunks of consecutive windows, so it may lie in several blocks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, give_back, written
from .shingles import batch_slices

WINDOW, BLOCK_NODES, CHUNK, DIGITS, SLICE = 10, 6_000_000, 5_000, 3, 4_000_000
#: Bytes of UTF-8: A-Z become a-z, ASCII that is no letter or digit becomes a space, all else stays.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
HITS = "spans array<struct<start:int,end:int>>, first array<int>, last array<int>, items array<string>"
_built: dict = {}


def words_of(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().translate(FOLD).split()]


def spelled(k: int, base: int) -> str:
    """A number below base ** 3 as three digits, each from an alphabet of its own, so that matches begin and end with a word."""
    return chr(2 + k // base**2) + chr(2 + base + k // base % base) + chr(2 + 2 * base + k % base)


class Matcher:
    """An automaton over (item, words) chunks: all windows of `size` consecutive words, or all the words where they are fewer."""

    def __init__(self, chunks: list[tuple[str, list[str]]], size: int):
        known = sorted({w for _, ws in chunks for w in ws})
        base = math.ceil((len(known) + 1) ** (1 / 3) + 1e-9)
        self.symbols, self.other = {w.encode(): spelled(k, base) for k, w in enumerate(known)}, spelled(len(known), base)
        self.names = sorted({item for item, _ in chunks})
        number = {name: k for k, name in enumerate(self.names)}
        owners: dict[str, list[int]] = {}
        for item, ws in chunks:
            line = "".join([self.symbols[w.encode()] for w in ws])
            for i in range(max(1, len(ws) - size + 1)) if ws else ():
                owners.setdefault(line[DIGITS * i:DIGITS * (i + size)], []).append(number[item])
        self.automaton = ahocorasick.Automaton()
        for w, ids in owners.items():
            self.automaton.add_word(w, (len(w) // DIGITS, tuple(ids)))
        if owners:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of the text; runs of hit words (first, last), merged where they overlap or touch; items found."""
        found = (text or "").encode().translate(FOLD).split()
        if not found or not len(self.automaton):
            return len(found), [], set()
        get, other = self.symbols.get, self.other
        ends = list(self.automaton.iter("".join([get(w, other) for w in found])))
        return len(found), merged([(end // DIGITS - n + 1, end // DIGITS) for end, (n, _) in ends]), {self.names[i] for i in {i for _, (_, ids) in ends for i in ids}}


def matcher_of(key, chunks: list[tuple[str, list[str]]], size: int) -> Matcher:
    """Kept in the worker by key, so later tasks don't build it again."""
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(chunks, size)
    return _built[key]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def originals(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Code points of the original text that runs of words cover."""
    raw = np.frombuffer(text.encode(), np.uint8)
    word = np.frombuffer(FOLD, np.uint8)[raw] != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0]))))
    point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [{"start": int(point[edge[2 * a]]), "end": int(point[edge[2 * b + 1]])} for a, b in runs]


def _chunks(size: int):
    """Items as chunks of CHUNK windows: item, words, nodes (an upper bound)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for item, text in zip(x["item"].to_pylist(), x["text"].to_pylist(), strict=True):
                w = words_of(text)
                parts = [w[i:i + CHUNK + size - 1] for i in range(0, max(1, len(w) - size + 1), CHUNK)] if w else []
                if parts:
                    nodes = [DIGITS * max(1, len(p) - size + 1) * min(size, len(p)) for p in parts]
                    yield pa.RecordBatch.from_pydict({"item": pa.array([item] * len(parts), pa.string()), "words": pa.array(parts, pa.list_(pa.string())), "nodes": pa.array(nodes, pa.int64())})

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, block_nodes: int = BLOCK_NODES, with_text: bool = False) -> DataFrame:
    """One row per document: id, n_words, n_hit, contaminated, items (sorted ids as strings), spans in the original text, and with `with_text` the text.

    A null or empty text has no words. Items with a null id have the id `null`; repeated items count once. Without items
    nothing is hit. Repeated document rows each have their row. Other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text")).filter("text IS NOT NULL").distinct()
    chunks = cut(items.mapInArrow(_chunks(window), "item string, words array<string>, nodes long"))
    total = chunks.agg(F.coalesce(F.sum("nodes"), F.lit(0))).first()[0]
    n_blocks = 1 if total <= block_nodes else -(-2 * total // block_nodes)  # blocks half full on average, as chunks are dealt by hash
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), *(F.lit(None).cast(k).alias(c) for c, k in
                      (("spans", "array<struct<start:int,end:int>>"), ("first", "array<int>"), ("last", "array<int>"), ("items", "array<string>"))))
    id_type = out.schema["id"].dataType.simpleString()
    before: list[str] = []
    for b in range(n_blocks):
        mine = chunks.filter(F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)) == b) if n_blocks > 1 else chunks
        block = spark.sparkContext.broadcast([(r.item, list(r.words)) for r in mine.select("item", "words").collect()])
        out = _pass(out, block, window, id_type, b == n_blocks - 1, with_text or b < n_blocks - 1)
        if b < n_blocks - 1:  # one automaton at a time in a worker
            out, path = written(out)
            forget(spark, *before)
            before = [path]
    n_hit = F.aggregate(F.zip_with("first", "last", lambda a, b: b - a + 1), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), (n_hit > 0).alias("contaminated"), "items", "spans", *["text"] * with_text)


def _pass(rows: DataFrame, block, window: int, id_type: str, final: bool, with_text: bool) -> DataFrame:
    """Add what one automaton finds."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher_of(key, block.value, window)
        for whole in batches:
            for i, j in batch_slices(whole["text"], SLICE):
                x = whole.slice(i, j - i)
                first, last, found, spans, n = [], [], [], [], []
                for text, f, g, had in zip(x["text"].to_pylist(), *(x[c].to_pylist() for c in ("first", "last", "items")), strict=True):
                    k, runs, ids = m.scan(text)
                    runs, ids = (merged([*zip(f or (), g or (), strict=True), *runs]), ids | set(had or ())) if f else (runs, ids)
                    n.append(k), first.append([r[0] for r in runs]), last.append([r[1] for r in runs]), found.append(sorted(ids))
                    spans.append(originals(text, runs) if final and runs else [])
                new = {"n_words": pa.array(n, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                       "first": pa.array(first, pa.list_(pa.int32())), "last": pa.array(last, pa.list_(pa.int32())), "items": pa.array(found, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict({"id": x["id"]} | ({"text": x["text"]} if with_text else {}) | new)
        give_back()

    return rows.mapInArrow(run, f"id {id_type}, " + "text string, " * with_text + "n_words long, " + HITS)
