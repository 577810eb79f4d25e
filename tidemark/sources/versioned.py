"""Keyed tables in versioned Parquet: each batch rewrites the buckets it touches and commits with one manifest.

Layout below the root: data/v=<n>/depth=<d>/code=<c>/, notes/v=<n>/ (ledger, audit rows, rejects) and manifest/v=<n>/. The manifest is written last and holds all
state: which version holds each bucket, what batches and sequences were applied, drops, fences. So data and state commit together, and a batch that
fails leaves nothing that a reader sees.

Buckets follow size: a bucket holds the rows whose key hash ends in `depth` given bits, and splits by the next bits where it would pass
`rows_per_bucket`. A batch reads and rewrites the buckets of its keys alone.

Positions: a row holds the position (cluster_time, seq) of its last change, a deleted one stays as a tombstone. A change counts if its position is above
that of its key, so batches and files may come in any order. `drop` and `dropDatabase` are bounds: whatever a table held up to that position is gone,
whether it came before the drop or comes later. A snapshot has a fence for each table: changes up to it are in the snapshot.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import micros
from tidemark.operators.changelog import DDL, DML, latest
from tidemark.sources.intervals import Intervals, covered, holds, islands, merged

HIDDEN = "_gone boolean, _db string, _coll string"
NOTE = "kind string, stream string, batch long, status string, db string, coll string, op string, seq long, docs long, message string, at timestamp"
#: Most intervals of sequences that one table's state may have; numbers that are not dense run into it and are an error.
MOST_INTERVALS = 100_000


@dataclasses.dataclass
class Manifest:
    """All state of one version. Tables are named "db.coll", a whole database "db."; positions are [microseconds, sequence]."""

    version: int = 0
    generation: int = 0
    last_seq: int = -1
    buckets: dict[str, list[int]] = dataclasses.field(default_factory=lambda: {"0/0": [0, 0]})  # depth/code: version that holds it, rows
    batches: dict[str, Intervals] = dataclasses.field(default_factory=dict)  # by stream
    applied: dict[str, Intervals] = dataclasses.field(default_factory=dict)  # sequences by JSON list [client, db, coll]
    drops: dict[str, list[int]] = dataclasses.field(default_factory=dict)
    fences: dict[str, list[int]] = dataclasses.field(default_factory=dict)
    settled: int | None = None  # no change older than this is still to come


class VersionedTarget:
    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, rows_per_bucket: int = 1_000_000, history: int = 20):
        self.spark, self.root, self.schema, self.key, self.rows_per_bucket, self.history = spark, root.rstrip("/"), schema, key, rows_per_bucket, history

    # state

    def _path(self, *parts):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions that are kept, newest first: one listing of `history` folders or few more."""
        fs, folder = self._fs(), self._path("manifest")
        found = sorted((int(s.getPath().getName()[2:]) for s in (fs.listStatus(folder) if fs.exists(folder) else ())), reverse=True)
        return [v for v in found if fs.exists(self._path("manifest", f"v={v}", "_SUCCESS"))]

    def manifest(self) -> Manifest:
        """The newest version's state; no other version is read."""
        found = self.versions()
        return Manifest(**json.loads(self.spark.read.text(f"{self.root}/manifest/v={found[0]}", wholetext=True).first()[0])) if found else Manifest()

    def positions(self) -> DataFrame:
        """Per client and table: the sequence up to which all have been applied, the greatest one, and the number of gaps between."""
        rows = [(*json.loads(k), i[0][1], i[-1][1], len(i) - 1) for k, i in self.manifest().applied.items()]
        return self.spark.createDataFrame(rows, "client string, db string, coll string, acked_seq long, last_seq long, gaps int")

    # buckets

    def _depth(self, m: Manifest) -> int:
        return max(int(b.split("/")[0]) for b in m.buckets)

    def _with_bucket(self, rows: DataFrame, m: Manifest) -> DataFrame:
        """Rows with `depth` and `code` of their bucket. Slots of the deepest level are listed: about as many as buckets."""
        deepest = self._depth(m)
        slot = F.xxhash64(self.key).bitwiseAND(F.lit(2**deepest - 1))
        if all(b.startswith(f"{deepest}/") for b in m.buckets):
            return rows.withColumns({"depth": F.lit(deepest), "code": slot})
        slots = []
        for b in m.buckets:
            d, c = map(int, b.split("/"))
            slots += [(c + (i << d), d, c) for i in range(2 ** (deepest - d))]
        known = F.broadcast(self.spark.createDataFrame(slots, "_slot long, depth int, code long"))
        return rows.withColumn("_slot", slot).join(known, "_slot").drop("_slot")

    def _stored(self, m: Manifest, buckets: Iterable[str]) -> DataFrame:
        """Rows and tombstones as they were written, with hidden columns."""
        paths = [f"{self.root}/data/v={m.buckets[b][0]}/depth={b.split('/')[0]}/code={b.split('/')[1]}" for b in buckets if m.buckets[b][1]]
        schema = f"{self.schema}, {HIDDEN}"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _above(self, rows: DataFrame, bounds: dict[str, list[int]], db: str, coll: str) -> DataFrame:
        """Rows whose position is above the bounds of their table and of its database; one row a table that has a bound is broadcast."""
        for part, name in ((lambda k: not k.endswith("."), F.concat_ws(".", db, coll)), (lambda k: k.endswith("."), F.concat(F.col(db), F.lit(".")))):
            some = [(k, *v) for k, v in bounds.items() if part(k)]
            if some:
                known = F.broadcast(self.spark.createDataFrame(some, "_name string, _time long, _seq long"))
                here = F.struct(micros(F.col("cluster_time")), F.col("seq"))
                rows = rows.withColumn("_name", name).join(known, "_name", "left").filter(F.col("_time").isNull() | (here > F.struct("_time", "_seq"))).drop("_name", "_time", "_seq")
        return rows

    def _live(self, m: Manifest, buckets: Iterable[str]) -> DataFrame:
        """Stored rows that no drop has taken, and tombstones that an older change may still meet."""
        rows = self._stored(m, buckets)
        if m.drops:
            rows = self._above(rows, m.drops, "_db", "_coll")
        if m.settled is not None and "cluster_time" in rows.columns:
            rows = rows.filter(~F.coalesce("_gone", F.lit(False)) | (micros(F.col("cluster_time")) > m.settled))
        return rows

    def read(self) -> DataFrame:
        m = self.manifest()
        return self._live(m, m.buckets).filter(~F.coalesce("_gone", F.lit(False))).drop("_gone", "_db", "_coll")

    # commits

    def commit(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, last_seq: int = -1, batch: int = 0, replace: bool = False, stream: str = "") -> bool:
        """Apply rows and keys that don't overlap; with `replace` the table is emptied first. False if the stream's batch was applied before. Rows
        without a key are put on record with the rejects."""
        m = self.manifest()
        if holds(m.batches.get(stream, []), batch):
            return False
        notes = []
        rows = self._empty() if upserts is None else upserts.select(self._columns()).withColumns({"_gone": F.lit(False), "_db": F.lit(None).cast("string"), "_coll": F.lit(None).cast("string")})
        if upserts is not None:
            notes.append(self._rejected(rows, stream, batch, self.key))
        m.last_seq = max(m.last_seq, last_seq)
        self._write(m, rows.filter(F.col(self.key).isNotNull()), None if deletes is None else deletes.select(self.key), stream, batch, notes, replace)
        return True

    def insert_new(self, rows: DataFrame, batch: int, last_seq: int = -1, stream: str = "") -> bool:
        """Insert-ignore: rows whose key is there already are left out. Only the buckets of the keys that come are read."""
        m = self.manifest()
        touched = self._touched(m, rows.filter(F.col(self.key).isNotNull()).select(self.key))
        there = self._live(m, touched).filter(~F.coalesce("_gone", F.lit(False))).select(self.key)
        return self.commit(rows.join(there, self.key, "left_anti"), None, last_seq, batch, stream=stream)

    def bootstrap(self, snapshot: DataFrame, fence: DataFrame, batch: int, stream: str = "", db: str | None = None, coll: str | None = None) -> bool:
        """Start over from a snapshot: a new generation, all state reset. `fence` (db, coll, cluster_time, seq) is the position of the log at which the
        snapshot was taken, a row a table; changes up to it are in the snapshot, later ones are merged by position, those that were applied already
        included: the stream doesn't bring them again. `db` and `coll` name
        the snapshot's columns for its table, so that later drops find its rows. Rows without a position of their own get the fence's."""
        old = self.manifest()
        if holds(old.batches.get(stream, []), batch):
            return False
        fences = {f"{r.db}.{r.coll}": [r.at, r.seq] for r in fence.groupBy("db", "coll").agg(F.max(F.struct(micros(F.col("cluster_time")).alias("at"), "seq")).alias("p")).select("db", "coll", "p.*").collect()}
        past = lambda name, at: at > fences[name] if name in fences else not name.endswith(".") or any(at > f for k, f in fences.items() if k.startswith(name))
        m = Manifest(version=old.version, generation=old.generation + 1, fences=fences, last_seq=max((s for _, s in fences.values()), default=-1),
                     buckets=old.buckets, batches={stream: old.batches.get(stream, [])}, drops={k: v for k, v in old.drops.items() if past(k, v)})
        named = snapshot.withColumns({"_gone": F.lit(False), "_db": F.col(db) if db else F.lit(None).cast("string"), "_coll": F.col(coll) if coll else F.lit(None).cast("string")})
        if "cluster_time" in self._columns() and "cluster_time" not in snapshot.columns:
            at = fence.groupBy("db", "coll").agg(F.max(F.struct("cluster_time", "seq")).alias("p")).select(F.col("db").alias("_db"), F.col("coll").alias("_coll"), "p.*")
            named = named.drop("seq").join(F.broadcast(at), ["_db", "_coll"], "left")
        rows = named.select(*self._columns(), "_gone", "_db", "_coll")
        notes = [self._rejected(rows, stream, batch, self.key)]
        rows = rows.filter(F.col(self.key).isNotNull())
        if "cluster_time" in self._columns():
            newer = self._above(self._live(old, old.buckets), fences, "_db", "_coll").filter(F.concat_ws(".", "_db", "_coll").isin(*fences))
            rows = rows.join(newer.select(self.key), self.key, "left_anti").select(newer.columns).unionByName(newer)
        self._write(m, rows, None, stream, batch, notes, True)
        return True

    def check_start(self, start: int, now: int, stale_seconds: int = 3600) -> list[str]:
        """A stream may start at the fences or later (all in microseconds): an earlier start is an error, fences older than an hour are a warning."""
        fences = self.manifest().fences
        early = [k for k, (at, _) in fences.items() if start < at]
        if early:
            raise ValueError(f"the stream starts before the snapshot of {', '.join(sorted(early))} was taken")
        return [f"fence of {k} is {(now - at) // 1_000_000} s old" for k, (at, _) in sorted(fences.items()) if now - at > stale_seconds * 1_000_000]

    def apply(self, changes: DataFrame, batch: int, doc_fields: list[str], stream: str = "", client: str | None = None, dense: bool = True, settled: int | None = None) -> bool:
        """Apply a batch of a changelog; what is not above the position of its key, table or database is skipped.

        `client` names a column by which the ledger counts. Where sequences are dense per client and table, those that were applied are skipped as replays, while
        late ones below the highest are not. Rows of DDL are taken in as bounds (drops) or put on record (all others), changes without a key with the rejects.
        `settled` (microseconds) says that no older change will come: tombstones up to there are let go. Repeating a batch does nothing.
        """
        m = self.manifest()
        if holds(m.batches.get(stream, []), batch):
            return False
        changes = changes.persist()
        try:
            notes = [changes.filter(F.col("op").isin(*DDL)).select(*self._note("audit", stream, batch, None), "db", "coll", "op", "seq", F.lit(None).cast("long").alias("docs"), F.lit(None).cast("string").alias("message"), F.col("cluster_time").cast("timestamp").alias("at")),
                     self._rejected(changes.filter(F.col("op").isin(*DML)), stream, batch, self.key)]
            control = F.when(F.col("op").isin("drop", "dropDatabase"), F.col("op"))
            place = F.max(F.struct(micros(F.col("cluster_time")).alias("at"), "seq")).alias("p")
            for r in changes.groupBy("db", "coll", control.alias("control")).agg(place, F.max("seq").alias("top")).collect():  # three rows a table at most
                m.last_seq = max(m.last_seq, -1 if r.top is None else r.top)
                if r.control:
                    name = f"{r.db}.{r.coll if r.control == 'drop' else ''}"
                    m.drops[name] = max(m.drops.get(name, [*r.p]), [*r.p])
            who = F.col(client).cast("string") if client else F.lit(None).cast("string")
            null = F.lit(None).cast("string")
            notes.append(changes.groupBy(who.alias("message")).agg(F.count("*").alias("docs"), F.max("seq").alias("seq")).select(
                *self._note("ledger", stream, batch, "completed"), null.alias("db"), null.alias("coll"), null.alias("op"), "seq", "docs", "message", F.current_timestamp().alias("at")))
            rows = changes.filter(F.col("op").isin(*DML) & F.col(self.key).isNotNull())
            if client and dense:
                rows = self._unapplied(m, rows, client)
                self._acknowledge(m, changes.select(F.col(client).cast("string").alias("client"), "db", "coll", "seq"))
            rows = self._above(self._above(rows, m.fences, "db", "coll"), m.drops, "db", "coll")
            if m.settled is not None:
                rows = rows.filter(micros(F.col("cluster_time")) > m.settled)
            fresh = latest(rows, [self.key]).persist()
            try:
                touched = self._touched(m, fresh.select(self.key))
                stored = self._live(m, touched).select(self.key, F.struct("cluster_time", "seq").alias("_position"))
                later = fresh.join(stored, self.key, "left").filter(F.col("_position").isNull() | (F.struct("cluster_time", "seq") > F.col("_position")))
                gone = F.col("op") == "delete"
                fields = [F.when(~gone, F.col(f"doc.{c}")).alias(c) for c in doc_fields]
                have = {"cluster_time", "seq", self.key, *doc_fields}
                kind = self.spark.createDataFrame([], self.schema).schema
                rest = [F.lit(None).cast(kind[c].dataType).alias(c) for c in self._columns() if c not in have]
                rows = later.select(self.key, "cluster_time", "seq", *fields, *rest, gone.alias("_gone"), F.col("db").alias("_db"), F.col("coll").alias("_coll")).select(*self._columns(), "_gone", "_db", "_coll")
                if settled is not None:
                    m.settled = max(settled, settled if m.settled is None else m.settled)
                self._write(m, rows, None, stream, batch, notes, incoming=touched)
                return True
            finally:
                fresh.unpersist()
        finally:
            changes.unpersist()

    def _unapplied(self, m: Manifest, rows: DataFrame, client: str) -> DataFrame:
        """Changes whose sequence isn't among those applied for their client and table."""
        known = [(*json.loads(k), at) for at, k in enumerate(m.applied)]
        if not known:
            return rows
        state = F.broadcast(self.spark.createDataFrame(known, "_c string, db string, coll string, _at int"))
        done = covered(list(m.applied.values()))(F.col("_at"), F.col("seq"))
        return rows.withColumn("_c", F.col(client).cast("string")).join(state, ["_c", "db", "coll"], "left").filter(F.col("_at").isNull() | ~done).select(rows.columns)

    def _acknowledge(self, m: Manifest, seen: DataFrame) -> None:
        """Add a batch's sequences to those applied, as intervals."""
        new: dict[str, Intervals] = {}
        for r in islands(seen, ["client", "db", "coll"], "seq", MOST_INTERVALS):
            new.setdefault(json.dumps([r.client, r.db, r.coll]), []).append([r.lo, r.hi])
        for name, found in new.items():
            m.applied[name] = merged(m.applied.get(name, []), found)
        if sum(map(len, m.applied.values())) > MOST_INTERVALS:
            raise ValueError("sequences are not dense per client and table: number them first")

    # writing

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], f"{self.schema}, {HIDDEN}")

    def _note(self, kind: str, stream: str, batch: int, status: str | None) -> list[Column]:
        return [F.lit(kind).alias("kind"), F.lit(stream).alias("stream"), F.lit(batch).cast("long").alias("batch"), F.lit(status).cast("string").alias("status")]

    def _rejected(self, rows: DataFrame, stream: str, batch: int, key: str) -> DataFrame:
        """One row with the number of rows without a key, if there are any."""
        none = F.lit(None).cast("string")
        n = rows.filter(F.col(key).isNull()).agg(F.count("*").alias("docs")).filter("docs > 0")
        return n.select(*self._note("reject", stream, batch, None), none.alias("db"), none.alias("coll"), none.alias("op"), F.lit(None).cast("long").alias("seq"), "docs", F.lit(f"no {key}").alias("message"), F.current_timestamp().alias("at"))

    def _touched(self, m: Manifest, keys: DataFrame) -> dict[str, int]:
        """Buckets of these keys, with how many there are in each: as many rows as buckets."""
        return {f"{r.depth}/{r.code}": r["count"] for r in self._with_bucket(keys, m).groupBy("depth", "code").count().collect()}

    def _write(self, m: Manifest, rows: DataFrame, deletes: DataFrame | None, stream: str, batch: int, notes: list[DataFrame], replace: bool = False, incoming: dict[str, int] | None = None) -> None:
        """Rewrite the buckets that rows and deletes touch, then the notes, then the manifest."""
        m.version += 1
        keys = rows.select(self.key) if deletes is None else rows.select(self.key).unionByName(deletes)
        incoming = self._touched(m, keys) if incoming is None else incoming
        touched = dict.fromkeys(m.buckets, 0) | incoming if replace else incoming
        kept = self._empty() if replace else self._live(m, touched).join(keys, self.key, "left_anti")
        after = {}
        for b in touched:
            depth, code = map(int, b.split("/"))
            extra = max(0, (-(-(touched[b] + (0 if replace else m.buckets[b][1])) // self.rows_per_bucket) - 1).bit_length())
            after |= {f"{depth + extra}/{code + (i << depth)}": [m.version, 0] for i in range(2**extra)}
            del m.buckets[b]
        m.buckets |= after
        if touched:
            out, path = self._with_bucket(kept.unionByName(rows), m), f"{self.root}/data/v={m.version}"
            out.repartition(len(after), "depth", "code").write.partitionBy("depth", "code").parquet(path, mode="overwrite")
            try:
                sizes = self.spark.read.schema("depth int, code long").parquet(path).groupBy("depth", "code").count().collect()
            except AnalysisException:  # nothing was left to write
                sizes = []
            for r in sizes:
                m.buckets[f"{r.depth}/{r.code}"][1] = r["count"]
        m.batches[stream] = merged(m.batches.get(stream, []), [[batch, batch]])
        self._write_notes(m, notes)
        self.spark.createDataFrame([(json.dumps(dataclasses.asdict(m)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/manifest/v={m.version}")
        self._prune(m)

    def _write_notes(self, m: Manifest, notes: list[DataFrame]) -> None:
        if notes:
            reduce(DataFrame.unionByName, notes).coalesce(1).write.parquet(f"{self.root}/notes/v={m.version}", mode="overwrite")

    def notes(self, kind: str) -> DataFrame:
        """Rows on record of committed versions: audit (DDL), reject (rows without a key), ledger (completed batches)."""
        newest = self.manifest().version
        try:
            found = self.spark.read.schema(f"{NOTE}, v long").option("basePath", f"{self.root}/notes").parquet(f"{self.root}/notes")
        except AnalysisException:
            return self.spark.createDataFrame([], f"{NOTE}, v long")
        return found.filter((F.col("v") <= newest) & (F.col("kind") == kind))

    # ledger

    def _log(self, stream: str, batch: int, attempt: str, status: str, message: str | None = None) -> None:
        row = [("ledger", stream, batch, status, None, None, None, None, None, message, dt.datetime.now())]
        self.spark.createDataFrame(row, NOTE).withColumn("attempt", F.lit(attempt)).coalesce(1).write.parquet(f"{self.root}/ledger/{attempt}-{status}")

    def recorded(self, stream: str, batch: int, work: Callable[[], bool]) -> bool:
        """Do the work of a batch on record: in progress before it writes, failed with its message if it raises. Completion is part of the commit
        itself (see apply), so there is none without data and no data without it."""
        attempt = f"{stream}-{batch}-{uuid.uuid4().hex}"
        self._log(stream, batch, attempt, "in_progress")
        try:
            return work()
        except Exception as e:
            self._log(stream, batch, attempt, "failed", str(e).strip().split("\n")[0][:500])
            raise

    def ledger(self) -> DataFrame:
        """One row per batch and client where completed: stream, batch, client, status, docs, end_seq; else one row: failed with its last message, or in_progress.
        A batch in progress that another attempt or a later batch has passed is orphaned: its job is gone."""
        done = self.notes("ledger").select("stream", "batch", F.col("message").alias("client"), F.lit("completed").alias("status"), "docs", F.col("seq").alias("end_seq"), F.lit(None).cast("string").alias("message"))
        try:
            tries = self.spark.read.schema(f"{NOTE}, attempt string").parquet(f"{self.root}/ledger/*")
        except AnalysisException:
            return done
        per = tries.groupBy("stream", "batch", "attempt").agg(F.max(F.struct(F.col("status") == "failed", "status", "message")).alias("s"), F.min("at").alias("at"))
        last = per.groupBy("stream", "batch").agg(F.max_by("s", "at").alias("s"), F.max("at").alias("at"))
        newest = last.groupBy("stream").agg(F.max("at").alias("newest"))
        open_ = last.join(done.select("stream", "batch").distinct(), ["stream", "batch"], "left_anti").join(F.broadcast(newest), "stream")
        status = F.when((F.col("s.status") == "in_progress") & (F.col("at") < F.col("newest")), "orphaned").otherwise(F.col("s.status"))
        null = F.lit(None)
        return done.unionByName(open_.select("stream", "batch", null.cast("string").alias("client"), status.alias("status"), null.cast("long").alias("docs"), null.cast("long").alias("end_seq"), "s.message"))

    def _prune(self, m: Manifest) -> None:
        """Let go of manifests beyond `history` and of data that no kept manifest points to."""
        old = self.versions()[self.history:]
        if not old:
            return
        fs, used = self._fs(), {v for v, _ in m.buckets.values()}
        for v in old:
            fs.delete(self._path("manifest", f"v={v}"), True)
        oldest = self.versions()[-1]
        held = Manifest(**json.loads(self.spark.read.text(f"{self.root}/manifest/v={oldest}", wholetext=True).first()[0]))
        used |= {v for v, _ in held.buckets.values()}
        folder = self._path("data")
        for s in fs.listStatus(folder) if fs.exists(folder) else ():
            v = int(s.getPath().getName()[2:])
            if v <= oldest and v not in used:  # a bucket that a later manifest holds by an older version is in the oldest one too
                fs.delete(s.getPath(), True)
