"""Incremental removal of repeated passages with a log-structured fingerprint index.

The index is a log of sorted immutable runs in a folder that a later application
can open: fingerprint runs hold, for each anchor context seen (k-gram and context
hash), the first document that has it; window runs hold the hashes of the windows
under contexts that met another context of the same k-gram, each with the first
document that has it.  A run is a Parquet table bucketed and sorted by its key, so a
batch of documents, whose ids are greater than all before it, is dealt to the same
buckets and merge-joined with each run as it lies.  Matches are verified on the
windows' words (two independent 64-bit hashes over all of them; historical texts are
read again where a fingerprint is shared for the first time), and what was new is
written as further runs.

Compaction goes by tiers: two runs of one tier are merged, bucket by bucket in
their order, to one of the next, so there are no more runs than the logarithm of
the number of batches, and a row is rewritten as often.  A later entry of a context
only says that its windows have been written.

Runs never change.  A manifest lists those that count; each batch writes a new one
when its runs are complete, and the last complete manifest holds.  A lost executor
or a failed batch so leaves the index as it was, and the batch can be given again.

Defined results: as for the suffix array, whose result on the same documents is
the same; batches are ranges of ids, and null ids go with the last one; an empty
batch adds empty runs.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import passages as P
from scriptorium.llm import suffixarray
from scriptorium.llm.runtime import Scratch, quietly_delete
from scriptorium.session import spread

BATCHES = 3
#: What the runs' order is worth to a join: that bucketed tables are read in it, and that a join by more columns than they are dealt by needs no shuffle.
IN_ORDER = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
SCHEMAS = {"run": "key bigint, sub bigint, _d bigint, _t bigint, shown int", "windows": "key bigint, sub bigint, _d bigint, _t bigint"}

#: Where a row comes from: the batch, history without written windows, history with them.
NEW, OLD, SHOWN = 0, 1, 2


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


@dataclass(frozen=True)
class Run:
    kind: str
    name: str
    tier: int


class FingerprintIndex:
    """``ingest`` batches in ascending order of ids; each gives the marks of its repeated passages.

    ``folder`` must be shared; an index that is there already is opened with what it was made with.  ``scratch`` is for the
    tables of a batch alone.
    """

    def __init__(self, scratch: Scratch, folder: str, *, window: int = P.WINDOW, gram: int = P.GRAM, buckets: int | None = None):
        self.scratch, self.spark, self.folder = scratch, scratch.spark, folder.rstrip("/")
        self.own = f"scriptorium_{uuid.uuid4().hex[:12]}"
        self.runs: list[Run] = []
        self.tables: dict[Run, str] = {}
        self.n = 0
        self.window, self.gram, self.buckets = window, gram, buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._open()
        atexit.register(self._forget)

    @contextmanager
    def in_order(self) -> Iterator[None]:
        """While the runs' order counts in the session's joins."""
        before = {key: self.spark.conf.get(key) for key in IN_ORDER}
        for key, value in IN_ORDER.items():
            self.spark.conf.set(key, value)
        try:
            yield
        finally:
            for key, value in before.items():
                self.spark.conf.set(key, value)

    def _open(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest/*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        written = sorted(int(f.getPath().getParent().getName()) for f in found or [])
        if not written:
            return
        rows = self.spark.read.parquet(f"{self.folder}/manifest/{written[-1]:08d}").collect()  # a row for each run, and one for the index
        for r in rows:
            if r.kind == "index":
                self.n, self.window, self.gram, self.buckets = r.tier, r.window, r.gram, r.buckets
        self.runs = [Run(r.kind, r.name, r.tier) for r in rows if r.kind != "index"]

    def _commit(self) -> None:
        rows = [("index", "", self.n, self.window, self.gram, self.buckets)] + [(r.kind, r.name, r.tier, None, None, None) for r in self.runs]
        made = self.spark.createDataFrame(rows, "kind string, name string, tier int, window int, gram int, buckets int")
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{self.n:08d}")

    def _path(self, run: Run) -> str:
        return f"{self.folder}/{run.kind}/{run.name}"

    def table(self, run: Run) -> DataFrame:
        """A run, which this application knows by a name of its own."""
        if run not in self.tables:
            name = f"{self.own}_{run.kind}_{run.name.replace('-', '_')}"
            self.spark.sql(f"CREATE TABLE {name} ({SCHEMAS[run.kind]}) USING parquet CLUSTERED BY (key) SORTED BY (key, sub) INTO {self.buckets} BUCKETS LOCATION '{self._path(run)}'")
            self.tables[run] = name
        return self.spark.table(self.tables[run])

    def _forget(self) -> None:
        try:
            for name in self.tables.values():
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # noqa: BLE001  the session is gone, and its catalog with it
            pass

    def _write(self, rows: DataFrame, run: Run) -> None:
        """Rows in buckets already, as a new run."""
        name = f"{self.own}_writes"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        writer = rows.sortWithinPartitions("key", "sub").write.format("parquet").mode("overwrite").option("compression", "zstd").option("path", self._path(run))
        writer.bucketBy(self.buckets, "key").sortBy("key", "sub").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        self.runs.append(run)

    def _dealt(self, rows: DataFrame, *last: Column) -> DataFrame:
        """One row for each key and sub key, in buckets."""
        least = F.min(F.struct("_d", "_t")).alias("first")
        return rows.repartition(self.buckets, "key").groupBy("key", "sub").agg(least, *last).select("key", "sub", "first._d", "first._t", *[c for c in ("shown",) if last])

    def _history(self, kind: str, keys: DataFrame) -> DataFrame | None:
        """Entries of the runs under the keys (in buckets), by a merge join with each run."""
        found = [self.table(r).join(keys.hint("merge"), "key", "left_semi") for r in self.runs if r.kind == kind]
        return _all(found) if found else None

    def _keys(self, rows: DataFrame) -> DataFrame:
        return rows.select("key").repartition(self.buckets, "key").distinct()

    def ingest(self, batch: DataFrame, history: DataFrame | None) -> DataFrame:
        """Marks of the batch's documents. ``batch``, ``history``: see ``passages.keyed``; history holds all earlier batches' texts."""
        with self.in_order():
            return self._ingest(batch, history)

    def _ingest(self, batch: DataFrame, history: DataFrame | None) -> DataFrame:
        own = f"{self.n + 1:06d}"
        keep, drop = self.scratch.keep, self.scratch.drop
        anchors = keep(P.anchor_rows(batch, self.window, self.gram).withColumn("of", F.lit(NEW)), f"anchors-{own}", compression="zstd")
        every = anchors
        if (old := self._history("run", self._keys(anchors))) is not None:
            old = old.groupBy("key", "sub").agg(F.min(F.struct("_d", "_t")).alias("first"), F.max("shown").alias("shown"))
            every = anchors.unionByName(old.select("key", "sub", "first._d", "first._t", F.when(F.col("shown") == 1, SHOWN).otherwise(OLD).cast("int").alias("of")))
        met = keep(P.sorted_neighbours(every, True, "of int", alone=True), f"met-{own}", compression="zstd")
        drop(f"anchors-{own}")

        shared = met.where((F.col("kind") == P.FIRST) & (F.col("of") != SHOWN))
        fresh = P.window_rows(batch, shared.where(F.col("of") == NEW).select("_d", "_t", "sub"), self.window, self.gram).withColumn("of", F.lit(NEW))
        if history is not None:
            again = P.window_rows(history, shared.where(F.col("of") == OLD).select("_d", "_t", "sub"), self.window, self.gram)
            fresh = fresh.unionByName(again.withColumn("of", F.lit(OLD)))
        fresh = keep(fresh, f"fresh-{own}", compression="zstd")
        old = self._history("windows", self._keys(fresh))
        every = fresh if old is None else fresh.unionByName(old.withColumn("of", F.lit(OLD)))
        repeated = P.sorted_neighbours(every, False, "of int").where(F.col("of") == NEW)
        marks = keep(P.marks(met.where((F.col("kind") == P.REPEAT) & (F.col("of") == NEW)), repeated), f"marks-{own}")

        entries = met.where((F.col("kind") != P.REPEAT) & ((F.col("of") == NEW) | ((F.col("of") == OLD) & (F.col("kind") == P.FIRST))))
        entries = entries.select("key", "sub", "_d", "_t", (F.col("kind") == P.FIRST).cast("int").alias("shown"))
        self._write(self._dealt(entries, F.max("shown").alias("shown")), Run("run", f"{own}-0", 0))
        self._write(self._dealt(fresh), Run("windows", f"{own}-0", 0))
        drop(f"met-{own}", f"fresh-{own}")
        self.n += 1
        replaced = [x for kind in SCHEMAS for x in self._compact(kind)]
        self._commit()
        for run in replaced:  # no manifest to come names them
            if name := self.tables.pop(run, None):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            quietly_delete(self.spark, self._path(run))
        return marks

    def _compact(self, kind: str) -> list[Run]:
        """Merges two runs of a tier to one of the next, as long as there are two of any; those that were replaced."""
        replaced = []
        while True:
            tiers = [r.tier for r in self.runs if r.kind == kind]
            twice = [t for t in tiers if tiers.count(t) > 1]
            if not twice:
                return replaced
            a, b = [r for r in self.runs if r.kind == kind and r.tier == min(twice)][:2]
            merged = Run(kind, f"{self.n:06d}-{a.tier + 1}", a.tier + 1)
            self._write(self.merged(a, b), merged)
            self.runs = [r for r in self.runs if r not in (a, b)]
            replaced += [a, b]

    def merged(self, a: Run, b: Run) -> DataFrame:
        """Both runs' entries, one for each key and sub key: a merge join of the runs as they lie."""
        pairs = self.table(a).alias("a").join(self.table(b).alias("b").hint("merge"), ["key", "sub"], "full_outer")
        first = lambda s: F.when(F.col(f"{s}._d").isNotNull(), F.struct(F.col(f"{s}._d").alias("_d"), F.col(f"{s}._t").alias("_t")))
        shown = [F.greatest("a.shown", "b.shown").alias("shown")] if a.kind == "run" else []
        rows = pairs.select("key", "sub", F.least(first("a"), first("b")).alias("first"), *shown)
        return rows.select("key", "sub", "first._d", "first._t", *["shown" for _ in shown])


def batches_of(source: DataFrame, n: int) -> list[DataFrame]:
    """Ranges of ids with about as many documents each."""
    cuts = source.where(F.col("_d") != P.NO_ID).agg(F.percentile_approx("_d", [k / n for k in range(1, n)], 1000)).first()[0] or []
    edges = sorted(set(cuts))
    bounds = list(zip([None, *edges], [*edges, None], strict=True))
    return [source.where((F.lit(True) if lo is None else F.col("_d") > lo) & (F.lit(True) if hi is None else F.col("_d") <= hi)) for lo, hi in bounds]


def op4_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in batches by id; windows of 50 words. The index goes when the application ends."""
    scratch = Scratch(spark, "op4")
    source = P.keyed(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), "doc_id", "text")
    index = FingerprintIndex(scratch, scratch.path("index"))
    marks, history = [], None
    for batch in batches_of(source, BATCHES):
        marks.append(index.ingest(batch, history))
        history = batch if history is None else history.unionByName(batch)
    return scratch.until_exit(suffixarray.digested(source, _all(marks)))


ORACLE = suffixarray.ORACLE
