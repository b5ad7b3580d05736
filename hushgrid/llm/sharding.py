"""Sharding by size-tiered compaction (operator 9), native.

A dataset is a folder of immutable runs and a log of versions. ``append`` writes an arrival as a run of
small shards, ``append_each`` many arrivals in one pass. ``compact`` merges runs of similar size (a tier: none is
``SIMILAR`` times as large as its smallest) when ``FANOUT`` of them have gathered, into shards of about ``TARGET_BYTES``,
by reading their files in place: no shuffle. A merged run is about ``FANOUT`` times as large as its parts, so it leaves their
tier, a row is rewritten a logarithmic number of times and few runs are live.

A version is one small file that names the live runs. It is written aside and renamed to the next number,
which fails if another writer got there first; that writer then takes the newer version and tries again.
Readers see the old version or the new one, and a task or a driver that dies leaves files that no version
names. (A store whose rename replaces files needs one writer at a time.)

A writer marks its run before the first file, renews the mark every ``RENEW_S`` while it works and takes it away after the
commit. ``vacuum`` deletes runs that none of the last versions names, but never one that is marked, unless its mark is older than
``ABANDONED_S``. It lists runs first, marks next and versions last, so a commit in between is seen. A writer that was
taken for dead finds its mark gone and raises ``Abandoned`` instead of publishing a run without files. The
driver handles runs, never rows or shards.

Rows are kept as they are: nulls, repeated rows, very long texts and any columns, also such as differ from the output's by case alone. An empty arrival makes no
run and no version; a dataset without runs reads as an empty table of the schema given.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names

FANOUT, SIMILAR = 4, 2
TARGET_BYTES = 128 << 20
#: Age of a mark after which its writer counts as dead, and how often a living one renews it.
ABANDONED_S, RENEW_S = 24 * 3600, 600
#: Commits that lose against other writers before giving up.
TRIES = 20
ARRIVAL = "hushgrid_arrival"


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class Abandoned(RuntimeError):
    """The writer was taken for dead and its files may be gone: write the arrival again."""


class Shards:
    """A dataset of shards under ``root``."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target_bytes
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, what: str) -> list:
        at = self._path(f"{self.root}/{what}" if what else self.root)
        return list(self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._list("versions")]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{version, runs: [{path, bytes, shards, level, arrivals}]} of the latest or a given version."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return {"version": 0, "runs": []}
        text = self.spark.read.text(f"{self.root}/versions/{version:08d}.json", wholetext=True).first()
        return json.loads(text[0])

    def commit(self, base: int, runs: list[dict]) -> int:
        """Publish ``runs`` as the version after ``base``; fails if that version exists."""
        version = base + 1
        aside, final = self._path(f"{self.root}/versions/.{uuid.uuid4().hex}"), self._path(f"{self.root}/versions/{version:08d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"version": version, "runs": runs}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise Conflict(f"version {version} was committed by another writer")
        return version

    def _publish(self, change: Callable[[list[dict]], list[dict] | None], new: dict) -> int | None:
        """Commit what ``change`` makes of the live runs and of the marked run ``new``, anew where another writer came first; None if it makes nothing of them."""
        run = new["path"].partition("/runs/")[2].partition("/")[0]
        for _ in range(TRIES):
            now = self.manifest()
            if (runs := change(now["runs"])) is None:
                return None
            self._held(run, new["path"])
            try:
                version = self.commit(now["version"], runs)
            except Conflict:
                continue
            try:  # a vacuum that took the mark away just before may not have seen this version
                self._held(run, new["path"])
            except Abandoned:
                self._withdraw(new["path"])
                raise
            return version
        raise Conflict(f"no commit in {TRIES} tries")

    def _held(self, run: str, path: str) -> None:
        if not (self._fs.exists(self._path(f"{self.root}/marks/{run}")) and self._fs.exists(self._path(path))):
            raise Abandoned(f"run {run} has lost its mark or its files")

    def _withdraw(self, path: str) -> None:
        while True:
            now = self.manifest()
            try:
                self.commit(now["version"], [r for r in now["runs"] if r["path"] != path])
                return
            except Conflict:
                continue

    def mark(self, run: str, renew: bool = False) -> None:
        """Announce a run that no version names yet."""
        self._fs.create(self._path(f"{self.root}/marks/{run}"), renew).close()

    @contextmanager
    def _marked(self, run: str) -> Iterator[None]:
        """A mark that is renewed as long as the block runs; it stays, to age, where the block fails."""
        done = threading.Event()

        def renew() -> None:
            while not done.wait(RENEW_S):
                if self._fs.exists(self._path(f"{self.root}/marks/{run}")):  # one that was taken away stays away
                    self.mark(run, True)

        self.mark(run)
        beat = threading.Thread(target=renew, daemon=True)
        beat.start()
        try:
            yield
        finally:
            done.set()
            beat.join()
        self.unmark(run)

    def unmark(self, run: str) -> None:
        self._fs.delete(self._path(f"{self.root}/marks/{run}"), False)

    def _measured(self, path: str, level: int, arrivals: list[str]) -> dict:
        shards = [s for s in self._fs.listStatus(self._path(path)) if s.getPath().getName().startswith("part-")]
        return {"path": path, "bytes": sum(s.getLen() for s in shards), "shards": len(shards), "level": level, "arrivals": arrivals}

    def _write(self, df: DataFrame, run: str, level: int, arrivals: list[str]) -> dict | None:
        """Files of a marked run, or None if there is no row."""
        path = f"{self.root}/runs/{run}"
        df.write.option("compression", "zstd").parquet(path)
        if self.spark.read.parquet(path).isEmpty():
            self._fs.delete(self._path(path), True)
            return None
        return self._measured(path, level, arrivals)

    def append(self, df: DataFrame, arrival: str) -> int:
        """Write an arrival as a run of small shards and publish it; returns the version that holds it."""
        run = uuid.uuid4().hex
        with self._marked(run):
            written = self._write(df, run, 0, [arrival])
            return self._publish(lambda live: [*live, written], written) if written else self.manifest()["version"]

    def append_each(self, df: DataFrame, arrival: Column, after: Callable[[], object] | None = None) -> int:
        """Write many arrivals in one pass, then publish them one after another, as ``append`` would; ``after`` follows each."""
        run = uuid.uuid4().hex
        with self._marked(run):
            path = f"{self.root}/runs/{run}"
            df.withColumn(ARRIVAL, arrival).write.partitionBy(ARRIVAL).option("compression", "zstd").parquet(path)
            parts = [s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isDirectory()]
            for part in sorted(parts, key=lambda p: (len(p), p)):
                written = self._measured(f"{path}/{part}", 0, [f"arrival-{part.partition('=')[2]}"])
                self._publish(lambda live, w=written: [*live, w], written)
                if after:
                    after()
        return self.manifest()["version"]

    @staticmethod
    def tiers(runs: list[dict]) -> list[list[dict]]:
        """Runs of similar size together, small ones first."""
        out: list[list[dict]] = []
        for r in sorted(runs, key=lambda r: (r["bytes"], r["path"])):
            if out and r["bytes"] < SIMILAR * out[-1][0]["bytes"]:
                out[-1].append(r)
            else:
                out.append([r])
        return out

    def compact(self) -> int:
        """Merge tiers that hold FANOUT runs until none does; returns the last version."""
        while True:
            now = self.manifest()
            old = next((t for t in self.tiers(now["runs"]) if len(t) >= FANOUT), None)
            if not old:
                return now["version"]
            gone = {r["path"] for r in old}
            files = max(1, -(-sum(r["bytes"] for r in old) // self.target))
            run = uuid.uuid4().hex
            with self._marked(run):
                merged = self._write(self._read(old).coalesce(files), run, 1 + max(r["level"] for r in old), [a for r in old for a in r["arrivals"]])
                # a run that another writer has merged meanwhile isn't merged twice
                self._publish(lambda live: [*(r for r in live if r["path"] not in gone), merged] if gone <= {r["path"] for r in live} else None, merged)

    def _read(self, runs: list[dict]) -> DataFrame:
        first = self.spark.read.parquet(runs[0]["path"])
        return self.spark.read.schema(first.schema).parquet(*(r["path"] for r in runs))

    def vacuum(self, keep_versions: int = 2, abandoned_s: float = ABANDONED_S) -> int:
        """Delete the runs that none of the last ``keep_versions`` versions names and no writer marks; returns how many went.

        Readers of older versions than these lose their files.
        """
        runs: dict[str, tuple] = {}  # the end of each run's path, and its whole folder
        for s in self._list("runs"):
            name = s.getPath().getName()
            parts = [x.getPath() for x in self._list(f"runs/{name}") if x.getPath().getName().startswith(f"{ARRIVAL}=")]
            runs |= {f"{name}/{p.getName()}": p for p in parts} or {name: s.getPath()}
        marked = set()
        for s in self._list("marks"):
            if s.getModificationTime() / 1000 < time.time() - abandoned_s:
                self._fs.delete(s.getPath(), False)
            else:
                marked.add(s.getPath().getName())
        last = self.versions()[-max(1, keep_versions):]
        live = {r["path"].partition("/runs/")[2] for v in last for r in self.manifest(v)["runs"]}
        gone = [k for k in runs if k not in live and k.partition("/")[0] not in marked]
        for k in gone:
            self._fs.delete(runs[k], True)
        for top in {k.partition("/")[0] for k in gone if "/" in k}:
            if not any(x.isDirectory() for x in self._list(f"runs/{top}")):
                self._fs.delete(self._path(f"{self.root}/runs/{top}"), True)
        return len(gone)

    def read(self, schema=None) -> DataFrame:
        """All live rows, with the hidden column ``_metadata`` of their shards."""
        runs = self.manifest()["runs"]
        return self._read(runs) if runs else self.spark.createDataFrame([], schema)


def arrival_of(key: Column, n: int) -> Column:
    """The arrival, 0 to n - 1, that a row comes with."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def shard_table(docs: DataFrame, root: str, id_col: str = "doc_id", arrivals: int = FANOUT * FANOUT, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Store ``docs`` arrival by arrival, compacting after each, and return its rows with
    ``shard`` (file), ``level`` (merges behind it) and ``version``.

    Column names that clash with these get underscores in the result. ``root`` is new: nobody reads its older versions.
    """
    store = Shards(docs.sparkSession, root, target_bytes)

    def settle() -> None:
        before = store.manifest()["version"]
        if store.compact() != before:
            store.vacuum(1)

    store.append_each(docs, arrival_of(F.col(f"`{id_col}`"), arrivals), settle)
    store.vacuum(1)
    now = store.manifest()
    rows = store.read(docs.schema)
    keep = [F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, free_names(docs.columns, ["shard", "level", "version"]))]
    if not now["runs"]:
        return rows.select(*keep, F.lit("").alias("shard"), F.lit(0).alias("level"), F.lit(now["version"]).alias("version"))
    level = F.lit(0)
    run = F.regexp_extract("_metadata.file_path", "/runs/(.+)/[^/]+$", 1)
    for r in now["runs"]:
        level = F.when(run == r["path"].partition("/runs/")[2], F.lit(r["level"])).otherwise(level)
    return rows.select(*keep, F.concat_ws("/", run, F.col("_metadata.file_name")).alias("shard"), level.cast("int").alias("level"), F.lit(now["version"]).cast("int").alias("version"))
