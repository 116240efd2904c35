"""A versioned graph store: one writer commits batches of insertions or deletions, readers pin immutable versions.

Layout below a root folder: base/ (all edges of some version), delta/ (the batch
that made a version), manifest/K.json and pins/.  A commit writes its data, then
its manifest under another name, and renames that to the next number without
overwriting; the rename is the point at which the version exists, so a crash
leaves no half version.  The root must be on a file system whose rename is atomic
and refuses to overwrite (HDFS and its like); an object store needs a committer
that gives it that.

A pin is a file with the time until which it holds, so readers of other processes
are seen too; a reader that dies loses its pin when that time is over.  Data files
that no manifest names may belong to a commit under way: they go only when they
are older than GRACE_S.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgraph.plans.graph import Graph


#: Seconds that a pin holds unless it is renewed, and that unnamed data files are left alone.
LEASE_S, GRACE_S = 3600.0, 24 * 3600.0
#: Batches after which a commit writes a new base, so that reads stay short.
COMPACT_AFTER = 64


class Conflict(RuntimeError):
    """Another writer has committed the version."""


@dataclass(frozen=True)
class Snapshot:
    """A pinned version; use as a context manager or release it."""

    store: GraphStore
    version: int
    pin: str

    @property
    def graph(self) -> Graph:
        return self.store.graph_at(self.version)

    def renew(self, seconds: float = LEASE_S) -> None:
        self.store.hold(self.version, self.pin, seconds)

    def release(self) -> None:
        self.store.release(self.pin)

    def __enter__(self) -> Graph:
        return self.graph

    def __exit__(self, *_) -> None:
        self.release()


class GraphStore:
    def __init__(self, spark: SparkSession, root: str, compact_after: int = COMPACT_AFTER):
        self.spark, self.root, self.compact_after = spark, root.rstrip("/"), compact_after
        self._writing = threading.RLock()

    # -- files

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _delete(self, name: str) -> None:
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)

    def _read(self, version: int) -> dict:
        return self._json(f"manifest/{version}.json")

    def _json(self, name: str) -> dict:
        fs, p = self._fs(f"{self.root}/{name}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(b & 255 for b in stream.readAllBytes()))
        finally:
            stream.close()

    def _put(self, name: str, facts: dict) -> None:
        """The file, whole or not at all; raises Conflict if there is one of that name."""
        aside = f"{name}.{uuid.uuid4().hex}.part"
        fs, p = self._fs(f"{self.root}/{aside}")
        out = fs.create(p, False)
        try:
            out.write(bytearray(json.dumps(facts).encode()))
        finally:
            out.close()
        context, hadoop = self.spark.sparkContext, self.spark.sparkContext._jvm.org.apache.hadoop.fs
        never = context._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        never[0] = getattr(hadoop, "Options$Rename").NONE
        target = hadoop.Path(f"{self.root}/{name}")
        try:
            hadoop.FileContext.getFileContext(target.toUri(), context._jsc.hadoopConfiguration()).rename(p, target, never)
        except Exception as e:
            fs.delete(p, False)
            if fs.exists(target):
                raise Conflict(f"{name} exists") from e
            raise

    def _publish(self, version: int, facts: dict) -> None:
        self._put(f"manifest/{version}.json", facts)

    # -- versions

    @classmethod
    def create(cls, spark: SparkSession, root: str, graph: Graph | None = None, compact_after: int = COMPACT_AFTER) -> GraphStore:
        store = cls(spark, root, compact_after)
        graph = graph or Graph.empty(spark)
        folder = f"base/{uuid.uuid4().hex}"
        graph.edges.select("src", "dst").repartition("src").sortWithinPartitions("src", "dst").write.parquet(f"{store.root}/{folder}")
        graph.vertices.select("id").write.parquet(f"{store.root}/{folder}-v")
        store._publish(0, {"base": folder, "deltas": [], "batch": None})
        return store

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json"))

    def latest(self) -> int:
        return self.versions()[-1]

    def _pins(self) -> list[tuple[int, float, str]]:
        """(version, until when, name) of every pin."""
        return [(int(v), float(until), n) for n in self._names("pins") if not n.endswith(".part") for v, until in [n.split("-")[:2]]]

    def readers(self, version: int) -> int:
        return sum(v == version and until > time.time() for v, until, _ in self._pins())

    def acquire(self, version: int | None = None, seconds: float = LEASE_S) -> Snapshot:
        """A pinned version.  The pin is there before the version is looked at again, so no vacuum goes between."""
        while True:
            wanted = self.latest() if version is None else version
            pin = uuid.uuid4().hex
            self.hold(wanted, pin, seconds)
            if wanted in self.versions():
                return Snapshot(self, wanted, pin)
            self.release(pin)
            if version is not None:
                raise KeyError(f"version {version} is gone")

    def hold(self, version: int, pin: str, seconds: float) -> None:
        old = [n for _, _, n in self._pins() if n.endswith(pin)]
        self._put(f"pins/{version}-{time.time() + seconds:.3f}-{pin}", {})
        for name in old:
            self._delete(f"pins/{name}")

    def release(self, pin: str) -> None:
        for _, _, name in self._pins():
            if name.endswith(pin):
                self._delete(f"pins/{name}")

    # -- commits

    def insert_edges(self, batch: DataFrame, batch_id: int | None = None, small: bool = False) -> int:
        return self._commit("+", batch, batch_id, small)

    def delete_edges(self, batch: DataFrame, batch_id: int | None = None, small: bool = False) -> int:
        return self._commit("-", batch, batch_id, small)

    def _commit(self, op: str, batch: DataFrame, batch_id: int | None, small: bool) -> int:
        """A batch_id that a version carries already is not applied again."""
        with self._writing:
            latest = self.latest()
            facts = self._read(latest)
            if batch_id is not None and facts["batch"] is not None and batch_id <= facts["batch"]:
                return latest
            folder = f"delta/{uuid.uuid4().hex}"
            rows = batch.select(F.col("src").cast("long"), F.col("dst").cast("long")).dropDuplicates()
            (rows.coalesce(1) if small else rows).write.parquet(f"{self.root}/{folder}")
            deltas = [*facts["deltas"], [latest + 1, op, folder]]
            self._publish(latest + 1, {"base": facts["base"], "deltas": deltas, "batch": batch_id if batch_id is not None else facts["batch"]})
            if len(deltas) >= self.compact_after:
                self.compact()
            return latest + 1

    # -- reads

    def log(self, version: int) -> DataFrame:
        """(version, op, src, dst) of the batches since the version's base."""
        empty = self.spark.createDataFrame([], "version long, op string, src long, dst long")
        for number, op, folder in self._read(version)["deltas"]:
            empty = empty.union(self.spark.read.schema("src long, dst long").parquet(f"{self.root}/{folder}").select(F.lit(number).cast("long"), F.lit(op), "src", "dst"))
        return empty

    def graph_at(self, version: int) -> Graph:
        facts = self._read(version)
        base = self.spark.read.schema("src long, dst long").parquet(f"{self.root}/{facts['base']}")
        ids = self.spark.read.schema("id long").parquet(f"{self.root}/{facts['base']}-v")
        if not facts["deltas"]:
            return Graph(ids, base)
        log = self.log(version)
        edges = as_of(base.select(F.lit(0).cast("long").alias("version"), F.lit("+").alias("op"), "src", "dst").union(log), version)
        return Graph(ids.union(log.where("op = '+'").select("src")).distinct(), edges)

    # -- upkeep

    def compact(self) -> None:
        """Writes the latest version as the base of the versions to come; the version and its readers are unchanged."""
        latest = self.latest()
        graph = self.graph_at(latest)
        facts = self._read(latest)
        folder = f"base/{uuid.uuid4().hex}"
        graph.edges.repartition("src").sortWithinPartitions("src", "dst").write.parquet(f"{self.root}/{folder}")
        graph.vertices.write.parquet(f"{self.root}/{folder}-v")
        self._publish(latest + 1, {"base": folder, "deltas": [], "batch": facts["batch"]})

    def vacuum(self, grace: float = GRACE_S) -> list[int]:
        """Drops the versions that are neither the newest nor pinned, and the data older than ``grace`` seconds that no kept version needs."""
        now = time.time()
        for _, until, name in self._pins():
            if until <= now:
                self._delete(f"pins/{name}")
        every = self.versions()
        kept = {every[-1], *(v for v, until, _ in self._pins() if until > now)} & set(every)
        dropped = [v for v in every if v not in kept]
        for v in dropped:
            self._delete(f"manifest/{v}.json")
        # Read after the versions went: what a commit has published meanwhile is needed too.
        needed = set()
        for v in self.versions():
            facts = self._read(v)
            needed |= {facts["base"], f"{facts['base']}-v", *(d[2] for d in facts["deltas"])}
        for folder in ("base", "delta"):
            fs, p = self._fs(f"{self.root}/{folder}")
            for status in fs.listStatus(p) if fs.exists(p) else ():
                name = f"{folder}/{status.getPath().getName()}"
                if name not in needed and status.getModificationTime() / 1000 <= now - grace:
                    self._delete(name)
        return dropped


def as_of(log: DataFrame, version: int) -> DataFrame:
    """The edges of a change log (version, op, src, dst) at a version: the last change of each edge, if it is an insertion."""
    last = log.where(F.col("version") <= version).groupBy("src", "dst").agg(F.max_by("op", "version").alias("op"))
    return last.where("op = '+'").select("src", "dst")
