"""Size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder of any file system that Spark reads and writes:

* ``data/<batch>/*.parquet``: shards, never changed once a manifest names them;
* ``manifests/<version>.json``: the head of a version: the table's schema, its open shards with their bytes and rows, and the
  names of its sealed lists;
* ``manifests/sealed-<id>/*.parquet``: sealed lists of finished shards, written once.

Arrivals are appended as small shards of at most so many rows; one write, no shuffle. Compaction puts the live shards in
tiers by size, each tier ``RATIO`` times the one below, and merges the shards of a tier that holds at least ``LEAST_RUN`` of
them, in runs of about the target size; a run becomes one file, written by one task. Shards near the target or above it are
left alone. Rounds follow until no tier is full, so a row is rewritten about once for each tier that it climbs.

Compaction also seals: once ``SEAL`` open shards are finished, they move from the head to a sealed list, which later versions
only name. So a head holds the shards of recent arrivals, a few of each tier and fewer than ``SEAL`` finished ones, however
large the table is, and appends and compactions read and write the head alone. Readers take the sealed lists too, an entry a
file, as any scan of files does. Sealed shards stay as they are, also under a larger target.

A commit writes the manifest under a temporary name and renames it to the next version, which fails if that version is
there: of two writers one wins, the other reads the new version and applies its change again. Readers take the highest
version and see all of a commit or nothing. Files that no manifest names (of failed writes or lost executors) and files of
old versions go when ``vacuum`` is called.

Rows are kept as they are: nulls, ties, repeats and any columns. Empty arrivals add no shard; a store without shards reads
as an empty table with the schema of the first append.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passplane.llm.base import documents, shared_folder

#: Size of a finished shard; growth from tier to tier; shards that fill a tier; rows of an arriving shard.
TARGET_BYTES, RATIO, LEAST_RUN, ARRIVAL_ROWS = 64 << 20, 4, 4, 2000
#: Shards that one round of compaction takes in, a bound on the plan that is sent to executors.
ROUND_SHARDS = 20_000
#: Finished shards that are put in a sealed list together; share of the target from which a shard is finished.
SEAL, FINISHED = 1000, 0.75


#: An entry of a list of shards.
SHARD = "path string, bytes long, rows long"


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class Store:
    """A table of shards in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)
        for name in ("data", "manifests"):
            self._fs.mkdirs(self._path(f"{self.folder}/{name}"))

    def version(self) -> int:
        """The highest version; 0 before the first commit."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/manifests"))]
        return max([0, *(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())])

    def head(self, version: int | None = None) -> dict:
        """The head of a version, the highest if none is given: its open shards and the names of its sealed lists."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": [], "sealed": []}
        file = self._fs.open(self._path(f"{self.folder}/manifests/{version:012d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def manifest(self, version: int | None = None) -> dict:
        """A version, the highest if none is given, with all its shards open: those of its sealed lists, then the others."""
        head = self.head(version)
        if not head["sealed"]:
            return head
        rows = self.spark.read.schema(SHARD).parquet(*[f"{self.folder}/manifests/{n}" for n in head["sealed"]])
        return head | {"shards": [r.asDict() for r in rows.collect()] + head["shards"], "sealed": []}

    def _sealed(self, base: dict, target: int) -> dict:
        """The base with its finished shards in a sealed list if they are many enough, else as it is."""
        done = [s for s in base["shards"] if s["bytes"] >= target * FINISHED]
        if len(done) < SEAL:
            return base
        name = f"sealed-{uuid.uuid4().hex}"
        self.spark.createDataFrame(done, SHARD).coalesce(1).write.parquet(f"{self.folder}/manifests/{name}")
        return base | {"shards": [s for s in base["shards"] if s["bytes"] < target * FINISHED], "sealed": [*base["sealed"], name]}

    def commit(self, base: dict, schema: str, shards: list[dict]) -> dict:
        """Makes these open shards, and the sealed lists of base, the version after base. Raises Conflict if it is there."""
        new = {"version": base["version"] + 1, "schema": schema, "shards": shards, "sealed": base["sealed"]}
        temporary = self._path(f"{self.folder}/manifests/{uuid.uuid4().hex}.tmp")
        file = self._fs.create(temporary, False)
        file.write(json.dumps(new).encode())
        file.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        target = self._path(f"{self.folder}/manifests/{new['version']:012d}.json")
        try:
            options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self._conf).rename(self._fs.makeQualified(temporary), self._fs.makeQualified(target), options)
        except Exception as e:
            self._fs.delete(temporary, False)
            if self._fs.exists(target):
                raise Conflict(f"version {new['version']} is taken") from e
            raise
        return new

    def _write(self, rows: DataFrame, most_rows: int = 0) -> list[dict]:
        """Writes rows as files and describes those that hold any."""
        batch = f"data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", most_rows).parquet(f"{self.folder}/{batch}")
        files = [s for s in self._fs.listStatus(self._path(f"{self.folder}/{batch}")) if s.getPath().getName().endswith(".parquet")]
        sizes = {s.getPath().getName(): s.getLen() for s in files}
        if not sizes:
            return []
        back = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{batch}")
        counts = back.groupBy(back.metadataColumn("_metadata").getField("file_name").alias("f")).count().collect()
        return [{"path": f"{batch}/{r.f}", "bytes": sizes[r.f], "rows": r["count"]} for r in sorted(counts, key=lambda r: r.f)]

    def append(self, rows: DataFrame, most_rows: int = ARRIVAL_ROWS) -> dict:
        """Adds rows as small shards in one commit."""
        added = self._write(rows, most_rows)
        while True:
            base = self.head()
            try:
                return self.commit(base, base["schema"] or rows.schema.json(), base["shards"] + added)
            except Conflict:
                continue

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the highest if none is given."""
        found = self.manifest(version)
        if not found["schema"]:
            raise ValueError("nothing was appended yet")
        return self._open(found["shards"], found["schema"])

    def _open(self, shards: list[dict], schema: str) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.folder}/{s['path']}" for s in shards])

    def compact(self, target: int = TARGET_BYTES) -> dict:
        """Merges full tiers, round by round, seals finished shards, and returns the last head."""
        while True:
            base = self.head()
            runs = plan(base["shards"], target)
            if not runs:
                sealed = self._sealed(base, target)
                if sealed is base:
                    return base
                try:
                    return self.commit(sealed, base["schema"], sealed["shards"])
                except Conflict:
                    continue  # its list stays unnamed until vacuum
            run_of = {s["path"]: k for k, run in enumerate(runs) for s in run}
            merged = self._merge([s for run in runs for s in run], run_of, len(runs), base["schema"])
            while True:
                live = {s["path"] for s in base["shards"]}
                if not run_of.keys() <= live:
                    break  # another writer merged some of them; plan again
                try:
                    self.commit(base, base["schema"], [s for s in base["shards"] if s["path"] not in run_of] + merged)
                    break
                except Conflict:
                    base = self.head()

    def _merge(self, shards: list[dict], run_of: dict[str, int], runs: int, schema: str) -> list[dict]:
        """One file for each run. A run is bounded by the target size, so one task can write it."""
        rows = self._open(shards, schema)
        where = rows.metadataColumn("_metadata").getField("file_path")
        known = self.spark.createDataFrame([(p.removeprefix("data/"), k) for p, k in run_of.items()], "file string, run int")
        # rows travel as one column, so their names cannot clash; the plan has at most ROUND_SHARDS rows
        marked = rows.select(F.substring_index(where, "/", -2).alias("file"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
        dealt = marked.join(F.broadcast(known), "file").select("run", "row").repartitionById(runs, "run").select("row.*")
        return self._write(dealt)

    def vacuum(self) -> int:
        """Deletes what the highest version does not name; returns how many files went. Not beside running writers."""
        head = self.head()
        live = {s["path"] for s in self.manifest(head["version"])["shards"]}
        gone = 0
        for s in self._fs.listStatus(self._path(f"{self.folder}/manifests")):
            name = s.getPath().getName()
            if name.startswith("sealed-") and name not in head["sealed"]:
                gone += self._fs.delete(s.getPath(), True)
        for folder in self._fs.listStatus(self._path(f"{self.folder}/data")):
            for s in self._fs.listStatus(folder.getPath()):
                path = f"data/{folder.getPath().getName()}/{s.getPath().getName()}"
                if path not in live:
                    gone += self._fs.delete(s.getPath(), False)
        return gone


def tier(size: int, target: int) -> int:
    """The tier of a shard: 0 for the largest below the target, one more for each RATIO that it is smaller."""
    return max(0, math.ceil(math.log(target / max(size, 1)) / math.log(RATIO)) - 1)


def plan(shards: list[dict], target: int) -> list[list[dict]]:
    """Runs to merge: neighbours by size in a full tier, of about the target size, two shards at least."""
    tiers: dict[int, list[dict]] = {}
    for s in shards:
        if s["bytes"] < target * FINISHED:
            tiers.setdefault(tier(s["bytes"], target), []).append(s)
    runs: list[list[dict]] = []
    taken = 0
    for own in (tiers[k] for k in sorted(tiers, reverse=True)):
        if len(own) < LEAST_RUN:
            continue
        run: list[dict] = []
        size = 0
        for s in sorted(own, key=lambda s: (s["bytes"], s["path"])):
            if taken >= ROUND_SHARDS:
                break
            if run and size + s["bytes"] > target * 1.25:
                runs.append(run)
                run, size = [], 0
            run.append(s)
            size += s["bytes"]
            taken += 1
        runs.append(run)
    return [r for r in runs if len(r) > 1]


#: Arrivals of the query: how many small ones, each of one in so many rows; all others arrive at once.
ARRIVALS, SHARE = 5, 32


def arrive(store: Store, docs: DataFrame, most_rows: int = ARRIVAL_ROWS) -> None:
    """Appends docs (doc_id, ...) in small arrivals and a large one, each compacted: shards of an arrival merge, and what was
    merged merges again with its like."""
    place = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(SHARE))
    for k in range(ARRIVALS):
        store.append(docs.where(place == k), most_rows)
        store.compact()
    store.append(docs.where(place >= ARRIVALS), most_rows)
    store.compact()


def op5_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends the documents to a new store in arrivals of unlike size, compacts it after each, and reads the rows back
    through the manifest."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    arrive(store, documents(spark, sf_dir))
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"
