"""Tables with one row a key, kept as Parquet in buckets of keys, and upserts that rewrite only the buckets they touch.

A table is a folder: ``data/<write>/_bucket=<n>`` with Parquet files that are never changed, and ``versions/<number>.json``, which says of each bucket in which
write's folder it is. An upsert reads the buckets of its keys, keeps of each key the row with the highest version, writes these buckets to a new
folder, and then creates the next version's file, which names the new folders for them and the old ones for all others. A reader takes the last
version that is whole, so it sees all of an upsert or nothing; readers of a version before still find their files, until `vacuum`. Of two upserts at
once that read one version, the second finds that its version's file exists and is refused: it reads again and repeats. Files and versions go through
Hadoop's file systems, so any store that creates a file only if it is not there will do.

Keys may be null; they are equal then. Rows of a key in one upsert, or with the version that is there, are reduced to the highest, then the highest by the other
columns. A hot key is pre-aggregated to one row a task.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passplane.operators.sessions import upsert as newest


class Conflict(RuntimeError):
    """Another writer made the next version first."""


class KeyedTable:
    """A table of one row a key in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, folder: str, schema: StructType, keys: list[str], version: str, buckets: int = 64) -> KeyedTable:
        """A new table; an existing one is refused. buckets: as many as files of a good size that the table will have."""
        table = cls(spark, folder)
        table._commit(0, {"keys": keys, "version": version, "buckets": buckets, "schema": schema.json(), "places": {}})
        return table

    def state(self) -> tuple[int, dict]:
        """The number and content of the last whole version."""
        names = sorted((str(f.getPath().getName()) for f in self._files.listStatus(self._path(f"{self.folder}/versions"))), reverse=True)
        for name in names:
            try:
                return int(name.split(".")[0]), json.loads(self._text(f"{self.folder}/versions/{name}"))
            except json.JSONDecodeError:  # still being written, or left by a writer that was lost
                continue
        raise FileNotFoundError(f"no version in {self.folder}")

    def _text(self, path: str) -> str:
        stream = self._files.open(self._path(path))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commit(self, number: int, content: dict) -> None:
        path = self._path(f"{self.folder}/versions/{number:012d}.json")
        if self._files.exists(path):
            raise Conflict(f"version {number} of {self.folder} exists")
        stream = self._files.create(path, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()

    def _bucket(self, content: dict) -> Column:
        return F.pmod(F.xxhash64(*content["keys"]), F.lit(content["buckets"])).cast("int")

    def _of(self, content: dict, buckets: list[int] | None = None) -> DataFrame:
        """The rows of some buckets, or all."""
        schema = StructType.fromJson(json.loads(content["schema"]))
        paths = [f"{self.folder}/data/{place}/_bucket={b}" for b, place in content["places"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of the last version, or of an older one that was not vacuumed."""
        content = self.state()[1] if number is None else json.loads(self._text(f"{self.folder}/versions/{number:012d}.json"))
        return self._of(content)

    def upsert(self, rows: DataFrame) -> dict[str, int]:
        """Adds rows and replaces those of lower versions; gives the new version's number and how many buckets were written anew."""
        number, content = self.state()
        schema = StructType.fromJson(json.loads(content["schema"]))
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
        touched = sorted(r[0] for r in rows.select(self._bucket(content)).distinct().collect())  # at most one a bucket
        if not touched:
            return {"version": number, "buckets": 0}
        merged = newest(self._of(content, touched), rows, content["keys"], content["version"]).select(*schema.fieldNames())
        place = uuid.uuid4().hex
        merged.withColumn("_bucket", self._bucket(content)).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/data/{place}")
        self._commit(number + 1, content | {"places": content["places"] | {str(b): place for b in touched}})
        return {"version": number + 1, "buckets": len(touched)}

    def vacuum(self, keep: int = 1) -> int:
        """Deletes versions but the last `keep`, and the buckets that only they name; gives how many folders went. Not while upserts run."""
        last, _ = self.state()
        kept, old = [max(0, last - keep + 1), last + 1], []
        contents = {n: json.loads(self._text(f"{self.folder}/versions/{n:012d}.json")) for n in range(last + 1) if self._files.exists(self._path(f"{self.folder}/versions/{n:012d}.json"))}
        used = {(p, b) for n in range(*kept) if n in contents for b, p in contents[n]["places"].items()}
        for n in sorted(contents):
            if n < kept[0]:
                old += [(p, b) for b, p in contents[n]["places"].items() if (p, b) not in used]
                self._files.delete(self._path(f"{self.folder}/versions/{n:012d}.json"), False)
        for place, bucket in set(old):
            self._files.delete(self._path(f"{self.folder}/data/{place}/_bucket={bucket}"), True)
        return len(set(old))
