"""Token ids as flat unsigned integer files with 64-bit document offsets, read through memory maps.

Layout of a data set (a folder that driver and executors share):

* ``<part>.bin``: the ids of consecutive documents, little-endian uint16 (uint32 for vocabularies over 65,536), no header;
* ``<part>.idx``: little-endian int64: number of documents n, n + 1 offsets into the ids, n document ids, n flags (1: the
  document has an id, 0: its id is null);
* ``manifest.json``: the parts in order, each with its documents, tokens and *base*, the tokens of all parts before it.

Documents are dealt to parts by ranges of (doc_id, hash of the text) and sorted inside a part, so the parts in order hold
ascending ids, and many rows of one id, or without one, are spread over parts. Null ids come first; rows of one id are
ordered by the hash of the text. Rows that are equal in both are in any order, and spread over parts too if they are many. A part is written under a name of its own attempt and only
the names that successful tasks return enter the manifest, so a lost or repeated task leaves no trace. Bases are prefix
sums over the parts' counts: one number a part reaches the driver.

Null and empty texts have just the end id. An empty table gives a data set without parts. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passplane.llm.base import shared_folder, texts_of
from passplane.llm.tokens import encoder

#: Tokens are dealt to parts of about so many documents.
DOCUMENTS_PER_PART = 4000


def local_path(folder: str) -> str:
    """The mounted path of a shared folder. Memory maps need one; another kind of store is refused."""
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {folder}")
    return folder.removeprefix("file://")


@dataclass
class Cuts:
    """Where the order of rows by (id, hash of the text, spread) is cut into parts. loose: whether a part may begin between ids."""

    ids: np.ndarray
    hashes: np.ndarray
    spreads: np.ndarray
    loose: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def part(self, ids: np.ndarray, hashes: np.ndarray, spreads: np.ndarray) -> np.ndarray:
        """The part of each row: how many cuts are not after it."""
        return _not_after([self.ids, self.hashes, self.spreads], [ids, hashes, spreads])

    def only(self, keep: np.ndarray) -> Cuts:
        """Some of the cuts."""
        return Cuts(self.ids[keep], self.hashes[keep], self.spreads[keep], self.loose[keep])


def _not_after(cuts: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """For each row the number of cuts that are not after it, both compared column by column; cuts are in order."""
    end = np.searchsorted(cuts[0], rows[0], side="right")
    if len(cuts) == 1:
        return end
    part = np.searchsorted(cuts[0], rows[0], side="left")
    equal = np.flatnonzero(end > part)
    for v in np.unique(rows[0][equal]):
        own = equal[rows[0][equal] == v]
        a, b = part[own[0]], end[own[0]]
        part[own] = a + _not_after([c[a:b] for c in cuts[1:]], [r[own] for r in rows[1:]])
    return part


LEAST_LONG = np.iinfo(np.int64).min


def _inside(rows: DataFrame, keys: list[str], of: str, rows_per_part: int) -> dict[tuple, list[int]]:
    """For each group of more than two parts' rows, values of a long column at which it is cut into parts. They are the group's own values, none the least, so no part is
    empty. About two counts a part reach the driver."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 2 * rows_per_part).select(*[F.col(k).alias(f"own_{k}") for k in keys], "n")
    # at most one group for every two parts
    same = [F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in keys]
    cell = F.floor((F.col(of) / 2.0**64 + 0.5) * F.ceil(F.col("n") / rows_per_part) * 2).alias("cell")
    cells = rows.join(F.broadcast(sizes), same).groupBy(*keys, cell).agg(F.min(of).alias("first"), F.count("*").alias("rows")).collect()
    out: dict[tuple, list[int]] = {}
    held: dict[tuple, int] = {}
    for r in sorted(cells, key=lambda r: r["cell"]):
        group = tuple(r[k] for k in keys)
        cuts = out.setdefault(group, [])
        if held.get(group, 0) >= rows_per_part:
            cuts.append(r["first"])
            held[group] = 0
        held[group] = held.get(group, 0) + r["rows"]
    return out


def cuts_of(docs: DataFrame, rows_per_part: int) -> Cuts:
    """Cuts docs (doc_id, text) into parts of about rows_per_part rows, each of which has a row. An id that holds more than two parts' rows, or the null id (it counts as the
    least), is cut by the hash of the text; rows of it that are equal in text too, by the spread. At most one id, or text of an id, for every two parts can be."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    parts = -(-n // rows_per_part)
    found: set[tuple[int, int, int]] = set()
    loose: set[tuple[int, int, int]] = set()
    if parts > 1:
        at = [k / parts for k in range(1, parts)]
        found = {(v, LEAST_LONG, LEAST_LONG) for v in ids.select(F.percentile_approx("doc_id", at, max(10_000, 20 * parts))).first()[0] or []}
        hot = [r.doc_id for r in ids.groupBy("doc_id").count().where(F.col("count") > 2 * rows_per_part).collect()]
        known = [d for d in hot if d is not None]
        found |= {(v, LEAST_LONG, LEAST_LONG) for v in known}
        if hot:
            # each ends where the next id begins
            following = ids.agg(*[F.min(F.when(F.col("doc_id") > v, F.col("doc_id")) if v is not None else F.col("doc_id")).alias(f"_{k}") for k, v in enumerate(hot)]).first()
            found |= {(v, LEAST_LONG, LEAST_LONG) for v in following if v is not None}
            # texts are read for this only where an id is hot
            own = hashed(docs).where(F.col("doc_id").isin(known) | (F.col("doc_id").isNull() & F.lit(len(known) < len(hot))))
            name = lambda d: LEAST_LONG if d is None else d
            for (doc_id,), hashes in _inside(own, ["doc_id"], "hash", rows_per_part).items():
                loose |= {(name(doc_id), h, LEAST_LONG) for h in hashes}
            for (doc_id, h), spreads in _inside(own, ["doc_id", "hash"], "spread", rows_per_part).items():
                loose |= {(name(doc_id), h, x) for x in spreads}
            found |= loose
    order = sorted(found)
    columns = [np.array([c[k] for c in order], np.int64) for k in range(3)]
    return Cuts(*columns, np.array([c in loose for c in order], bool))


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, hash, spread) of doc_id, text; null text is empty. spread parts equal rows: a hash of the row's place in the table, the same whenever it is read."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("hash"), F.xxhash64(F.monotonically_increasing_id()).alias("spread"))


def encoded(docs: DataFrame, tokenizer: str, end_id: int, cuts: Cuts) -> DataFrame:
    """(part, doc_id, hash, ids): the ids of each text and the end id, as bytes of the file's integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer)
        width = np.dtype("<u2") if max(tok.library.get_vocab_size(), end_id + 1) <= 65_536 else np.dtype("<u4")
        for batch in batches:
            ids = [np.append(x, end_id).astype(width).tobytes() for x in tok.encode(texts_of(batch.column("text")))]
            doc = batch.column("doc_id")
            part = cuts.part(np.asarray(doc.fill_null(LEAST_LONG)), np.asarray(batch.column("hash")), np.asarray(batch.column("spread")))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), doc, batch.column("hash"), pa.array(ids, pa.binary()), pa.array([width.itemsize] * len(ids), pa.int32())], ["part", "doc_id", "hash", "ids", "width"])

    return hashed(docs).mapInArrow(run, "part int, doc_id long, hash long, ids binary, width int")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, rows_per_part: int = DOCUMENTS_PER_PART) -> dict:
    """Writes the data set to a shared folder and returns its manifest. docs: doc_id, text."""
    root = local_path(folder)
    docs = docs.select("doc_id", "text")
    cuts = cuts_of(docs, rows_per_part)
    os.makedirs(root, exist_ok=True)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes one part as its sorted rows stream by; only offsets and ids of documents are held."""
        number = TaskContext.get().partitionId()
        name = f"part-{number:06d}-{uuid.uuid4().hex[:12]}"
        sizes, docs_here, flags, width, file = [], [], [], 2, None
        for batch in batches:
            if batch.num_rows and file is None:
                file, width = open(f"{root}/{name}.bin", "wb"), batch.column("width")[0].as_py()  # noqa: SIM115
            for blob in batch.column("ids").to_pylist():
                file.write(blob)
                sizes.append(len(blob) // width)
            doc = batch.column("doc_id")
            flags.append(np.asarray(doc.is_valid()).astype("<i8"))
            docs_here.append(np.asarray(doc.fill_null(0)))
        if file is None:
            return
        file.close()
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        np.concatenate([[len(sizes)], offsets, *docs_here, *flags]).astype("<i8").tofile(f"{root}/{name}.idx")
        yield pa.RecordBatch.from_pydict({"part": [number], "name": [name], "documents": [len(sizes)], "tokens": [int(offsets[-1])], "width": [width]})

    rows = encoded(docs, tokenizer, end_id, cuts).repartitionById(len(cuts) + 1, "part")
    parts = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "hash", "ids").mapInArrow(save, "part long, name string, documents long, tokens long, width long").collect()
    manifest: dict = {"parts": [], "tokens": 0}
    for p in sorted(parts, key=lambda p: p.part):
        manifest["parts"].append({"name": p.name, "documents": p.documents, "tokens": p.tokens, "width": p.width, "base": manifest["tokens"]})
        manifest["tokens"] += p.tokens
    with open(f"{root}/manifest.tmp", "w") as out:
        json.dump(manifest, out)
    os.replace(f"{root}/manifest.tmp", f"{root}/manifest.json")
    return manifest


def open_part(root: str, part: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Memory maps of a part: its ids, offsets, document ids and flags."""
    n = part["documents"]
    index = np.memmap(f"{root}/{part['name']}.idx", "<i8", "r")
    return np.memmap(f"{root}/{part['name']}.bin", f"<u{part['width']}", "r"), index[1 : n + 2], index[n + 2 : 2 * n + 2], index[2 * n + 2 :]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. One task maps one part."""
    root = local_path(folder)
    with open(f"{root}/manifest.json") as f:
        parts = json.load(f)["parts"]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in batch.column("line").to_pylist():
                part = json.loads(line)
                ids, offsets, doc, flags = open_part(root, part)
                cuts = offsets.tolist()
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(cuts, cuts[1:], strict=False)]
                doc_id = pa.array(np.array(doc), pa.int64(), mask=flags == 0)
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(part["base"] + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    lines = spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(parts)], "part int, line string").repartitionById(max(1, len(parts)), "part")
    return lines.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of every document and reads them back from the files."""
    import public_tokenizers

    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, folder)
