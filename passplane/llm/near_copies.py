"""Groups of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A text's bytes are lower-cased in A-Z and split at ASCII white space; every run of ``WORDS`` words (all words, if there are
fewer) is hashed with XXH64. Repeated shingles count once. Texts of equal shingle sets are one from the start, so many
copies of a text cost one row each; texts without words are all equal.

Candidates come from two sources. Fingerprints: SimHash of the shingles, repeats included, linked at 2 bits through the
vantage-point tree, which finds most very near copies and few of those at 0.8, whose fingerprints differ by about 10 of 64
bits, more than any triangle bound can prune. MinHash: ``BANDS`` bands of ``ROWS`` minima; two texts that agree in a band
are candidates. A pair at 0.8 is found with probability 1 - (1 - 0.8^6)^25 = 0.9995 and more similar ones more often.
Candidates only decide which texts are compared: their connected components are clusters, and inside a cluster every link
is decided by the exact similarity, found as a candidate or not.

A cluster of at most ``BLOCK_CHARS`` characters is one cell, compared in one task. A larger one is cut into blocks. First,
each block meets ``PIVOTS`` texts of its cluster, which join the blocks; texts that are not of the cluster's largest
component then meet every other block. The largest component needs no more comparing, so a group of copies of one text
costs in proportion to its size, whatever its share of all rows; only texts apart from it cost blocks times blocks. In a
cell, texts are compared with all others until only the largest component has texts that were not, which cannot change the
components. Cells give a representative for each text; these are joined by connected components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passplane.llm.base import by_size, finished, majority_bits, ranges, texts_of, written
from passplane.llm.graphs import components

#: Words of a shingle; bands and minima of a band; characters of a block on average; texts that join the blocks of a cluster.
WORDS, BANDS, ROWS, BLOCK_CHARS, PIVOTS = 5, 25, 6, 4_000_000, 8

_RNG = np.random.default_rng(17)
_XOR = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def hashes_of(text: str) -> np.ndarray:
    """The hashes of the shingles of a text, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words)]
    k = min(WORDS, len(words))
    if not words:
        return np.zeros(0, np.uint64)
    pairs = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.array([xxh64_intdigest(line[s:e]) for s, e in pairs], np.uint64)


def shingles_of(text: str) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text."""
    return np.unique(hashes_of(text))


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, BANDS): the key of each band; 0 for empty sets."""
    counts = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), BANDS), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    flat = np.concatenate([sets[k] for k in full.tolist()])
    starts = np.cumsum(counts[full]) - counts[full]
    for band in range(BANDS):
        key = np.full(len(full), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            low = np.minimum.reduceat((flat ^ _XOR[k]) * _TIMES[k], starts)
            key = (key ^ low) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        out[full, band] = key
    return out


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, same, fp, bands, n_chars): same is a 128-bit digest of the shingle set, fp the SimHash of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in by_size(texts, 500_000):
                every = [hashes_of(t) for t in texts[a:b]]
                fp = majority_bits(np.concatenate(every), np.array([len(h) for h in every]))
                sets = [np.unique(h) for h in every]
                keys = bands_of(sets).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                same = pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), same, pa.array(fp.view(np.int64)), lists, pa.array([len(t) for t in texts[a:b]], pa.int64())], ["doc_id", "same", "fp", "bands", "n_chars"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, same binary, fp long, bands array<long>, n_chars long")


def link(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest position in the component of each set."""
    n = len(sets)
    labels, waiting = np.arange(n), np.ones(n, bool)
    counts = np.array([len(s) for s in sets])
    ends = np.cumsum(counts)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    # the sets that hold each shingle, one shingle after the other
    holders = np.repeat(np.arange(n), counts)[np.argsort(flat, kind="stable")]
    held = np.bincount(flat)
    first = np.cumsum(held) - held
    while True:
        left = np.flatnonzero(waiting & (labels != np.bincount(labels, minlength=n).argmax()))
        if not len(left):
            return labels
        at = int(left[0])
        waiting[at] = False
        own = flat[ends[at] - counts[at] : ends[at]]
        shared = np.bincount(holders[ranges(first[own], held[own])], minlength=n)
        near = (shared > 0) & (9 * shared >= 4 * (counts + counts[at]))
        near[at] = True
        joined = np.isin(labels, labels[near])
        labels[joined] = labels[joined].min()


def linked(cells: DataFrame) -> DataFrame:
    """(a, b): each text that has a link in its cell and its representative there. cells: cell, doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []

        def done() -> pa.RecordBatch:
            own = np.array(ids, np.int64)
            root = own[link(sets)]
            other = root != own
            return pa.RecordBatch.from_arrays([pa.array(own[other]), pa.array(root[other])], ["a", "b"])

        for batch in batches:
            for cell, doc_id, text in zip(batch.column("cell").to_pylist(), batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                if cell != now and ids:
                    yield done()
                    ids, sets = [], []
                now = cell
                ids.append(doc_id)
                sets.append(shingles_of(text))
        if ids:
            yield done()

    return cells.repartition("cell").sortWithinPartitions("cell", "doc_id").mapInArrow(run, "a long, b long")


def clusters(firsts: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root, n_chars, blocks, block) of the texts that have candidates."""
    keys = firsts.select("doc_id", F.explode("bands").alias("band"))
    keys = keys.join(keys.groupBy("band").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"), "band")
    edges = keys.where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).union(links_of(firsts.select("doc_id", "fp")))
    found = components(edges).join(firsts.select(F.col("doc_id").alias("node"), "n_chars"), "node")
    sizes = found.groupBy("root").agg(F.greatest(F.ceil(F.sum("n_chars") / F.lit(BLOCK_CHARS)).cast("int"), F.lit(1)).alias("blocks"))
    return found.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")).cast("int"))


def cells_of(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """(cell, doc_id, text) of placed (node, root, part, block): a cell is a root, a part and a block."""
    cell = F.concat_ws("/", "root", "part", "block")
    return placed.select(cell.alias("cell"), F.col("node").alias("doc_id")).distinct().join(texts, "doc_id").select("cell", "doc_id", "text")


def first_of_each(docs: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id of the first text of each group of docs (doc_id without nulls or repeats, text).

    links_of: from (doc_id, fp) to candidates (a, b) by fingerprint.
    """
    texts, spark = docs.select(F.col("doc_id").cast("long"), "text"), docs.sparkSession
    own = F.struct("doc_id", "fp", "bands", "n_chars")
    firsts = written(marked(texts).groupBy("same").agg(F.min(own).alias("x")).select("x.*"), "shingled")
    cluster = finished(lambda: clusters(firsts, links_of), "clusters", spark)
    large = cluster.where("blocks > 1")
    order = Window.partitionBy("root").orderBy(F.xxhash64("node", F.lit(10)), "node")
    pivots = large.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIVOTS)
    everywhere = pivots.select("node", "root", F.lit(0).alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    placed = cluster.select("node", "root", F.lit(0).alias("part"), "block").unionByName(everywhere)
    links = finished(lambda: linked(cells_of(placed, texts)), "links", spark)
    if not large.isEmpty():
        links = links.union(finished(lambda: linked(cells_of(apart(large, links), texts)), "links", spark))
    joined = finished(lambda: components(links), "copies", spark)
    return firsts.select("doc_id").join(joined.where("node <> root").select(F.col("node").alias("doc_id")), "doc_id", "left_anti")


def apart(large: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root, part, block): where the texts of large clusters that are not of their largest component, given links, meet
    the others. A part is a block of such texts; it meets every block of its cluster."""
    label = components(links).withColumnRenamed("root", "label")
    named = written(large.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    sizes = named.groupBy("root", "label").agg(F.count("*").alias("n"))
    most = sizes.groupBy("root").agg(F.min(F.struct((-F.col("n")).alias("by"), "label")).alias("x")).select("root", F.col("x.label").alias("most"))
    left = written(named.join(most, "root").where("label <> most"), "apart")
    parts = left.groupBy("root").agg(F.greatest(F.ceil(F.sum("n_chars") / F.lit(BLOCK_CHARS)).cast("int"), F.lit(1)).alias("parts"))
    part = (F.pmod(F.xxhash64("node", F.lit(11)), F.col("parts")) + 1).cast("int")
    meet = left.join(parts, "root").select("node", "root", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    others = large.join(parts, "root").select("node", "root", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("part"), "block")
    return meet.unionByName(others)
