"""SimHash fingerprints and exact near-duplicate groups through a vantage-point tree of shards.

A text's bytes are lower-cased in A-Z and split at the six ASCII white space characters; every run of three words, joined
by single spaces (all words, if there are fewer), is hashed with XXH64, seed 42. A fingerprint bit is set where over half
of the hashes, repeats included, have it. Null texts and texts without words have fingerprint 0 and link like any other.

Distinct fingerprints are dealt to shards by a vantage-point tree. A node has a vantage point p and a radius m; x goes to
the outer branch if d(x, p) > m and to the inner one if d(x, p) <= m + r, r being the distance that links. By the triangle
inequality two fingerprints at most r apart differ by at most r in their distance to p, so either both are within m + r
(and meet inside) or both are beyond m (and meet outside): every linked pair meets in a leaf. Vantage points and radii come
from a bounded sample, which decides only how even the shards are. A level copies about a sixth of random fingerprints, so
there are as many shards as the cluster has use for, of up to ``MOST`` fingerprints, and no more: 10^9 fingerprints in
shards of 10^6 have some 9 copies each. A leaf that distances cannot split is cut into r + 2 blocks of bits instead: two
fingerprints at most r apart agree in two of them, so they meet in a shard of their own by two blocks' values. A shard is searched by the same tree in memory down to
small blocks that are compared pair by pair. Where distances cannot split a dense block, each fingerprint's whole Hamming
ball is probed in the sorted block, so no block costs the square of its size. A shard gives a representative for each
fingerprint, never pairs; shards are then merged by connected components of representatives.

Ties: the component is the smallest doc_id reachable. Rows with a null doc_id are linked but never represent unless no
member has an id (component null). Rows that repeat an id are separate members. Empty tables give no rows. Other columns
are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passplane.llm.base import by_size, documents, majority_bits, texts_of, written
from passplane.llm.graphs import components
from passplane.llm.near_copies import first_of_each

#: Fingerprints in a shard, on average, at least and at most; those that the tree is built from at most; those compared
#: pair by pair; pairs that are merged at once.
LEAST, MOST, SAMPLE, BLOCK, PAIRS = 20_000, 1_000_000, 40_000, 1024, 1_000_000


def fingerprints_of(texts: list[str], words_per_shingle: int = 3) -> np.ndarray:
    """The fingerprint of each text, as uint64."""
    from xxhash import xxh64_intdigest

    out = []
    for a, b in by_size(texts, 500_000):
        hashes, counts = [], []
        for text in texts[a:b]:
            words = text.encode("utf-8", "replace").lower().split()
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])[: len(words)]
            k = min(words_per_shingle, len(words))
            counts.append(len(words) - k + 1 if words else 0)
            if words:
                hashes += [xxh64_intdigest(line[s:e], 42) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
        out.append(majority_bits(np.array(hashes, np.uint64), np.array(counts)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long of the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints_of(texts_of(batch.column("text"))).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def distances(x: np.ndarray, p: int) -> np.ndarray:
    """Hamming distances of fingerprints to one."""
    return np.bitwise_count(x ^ np.uint64(p)).astype(np.int16)


def split_point(x: np.ndarray, reach: int, rng: np.random.Generator) -> tuple[int, int, float]:
    """The vantage point and radius, of a few tried, with the smallest larger branch; and that branch's share of x."""
    best = (0, 0, 2.0)
    for p in rng.choice(x, min(6, len(x)), replace=False).tolist():
        below = np.cumsum(np.bincount(distances(x, p), minlength=65 + reach)) / len(x)
        for m in range(64):
            share = max(below[m + reach], 1 - below[m])
            if share < best[2]:
                best = (p, m, share)
    return best


@dataclass
class Tree:
    """nodes: (vantage point, radius, inner, outer); a negative child -1 - k is leaf k. dense: leaves that do not split."""

    nodes: list[tuple[int, int, int, int]]
    dense: set[int]
    reach: int

    def leaves_of(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, positions) of the fingerprints that reach each leaf."""
        todo = [(0 if self.nodes else -1, np.arange(len(x)))]
        while todo:
            at, own = todo.pop()
            if not len(own):
                continue
            if at < 0:
                yield -1 - at, own
                continue
            p, m, inner, outer = self.nodes[at]
            d = distances(x[own], p)
            todo += [(inner, own[d <= m + self.reach]), (outer, own[d > m])]

    def shards_of(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(shards, positions): a leaf is a shard; a dense one has a shard for each pair of blocks and their values."""
        for leaf, own in self.leaves_of(x):
            if leaf not in self.dense:
                yield np.full(len(own), leaf, np.int64), own
                continue
            cuts = np.linspace(0, 64, self.reach + 3).astype(int)
            blocks = [(((1 << int(b)) - 1) ^ ((1 << int(a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
            for k, (i, j) in enumerate(itertools.combinations(range(len(blocks)), 2)):
                kept = x[own] & np.uint64(blocks[i] | blocks[j])
                mixed = (kept ^ np.uint64((leaf * 1009 + k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
                mixed ^= mixed >> np.uint64(29)
                # beyond the leaves' numbers; equal numbers of unlike shards only compare more
                yield (mixed | np.uint64(1 << 62)).astype(np.uint64).view(np.int64) & np.int64((1 << 63) - 1), own


def build_tree(sample: np.ndarray, leaf_share: float, reach: int) -> Tree:
    """The tree of a sample. leaf_share: of the sample in a leaf."""
    rng = np.random.default_rng(11)
    nodes: list = []
    dense: set[int] = set()
    leaves = 0

    def grow(x: np.ndarray) -> int:
        nonlocal leaves
        if len(x) > max(8, leaf_share * len(sample)):
            p, m, share = split_point(x, reach, rng)
            if share < 0.9:
                at = len(nodes)
                nodes.append(None)
                d = distances(x, p)
                nodes[at] = (p, m, grow(x[d <= m + reach]), grow(x[d > m]))
                return at
            if len(x) > 4 * max(8, leaf_share * len(sample)):
                dense.add(leaves)
        leaves += 1
        return -leaves

    grow(sample)
    return Tree(nodes, dense, reach)


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the smallest position of the component) after linking positions i and j."""
    i, j = labels[i], labels[j]
    while True:
        low = np.minimum(labels[i], labels[j])
        before = labels.copy()
        np.minimum.at(labels, i, low)
        np.minimum.at(labels, j, low)
        while not np.array_equal(up := labels[labels], labels):
            labels = up
        if np.array_equal(labels, before):
            return labels


def link(x: np.ndarray, reach: int) -> np.ndarray:
    """For sorted distinct fingerprints, the smallest position in the component of each."""
    labels = np.arange(len(x))
    rng = np.random.default_rng(5)
    todo = [np.arange(len(x))]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def merged() -> np.ndarray:
        i, j = (np.concatenate(side) for side in zip(*found, strict=True)) if found else (labels[:0], labels[:0])
        return merge(labels, i, j) if len(i) else labels

    while todo:
        own = todo.pop()
        if len(own) > BLOCK:
            p, m, share = split_point(rng.choice(x[own], min(len(own), 2000), replace=False), reach, rng)
            if share < 0.8:
                d = distances(x[own], p)
                todo += [own[d <= m + reach], own[d > m]]
                continue
            if len(own) > 8 * BLOCK:
                labels = probe(x, own, reach, labels)
                continue
        for a in range(0, len(own), 256):
            i, j = np.nonzero(np.bitwise_count(x[own[a : a + 256], None] ^ x[own[a:]][None, :]) <= reach)
            apart = i < j
            if apart.any():
                found.append((own[a + i[apart]], own[a + j[apart]]))
                held += int(apart.sum())
            if held > PAIRS:
                labels, found, held = merged(), [], 0
    return merged()


def probe(x: np.ndarray, own: np.ndarray, reach: int, labels: np.ndarray) -> np.ndarray:
    """Links the positions own of x by looking up every fingerprint within reach of each of them."""
    own = np.sort(own)
    block = x[own]
    masks = [0]
    for _ in range(reach):
        masks = sorted({m | (1 << b) for m in masks for b in range(64)} | set(masks))
    for mask in masks[1:]:
        wanted = block ^ np.uint64(mask)
        at = np.minimum(np.searchsorted(block, wanted), len(block) - 1)
        hit = (block[at] == wanted) & (wanted > block)
        if hit.any():
            labels = merge(labels, own[hit], own[at[hit]])
    return labels


def representatives(distinct: DataFrame, reach: int, tree: Tree) -> DataFrame:
    """(fp, root): for each shard in which a fingerprint has a link, the shard's smallest fingerprint linked with it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("fp")).view(np.uint64)
            for shards, own in tree.shards_of(x):
                yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(x[own].view(np.int64))], ["leaf", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        leaf = None

        def done() -> Iterator[pa.RecordBatch]:
            x = np.unique(np.concatenate(held).view(np.uint64))
            labels = link(x, reach)
            linked = np.bincount(labels, minlength=len(x))[labels] > 1
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[linked].view(np.int64)), pa.array(x[labels[linked]].view(np.int64))], ["fp", "root"])

        for batch in batches:
            leaves, fps = np.asarray(batch.column("leaf")), np.asarray(batch.column("fp"))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(leaves)) + 1, [len(leaves)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                if leaf != leaves[a] and held:
                    yield from done()
                    held = []
                leaf = leaves[a]
                held.append(fps[a:b].copy())
        if held:
            yield from done()

    dealt = distinct.select("fp").mapInArrow(deal, "leaf long, fp long")
    return dealt.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(search, "fp long, root long")


def tree_of(distinct: DataFrame, n: int, reach: int) -> Tree:
    """The tree for n distinct fingerprints (fp), from a bounded sample of them."""
    per_shard = max(LEAST, min(MOST, n // (4 * distinct.sparkSession.sparkContext.defaultParallelism)))
    sample = np.zeros(0, np.uint64)
    if n > per_shard:
        # a fingerprint is in the sample by its hash, so the sample is the same in any order of the rows
        chosen = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(n)) < SAMPLE // 2).select("fp").limit(SAMPLE)
        sample = chosen.toPandas().fp.to_numpy().view(np.uint64)
    return build_tree(np.sort(sample), per_shard / max(n, 1), reach)


def candidate_links(docs: DataFrame, reach: int = 2) -> DataFrame:
    """(a, b): doc_ids of docs (doc_id, fp) whose fingerprints are linked, each with its shard's representative."""
    distinct = written(docs.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    links = representatives(distinct, reach, tree_of(distinct, distinct.count(), reach)).where("fp <> root")
    root = distinct.select(F.col("fp").alias("root"), F.col("first_doc").alias("b"))
    apart = links.join(distinct, "fp").join(root, "root").select(F.col("first_doc").alias("a"), "b")
    return docs.join(distinct, "fp").where("doc_id <> first_doc").select(F.col("doc_id").alias("a"), F.col("first_doc").alias("b")).union(apart)


def near_duplicates(docs: DataFrame, reach: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of each row of doc_id, text: the smallest doc_id reachable over links of at most reach bits."""
    rows = written(fingerprints(docs), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")), "distinct")
    n, total = distinct.agg(F.count("*"), F.sum("n")).first()
    links = written(representatives(distinct, reach, tree_of(distinct, n, reach)), "representatives")
    least = links.groupBy("fp").agg(F.min("root").alias("least"))
    joined = components(links.join(least, "fp").where("root <> least").select(F.col("root").alias("a"), F.col("least").alias("b")))
    member = least.join(joined, F.col("least") == F.col("node"), "left").select("fp", F.coalesce("root", "least").alias("group"))
    member = written(member.join(distinct, "fp").select("fp", "group", "first_doc"), "members")
    smallest = member.groupBy("group").agg(F.min("first_doc").alias("component_id"))
    labels = written(distinct.join(member.join(smallest, "group").select("fp", "component_id"), "fp", "left").select("fp", "n", F.coalesce("component_id", "first_doc").alias("component_id")), "labels")
    # a fingerprint that many rows share (at most 1,000 can have a thousandth of them) is joined without a shuffle
    is_hot = F.col("n") * 1000 >= F.lit(total or 0)
    hot = F.broadcast(labels.where(is_hot).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot")))
    split = rows.join(hot, "fp", "left")
    rest = split.where("hot is null").select("doc_id", "fp").join(labels.where(~is_hot).select("fp", "component_id"), "fp")
    return split.where("hot").select("doc_id", "fp", F.col("hot_id").alias("component_id")).unionByName(rest)


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies of docs (doc_id, text, any others): that with the smallest doc_id.

    Near copies share five-word shingles at a Jaccard similarity of 0.8 or more, decided exactly (see ``near_copies``). The
    candidates are the links of the vantage-point tree over fingerprints of five-word shingles, and MinHash bands for those
    beyond its reach.
    If ids are null or repeat, rows are numbered for this by (id, hash of the text), nulls last, and the first stays.
    """
    rows, known = docs.agg(F.count("*"), F.count("doc_id")).first()
    if known < rows or docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
        packed = ordered.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("doc_id"))
        packed = written(packed, "numbered")
        return packed.join(first_of_each(packed.select("doc_id", F.col("row.text").alias("text")), candidate_links), "doc_id", "left_semi").select("row.*")
    return docs.join(first_of_each(docs, candidate_links), "doc_id", "left_semi")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
