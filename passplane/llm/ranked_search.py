"""Ranked lexical search: the best documents of each item, by weighted term counts, with presence masks.

A text's terms are its runs of letters and digits of ASCII and of all other characters, with A-Z lower-cased. The first pass over the
documents keeps, of each, its number of terms and the counts of those terms that some item has; statistics (N, L, df) are
sums over these rows. The second pass takes them in blocks of ``DOCUMENTS``. In a block every term has a bitmap of the
documents that hold it. For an item, the bitmaps of its terms give each document a mask of the terms that it matches;
documents of equal masks are a group, and a group's maximum score is the sum, over its terms, of the largest value that the
term has in the block. Groups are scored in descending order of that maximum until it is below the item's last kept score, which
a task carries from block to block. A task gives at most k rows an item, whatever it reads, and these are cut to k by
(item, salt), then by item. No row joins an item to a document that is not among a task's best.

Items go in blocks of about ``ITEM_CHARS`` characters of text, each with its own pass over the documents: only their distinct
terms are sent to tasks, so neither their number nor that of the documents is bounded.

Null and empty texts have no terms and are no documents. Items without terms, or whose terms no document has, give no rows;
rows that repeat an item_id, and items without one, are items of their own. Of equal scores the smaller doc_id comes first and rows without one last;
rows that repeat a doc_id are documents of their own. An empty table of either kind gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passplane.llm.base import by_size, documents, ranges, written

#: Documents and kept term counts of a block; characters of a block of items; groups of documents before the last cut.
DOCUMENTS, COUNTS, ITEM_CHARS, SALTS = 8192, 4_000_000, 400_000, 64

_KEPT = [c for c in range(256) if chr(c).isascii() and chr(c).isalnum() or c >= 0x80]
#: UTF-8 bytes: letters lower-cased, everything that is in no term a space.
_TERMS = bytes(ord(chr(c).lower()) if c < 0x80 else c for c in range(256)).translate(bytes(c if c in _KEPT else 32 for c in range(256)))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text."""
    return text.translate(_TERMS).split()


def counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) of docs (doc_id, text) with terms: how many they have, and the places in the vocabulary and
    the counts of those that are in it."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: k for k, w in enumerate(shared.value)}
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for a, b in by_size(texts):
                words = [terms_of(t) for t in texts[a:b]]
                n = np.array([len(w) for w in words])
                found = np.fromiter((k for w in words for k in map(place.get, w, repeat(-1))), np.int64, int(n.sum()))
                key = (np.repeat(np.arange(b - a), n) * (len(place) + 1) + found)[found >= 0]
                key, tf = np.unique(key, return_counts=True)
                doc, term = np.divmod(key, len(place) + 1)
                cuts = pa.array(np.searchsorted(doc, np.arange(b - a + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])

    texts = docs.where("text is not null").select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>").where("n > 0")


@dataclass
class Statistics:
    """documents: with terms; terms: of all of them, with repeats; weight: of each term of the vocabulary."""

    documents: int
    terms: int
    weight: np.ndarray

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """m of documents with n terms each; Python's integers, for n times all documents may pass 64 bits."""
        return np.array([25 + 75 * x * self.documents // self.terms for x in n.tolist()], np.int64)


def statistics(rows: DataFrame, size: int) -> Statistics:
    """Of the rows of `counted`; at most one number a term of the vocabulary reaches the driver."""
    documents, terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(size, np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        held[r.term] = r["count"]
    return Statistics(documents, terms, np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * h + 1))) for h in held.tolist()], np.int64))


class Block:
    """Term counts of some documents, by term, and each term's bitmap."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, known: Statistics):
        self.size = len(n)
        m = known.lengths(n)
        doc = np.repeat(np.arange(self.size), sizes)
        value = known.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.argsort(term, kind="stable")
        self.doc, self.value = doc[order], value[order]
        self.terms, first = np.unique(term[order], return_index=True)
        self.cuts = np.append(first, len(order))
        self.most = np.maximum.reduceat(self.value, first) if len(first) else np.zeros(0, np.int64)
        self.bitmaps = np.zeros((len(self.terms), -(-self.size // 8)), np.uint8)
        row = np.repeat(np.arange(len(self.terms)), np.diff(self.cuts))
        np.bitwise_or.at(self.bitmaps, (row, self.doc >> 3), np.uint8(1) << (self.doc & 7).astype(np.uint8))

    def groups(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(masks, order, cuts): the distinct masks of matched terms as rows of bits, and the documents of each, as
        ranges of order. rows: the terms' places in the block. Documents that match none are left out."""
        some = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(self.bitmaps[rows], axis=0), count=self.size, bitorder="little"))
        words = []
        for a in range(0, len(rows), 64):
            word = np.zeros(len(some), np.uint64)
            for k, row in enumerate(rows[a : a + 64].tolist()):
                word |= np.unpackbits(self.bitmaps[row], count=self.size, bitorder="little")[some].astype(np.uint64) << np.uint64(k)
            words.append(word)
        order = np.argsort(words[0], kind="stable") if len(words) == 1 else np.lexsort(words)
        masks = np.stack([w[order] for w in words], axis=1)
        first = np.flatnonzero(np.append(True, (masks[1:] != masks[:-1]).any(axis=1)))
        bits = np.unpackbits(masks[first].astype("<u8").view(np.uint8), axis=1, count=len(rows), bitorder="little")
        return bits, some[order], np.append(first, len(some))

    def scores(self, some: np.ndarray, rows: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The scores of some documents, given in ascending order."""
        out = np.zeros(len(some), np.int64)
        for row, repeats in zip(rows.tolist(), times.tolist(), strict=True):
            doc, value = self.doc[self.cuts[row] : self.cuts[row + 1]], self.value[self.cuts[row] : self.cuts[row + 1]]
            at = np.minimum(np.searchsorted(doc, some), len(doc) - 1)
            out += np.where(doc[at] == some, value[at] * repeats, 0)
        return out


class Best:
    """The k best documents so far, best first: by score, then by id, those without an id last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.doc_id, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """A lower score cannot enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc_id: np.ndarray, missing: np.ndarray) -> None:
        """Takes more documents; those without a score are left out."""
        score, doc_id, missing = (np.concatenate([old, new[score > 0]]) for old, new in ((self.score, score), (self.doc_id, doc_id), (self.missing, missing)))
        order = np.lexsort((doc_id, missing, -score))[: self.k]
        self.score, self.doc_id, self.missing = score[order], doc_id[order], missing[order]


def search_block(block: Block, doc_id: np.ndarray, missing: np.ndarray, terms: np.ndarray, times: np.ndarray, best: Best) -> int:
    """Adds the block's best documents for an item's distinct terms (places in the vocabulary, how often each); gives how many
    documents were scored."""
    rows = np.searchsorted(block.terms, terms)
    here = rows < len(block.terms)
    here[here] = block.terms[rows[here]] == terms[here]
    rows, times = rows[here], times[here]
    if not len(rows):
        return 0
    masks, members, cuts = block.groups(rows)
    bound = masks.astype(np.int64) @ (block.most[rows] * times)
    order = np.argsort(-bound, kind="stable")
    sizes = np.diff(cuts)[order]
    begin, scored, ask = 0, 0, 8 * best.k
    while begin < len(order) and bound[order[begin]] >= best.least():
        # groups of at least `ask` documents together, and all of them may still enter
        end = begin + int(np.searchsorted(np.cumsum(sizes[begin:]), ask)) + 1
        end = min(end, begin + int(np.searchsorted(-bound[order[begin:]], -best.least(), side="right")))
        some = np.sort(members[ranges(cuts[order[begin:end]], sizes[begin:end])])
        best.add(block.scores(some, rows, times), doc_id[some], missing[some])
        begin, scored, ask = end, scored + len(some), 4 * ask
    return scored


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 for each item, best first.

    docs: doc_id, text; items: item_id, text, in as many blocks, and passes over docs, as their characters need.
    """
    spark = docs.sparkSession
    items = items.where("text is not null").select(F.col("item_id").cast("long"), "text")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // ITEM_CHARS))
    out = [found_in(docs, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b), k) for b in range(blocks)]
    return reduce(DataFrame.union, out, spark.createDataFrame([], "item_id long, rank int, doc_id long, score long"))


def found_in(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """`search` for one block of items."""
    spark = docs.sparkSession
    asked = sorted(((r.item_id, terms_of(r.text.encode("utf-8", "replace"))) for r in items.toLocalIterator()), key=lambda x: (x[0] is None, x[0], x[1]))
    vocabulary = sorted({w for _, words in asked for w in words})
    rows = written(counted(docs, vocabulary), "term-counts")
    known = statistics(rows, len(vocabulary))
    place = {w: n for n, w in enumerate(vocabulary)}
    wanted = [(item, *np.unique(np.array([place[w] for w in words], np.int64), return_counts=True)) for item, words in asked if words]
    shared = spark.sparkContext.broadcast((wanted, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, known = shared.value
        best = [Best(k) for _ in wanted]
        held: list[pa.RecordBatch] = []

        def done() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table["terms"].combine_chunks()
            sizes, tfs = np.diff(np.asarray(lists.offsets)), table["tfs"].combine_chunks()
            term, tf = (np.asarray(x.flatten()).astype(np.int64) for x in (lists, tfs))
            ids = table["doc_id"].combine_chunks()
            doc_id, missing = np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())
            block = Block(np.asarray(table["n"]), sizes, term, tf, known)
            for (_, terms, times), kept in zip(wanted, best, strict=True):
                search_block(block, doc_id, missing, terms, times, kept)
            held.clear()

        for batch in batches:
            sizes = np.diff(np.asarray(batch.column("terms").offsets))
            total, begin = np.cumsum(sizes), 0
            while begin < batch.num_rows:
                room = COUNTS + (int(total[begin - 1]) if begin else 0)
                take = max(1, min(DOCUMENTS, int(np.searchsorted(total, room, side="right")) - begin))
                if held and (sum(x.num_rows for x in held) + take > DOCUMENTS or sum(len(x.column("terms").flatten()) for x in held) + int(sizes[begin : begin + take].sum()) > COUNTS):
                    done()
                held.append(batch.slice(begin, take))
                begin += take
        if held:
            done()
        for number, ((item, _, _), kept) in enumerate(zip(wanted, best, strict=True)):
            if len(kept.score):
                size = len(kept.score)
                yield pa.RecordBatch.from_arrays([pa.array([number] * size, pa.int32()), pa.array([item] * size, pa.int64()), pa.array(kept.doc_id, pa.int64(), mask=kept.missing), pa.array(kept.score)], ["item", "item_id", "doc_id", "score"])

    found = rows.mapInArrow(run, "item int, item_id long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    few = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    for keys in (["item", "salt"], ["item"]):
        few = few.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return few.select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each item of the benchmark."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH lower_case AS (SELECT translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, doc_id, row_number() OVER () AS d FROM documents WHERE text IS NOT NULL),
w AS (SELECT d, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lower_case),
i AS (SELECT item_id, row_number() OVER () AS item, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item, item_id, term, count(*) AS times FROM i GROUP BY ALL),
n AS (SELECT d, any_value(doc_id) AS doc_id, count(*) AS n FROM w GROUP BY d),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
f AS (SELECT d, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY d, term),
g AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM f, s GROUP BY term, docs),
p AS (SELECT item, item_id, doc_id, d, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * docs) // terms)))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN g USING (term) JOIN n USING (d), s GROUP BY item, item_id, doc_id, d)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0) WHERE rank <= 10
"""
