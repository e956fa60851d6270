"""Packing along a space-filling curve.

Each document's words are hashed into buckets; the vector of square roots of the bucket counts, scaled to length 1, is
projected by fixed random directions to a few dimensions, each squashed to the unit interval and cut to a grid; the cell's
place on the Hilbert curve is the document's key. Documents are range-sorted by (key, doc_id) and laid end to end along the
curve inside each range, cut at every ``capacity`` tokens. What is left at a range's end is cut into powers of two, so no
sequence needs padding.

The id of the document breaks ties of the key, so any number of equal documents spreads over several ranges. A range's task
streams over its documents and holds one unfinished sequence. Keys and ids are written once to the shared folder before the
range sort, so its sampling does not encode twice and a lost executor repeats only its own part.

Null and empty texts have just the end id. A document with a null id is packed like any other. Rows that repeat an id are
packed each on their own. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passplane.llm.base import by_size, documents, texts_of, written
from passplane.llm.tokens import encoder

#: The curve: dimensions and bits of each. The hashed vectors' buckets. Tokens that one range holds on average.
DIMENSIONS, BITS, BUCKETS, TOKENS_PER_RANGE = 4, 15, 256, 3_000_000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of grid cells (rows, dimensions), as int64.

    Cells are first turned into the transposed index by undoing the rotations of each level, from the highest bit down, and
    Gray decoding; then the bits are interleaved.
    """
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    level = np.uint64(1 << (bits - 1))
    one = np.uint64(1)
    while level > one:
        low = level - one
        for i in range(n):
            inside = (x[i] & level) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        level >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    level = np.uint64(1 << (bits - 1))
    while level > one:
        flip ^= np.where(x[n - 1] & level, level - one, np.uint64(0))
        level >>= one
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_keys(words: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    """The Hilbert key of each of n texts' hashed word vectors. words: a hash of each word; text_of: its text."""
    directions = np.random.default_rng(7).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)
    cells = text_of * BUCKETS + (words % np.uint64(BUCKETS)).astype(np.int64)
    vector = np.sqrt(np.bincount(cells, minlength=n * BUCKETS).reshape(n, BUCKETS)).astype(np.float32)
    size = np.sqrt((vector**2).sum(1, keepdims=True))
    place = 1 / (1 + np.exp(-1.7 * (vector / np.maximum(size, 1e-9)) @ directions))
    return hilbert_key(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def keyed_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, key, n, ids): each text's curve key and its ids with the end id, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer)
        width = "<u2" if max(tok.library.get_vocab_size(), end_id + 1) <= 65_536 else "<u4"
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in by_size(texts):
                found, words, text_of = tok.encode_with_words(texts[a:b])
                ids = [np.append(x, end_id).astype(width) for x in found]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(curve_keys(words, text_of, b - a)), pa.array(list(map(len, ids)), pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "key", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, key long, n long, ids binary")


def powers_of_two(n: int) -> list[int]:
    """Powers of two, the largest first, that sum to n."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Lays documents end to end in sequences of a capacity; gives a piece for each part of a document in a sequence."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence, self.room = capacity, first_sequence, capacity
        self.open: list[tuple] = []  # (doc_id, start, ids, doc_tokens) in the unfinished sequence

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        """The pieces of the sequences that this document completes."""
        at = 0
        while at < len(ids):
            part = ids[at : at + self.room]
            self.open.append((doc_id, at, part, len(ids)))
            at += len(part)
            self.room -= len(part)
            if not self.room:
                yield from self._close(self.open)
                self.open, self.room = [], self.capacity

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, part, total in pieces:
            yield doc_id, start, len(part), zlib.crc32(part.astype("<u4")), total, self.sequence, offset
            offset += len(part)
        self.sequence += 1

    def finish(self) -> Iterator[tuple]:
        """The rest, in sequences of powers of two."""
        left = list(self.open)
        for size in powers_of_two(sum(len(p[2]) for p in left)):
            pieces = []
            while size:
                doc_id, start, part, total = left.pop(0)
                pieces.append((doc_id, start, part[:size], total))
                if len(part) > size:
                    left.insert(0, (doc_id, start + size, part[size:], total))
                size -= len(pieces[-1][2])
            yield from self._close(pieces)
        self.open = []


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """Packs doc_id, text: a row for each piece, see PIECE. The sequences of one range have consecutive ids."""
    ids = written(keyed_ids(docs, tokenizer, end_id), "keyed-ids")
    total = ids.agg(F.sum("n")).first()[0] or 0
    width = 2 if ids.isEmpty() else ids.select((F.length("ids") / F.col("n")).cast("int")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, TaskContext.get().partitionId() << 32)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], [x.split()[0] for x in PIECE.split(", ")])

        for batch in batches:
            pieces: list[tuple] = []
            for doc_id, blob in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                pieces += packer.add(doc_id, np.frombuffer(blob, f"<u{width}"))
            yield out(pieces)
        yield out(list(packer.finish()))

    ranges = max(1, -(-total // TOKENS_PER_RANGE))
    # equal texts have one key; a hash of the row's place in the written table parts those that have one id, or none, too
    spread = F.xxhash64(F.monotonically_increasing_id()).alias("spread")
    return ids.select("*", spread).repartitionByRange(ranges, "key", "doc_id", "spread").sortWithinPartitions("key", "doc_id", "ids").select("doc_id", "ids").mapInArrow(run, PIECE)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs every document into sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
