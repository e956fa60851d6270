"""Document fingerprints from prefix polynomial hashes.

A text's code points c[0], c[1], ... have the prefix hashes H[i] = sum of (c[j] + 1) * B^j for j < i, modulo the prime
2^31 - 1, twice with different B. The hash of a span [a, b) is (H[b] - H[a]) * B^-a, so the equality of any two spans of any
two texts takes a few operations, and their longest common extension is found by binary search over the length.

A fingerprint has, for each of a few lengths of spans, ``BINS`` bins with the low bits of the least of the hashes of all spans of
that length that fall in that bin, then the hash of the whole text and its length. A bin without spans takes the next full
bin's value, mixed with the distance. Two texts are compared by the length of spans that fits the shorter one (``SPANS``), so unequal
lengths do not matter; a text has the bins of its own length and of those of shorter texts down to an eighth of it. The
likeness of two fingerprints is 1 if they are equal; else the share of bins that agree, corrected for the
agreement of random bits, is an estimate j of the common part of all spans of both, and 2j / (1 + j) one of the share of a text's spans
that the other has. Where one text is so much longer that this is below 0.23, it is 0. Equal texts have equal
fingerprints and likeness 1, different ones at most n / (n + 1) for the longer one's n code points; with an empty text it is 0.

An edited text shares its beginning with the document and its end with the next document: its prefix hashes are the
document's up to the cut, then the next document's, moved; no text is hashed twice.

The next document is that of the next larger (doc_id, hash of the text, text); after the last comes the first. Documents are
dealt to ranges of (doc_id, hash), so many rows of one id, or without one, are spread over tasks; the first row of every
range is also sent to the range before. Null texts are empty; null ids come first; rows that repeat an id follow each other
by hash and text; equal rows are in any order, and spread over ranges too if they are many. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passplane.llm.base import documents
from passplane.llm.token_files import LEAST_LONG, cuts_of, hashed

PRIME = np.uint64((1 << 31) - 1)
#: The two bases; bins; bits kept of each.
BASES, BINS, BITS = (1_000_003, 918_273_645), 64, 8
#: Code points in a span, by the least and the greatest length of the shorter of two texts.
SPANS = ((1, 1, 1), (2, 2, 11), (5, 12, 71), (12, 72, 1 << 62))
#: A text so many times longer than a length's greatest has no bins for it.
APART = 8
#: Documents in a range of doc_id.
ROWS_PER_RANGE = 4000


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2^62."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


class Powers:
    """Powers of a base and of its inverse, as many as were asked for."""

    def __init__(self, base: int):
        self.base = base
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        """Makes n powers known."""
        while len(self.up) < n:
            k = len(self.up)
            for name, b in (("up", self.base), ("down", pow(self.base, -1, int(PRIME)))):
                own = getattr(self, name)
                setattr(self, name, np.concatenate([own, reduced(own * np.uint64(pow(b, k, int(PRIME))))]))


POWERS = [Powers(b) for b in BASES]


class Prefix:
    """The prefix hashes of a text, of one base."""

    def __init__(self, cps: np.ndarray, powers: Powers):
        powers.grow(len(cps) + 2)
        self.powers = powers
        # terms are below 2^31, so up to 2^32 of them can be added before reducing
        terms = reduced((cps.astype(np.uint64) + np.uint64(1)) * powers.up[: len(cps)])
        self.sums = np.concatenate([np.zeros(1, np.uint64), reduced(np.cumsum(terms))])

    @classmethod
    def joined(cls, a: Prefix, cut: int, b: Prefix, taken: int) -> Prefix:
        """Of a's first cut code points followed by b's first taken."""
        out = cls.__new__(cls)
        out.powers = a.powers
        a.powers.grow(cut + taken + 2)
        out.sums = np.concatenate([a.sums[: cut + 1], reduced(a.sums[cut] + reduced(b.sums[1 : taken + 1] * a.powers.up[cut]))])
        return out

    def __len__(self) -> int:
        return len(self.sums) - 1

    def span(self, a: int, b: int) -> int:
        """The hash of the span [a, b)."""
        return (int(self.sums[b]) - int(self.sums[a])) * int(self.powers.down[a]) % int(PRIME)

    def spans(self, length: int) -> np.ndarray:
        """The hashes of all spans of a length."""
        n = len(self) - length + 1
        return reduced((self.sums[length:] + PRIME - self.sums[:n]) * self.powers.down[:n])


def prefixes(text: str) -> list[Prefix]:
    """The prefix hashes of a text, of both bases."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return [Prefix(cps, p) for p in POWERS]


def spans_equal(x: list[Prefix], a: int, b: int, y: list[Prefix], c: int, d: int) -> bool:
    """Whether span [a, b) of one text equals span [c, d) of another (by both hashes)."""
    return b - a == d - c and all(p.span(a, b) == q.span(c, d) for p, q in zip(x, y, strict=True))


def common_extension(x: list[Prefix], a: int, y: list[Prefix], b: int) -> int:
    """The length of the longest common span that begins at a in one text and at b in another."""
    low, high = 0, min(len(x[0]) - a, len(y[0]) - b)
    while low < high:
        middle = (low + high + 1) // 2
        if spans_equal(x, a, a + middle, y, b, b + middle):
            low = middle
        else:
            high = middle - 1
    return low


_BIN_SHIFT = np.uint64(31 - int(np.log2(BINS)))


def sketch(x: list[Prefix]) -> bytes:
    """Which lengths of spans the text has bins for (a bit each), their bins, then its two whole hashes and its length."""
    n = len(x[0])
    has = [low <= n <= APART * high for _, low, high in SPANS]
    bins = b"".join(_bins(spread(x[0].spans(span))) for (span, _, _), own in zip(SPANS, has, strict=True) if own)
    whole = b"".join(p.span(0, n).to_bytes(4, "little") for p in x) + n.to_bytes(5, "little")
    return bytes([sum(own << k for k, own in enumerate(has))]) + bins + whole


def spread(h: np.ndarray) -> np.ndarray:
    """Mixes hashes; those of spans that differ in one character are near each other."""
    h = reduced(h * np.uint64(1_812_433_253))
    h ^= h >> np.uint64(15)
    return reduced((h & PRIME) * np.uint64(1_597_334_677))


def _bins(h: np.ndarray) -> bytes:
    """The low bits of the least hash in each bin; the leading bits are the bin."""
    if len(h) > 64 * BINS:
        # the least of a bin is nearly always among these; if not, all are sorted
        inside = (h & np.uint64((1 << int(_BIN_SHIFT)) - 1)) < np.uint64((1 << int(_BIN_SHIFT)) * 16 * BINS // len(h))
        few = np.sort(h[inside])
        first = np.searchsorted(few, np.arange(BINS, dtype=np.uint64) << _BIN_SHIFT)
        if len(few) and (np.diff(np.append(first, len(few))) > 0).all():
            return (few[first] * np.uint64(2_654_435_761) >> np.uint64(24)).astype(np.uint8).tobytes()
    least = np.sort(h)
    first = np.searchsorted(least, np.arange(BINS, dtype=np.uint64) << _BIN_SHIFT)
    full = np.diff(np.append(first, len(least))) > 0
    value = least[np.minimum(first, len(least) - 1)]
    # an empty bin borrows from the next full one, around the end
    at = np.flatnonzero(full)
    source = at[np.searchsorted(at, np.arange(BINS)) % len(at)]
    away = ((source - np.arange(BINS)) % BINS).astype(np.uint64)
    return ((value[source] + away * np.uint64(0x9E3779B1)) * np.uint64(2_654_435_761) >> np.uint64(24)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The likeness of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    lengths = [int.from_bytes(x[-5:], "little") for x in (a, b)]
    kind = next((k for k, (_, low, high) in enumerate(SPANS) if low <= min(lengths) <= high), None)
    if kind is None or not all(x[0] >> kind & 1 for x in (a, b)):
        return 0.0
    own = [x[1 + BINS * (x[0] & ((1 << kind) - 1)).bit_count() :][:BINS] for x in (a, b)]
    same = float((np.frombuffer(own[0], np.uint8) == np.frombuffer(own[1], np.uint8)).mean())
    j = max(0.0, (same - 2.0**-BITS) / (1 - 2.0**-BITS))
    return min(2 * j / (1 + j), max(lengths) / (max(lengths) + 1))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_prefix long"


def dealt(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(own, doc_id, text) of doc_id, text: a partition has a range of (id, hash) in order, then the first row of the next.

    Cuts between ranges are ids of the table, so the first row of a range is known by its id; of a range that may begin
    elsewhere each batch sends its own first row, and the first of these is taken.
    """
    cuts = cuts_of(docs, rows_per_range)
    docs = hashed(docs)
    least, nulls = docs.agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    first_id = LEAST_LONG if nulls or least is None else least
    # a cut at the first id makes no range
    cuts = cuts.only((cuts.ids > first_id) | (cuts.hashes > LEAST_LONG) | (cuts.spreads > LEAST_LONG))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "own", "doc_id", "text", "hash"]
        for batch in batches:
            ids, own_hash = np.asarray(batch.column("doc_id").fill_null(LEAST_LONG)), np.asarray(batch.column("hash"))
            part = cuts.part(ids, own_hash, np.asarray(batch.column("spread")))
            batch = batch.select(names[2:])
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.ones(len(ids), bool)), *batch.columns], names)
            order = np.lexsort((own_hash, ids, part))
            extra = order[np.flatnonzero(np.diff(part[order], prepend=-1))]
            before = part[extra] - 1
            begin = np.concatenate([[first_id], cuts.ids])[part[extra]]
            known = (ids[extra] == begin) | np.concatenate([[False], cuts.loose])[part[extra]]
            extra, before = extra[known], np.where(before[known] < 0, len(cuts), before[known])
            if len(extra):
                yield pa.RecordBatch.from_arrays([pa.array(before, pa.int32()), pa.array(np.zeros(len(extra), bool)), *batch.take(pa.array(extra)).columns], names)

    rows = docs.mapInArrow(deal, "part int, own boolean, doc_id long, text string, hash long").repartitionById(len(cuts) + 1, "part")
    return rows.sortWithinPartitions(F.col("own").desc(), F.col("doc_id").asc_nulls_first(), "hash", "text").drop("part", "hash")


class Marked:
    """A document with its prefix hashes and fingerprint."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.prefixes = prefixes(text)
        self.sketch = sketch(self.prefixes)

    def against(self, following: Marked) -> tuple:
        """The row of this document, given the next one."""
        n = len(self.text)
        cut, taken = n - n // 4, min(n // 4, len(following.text))
        edited = [Prefix.joined(a, cut, b, taken) for a, b in zip(self.prefixes, following.prefixes, strict=True)]
        mark = sketch(edited)
        text = self.text[:cut] + following.text[:taken]
        return self.doc_id, n, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), self.sketch.hex(), mark.hex(), likeness(self.sketch, mark), likeness(self.sketch, following.sketch), common_extension(self.prefixes, 0, edited, 0)


def fingerprints(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """A row for each of doc_id, text, see OUT; shared_prefix: what the text and the edited text begin with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: Marked | None = None
        for batch in batches:
            rows = []
            for own, doc_id, text in zip(*(batch.column(x).to_pylist() for x in ("own", "doc_id", "text")), strict=True):
                if before is None:
                    if not own:
                        break
                    before = Marked(doc_id, text)
                    continue
                now = Marked(doc_id, text)
                rows.append(before.against(now))
                before = now if own else None
                if not own:
                    break
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()), strict=True)], [x.split()[0] for x in OUT.split(", ")])
            if before is None:
                return

    return dealt(docs, rows_per_range).mapInArrow(run, OUT)


def op8_prefix_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document, of its edited text, and their likeness."""
    return fingerprints(documents(spark, sf_dir))
