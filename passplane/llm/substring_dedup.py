"""Substring deduplication: words inside any run of ``WINDOW`` words that also starts elsewhere are removed.

The texts' k-mers of ``GRAM`` words are the nodes of a de Bruijn graph; only some are kept, its *anchors*: in every window
the one with the least hash (of equal ones the last), which depends on the window's words alone, so the same window has the
same anchor wherever it stands. Edges are the words between neighbouring anchors, with the words before a text's first and
after its last anchor as edges to its ends. A node's context is the hash of its edges on both sides.

1. *Degrees.* One aggregate by node counts its places and the least and largest context. A node at several places
   whose contexts are all the same is nonbranching: wherever it stands, the words up to both neighbours are the same.
2. *Compaction.* Joined to the places, the degrees compact the graph: a window whose own anchor is nonbranching, and all
   anchors inside it too, lies on a path that has no branch, so all of it stands elsewhere as well. Windows whose anchor
   stands only once stand once. Neither needs any more rows; most of a corpus ends here.
3. *Verification.* What is left, windows near branches, is verified by source coordinates: neighbouring windows of one anchor are a
   *run*, known by a 128-bit hash of all of its words. Each distinct run gives the 128-bit hashes of its windows once, with its number of
   places; a window that has two places or more in total is repeated. Whether a window is left depends on its words alone, so of a repeated one
   all places are left or none.

The place of a run and a doc's anchors are found again by (doc_id, hash of doc_id and text). Places of a hot
anchor or run meet one row of the other side in a join whose skewed partitions Spark splits; counts are pre-aggregated; rows that are
equal in id and text give one list. A node hash of 64 bits may be shared: the node then branches and its windows are verified.

Words are runs of bytes other than ASCII white space, case and marks included. Null, empty and short texts have no windows and
keep their words. Null and repeated ids are ids like others; each row has its result. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passplane.llm.base import Codes, by_size, deleted, documents, ranges, written

#: Words of a window and of a node. A run has at most WINDOW - GRAM + 1 windows, the bits of a long.
WINDOW, GRAM = 35, 8
SPAN = WINDOW - GRAM + 1

_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of sums."""
    h = (h ^ (h >> np.uint64(32))) * _STEP
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def rolled(x: np.ndarray, length: int, base: int = _BASE) -> np.ndarray:
    """The sum of x[i + j] * base^j for j < length, at every i where so many follow, by doubling."""
    n = max(0, len(x) - length + 1)
    out, done, step, value, power = np.zeros(n, np.uint64), 0, 1, x, base
    factor = 1
    while True:
        if length & step:
            out += value[done : done + n] * np.uint64(factor)
            done, factor = done + step, factor * power % (1 << 64)
        if done == length or not n:
            return mixed(out)
        value = value[:-step] + value[step:] * np.uint64(power)
        step, power = 2 * step, power * power % (1 << 64)


def last_least(x: np.ndarray, length: int) -> np.ndarray:
    """For every i where so many follow, the place of the least of x[i : i + length], of equal ones the last; by doubling."""
    value, at, size = x, np.arange(len(x)), 1
    while size < length:
        apart = min(size, length - size)
        right = value[apart:] <= value[:-apart]
        value, at = np.where(right, value[apart:], value[:-apart]), np.where(right, at[apart:], at[:-apart])
        size += apart
    return at


class Graph:
    """Words, windows and anchors of some texts, laid end to end.

    n, starts: words of each text and where they begin; windows: where they begin, text: whose each is, chosen: its anchor's
    place among `anchors`; node, context: hashes of the anchors.
    """

    def __init__(self, texts: list[bytes]):
        from xxhash import xxh3_128_intdigest

        self.words = [t.split() for t in texts]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(self.n) - self.n
        codes = Codes()
        flat = codes.of([w for words in self.words for w in words])
        whole = np.frombuffer(b"".join(xxh3_128_intdigest(w).to_bytes(16, "little") for w in codes), "<u8").reshape(-1, 2)
        self.hash = [whole[:, k][flat] for k in (0, 1)]
        count = np.maximum(self.n - WINDOW + 1, 0)
        self.windows = ranges(self.starts, count)
        self.text = np.repeat(np.arange(len(texts)), count)
        self.anchors, self.owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.windows):
            self.chosen = self.anchors
            self.node = self.context = np.zeros(0, np.uint64)
            return
        grams = rolled(self.hash[0], GRAM)
        places = last_least(grams, SPAN)[self.windows]
        new = np.append(True, (places[1:] != places[:-1]))
        self.anchors, self.chosen = places[new], np.cumsum(new) - 1
        self.owner = self.text[new]
        self.node, self.context = grams[self.anchors], self._contexts()

    def _contexts(self) -> np.ndarray:
        """The hashes of the edges on both sides of each anchor."""
        first = np.append(True, self.owner[1:] != self.owner[:-1])
        last = np.append(first[1:], True)
        before = np.where(first, self.starts[self.owner], np.append(0, self.anchors[:-1]))
        after = np.where(last, (self.starts + self.n)[self.owner], np.append(self.anchors[1:], 0) + GRAM)
        return mixed(self.span(0, before, self.anchors) + first) * np.uint64(3) + mixed(self.span(0, self.anchors, after) + last)

    def span(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The k-th hash of the words [a, b)."""
        n = len(self.hash[k])
        up, down = (np.cumprod(np.append(np.uint64(1), np.full(n, f, np.uint64))) for f in (_BASE, _INVERSE))
        sums = np.append(np.uint64(0), np.cumsum(self.hash[k] * up[:n]))
        return mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _STEP)

    def kinds(self, several: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sure, left) of the windows. several: anchors at several places; single: those of them that do not branch."""
        branches = np.append(0, np.cumsum(~single))
        low, high = np.searchsorted(self.anchors, self.windows + 1), np.searchsorted(self.anchors, self.windows + SPAN - 1)
        sure = single[self.chosen] & (branches[np.maximum(low, high)] == branches[low])
        return sure, several[self.chosen] & ~sure

    def runs(self, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last window of each run, as places among the windows."""
        at = np.flatnonzero(left)
        if not len(at):
            return at, at
        new = np.append(True, (np.diff(at) > 1) | (np.diff(self.chosen[at]) > 0) | (np.diff(self.text[at]) > 0))
        return at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]


def covered(n: int, spans: np.ndarray) -> np.ndarray:
    """Which of n words lie in the spans, given as pairs (first, end)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, spans[::2], 1)
    np.add.at(change, spans[1::2], -1)
    return np.cumsum(change[:-1]) > 0


def islands(first: np.ndarray) -> np.ndarray:
    """Pairs (first, end) of the words that windows with ascending beginnings cover."""
    if not len(first):
        return first
    new = np.append(True, np.diff(first) > WINDOW)
    return np.stack([first[new], first[np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)] + WINDOW], axis=1).ravel()


def outcome(words: list[bytes], spans: np.ndarray, text: bool) -> tuple[int, int, str, list[dict]]:
    """(n_words, n_removed, kept, spans): kept is the text of the kept words, or its SHA-256."""
    gone = covered(len(words), spans)
    kept = b" ".join(compress(words, (~gone).tolist()))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
    pairs = [{"first": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
    return len(words), int(gone.sum()), kept.decode("utf-8", "replace") if text else hashlib.sha256(kept).hexdigest(), pairs


_PAIRS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
_OUT = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string(), "spans": _PAIRS}
_RESULT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<first:int,end:int>>"
_RUN = pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64()), ("first", pa.int32()), ("windows", pa.list_(pa.struct([("p", pa.int64()), ("q", pa.int64())])))]))
_RUNS = "array<struct<x:long,y:long,first:int,windows:array<struct<p:long,q:long>>>>"


def keyed(docs: DataFrame) -> DataFrame:
    """(a, b, doc_id, text): a and b know a row again, up to rows that are equal in id and text; null text is empty."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.select(F.coalesce("doc_id", F.lit(0)).alias("a"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text").alias("b"), "doc_id", "text")


def anchored(rows: DataFrame) -> DataFrame:
    """(a, b, place, node, context): a row for every anchor of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for begin, end in by_size(texts):
                g = Graph(texts[begin:end])
                keys = [batch.column(c).slice(begin, end - begin).take(pa.array(g.owner)) for c in ("a", "b")]
                place = pa.array(g.anchors - g.starts[g.owner], pa.int32())
                yield pa.RecordBatch.from_arrays([*keys, place, pa.array(g.node.view(np.int64)), pa.array(g.context.view(np.int64))], ["a", "b", "place", "node", "context"])

    return rows.select("a", "b", "text").mapInArrow(run, "a long, b long, place int, node long, context long")


def degrees(anchors: DataFrame) -> DataFrame:
    """(node, single): the nodes at several places, and whether they do not branch."""
    found = anchors.groupBy("node").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).where("n > 1")
    return found.select("node", (F.col("low") == F.col("high")).alias("single"))


def compacted(rows: DataFrame, places: DataFrame, text: bool) -> DataFrame:
    """Per row its outcome (see `outcome`) if no window is left, or else its text, the spans known so far and its runs.
    places: (a, b, places), each twice the word at which a node of several places stands, plus 1 if it does not branch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for begin, end in by_size(texts):
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("a", "b", "doc_id")], *_compact(texts[begin:end], part.column("places"), seen, text)], ["a", "b", "doc_id", *_OUT, "text", "sure", "runs"])

    return rows.join(places, ["a", "b"], "left").select("a", "b", "doc_id", "text", "places").mapInArrow(run, f"a long, b long, {_RESULT}, text binary, sure array<int>, runs {_RUNS}")


def _compact(texts: list[bytes], places: pa.Array, seen: set[bytes], text: bool) -> list[pa.Array]:
    """The columns of `compacted` after the keys. seen: hashes of runs whose windows this task has already given."""
    some = np.flatnonzero(np.asarray(places.is_valid()))
    g = Graph([texts[k] for k in some.tolist()])
    lists = places.take(pa.array(some))
    flat = np.asarray(lists.flatten()).astype(np.int64)
    at = np.repeat(g.starts, np.asarray(lists.value_lengths()).astype(np.int64)) + (flat >> 1)
    several, single = np.zeros(len(g.anchors), bool), np.zeros(len(g.anchors), bool)
    row = np.searchsorted(g.anchors, at)
    several[row], single[row] = True, flat & 1 == 1
    sure, left = g.kinds(several, single)
    first, last = g.runs(left)
    begin, end = g.windows[first], g.windows[last] + WINDOW
    x, y = (g.span(k, begin, end).view(np.int64) for k in (0, 1)) if len(first) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    hashes = [rolled(g.hash[k], WINDOW, _BASE).view(np.int64) for k in (0, 1)]
    of_text = g.text[first]
    cuts = np.searchsorted(of_text, np.arange(len(some) + 1))
    sure_at = np.flatnonzero(sure)
    sure_cuts = np.searchsorted(g.text[sure_at], np.arange(len(some) + 1))
    out: dict[str, list] = {c: [None] * len(texts) for c in (*_OUT, "text", "sure", "runs")}
    rank = dict(zip(some.tolist(), range(len(some)), strict=True))
    for k, t in enumerate(texts):
        r = rank.get(k)
        spans = np.zeros(0, np.int64) if r is None else islands(g.windows[sure_at[sure_cuts[r] : sure_cuts[r + 1]]] - g.starts[r])
        if r is None or cuts[r] == cuts[r + 1]:
            for c, v in zip(_OUT, outcome(t.split() if r is None else g.words[r], spans, text), strict=True):
                out[c][k] = v
            continue
        runs = []
        for j in range(cuts[r], cuts[r + 1]):
            key = x[j].tobytes() + y[j].tobytes()
            windows = None
            if key not in seen:
                seen.add(key)
                windows = [{"p": p, "q": q} for p, q in zip(*(h[begin[j] : end[j] - WINDOW + 1].tolist() for h in hashes), strict=True)]
            runs.append({"x": x[j], "y": y[j], "first": begin[j] - g.starts[r], "windows": windows})
        out["text"][k], out["sure"][k], out["runs"][k] = t, spans, runs
    kinds = _OUT | {"text": pa.binary(), "sure": pa.list_(pa.int32()), "runs": _RUN}
    return [pa.array(v, kinds[c]) for c, v in out.items()]


def verified(runs: DataFrame) -> DataFrame:
    """(x, y, bits): which windows of each distinct run have two places or more. runs: x, y, windows, of which at least one of a run is not null."""
    distinct = written(runs.groupBy("x", "y").agg(F.count("*").alias("n"), F.first("windows", ignorenulls=True).alias("windows")), "runs")
    windows = distinct.select("x", "y", "n", F.posexplode("windows")).select("x", "y", "n", F.col("pos"), "col.p", "col.q")
    often = windows.groupBy("p", "q").agg(F.sum("n").alias("places")).where("places > 1").select("p", "q")
    return windows.join(often, ["p", "q"]).groupBy("x", "y").agg(F.bit_or(F.expr("shiftleft(1L, pos)")).alias("bits"))


def finished_rows(left: DataFrame, found: DataFrame, text: bool) -> DataFrame:
    """The outcome of rows with runs. left: doc_id, text, sure; found: (a, b, found), structs of a run's first window and its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, sure, runs in zip(*(batch.column(c).to_pylist() for c in ("text", "sure", "found")), strict=True):
                at = sorted({r["first"] + k for r in runs or [] for k in range(SPAN) if r["bits"] >> k & 1})
                rows.append(outcome(t.split(), np.concatenate([np.array(sure, np.int64), islands(np.array(at, np.int64))]), text))
            columns = zip(*rows, strict=True) if rows else [[]] * len(_OUT)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, kind) for v, kind in zip(columns, _OUT.values(), strict=True)]], ["doc_id", *_OUT])

    return left.join(found, ["a", "b"], "left").select("doc_id", "text", "sure", "found").mapInArrow(run, _RESULT)


def without_repeats(docs: DataFrame, text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans) per row of docs (doc_id, text): the kept words joined by one space (their SHA-256, if not text), and
    the removed spans of words. Intermediate tables are deleted once used, but for the one that the result is read from."""
    spark = docs.sparkSession
    rows = keyed(docs)

    def step(df: DataFrame, name: str, *used: DataFrame) -> DataFrame:
        out = shuffled_away(lambda: written(df, name), spark)
        deleted(spark, [f.rsplit("/", 1)[0] for u in used for f in u.inputFiles()[:1]])
        return out

    anchors = step(anchored(rows), "anchors")
    nodes = step(degrees(anchors), "nodes")
    marked = anchors.select("a", "b", "place", "node").join(nodes, "node").select("a", "b", (F.col("place").cast("long") * 2 + F.col("single").cast("long")).alias("place"))
    places = marked.groupBy("a", "b").agg(F.collect_set("place").alias("places"))
    paths = step(compacted(rows, places, text), "paths", anchors, nodes)
    left = paths.where("text is not null")
    runs = left.select("a", "b", F.inline("runs"))
    bits = step(verified(runs), "repeated")
    found = runs.select("a", "b", "x", "y", "first").join(bits, ["x", "y"]).groupBy("a", "b").agg(F.collect_set(F.struct("first", "bits")).alias("found"))
    return paths.where("text is null").select("doc_id", *_OUT).union(finished_rows(left.select("a", "b", "doc_id", "text", "sure"), found, text))


def shuffled_away(step: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """Runs a step that writes a table; the shuffle files of its jobs are deleted at its end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        return step()
    finally:
        spark.conf.set(name, before)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of repeated windows."""
    return without_repeats(documents(spark, sf_dir), text=False).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT d, words, unnest(range(1, len(words) - 33)) AS i FROM w),
h AS (SELECT d, i, array_to_string(words[i:i + 34], ' ') AS passage FROM p),
r AS (SELECT d, i FROM (SELECT *, count(*) OVER (PARTITION BY passage) AS n FROM h) WHERE n > 1),
g AS (SELECT DISTINCT d, unnest(range(i, i + 35)) AS i FROM r),
k AS (SELECT doc_id, d, words, unnest(range(1, len(words) + 1)) AS i FROM w),
o AS (SELECT d, string_agg(words[k.i], ' ' ORDER BY k.i) AS kept, count(*) AS n FROM k ANTI JOIN g USING (d, i) GROUP BY d)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN o USING (d)
"""
