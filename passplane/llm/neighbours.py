"""Approximate nearest neighbours by multi-index hashing, for the largest inner product.

A vector x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm of all, which turns inner products into
angles; a query gets 0 there. Binary codes are the signs after learned rotations (each alternately fitted to the nearest
corners of the cube, on a bounded sample of rows); several rotations fill the code. A code is split into substrings of 16
bits, and each substring is indexed by its value. For a Hamming radius r the pigeonhole principle gives each of m substrings
a radius t with sum of (t + 1) = r + 1, so a code within r lies within t in at least one of them: exactly the buckets within
t of the query's substring are looked up, what they hold is held to the full radius, and what stays is ranked by the inner
product of the original vectors in double precision.

The index is a table of codes in shards by (substring, leading bits of its value): a row is in one shard of each substring,
a query goes only to the shards whose leading bits are within t of its own. A shard that many rows fall in is split and its
queries go to each part, so a task holds a bounded number of codes whatever the values' shares. A candidate that several
substrings find counts for the first of them, which its code tells, so nothing has to be gathered to drop repeats. Vectors
travel beside their codes and are ranked in the shard: it gives k rows a query at most, so what is shuffled grows with the
rows and queries, not with their candidate pairs. A limited window keeps the best k of a query's shards.

The radius covers ``COVER`` of the true neighbours, among all rows, of ``ASKED`` sampled rows. A query that finds fewer than
k rows is asked again with a larger radius, up to the whole code, which reaches every row. ``radius=CODE`` from the start is
the exact way. Ties go to the smaller id. Vectors that are null, zero or hold null or non-finite components take no part; nor
do rows without an id. Vectors of unlike lengths are compared as if the shorter one ended in zeros. Products that overflow are infinite; one
that is no number ranks last. Rows that repeat an id are candidates and queries each: rows are numbered, and a query leaves
out only the row of its own number. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passplane.llm.base import ranges, written

#: Bits of a code and of a substring; rows that rotations are fitted on; rows whose true neighbours set the radius, and the
#: share of these that it covers; how much it grows for queries that find too little.
CODE, SUBSTRING, SAMPLE, ASKED, COVER, MORE = 256, 16, 4096, 128, 0.95, 32
PARTS = CODE // SUBSTRING
#: Codes and vector components of a shard, on average; a shard of more than twice as many is split.
PER_SHARD, COMPONENTS = 16_000, 1_024_000

OUT = "query_id long, rank int, vec_id long, score double"
#: Columns on the way to a shard, and what it finds.
ENTRY = ["shard", "split", "asks", "row", "vec_id", "embedding", "code"]
FOUND = ["query", "query_id", "row", "vec_id", "score"]


@dataclass
class Coder:
    """rotation: (dimensions + 1, bits); scale: the largest component; largest: the largest norm after division by it."""

    rotation: np.ndarray
    scale: float
    largest: float

    def codes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Codes (rows, CODE / 64) as uint64."""
        x = x / self.scale
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.largest**2 - (x**2).sum(1), 0))
        bits = np.concatenate([x, extra[:, None]], axis=1) @ self.rotation > 0
        return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u8")


def fit_rotation(x: np.ndarray, bits: int, rounds: int = 25, seed: int = 1) -> np.ndarray:
    """Rotations fitted to rows of length 1 so that these lie near corners of the cube, side by side up to so many bits."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds if len(x) > 1 else 0):
            u, _, v = np.linalg.svd(np.sign(x @ r).T @ x)
            r = (u @ v).T
        parts.append(r)
    return np.concatenate(parts, axis=1)[:, :bits]


def fit(sample: np.ndarray) -> tuple[np.ndarray, float]:
    """The rotation for rows like those of the sample (rows, dimensions), scaled to components of at most 1."""
    largest = float(np.sqrt((sample**2).sum(1).max()))
    extended = np.concatenate([sample, np.sqrt(np.maximum(largest**2 - (sample**2).sum(1), 0))[:, None]], axis=1) / largest
    return fit_rotation(extended, CODE), largest


def substring_radii(radius: int, parts: int = PARTS) -> list[int]:
    """Radii whose (t + 1) sum to radius + 1, as even as can be; -1: the substring need not be probed. A radius of the whole
    code needs one substring only."""
    if radius >= parts * SUBSTRING:
        return [SUBSTRING] + [-1] * (parts - 1)
    least, more = divmod(radius + 1, parts)
    return [least - 1 + (j < more) for j in range(parts)]


_MASKS: dict[int, list[np.ndarray]] = {}


def masks(bits: int, radius: int) -> np.ndarray:
    """All values of so many bits of which at most radius are set."""
    if bits not in _MASKS:
        every = np.arange(1 << bits, dtype=np.int64)
        _MASKS[bits] = [every[np.bitwise_count(every) <= t] for t in range(bits + 1)]
    return _MASKS[bits][min(radius, bits)]


@dataclass
class Layout:
    """The shards: leading bits that tell them; radius of the search and of each substring; parts of split shards by number."""

    bits: int
    radius: int
    splits: dict[int, int]

    def __post_init__(self) -> None:
        self.radii = substring_radii(self.radius)

    def shard(self, part: int, leading: np.ndarray) -> np.ndarray:
        """The numbers of the shards of a substring."""
        return (part << self.bits) + leading

    def of_rows(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position, shard) of each code in the shards of every substring that is probed."""
        words = codes.view("<u2")
        for j, t in enumerate(self.radii):
            if t >= 0:
                yield np.arange(len(codes)), self.shard(j, words[:, j].astype(np.int64) >> (SUBSTRING - self.bits))

    def of_queries(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position, shard) of each query's code and every shard within reach."""
        words = codes.view("<u2")
        for j, t in enumerate(self.radii):
            if t >= 0:
                own = words[:, j].astype(np.int64) >> (SUBSTRING - self.bits)
                near = own[:, None] ^ masks(self.bits, t)[None]
                yield np.repeat(np.arange(len(codes)), near.shape[1]), self.shard(j, near).ravel()


class Index:
    """The codes of a shard by the value of its substring."""

    def __init__(self, codes: np.ndarray, shard: int, layout: Layout):
        self.layout, self.part = layout, shard >> layout.bits
        self.leading, self.low_bits = shard & ((1 << layout.bits) - 1), SUBSTRING - layout.bits
        low = codes.view("<u2")[:, self.part].astype(np.int64) & ((1 << self.low_bits) - 1)
        self.order = np.argsort(low, kind="stable")
        self.codes = codes[self.order]
        # place of each value's bucket in that order
        self.start = np.concatenate([[0], np.cumsum(np.bincount(low, minlength=1 << self.low_bits))])

    def probed(self, code: np.ndarray) -> np.ndarray:
        """Places of all codes in buckets within reach of the query's substring."""
        own = int(code.view("<u2")[self.part])
        left = self.layout.radii[self.part] - ((own >> self.low_bits) ^ self.leading).bit_count()
        if left < 0:
            return np.zeros(0, np.int64)
        bucket = (own & ((1 << self.low_bits) - 1)) ^ masks(self.low_bits, left)
        start = self.start[bucket]
        size = self.start[bucket + 1] - start
        full = size > 0
        return ranges(start[full], size[full])

    def within(self, code: np.ndarray) -> np.ndarray:
        """Positions of the codes within the radius that no substring before this one finds."""
        at = self.probed(code)
        at = at[np.bitwise_count(self.codes[at] ^ code).sum(1) <= self.layout.radius]
        apart = np.bitwise_count(self.codes[at].view("<u2") ^ code.view("<u2")) <= np.array(self.layout.radii)
        return self.order[at[apart.argmax(1) == self.part]]


def usable(vector: str) -> Column:
    """Whether a vector takes part."""
    c = F.col(vector)
    good = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & good & F.exists(c, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, with zeros after the shorter ones."""
    flat = np.asarray(column.flatten(), np.float64)
    sizes = np.diff(np.asarray(column.offsets))
    if len(flat) == len(sizes) * width:
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), ranges(np.zeros(len(sizes), np.int64), sizes)] = flat
    return out


def best(scored: DataFrame, k: int) -> DataFrame:
    """The first k of each query of (query, vec_id, row, score, ...), with their rank. Spark limits each group before the shuffle."""
    order = Window.partitionBy("query").orderBy(F.nanvl("score", F.lit(float("-inf"))).desc(), "vec_id", "row")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fitted(rows: DataFrame, n: int, k: int) -> tuple[Coder, int]:
    """The coder for rows (row, vec_id, embedding), and the radius that covers the true neighbours of the sampled queries."""
    width, scale = rows.agg(F.max(F.size("embedding")), F.max(F.array_max(F.transform("embedding", F.abs)))).first()
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + (v / scale) * (v / scale)))
    largest = rows.agg(F.max(size)).first()[0]
    place = F.pmod(F.xxhash64("vec_id", "embedding", F.lit(5)), F.lit(n))
    found = rows.where(place < SAMPLE).orderBy(place, "vec_id", "embedding", "row").limit(SAMPLE).select("row", "embedding").collect()
    sample = np.zeros((len(found), width))
    for at, r in zip(sample, found, strict=True):
        at[: len(r.embedding)] = r.embedding
    coder = Coder(fit(sample / scale)[0], scale, largest)
    asked, numbers = sample[:ASKED], np.array([r.row for r in found[:ASKED]])
    codes = coder.codes(asked, True)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = matrix(batch.column("embedding"), width), np.asarray(batch.column("row"))
            # scaled on both sides, so that no product is infinite
            score = (asked / scale) @ (x / scale).T
            score[numbers[:, None] == own[None]] = -np.inf
            top = np.argpartition(-score, min(k, len(own)) - 1, axis=1)[:, :k] if len(own) else np.zeros((len(asked), 0), np.int64)
            query = np.repeat(np.arange(len(asked)), top.shape[1])
            apart = np.bitwise_count(coder.codes(x, False)[top.ravel()] ^ codes[query]).sum(1)
            kept = np.isfinite(score[query, top.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(v[kept]) for v in (query, own[top.ravel()], score[query, top.ravel()], apart.astype(np.int64))], ["query", "row", "score", "apart"])

    true = best(rows.select("row", "embedding").mapInArrow(near, "query long, row long, score double, apart long").withColumn("vec_id", F.lit(0)), k)
    apart = [r.apart for r in true.select("apart").collect()]  # at most k of each sampled query
    return coder, int(np.ceil(np.quantile(apart, COVER))) if apart else CODE


def nearest(queries: np.ndarray, place: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, inner products) of the first k of vectors (ids, rows) for each of queries, which place names in ascending
    order; ties go to the smaller id, then row."""
    with np.errstate(all="ignore"):
        # summed in one order for every row, so equal vectors have equal scores
        score = (vectors * queries[place]).sum(1)
    order = np.lexsort((rows, ids, -np.where(np.isnan(score), -np.inf, score), place))
    sizes = np.bincount(place)
    order = order[ranges(np.zeros(len(sizes), np.int64), sizes) < k]
    return order, score[order]


def search(rows: DataFrame, queries: Column, k: int = 20, radius: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of rows (vec_id, embedding): the k nearest found of each row where queries holds.

    radius: of the search; fitted to the rows if None, exact from CODE. Rows that repeat a query's id have k answers each,
    all under that id.
    """
    held = rows.select(F.col("vec_id").cast("long"), F.col("embedding").alias("held"), F.col("embedding").cast("array<double>"))
    held = held.where(usable("embedding") & F.col("vec_id").isNotNull())
    # the number of a row is written, so it stays the same whenever rows are read
    stored = written(held.select("vec_id", F.col("held").alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")), "vectors")
    held = stored.select("row", "vec_id", "asks", F.col("embedding").cast("array<double>"))
    n = held.count()
    if n < 2:
        return rows.sparkSession.createDataFrame([], OUT)
    coder, fit_radius = fitted(held, n, k)
    radius = fit_radius if radius is None else radius
    width = len(coder.rotation) - 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, asks = matrix(batch.column("embedding"), width), np.asarray(batch.column("asks"))
            codes, own = coder.codes(x, False), coder.codes(x, True)
            asked = [c.tobytes() if a else None for c, a in zip(own, asks.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "embedding")), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(asked, pa.binary())], ["row", "vec_id", "embedding", "code", "asked"])

    # floats stay floats on the way to the shards; products are of doubles in either case
    kind = "array<float>" if stored.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    plain = stored.select("row", "vec_id", F.col("embedding").cast(kind), "asks")
    codes = written(plain.mapInArrow(encode, f"row long, vec_id long, embedding {kind}, code binary, asked binary"), "codes")
    wanted, done = min(k, n - 1), None
    asked = codes.where("asked is not null").select("row", "vec_id", "embedding", "asked")
    while True:
        found = written(best(ranked(codes, asked, n, radius, width, k), k), "neighbours")
        full = found.groupBy("query").count().where(F.col("count") >= wanted).select("query")
        if radius >= CODE or asked.join(full, F.col("row") == F.col("query"), "left_anti").isEmpty():
            found = found if done is None else done.unionByName(found)
            return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        enough = found.join(full, "query", "left_semi")
        done = enough if done is None else done.unionByName(enough)
        asked = written(asked.join(full, F.col("row") == F.col("query"), "left_anti"), "asked")
        radius = min(CODE, radius + MORE)


def ranked(codes: DataFrame, asked: DataFrame, n: int, radius: int, width: int, k: int) -> DataFrame:
    """(query, query_id, row, vec_id, score): of the rows of codes (row, vec_id, embedding, code) within the radius of each of
    asked (row, vec_id, embedding, asked), itself left out, the k nearest that each shard finds. Vectors have so many components at most."""
    per_shard = max(1, min(PER_SHARD, COMPONENTS // width))
    bits = min(SUBSTRING, max(0, (-(-n // per_shard) - 1).bit_length()))
    layout = Layout(bits, radius, {})
    parts = [j for j, t in enumerate(layout.radii) if t >= 0]
    value = [F.conv(F.hex(F.reverse(F.substring("code", 2 * j + 1, 2))), 16, 10).cast("int") for j in parts]
    shard = F.explode(F.array(*[F.shiftright(v, SUBSTRING - bits) + (j << bits) for j, v in zip(parts, value, strict=True)]))
    # of these there is one for 2 * per_shard entries of the index at most
    crowded = codes.select(shard.alias("shard")).groupBy("shard").count().where(F.col("count") > 2 * per_shard).collect()
    layout.splits = {r.shard: -(-r["count"] // per_shard) for r in crowded}
    shared = codes.sparkSession.sparkContext.broadcast(layout)

    def deal(column: str) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            layout = shared.value
            for batch in batches:
                own = np.frombuffer(b"".join(batch.column(column).to_pylist()), "<u8").reshape(-1, CODE // 64)
                rows = np.asarray(batch.column("row"))
                queries = column == "asked"
                for at, shard in layout.of_queries(own) if queries else layout.of_rows(own):
                    split = np.zeros(len(at), np.int64)
                    if layout.splits:
                        times = np.fromiter((layout.splits.get(s, 1) for s in shard.tolist()), np.int64, len(shard))
                        if queries:
                            at, shard, split = np.repeat(at, times), np.repeat(shard, times), ranges(np.zeros(len(at), np.int64), times)
                        else:
                            split = rows[at] % times
                    step = max(1, min(20_000, COMPONENTS // width))
                    for a in range(0, len(at), step):
                        take = pa.array(at[a : a + step])
                        yield pa.RecordBatch.from_arrays([pa.array(shard[a : a + step], pa.int32()), pa.array(split[a : a + step], pa.int32()), pa.array(np.full(len(take), queries)), *(batch.column(c).take(take) for c in ("row", "vec_id", "embedding", column))], ENTRY)

        return run

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shard's rows come first; its queries stream by."""
        now, held, index = None, [], None

        for batch in batches:
            shards, splits, asks = (np.asarray(batch.column(x)) for x in ("shard", "split", "asks"))
            rows, ids = np.asarray(batch.column("row")), np.asarray(batch.column("vec_id"))
            vectors = matrix(batch.column("embedding"), width)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), "<u8").reshape(-1, CODE // 64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shards) | np.diff(splits) | np.diff(asks.astype(np.int8))) + 1, [len(shards)]]).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if now != (shards[a], splits[a]):
                    now, held, index = (shards[a], splits[a]), [], None
                if not asks[a]:
                    held.append((codes[a:b], rows[a:b], ids[a:b], vectors[a:b]))
                    continue
                if not held:
                    continue
                if index is None:
                    own_codes, own_rows, own_ids, own_vectors = (np.concatenate(x) for x in zip(*held, strict=True))
                    index, held = Index(own_codes, int(now[0]), shared.value), held[:1]
                found, size = [], 0
                for at in range(a, b):
                    near = index.within(codes[at])
                    found.append(near[own_rows[near] != rows[at]])
                    size += len(found[-1])
                    if size * width < COMPONENTS and at + 1 < b:
                        continue
                    # as many queries at once as find about so many components
                    near, first = np.concatenate(found), at + 1 - len(found)
                    place = first + np.repeat(np.arange(len(found)), [len(x) for x in found])
                    order, score = nearest(vectors, place, own_vectors[near], own_ids[near], own_rows[near], k)
                    near, place = near[order], place[order]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[place], ids[place], own_rows[near], own_ids[near], score)], FOUND)
                    found, size = [], 0

    vector = codes.schema["embedding"].dataType.simpleString()
    kind = f"shard int, split int, asks boolean, row long, vec_id long, embedding {vector}, code binary"
    entries = codes.select("row", "vec_id", "embedding", "code").mapInArrow(deal("code"), kind).unionByName(asked.mapInArrow(deal("asked"), kind))
    tasks = max(len(parts), (len(parts) << bits) // 4)
    sorted_entries = entries.repartition(tasks, "shard", "split").sortWithinPartitions("shard", "split", "asks")
    return sorted_entries.mapInArrow(look_up, "query long, query_id long, row long, vec_id long, score double")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found of every twentieth vector."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
