"""A convolutional text classifier for toxicity, trained in numpy.

Words (runs of letters, lower-cased) have three features: the 64-bit hashes of the word, of its first four and of its first
five letters, so inflected forms share what their stems show. The features that tell most about the label (by the normal
score of their toxic training texts) have embeddings, all others share a zero embedding; a word's embedding is the sum over
its features. Filters of several widths run over the embeddings of a text, the maximum of each filter over the text is kept
(max pooling), and a linear layer gives a logit. Stretches of words without features, which add nothing, are shortened.
Embeddings start with the log odds of the feature among toxic training texts in one dimension; everything is then trained
by Adam on cross entropy.

Thresholds are calibrated by language: for each language that the text itself shows (by the word scores of the language
operator) the logit that gives the best F0.5 on all labelled training rows that the weights have not seen, counted by fine
steps of the logit, or the overall one where a language has too few; above all logits if none is right at least half of
the time. The score is the logistic function of the logit less that threshold, so 0.5 is the threshold.

Labels are learned only from training rows; weights in a sample by the hash of the id of about ``POSITIVES`` and
``NEGATIVES`` texts, of ``SAMPLE_CHARS`` characters each at most: bounded and the same in any order of the rows. Of several labels of a document the largest counts; null labels are ignored.
Null and empty texts get a score like any text without known words. Without a label of each kind, every score is 0.
Repeated rows are scored each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passplane.llm import language
from passplane.llm.base import annotated, by_size, documents, is_held_out, is_training_row, segment_sums, texts_of
from passplane.llm.words import HashTable, hashes

#: Training texts of each label, on average; texts a feature must occur in to have an embedding, and its least normal score;
#: features that have one; leading letters.
POSITIVES, NEGATIVES, LEAST_TEXTS, LEAST_SCORE, VOCABULARY, PREFIXES = 2000, 4000, 3, 3.0, 8192, (4, 5)
#: Characters of the training texts of each label at most; what does not fit in the order of the ids' hashes is left to the
#: thresholds.
SAMPLE_CHARS = 16_000_000
#: Ids of labelled rows (8 bytes each) up to which they are sent to every task; more meet the texts in a shuffle.
BROADCAST_IDS = 2_000_000
#: Steps that a logit of 1 is counted in, and the largest logit that is told from larger ones.
STEPS, LARGEST = 64, 128
#: Dimensions of an embedding, filter widths, filters of each width, passes over the training texts.
DIMENSIONS, WIDTHS, FILTERS, EPOCHS = 8, (1, 2, 3), 12, 5


@dataclass
class Text:
    """Features (words, 3) of texts end to end, how many words each text has, and each text's language."""

    words: np.ndarray
    counts: np.ndarray
    lang: np.ndarray


def prepare(texts: list[str], model: language.Model) -> Text:
    """Hashes the words of the texts and tells their languages from their words' scores (-1: none)."""
    w = language.words_of(texts)
    counts = np.bincount(w.text_of, minlength=len(texts))
    lang = np.full(len(texts), -1)
    if len(model.languages) and len(w.starts):
        lang = np.where(counts > 0, segment_sums(model.scores(w), counts).argmax(1), -1)
    salt = [np.uint64(0), *(np.uint64(k) << np.uint64(56) for k in PREFIXES)]
    stops = [w.stops, *(np.minimum(w.stops, w.starts + k) for k in PREFIXES)]
    return Text(np.stack([hashes(w.low, w.starts, x) ^ y for x, y in zip(stops, salt, strict=True)], axis=1), counts, lang)


@dataclass
class Net:
    """The network. table: rows of embeddings by feature (row 0: all other features and the margins)."""

    table: HashTable
    embedding: np.ndarray
    filters: list[np.ndarray]  # by width: (width, dimensions, filters)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    thresholds: dict[int, float] = field(default_factory=dict)

    def rows(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The embedding rows (words, 3) that matter and how many words each text keeps.

        Words without features go, but for as many on either side of the others as keep windows apart.
        """
        flat = words.ravel()
        slot = self.table._find(flat)
        rows = np.where(self.table.keys[slot] == 0, 0, self.table.values[slot] + 1).reshape(words.shape)
        near = rows.any(axis=1)
        for _ in range(max(WIDTHS) - 1):
            wide = near.copy()
            wide[1:] |= near[:-1]
            wide[:-1] |= near[1:]
            near = wide
        return rows[near], segment_sums(near.astype(np.int64), counts)

    def logits(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The logit of each text."""
        return self.forward(*self.rows(words, counts), self.tables())[0]

    def tables(self) -> list[list[np.ndarray]]:
        """By width and place in the window: what each embedding row adds to the filters."""
        return [[self.embedding @ f[j] for j in range(len(f))] for f in self.filters]

    def forward(self, rows: np.ndarray, counts: np.ndarray, tables: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Logits, pooled features, by width the responses, and the padded rows. Every text has a margin of row 0 after it."""
        margin = max(WIDTHS)
        ends = np.cumsum(counts + margin)
        padded = np.zeros((int(ends[-1]) + margin if len(ends) else margin, rows.shape[1]), np.int64)
        padded[np.arange(len(rows)) + margin * np.repeat(np.arange(len(counts)), counts)] = rows
        n = len(padded) - margin
        responses, pooled = [], []
        for table, bias in zip(tables, self.bias, strict=True):
            r = np.zeros((n, FILTERS), np.float32)
            for j in range(len(table)):
                for k in range(padded.shape[1]):
                    r += table[j][padded[j : n + j, k]]
            responses.append(r)
            pooled.append(np.maximum(np.maximum.reduceat(r, ends - counts - margin, axis=0) + bias, 0) if len(counts) else np.zeros((0, FILTERS)))
        feature = np.concatenate(pooled, axis=1)
        return feature @ self.out + self.out_bias[0], feature, responses, padded


def train(data: Text, labels: np.ndarray, weight: np.ndarray, seed: int = 3) -> Net:
    """Trains on texts with labels 0 and 1; weight: of each text."""
    rng = np.random.default_rng(seed)
    begin = np.cumsum(data.counts) - data.counts
    own = [np.unique(data.words[a : a + n]) for a, n in zip(begin.tolist(), data.counts.tolist(), strict=True)]
    distinct, which = np.unique(np.concatenate(own) if own else np.zeros(0, np.uint64), return_inverse=True)
    texts = np.bincount(which, minlength=len(distinct))
    toxic = np.bincount(which, np.repeat(labels, [len(x) for x in own]), len(distinct))
    del own, which
    rate = labels.mean()
    normal = np.abs(toxic - texts * rate) / np.sqrt(texts * rate * (1 - rate) + 1)
    keep = np.flatnonzero((texts >= LEAST_TEXTS) & (normal >= LEAST_SCORE))
    keep = keep[np.argsort(-normal[keep], kind="stable")][:VOCABULARY]
    table = HashTable()
    number, _ = table.of(distinct[keep])
    odds = np.log((toxic[keep] + rate) / (texts[keep] + 1) / rate)
    embedding = np.zeros((len(keep) + 1, DIMENSIONS), np.float32)
    embedding[number + 1] = rng.normal(0, 0.05, (len(keep), DIMENSIONS))
    embedding[number + 1, 0] = np.clip(odds, -3, 3)
    filters = [rng.normal(0, 0.15, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :4] += 0.5 / len(f) ** 0.5
    net = Net(table, embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.2, FILTERS * len(WIDTHS)).astype(np.float32), np.array([np.log(rate / (1 - rate))], np.float32))
    rows, kept = net.rows(data.words, data.counts)
    begin = np.cumsum(kept) - kept
    # Adam: first and second moments of every parameter
    params = [net.embedding, *net.filters, *net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(EPOCHS):
        for chosen in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 48)):
            counts = kept[chosen]
            own = np.concatenate([rows[a : a + n] for a, n in zip(begin[chosen], counts, strict=True)]) if len(chosen) else rows[:0]
            logit, feature, responses, padded = net.forward(own, counts, net.tables())
            slope = ((1 / (1 + np.exp(-logit)) - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            grads = [np.zeros_like(p) for p in params]
            grads[-2], grads[-1] = feature.T @ slope, slope.sum(keepdims=True)
            back = slope[:, None] * net.out[None] * (feature > 0)
            stops = np.cumsum(counts + max(WIDTHS))
            for k, width in enumerate(WIDTHS):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                best = np.stack([r0 + responses[k][r0:r1].argmax(0) for r0, r1 in zip(np.concatenate([[0], stops[:-1]]), stops, strict=True)])
                grads[1 + len(WIDTHS) + k] = part.sum(0)
                for j in range(width):
                    at_row = padded[best + j]  # (texts, filters, features)
                    grads[1 + k][j] = np.einsum("tf,tfd->df", part, net.embedding[at_row].sum(2))
                    slopes = np.repeat(part[:, :, None, None] * net.filters[k][j].T[None, :, None], at_row.shape[2], axis=2)
                    np.add.at(grads[0], at_row.ravel(), slopes.reshape(-1, DIMENSIONS))
            grads[0][0] = 0
            step += 1
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def best_threshold(logit: np.ndarray, label: np.ndarray, weight: np.ndarray, near: float = 0.005) -> float:
    """The middle of the logits around the best F0.5 (precision counts twice) at which it stays near it.

    Above all logits if no threshold is right for half of the texts that pass it: then nothing was learned.
    """
    order = np.argsort(-logit, kind="stable")
    x, hit, w = logit[order], (label * weight)[order], weight[order]
    true, passed = np.cumsum(hit), np.cumsum(w)
    f = 1.25 * true / np.maximum(0.25 * hit.sum() + passed, 1e-9)
    f[true < 0.5 * passed] = 0
    cut, ends = np.append((x[:-1] + x[1:]) / 2, x[-1] - 1), np.append(x[:-1] != x[1:], True)
    f, cut = f[ends], cut[ends]
    if not f.any():
        return float(x[0] + 1)
    first = last = int(f.argmax())
    while first > 0 and f[first - 1] >= f.max() - near:
        first -= 1
    while last + 1 < len(f) and f[last + 1] >= f.max() - near:
        last += 1
    return float((cut[first] + cut[last]) / 2)


def calibrate(net: Net, logit: np.ndarray, lang: np.ndarray, labels: np.ndarray, weight: np.ndarray, counts: np.ndarray | None = None, least: int = 25) -> None:
    """Sets the threshold of each language (None of its own: key -2, the overall one).

    counts: how many texts each entry stands for, one each if None; least: toxic texts that a language needs.
    """
    counts = np.ones(len(logit), np.int64) if counts is None else counts
    net.thresholds = {-2: best_threshold(logit, labels, weight * counts) if labels.any() else 0.0}
    for k in np.unique(lang).tolist():
        own = lang == k
        if (labels * counts)[own].sum() >= least:
            net.thresholds[k] = best_threshold(logit[own], labels[own], (weight * counts)[own])


@dataclass
class Model:
    """What a score needs. net: None if nothing could be learned."""

    net: Net | None
    lang: language.Model

    def scores(self, texts: list[str]) -> np.ndarray:
        """The score of each text."""
        if self.net is None:
            return np.zeros(len(texts))
        out = []
        for a, b in by_size(texts, self.lang.at_once(500_000)):
            data = prepare(texts[a:b], self.lang)
            shift = np.array([self.net.thresholds.get(x, self.net.thresholds[-2]) for x in data.lang.tolist()])
            out.append(1 / (1 + np.exp(-np.clip(self.net.logits(data.words, data.counts) - shift, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def learn(rows: list[tuple[str, int, bool, float]], lang: language.Model) -> Model:
    """From (text, label, for calibration, weight) of labelled rows. Calibrated on these rows alone."""
    labels, later, weight = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
    if not rows or labels.min() == labels.max():
        return Model(None, lang)
    if len(set(labels[~later].tolist())) < 2 or len(set(labels[later].tolist())) < 2:
        later[:] = False
    texts = [r[0] for r in rows]

    def part(own: np.ndarray) -> Text:
        parts = [prepare([texts[k] for k in own[a:b]], lang) for a, b in by_size([texts[k] for k in own], lang.at_once(500_000))]
        return Text(*(np.concatenate([getattr(p, x) for p in parts]) for x in ("words", "counts", "lang")))

    fitting, held = np.flatnonzero(~later), np.flatnonzero(later if later.any() else ~later)
    net = train(part(fitting), labels[fitting], np.ones(len(fitting)))
    data = part(held)
    calibrate(net, net.logits(data.words, data.counts), data.lang, labels[held], weight[held])
    return Model(net, lang)


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, later): the training rows' labels; a quarter is kept from the weights."""
    known = labels.where(is_training_row() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marked = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    return marked.withColumn("later", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0)


def steps_of(docs: DataFrame, ids: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, step) of the rows of docs that have one of the ids: the language that the text shows and the logit in steps. Other texts do not reach Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            lang, step = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int32)
            for a, b in by_size(texts, shared.value.lang.at_once(500_000)):
                data = prepare(texts[a:b], shared.value.lang)
                lang[a:b] = data.lang
                step[a:b] = np.floor(np.clip(shared.value.net.logits(data.words, data.counts), -LARGEST, LARGEST) * STEPS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang), pa.array(step)], ["doc_id", "lang", "step"])

    own = docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi")
    return own.mapInArrow(run, "doc_id long, lang int, step int")


def fit(docs: DataFrame, labels: DataFrame, lang: language.Model) -> Model:
    """Learns from docs (doc_id, text) and labels (doc_id, toxic): weights from a sample of at most three quarters of the
    labelled training rows, thresholds from all the others."""
    spark = docs.sparkSession
    marked = labelled(labels)
    known = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    share = {k: min(1.0, most / max(1, known.get(k, 0))) for k, most in ((0, NEGATIVES), (1, POSITIVES))}
    place = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 20))
    in_sample = place < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]) * (1 << 20)
    # the sample is bounded by its shares, so its ids can be broadcast; then by its characters, in the order of the hashes
    marks = "doc_id long, toxic int, later boolean"
    drawn = spark.createDataFrame([tuple(r) for r in marked.where(in_sample).collect()], marks)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    sizes = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic", "later").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    room, ids = {0: SAMPLE_CHARS, 1: SAMPLE_CHARS}, []
    for r in sorted(sizes.withColumn("place", F.xxhash64("doc_id", F.lit(4))).collect(), key=lambda r: (r.place, r.doc_id)):
        if r.chars <= room[r.toxic]:
            room[r.toxic] -= r.chars
            ids.append((r.doc_id, r.toxic, r.later))
    taken_ids = spark.createDataFrame(ids, marks)
    # the characters of the sample are bounded; of the empty texts of one id, one is as good as many
    rows = texts.join(F.broadcast(taken_ids), "doc_id").groupBy("doc_id", "toxic", "later", F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("n"))
    found = sorted((r.doc_id, r.text, r.toxic, r.later) for r in rows.toLocalIterator() for _ in range(r.n if r.text else 1))
    model = learn([(text, toxic, later, 1 / share[toxic]) for _, text, toxic, later in found], lang)
    if model.net is None:
        return model
    # without both labels on both sides, the weights were learned from the whole sample, and all rows calibrate
    split = all(len({toxic for _, _, toxic, later in found if later == side}) == 2 for side in (False, True))
    others = marked.join(F.broadcast(taken_ids.where(~F.col("later"))), "doc_id", "left_anti") if split else marked
    ids = others.select("doc_id")
    if sum(known.values()) <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    counted = steps_of(docs, ids, model).join(others.select("doc_id", "toxic"), "doc_id").groupBy("lang", "step", "toxic").count().collect()
    lang_of, step, toxic, counts = (np.array([r[k] for r in sorted(tuple(r) for r in counted)]) for k in range(4))
    # the weights took more of one label than of the other
    left = np.maximum(1, np.bincount(toxic, counts, 2))
    taken = np.bincount(np.array([y for _, _, y, later in found if split and not later], np.int64), minlength=2)
    weight = (1 + taken / left)[toxic]
    calibrate(model.net, (step + 0.5) / STEPS, lang_of, toxic, weight, counts)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score): each row of docs as one column, and the score of its text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return annotated(docs, lambda texts: [pa.array(shared.value.scores(texts))], "score double")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that score below the threshold; learns from docs (doc_id, text, lang) and labels."""
    return score(docs, fit(docs, labels, language.fit(docs))).where(F.col("score") < 0.5).select("row.*")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), language.fit(docs))
    found = score(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", is_held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
