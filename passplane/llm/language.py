"""Language identification: script ranges narrow the candidates, Viterbi over word scores labels spans.

A word is a run of letters and marks with a letter at least. Its score for a language is the sum over its characters of
the log share, in that language's training texts, of the trigram that ends there, word ends included. Scripts by ranges of
code points narrow a word's candidates to the languages that use the script; a script that no language uses rules nothing
out. The best labelling of a text's words, with a penalty for each change of language, is found by Viterbi's recursion, one
step for the same word of many texts. The prediction is the language that holds most letters (ties: the first by name), its
score the share of letters that it holds.

Learned only from text and non-null lang of training rows: of every language, the ``PER_LANGUAGE`` rows of the least hashes of
id and text, or all if there are fewer; so bounded by a count, the same in any order of the rows, and no id or its absence decides
for all of its rows. Rows that are equal in both count once. Tasks count trigrams, one language after the other; the counts that are not 0 reach the driver,
whatever the texts' lengths. There is no limit on the number of languages: many have their scores as lists of the buckets that they know. Null
texts and texts without a letter (general category L) are ``und`` with score 0; so is everything if nothing can be learned. Repeated rows are scored each. Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passplane.llm.base import CHARS_AT_ONCE, annotated, by_size, documents, is_held_out, is_training_row, ranges, segment_sums, texts_of

#: Training texts of a language at most; trigram buckets; penalty for a change of language; least share of a language's
#: letters in a script that makes it a candidate; languages up to which scores are a matrix and not lists.
PER_LANGUAGE, BUCKETS, PENALTY, SCRIPT_SHARE, DENSE = 1500, 1 << 16, 6.0, 0.01, 256
#: A text is kept if one language holds this share of its letters.
LEAST_SHARE = 0.3

# First and last code point of scripts' letters.
SCRIPTS = [
    (0x41, 0x24F), (0x1E00, 0x1EFF),  # Latin
    (0x370, 0x3FF), (0x1F00, 0x1FFF),  # Greek
    (0x400, 0x52F),  # Cyrillic
    (0x530, 0x58F), (0x590, 0x5FF), (0x600, 0x6FF),  # Armenian, Hebrew, Arabic
    (0x900, 0x97F), (0x980, 0x9FF), (0xA00, 0xA7F), (0xA80, 0xAFF),  # Devanagari, Bengali, Gurmukhi, Gujarati
    (0xB80, 0xBFF), (0xC00, 0xC7F), (0xC80, 0xCFF), (0xD00, 0xD7F),  # Tamil, Telugu, Kannada, Malayalam
    (0xE00, 0xE7F), (0xE80, 0xEFF), (0x10A0, 0x10FF), (0x1200, 0x137F),  # Thai, Lao, Georgian, Ethiopic
    (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF),  # Kana, Han, Hangul
]
#: Ranges that are one script with the range before.
_SAME = {0x1E00, 0x1F00}
_TABLE = 0x32400


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 0 for what is no letter or mark, else 1 + the number of its script; the lower case; whether it is a letter."""
    script, lower, letter = np.zeros(_TABLE, np.uint8), np.arange(_TABLE, dtype=np.uint32), np.zeros(_TABLE, bool)
    for c in range(_TABLE):
        if (kind := unicodedata.category(chr(c))[0]) in "LM":
            script[c] = 255
            letter[c] = kind == "L"
            if len(low := chr(c).lower()) == 1:
                lower[c] = ord(low)
    number = 0
    for first, end in SCRIPTS:
        number += first not in _SAME
        part = script[first : end + 1]
        part[part > 0] = number
    script[script == 255] = number + 1
    return script, lower, letter


_CACHE: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


@dataclass
class Words:
    """Words of texts end to end: begin and end, letters, script and text of each; by place the lower case and a trigram bucket."""

    starts: np.ndarray
    stops: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    text_of: np.ndarray
    low: np.ndarray
    bucket: np.ndarray


def words_of(texts: list[str]) -> Words:
    """The words of the texts."""
    if not _CACHE:
        _CACHE.append(_tables())
    script, lower, is_letter = _CACHE[0]
    cps = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1)
    known = np.minimum(cps, _TABLE - 1)
    own = script[known]
    letter = own > 0
    low = np.where(letter, lower[known], np.uint32(32))
    before = np.concatenate([[np.uint32(32)], low[:-1]])
    twice = np.concatenate([[np.uint32(32)], before[:-1]])
    twice[before == 32] = 32
    mixed = low * np.uint32(0x9E3779B1) ^ before * np.uint32(0x85EBCA6B) ^ twice * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    bucket = (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    change = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    starts, stops = change[::2], change[1::2]
    before_place = np.concatenate([[0], np.cumsum(is_letter[known])])
    letters = before_place[stops] - before_place[starts]
    if not letters.all():  # marks without a letter are no word
        starts, stops, letters = starts[letters > 0], stops[letters > 0], letters[letters > 0]
    return Words(starts, stops, letters, own[starts], np.searchsorted(ends, starts), low, bucket)


@dataclass
class Model:
    """languages in order; what a bucket adds to each language's base, which is the log share of an unseen bucket, as ranges
    `cuts` of (which, more); `logs`, their sums as a matrix, for few languages; candidate languages by script."""

    languages: list[str]
    base: np.ndarray
    cuts: np.ndarray
    which: np.ndarray
    more: np.ndarray
    candidate: np.ndarray
    logs: np.ndarray | None = None

    def at_once(self, most: int) -> int:
        """Characters whose scores are held at once: fewer with many languages."""
        return max(20_000, most * 16 // max(16, len(self.languages)))

    def scores(self, w: Words) -> np.ndarray:
        """Log scores (words, languages). The place after a word counts as its end."""
        n = len(self.languages)
        if not len(w.starts):
            return np.zeros((0, n), np.float32)
        sizes = w.stops - w.starts + 1
        bucket = w.bucket[ranges(w.starts, sizes)]
        if self.logs is not None:
            total = np.add.reduceat(self.logs[bucket], np.cumsum(sizes) - sizes, axis=0)
        else:
            held = self.cuts[bucket + 1] - self.cuts[bucket]
            at = ranges(self.cuts[bucket], held)
            word = np.repeat(np.repeat(np.arange(len(sizes)), sizes), held)
            total = np.bincount(word * n + self.which[at], self.more[at], len(sizes) * n).reshape(-1, n) + sizes[:, None] * self.base
        return (total + np.where(self.candidate[w.script], 0, -1000)).astype(np.float32)


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the trigram buckets and of letters by script in texts of one language."""
    buckets, scripts = np.zeros(BUCKETS, np.int64), np.zeros(256, np.int64)
    for a, b in by_size(texts):
        w = words_of(texts[a:b])
        sizes = w.stops - w.starts + 1
        places = np.repeat(w.starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        buckets += np.bincount(w.bucket[places], minlength=BUCKETS)
        scripts += np.bincount(w.script, w.letters, 256).astype(np.int64)
    return buckets, scripts


def sparse(buckets: np.ndarray, scripts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which buckets there are, their counts, and the letters by script."""
    seen = np.flatnonzero(buckets)
    return seen, buckets[seen], scripts


def model_of(counts: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], dense: int = DENSE) -> Model:
    """A model from each language's buckets, their counts, and letters by script."""
    languages = sorted(counts)
    n = len(languages)
    sums = np.array([counts[x][1].sum() for x in languages], float)
    scripts = np.stack([counts[x][2] for x in languages], axis=1).astype(float) if languages else np.zeros((256, 0))
    candidate = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    candidate[~candidate.any(1)] = True
    base = np.log(0.3 / (sums + 0.3 * BUCKETS))
    bucket = np.concatenate([counts[x][0] for x in languages] or [np.zeros(0, np.int64)])
    which = np.repeat(np.arange(n, dtype=np.int32), [len(counts[x][0]) for x in languages])
    more = np.log1p(np.concatenate([counts[x][1] for x in languages] or [np.zeros(0)]) / 0.3).astype(np.float32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    model = Model(languages, base, cuts, which[order], more[order], candidate)
    if n <= dense:
        model.logs = np.tile(base.astype(np.float32), (BUCKETS, 1))
        model.logs[bucket, which] += more
    return model


def train(rows: list[tuple[str, str]]) -> Model:
    """A model from (language, text) pairs."""
    by: dict[str, list[str]] = {}
    for lang, text in rows:
        by.setdefault(lang, []).append(text)
    return model_of({lang: sparse(*counted(texts)) for lang, texts in by.items()})


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word. scores: (words, labels) of texts end to end; counts: words of each text."""
    labels = np.zeros(len(scores), np.int64)
    if scores.shape[1] < 2 or not len(scores):
        return labels
    order = np.argsort(-counts, kind="stable")
    first, sizes = (np.cumsum(counts) - counts)[order], counts[order]
    active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # texts longer than t
    value = np.zeros((len(counts), scores.shape[1]), np.float32)
    jumps, best_of = [], []
    for t, n in enumerate(active.tolist()):
        v = value[:n]
        best = v.argmax(1)
        top = v[np.arange(n), best] - np.float32(penalty)
        jump = v < top[:, None]
        jumps.append(jump)
        best_of.append(best)
        value[:n] = np.maximum(v, top[:, None]) + scores[first[:n] + t]
    now = value.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        own = now[:n]
        labels[first[:n] + t] = own
        own[jumps[t][np.arange(n), own]] = best_of[t][jumps[t][np.arange(n), own]]
    return labels


def label(model: Model, texts: list[str], spans: bool = False) -> list[tuple]:
    """(language, score, spans) of each text; spans: (first word, last word, language) if asked for, else their number."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    out: list = [None] * len(texts)
    size = len(model.languages)
    ordered = [texts[k] for k in order]
    for a, b in by_size(ordered, model.at_once(CHARS_AT_ONCE)):
        w = words_of(ordered[a:b])
        counts = np.bincount(w.text_of, minlength=b - a)
        labels = viterbi(model.scores(w), counts, PENALTY) if size else np.zeros(len(w.starts), np.int64)
        held = np.bincount(w.text_of * max(size, 1) + labels, w.letters, (b - a) * max(size, 1)).reshape(b - a, -1)
        total, winner = held.sum(1), held.argmax(1)
        new = np.ones(len(labels), bool)
        new[1:] = (labels[1:] != labels[:-1]) | (w.text_of[1:] != w.text_of[:-1])
        runs = segment_sums(new.astype(np.int64), counts)
        begin = np.cumsum(counts) - counts
        for k in range(b - a):
            found: object = int(runs[k])
            if spans:
                cut = [*np.flatnonzero(new[begin[k] : begin[k] + counts[k]]).tolist(), int(counts[k])]
                found = [(x, y - 1, model.languages[labels[begin[k] + x]]) for x, y in zip(cut, cut[1:], strict=False)] if size else []
            known = size and total[k] > 0
            out[order[a + k]] = (model.languages[winner[k]] if known else "und", float(held[k, winner[k]] / total[k]) if known else 0.0, found if known else ([] if spans else 0))
    return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from the training rows of doc_id, text, lang, every language that one of them has."""
    rows = docs.select("doc_id", "text", "lang").where(is_training_row() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("hash")).withColumn("bucket", F.shiftright("hash", 52))
    # of each language the hash buckets, from the least, that surely have enough different rows: pre-aggregated to 4,096 counts
    counts = rows.groupBy("lang", "bucket").agg(F.approx_count_distinct("hash").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    last = counts.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < 2 * per_language).groupBy("lang").agg(F.max("bucket").alias("last")).collect()
    if not last:
        return model_of({})
    # a row for each language, as the model itself has
    last = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in last], "lang string, last long"))
    few = rows.join(last, "lang").where("bucket <= last").groupBy("lang", "hash").agg(F.first("text").alias("text"))
    chosen = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("n") <= per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come language by language."""
        now, buckets, scripts = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def done() -> pa.RecordBatch:
            seen, n, letters = sparse(buckets, scripts)
            return pa.RecordBatch.from_pydict({"lang": [now], "seen": [seen.tobytes()], "n": [n.tobytes()], "scripts": [letters.tobytes()]})

        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), texts_of(batch.column("text"))
            cuts = [k for k in range(len(langs)) if not k or langs[k] != langs[k - 1]] + [len(langs)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if langs[a] != now:
                    if now is not None:
                        yield done()
                    now, buckets, scripts = langs[a], np.zeros(BUCKETS, np.int64), np.zeros(256, np.int64)
                own = counted(texts[a:b])
                buckets, scripts = buckets + own[0], scripts + own[1]
        if now is not None:
            yield done()

    found = chosen.select("lang", "text").mapInArrow(run, "lang string, seen binary, n binary, scripts binary")
    return model_of({r.lang: tuple(np.frombuffer(r[c], np.int64) for c in ("seen", "n", "scripts")) for r in found.toLocalIterator()})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(row, lang_pred, score, n_spans): each row of docs as one column, and what its text shows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(texts: list[str]) -> list[pa.Array]:
        found = label(shared.value, texts)
        return [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int64()))]

    return annotated(docs, kernel, "lang_pred string, score double, n_spans long")


def keep_known(docs: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """The rows whose text has a language that holds at least this share of its letters; learns from docs (text, lang)."""
    return predict(docs, fit(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")


def label_spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, spans): the language of each run of words, by their positions."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = label(shared.value, texts_of(batch.column("text")), spans=True)
            spans = [[{"first": a, "last": b, "lang": x} for a, b, x in s] for _, _, s in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, spans array<struct<first:long,last:long,lang:string>>")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = documents(spark, sf_dir)
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("row.doc_id", is_held_out("row.doc_id").alias("held_out"), "lang_pred", "score", "n_spans")
