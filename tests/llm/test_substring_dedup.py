"""Substring deduplication against a count of every window."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np

from passplane.llm import substring_dedup as sd
from passplane.llm.base import documents


def by_hand(rows):
    """rows: (doc_id, text). Gives (doc_id, n_words, n_removed, kept)."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    places = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - 34) if places[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        out.append((doc_id, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept")) for r in df.collect()), key=str)


def test_given_documents_by_hand_and_sql(spark, sf_dir):
    want = by_hand([tuple(r) for r in documents(spark, sf_dir).select("doc_id", "text").collect()])
    assert sum(r[2] for r in want) > 0
    want = sorted((*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in want)
    assert sorted(tuple(r) for r in sd.op13_substring_dedup(spark, sf_dir).collect()) == want
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        assert sorted(tuple(x) for x in con.execute(sd.ORACLE_SQL).fetchall()) == want


def mixture(seed):
    """Texts of shared passages, near copies, runs of one word, and pieces that end or begin with a text."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(rng.choice([2, 8, 400]))]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([20, 34, 35, 36, 60, 200]))] for _ in range(6)]
    rows = []
    for k in range(60):
        words = []
        for _ in range(rng.randrange(4)):
            piece = list(rng.choice(passages))
            kind = rng.randrange(5)
            if kind == 0:
                piece = piece[rng.randrange(len(piece)) :]
            elif kind == 1:
                piece[rng.randrange(len(piece))] = f"new{rng.random()}"
            elif kind == 2:
                piece = [rng.choice(vocabulary) for _ in range(rng.randrange(80))]
            elif kind == 3:
                piece = ["same"] * rng.randrange(90)
            words += piece
        rows.append((rng.choice([k, 5, None]), " ".join(words)))
    return rows + rows[:3]


def test_random_mixtures(spark):
    for seed in range(6):
        rows = mixture(seed)
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        found = sd.without_repeats(table)
        assert got(found) == by_hand(rows), seed


def test_odd_rows_and_spans(spark, odd, odd_rows, nothing):
    long = " ".join(f"p{k}" for k in range(50))
    more = spark.createDataFrame([(30, f"a b\tc  {long}\n end"), (31, f"{long} 你好"), (None, f"x {long}"), (32, None)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(more)
    found = sd.without_repeats(docs)
    assert got(found) == by_hand([(r.doc_id, r.text) for r in docs.collect()])
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in found.collect() if r.doc_id in (5, 30, 31)}
    assert spans == {5: [], 30: [(3, 53)], 31: [(0, 50)]}
    assert sd.without_repeats(nothing).count() == 0
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept", "spans"]
    assert got(sd.without_repeats(odd)) == by_hand([tuple(r) for r in odd.select("doc_id", "text").collect()])


def test_anchors_depend_on_the_window_alone():
    rng = random.Random(1)
    shared = [rng.choice("abc") for _ in range(35)]
    chosen = set()
    for _ in range(30):
        before = [rng.choice("abcd") for _ in range(rng.randrange(60))]
        text = " ".join([*before, *shared, *(rng.choice("abcd") for _ in range(rng.randrange(60)))])
        g = sd.Graph([b"", text.encode(), b"q " * 40])
        at = int(np.flatnonzero(g.windows == len(before))[0])
        chosen.add(int(g.anchors[g.chosen[at]]) - len(before))
    assert len(chosen) == 1
