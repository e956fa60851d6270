"""Ranked search against scoring of every pair."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest

from passplane.llm import ranked_search
from passplane.llm.base import documents


def terms_by_hand(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def by_hand(docs, items, k=10):
    """docs: (doc_id, text); items: (item_id, text)."""
    counts = [(i, collections.Counter(terms_by_hand(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    held = collections.Counter(w for _, c, _ in counts for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counts:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w in terms_by_hand(text) if w in c)
            if score > 0:
                scores.append((-score, i is None, i, score))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, i, score) for rank, (_, _, i, score) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=str)


def test_search_by_hand_and_sql(spark, sf_dir):
    docs = [tuple(r) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = by_hand(docs, items)
    assert got(ranked_search.op12_ranked_search(spark, sf_dir)) == want
    with duckdb.connect() as con:
        for name in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        assert sorted((tuple(x) for x in con.execute(ranked_search.ORACLE_SQL).fetchall()), key=str) == want


def test_odd_rows(spark, odd, nothing, monkeypatch):
    many = " ".join(f"palabra{k}" for k in range(97)) + " words WORDS the"
    items = [(1, "The same words, same words!"), (1, "same_words"), (2, None), (3, " \t"), (None, "id"), (4, many), (5, "nowhere"), (6, "你好 мир TEXT x")]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = by_hand(rows, items, 3)
    assert got(ranked_search.search(odd, table, 3)) == want
    assert {x for i, _, x, _ in want if i == 1} >= {5, 6, 7}
    assert ranked_search.search(nothing, table).count() == 0
    assert ranked_search.search(odd, table.limit(0)).count() == 0
    # several blocks of items, each with its own pass
    monkeypatch.setattr(ranked_search, "ITEM_CHARS", 400)
    assert got(ranked_search.search(odd, table, 3)) == want


@pytest.mark.parametrize(("size", "terms"), [(8, 5), (100, 40), (500, 150)])
def test_blocks_skip_documents_and_lose_none(size, terms):
    """Scores of skipped groups are too low; ties go by id; masks may have more than 64 bits."""
    rng = random.Random(size)
    docs = [(rng.choice([None, *range(size)]), [rng.choice(range(2 * terms)) ** 2 // (2 * terms) for _ in range(rng.choice([1, 5, 40]))]) for _ in range(4 * size)]
    n = np.array([len(w) for _, w in docs])
    held = collections.Counter(w for _, ws in docs for w in set(ws))
    known = ranked_search.Statistics(len(docs), int(n.sum()), np.array([math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * held[w] + 1))) for w in range(2 * terms)]))
    asked, times = np.arange(0, terms), 1 + np.arange(terms) % 3
    best, scored = ranked_search.Best(10), 0
    for a in range(0, len(docs), size):
        part = docs[a : a + size]
        counts = [sorted(collections.Counter(w).items()) for _, w in part]
        term, tf = (np.array([x[k] for c in counts for x in c], np.int64) for k in (0, 1))
        block = ranked_search.Block(n[a : a + size], np.array([len(c) for c in counts]), term, tf, known)
        ids = [i for i, _ in part]
        scored += ranked_search.search_block(block, np.array([i or 0 for i in ids]), np.array([i is None for i in ids]), asked, times, best)
    words = [(i, " ".join(f"w{x}" for x in w)) for i, w in docs]
    want = by_hand(words, [(0, " ".join(f"w{t}" for t, c in zip(asked.tolist(), times.tolist(), strict=True) for _ in range(c)))])
    found = [(0, rank, None if missing else i, s) for rank, (i, missing, s) in enumerate(zip(best.doc_id.tolist(), best.missing.tolist(), best.score.tolist(), strict=True), 1)]
    assert sorted(found, key=str) == want
    if size == 500:
        assert scored < len(docs) / 2
