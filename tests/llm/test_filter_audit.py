"""The filter audit against a simulation of every order."""

import itertools
import re

import duckdb
import pytest

from passplane.llm import filter_audit

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def by_hand(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    rows = [(i, t or "", s or "") for i, t, s in rows]
    good, toxic = ({i for i, *flags in labels if i is not None and flags[k] == 1} for k in (0, 1))

    def fails(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        found = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        return found + "E" * (i is not None and any(t == text and j is not None and j < i for j, t, _ in rows))

    marked = [(i, p, fails(i, t)) for i, t, p in rows]
    out = {}
    for part in {p for _, p, _ in marked}:
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(i, f) for i, p, f in marked if p == part]
            gone = []
            for step, c in enumerate(order, 1):
                now = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                alone = sum(f == c for _, p, f in marked if p == part)
                out[part, order, step] = [len(left), len(now), sum(c in f for _, f in gone), alone, sum(i in good for i, _ in now), sum(i in toxic for i, _ in now)]
                total[c] += len(now)
                gone += now
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def run(docs, labels):
    return filter_audit.audit(filter_audit.labelled(filter_audit.failures(docs), labels), "ABCDE")


def test_every_order_by_hand(spark, sf_dir):
    want = by_hand([tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()], [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()])
    assert got(filter_audit.op11_filter_audit(spark, sf_dir)) == want
    with duckdb.connect() as con:
        for name in ("documents", "labels"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        found = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({filter_audit.ORACLE_SQL})").fetchall()
    assert sorted(found) == want


def test_odd_rows_repeated_labels_and_null_parts(spark, odd, nothing):
    marks = [(1, 1, 0), (1, 1, 1), (8, 0, 1), (None, 1, 1), (5, None, None), (6, 1, None), (99, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    more = spark.createDataFrame([(20, "UPPER & more", None), (21, "UPPER & more", "s"), (None, "UPPER & more", ""), (None, None, None), (22, "🦆A", "t"), (20, "UPPER & more", None)], "doc_id long, text string, source string")
    docs = odd.select("doc_id", "text", "source").union(more)
    assert got(run(docs, labels)) == by_hand([tuple(r) for r in docs.collect()], marks)
    assert run(nothing, labels).count() == 0
    assert got(run(odd, labels.limit(0))) == by_hand([tuple(r) for r in odd.select("doc_id", "text", "source").collect()], [])


@pytest.mark.parametrize("filters", [1, 2, 3, 5])
def test_intervals_cover_each_order_once(filters):
    """Every mask is removed once in every order, at its first filter."""
    orders = list(itertools.permutations(range(filters)))
    found = {}
    for mask, step, begin, end in filter_audit.intervals(filters):
        for rank in range(begin, end):
            assert (mask, rank) not in found
            found[mask, rank] = step
    assert found == {(m, k): next(s for s, x in enumerate(p, 1) if m >> x & 1) for m in range(1, 1 << filters) for k, p in enumerate(orders)}
