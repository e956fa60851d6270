"""Filter interaction audit: what each of several filters removes, in every order in which they can be applied.

A document fails some of the filters, its *mask*. An order is a permutation of the filters, ranked as in a dictionary (by its
Lehmer code). A document is removed at the step of the first filter of the order that is in its mask: all orders that begin
with the same ``step - 1`` filters outside the mask, followed by one inside, remove it there, and the ranks of those orders
are one interval. So every mask gives a few intervals for each step (840 for all masks of five filters); its count
is added where an interval begins and taken away where it ends, and a running sum over the ranks gives the number removed in
every order and step. No document meets an order: documents are counted by (part, mask, labels) before.

Each filter is a condition on a row's text; one, which says whether the text is also that of a row with a smaller doc_id, needs
other rows. That one is found without bringing equal texts together: the smallest id of each text (pre-aggregated by digest)
is joined to the row of that id, by digest and id, so many copies of a text are spread. Rows are then counted by id, part and mask
before they meet their labels.

Null texts are empty, null sources the empty part. A null doc_id is neither smaller nor larger than another and has no labels;
rows that repeat an id and text are both the first of it. An id with several labels counts as good or toxic if any of them
says so; repeated labels count once. Each row is a document. An empty table gives no rows; labels may be empty. Other
columns are ignored.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passplane.llm.base import documents, written

#: The letter of the filter that compares rows; the others are conditions on a text.
REPEATED = "E"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def conditions() -> dict[str, Column]:
    """The failure conditions on column `text`, by letter; `words` are its words."""
    words, text = F.col("words"), F.col("text")
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": (F.length(text) - F.length(F.translate(text, _CAPITALS, ""))) * 100 > F.length(text) * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, own: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, part, mask, n): how many rows of an id and part fail which filters; bit k of mask is the k-th letter, the last
    one `REPEATED`. docs: doc_id, text, source. own: the conditions on columns `text` and `words`."""
    own = own or conditions()
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), ""))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(own.values())), F.lit(0))
    rows = written(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask")), "masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    # rows of one digest and id are counted before they are dealt, so a repeated row costs a task one row
    counted = rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    again = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 1 << len(own)).otherwise(0)
    marked = counted.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + again)
    return marked.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def labelled(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): counts of the rows of `failures`. labels: doc_id, quality, toxic."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    return failed.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.coalesce(F.sum(F.col("n") * F.col(x)), F.lit(0)).alias(x) for x in ("good", "toxic")])


def intervals(filters: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, begin, end): the ranks of orders that remove a document of the mask at the step. One interval for every
    sequence of step - 1 filters outside the mask and one inside."""
    out = []
    for mask in range(1, 1 << filters):
        outside = [k for k in range(filters) if not mask >> k & 1]
        for step in range(1, len(outside) + 2):
            below = math.factorial(filters - step)
            for before in itertools.permutations(outside, step - 1):
                for last in (k for k in range(filters) if mask >> k & 1):
                    begin = _rank((*before, last), filters)
                    out.append((mask, step, begin, begin + below))
    return out


def _rank(prefix: tuple[int, ...], filters: int) -> int:
    """The rank of the first order that begins with the prefix: the sum of its Lehmer digits, weighted by factorials."""
    return sum(sum(other < x and other not in prefix[:at] for other in range(filters)) * math.factorial(filters - 1 - at) for at, x in enumerate(prefix))


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """The result columns of op11 for every part, order and step. counts: (part, mask, n, good, toxic), bits of mask as in letters."""
    spark, n = counts.sparkSession, len(letters)
    ranks, steps, kinds = math.factorial(n), range(1, n + 1), ("n", "good", "toxic")
    # fixed by the number of filters alone: 1,680 ends of intervals and 120 orders for five
    ends = [(m, s, at, sign) for m, s, begin, end in intervals(n) for at, sign in ((begin, 1), (end, -1)) if at < ranks]
    ends = F.broadcast(spark.createDataFrame(ends, "mask int, step int, rank int, sign int"))
    orders = F.broadcast(spark.createDataFrame([(k, "".join(p)) for k, p in enumerate(itertools.permutations(letters))], "rank int, filter_order string"))
    changes = counts.join(ends, "mask").select("part", "rank", "step", *[(F.col(x) * F.col("sign")).alias(x) for x in kinds])
    nothing = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank"), F.lit(1).alias("step"), *[F.lit(0).cast("long").alias(x) for x in kinds])
    at_rank = changes.union(nothing).groupBy("part", "rank").agg(*[F.sum(F.when(F.col("step") == s, F.col(x)).otherwise(0)).alias(f"{x}{s}") for x in kinds for s in steps])
    so_far = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removed = at_rank.select("part", "rank", *[F.sum(f"{x}{s}").over(so_far).alias(f"{x}{s}") for x in kinds for s in steps]).join(orders, "rank")
    # a filter's total over all orders is the sum of what its step removes in each
    whole = Window.partitionBy("part")
    total = {c: F.sum(sum((F.when(F.substring("filter_order", s, 1) == c, F.col(f"n{s}")).otherwise(0) for s in steps), F.lit(0))).over(whole) for c in letters}
    removed = removed.withColumns({f"shapley_{c}": x for c, x in total.items()})
    fails = {f"{kind}_{c}": F.sum(F.when(test(k), F.col("n")).otherwise(0)) for k, c in enumerate(letters) for kind, test in (("fails", lambda k: F.col("mask").bitwiseAND(1 << k) != 0), ("alone", lambda k: F.col("mask") == 1 << k))}
    sizes = counts.groupBy("part").agg(F.sum("n").alias("documents"), *[x.alias(name) for name, x in fails.items()])
    rows = removed.join(sizes, "part")

    def of(kind: str, letter: Column) -> Column:
        return F.coalesce(*[F.when(letter == c, F.col(f"{kind}_{c}")) for c in letters])

    each = []
    for s in steps:
        letter, gone = F.substring("filter_order", s, 1), F.col(f"n{s}")
        fields = {
            "step": F.lit(s), "kept": F.col("documents") - sum((F.col(f"n{k}") for k in range(1, s + 1)), F.lit(0)), "removed": gone, "redundant": of("fails", letter) - gone,
            "unique_fails": of("alone", letter), "good_lost": F.col(f"good{s}"), "toxic_lost": F.col(f"toxic{s}"), "shapley": of("shapley", letter),
        }
        each.append(F.struct(*[c.cast("int" if name == "step" else "long").alias(name) for name, c in fields.items()]))
    return rows.select("part", "filter_order", F.inline(F.array(*each)))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents in all 120 orders, by source."""
    counts = labelled(failures(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return audit(written(counts, "mask-counts"), "".join(conditions()) + REPEATED)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
m AS (SELECT doc_id, part, CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
  WHERE b.f <> a.f AND c.f NOT IN (a.f, b.f) AND d.f NOT IN (a.f, b.f, c.f) AND e.f NOT IN (a.f, b.f, c.f, d.f)),
r AS (SELECT part, fails, n, good, toxic, filter_order, coalesce(list_min([strpos(filter_order, f) FOR f IN string_split(fails, '') IF f <> '']), 6) AS gone FROM c, o),
s AS (SELECT part, filter_order, step::INT AS step, filter_order[step] AS f, sum(n) FILTER (gone > step) AS kept, sum(n) FILTER (gone = step) AS removed,
  sum(n) FILTER (contains(fails, filter_order[step]) AND gone < step) AS redundant, sum(n) FILTER (fails = filter_order[step]) AS unique_fails,
  sum(good) FILTER (gone = step) AS good_lost, sum(toxic) FILTER (gone = step) AS toxic_lost FROM r, range(1, 6) AS k(step) GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM s
"""
