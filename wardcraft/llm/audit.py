"""What filters cost each other: for every order of application, what each one removes, repeats and alone rejects.

A document's failures are a mask, a bit a filter; masks are counted per part (source), and all orders and steps are sums over the 32
counters of a part, so documents are read for the masks and never again for an order. Masks of the first filters are Columns. The last
filter rejects repeated texts: rows whose fingerprint stands in several rows (by a table of 2^26 marks, 8 MB) are range-sorted by
fingerprint, full text and doc_id, each is compared with its predecessor, and what a task's last fingerprint holds is handed to the later tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcraft.llm.text import as_batch, only, slices, table
from wardcraft.llm.warc import PLACES, _marks
from wardcraft.plans.shared import materialise

#: Up to so many ends of tasks, of about 50 bytes, are sent to all tasks.
MOST_ENDS = 1 << 20
_WORD = r"[^\x20\x09-\x0D]+"


def conditions(text: Column, least_words: int = 200, distinct: int = 50, capitals: int = 2) -> dict[str, Column]:
    """The failure conditions of A to D over a text without nulls: few words, repeated words, capitals, signs."""
    words = F.regexp_extract_all(text, F.lit(f"({_WORD})"), 1)
    return {
        "A": F.size(words) < least_words,
        "B": 100 * F.size(F.array_distinct(words)) < distinct * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > capitals * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _mask(failures: dict[str, Column]) -> Column:
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failures.values())]
    return sum(bits[1:], bits[0]).cast("int")


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (fp, text, doc_id, part, mask) -> (kind 0, fp, doc_id, part, mask, first, sha), first the smallest doc_id of the text in this task.

    sha is given where an earlier task may hold the text, that is in the task's first fingerprint. After all rows come those of kind 1:
    each text of the task's last fingerprint with its smallest doc_id, for later tasks. One text and one fingerprint's digests are held.
    """
    only(None)
    head = now = text = first = sha = None
    ends: dict[bytes, int | None] = {}
    names, types = ["kind", "fp", "doc_id", "part", "mask", "first", "sha"], [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    for batch in batches:
        for rows in slices(batch):
            firsts, shas = [], []
            fps = rows.column("fp").to_pylist()
            for fp, x, doc_id in zip(fps, rows.column("text").cast(pa.binary()), rows.column("doc_id").to_pylist(), strict=True):
                x = x.as_py()
                if fp != now or x != text:
                    if fp != now:
                        head, ends = (fp if now is None else head), {}
                    now, text, first, sha = fp, x, None, hashlib.sha256(x).digest()
                first = doc_id if first is None else first  # doc_id rises within a text, nulls first
                ends[sha] = first
                firsts.append(first)
                shas.append(sha if fp == head else None)
            yield as_batch(names, types, [[0] * len(fps), fps, rows.column("doc_id"), rows.column("part"), rows.column("mask"), firsts, shas])
    if ends:
        n = len(ends)
        yield as_batch(names, types, [[1] * n, [now] * n, [None] * n, [None] * n, [None] * n, list(ends.values()), list(ends)])


def with_repeats(spark: SparkSession, rows: DataFrame, bit: int) -> DataFrame:
    """rows(fp, text, doc_id, part, mask) -> doc_id, part, mask with the bit set where a smaller doc_id has the same text.

    Ranges are cut by fingerprint and doc_id, so a text that many rows have is dealt to many tasks, and no text is sampled for the
    bounds. A null doc_id is neither smaller than another nor repeated.
    """
    ranged = rows.repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    swept = materialise(spark, ranged.mapInArrow(_repeats, "kind int, fp long, doc_id long, part string, mask int, first long, sha binary"), "swept")
    ends = swept.where("kind = 1").groupBy("fp", "sha").agg(F.min("first").alias("before"))
    # a row per task and each other text that shares its last fingerprint; rows of one text needn't meet in one task for so few
    ends = F.broadcast(ends) if ends.count() <= MOST_ENDS else ends
    least = F.least("first", "before")  # ignores nulls
    failed = F.coalesce(F.col("doc_id") > least, F.lit(False))
    out = swept.where("kind = 0").join(ends, ["fp", "sha"], "left")
    return out.select("doc_id", "part", F.when(failed, F.col("mask").bitwiseOR(F.lit(1 << bit))).otherwise(F.col("mask")).alias("mask"))


def failure_masks(spark: SparkSession, docs: DataFrame, failures=conditions) -> DataFrame:
    """documents -> doc_id, part, mask: bit k of the mask is set where the text fails filter k; the last bit is the repeats'."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("fp", F.xxhash64("text"))
    found = failures(F.col("text"))
    masks = materialise(spark, rows.select("doc_id", "part", _mask(found).alias("mask"), "fp"), "masks")
    place = F.pmod("fp", F.lit(1 << PLACES))
    held = _marks(spark, masks.groupBy("fp").count().where("count > 1").select(place.alias("place")))

    @F.pandas_udf("boolean")
    def shared(place: pd.Series) -> pd.Series:
        k = place.to_numpy(np.int64)
        return pd.Series(held.value[k >> 6] >> (k & 63).astype(np.uint64) & np.uint64(1) == 1)

    again = rows.where(shared(place)).select("fp", "text", "doc_id", "part", _mask(found).alias("mask"))
    return masks.where(~shared(place)).select("doc_id", "part", "mask").unionByName(with_repeats(spark, again, len(found)))


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def orders(letters: str) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


def weights(letters: str) -> np.ndarray:
    """0 or 1 (for shapley: the number of orders) by order, step, count of COUNTS and mask: what a document of a mask adds."""
    every = np.arange(1 << len(letters))
    out = np.zeros((len(orders(letters)), len(letters), len(COUNTS), len(every)), np.int64)
    fails = {x: every >> k & 1 == 1 for k, x in enumerate(letters)}
    size = sum(f.astype(np.int64) for f in fails.values())
    for i, order in enumerate(orders(letters)):
        gone = np.zeros(len(every), bool)
        for j, x in enumerate(order):
            now = fails[x] & ~gone
            # of the orders, the filter comes first among a mask's in one of as many as the mask has
            out[i, j] = [~gone & ~fails[x], now, fails[x] & gone, fails[x] & (size == 1), now, now, np.where(fails[x], len(out) // np.maximum(size, 1), 0)]
            gone |= fails[x]
    return out


def _report(letters: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(None)
        w, n = weights(letters), len(letters)
        of = {"good_lost": 1, "toxic_lost": 2}  # which of a part's counters a count sums
        names = orders(letters)
        for batch in batches:
            for part, found in zip(batch.column("part").to_pylist(), batch.column("counters").to_pylist(), strict=True):
                c = np.zeros((3, 1 << n), np.int64)
                for x in found:
                    c[:, x["mask"]] = x["n"], x["good"], x["toxic"]
                sums = [(w[:, :, k] @ c[of.get(name, 0)]).ravel() for k, name in enumerate(COUNTS)]
                rows = len(names) * n
                yield as_batch(["part", "filter_order", "step", *COUNTS], [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)], [[part] * rows, [x for x in names for _ in range(n)], list(range(1, n + 1)) * len(names), *[pa.array(s) for s in sums]])

    return run


def filter_audit(spark: SparkSession, docs: DataFrame, labels: DataFrame, failures=conditions) -> DataFrame:
    """documents and labels -> part, filter_order, step and the COUNTS: a row per part, order and step, zeros included.

    The filters are those of `failures` (letters to Columns over a text), and the last letter E, repeats. A null text counts as empty, a
    null source as the part ''. Repeated rows count each; they fail E only beside a smaller doc_id. A document is good (toxic) if any of its
    labels has quality (toxic) 1; those without a doc_id have none. Other columns are ignored; an empty table gives no rows.
    """
    letters = "".join([*failures(F.lit("")), "E"])
    seen = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    rows = failure_masks(spark, docs, failures).join(seen, "doc_id", "left")
    counted = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counters"))  # a counter per mask
    return parts.mapInArrow(_report(letters), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e FROM w),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN g USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [p.k, q.k, r.k, s.k, t.k] AS o FROM l p, l q, l r, l s, l t WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5),
z AS (SELECT o, k AS step, o[k] AS own, list_slice(o, 1, k - 1) AS before FROM o, l),
x AS (SELECT part, o, step, n, good, toxic, fails[own] AS here, len(list_filter(before, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda i: i)) AS many FROM z, m)
SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(coalesce(sum(n) FILTER (NOT gone AND NOT here), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (here AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (here AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (here AND many = 1), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (here AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (here AND NOT gone), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * (120 // greatest(many, 1))) FILTER (here), 0) AS BIGINT) AS shapley
FROM x GROUP BY part, o, step
"""
