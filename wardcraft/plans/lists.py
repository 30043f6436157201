"""List ranking: rings and lists given by each item's follower get a name and each item its place, without any one passing through one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcraft.plans.shared import materialise, remove

_CHAIN = "id long, head long, pos long, nx long, len long, m long, off long"


def _chains(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Rows (id, next) -> (id, head, pos, nx, len, m, off): each id's chain among these rows and its place there; a head also has its chain's
    follower and length, its least id and the place of it. Rows are taken in lots, so that little is held."""
    names = ["id", "head", "pos", "nx", "len", "m", "off"]

    def lot(rows: pa.Table) -> pa.RecordBatch:
        next_of = dict(zip(rows["id"].to_pylist(), rows["next"].to_pylist(), strict=True))
        inner = {x for x in next_of.values() if x in next_of}
        out: list[tuple] = []
        seen: set[int] = set()
        for head in [*[x for x in next_of if x not in inner], *sorted(inner)]:
            if head in seen:
                continue
            chain, x = [], head
            while x is not None and x in next_of and x not in seen:
                seen.add(x)
                chain.append(x)
                x = next_of[x]
            least = min(chain)
            out.append((head, head, 0, x, len(chain), least, chain.index(least)))  # x is None at a list's end
            out += [(c, head, k, None, None, None, None) for k, c in enumerate(chain[1:], 1)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield lot(pa.Table.from_batches(held))
            held = []
    if held and sum(b.num_rows for b in held):
        yield lot(pa.Table.from_batches(held))


def traced(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links(id, next), where every id has one follower and is one's -> id, ring (the least id of its cycle), seq (from 0 there), n (its length).

    Chains within a task become one link each; then every chain looks twice as far ahead each round for the least id of its ring, so rounds
    grow with the logarithm of the chains in a ring.
    """
    chains = materialise(spark, links.select("id", "next").repartitionByRange("id").mapInArrow(_chains, _CHAIN), "chains")  # neighbours share a task
    heads = chains.where("len is not null").select("head", "nx", "len", "m", "off")
    now, last = heads, None
    while True:
        ahead = now.select(*[F.col(c).alias(f"{c}_") for c in now.columns if c != "changed"])
        found = now.join(ahead.hint("merge"), F.col("nx") == F.col("head_")).select("head", F.col("nx_").alias("nx"), F.expr("len + len_").alias("len"), F.least("m", "m_").alias("m"), F.expr("case when m_ < m then len + off_ else off end").alias("off"), F.expr("m_ < m").alias("changed"))
        found = materialise(spark, found, "ahead")
        if last is not None:
            remove(spark, last)
        now = last = found
        if found.where("changed").isEmpty():
            break
    rings = now.select("head", F.col("m").alias("ring"), F.col("off").alias("at")).join(heads.select("head", F.col("len").alias("own")).hint("merge"), "head")
    rings = rings.join(rings.groupBy("ring").agg(F.sum("own").alias("n")).hint("merge"), "ring").select("head", "ring", "at", "n")
    return chains.select("id", "head", "pos").join(rings.hint("merge"), "head").select("id", "ring", F.expr("pmod(pos - at, n)").alias("seq"), "n")


def ranked(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links(id, next), next null at a list's end and no two ids with the same -> id, list (its last id), seq (from 0 at its first), n. Items of rings are left out."""
    chains = materialise(spark, links.select("id", "next").repartitionByRange("id").mapInArrow(_chains, _CHAIN), "chains")  # neighbours share a task
    heads = chains.where("len is not null").select("head", "nx", "len")
    tails = chains.groupBy("head").agg(F.max_by("id", "pos").alias("tail"))
    now, last, left = heads.join(tails.hint("merge"), "head"), None, None
    while True:
        ahead = now.select(F.col("head").alias("head_"), F.col("nx").alias("nx_"), F.col("len").alias("len_"), F.col("tail").alias("tail_"))
        # lists at their end wait apart: a join would bring all of their nulls to one task
        found = now.where("nx is not null").join(ahead.hint("merge"), F.col("nx") == F.col("head_"), "left").select("head", F.col("nx_").alias("nx"), F.expr("len + coalesce(len_, 0)").alias("len"), F.coalesce("tail_", "tail").alias("tail"))
        found = materialise(spark, found.unionByName(now.where("nx is null").select("head", "nx", "len", "tail")), "ahead")
        if last is not None:
            remove(spark, last)
        now = last = found
        row = found.agg(F.count(F.lit(1)).alias("n"), F.count("nx").alias("open")).first()
        left = row.n if left is None else left >> 1  # a list of n chains is at its end after log2(n) rounds; what goes on is a ring
        if not row.open or not left:
            break
    lists = now.where("nx is null").select("head", F.col("len").alias("ahead"), F.col("tail").alias("list"))
    lists = lists.join(lists.groupBy("list").agg(F.max("ahead").alias("n")).hint("merge"), "list")
    return chains.select("id", "head", "pos").join(lists.hint("merge"), "head").select("id", "list", F.expr("n - ahead + pos").alias("seq"), "n")
