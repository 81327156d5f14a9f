"""Mixing sources to target shares of all tokens by a low-discrepancy schedule.

Slot i of the schedule takes the source in whose part of the cumulative target weights the i-th van der Corput point
falls, so every stretch of the schedule has the target mix. The r-th slot of a source draws its r-th block of BLOCK
tokens. The blocks cut the stream of the source's documents, in an order shuffled anew for every repetition, into equal
numbers of tokens: a document that lies across an edge has a row in each block, with the tokens that fall in it. The sums
that place a document are two-level (bucket totals, then within a bucket of at most about BUCKET documents), so no source
is ever gathered in one task. The schedule ends at the first slot whose source has no full block left within its allowed
repetitions: the largest mix in which all shares hold. A source's last document may be cut by that end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.session import cut

from .repeated_lines import source_key

BLOCK = 1024  # tokens a slot stands for
BUCKET = 5_000  # documents, about
STRETCH = 1 << 18  # slots a task draws up at once


def van_der_corput(i: np.ndarray) -> np.ndarray:
    """Radical inverse in base 2."""
    i, out, half = np.asarray(i, np.int64).copy(), np.zeros(len(i)), 0.5
    while i.any():
        out += half * (i & 1)
        i >>= 1
        half /= 2
    return out


def sources_of(start: int, end: int, edges: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(edges, van_der_corput(np.arange(start, end)), side="right"), len(edges) - 1)


def schedule_length(edges: np.ndarray, room: np.ndarray, spark) -> tuple[int, list[np.ndarray]]:
    """Number of slots until a source would need more than its `room` blocks, and the counts at every stretch's start."""
    share = np.diff(np.r_[0.0, edges])
    most = int(min(r / s for r, s in zip(room, share) if s > 0)) + 64 * len(edges)
    stretches = -(-most // STRETCH)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in b["id"]:
                c = np.bincount(sources_of(k * STRETCH, min(most, (k + 1) * STRETCH), edges), minlength=len(edges))
                yield pd.DataFrame({"k": [k], "c": [c.tolist()]})

    rows = sorted(spark.range(stretches).mapInPandas(count, "k bigint, c array<bigint>").collect())  # one row a stretch of 2^18 slots
    starts, now = [], np.zeros(len(edges), np.int64)
    for k, c in rows:
        starts.append(now)
        after = now + np.array(c)
        if (after > room).any():
            s = sources_of(k * STRETCH, min(most, (k + 1) * STRETCH), edges)
            over = [np.flatnonzero(np.cumsum(s == x) + now[x] > room[x]) for x in range(len(edges))]
            return k * STRETCH + min(int(o[0]) for o in over if len(o)), starts
        now = after
    return most, starts


def mixed(sized: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source, repetition, doc_id, start, tokens): the drawn documents in mixing order; start is the first token in the slot.

    sized: (doc_id, source, tokens) with unique doc_id; targets: (source, target_share, max_repeats), one row a source
    (repeated rows count once; share and repeats must be positive). A document is drawn at most max_repeats times. Targets
    without any token drop out and the others keep their ratio; no usable target gives no row.
    """
    spark = sized.sparkSession
    empty = "slot bigint, source string, repetition int, doc_id bigint, start bigint, tokens bigint"
    rows = targets.select(source_key().alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0").dropDuplicates(["source"])
    docs = cut(sized.where("tokens > 0").select("doc_id", source_key().alias("source"), "tokens").join(F.broadcast(rows.select("source")), "source"))  # a configured list of sources
    have = {r["source"]: (r["n"], r["t"]) for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).collect()}
    plan = [(r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in rows.orderBy("source").collect() if r["source"] in have]
    if not plan:
        return spark.createDataFrame([], empty)
    share = np.array([p[1] for p in plan])
    edges = np.cumsum(share / share.sum())
    slots, starts = schedule_length(edges, np.array([max(1, have[s][1] * times // block) for s, _, times in plan], np.int64), spark)
    names = [p[0] for p in plan]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in b["id"]:
                s = sources_of(k * STRETCH, min(slots, (k + 1) * STRETCH), edges)
                rank = np.zeros(len(s), np.int64)
                for x in range(len(edges)):
                    at = s == x
                    rank[at] = starts[k][x] + np.arange(at.sum())
                yield pd.DataFrame({"slot": np.arange(k * STRETCH, k * STRETCH + len(s)), "source": np.array(names, object)[s], "block": rank})

    stretches = -(-slots // STRETCH)
    schedule = spark.range(stretches).mapInPandas(draw, "slot bigint, source string, block bigint") if slots else spark.createDataFrame([], "slot bigint, source string, block bigint")
    most = F.broadcast(spark.createDataFrame([(s, times, int(max(1, have[s][0] // BUCKET)), have[s][1]) for s, _, times in plan], "source string, times int, buckets int, whole bigint"))  # the same list
    each = docs.join(most, "source").select("doc_id", "source", "tokens", "buckets", "whole", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("repetition"))
    key = F.xxhash64("doc_id", "repetition")
    each = each.withColumns({"key": key, "bucket": F.pmod(F.shiftrightunsigned(key, 20), F.col("buckets"))})
    sums = each.groupBy("source", "repetition", "bucket").agg(F.sum("tokens").alias("t"))
    before = sums.select("source", "repetition", "bucket", (F.sum("t").over(Window.partitionBy("source", "repetition").orderBy("bucket")) - F.col("t")).alias("before"))
    inner = Window.partitionBy("source", "repetition", "bucket").orderBy("key", "doc_id")
    at = F.col("whole") * F.col("repetition") + F.col("before") + F.sum("tokens").over(inner) - F.col("tokens")
    placed = each.join(before, ["source", "repetition", "bucket"]).withColumn("at", at)
    parts = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("tokens") - 1) / block))))
    first = F.greatest(F.col("block") * block, F.col("at"))
    part = F.least((F.col("block") + 1) * block, F.col("at") + F.col("tokens")) - first
    parts = parts.select("source", "repetition", "doc_id", "block", (first - F.col("at")).cast("bigint").alias("start"), part.cast("bigint").alias("tokens"))
    return parts.join(schedule, ["source", "block"]).select("slot", "source", "repetition", "doc_id", "start", "tokens")


def reached_shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, draws, tokens, share, most_repeats) of every target; share is of all drawn tokens."""
    draws = drawn.groupBy("source", "doc_id", "repetition").agg(F.sum("tokens").alias("tokens"))
    per_doc = draws.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("times"), F.sum("tokens").alias("tokens"))
    own = cut(per_doc.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("times").alias("draws"), F.sum("tokens").alias("tokens"), F.max("times").alias("most_repeats")))
    total = own.agg(F.sum("tokens")).first()[0] or 1
    rows = targets.select(source_key().alias("source"), "target_share").where("source is not null").dropDuplicates(["source"])
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(own, "source", "left").select("source", "target_share", z("documents"), z("draws"), z("tokens"), F.coalesce(F.col("tokens") / F.lit(total), F.lit(0.0)).alias("share"), z("most_repeats"))


def stretch_errors(drawn: DataFrame, targets: DataFrame, stretch: int = 256) -> DataFrame:
    """(source, worst): the largest distance between a source's share and its target within any whole stretch of slots."""
    total = targets.select(source_key().alias("source"), "target_share").where("source is not null and target_share > 0").dropDuplicates(["source"])
    t = drawn.groupBy(F.floor(F.col("slot") / stretch).alias("stretch"), "source").agg(F.sum("tokens").alias("t"))
    whole = t.groupBy("stretch").agg(F.sum("t").alias("all"))
    last = whole.agg(F.max("stretch").alias("last"))
    rows = t.join(whole, "stretch").join(F.broadcast(last), F.col("stretch") < F.col("last"))  # one row
    return rows.join(F.broadcast(total), "source").groupBy("source").agg(F.max(F.abs(F.col("t") / F.col("all") - F.col("target_share"))).alias("worst"))
