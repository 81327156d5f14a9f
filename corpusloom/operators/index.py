"""Vector index of the active chunks: windows, pooled encoding, build, fingerprint, refusal when stale.

The encoder is given: a name that identifies it and a function from a text column to an array<double> column. It runs where
the chunks lie; a model goes in as a pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import text as T
from corpusloom.session import cut

from . import corpus, rank

WINDOW = 100  # fixed value: terms of a window


@dataclass(frozen=True)
class Encoder:
    identity: str
    encode: Callable[[Column], Column]


def hash_encoder(dims: int = 8) -> Encoder:
    """A deterministic stand-in for a model: equal texts have equal vectors, others unrelated ones; dims up to 8."""

    def encode(text: Column) -> Column:
        h = F.sha2(text, 256)
        raw = [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("double") / F.lit(2.0**31) - 1 for i in range(dims)]
        return F.array(*raw)

    return Encoder(f"sha256-{dims}", encode)


def unit(v: Column) -> Column:
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return F.transform(v, lambda x: x / norm)


def windows(rows: DataFrame, size: int = WINDOW) -> DataFrame:
    """(id, window, text) of rows(id, text): runs of `size` terms; a text without terms has one blank window."""
    ts = T.tokens(F.coalesce("text", F.lit("")))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("ts") - 1) / size).cast("int"))), lambda i: F.array_join(F.slice("ts", i * size + 1, size), " "))
    return rows.select("id", ts.alias("ts")).select("id", F.posexplode(parts).alias("window", "text"))


def encoded(rows: DataFrame, encoder: Encoder, size: int = WINDOW) -> DataFrame:
    """(id, embedding) of rows(id, text): the unit mean of the unit vectors of a text's windows."""
    each = windows(rows, size).select("id", unit(encoder.encode(F.col("text"))).alias("embedding"))
    return rank.pooled(each)


def build(chunks: DataFrame, encoder: Encoder) -> tuple[DataFrame, DataFrame]:
    """(vectors(id, embedding), meta(fingerprint, encoder, vectors)) of the active chunks; both replace what was there. No active chunk is an error."""
    active = rank.active_once(chunks)
    if active.isEmpty():
        raise ValueError("there is no active chunk to index")
    vectors = cut(encoded(active.select("id", "text"), encoder))
    meta = corpus.fingerprint(chunks).select("fingerprint", F.lit(encoder.identity).alias("encoder"), F.col("chunks").alias("vectors"))
    return vectors, meta


def store(vectors: DataFrame, meta: DataFrame, root: str) -> None:
    """Writes an index; the one row that names it comes last, so a half-written index is never found."""
    vectors.write.mode("overwrite").parquet(f"{root}/vectors")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{root}/meta")


def load(spark, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/vectors"), spark.read.parquet(f"{root}/meta")


def search(queries: DataFrame, chunks: DataFrame, stored: tuple[DataFrame, DataFrame], encoder: Encoder, k: int = 5) -> DataFrame:
    """queries(query_id, text) by the stored index; refuses an index that no longer fits the chunks or the encoder."""
    vectors, meta = stored
    if corpus.stale(meta, chunks, encoder.identity).first()["stale"]:
        raise ValueError("the vector index is stale; build it again")
    asked = encoded(queries.where(~T.is_blank(F.col("text"))).select(F.col("query_id").alias("id"), "text"), encoder).withColumnRenamed("id", "query_id")
    return rank.vector(asked, vectors, k, live=chunks)
