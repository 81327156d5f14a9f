"""Incremental import: a stream of Markdown files goes through the same import as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import corpus
from corpusloom.sources import files

def import_stream(spark: SparkSession, incoming: str, root: str, checkpoint: str, splitter: str | None = None) -> StreamingQuery:
    """Imports the .md files that appear in `incoming`; documents and chunks are published together under `root` once a micro-batch.

    A batch that is replayed after a failure finds its documents unchanged, so the result is the same. A failure to
    read what is published fails the batch; only a root where nothing was ever published counts as empty. A micro-batch reads
    and writes only the buckets of its documents.
    """
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.md").load(incoming)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    rows = raw.select(F.col("path").alias("source"), F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("title"), F.lit("unknown").alias("license"), F.to_date("modificationTime").cast("string").alias("acquired"), text.alias("text"), F.lit(splitter).cast("string").alias("splitter")).where(F.col("text").rlike(r"(?U)\S"))

    def one(batch: DataFrame, _: int) -> None:
        now = batch.sparkSession
        touched = [r[0] for r in batch.select(files.bucket_of(corpus.document_id(F.col("source"))).alias("b")).distinct().collect()]  # at most BUCKETS numbers
        docs, chunks = corpus.import_documents(files.published(now, root, "documents", corpus.DOCUMENTS, touched), files.published(now, root, "chunks", corpus.CHUNKS, touched), batch)
        files.publish({"documents": docs, "chunks": chunks}, root, touched)

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
