"""Token counts and totals by slice, kept up to date by signed deltas.

A count table maps (content hash, tokenizer hash) to a number of tokens; it is stored and added to. Only contents that are
not in the table are encoded. A cube holds totals by source, language, domain and splitter; a change of the collection
adds the difference of every slice: plus for new, minus for removed documents, both for changed ones.

Texts go through no exchange: without a table they are hashed and encoded where they are read (equal texts of a task
once); with one, hashes find the unseen contents and one row that holds each, and only those rows' texts are encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.session import cut, maybe_broadcast

from . import tokenizers

DIMENSIONS = ("source", "lang", "domain", "splitter")


def language(column: str = "lang"):
    """Primary subtag in lower case; null or blank is und."""
    bare = F.regexp_extract(F.lower(F.trim(F.coalesce(F.col(column), F.lit("")))), "^[a-z]+", 0)
    return F.when(bare == "", "und").otherwise(bare)


def normalised(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, domain, splitter, text); absent values become a named slice. Repeated rows of a doc_id are still in."""
    blank = lambda c: F.coalesce(F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "")), F.lit("(none)"))
    return docs.select("doc_id", blank("source").alias("source"), language().alias("lang"), blank("domain").alias("domain"), blank("splitter").alias("splitter"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")


def counted_rows(rows: DataFrame, known: DataFrame | None = None, folder: str = tokenizers.FOLDER, name: str = tokenizers.NAME, key: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(the rows with content and tokens in place of text, one a key; the counts that `known` lacked, as (content, tokenizer, tokens))."""
    mark = tokenizers.tokenizer_hash(folder, name)
    fresh = lambda df: df.select("content", F.lit(mark).alias("tokenizer"), "tokens").dropDuplicates(["content"])
    if known is None:
        counted = cut(tokenizers.hashed_and_counted(rows, "text", folder, name).dropDuplicates(list(key)))
        return counted, fresh(counted)
    hashed = cut(rows.withColumn("content", F.sha2("text", 256)).drop("text").dropDuplicates(list(key)))
    own = known.where(F.col("tokenizer") == mark).select("content", "tokens")
    one = cut(hashed.join(own.select("content"), "content", "left_anti").groupBy("content").agg(F.min_by(F.struct(*key), F.struct(*key)).alias("k")).select("k.*"))
    texts = rows.join(maybe_broadcast(one, one.count(), 128), list(key)).select("text")
    new = cut(fresh(tokenizers.hashed_and_counted(texts, "text", folder, name)))
    return hashed.join(own.unionByName(new.select("content", "tokens")).dropDuplicates(["content"]), "content"), new


class CountTable:
    """The stored counts: files under a folder, added to by whole jobs; a content that two runs added counts once."""

    def __init__(self, path: str):
        self.path = path

    def load(self, spark) -> DataFrame | None:
        """None before anything was added."""
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return None
        return spark.read.parquet(self.path).dropDuplicates(["content", "tokenizer"])

    def add(self, counts: DataFrame) -> None:
        counts.select("content", "tokenizer", "tokens").write.mode("append").parquet(self.path)


def counted_with(table: CountTable, rows: DataFrame, folder: str = tokenizers.FOLDER, name: str = tokenizers.NAME, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The rows with tokens; what the stored table lacked is encoded and added to it."""
    counted, new = counted_rows(rows, table.load(rows.sparkSession), folder, name, key)
    counted = cut(counted)  # before the files that it reads are added to
    table.add(new)
    return counted


def cube(counted: DataFrame) -> DataFrame:
    """Totals of documents and tokens by the four dimensions, finest slices only; coarser ones are sums of these."""
    return counted.groupBy(*DIMENSIONS).agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))


def signed_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(dimensions, documents, tokens): what to add to the cube of `before` (counted rows by doc_id) to get that of `after`.

    Unchanged documents (same content and slice) cancel out before anything is summed.
    """
    key = ["doc_id", "content", *DIMENSIONS]
    both = before.select(*key, "tokens", F.lit(-1).alias("sign")).unionByName(after.select(*key, "tokens", F.lit(1).alias("sign")))
    net = both.groupBy(*key, "tokens").agg(F.sum("sign").alias("sign")).where("sign <> 0")
    return net.groupBy(*DIMENSIONS).agg(F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))


def updated_cube(old: DataFrame, deltas: DataFrame) -> DataFrame:
    """The cube after the deltas; slices without documents disappear."""
    return old.unionByName(deltas).groupBy(*DIMENSIONS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents > 0")


def totals(finest: DataFrame) -> DataFrame:
    """Totals for every single dimension, for source by language, and over all: (slice, source, lang, domain, splitter, documents, tokens)."""
    sets = [("all", ()), ("source", ("source",)), ("lang", ("lang",)), ("domain", ("domain",)), ("splitter", ("splitter",)), ("source_lang", ("source", "lang"))]
    out = None
    for name, dims in sets:
        part = finest.groupBy(*dims) if dims else finest.groupBy()
        part = part.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
        part = part.select(F.lit(name).alias("slice"), *(F.col(c) if c in dims else F.lit(None).cast("string").alias(c) for c in DIMENSIONS), "documents", "tokens")
        out = part if out is None else out.unionByName(part)
    return out


def same_slices(a: DataFrame, b: DataFrame) -> DataFrame:
    """(dimensions, same): whether two cubes agree on a slice of either."""
    left, right = (x.select(*DIMENSIONS, F.col("documents").alias(f"d{i}"), F.col("tokens").alias(f"t{i}")) for i, x in enumerate((a, b)))
    both = left.join(right, list(DIMENSIONS), "full")
    return both.select(*DIMENSIONS, F.coalesce((F.col("d0") == F.col("d1")) & (F.col("t0") == F.col("t1")), F.lit(False)).alias("same"))


def collection_tokens(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kind, id, tokens) of every document (doc_id) and every chunk."""
    docs = documents.select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), "text")
    parts = chunks.select(F.lit("chunk").alias("kind"), "id", "text")
    rows = docs.unionByName(parts).where("id is not null")
    return tokenizers.hashed_and_counted(rows).select("kind", "id", "tokens").dropDuplicates(["kind", "id"])
