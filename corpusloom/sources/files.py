"""Readers and writers: Markdown and page files, evaluation cases, run log, versioned tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CASES = (
    "kind string, version string, note string, sources map<string,string>, cases array<struct<id:string,question:string,expected_status:string,kind:string,structure:string,"
    "evidence:array<struct<source:string,start_line:int,end_line:int,must_include:array<string>,required_together:boolean,why:string>>,human_review:array<string>,note:string>>"
)

#: Published tables are split by document, so that a change of some documents rewrites their buckets only
BUCKETS = 256
KEYS = {"documents": "id", "chunks": "doc_id"}
MANIFEST = "version string, at timestamp, parts struct<documents: map<string, string>, chunks: map<string, string>>"


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(file, hash, text, problem) of .md files: hash of the bytes, text as UTF-8 without a byte order mark; blank files have a problem."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return raw.select(F.col("path").alias("file"), F.sha2("content", 256).alias("hash"), text.alias("text")).withColumn("problem", F.when(~F.col("text").rlike(r"(?U)\S"), "the file is blank"))


def pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[list[str]]] | None = None) -> DataFrame:
    """(file, hash, pages, problem) of .pdf files by an extractor bytes -> lines by page (pypdf's text layer by default, where installed)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)

    def default(data: bytes) -> list[list[str]]:
        import io

        import pypdf

        return [(p.extract_text() or "").splitlines() for p in pypdf.PdfReader(io.BytesIO(data)).pages]

    read = extract or default

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for file, data in zip(b["file"], b["content"]):
                try:
                    got, problem = read(data), None
                    if not got:
                        problem = "the file has no pages"
                    elif not any(x.strip() for p in got for x in p):
                        problem = "the file has no text layer"
                except Exception as e:  # a broken file is a row with a problem, not a failed job
                    got, problem = [], f"unreadable: {type(e).__name__}"
                out.append((file, got, problem))
            yield pd.DataFrame(out, columns=["file", "pages", "problem"])

    rows = raw.select(F.col("path").alias("file"), "content")
    hashes = raw.select(F.col("path").alias("file"), F.sha2("content", 256).alias("hash"))
    return rows.mapInPandas(run, "file string, pages array<array<string>>, problem string").join(hashes, "file")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation files as rows of the cases table; source labels are resolved by the file's own map, split is the file's kind."""
    f = spark.read.schema(CASES).option("multiLine", "true").json(path)
    c = f.select("kind", "version", "sources", F.explode("cases").alias("c"))
    label = F.transform("c.evidence", lambda e: e.withField("source", F.coalesce(F.try_element_at("sources", e["source"]), e["source"])).withField("required_together", F.coalesce(e["required_together"], F.lit(True))))
    return c.select(F.col("c.id").alias("id"), F.col("kind").alias("split"), F.col("c.question").alias("question"), F.col("c.expected_status").alias("expected_status"), F.col("c.kind").alias("kind"), F.col("c.structure").alias("structure"), label.alias("evidence"), F.col("c.human_review").alias("human_review"), "version", F.col("c.note").alias("note"))


def invalid_cases(rows: DataFrame) -> DataFrame:
    """(id, problem) of case rows that break the contract; must be empty before a run."""
    bad = lambda e: e["start_line"].isNull() | e["end_line"].isNull() | (e["start_line"] < 1) | (e["end_line"] < e["start_line"])
    blank = lambda c: ~F.coalesce(F.col(c), F.lit("")).rlike(r"(?U)\S")
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and id is not null").select("id", F.lit("the id is not unique").alias("problem"))
    problem = F.when(blank("id"), "the id is blank").when(blank("question"), "the question is blank").when(F.coalesce(F.size("evidence"), F.lit(0)) < 1, "there is no evidence").when(F.exists("evidence", bad), "line numbers")
    return rows.select("id", problem.alias("problem")).where("problem is not null").unionByName(twice)


def append_runs(runs: DataFrame, path: str) -> None:
    """The only writer of the run log: appends (id, created, query, result, elapsed_ms); ids are unique without a counter."""
    rows = runs.withColumn("id", F.xxhash64(F.lit(uuid.uuid4().hex), F.monotonically_increasing_id(), "query")) if "id" not in runs.columns else runs
    created = F.col("created") if "created" in runs.columns else F.current_timestamp()
    rows.select("id", created.alias("created"), "query", "result", "elapsed_ms").write.mode("append").parquet(path)


def amended(runs: DataFrame, amendments: DataFrame) -> DataFrame:
    """Runs with the fields of amendments(id, at, extra JSON object) merged into their result, later ones last; values keep
    their JSON type. Unreadable results and amendments that are no object change nothing (see amend_problems)."""
    kind = "map<string,variant>"
    fields = lambda c: F.from_json(c, kind)
    empty = F.create_map().cast(kind)
    merged = amendments.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "extra"))).alias("xs"))
    over = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)
    extra = F.aggregate("xs", empty, lambda a, x: over(a, F.coalesce(fields(x["extra"]), empty)))
    rows = runs.join(merged.select("id", extra.alias("m")), "id", "left").withColumn("own", fields(F.col("result")))
    return rows.withColumn("result", F.when((F.size("m") > 0) & F.col("own").isNotNull(), F.to_json(over(F.col("own"), F.col("m")))).otherwise(F.col("result"))).drop("m", "own")


def amend_problems(runs: DataFrame, amendments: DataFrame) -> DataFrame:
    """(id, at, problem) of amendments to runs that are not there or that are no JSON object, and to unreadable results."""
    own = runs.select("id", F.col("result").alias("stored"), F.lit(True).alias("known")).dropDuplicates(["id"])
    is_object = lambda c: F.coalesce(F.json_object_keys(c).isNotNull(), F.lit(False))
    problem = F.when(F.col("known").isNull(), "unknown run").when(~is_object(F.col("extra")), "the amendment is no object").when(~is_object(F.col("stored")), "the stored result is no object")
    return amendments.join(own, "id", "left").select("id", "at", problem.alias("problem")).where("problem is not null")


def run_result(runs: DataFrame, run_id) -> str:
    """The stored JSON of one run; an unknown id is an error."""
    rows = runs.where(F.col("id") == F.lit(run_id)).select("result").head(1)
    if not rows:
        raise ValueError(f"there is no run {run_id}")
    return rows[0]["result"]


def write_report(report: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file of lines, whole or not at all."""
    report.coalesce(1).write.mode("overwrite").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def bucket_of(key: Column) -> Column:
    """The bucket that a document and its chunks are published in, by document id."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _manifest(spark: SparkSession, root: str) -> dict[str, dict[int, str]]:
    """Of every table: the version that holds each of its buckets; buckets without rows are not listed."""
    rows = spark.read.schema(MANIFEST).json(f"{root}/_current")
    last = rows.orderBy(F.desc("at"), "version").first()
    return {name: {int(b): v for b, v in own.items()} for name, own in last["parts"].asDict(recursive=True).items() if own} if last else {}


def publish(tables: dict[str, DataFrame], root: str, touched: list[int] | None = None) -> str:
    """Writes new versions of tables that belong together (documents, chunks) next to the old ones and only then points to them: readers see all of the old or all of the new.

    touched: the buckets that the tables hold; the others stay as they are published. By default all are replaced.
    """
    version = f"v-{uuid.uuid4().hex}"
    spark = next(iter(tables.values())).sparkSession
    now = _manifest(spark, root) if touched is not None and exists(spark, f"{root}/_current") else {}
    parts = {}
    for name, df in tables.items():
        path = f"{root}/{version}/{name}"
        df.withColumn("bucket", bucket_of(F.col(KEYS[name]))).write.mode("errorifexists").partitionBy("bucket").parquet(path)
        new = {b: version for b in (touched if touched is not None else range(BUCKETS)) if exists(spark, f"{path}/bucket={b}")}
        parts[name] = {str(b): v for b, v in ({b: v for b, v in now.get(name, {}).items() if b not in set(touched or ())} | new).items()}
    row = spark.createDataFrame([(version, tuple(parts.get(n) for n in KEYS))], f"version string, {MANIFEST.split(', ', 2)[2]}")
    row.coalesce(1).withColumn("at", F.current_timestamp()).write.mode("append").json(f"{root}/_current")
    return version


def published(spark: SparkSession, root: str, name: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
    """A table (or some of its buckets) as it was published last. Where nothing was ever published it is empty; any other failure to read rises."""
    out = spark.createDataFrame([], schema)
    if not exists(spark, f"{root}/_current"):
        return out
    by: dict[str, list[int]] = {}
    for b, v in _manifest(spark, root).get(name, {}).items():
        if buckets is None or b in buckets:
            by.setdefault(v, []).append(b)
    for v, own in sorted(by.items()):
        base = f"{root}/{v}/{name}"
        out = out.unionByName(spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/bucket={b}" for b in sorted(own))).select(*out.columns))
    return out
