"""Command line over a published corpus: `python -m corpusloom.cli --root FOLDER COMMAND ...`; JSON to stdout, problems to stderr with exit code 2.

FOLDER holds the published tables (documents, chunks), the run log (runs), the ledger (calls) and the vector index (index).
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.operators import answer, corpus, evaluate, index, rank
from corpusloom.session import ship
from corpusloom.sources import files

RUNS = "id bigint, created timestamp, query string, result string, elapsed_ms double"
CALLS = "id bigint, status string, reserved bigint, spent bigint"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom")
    p.add_argument("--root", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("import", "update"):
        c = sub.add_parser(name)
        c.add_argument("file")
        c.add_argument("--source", required=True)
        c.add_argument("--title", required=name == "import")
        c.add_argument("--license", required=name == "import")
        c.add_argument("--acquired", default=dt.date.today().isoformat())  # an update from here never inherits its date
        c.add_argument("--splitter")
    sub.add_parser("delete").add_argument("source")
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("--mode", choices=("keyword", "bm25", "vector"), default="keyword")
    c.add_argument("--limit", type=int, default=5)
    for name in ("docs", "index", "budget"):
        sub.add_parser(name)
    sub.add_parser("read").add_argument("chunk_id")
    for name in ("run", "replay"):
        sub.add_parser(name).add_argument("run_id", type=int)
    c = sub.add_parser("eval")
    c.add_argument("cases")
    c.add_argument("--holdout")
    c.add_argument("--limit", type=int, default=5)
    return p


def rows(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.select(F.to_json(F.struct("*")).alias("j")).toPandas()["j"]]


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.parquet(path) if files.exists(spark, path) else spark.createDataFrame([], schema)


def run(spark: SparkSession, a: argparse.Namespace, encoder: index.Encoder) -> list | dict:
    ship(spark)
    docs, chunks = files.published(spark, a.root, "documents", corpus.DOCUMENTS), files.published(spark, a.root, "chunks", corpus.CHUNKS)
    if a.command in ("import", "update"):
        given = files.markdown(spark, a.file) if a.file.endswith(".md") else files.pages(spark, a.file)
        problem = given.where("problem is not null").head(1)
        if problem or given.isEmpty():
            raise ValueError(problem[0]["problem"] if problem else f"{a.file} is no .md or .pdf file")
        own = [F.lit(x).cast("string").alias(n) for n, x in (("source", a.source), ("title", a.title), ("license", a.license), ("acquired", a.acquired), ("splitter", a.splitter))]
        incoming = given.select(*own, *(c if c in given.columns else F.lit(None).cast(k).alias(c) for c, k in (("text", "string"), ("pages", "array<array<string>>"))))
        if a.command == "update":
            refuse(corpus.unknown_sources(docs, incoming))
            pages = incoming.select("pages")
            incoming = corpus.inherited(docs, incoming).join(pages)  # one row by one row
        refuse(corpus.invalid(incoming))
        status = rows(corpus.import_status(docs, incoming).select("id", "source", "splitter", "status"))
        files.publish(dict(zip(("documents", "chunks"), corpus.import_documents(docs, chunks, incoming))), a.root)
        return status[0]
    if a.command == "delete":
        gone = spark.createDataFrame([(a.source,)], "source string")
        refuse(corpus.unknown_sources(docs, gone))
        files.publish(dict(zip(("documents", "chunks"), corpus.delete_documents(docs, chunks, gone))), a.root)
        return {"deleted": a.source}
    if a.command == "docs":
        return rows(docs.drop("snapshot").orderBy("id"))
    if a.command == "index":
        vectors, meta = index.build(chunks, encoder)
        index.store(vectors, meta, f"{a.root}/index")
        return rows(meta)[0]
    if a.command == "search":
        q = rank.one_query(spark, a.query)
        rank.check_arguments(a.query, a.limit)
        if a.mode == "vector":
            found = index.search(q, chunks, index.load(spark, f"{a.root}/index"), encoder, a.limit)
        else:
            found = {"keyword": rank.keyword, "bm25": rank.bm25}[a.mode](q, chunks, a.limit)
        out = rows(found.join(corpus.read_chunks(chunks, docs, found), "id").orderBy("rank"))
        result = {"mode": a.mode, "query": a.query, "candidates": out}
        files.append_runs(spark.createDataFrame([(a.query, json.dumps(result, ensure_ascii=False), 0.0)], "query string, result string, elapsed_ms double"), f"{a.root}/runs")
        return result
    if a.command == "read":
        one = chunks.where(F.col("id") == a.chunk_id)
        got = rows(corpus.read_chunks(one, docs))
        if not got:
            raise ValueError("the chunk is retired" if one.head(1) else "unknown chunk")
        return got[0]
    if a.command == "run":
        return json.loads(files.run_result(stored(spark, f"{a.root}/runs", RUNS), a.run_id))
    if a.command == "replay":
        runs = stored(spark, f"{a.root}/runs", RUNS)
        of = json.loads(files.run_result(runs, a.run_id)).get("retrieval_run_id")
        return rows(answer.replayed(runs.where(F.col("id").cast("string").isin(str(a.run_id), str(of)))).where(F.col("answer_id") == a.run_id))[0]
    if a.command == "budget":
        return rows(answer.ledger_summary(stored(spark, f"{a.root}/calls", CALLS)))[0]
    sampled = evaluate.loaded(files.cases(spark, a.cases), files.cases(spark, a.holdout) if a.holdout else None)
    ranked = rank.keyword(sampled.select(F.col("case_id").alias("query_id"), F.col("question").alias("text")), chunks, a.limit)
    where = docs.select("id", F.col("source").alias("url"))
    scores = evaluate.case_scores(sampled, evaluate.bundles(evaluate.covering(evaluate.spans(sampled), where, chunks), ranked), ranked, chunks)
    return {"cases": rows(scores.orderBy("case_id")), "report": rows(evaluate.report(scores, evaluate.freeze(sampled, docs)))[0]}


def refuse(problems: DataFrame) -> None:
    found = problems.head(1)
    if found:
        raise ValueError(found[0]["problem"])


def main(args: list[str] | None = None, spark: SparkSession | None = None, encoder: index.Encoder | None = None) -> int:
    a = parser().parse_args(args)
    own = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    try:
        if a.command == "search" and not a.query.strip():
            raise ValueError("the query is blank")
        print(json.dumps(run(own, a, encoder or index.hash_encoder()), ensure_ascii=False, indent=2, default=str))
        return 0
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
