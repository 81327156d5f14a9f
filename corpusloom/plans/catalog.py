"""Core queries over the driver's tables. Each runs over its whole tables; SQL for the check is in corpusloom.plans.oracle.

Batches of questions are the development and the holdout cases; evaluation rows carry the split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions import text as T
from corpusloom.operators import answer, corpus, evaluate, index, rank, split
from corpusloom.plans.oracle import ORACLE_SQL
from corpusloom.session import cut, table
from corpusloom.sources import files

# Fixed values of the single-question queries; the oracle uses the same
QUESTION = "How does the gateway treat access tokens when the source has changed since the last import?"
EXCLUDED = "gavepi-forum.example"

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("id").alias("doc_id"), "hash", "text")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks")


def _sample(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.sample(table(spark, d, "cases"), ("development", "holdout"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).select(F.col("case_id").alias("query_id"), F.col("question").alias("text"))


def _pages(spark: SparkSession, d: str, lines=lambda text: F.split(text, "\n", -1)) -> DataFrame:
    """Documents with pages, put together from their active pieces that name a page."""
    c = _chunks(spark, d).where("active and page is not null").select("id", "doc_id", "version", "page", "start_line", "text").dropDuplicates(["id"])
    page = c.groupBy("doc_id", "version", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "id", "text"))), lambda x: x["text"]), "\n").alias("t"))
    docs = page.groupBy("doc_id", F.col("version").alias("hash")).agg(F.array_sort(F.collect_list(F.struct("page", "t"))).alias("ps"))
    return docs.select("doc_id", "hash", F.transform("ps", lambda p: lines(p["t"])).alias("pages"))


# ---- lines and splitters


@query
def q_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("line_no"), "line")


@query
def q_chunk_baseline(spark, d):
    return split.split_lines(_docs(spark, d)).select("id", "doc_id", "section", "start_line", "end_line", "text", "kind")


@query
def q_chunk_census(spark, d):
    return split.census(split.split_lines(_docs(spark, d)))


@query
def q_chunk_blocks(spark, d):
    return split.split_blocks(_docs(spark, d)).select("id", "doc_id", "section", "start_line", "end_line", "text", "kind")


@query
def q_chunk_procedures(spark, d):
    return split.split_procedures(_docs(spark, d)).select("id", "doc_id", "section", "start_line", "end_line", "text", "kind")


@query
def q_chunk_pages(spark, d):
    return split.split_pages(_pages(spark, d)).select("id", "doc_id", "section", "start_line", "end_line", "kind", "page")


@query
def q_page_furniture(spark, d):
    return split.page_furniture(_pages(spark, d))


@query
def q_suspect_pages(spark, d):
    """Pages set in columns of three characters, as a broken text layer gives them."""
    return split.suspect_pages(_pages(spark, d, lambda t: F.regexp_extract_all(t, F.lit("[^\n]{1,3}"), F.lit(0))))


@query
def q_chunk_preview(spark, d):
    docs = table(spark, d, "documents").select(F.col("id").alias("doc_id"), F.col("text").alias("snapshot"))
    return split.preview(_chunks(spark, d).where("active").dropDuplicates(["id"]), docs)


@query
def q_metadata_blocks(spark, d):
    rows = _chunks(spark, d).where("active and text is not null").select("id", "kind", "text").dropDuplicates(["id"])
    return rows.select("id", "kind", T.is_metadata_block(T.lines(F.col("text"))).alias("provenance"))


@query
def q_structure_fallback(spark, d):
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", "splitter", corpus.effective_splitter(F.col("text"), F.when(F.col("splitter") != split.PAGES, F.col("splitter"))).alias("effective"))


# ---- terms


@query
def q_tokens_tf(spark, d):
    return rank.bm25_parts(_chunks(spark, d))[0].select("id", "term", "tf")


@query
def q_tokens_df(spark, d):
    return rank.bm25_parts(_chunks(spark, d))[0].groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query
def q_avgdl(spark, d):
    return rank.bm25_parts(_chunks(spark, d))[1].select("n", F.round("avgdl", 6).alias("avgdl"))


@query
def q_search_terms(spark, d):
    rows = table(spark, d, "runs").where("query is not null").select("id", "query").dropDuplicates(["id"])
    return rows.select("id", F.array_join(T.search_terms(F.col("query")), " ").alias("terms"))


@query
def q_question_parts(spark, d):
    rows = table(spark, d, "cases").where("question is not null").select("id", "question").dropDuplicates(["id"])
    return rows.select("id", F.explode(T.question_parts(F.col("question"))).alias("p")).select("id", F.col("p.id").alias("part"), F.col("p.text").alias("text"))


@query
def q_evidence_tokens(spark, d):
    return _chunks(spark, d).where("active and text is not null").select("id", "text").dropDuplicates(["id"]).select("id", T.estimated_tokens(F.col("text")).alias("tokens"))


# ---- retrieval


@query
def q_keyword_topk(spark, d):
    return rank.keyword(rank.one_query(spark, QUESTION), _chunks(spark, d), 10)


@query
def q_bm25_topk(spark, d):
    return rank.bm25(rank.one_query(spark, QUESTION), _chunks(spark, d), 10)


@query
def q_search_guard(spark, d):
    """Queries that are refused: every seventh logged query is blanked."""
    q = table(spark, d, "runs").select(F.col("id").alias("query_id"), F.when(F.col("id") % 7 == 0, " \t").otherwise(F.coalesce("query", F.lit(""))).alias("text")).dropDuplicates(["query_id"])
    return rank.refused(q)


@query
def q_keyword_batch(spark, d):
    return rank.keyword(_questions(spark, d), _chunks(spark, d), 5)


@query
def q_bm25_batch(spark, d):
    return rank.bm25(_questions(spark, d), _chunks(spark, d), 5)


@query
def q_vector_topk(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rank.vector(e.where("id = 0").select(F.lit("q").alias("query_id"), "embedding"), e, 10)


@query
def q_vector_batch(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rank.vector(e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), e, 5)


@query
def q_pool(spark, d):
    p = rank.pooled(table(spark, d, "embeddings").select(F.col("label").alias("id"), "embedding"))
    return p.select("id", F.posexplode("embedding").alias("dim", "x")).select("id", "dim", F.round("x", 6).alias("x"))


def _fused(spark, d, k=5):
    q, c = _questions(spark, d), _chunks(spark, d)
    h = rank.held(q, c)
    return rank.rrf([("keyword", rank.keyword(q, c, 10, h), 1.0), ("bm25", rank.bm25(q, c, 10, h), 1.0)], k)


@query
def q_rrf(spark, d):
    return _fused(spark, d).select("query_id", "id", "rank", "score", F.coalesce(F.try_element_at("contributions", F.lit("keyword")), F.lit(0)).alias("rank_keyword"), F.coalesce(F.try_element_at("contributions", F.lit("bm25")), F.lit(0)).alias("rank_bm25"))


def _excluded(spark, d):
    return table(spark, d, "documents").where(F.lower(corpus.trimmed(F.col("source"))) == EXCLUDED).select(F.col("id").alias("doc_id"))


@query
def q_exclude(spark, d):
    # the oversampling bound is 20 candidates; documents excluded beyond it are dropped from those
    return rank.excluding(rank.keyword, rank.one_query(spark, QUESTION), _chunks(spark, d), _excluded(spark, d), 5)


@query
def q_exclude_bm25(spark, d):
    return rank.excluding(rank.bm25, _questions(spark, d), _chunks(spark, d), _excluded(spark, d), 5)


# ---- vector index and modes

ENCODER = index.hash_encoder(8)


@query
def q_vector_index(spark, d):
    vectors, _ = index.build(_chunks(spark, d), ENCODER)
    return vectors.select("id", F.posexplode("embedding").alias("dim", "x")).select("id", "dim", F.round("x", 6).alias("x"))


def _lists(spark, d):
    """Ten candidates a question by each mode; the index is built and searched through its guard."""
    q, c = cut(_questions(spark, d)), _chunks(spark, d)
    h = rank.held(q, c)
    return {"keyword": cut(rank.keyword(q, c, 10, h)), "bm25": cut(rank.bm25(q, c, 10, h)), "vector": cut(index.search(q, c, index.build(c, ENCODER), ENCODER, 10))}


@query
def q_rrf_vector(spark, d):
    own = lambda n: F.coalesce(F.try_element_at("contributions", F.lit(n)), F.lit(0)).alias(f"rank_{n}")
    fused = rank.fused([(n, r, 1.0) for n, r in _lists(spark, d).items()], _chunks(spark, d), 5)
    return fused.select("query_id", "id", "rank", "score", own("keyword"), own("bm25"), own("vector"))


@query
def q_compare_modes(spark, d):
    """Recall by vector, BM25 and their fusion, and what changes against vector."""
    lists = _lists(spark, d)
    modes = {n: lists[n].where("rank <= 5") for n in ("vector", "bm25")} | {"hybrid": cut(rank.rrf([(n, lists[n], 1.0) for n in ("bm25", "vector")], 5))}
    return evaluate.compared({n: _scores(spark, d, r) for n, r in modes.items()}, "vector").join(_sample(spark, d).select("case_id", "split"), "case_id")


@query
def q_rank_lookup(spark, d):
    """Where the chunks that cover a case's passages stand in its list."""
    cover = evaluate.covering(evaluate.spans(_sample(spark, d)), table(spark, d, "documents").select("id", "url"), _chunks(spark, d)).where("id is not null")
    return rank.rank_of(rank.bm25(_questions(spark, d), _chunks(spark, d), 5), cover.select(F.col("case_id").alias("query_id"), "id"))


@query
def q_section_recall(spark, d):
    wanted = _questions(spark, d).select("query_id", F.lit("(body)").alias("section"))
    return evaluate.section_recall(wanted, rank.bm25(_questions(spark, d), _chunks(spark, d), 5), _chunks(spark, d))


@query
def q_term_mismatch(spark, d):
    q = _questions(spark, d)
    return rank.term_mismatch(q, rank.keyword(q, _chunks(spark, d), 5))


@query
def q_inactive_candidates(spark, d):
    """Candidates of the logged runs that are no active chunk any more, were all but the body retired."""
    ids = F.flatten(F.array(F.from_json(F.get_json_object("result", "$.candidates[*].id"), "array<string>")))
    rows = table(spark, d, "runs").where("result is not null").select("id", "result").dropDuplicates(["id"]).select(F.col("id").alias("run_id"), F.explode(ids).alias("id")).distinct()
    return rank.inactive_candidates(rows, _chunks(spark, d).withColumn("active", F.col("active") & (F.col("kind") == "body"))).select("run_id", "id")


# ---- corpus life cycle


def _incoming(spark, d):
    """A later delivery: every fifth document has a line more, every seventh is missing, every eleventh comes under a new address."""
    docs = table(spark, d, "documents").where("text is not null")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\nUpdated."))).otherwise(F.col("text"))
    url = F.when(F.col("doc_id") % 11 == 0, F.concat("url", F.lit("/new"))).otherwise(F.col("url"))
    return docs.where("doc_id % 7 <> 0").select(url.alias("source"), "title", "license", "acquired", text.alias("text"), F.lit(split.LINES).alias("splitter"))


def _current(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("id", "title", F.col("url").alias("source"), "license", "acquired", F.sha2("text", 256).alias("hash"), F.lit(split.LINES).alias("splitter"), F.col("text").alias("snapshot"))


@query
def q_import_status(spark, d):
    return corpus.import_status(_current(spark, d), _incoming(spark, d)).select("id", "hash", "status")


@query
def q_import_result(spark, d):
    docs = _current(spark, d)
    chunks = split.split_lines(docs.select(F.col("id").alias("doc_id"), "hash", F.col("snapshot").alias("text")))
    _, after = corpus.import_documents(docs, chunks, _incoming(spark, d))
    return after.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("active").alias("live"), F.count_distinct("version").alias("versions"))


@query
def q_import_invalid(spark, d):
    rows = table(spark, d, "documents").select("source", "title", "license", "acquired", "text", "splitter")
    return corpus.invalid(rows).groupBy("problem").agg(F.count(F.lit(1)).alias("rows"))


@query
def q_import_pages(spark, d):
    """Page documents imported into empty tables: every non-blank line is in one chunk."""
    docs = _pages(spark, d).select(F.concat(F.lit("pages/"), "doc_id").alias("source"), F.lit("t").alias("title"), F.lit("l").alias("license"), F.lit("2026-01-01").alias("acquired"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("splitter"), "pages")
    empty = lambda schema: spark.createDataFrame([], schema)
    after, chunks = corpus.import_documents(empty(corpus.DOCUMENTS), empty(corpus.CHUNKS), docs)
    lines = F.size(F.filter(F.split("text", "\n", -1), lambda x: ~T.is_blank(x)))
    n = chunks.where("active").groupBy("doc_id").agg(F.sum(lines).alias("lines"), F.count_distinct("page").alias("pages"))
    return n.join(after.select(F.col("id").alias("doc_id"), "source", "splitter"), "doc_id").select("source", "splitter", "lines", "pages")


@query
def q_unknown_sources(spark, d):
    asked = table(spark, d, "documents").select(F.when(F.col("doc_id") % 9 == 0, "  ").when(F.col("doc_id") % 11 == 0, F.concat("url", F.lit("/gone"))).otherwise(F.col("url")).alias("source"))
    return corpus.unknown_sources(_current(spark, d), asked)


@query
def q_migrate(spark, d):
    """Chunks of a layout without version, active, kind and page."""
    old = _chunks(spark, d).dropDuplicates(["id"]).drop("version", "active", "kind", "page")
    return corpus.migrated(old, table(spark, d, "documents")).select("id", "version", "active", "kind", "page")


@query
def q_delete(spark, d):
    docs = _current(spark, d)
    gone = docs.where(F.contains("source", F.lit(EXCLUDED))).select("source")
    _, after = corpus.delete_documents(docs, _chunks(spark, d).dropDuplicates(["id"]), gone)
    return after.select("id", "active")


@query
def q_active_chunks(spark, d):
    return _chunks(spark, d).where("active").select("id", "kind").distinct()


@query
def q_read(spark, d):
    docs = table(spark, d, "documents").select("id", "title", F.col("url").alias("source"), "license", "acquired", "hash")
    return corpus.read_chunks(_chunks(spark, d).dropDuplicates(["id"]), docs).select("id", "doc_id", "section", "start_line", "end_line", "title", "source", "version")


@query
def q_liveness(spark, d):
    """Evidence of every stored piece, held against the version its document has now."""
    docs = table(spark, d, "documents").select(F.col("id").alias("doc_id"), F.col("hash").alias("version"))
    evidence = _chunks(spark, d).select("id", "doc_id").distinct().join(docs, "doc_id", "left").select("id", "version")
    return corpus.liveness(_chunks(spark, d), evidence)


@query
def q_fingerprint(spark, d):
    return corpus.fingerprint(_chunks(spark, d))


@query
def q_stale_index(spark, d):
    stored = corpus.fingerprint(_chunks(spark, d).where("kind = 'body'")).select("fingerprint", F.lit("encoder-1").alias("encoder"))
    return corpus.stale(stored, _chunks(spark, d), "encoder-1")


@query
def q_manifest(spark, d):
    docs = table(spark, d, "documents").select(F.col("url").alias("file"), F.col("snapshot").alias("content"), "text", F.col("hash").alias("sha256"))
    return corpus.manifest_mismatches(docs.select("file", F.coalesce("text", F.lit("")).alias("content")), docs.select("file", "sha256"))


@query
def q_documents_list(spark, d):
    return table(spark, d, "documents").where(F.startswith("url", F.lit("https://"))).select("id", "url", "title", "license", F.col("acquired").cast("string").alias("acquired"), "hash", "splitter")


# ---- runs


@query
def q_amend(spark, d):
    """Fields of several types merged into every stored result, the second amendment over the first."""
    runs = table(spark, d, "runs").select("id", "result").dropDuplicates(["id"])
    extra = runs.select("id", F.explode(F.array(F.struct(F.lit(1).alias("at"), F.lit('{"limit": 50, "checked": true, "about": {"a": [1, 2]}}').alias("extra")), F.struct(F.lit(2).alias("at"), F.lit('{"checked": false}').alias("extra")))).alias("x")).select("id", "x.*")
    j = lambda path: F.get_json_object("result", path)
    return files.amended(runs, extra).select("id", j("$.limit").alias("asked"), j("$.checked").alias("checked"), j("$.about.a[1]").alias("a"), j("$.mode").alias("mode"), j("$.run_id").alias("run_id"))


@query
def q_amend_problems(spark, d):
    runs = table(spark, d, "runs").select("id", "result").dropDuplicates(["id"])
    extra = runs.select(F.when(F.col("id") % 5 == 0, -F.col("id")).otherwise(F.col("id")).alias("id"), F.lit(1).alias("at"), F.when(F.col("id") % 3 == 0, "[1]").otherwise('{"x": 1}').alias("extra"))
    return files.amend_problems(runs, extra)


@query
def q_run_lookup(spark, d):
    rows = table(spark, d, "runs").where("result is not null").select("id", "result").dropDuplicates(["id"])
    return rows.select("id", F.get_json_object("result", "$.mode").alias("mode"), F.get_json_object("result", "$.limit").cast("int").alias("asked"))


# ---- evaluation


def _bundles(spark, d, ranked):
    sampled = cut(_sample(spark, d))
    cover = evaluate.covering(evaluate.spans(sampled), table(spark, d, "documents").select("id", "url"), _chunks(spark, d))
    return sampled, evaluate.bundles(cover, ranked)


def _scores(spark, d, ranked):
    sampled, b = _bundles(spark, d, ranked)
    return evaluate.case_scores(sampled, b, ranked, _chunks(spark, d))


def _with_split(spark, d, rows):
    return rows.join(_sample(spark, d).select("case_id", "split"), "case_id")


@query
def q_spans(spark, d):
    cover = evaluate.covering(evaluate.spans(_sample(spark, d)), table(spark, d, "documents").select("id", "url"), _chunks(spark, d))
    return cover.groupBy("case_id", "span_no").agg(F.count("id").alias("covering"))


@query
def q_bundle_recall(spark, d):
    ranked = cut(rank.bm25(_questions(spark, d), _chunks(spark, d), 5))
    return _bundles(spark, d, ranked)[1]


@query
def q_case_scores(spark, d):
    return _with_split(spark, d, _scores(spark, d, cut(rank.bm25(_questions(spark, d), _chunks(spark, d), 5))))


@query
def q_macro_recall(spark, d):
    return evaluate.summary(_with_split(spark, d, _scores(spark, d, cut(rank.bm25(_questions(spark, d), _chunks(spark, d), 5)))), ("split",))


@query
def q_eval_report(spark, d):
    scores = _scores(spark, d, cut(rank.bm25(_questions(spark, d), _chunks(spark, d), 5)))
    frozen = evaluate.freeze(_sample(spark, d), table(spark, d, "documents").select("id", "hash", "splitter"))
    return evaluate.report(scores, frozen, "none").withColumn("not_run", F.array_join("not_run", ","))


@query
def q_compare_splitters(spark, d):
    """Recall by splitter: the corpus is rebuilt from its snapshots under each, chunk lines being what passages overlap."""
    q, sampled, urls = _questions(spark, d), cut(_sample(spark, d)), table(spark, d, "documents").select("id", "url")
    out = {}
    for name, (chunks, batch) in evaluate.split_and_held(q, _current(spark, d), {"lines": split.LINES, "blocks": split.BLOCK, "procedures": split.PROCEDURE}).items():
        ranked = cut(rank.bm25(q, chunks, 5, batch))
        out[name] = evaluate.case_scores(sampled, evaluate.bundles(evaluate.covering(evaluate.spans(sampled), urls, chunks), ranked), ranked, chunks)
    return _with_split(spark, d, evaluate.compared(out, "lines"))


@query
def q_compare_retrievers(spark, d):
    q, c = _questions(spark, d), _chunks(spark, d)
    h = rank.held(q, c)
    both = {"keyword": cut(rank.keyword(q, c, 5, h)), "bm25": cut(rank.bm25(q, c, 5, h))}
    return _with_split(spark, d, evaluate.compared({n: _scores(spark, d, r) for n, r in both.items()}, "keyword"))


@query
def q_degradation(spark, d):
    ranked = cut(rank.bm25(_questions(spark, d), _chunks(spark, d), 5))
    sampled, b = _bundles(spark, d, ranked)
    return _with_split(spark, d, evaluate.degradation(sampled, b, ranked))


@query
def q_freeze(spark, d):
    return evaluate.freeze(_sample(spark, d), table(spark, d, "documents").select("id", "hash", "splitter"))


@query
def q_sample_overlap(spark, d):
    """Development cases some of which are delivered as holdout too."""
    cases = table(spark, d, "cases").select("id", "split")
    again = cases.where("split = 'development'").where(F.substring("id", -1, 1).isin("1", "2", "3")).withColumn("split", F.lit("holdout"))
    return evaluate.sample_overlap(cases.unionByName(again))


@query
def q_supplement_rounds(spark, d):
    q = _questions(spark, d)
    return evaluate.stop_reasons(q, evaluate.rounds(rank.keyword(q, _chunks(spark, d), 15), 5))


def _modes(spark, d):
    q = _questions(spark, d)
    return evaluate.supplement_modes(q, rank.keyword(q, _chunks(spark, d), 15), 5)


@query
def q_supplement_modes(spark, d):
    return _modes(spark, d)


@query
def q_stop_histogram(spark, d):
    return evaluate.stop_histogram(_modes(spark, d))


@query
def q_bounded_rounds(spark, d):
    """Widening rounds; questions that ask how are content after a supplementary round, those about a limit run out of time before the last."""
    q = cut(_questions(spark, d))
    ranked = rank.keyword(q, _chunks(spark, d), 15).groupBy("query_id").agg(F.collect_list(F.struct("rank", "id")).alias("r"))
    rows = q.join(ranked, "query_id", "left").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(2))))
    seen = F.transform(F.filter(F.array_sort(F.coalesce("r", F.array().cast("array<struct<rank:int,id:string>>"))), lambda x: x["rank"] <= 5 * (F.col("round") + 1)), lambda x: F.struct(x["id"].alias("id"), F.array().cast("array<string>").alias("fields")))
    low = F.lower("text")
    passes = rows.select(
        "query_id", "round", ((F.col("round") == 2) & F.contains(low, F.lit("limit"))).alias("late"), F.lit(False).alias("broke"), F.lit(False).alias("failed"), seen.alias("candidates"),
        ((F.col("round") >= 1) & F.contains(low, F.lit("how"))).alias("sufficient"), F.lit(None).cast("array<string>").alias("required"),
    )
    return evaluate.bounded_rounds(passes).select("query_id", "stop_reason", "supplementary_rounds", F.size("evidence").alias("evidence"))


# ---- answers and spend


@query
def q_quote_verify(spark, d):
    """Quoted phrases against the lines of the document they are quoted from."""
    e = table(spark, d, "cases").select("id", "evidence").dropDuplicates(["id"]).select("id", F.posexplode("evidence").alias("passage", "e"))
    e = e.select("id", "passage", F.col("e.source").alias("url"), F.posexplode("e.must_include").alias("n", "quote"))
    docs = table(spark, d, "documents").select("url", "text")
    return e.join(docs, "url", "left").select("id", "passage", "n", F.coalesce(F.contains("text", "quote"), F.lit(False)).alias("verbatim"))


def _answers(spark, d):
    """Answers told from the cases: one claim a passage, each citing its document and first phrase."""
    c = table(spark, d, "cases").where("size(evidence) > 0 and question is not null").select("id", "question", "expected_status", "evidence").dropDuplicates(["id"])
    quotes = F.filter("evidence", lambda e: F.size(e["must_include"]) > 0)
    return c.select(
        F.col("id").alias("answer_id"), "question", F.col("expected_status").alias("status"), F.when(F.col("expected_status") == "grounded", "").otherwise("not stated").alias("missing"),
        F.transform(quotes, lambda e: F.struct(e["why"].alias("text"), F.array(e["source"]).alias("citations"))).alias("claims"),
        F.transform(quotes, lambda e: F.struct(e["source"].alias("id"), F.element_at(e["must_include"], 1).alias("quote"), F.lit("t").alias("translation"))).alias("citations"),
    )


@query
def q_validate(spark, d):
    a = _answers(spark, d)
    cited = a.select("answer_id", F.explode("citations.id").alias("id")).distinct()
    docs = table(spark, d, "documents").select(F.col("url").alias("id"), "text")
    return answer.validated(a, cited.join(docs, "id")).select("answer_id", "status", "problem", "quotes")


@query
def q_replay(spark, d):
    """Answers stored as model text, with one citation written out in place of its id, told again against the stored candidates."""
    a = _answers(spark, d)
    inline = F.transform("claims", lambda c, i: F.struct(c["text"].alias("text"), F.when(i == 0, F.array(F.to_json(F.element_at("citations", 1)))).otherwise(c["citations"]).alias("citations")))
    a = a.withColumn("claims", inline)
    cited = a.select("answer_id", F.explode("citations.id").alias("id")).distinct().join(table(spark, d, "documents").select(F.col("url").alias("id"), "text"), "id")
    found = cited.groupBy("answer_id").agg(F.collect_list(F.struct("id", "text")).alias("candidates"))
    stored = found.select(F.concat(F.lit("r"), "answer_id").alias("id"), F.to_json(F.struct("candidates")).alias("result"))
    model = F.to_json(F.struct("claims", "citations", "status", "missing"))
    runs = a.select(F.col("answer_id").alias("id"), F.to_json(F.struct(model.alias("model_output"), F.concat(F.lit("r"), "answer_id").alias("retrieval_run_id"))).alias("result"))
    return answer.replayed(runs.unionByName(stored)).where("problem is null or problem <> 'no model text'").select("answer_id", "status", "problem", "quotes", "normalised")


@query
def q_coverage(spark, d):
    a = _answers(spark, d)
    rows = F.transform(T.question_parts(F.col("question")), lambda p, i: F.struct(p["id"].alias("question_id"), F.when(i == 0, F.transform("claims", lambda c, j: j.cast("int"))).otherwise(F.array().cast("array<int>")).alias("claims"), F.when(i == 0, F.col("missing")).otherwise(F.lit("no passage")).alias("missing")))
    return answer.covered(a.withColumn("coverage", rows)).select("answer_id", "problem", "status", "missing")


@query
def q_cost(spark, d):
    runs = table(spark, d, "runs").select("id", F.coalesce(F.length("query"), F.lit(0)).alias("i"), F.coalesce(F.length("result"), F.lit(0)).alias("o")).dropDuplicates(["id"])
    models = table(spark, d, "model_config").select("model", "input_rmb_per_million", "output_rmb_per_million", F.regexp_extract("model", r"-(\d+)$", 1).cast("int").alias("key"))
    rows = runs.withColumn("key", F.expr("shiftleft(1, cast(pmod(id, 6) + 1 as int))")).join(F.broadcast(models), "key")  # the price list, a few rows
    return rows.select("id", "model", answer.cost(F.col("i"), F.col("o"), F.col("input_rmb_per_million"), F.col("output_rmb_per_million")).alias("cost"))


def _calls(spark, d):
    amount = F.round(F.col("value") * 100).cast("bigint")
    status = F.when(F.col("event_type") == "error", "unknown").when(F.col("event_type") == "view", "pending").otherwise("settled")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("account"), F.col("ts").alias("at"), status.alias("status"), amount.alias("reserved"), F.when(status == "settled", amount).alias("spent"), amount.alias("amount"))


@query
def q_ledger(spark, d):
    return answer.ledger_summary(_calls(spark, d))


@query
def q_ledger_by_account(spark, d):
    c = _calls(spark, d)
    return c.groupBy("account").agg(F.coalesce(F.sum("spent"), F.lit(0)).alias("spent"), F.coalesce(F.sum(F.when(F.col("status").isin("pending", "unknown"), F.col("reserved"))), F.lit(0)).alias("held"))


@query
def q_ledger_guard(spark, d):
    """With open calls, which block an account until they are settled."""
    return answer.guarded(_calls(spark, d), limit=50_000).select("account", "id", "accepted", "spent_before")


@query
def q_ledger_limit(spark, d):
    """All calls settled: only the limit refuses."""
    return answer.guarded(_calls(spark, d).drop("status", "spent"), limit=400_000).select("account", "id", "accepted", "spent_before")


@query
def q_settlement_problems(spark, d):
    c = _calls(spark, d).withColumn("spent", F.when(F.col("id") % 10 == 0, F.col("spent") + 1).otherwise(F.col("spent")))
    return answer.settlement_problems(c)
