"""Evaluation of retrieval against annotated source spans: one plan over all cases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import text as T
from corpusloom.operators import rank, split
from corpusloom.session import written_at


def sample(cases: DataFrame, kinds: tuple[str, ...] = ("development",)) -> DataFrame:
    """(case_id, split, question, spans) of the named splits with at least one annotated span; repeated ids count once."""
    ok = "id is not null and question is not null and trim(question) <> '' and size(evidence) > 0"
    return cases.where(F.col("split").isin(*kinds)).where(ok).select(F.col("id").alias("case_id"), "split", "question", F.col("evidence").alias("spans")).dropDuplicates(["case_id"])


def loaded(development: DataFrame, holdout: DataFrame | None = None) -> DataFrame:
    """The sample of files of cases: each must be of the kind it is given as, no id in both, none against the contract; else an error."""
    parts = [("development", development)] + ([("holdout", holdout)] if holdout is not None else [])
    for kind, rows in parts:
        other = rows.where(~F.col("split").eqNullSafe(F.lit(kind))).head(1)
        if other:
            raise ValueError(f"a file of kind {other[0]['split']} was given as {kind}")
        from corpusloom.sources import files

        bad = files.invalid_cases(rows).head(1)
        if bad:
            raise ValueError(f"case {bad[0]['id']}: {bad[0]['problem']}")
    rows = development if holdout is None else development.unionByName(holdout)
    twice = sample_overlap(rows).head(1)
    if twice:
        raise ValueError(f"case {twice[0]['id']} is in both files")
    return sample(rows, ("development", "holdout"))


def sample_overlap(cases: DataFrame) -> DataFrame:
    """Ids that are both development and holdout; must be empty."""
    of = lambda s: cases.where(F.col("split") == s).select("id").distinct()
    return of("development").join(of("holdout"), "id", "left_semi")


def spans(sampled: DataFrame) -> DataFrame:
    """(case_id, span_no, source, start_line, end_line, required_together), required together by default."""
    flat = sampled.select("case_id", F.posexplode("spans").alias("at", "s"))
    return flat.select("case_id", (F.col("at") + 1).alias("span_no"), F.col("s.source").alias("source"), F.col("s.start_line").alias("start_line"), F.col("s.end_line").alias("end_line"), F.coalesce("s.required_together", F.lit(True)).alias("required_together"))


def covering(span_rows: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case_id, span_no, required_together, id): active chunks that overlap a span; id null where the source or the lines are not there (stale).

    A span's source is a document's address or id: two equi-joins, the address first. The overlap is a residual of the
    join on the document.
    """
    by_url = documents.select(F.col("url").alias("source"), F.col("id").alias("by_url")).dropDuplicates(["source"])
    by_id = documents.select(F.col("id").alias("source"), F.col("id").alias("by_id")).dropDuplicates(["source"])
    s = span_rows.join(by_url, "source", "left").join(by_id, "source", "left").withColumn("doc", F.coalesce("by_url", "by_id"))
    c = chunks.where("active").select("id", "doc_id", F.col("start_line").alias("a"), F.col("end_line").alias("z"))
    hit = s.join(c, (s["doc"] == c["doc_id"]) & (c["a"] <= s["end_line"]) & (c["z"] >= s["start_line"]), "left")
    return hit.select("case_id", "span_no", "required_together", "id").dropDuplicates(["case_id", "span_no", "id"])  # of the hits, which are few


def bundles(cover: DataFrame, ranked: DataFrame) -> DataFrame:
    """(case_id, span_no, covering, retrieved, stale, whole, broken) of ranked(query_id = case_id, id)."""
    got = ranked.select(F.col("query_id").alias("case_id"), "id", F.lit(1).alias("hit"))
    rows = cover.join(got, ["case_id", "id"], "left")
    n, r = F.count("id"), F.count("hit")
    out = rows.groupBy("case_id", "span_no").agg(n.alias("covering"), r.alias("retrieved"), (n == 0).alias("stale"), F.when(F.first("required_together"), (r == n) & (n > 0)).otherwise(r > 0).alias("whole"))
    return out.withColumn("broken", (F.col("retrieved") > 0) & ~F.col("whole"))


def case_scores(sampled: DataFrame, bundle_rows: DataFrame, ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case_id, relevant, whole, broken, recall, tokens, metadata_chunks); recall is null and tokens 0 where an annotation is stale."""
    b = bundle_rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("relevant"), F.count_if("whole").alias("whole"), F.count_if("broken").alias("broken"), F.bool_or("stale").alias("stale"))
    t = F.col("tokens") if "tokens" in chunks.columns else T.estimated_tokens(F.coalesce("text", F.lit("")))
    c = chunks.where("active").select("id", "kind", t.alias("t"))
    # the ranked side is k rows a case: it is what is small here, so repeated chunks are dropped after the join
    e = ranked.select(F.col("query_id").alias("case_id"), "id").join(c, "id").dropDuplicates(["case_id", "id"]).groupBy("case_id").agg(F.sum("t").alias("t"), F.count_if(F.col("kind") == "metadata").alias("m"))
    rows = sampled.select("case_id").join(b, "case_id", "left").join(e, "case_id", "left")
    bad = F.coalesce("stale", F.lit(True))
    zero = lambda x: F.when(bad, 0).otherwise(F.coalesce(x, F.lit(0))).cast("bigint")
    return rows.select("case_id", F.coalesce("relevant", F.lit(0)).alias("relevant"), zero(F.col("whole")).alias("whole"), zero(F.col("broken")).alias("broken"), F.when(~bad, F.round(F.col("whole") / F.col("relevant"), 6)).alias("recall"), zero(F.col("t")).alias("tokens"), zero(F.col("m")).alias("metadata_chunks"))


def summary(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, cases, scored, macro_recall, mean_tokens, metadata_chunks, broken_bundles): recall over scored cases, tokens over all."""
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"), F.count("recall").alias("scored"), F.round(F.avg("recall"), 6).alias("macro_recall"), F.round(F.avg("tokens"), 6).alias("mean_tokens"),
        F.coalesce(F.sum("metadata_chunks"), F.lit(0)).alias("metadata_chunks"), F.coalesce(F.sum("broken"), F.lit(0)).alias("broken_bundles"),
    )


def report(scores: DataFrame, frozen: DataFrame, encoder: str = "", not_run: tuple[str, ...] = ("generation",)) -> DataFrame:
    """One row: the summary with what pins it (sample, corpus, encoder), what was not run, that it is therefore not complete, and its cost of 0."""
    return summary(scores).join(frozen.drop("cases", "documents")).select(  # one row each
        "*", F.lit(encoder).alias("encoder"), F.array(*(F.lit(x) for x in not_run)).cast("array<string>").alias("not_run"), F.lit(not not_run).alias("complete"), F.lit(0).alias("cost")
    )


def section_recall(wanted: DataFrame, ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, section, chunks, retrieved, recall): of wanted(query_id, section), the share of the section's active chunks in the list; null where it has none."""
    c = chunks.where("active and id is not null").select("id", "section").dropDuplicates(["id"])
    size = c.groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    # what a list holds is counted from the list: a section's chunks never multiply with the queries that want it
    got = ranked.select("query_id", "id").distinct().join(c, "id").groupBy("query_id", "section").agg(F.count(F.lit(1)).alias("r"))
    rows = wanted.select("query_id", "section").distinct().join(size, "section", "left").join(got, ["query_id", "section"], "left")
    n, r = F.coalesce("n", F.lit(0)), F.coalesce("r", F.lit(0))
    return rows.select("query_id", "section", n.alias("chunks"), r.alias("retrieved"), F.when(n > 0, F.round(r / n, 6)).alias("recall"))


def split_and_held(queries: DataFrame, documents: DataFrame, splitters: dict[str, str]) -> dict[str, tuple[DataFrame, rank.Held]]:
    """Of documents(id, hash, snapshot), for every name: (chunks under its text splitter, the batch of queries held against them).

    What corpus.rebuilt and rank.held give, the usual fallback included, but a text is split into lines and terms once for all
    splitters, and no text is written: chunks(id, doc_id, start_line, end_line, kind, active, tokens).
    """
    from corpusloom.operators import corpus

    spark = documents.sparkSession
    kind, words, scans = rank.asked_terms(queries)
    shared = spark.sparkContext.broadcast(words)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        terms, seen = rank.Terms(shared.value), set()
        for b in batches:
            out, lines = [], []
            for doc, version, text, *own in zip(*(b.column(c).to_pylist() for c in ("id", "hash", "snapshot", *splitters))):
                if (doc, version) in seen:
                    continue
                seen.add((doc, version))
                at, ls, pieces = len(lines), split.own_lines(text), {}
                lines += ls
                for name, splitter in zip(splitters, own):
                    if splitter not in pieces:
                        pieces[splitter] = [(split.chunk_name(doc, version, splitter, a, z), doc, a, z, k, at + a - 1, at + z) for _, a, z, k in split.RULES[splitter](ls)]
                    out += [(name, *x) for x in pieces[splitter]]
            if out:
                found, bounds = terms.found(lines)
                chars = np.r_[0, np.cumsum([len(x) for x in lines])]
                name, ids, doc, a, z, k, first, last = zip(*out)
                first, last = np.array(first), np.array(last)
                ts, tfs = terms.counted(found, bounds[first], bounds[last])
                tokens = np.maximum(1, (chars[last] - chars[first] + last - first - 1) // 4)  # a line break between lines
                length = np.maximum(1, bounds[last] - bounds[first])
                columns = [pa.array(name), pa.array(ids), pa.array(doc, pa.string()), pa.array(a, pa.int32()), pa.array(z, pa.int32()), pa.array(k), pa.array([x == "body" for x in k]), pa.array(tokens, pa.int64()), pa.array(length, pa.int32()), ts, tfs]
                yield pa.RecordBatch.from_arrays(columns, ["name", "id", "doc_id", "start_line", "end_line", "kind", "body", "tokens", "length", "ts", "tfs"])

    # by document, so that a task sees all repeats of one, and few large row groups leave no core idle
    text = F.col("snapshot")
    docs = documents.select("id", "hash", "snapshot").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    docs = docs.select("*", *(corpus.effective_splitter(text, F.lit(s)).alias(n) for n, s in splitters.items()))
    fields = "id string, doc_id string, start_line int, end_line int, kind string, tokens bigint, length int, ts array<int>, tfs array<int>"
    rows = docs.mapInArrow(run, f"name string, {fields.replace('tokens', 'body boolean, tokens')}")
    path = written_at(rows.sortWithinPartitions("name", "body", "id"), "name", "body")
    chunks = spark.read.schema(f"{fields}, name string, body boolean").parquet(path)
    counts = rank.statistics(chunks.select("name", "length", "ts"), len(words))
    out = {}
    for name in splitters:
        n, mean, df = counts.get(name, (0, 1.0, np.zeros(len(words))))
        out[name] = chunks.where(F.col("name") == name).select("id", "doc_id", "start_line", "end_line", "kind", F.lit(True).alias("active"), "tokens"), rank.Held(kind, scans, f"{path}/name={name}", n, float(mean), df)
    return out


def compared(scores: dict[str, DataFrame], baseline: str) -> DataFrame:
    """(case_id, one recall column a strategy, change_<strategy> gained | lost | same | unscored against the baseline)."""
    out = None
    for name, s in scores.items():
        part = s.select("case_id", F.col("recall").alias(f"recall_{name}"))
        out = part if out is None else out.join(part, "case_id", "left")
    base = F.col(f"recall_{baseline}")
    for name in scores:
        if name != baseline:
            own = F.col(f"recall_{name}")
            out = out.withColumn(f"change_{name}", F.when(own.isNull() | base.isNull(), "unscored").when(own > base, "gained").when(own < base, "lost").otherwise("same"))
    return out


def degradation(sampled: DataFrame, bundle_rows: DataFrame, ranked: DataFrame) -> DataFrame:
    """(case_id, reason): why not all bundles came out whole: stale, zero_candidates, partial, ranked_out; none otherwise."""
    n = ranked.groupBy(F.col("query_id").alias("case_id")).agg(F.count(F.lit(1)).alias("n"))
    b = bundle_rows.groupBy("case_id").agg(F.bool_or("stale").alias("stale"), F.bool_or("broken").alias("broken"), F.bool_and("whole").alias("whole"))
    reason = F.when(F.col("stale"), "stale").when(F.col("n").isNull(), "zero_candidates").when(F.col("whole"), "none").when(F.col("broken"), "partial").otherwise("ranked_out")
    return sampled.select("case_id").join(b, "case_id").join(n, "case_id", "left").select("case_id", reason.alias("reason"))


def freeze(sampled: DataFrame, documents: DataFrame) -> DataFrame:
    """(cases, sample_hash, documents, corpus_hash): order-free hashes that pin the sample and the corpus."""
    def part(rows: DataFrame, h, name):
        once = rows.select(F.sha2(h, 256).alias("h")).distinct()
        sums = [F.coalesce(F.sum(F.conv(F.substring("h", a, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for a in (1, 9, 17, 25)]
        return once.agg(F.count(F.lit(1)).alias(name), F.sha2(F.concat_ws(":", *sums), 256).alias(f"{name}_hash"))

    a = part(sampled, F.concat_ws(":", "case_id", "question", F.array_join(F.transform("spans", lambda e: F.concat_ws("|", e["source"], e["start_line"].cast("string"), e["end_line"].cast("string"), F.array_join(F.coalesce(e["must_include"], F.array().cast("array<string>")), "~"), e["required_together"].cast("string"))), ";")), "cases")
    b = part(documents, F.concat_ws(":", "id", "hash", "splitter"), "documents")
    return a.join(b)  # one row each


def rounds(ranked: DataFrame, k: int, n: int = 3) -> DataFrame:
    """(query_id, id, first_round): evidence of widening rounds k, 2k, ... by the round in which it is first seen."""
    return ranked.where(F.col("rank") <= k * n).select("query_id", "id", F.ceil(F.col("rank") / k).cast("int").alias("first_round"))


def stop_reasons(queries: DataFrame, evidence: DataFrame, n: int = 3, required: DataFrame | None = None) -> DataFrame:
    """(query_id, rounds, chunks, stop_reason): a round without fresh evidence stops with no_new_evidence, reaching all of required(query_id, id) with sufficient, else round_limit."""
    by = evidence.groupBy("query_id", "first_round").agg(F.count(F.lit(1)).alias("fresh"))
    last = by.groupBy("query_id").agg(F.max("first_round").alias("last"), F.sum("fresh").alias("chunks"))
    rows = queries.select("query_id").join(last, "query_id", "left").select("query_id", F.coalesce("last", F.lit(0)).alias("last"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    done = F.lit(None).cast("int")
    if required is not None:
        need = required.join(evidence, ["query_id", "id"], "left").groupBy("query_id").agg(F.bool_and(F.col("first_round").isNotNull()).alias("all"), F.max("first_round").alias("at"))
        rows = rows.join(need, "query_id", "left")
        done = F.when(F.col("all"), F.col("at"))
    stop = F.when(done.isNotNull(), "sufficient").when(F.col("last") < n, "no_new_evidence").otherwise("round_limit")
    ran = F.when(done.isNotNull(), done).otherwise(F.least(F.lit(n), F.col("last") + 1))
    return rows.select("query_id", ran.cast("int").alias("rounds"), "chunks", stop.alias("stop_reason"))


def supplement_modes(queries: DataFrame, ranked: DataFrame, k: int, n: int = 3) -> DataFrame:
    """(query_id, mode, rounds, reached, stop_reason, change): one round (off), the same search again (on), and wider ones k, 2k, ... (widening).

    change compares the reached chunks with those of off: gained where they are a proper superset, else same.
    """
    sets = ranked.groupBy("query_id").agg(*(F.array_sort(F.collect_set(F.when(F.col("rank") <= k * i, F.col("id")))).alias(f"s{i}") for i in range(1, n + 1)))
    none = F.array().cast("array<string>")
    rows = queries.select("query_id").distinct().join(sets, "query_id", "left").select("query_id", *(F.coalesce(f"s{i}", none).alias(f"s{i}") for i in range(1, n + 1)))
    dry = F.lit(n - 1)  # supplementary rounds until one brings nothing new
    for i in range(n, 1, -1):
        dry = F.when(F.size(f"s{i}") == F.size(f"s{i - 1}"), i - 1).otherwise(dry)
    stopped = F.lit(False)
    for i in range(2, n + 1):
        stopped = stopped | (F.size(f"s{i}") == F.size(f"s{i - 1}"))
    modes = F.array(
        F.struct(F.lit("off").alias("mode"), F.lit(0).alias("rounds"), F.col("s1").alias("reached"), F.lit("round_limit").alias("stop_reason")),
        F.struct(F.lit("on").alias("mode"), F.lit(1).alias("rounds"), F.col("s1").alias("reached"), F.lit("no_new_evidence").alias("stop_reason")),
        F.struct(F.lit("widening").alias("mode"), dry.alias("rounds"), F.col(f"s{n}").alias("reached"), F.when(stopped, "no_new_evidence").otherwise("round_limit").alias("stop_reason")),
    )
    gained = (F.size(F.array_except("m.reached", "s1")) > 0) & (F.size(F.array_except("s1", "m.reached")) == 0)
    return rows.select("query_id", "s1", F.explode(modes).alias("m")).select("query_id", "m.mode", "m.rounds", F.size("m.reached").alias("reached"), "m.stop_reason", F.when(gained, "gained").otherwise("same").alias("change"))


def stop_histogram(modes: DataFrame) -> DataFrame:
    """(mode, stop_reason, queries)."""
    return modes.groupBy("mode", "stop_reason").agg(F.count(F.lit(1)).alias("queries"))


def bounded_rounds(passes: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, stop_reason, supplementary_rounds, evidence array<id>) of passes(query_id, round, late, broke, failed, candidates, sufficient, required).

    A pass is one round of a query: late and broke say that the time or the budget was out when it began, failed that its
    search broke down, candidates array<struct<id, fields array<string>>> what it returned, sufficient what the answer
    made of it, required array<string> the ids that suffice (the same in all rounds; null or empty: none). The order within a
    round: time, budget, search, vetting (no id, or a field that asks for a tool), from round 1 on no new evidence, sufficient,
    all required, the limit of `most` supplementary rounds. Evidence is the union by first sight. A round that is missing
    stops as one without new evidence. At most three rows a query are gathered.
    """
    tools = F.array(*(F.lit(x) for x in ("tool", "tool_call", "function_call", "arguments")))
    rows = passes.where(F.col("round").between(0, most)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("round", "late", "broke", "failed", "candidates", "sufficient", "required"))).alias("ps"))
    none = F.array().cast("array<string>")
    zero = F.struct(F.lit(None).cast("string").alias("stop"), F.lit(0).alias("at"), none.alias("known"))

    def step(s, p):
        yes = lambda c: F.coalesce(c, F.lit(False))
        given = F.coalesce(p["candidates"], F.array().cast("array<struct<id:string,fields:array<string>>>"))
        unfit = F.exists(given, lambda c: c["id"].isNull() | yes(F.arrays_overlap(c["fields"], tools)))
        early = F.when(yes(p["late"]), "timeout").when(yes(p["broke"]), "budget").when(yes(p["failed"]) | unfit, "error")
        known = F.when(early.isNotNull(), s["known"]).otherwise(F.array_union(s["known"], F.transform(given, lambda c: c["id"])))
        need = F.coalesce(p["required"], none)
        late = (
            F.when((p["round"] >= 1) & (F.size(known) == F.size(s["known"])), "no_new_evidence")
            .when(yes(p["sufficient"]) | ((F.size(need) > 0) & (F.size(F.array_except(need, known)) == 0)), "sufficient")
            .when(p["round"] >= most, "round_limit")
        )
        skipped = p["round"] > s["at"] + F.when(F.size(s["known"]) + s["at"] > 0, 1).otherwise(0)
        now = F.struct(F.coalesce(early, late).alias("stop"), p["round"].cast("int").alias("at"), known.alias("known"))
        gap = F.struct(F.lit("no_new_evidence").alias("stop"), s["at"].alias("at"), s["known"].alias("known"))
        return F.when(s["stop"].isNotNull(), s).when(skipped & (p["round"] > 1), gap).otherwise(now)

    out = rows.select("query_id", F.aggregate("ps", zero, step).alias("s"))
    return out.select("query_id", F.coalesce("s.stop", F.lit("no_new_evidence")).alias("stop_reason"), F.when(F.col("s.stop").isNull(), F.col("s.at") + 1).otherwise(F.col("s.at")).alias("supplementary_rounds"), F.col("s.known").alias("evidence"))
