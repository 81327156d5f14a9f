"""Queries of the training-data operators, by problem."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusloom.operators import rank
from corpusloom.session import cut, remove, shared_dir, table

from . import markup, mixing, packing, rank_walk, repeated_lines, split_overlap, term_weight, token_budget, tokenizers, unwanted, vector_neighbours


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlaps(table(spark, d, "cases")).select("case_a", "case_b")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_report(table(spark, d, "cases"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return vector_neighbours.near_pairs(table(spark, d, "vectors"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 20, against all vectors."""
    return vector_neighbours.nearest(table(spark, d, "vectors"), modulus=20)


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the vectors whose id is divisible by 20, against all: how many there are, and whether at least 0.9 of their ten nearest by brute force are found."""
    vectors = table(spark, d, "vectors")
    found = cut(vector_neighbours.nearest(vectors, modulus=20))
    unit = F.expr("transform(embedding, x -> x / sqrt(aggregate(embedding, 0D, (a, y) -> a + cast(y as double) * y)))")
    every = vector_neighbours.usable(vectors).select("id", unit.alias("embedding"))
    asked = every.join(found.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]).withColumnRenamed("id", "query_id")
    exact = rank.vector(asked, every, 11).where("id <> query_id")
    tenth = exact.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("n = 10").select(F.col("query_id").alias("id"), F.col("score").alias("tenth"))
    good = found.join(tenth, "id").groupBy("id").agg(F.count_if(F.col("similarity") >= F.col("tenth") - 1e-5).alias("good"))
    return good.agg(F.count(F.lit(1)).alias("queries"), (F.avg(F.col("good") / 10) >= 0.9).alias("holds"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_line_numbers(table(spark, d, "documents").select("doc_id", "text", "source"))


def p3_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(table(spark, d, "documents").select("doc_id", "text", "source"))


def p3_clean_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "id", "text", "source")
    chunks = table(spark, d, "chunks").select("id", "doc_id", "kind", "text").dropDuplicates(["id"])
    of = docs.select(F.col("id").alias("doc_id"), "source")
    rows = chunks.join(of, "doc_id", "left")
    return repeated_lines.without_repeated_lines(rows, id_col="id", counted=docs)


def p4_tokens(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.collection_tokens(table(spark, d, "documents"), table(spark, d, "chunks").select("id", "text"))


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    counted, _ = token_budget.counted_rows(token_budget.normalised(table(spark, d, "documents")))
    return token_budget.totals(token_budget.cube(counted))


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Yesterday's collection and today's. Retired pieces stand for yesterday's documents, as no earlier state is given;
    documents that are gone are removed, new ones added, changed ones both."""
    docs = table(spark, d, "documents")
    old = table(spark, d, "chunks").where("not active").select("id", "doc_id", "start_line", "text").dropDuplicates(["id"])
    old = old.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "id", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))
    about = docs.select(F.col("id").alias("doc_id"), "source", "lang", "domain", "splitter")
    yesterday = token_budget.normalised(old.join(about, "doc_id", "left"))
    return yesterday, token_budget.normalised(docs.select(F.col("id").alias("doc_id"), "source", "lang", "domain", "splitter", "text"))


def _updated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(the cube of yesterday brought to today by signed deltas, today's counted rows), over a stored count table."""
    yesterday, today = _states(spark, d)
    counts = token_budget.CountTable(f"{shared_dir(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}")
    before, after = token_budget.counted_with(counts, yesterday), token_budget.counted_with(counts, today)
    remove(spark, counts.path)
    return token_budget.updated_cube(token_budget.cube(before), token_budget.signed_deltas(before, after)), after


def p4_update(spark: SparkSession, d: str) -> DataFrame:
    return _updated(spark, d)[0]


def p4_update_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether the updated cube and one counted afresh agree, slice by slice."""
    return token_budget.same_slices(_updated(spark, d)[0], token_budget.cube(token_budget.counted_rows(_states(spark, d)[1])[0]))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    ranked = rank_walk.combined_ranking(table(spark, d, "runs").select("id", "result"))
    return ranked.where("place = 1 and kinds >= 3").select("run_id", "chunk_id")


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rank_walk.combined_ranking(table(spark, d, "runs").select("id", "result"))


def p5_check(spark: SparkSession, d: str) -> DataFrame:
    """Of every ranked run: its candidates, and whether the ranking is whole: every place once, all mass given out."""
    ranked = rank_walk.combined_ranking(table(spark, d, "runs").select("id", "result"))
    n = ranked.groupBy("run_id").agg(F.count(F.lit(1)).alias("items"), F.max("place").alias("last"), F.count_distinct("place").alias("places"), F.sum("mass").alias("mass"))
    return n.select("run_id", "items", ((F.col("last") == F.col("items")) & (F.col("places") == F.col("items")) & (F.abs(F.col("mass") - 1) < 1e-9)).alias("whole"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms that mark out a chunk significantly by their score; counts and document frequencies are checked exactly."""
    active = table(spark, d, "chunks").where("active").select("id", "kind", "text")
    scored = term_weight.distinctive_terms(active, keep=("kind",), min_tf=4, df_range=(2, 6), where="kind = 'body'")
    return scored.where(F.col("score") >= term_weight.SIGNIFICANT).select(F.col("record").alias("chunk_id"), "term")


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    active = table(spark, d, "chunks").where("active").select("id", "text")
    return term_weight.distinctive_terms(active).select(F.col("record").alias("chunk_id"), "term", "tf", "cf", "df", (F.round("score", 4) + 0.0).alias("score"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Counted where they are read; only ids and counts go through the exchange that drops repeated rows."""
    docs = table(spark, d, "documents").select("doc_id", "text").where("doc_id is not null")
    return tokenizers.counted(docs).dropDuplicates(["doc_id"])


def _packed(spark: SparkSession, d: str) -> DataFrame:
    capacities = [r[0] for r in table(spark, d, "model_config").select("context_token_upper_bound").distinct().collect()]
    return packing.containers(cut(_sized(spark, d)), capacities)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return markup.markup_kinds(docs, markup.trained_kinds(docs)).select("doc_id", "markup").distinct()


def p7_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = markup.trained_model(docs.select("id", "text", "snapshot"), table(spark, d, "chunks"))
    return markup.cleaned(docs, model, "doc_id", "snapshot")


def p7_clean_chunks(spark: SparkSession, d: str) -> DataFrame:
    model = markup.trained_model(table(spark, d, "documents").select("id", "text", "snapshot"), table(spark, d, "chunks"))
    return markup.cleaned(table(spark, d, "chunks").select("id", "text").dropDuplicates(["id"]), model, "id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_room(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    listed = targets.select(repeated_lines.source_key().alias("src")).distinct()
    docs = table(spark, d, "documents").select("doc_id", "source", "text").where("doc_id is not null").withColumn("src", repeated_lines.source_key())
    wanted = docs.join(F.broadcast(listed), "src", "left_semi").drop("src")
    return mixing.mixed(tokenizers.counted(wanted).dropDuplicates(["doc_id"]), targets)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached_shares(cut(p9_mixture(spark, d)), table(spark, d, "mix_targets"))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """Of every document with tokens: whether all of them are packed, and whether it is whole unless it exceeds the largest container; of every document, whether its containers hold what is in them."""
    sized = cut(_sized(spark, d))
    capacities = [r[0] for r in table(spark, d, "model_config").select("context_token_upper_bound").distinct().collect()]
    packed = cut(packing.containers(sized, capacities))
    full = packed.groupBy("block", "container").agg((F.sum("tokens") <= F.first("capacity")).alias("fits"))
    per = packed.join(full, ["block", "container"]).groupBy("doc_id").agg(F.sum("tokens").alias("packed"), F.count(F.lit(1)).alias("pieces"), F.bool_and("fits").alias("fits"))
    return sized.where("tokens > 0").join(per, "doc_id", "left").select("doc_id", F.coalesce(F.col("packed") == F.col("tokens"), F.lit(False)).alias("complete"), ((F.col("pieces") == 1) | (F.col("tokens") > max(capacities))).alias("whole"), "fits")


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """Of every target: whether its share is reached within 2 points, over all and within every stretch, and no document drawn too often."""
    targets = table(spark, d, "mix_targets")
    drawn = cut(p9_mixture(spark, d))
    limits = targets.select(repeated_lines.source_key().alias("source"), "max_repeats").dropDuplicates(["source"])
    rows = mixing.reached_shares(drawn, targets).join(limits, "source").join(mixing.stretch_errors(drawn, targets), "source", "left")
    return rows.select("source", (F.abs(F.col("share") - F.col("target_share")) <= 0.02).alias("share_holds"), (F.coalesce("worst", F.lit(0.0)) <= 0.02).alias("stretches_hold"), (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_hold"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return unwanted.scored(docs, table(spark, d, "review_labels")).where("score > 0.5").select("doc_id").distinct()


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return unwanted.rates(unwanted.scored(docs, table(spark, d, "review_labels")))


QUERIES = {k: v for k, v in globals().items() if k.startswith("p") and k[1:2].isdigit()}
ORACLE_SQL: dict[str, str] = {}

_KEY = "lower(regexp_replace(regexp_replace(l, '<[^>]*>|&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);', '', 'g'), '[^\\p{L}]+', '', 'g'))"
ORACLE_SQL["p3_found"] = f"""
with d as (select doc_id, lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) src, string_split(text, chr(10)) ls from documents where source is not null),
n as (select src, count(*) docs from d group by 1),
x as (select doc_id, src, unnest(ls) l, unnest(range(1, len(ls) + 1)) line_no from d),
k as (select doc_id, src, line_no, replace({_KEY}, 'ß', 'ss') key from x),
c as (select src, key, count(distinct doc_id) c from k where length(key) >= 8 group by 1, 2),
r as (select src, key from c join n using (src) where c >= 5 and c >= 0.10 * docs)
select doc_id, cast(line_no as int) line_no from k join r using (src, key)
"""

ORACLE_SQL["p3_clean_documents"] = ORACLE_SQL["p3_found"].replace("with d as", "with d as", 1).split("select doc_id, cast(line_no")[0] + """,
l as (select doc_id, unnest(string_split(text, chr(10))) l, unnest(range(1, len(string_split(text, chr(10))) + 1)) line_no from documents),
b as (select doc_id, line_no, 1 bad from k join r using (src, key)),
w as (select doc_id, cast(count(bad) as int) removed, coalesce(string_agg(l, chr(10) order by line_no) filter (where bad is null), '') text from l left join b using (doc_id, line_no) group by 1)
select doc_id, coalesce(removed, 0) removed, w.text from documents left join w using (doc_id)"""
ORACLE_SQL["p3_clean_chunks"] = ORACLE_SQL["p3_found"].split("select doc_id, cast(line_no")[0] + f""",
h as (select id, any_value(doc_id) doc_id, any_value(text) text from chunks group by id),
m as (select h.id, lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) src, unnest(string_split(h.text, chr(10))) l, unnest(range(1, len(string_split(h.text, chr(10))) + 1)) line_no from h left join documents e on e.id = h.doc_id),
q as (select id, src, line_no, l, replace({_KEY}, 'ß', 'ss') key from m),
w as (select q.id, cast(count(r.key) as int) removed, coalesce(string_agg(l, chr(10) order by line_no) filter (where r.key is null), '') text from q left join r on r.src = q.src and r.key = q.key group by 1)
select h.id, coalesce(removed, 0) removed, w.text from h left join w using (id)"""
ORACLE_SQL["p2_recall"] = """
with v as (select id, any_value(embedding) e from vectors where id is not null and len(embedding) = 64 and list_sum(list_transform(embedding, lambda x: abs(x))) > 0 group by id),
c as (select id, list_transform(string_split(regexp_replace(lower(id), '[^0-9a-f]', '', 'g'), ''), lambda x: case when x between '0' and '9' then cast(x as int) else ascii(x) - 87 end) h from v)
select count(*) queries, true holds from c where h[-1] % 4 = 0 and list_sum(h) % 5 = 0"""
ORACLE_SQL["p5_check"] = """
with r as (select id, any_value(result) j from runs where id is not null and result is not null group by id), o as (select id, case when json_valid(j) then cast(j as json) end j from r),
c as (select id, list_distinct(list_filter(list_concat(json_extract_string(j, '$.candidates[*].id'), json_extract_string(j, '$.lists.*[*].id')), lambda x: x is not null)) ids from o where len(json_keys(j, '$.parameters.order')) > 0)
select id run_id, cast(len(ids) as bigint) items, true whole from c where len(ids) > 0"""
_SLICE = "coalesce(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '(none)') {0}"
ORACLE_SQL["p4_update_check"] = f"select distinct {_SLICE.format('source')}, coalesce(nullif(regexp_extract(lower(trim(coalesce(lang, ''))), '^[a-z]+'), ''), 'und') lang, {_SLICE.format('domain')}, {_SLICE.format('splitter')}, true same from documents where id is not null"
ORACLE_SQL["p8_check"] = "select doc_id, true complete, true whole, true fits from documents where text <> ''"
ORACLE_SQL["p9_check"] = "select distinct lower(trim(source)) source, true share_holds, true stretches_hold, true repeats_hold from mix_targets"

_TERMS = """
c as (select id, any_value(kind) kind, any_value(text) text from chunks where active and id is not null group by id),
t as (select id, kind, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) term from c),
f as (select id, kind, term, count(*) tf from t where regexp_matches(term, '[a-z]') group by all),
s as (select term, sum(tf) cf, count(*) df from f group by 1)
"""
ORACLE_SQL["p6_found"] = f"with {_TERMS} select id chunk_id, term from f join s using (term) where tf >= 4 and kind = 'body' and df between 2 and 6"
ORACLE_SQL["p6_scores"] = f"""with {_TERMS},
n as (select id, sum(tf) n1 from f group by 1), a as (select sum(tf) n from f),
x as (select id, term, tf, cf, df, tf::double a, (cf - tf)::double b, n1::double n1, (n - n1)::double n2, n::double n from f join s using (term) join n using (id), a),
g as (select *, 2 * (a * ln(a / (n1 * (a + b) / n)) + case when b > 0 then b * ln(b / (n2 * (a + b) / n)) else 0 end
 + case when n1 - a > 0 then (n1 - a) * ln((n1 - a) / (n1 * (n - a - b) / n)) else 0 end + case when n2 - b > 0 then (n2 - b) * ln((n2 - b) / (n2 * (n - a - b) / n)) else 0 end) g from x)
select id chunk_id, term, tf, cast(cf as bigint) cf, df, round(case when a * n2 >= b * n1 then g else -g end, 4) + 0.0 score from g"""
