"""Answer contracts, cost and the spend ledger over tables of answers and calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions import text as T

#: Type of a stored answer
ANSWER = (
    "claims array<struct<text:string,citations:array<string>>>, citations array<struct<id:string,quote:string,translation:string>>,"
    " coverage array<struct<question_id:string,claims:array<int>,missing:string>>, status string, missing string"
)
LIMIT = 10_000_000  # fixed value: the budget in millionths
STRETCH = 10_000  # calls of an account summed in one place, about


def _blank(c: Column) -> Column:
    return T.is_blank(c)


def first_problem(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that is broken, null if none is; a rule that cannot be decided counts as broken."""
    out = F.lit(None).cast("string")
    for ok, name in reversed(rules):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def covered(answers: DataFrame) -> DataFrame:
    """answers(answer_id, question, claims, coverage) with problem, and status and missing as the coverage decides them.

    Every question part has one coverage row, in order; claim numbers are in range and named once; a row has claims or a
    named gap; every claim is used. All of it is arrays of one row: no exchange.
    """
    q = T.question_parts(F.col("question"))
    n = F.size("claims")
    gap = lambda r: ~_blank(r["missing"])
    used = F.array_distinct(F.flatten(F.transform("coverage", lambda r: r["claims"])))
    rules = [
        (F.col("claims").isNotNull(), "no claims array"),
        (F.col("coverage").isNotNull() & (F.size("coverage") == F.size(q)), "coverage is not one row a question"),
        (F.transform("coverage", lambda r: r["question_id"]) == F.transform(q, lambda p: p["id"]), "question ids or their order"),
        (F.forall("coverage", lambda r: r["claims"].isNotNull() & r["missing"].isNotNull() & F.forall(r["claims"], lambda i: (i >= 0) & (i < n)) & (F.size(F.array_distinct(r["claims"])) == F.size(r["claims"]))), "claim numbers or gap"),
        (F.forall("coverage", lambda r: (F.size(r["claims"]) > 0) | gap(r)), "neither claims nor gap"),
        ((F.size(used) == n), "a claim is not used"),
    ]
    answered, gaps = F.exists("coverage", lambda r: F.size(r["claims"]) > 0), F.exists("coverage", gap)
    status = F.when(gaps & answered, "partial").when(answered, "grounded").otherwise("insufficient")
    named = F.transform(F.filter(F.arrays_zip(F.col("coverage").alias("c"), q.alias("q")), lambda z: gap(z["c"])), lambda z: F.concat(z["q"]["text"], F.lit("："), F.regexp_replace(z["c"]["missing"], r"(?U)^\s+|\s+$", "")))
    rows = answers.withColumn("problem", first_problem(rules))
    good = F.col("problem").isNull()
    return rows.withColumns({"status": F.when(good, status), "missing": F.when(good, F.array_join(named, "\n"))})


def normalised(answers: DataFrame) -> DataFrame:
    """answers with inline citations (objects, as JSON text, in place of an id) turned into ids, and normalised, inline_ok.

    Only an exact repetition of one of the answer's own citations becomes its id; any other object is left, and inline_ok is false.
    """
    own = lambda x: F.from_json(x, "id string, quote string, translation string")
    inline = lambda x: F.coalesce(x.startswith("{"), F.lit(False))
    known = lambda x: F.coalesce(F.exists("citations", lambda c: (c["id"] == own(x)["id"]) & (c["quote"] == own(x)["quote"]) & (c["translation"] == own(x)["translation"])), F.lit(False))
    cited = F.flatten(F.transform("claims", lambda c: F.coalesce(c["citations"], F.array().cast("array<string>"))))
    claims = F.transform("claims", lambda c: F.struct(c["text"].alias("text"), F.transform(c["citations"], lambda x: F.when(inline(x) & known(x), own(x)["id"]).otherwise(x)).alias("citations")))
    rows = answers.withColumns({"normalised": F.coalesce(F.exists(cited, inline), F.lit(False)), "inline_ok": F.coalesce(F.forall(F.filter(cited, inline), known), F.lit(True))})
    return rows.withColumn("claims", claims)


def validated(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, status, problem, quotes, normalised, scope) of answers(answer_id, status, missing, claims, citations) against evidence(answer_id, id, text).

    scope is missing_context where a sound answer is insufficient and still cites what it found. Quotes must be verbatim in the cited evidence of the same answer: an equi-join on (answer_id, id), containment as
    its residual, never a join on containment alone.
    """
    c = answers.select("answer_id", F.posexplode("citations").alias("at", "c")).select("answer_id", "at", F.col("c.id").alias("id"), F.col("c.quote").alias("quote"), F.col("c.translation").alias("translation"))
    e = evidence.select("answer_id", "id", F.col("text").alias("evidence_text")).dropDuplicates(["answer_id", "id"])
    checked = c.join(e, ["answer_id", "id"], "left")
    twice = F.count(F.lit(1)).over(Window.partitionBy("answer_id", "id", "quote", "translation"))
    checked = checked.withColumn("twice", twice > 1)
    per = checked.groupBy("answer_id").agg(
        F.bool_and(F.col("evidence_text").isNotNull()).alias("known"), F.bool_and(~_blank(F.col("quote")) & F.coalesce(F.contains("evidence_text", "quote"), F.lit(False))).alias("verbatim"),
        F.bool_and(~_blank(F.col("translation"))).alias("translated"), F.bool_and(~F.col("twice")).alias("single"), F.collect_set("id").alias("ids"), F.count(F.lit(1)).alias("quotes"),
    )
    rows = normalised(answers).join(per, "answer_id", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n = F.coalesce("quotes", F.lit(0))
    some = lambda x: F.coalesce(x, F.lit(True))
    claimed, gap = F.size("claims") > 0, ~_blank(F.col("missing"))
    rules = [
        (F.col("status").isin("grounded", "partial", "insufficient"), "status"),
        (F.col("missing").isNotNull(), "missing is no text"),
        (F.col("claims").isNotNull() & F.col("citations").isNotNull(), "claims or citations are no arrays"),
        (some(F.col("known")), "unknown citation"),
        (some(F.col("verbatim")), "quote is not verbatim"),
        (some(F.col("translated")), "translation is blank"),
        (some(F.col("single")), "citation twice"),
        (F.col("inline_ok"), "inline citation differs"),
        (F.forall("claims", lambda x: ~_blank(x["text"]) & (F.coalesce(F.size(x["citations"]), F.lit(0)) > 0) & F.forall(x["citations"], lambda i: F.array_contains(ids, i))), "claim without valid citation"),
        (F.when(F.col("status") == "insufficient", ~claimed & gap).otherwise(claimed & (n > 0)), "claims do not fit the status"),
        ((F.col("status") != "partial") | gap, "partial without a gap"),
        ((F.col("status") != "grounded") | ~gap, "grounded with a gap"),
    ]
    scope = F.when(F.col("problem").isNull() & (F.col("status") == "insufficient") & (n > 0), "missing_context")
    return rows.withColumn("problem", first_problem(rules)).select("answer_id", "status", "problem", n.alias("quotes"), "normalised", scope.alias("scope"))


def replayed(runs: DataFrame) -> DataFrame:
    """validated, for the model texts stored in runs(id, result), against the evidence of the retrieval run that each names; no network.

    A run without model text has the problem "no model text", one whose retrieval run is gone "unknown citation".
    """
    text = F.get_json_object("result", "$.model_output")
    a = runs.select(F.col("id").alias("answer_id"), text.alias("model"), F.get_json_object("result", "$.retrieval_run_id").alias("of"))
    parsed = a.where("model is not null").select("answer_id", "of", F.from_json("model", ANSWER).alias("m")).select("answer_id", "of", "m.*")
    found = runs.select(F.col("id").cast("string").alias("of"), F.explode(F.from_json(F.get_json_object("result", "$.candidates"), "array<struct<id:string,text:string>>")).alias("c")).select("of", "c.id", "c.text")
    evidence = parsed.select("answer_id", "of").join(found, "of").select("answer_id", "id", "text")
    none = a.where("model is null").select("answer_id", F.lit(None).cast("string").alias("status"), F.lit("no model text").alias("problem"), F.lit(0).cast("bigint").alias("quotes"), F.lit(False).alias("normalised"), F.lit(None).cast("string").alias("scope"))
    return validated(parsed.drop("of"), evidence).unionByName(none)


def redacted(text: Column, secret: str) -> Column:
    """Text without a secret, wherever it occurs; an empty secret changes nothing."""
    return F.replace(text, F.lit(secret), F.lit("[redacted]")) if secret else text


def cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Millionths of the currency, rounded up; prices are per million tokens. Null or negative prices or counts: null."""
    ok = (input_tokens >= 0) & (output_tokens >= 0) & (input_price >= 0) & (output_price >= 0)
    return F.when(ok, F.ceil(input_tokens.cast("decimal(20,0)") * input_price + output_tokens.cast("decimal(20,0)") * output_price).cast("bigint"))


def ledger_summary(calls: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(limit_amount, spent, held, available, blocked) of calls(id, status, reserved, spent); pending and unknown calls hold their reserve."""
    open_ = F.col("status").isin("pending", "unknown")
    held = F.coalesce(F.sum(F.when(open_, F.col("reserved"))), F.lit(0))
    spent = F.coalesce(F.sum("spent"), F.lit(0))
    return calls.agg(F.lit(limit).cast("bigint").alias("limit_amount"), spent.alias("spent"), held.alias("held"), (F.lit(limit) - spent - held).alias("available"), F.coalesce(F.bool_or(open_), F.lit(False)).alias("blocked"))


def last_state(events: DataFrame) -> DataFrame:
    """calls from transitions (id, at, status, reserved, spent): the last state of every call."""
    s = F.max_by(F.struct("status", "reserved", "spent"), F.struct("at", "status"))
    return events.groupBy("id").agg(s.alias("s")).select("id", "s.*")


def settlement_problems(calls: DataFrame) -> DataFrame:
    """(id, problem) of settled calls that cost more than was reserved for them."""
    return calls.where("status = 'settled' and spent > reserved").select("id", F.lit("spent more than reserved").alias("problem"))


def _in_order(by: str, limit: int):
    """mapInPandas function over calls sorted by account and time: the rule, one state carried from batch to batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        account, spent, blocked = None, 0, False
        for b in batches:
            accepted, before = [], []
            for who, amount, cost_, open_ in zip(b[by], b["amount"], b["cost"], b["open"]):
                if account is None or who != account:
                    account, spent, blocked = who, 0, False
                before.append(spent)
                ok = not blocked and not pd.isna(amount) and amount >= 0 and spent + amount <= limit
                accepted.append(ok)
                if ok:
                    blocked = bool(open_)
                    spent += 0 if open_ else int(cost_)
            yield b[[by, "at", "id", "amount"]].assign(accepted=accepted, spent_before=before)

    return run


def guarded(calls: DataFrame, by: str = "account", limit: int = LIMIT) -> DataFrame:
    """(by, at, id, amount, accepted, spent_before): reservations of an account in order (at, id), each accepted or refused.

    A call is refused while an accepted one is pending or unknown (column status, if there is one), if its amount is null
    or negative, or if what is spent and its amount exceed the limit. An accepted, settled call costs its spent (column, if
    there is one), else its amount. Calls without account drop out.

    Accounts in which nothing can be refused need sums only: of stretches of time first, then within a stretch, so a large
    account is spread over tasks. The others are sequential by nature and pass through one task an account, in order, with
    one number of state.
    """
    open_ = F.col("status").isin("pending", "unknown") if "status" in calls.columns else F.lit(False)
    cost_ = F.coalesce(F.col("spent"), F.col("amount")) if "spent" in calls.columns else F.col("amount")
    rows = calls.where(F.col(by).isNotNull()).select(by, "at", "id", "amount", F.coalesce(open_, F.lit(False)).alias("open"), cost_.cast("bigint").alias("cost"))
    dated = rows.schema["at"].dataType.simpleString().startswith(("timestamp", "date"))
    moment = (F.col("at").cast("timestamp") if dated else F.col("at")).cast("double")
    kind = rows.schema[by].dataType.simpleString()
    schema = f"`{by}` {kind}, at {rows.schema['at'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, amount {rows.schema['amount'].dataType.simpleString()}, accepted boolean, spent_before bigint"
    hard = F.bool_or(F.col("open") | F.col("amount").isNull() | (F.col("amount") < 0) | (F.col("cost") < 0)) | (F.sum(F.greatest("amount", "cost")) > limit)
    totals = rows.groupBy(by).agg(F.coalesce(hard, F.lit(True)).alias("hard"), F.min(moment).alias("first"), F.max(moment).alias("last"), F.count(F.lit(1)).alias("n"))
    marked = rows.join(totals, by)
    folded = marked.where("hard").select(*rows.columns).repartition(by).sortWithinPartitions(by, "at", "id").mapInPandas(_in_order(by, limit), schema)
    easy = marked.where("not hard").withColumn("stretch", F.coalesce(F.floor((moment - F.col("first")) / F.nullif(F.col("last") - F.col("first"), F.lit(0.0)) * F.col("n") / STRETCH), F.lit(0)))
    sums = easy.groupBy(by, "stretch").agg(F.sum("cost").alias("t"))
    before = sums.select(by, "stretch", (F.sum("t").over(Window.partitionBy(by).orderBy("stretch")) - F.col("t")).alias("before"))
    inner = F.sum("cost").over(Window.partitionBy(by, "stretch").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1))
    summed = easy.join(before, [by, "stretch"]).select(by, "at", "id", "amount", F.lit(True).alias("accepted"), (F.col("before") + F.coalesce(inner, F.lit(0))).alias("spent_before"))
    return folded.unionByName(summed)
