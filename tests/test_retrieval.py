import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import evaluate, index, rank

ROWS = [("a", "body", "apple pie apple", True), ("b", "metadata", "apple apple apple", True), ("c", "body", "pie crust and pie", True), ("d", "body", "apple", False), ("e", "body", None, True), ("c", "body", "pie crust and pie", True), ("f", "body", "提示注入 is prompt injection", True)]


def chunks(spark):
    return spark.createDataFrame([(i, k, t, a, f"D{i}", 1, 3) for i, k, t, a in ROWS], "id string, kind string, text string, active boolean, doc_id string, start_line int, end_line int")


def asked(spark, text):
    return rank.one_query(spark, text)


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_keyword_and_bm25_tie_rules(spark):
    c = chunks(spark)
    assert ids(rank.keyword(asked(spark, "apple pie"), c, 5)) == ["a", "c", "b"]
    got = rank.bm25(asked(spark, "apple"), c, 5).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["a", "b"]  # body first although b scores higher
    assert got[1]["score"] > got[0]["score"]


def test_bm25_formula(spark):
    n, lengths, tf = 5, {"a": 3, "b": 3, "c": 4, "e": 1, "f": 4}, {"a": 2, "b": 3}
    avg = sum(lengths.values()) / n
    idf = math.log(1 + (n - 2 + 0.5) / 2.5)
    for r in rank.bm25(asked(spark, "apple"), chunks(spark)).collect():
        t = tf[r["id"]]
        assert r["score"] == pytest.approx(idf * t * 2.5 / (t + 1.5 * (0.25 + 0.75 * lengths[r["id"]] / avg)), abs=1e-6)


def test_more_queries_than_a_block(spark, monkeypatch):
    q = spark.createDataFrame([(i, ["apple pie", "crust", "  ", "提示注入 pie", "nothing"][i % 5]) for i in range(40)], "query_id int, text string")
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())
    whole = [key(f(q, chunks(spark), 3)) for f in (rank.keyword, rank.bm25)]
    monkeypatch.setattr(rank, "QUERY_BLOCK", 7)
    monkeypatch.setattr(rank, "QUERY_SCAN", 15)
    monkeypatch.setattr(rank, "CELLS", 1)
    assert whole == [key(f(q, chunks(spark), 3)) for f in (rank.keyword, rank.bm25)] and whole[0]
    assert sorted(r["query_id"] for r in rank.refused(q).collect()) == [i for i in range(40) if i % 5 == 2]


def test_exclusion_keeps_the_order(spark):
    none = spark.createDataFrame([], "doc_id string")
    assert ids(rank.excluding(rank.bm25, asked(spark, "apple"), chunks(spark), none, 5)) == ["a", "b"]
    assert ids(rank.excluding(rank.bm25, asked(spark, "apple"), chunks(spark), spark.createDataFrame([("Da",), ("Da",)], "doc_id string"), 5)) == ["b"]


def test_vector_index(spark):
    c = chunks(spark)
    e = index.hash_encoder()
    stored = index.build(c, e)
    q = spark.createDataFrame([("q", "apple pie apple"), ("blank", " ")], "query_id string, text string")
    got = index.search(q, c, stored, e, 3).orderBy("rank").collect()
    assert got[0]["id"] == "a" and got[0]["score"] == 1.0 and {r["query_id"] for r in got} == {"q"}
    with pytest.raises(ValueError, match="stale"):
        index.search(q, c, stored, index.hash_encoder(4), 3)
    with pytest.raises(ValueError, match="stale"):
        index.search(q, c.where("id <> 'f'"), stored, e, 3)
    with pytest.raises(ValueError, match="no active"):
        index.build(c.where("not active"), e)
    assert [r["window"] for r in index.windows(spark.createDataFrame([("x", "w " * 201), ("y", None)], "id string, text string")).orderBy("id", "window").collect()] == [0, 1, 2, 0]


def test_fusion_refuses_a_retired_candidate(spark):
    one = lambda i: spark.createDataFrame([("q", i, 1, 1.0)], "query_id string, id string, rank int, score double")
    assert ids(rank.fused([("a", one("a"), 1.0), ("b", one("b"), 2.0)], chunks(spark))) == ["b", "a"]
    with pytest.raises(ValueError, match="not active"):
        rank.fused([("a", one("a"), 1.0), ("v", one("d"), 1.0)], chunks(spark))
    assert [r["rank"] for r in rank.rank_of(one("a"), spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, id string")).orderBy("id").collect()] == [1, None]


def test_aliases_and_guards(spark):
    assert ids(rank.keyword(asked(spark, "提示注入"), chunks(spark), 5)) == ["f"]
    assert rank.keyword(asked(spark, "nothing here"), chunks(spark), 5).count() == 0
    assert rank.bm25(asked(spark, "apple"), chunks(spark).limit(0), 5).count() == 0
    for bad in (0, 21):
        with pytest.raises(ValueError):
            rank.check_arguments("x", bad)
    with pytest.raises(ValueError):
        rank.check_arguments("  ", 3)


def test_vector(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0]), ("d", None), ("e", [1.0]), ("a", [1.0, 0.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("r", [-1.0, 0.0])], "query_id string, embedding array<float>")
    got = rank.vector(q, v, 3).collect()
    assert [(r["id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == "q"] == [("a", 1.0), ("c", 1.0), ("b", 0.0)]
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == "r"] == ["b", "a", "c"]
    assert rank.vector(q, v.limit(0), 3).count() == 0


def test_rrf(spark):
    mk = lambda xs: spark.createDataFrame([("q", i, n) for n, i in enumerate(xs, 1)], "query_id string, id string, rank int")
    got = rank.rrf([("x", mk(["a", "b"]), 1.0), ("y", mk(["b", "c"]), 1.0)], 3).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["b", "a", "c"]
    assert got[0]["contributions"] == {"x": 2, "y": 1} and got[0]["score"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)


def test_question_parts_and_tokens(spark):
    d = spark.createDataFrame([("What? Why；\n  And?", "Ab_1 訊息 x"), (None, None), ("", "")], "q string, t string")
    r = d.select(T.question_parts(F.col("q")).alias("p"), T.tokens(F.col("t")).alias("t"), T.estimated_tokens(F.col("t")).alias("n")).collect()
    assert [(x["id"], x["text"]) for x in r[0]["p"]] == [("q1", "What?"), ("q2", "Why；"), ("q3", "And?")]
    assert r[0]["t"] == ["ab_1", "訊息", "x"] and r[2]["t"] == [] and r[2]["n"] == 1


def test_bundles(spark):
    c = spark.createDataFrame([("c1", "D", 1, 10, True, "body", "x" * 8), ("c2", "D", 11, 20, True, "body", "y" * 8), ("c3", "D", 1, 20, False, "body", "z")], "id string, doc_id string, start_line int, end_line int, active boolean, kind string, text string")
    docs = spark.createDataFrame([("D", "u")], "id string, url string")
    ev = "array<struct<source:string,start_line:int,end_line:int,must_include:array<string>,required_together:boolean>>"
    cases = spark.createDataFrame([("k1", "development", "q", [("u", 9, 12, [], True), ("D", 2, 3, [], None)]), ("k2", "development", "q", [("gone", 1, 1, [], True)]), ("k3", "development", "q", [("u", 9, 12, [], False)]), ("k4", "development", "q", [])], f"id string, split string, question string, evidence {ev}")
    s = evaluate.sample(cases)
    ranked = spark.createDataFrame([("k1", "c1", 1, 1.0), ("k3", "c2", 1, 1.0)], "query_id string, id string, rank int, score double")
    b = evaluate.bundles(evaluate.covering(evaluate.spans(s), docs, c), ranked)
    got = {(r["case_id"], r["span_no"]): (r["whole"], r["broken"], r["stale"]) for r in b.collect()}
    assert got == {("k1", 1): (False, True, False), ("k1", 2): (True, False, False), ("k2", 1): (False, False, True), ("k3", 1): (True, False, False)}
    sc = {r["case_id"]: (r["recall"], r["tokens"]) for r in evaluate.case_scores(s, b, ranked, c).collect()}
    assert sc == {"k1": (0.5, 2), "k2": (None, 0), "k3": (1.0, 2)}
    total = evaluate.summary(evaluate.case_scores(s, b, ranked, c)).first()
    assert (total["cases"], total["scored"], total["macro_recall"]) == (3, 2, 0.75)


def test_bounded_rounds(spark):
    cand = "candidates array<struct<id:string,fields:array<string>>>"
    c = lambda *xs: [(x, []) for x in xs]
    rows = [
        ("limit", 0, False, False, False, c("a"), False, None), ("limit", 1, False, False, False, c("a", "b"), False, None), ("limit", 2, False, False, False, c("c"), False, None), ("limit", 3, False, False, False, c("d"), True, None),
        ("dry", 0, False, False, False, c("a"), False, []), ("dry", 1, False, False, False, c("a"), True, []), ("enough", 0, False, False, False, c("a"), False, ["a"]),
        ("late", 0, False, False, False, c("a"), False, ["z"]), ("late", 1, True, True, False, c("b"), False, ["z"]), ("broke", 0, False, True, True, c("a"), True, None), ("tool", 0, False, False, False, [("a", ["tool_call"])], True, None),
        ("noid", 0, False, False, False, [(None, [])], True, None), ("failed", 0, False, False, True, None, True, None), ("missing", 0, False, False, False, c("a"), False, None), ("missing", 2, False, False, False, c("b"), False, None), ("good", 0, False, False, False, c("b", "a"), True, None),
    ]
    df = spark.createDataFrame(rows, f"query_id string, round int, late boolean, broke boolean, failed boolean, {cand}, sufficient boolean, required array<string>")
    got = {r["query_id"]: (r["stop_reason"], r["supplementary_rounds"], r["evidence"]) for r in evaluate.bounded_rounds(df).collect()}
    assert got["limit"] == ("round_limit", 2, ["a", "b", "c"]) and got["dry"] == ("no_new_evidence", 1, ["a"]) and got["enough"] == ("sufficient", 0, ["a"])
    assert got["late"] == ("timeout", 1, ["a"]) and got["broke"] == ("budget", 0, []) and got["good"] == ("sufficient", 0, ["b", "a"])
    assert {got[x][0] for x in ("tool", "noid", "failed")} == {"error"} and got["missing"] == ("no_new_evidence", 0, ["a"])


def test_sample_loading_refuses(spark):
    ev = "evidence array<struct<source:string,start_line:int,end_line:int,must_include:array<string>,required_together:boolean,why:string>>"
    make = lambda *rows: spark.createDataFrame([(i, k, q, [("u", 1, 2, [], True, "")]) for i, k, q in rows], f"id string, split string, question string, {ev}")
    assert evaluate.loaded(make(("1", "development", "q")), make(("2", "holdout", "q"))).count() == 2
    for dev, hold, why in ((make(("1", "holdout", "q")), None, "given as"), (make(("1", "development", "q")), make(("1", "holdout", "q")), "both"), (make(("1", "development", " ")), None, "blank")):
        with pytest.raises(ValueError, match=why):
            evaluate.loaded(dev, hold)


def test_supplied_section_recall_and_report(spark):
    c = chunks(spark).withColumn("section", F.when(F.col("id").isin("a", "c"), "S").otherwise("T"))
    given = spark.createDataFrame([("q", "c", 1), ("q", "a", 0), ("q", "b", 2)], "query_id string, id string, at int")
    ranked = rank.supplied(given, 2)
    assert ids(ranked) == ["a", "c"]
    wanted = spark.createDataFrame([("q", "S"), ("q", "T"), ("q", "none"), ("r", "S")], "query_id string, section string")
    got = {(r["query_id"], r["section"]): (r["chunks"], r["retrieved"], r["recall"]) for r in evaluate.section_recall(wanted, ranked, c).collect()}
    assert got == {("q", "S"): (2, 2, 1.0), ("q", "T"): (3, 0, 0.0), ("q", "none"): (0, 0, None), ("r", "S"): (2, 0, 0.0)}
    scores = spark.createDataFrame([("1", 0.5, 10, 0, 1), ("2", None, 0, 0, 0)], "case_id string, recall double, tokens bigint, metadata_chunks bigint, broken bigint")
    frozen = spark.createDataFrame([(2, "a", 3, "b")], "cases bigint, cases_hash string, documents bigint, documents_hash string")
    r = evaluate.report(scores, frozen, "e").first()
    assert (r["cases"], r["scored"], r["macro_recall"], r["mean_tokens"], r["complete"], r["cost"], r["encoder"], r["cases_hash"]) == (2, 1, 0.5, 5.0, False, 0, "e", "a")
    assert evaluate.summary(scores.limit(0)).first()["macro_recall"] is None


def test_supplement_modes(spark):
    q = spark.createDataFrame([("wide",), ("dry",), ("none",)], "query_id string")
    ranked = spark.createDataFrame([("wide", f"c{i}", i) for i in range(1, 7)] + [("dry", f"c{i}", i) for i in range(1, 3)], "query_id string, id string, rank int")
    got = {(r["query_id"], r["mode"]): (r["rounds"], r["reached"], r["stop_reason"], r["change"]) for r in evaluate.supplement_modes(q, ranked, 2).collect()}
    assert got["wide", "off"] == (0, 2, "round_limit", "same") and got["wide", "on"] == (1, 2, "no_new_evidence", "same") and got["wide", "widening"] == (2, 6, "round_limit", "gained")
    assert got["dry", "widening"] == (1, 2, "no_new_evidence", "same") and got["none", "widening"] == (1, 0, "no_new_evidence", "same")
    assert {(r["mode"], r["stop_reason"]): r["queries"] for r in evaluate.stop_histogram(evaluate.supplement_modes(q, ranked, 2)).collect()}["widening", "no_new_evidence"] == 2


def executed(plan):
    """The nodes of a plan that ran, those within its stages too."""
    name = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return [plan, *(n for p in inner for n in executed(p))]


def test_section_recall_never_multiplies_queries_by_chunks(spark):
    c = spark.range(300).selectExpr("cast(id as string) id", "true active", "'S' section")
    wanted = spark.range(200).selectExpr("cast(id as string) query_id", "'S' section")
    ranked = wanted.selectExpr("query_id", "query_id id")
    got = evaluate.section_recall(wanted, ranked, c)
    assert {(r["chunks"], r["retrieved"], r["recall"]) for r in got.collect()} == {(300, 1, 0.003333)}
    rows = [m.get().value() for m in (n.metrics().get("numOutputRows") for n in executed(got._jdf.queryExecution().executedPlan())) if m.isDefined()]
    assert 300 <= max(rows) < 1000


def by_hand(queries, rows, k, weigh):
    """Every query against every row: {(query, rank): (id, score)}."""
    held = {i: T_TOKENS(t) for i, _, t in rows}
    n, avg = len(rows), sum(max(1, len(x)) for x in held.values()) / len(rows)
    df = {w: sum(w in x for x in held.values()) for w in {w for x in held.values() for w in x}}
    out = {}
    for q, text in queries:
        scored = []
        for i, kind, _ in rows:
            own, score = held[i], 0.0
            for w in set(T_TOKENS(text)) & set(own):
                tf = own.count(w)
                score += math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(own) / avg)) if weigh else 1
            if round(score, 6) > 0:
                scored.append(((kind != "body", -round(score, 6), i) if weigh else (-score, kind != "body", i), i, round(score, 6)))
        out |= {(q, r): (i, s) for r, (_, i, s) in enumerate(sorted(scored)[:k], 1)}
    return out


def T_TOKENS(text):
    return re.findall(T.TOKEN, text.lower())


def test_batches_split_texts_once_and_equal_scores_by_hand(spark, monkeypatch):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["提示", "网关"]
    text = lambda n: " ".join(words[min(int(draw.expovariate(0.15)), 31)] for _ in range(n))
    rows = [(f"{i * 7919 % 1009:04}", draw.choice(["body", "body", "metadata"]), text(draw.randint(0, 12))) for i in range(250)]
    rows += [(f"x{i:03}", "body", rows[i][2]) for i in range(40)]  # equal texts tie
    queries = [(i, text(draw.randint(1, 8))) for i in range(50)]
    c = spark.createDataFrame([(*r, True) for r in rows], "id string, kind string, text string, active boolean").repartition(3)
    q = spark.createDataFrame(queries, "query_id int, text string")
    monkeypatch.setattr(rank, "QUERY_BLOCK", 8)
    monkeypatch.setattr(rank, "QUERY_SCAN", 20)
    monkeypatch.setattr(rank, "CELLS", 1)
    calls, own = [], rank.held_terms
    monkeypatch.setattr(rank, "held_terms", lambda *a: calls.append(1) or own(*a))
    for f, weigh in ((rank.keyword, False), (rank.bm25, True)):
        got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in f(q, c, 7).collect()}
        want = by_hand(queries, rows, 7, weigh)
        assert {x: i for x, (i, _) in got.items()} == {x: i for x, (i, _) in want.items()}
        assert all(got[x][1] == pytest.approx(s, abs=2e-6) for x, (_, s) in want.items())
    assert len(calls) == 2  # once a batch, not once every QUERY_SCAN queries


def test_vector_scores_by_hand_with_repeated_ids(spark, monkeypatch):
    draw = random.Random(5)
    some = [[round(draw.uniform(-1, 1), 1) for _ in range(3)] for _ in range(60)]  # equal scores occur
    rows = [(i, draw.choice(some)) for i in range(200)] + [(i % 50, draw.choice(some)) for i in range(80)] + [(300, [1.0, 2.0]), (301, None)]
    queries = [(q, draw.choice(some)) for q in range(30)]
    monkeypatch.setattr(rank, "QUERY_BLOCK", 8)
    monkeypatch.setattr(rank, "QUERY_SCAN", 20)
    v = spark.createDataFrame(rows, "id int, embedding array<double>").repartition(3)
    tasks, own = [], rank._nearest_in_task
    monkeypatch.setattr(rank, "_nearest_in_task", lambda *a: tasks.append(a) or own(*a))
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in rank.vector(spark.createDataFrame(queries, "query_id int, embedding array<double>"), v, 6).collect()}
    best = {}
    for q, a in queries:
        for i, b in rows:
            if b and len(b) == 3:
                best[q, i] = max(best.get((q, i), -9), round(sum(x * y for x, y in zip(a, b)), 6))
    for q, _ in queries:
        want = sorted((-s, i) for (x, i), s in best.items() if x == q)[:6]
        assert [(got[q, r][0], got[q, r][1]) for r in range(1, 7)] == [(i, pytest.approx(-s, abs=2e-6)) for s, i in want]
    assert {a[0] for a in tasks} and len({a[0] for a in tasks}) == 1  # the vectors are prepared once for all queries


def test_terms_of_a_batch_are_those_of_the_pattern():
    texts = ["", None, "Ab_1 c9提示x", "䷿一鿿ꀀ", "提示注入，网关", "a\x00b", "İKß-É é_", "x", "", "\U0001f600y龥〇z一"]
    words = sorted({w for t in texts for w in T_TOKENS((t or "").replace("a", " "))})
    terms = rank.Terms(words)
    found, bounds = terms.found(texts)
    for i, t in enumerate(texts):
        own = T_TOKENS(t or "")
        assert found[bounds[i] : bounds[i + 1]].tolist() == [words.index(w) if w in words else -1 for w in own]
    ts, tfs = terms.counted(found, bounds[[2, 0, 3]], bounds[[5, 0, 4]])  # rows may share terms
    for row, own in zip(range(3), (T_TOKENS(" ".join(texts[2:5])), [], T_TOKENS(texts[3]))):
        assert dict(zip(ts[row].as_py(), tfs[row].as_py())) == {words.index(w): own.count(w) for w in own if w in words}
    assert terms.found([])[1].tolist() == [0] and rank.Terms([]).found(["a b"])[0].tolist() == [-1, -1]


def test_terms_are_found_after_the_exchange(spark, monkeypatch):
    plans, own = [], rank.written_at
    monkeypatch.setattr(rank, "written_at", lambda df, *by: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, *by))
    monkeypatch.setattr(rank, "SLICE", 1)
    assert ids(rank.bm25(asked(spark, "apple pie"), chunks(spark).coalesce(1), 5)) == ["a", "c", "b"]
    nodes = [x for x in plans[0].split("\n") if "Exchange" in x or "MapIn" in x]  # from the last step down
    assert "MapIn" in nodes[0] and "Exchange" in nodes[1]  # one large row group is worked on by all cores


def test_queries_that_ask_for_the_same_are_ranked_once(spark):
    q = spark.createDataFrame([(i, ["apple pie", "pie  apple unheard"][i % 2]) for i in range(50)], "query_id int, text string")
    got = rank.bm25(q, chunks(spark), 3)
    assert {(r["query_id"], r["rank"], r["id"]) for r in got.collect()} == {(i, n, x) for i in range(50) for n, x in ((1, "a"), (2, "c"), (3, "b"))}
    window = [n for n in executed(got._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName() == "WindowExec"]
    assert window and all("query_id" not in w.toString().split("\n")[0] for w in window)


def test_split_and_held_equal_rebuilt_chunks_and_their_ranking(spark):
    from corpusloom.operators import corpus, split

    texts = ["# Gateway\nSource: x\n\nThe gateway checks tokens.\n\n```\ntokens\n```\nMore\r\ntokens", "no heading\n" * 25 + "gateway", "", "# A\n\n## B\n- gateway 提示注入\n\n", "# Gateway\n" + "token line\n\n" * 30]
    docs = spark.createDataFrame([(f"d{i % 5}", f"h{i % 5}", texts[i % 5]) for i in range(7)], "id string, hash string, snapshot string")
    q = spark.createDataFrame([(1, "gateway tokens"), (2, "提示注入"), (3, "line heading"), (4, "none"), (5, " ")], "query_id int, text string")
    splitters = {"lines": split.LINES, "blocks": split.BLOCK, "procedures": split.PROCEDURE}
    got = evaluate.split_and_held(q, docs, splitters)
    columns = ["id", "doc_id", "start_line", "end_line", "kind", "active"]
    rows = lambda df: sorted(map(tuple, df.collect()))
    for name, splitter in splitters.items():
        chunks, batch = got[name]
        old = corpus.rebuilt(docs, splitter)
        assert rows(chunks.select(*columns, "tokens")) == rows(old.dropDuplicates(["id"]).select(*columns, T.estimated_tokens(F.col("text")).alias("tokens")))
        assert rows(rank.bm25(q, chunks, 4, batch)) == rows(rank.bm25(q, old, 4)) != []
    assert len({batch.path.rsplit("/", 1)[0] for _, batch in got.values()}) == 1  # the texts were read once
    empty = evaluate.split_and_held(q, docs.limit(0), splitters)
    assert all(c.count() == 0 and rank.bm25(q, c, 4, h).count() == 0 for c, h in empty.values())
