import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import answer, corpus, split
from corpusloom.sources import files

DOC = "source string, title string, license string, acquired string, text string, splitter string"
DOCS = "id string, title string, source string, license string, acquired string, hash string, splitter string, snapshot string"
CHUNKS = "id string, doc_id string, section string, start_line int, end_line int, text string, version string, active boolean, kind string, page int"


def start(spark):
    return spark.createDataFrame([], DOCS), spark.createDataFrame([], CHUNKS)


def give(spark, *rows):
    return spark.createDataFrame([(s, "t", "l", "2026-01-01", x, k) for s, x, k in rows], DOC)


def live(chunks):
    return sorted((r["text"], r["active"]) for r in chunks.collect())


def test_life_cycle_reactivates(spark):
    d0, c0 = start(spark)
    d1, c1 = corpus.import_documents(d0, c0, give(spark, ("u", "one", None), ("v", "x", split.BLOCK)))
    assert live(c1) == [("one", True), ("x", True)]
    assert {r["source"]: r["splitter"] for r in d1.collect()} == {"u": split.LINES, "v": split.LINES}  # no heading: baseline
    d2, c2 = corpus.import_documents(d1, c1, give(spark, ("u", "two", None), ("v", "x", split.BLOCK)))
    assert live(c2) == [("one", False), ("two", True), ("x", True)]
    d3, c3 = corpus.import_documents(d2, c2, give(spark, ("u", "one", None)))
    assert live(c3) == [("one", True), ("two", False), ("x", True)]
    d4, c4 = corpus.delete_documents(d3, c3, spark.createDataFrame([("u ",)], "source string"))
    assert live(c4) == [("one", False), ("two", False), ("x", True)] and d4.count() == 1
    status = {r["source"]: r["status"] for r in corpus.import_status(d1, give(spark, ("u", "one", None), ("v", "y", None), ("w", "z", None))).collect()}
    assert status == {"u": "unchanged", "v": "updated", "w": "imported"}


def test_pages_go_through_the_import(spark):
    schema = DOC + ", pages array<array<string>>"
    give_pages = lambda *rows: spark.createDataFrame([(s, "t", "l", "2026-01-01", None, k, p) for s, k, p in rows], schema)
    first = [["Head 1", "# A", "one"], ["Head 2", "two"]]
    d1, c1 = corpus.import_documents(*start(spark), give_pages(("p", None, first)))
    assert d1.first()["splitter"] == split.PAGES and {(r["text"], r["page"], r["kind"]) for r in c1.collect()} == {("Head 1", 1, "metadata"), ("# A\none", 1, "body"), ("Head 2", 2, "metadata"), ("two", 2, "body")}
    assert corpus.import_status(d1, give_pages(("p", None, first))).first()["status"] == "unchanged"
    d2, c2 = corpus.import_documents(d1, c1, give_pages(("p", split.PAGES, [["Head 1", "# A", "one", "Head 2", "two"]])))
    assert c2.where("active").count() == 2 and c2.where("not active").count() == 4 and d2.count() == 1
    _, c3 = corpus.delete_documents(d2, c2, spark.createDataFrame([("p",)], "source string"))
    assert c3.where("active").count() == 0
    narrow = [["ab"] * 12]
    bad = give_pages(("a", split.LINES, first), ("b", None, narrow), ("c", None, [[" "]])).unionByName(give(spark, ("d", "x", split.PAGES)), allowMissingColumns=True)
    assert {r["source"]: r["problem"] for r in corpus.invalid(bad).collect()} == {"a": "a text splitter for pages", "b": "suspect reading order", "c": "text is blank", "d": "the page splitter for a text"}


def test_last_delivery_counts_and_unknown_sources(spark):
    rows = spark.createDataFrame([("u", "t", "l", "2026-01-02", "new", None), ("u", "t", "l", "2026-01-01", "old", None), ("u ", "t", "l", "2025-01-01", "older", None)], DOC)
    d, c = corpus.import_documents(*start(spark), rows)
    assert live(c) == [("new", True)]
    asked = spark.createDataFrame([("u",), ("w",), (" ",), (None,)], "source string")
    assert sorted((r["source"] or "", r["problem"]) for r in corpus.unknown_sources(d, asked).collect()) == [("", "source is blank"), (" ", "source is blank"), ("w", "unknown source")]
    old = c.drop("version", "active", "kind", "page")
    assert corpus.migrated(old, d).first()["version"] == d.first()["hash"]
    assert [r["text"] for r in corpus.rebuilt(d, split.PROCEDURE).collect()] == ["new"]


def test_update_inherits_and_invalid(spark):
    d1, _ = corpus.import_documents(*start(spark), give(spark, ("u", "one", None)))
    r = corpus.inherited(d1, spark.createDataFrame([("u", None, None, None, "new", None), ("zz", None, None, None, "new", None)], DOC)).collect()
    assert [(x["source"], x["title"], x["text"]) for x in r] == [("u", "t", "new")]
    bad = spark.createDataFrame([(" ", "t", "l", "2026-01-01", "x", None), ("s", "t", "l", "soon", "x", None), ("s", "t", "l", "2026-01-01", " ", None), ("s", "t", "l", "2026-01-01", "x", "odd")], DOC)
    assert sorted(r["problem"] for r in corpus.invalid(bad).collect()) == ["acquired is no date", "source is blank", "text is blank", "unknown splitter"]


def test_liveness_and_fingerprint(spark):
    _, c = corpus.import_documents(*start(spark), give(spark, ("u", "one", None), ("v", "two", None)))
    rows = c.select("id", "version").collect()
    e = spark.createDataFrame([(rows[0]["id"], rows[0]["version"]), (rows[1]["id"], "old"), ("none", "v")], "id string, version string")
    assert sorted(r["status"] for r in corpus.liveness(c, e).collect()) == ["ok", "unknown", "version_changed"]
    f = corpus.fingerprint(c).first()
    assert f == corpus.fingerprint(c.repartition(3).unionByName(c)).first()
    assert f["fingerprint"] != corpus.fingerprint(c.withColumn("text", F.concat("text", F.lit("!")))).first()["fingerprint"]
    stored = corpus.fingerprint(c).select("fingerprint", F.lit("e").alias("encoder"))
    assert [corpus.stale(stored, c, x).first()["stale"] for x in ("e", "f")] == [False, True]


def test_coverage(spark):
    schema = "answer_id string, question string, claims array<struct<text:string,citations:array<string>>>, coverage array<struct<question_id:string,claims:array<int>,missing:string>>"
    one = [("c", ["x"])]
    rows = [
        ("ok", "A? B?", one, [("q1", [0], ""), ("q2", [], "gap ")]), ("order", "A? B?", one, [("q2", [0], ""), ("q1", [], "gap")]), ("unused", "A?", one, [("q1", [], "gap")]),
        ("twice", "A?", one, [("q1", [0, 0], "")]), ("few", "A? B?", one, [("q1", [0], "")]), ("neither", "A? B?", one, [("q1", [0], ""), ("q2", [], " ")]), ("none", "A?", [], [("q1", [], "gap")]), ("null", "A?", None, None),
    ]
    got = {r["answer_id"]: (r["problem"], r["status"], r["missing"]) for r in answer.covered(spark.createDataFrame(rows, schema)).collect()}
    assert got["ok"] == (None, "partial", "B?：gap") and got["none"] == (None, "insufficient", "A?：gap")
    assert {k: v[0] for k, v in got.items() if v[0]} == {"order": "question ids or their order", "unused": "a claim is not used", "twice": "claim numbers or gap", "few": "coverage is not one row a question", "neither": "neither claims nor gap", "null": "no claims array"}


def test_validation(spark):
    schema = "answer_id string, status string, missing string, claims array<struct<text:string,citations:array<string>>>, citations array<struct<id:string,quote:string,translation:string>>"
    c, q = [("c", ["e"])], [("e", "verbatim", "t")]
    rows = [
        ("ok", "grounded", "", c, q), ("two quotes", "grounded", "", c, [*q, ("e", "words", "t")]), ("same", "grounded", "", c, q + q), ("wrong", "grounded", "", c, [("e", "other", "t")]), ("unknown", "grounded", "", c, [("z", "verbatim", "t")]),
        ("gap", "grounded", "g", c, q), ("partial", "partial", " ", c, q), ("no", "insufficient", "g", [], []), ("no claim", "grounded", "", [], q), ("status", "maybe", "", c, q), ("uncited", "grounded", "", [("c", [])], q),
    ]
    e = spark.createDataFrame([(r[0], "e", "these are verbatim words") for r in rows], "answer_id string, id string, text string")
    got = {r["answer_id"]: r["problem"] for r in answer.validated(spark.createDataFrame(rows, schema), e).collect()}
    assert {k for k, v in got.items() if v is None} == {"ok", "two quotes", "no"}
    assert (got["same"], got["wrong"], got["unknown"]) == ("citation twice", "quote is not verbatim", "unknown citation")


def test_replay_and_inline_citations(spark):
    q = '{"id": "e", "quote": "verbatim", "translation": "t"}'
    model = lambda cited, status="grounded", missing="", claims=True: json.dumps({"claims": [{"text": "c", "citations": cited}] if claims else [], "citations": [json.loads(q)], "status": status, "missing": missing})
    run = lambda i, m: (i, json.dumps({"model_output": m, "retrieval_run_id": "r"}))
    rows = [("r", json.dumps({"candidates": [{"id": "e", "text": "these are verbatim words"}]})), run("id", model(["e"])), run("inline", model([json.loads(q)])), run("other", model([json.loads(q) | {"quote": "words"}])), run("scope", model([], "insufficient", "gap", False)), run("broken", "{")]
    got = {r["answer_id"]: (r["problem"], r["normalised"], r["scope"]) for r in answer.replayed(spark.createDataFrame(rows, "id string, result string")).collect()}
    assert got["id"] == (None, False, None) and got["inline"] == (None, True, None) and got["other"][0] == "inline citation differs"
    assert got["scope"] == (None, False, "missing_context") and got["r"][0] == "no model text" and got["broken"][0] == "status"
    assert spark.sql("select 'key k1 and k1' t").select(answer.redacted(F.col("t"), "k1").alias("t")).first()["t"] == "key [redacted] and [redacted]"


def test_guard_with_open_calls_and_large_accounts(spark, monkeypatch):
    monkeypatch.setattr(answer, "STRETCH", 3)
    calls = [("x", i, i, 1, "settled", 1) for i in range(40)] + [("y", 1, 1, 60, "settled", 20), ("y", 2, 2, 60, "settled", 60), ("y", 3, 3, 5, "unknown", 0), ("y", 4, 4, 1, "settled", 1), (None, 1, 9, 1, "settled", 1)]
    df = spark.createDataFrame(calls, "account string, at int, id int, amount bigint, status string, spent bigint")
    got = answer.guarded(df, limit=100).orderBy("account", "at").collect()
    assert [(r["accepted"], r["spent_before"]) for r in got if r["account"] == "x"] == [(True, i) for i in range(40)]
    assert [(r["accepted"], r["spent_before"]) for r in got if r["account"] == "y"] == [(True, 0), (True, 20), (True, 80), (False, 80)]
    assert answer.guarded(df.limit(0)).count() == 0
    over = spark.createDataFrame([(1, "settled", 5, 6), (2, "settled", 5, 5), (3, "unknown", 5, 9)], "id int, status string, reserved bigint, spent bigint")
    assert [r["id"] for r in answer.settlement_problems(over).collect()] == [1]


def test_cost_and_guard(spark):
    r = spark.sql("select 1048576 i, 1500 o, cast(3 as decimal(10,4)) a, cast(9 as decimal(10,4)) b, cast(-1 as decimal(10,4)) z").select(answer.cost(F.col("i"), F.col("o"), F.col("a"), F.col("b")).alias("c"), answer.cost(F.col("i"), F.col("o"), F.col("z"), F.col("b")).alias("n")).first()
    assert (r["c"], r["n"]) == (3159228, None)
    calls = [("a", 1, 1, 60), ("a", 2, 2, 50), ("a", 3, 3, 40), ("b", 1, 4, 101), ("b", 2, 5, None), ("b", 3, 6, -1), ("b", 4, 7, 100)]
    got = answer.guarded(spark.createDataFrame(calls, "account string, at int, id int, amount bigint"), limit=100).orderBy("id").collect()
    assert [(r["accepted"], r["spent_before"]) for r in got] == [(True, 0), (False, 60), (True, 60), (False, 0), (False, 0), (False, 0), (True, 0)]
    ev = spark.createDataFrame([(1, 1, "pending", 10, None), (1, 2, "settled", 10, 8), (2, 1, "pending", 5, None)], "id int, at int, status string, reserved bigint, spent bigint")
    s = answer.ledger_summary(answer.last_state(ev), 100).first()
    assert (s["spent"], s["held"], s["available"], s["blocked"]) == (8, 5, 87, True)


def test_files_and_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BUCKETS", 1)
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_bytes("﻿# A\nwords".encode())
    (src / "b.md").write_text("  \n")
    got = {r["file"].rsplit("/", 1)[1]: (r["text"], r["problem"]) for r in files.markdown(spark, str(src)).collect()}
    assert got["a.md"] == ("# A\nwords", None) and got["b.md"][1]
    from corpusloom.streaming.ingest import import_stream

    for _ in range(2):
        import_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [r["text"] for r in files.published(spark, str(tmp_path / "out"), "chunks", corpus.CHUNKS).collect()] == ["# A\nwords"]
    # what cannot be read is not taken for nothing: the batch fails and the corpus stays
    import shutil

    last = next(iter(spark.read.json(str(tmp_path / "out/_current")).orderBy(F.desc("at")).collect()))["version"]
    shutil.move(str(tmp_path / "out" / last), str(tmp_path / "gone"))
    (src / "c.md").write_text("# C\nmore")
    try:
        import_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        raise AssertionError("the batch went through")
    except Exception as e:
        assert not isinstance(e, AssertionError), e
    shutil.move(str(tmp_path / "gone"), str(tmp_path / "out" / last))
    import_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["text"] for r in files.published(spark, str(tmp_path / "out"), "chunks", corpus.CHUNKS).collect()) == ["# A\nwords", "# C\nmore"]
    assert files.published(spark, str(tmp_path / "never"), "chunks", corpus.CHUNKS).count() == 0


def test_a_change_rewrites_its_buckets_only(spark, tmp_path):
    root = str(tmp_path / "out")
    d, c = corpus.import_documents(*start(spark), give(spark, *((f"u{i}", f"one {i}", None) for i in range(12))))
    first = files.publish({"documents": d, "chunks": c}, root)
    bucket = spark.sql("select 'u3' s").select(files.bucket_of(corpus.document_id(F.col("s")))).first()[0]
    read = lambda name, schema, b=None: files.published(spark, root, name, schema, b)
    d, c = read("documents", corpus.DOCUMENTS, [bucket]), read("chunks", corpus.CHUNKS, [bucket])
    assert 1 <= d.count() < 12
    second = files.publish(dict(zip(("documents", "chunks"), corpus.import_documents(d, c, give(spark, ("u3", "two", None))))), root, [bucket])
    assert sorted(r["text"] for r in read("chunks", corpus.CHUNKS).where("active").collect()) == sorted([f"one {i}" for i in range(12) if i != 3] + ["two"])
    assert read("documents", corpus.DOCUMENTS).count() == 12 and read("chunks", corpus.CHUNKS).count() == 13
    parts = files._manifest(spark, root)["documents"]
    assert parts[bucket] == second and set(parts.values()) == {first, second}
    gone = corpus.delete_documents(read("documents", corpus.DOCUMENTS, [bucket]), read("chunks", corpus.CHUNKS, [bucket]), read("documents", corpus.DOCUMENTS, [bucket]).select("source"))
    files.publish(dict(zip(("documents", "chunks"), gone)), root, [bucket])
    assert bucket not in files._manifest(spark, root)["documents"] and read("chunks", corpus.CHUNKS).count() == 13


def test_runs_and_cases(spark, tmp_path):
    runs = spark.createDataFrame([("q", '{"mode": "m"}', 1.0)], "query string, result string, elapsed_ms double")
    files.append_runs(runs, str(tmp_path / "runs"))
    files.append_runs(runs, str(tmp_path / "runs"))
    log = spark.read.parquet(str(tmp_path / "runs"))
    assert log.count() == 2 and log.select("id").distinct().count() == 2
    base = spark.createDataFrame([(1, '{"mode": "m", "x": "1"}'), (2, "broken")], "id int, result string")
    extra = spark.createDataFrame([(1, 1, '{"x": "2"}'), (1, 2, '{"y": "3"}'), (2, 1, '{"x": "2"}')], "id int, at int, extra string")
    got = {r["id"]: r["result"] for r in files.amended(base, extra).collect()}
    assert sorted(got[1].strip("{}").split(",")) == ['"mode":"m"', '"x":"2"', '"y":"3"'] and got[2] == "broken"
    typed = spark.createDataFrame([(1, 1, '{"x": 5, "y": {"z": [1, true, null]}}'), (1, 2, "[1]"), (9, 1, "{}")], "id int, at int, extra string")
    assert json.loads(files.amended(base, typed).where("id = 1").first()["result"]) == {"mode": "m", "x": 5, "y": {"z": [1, True, None]}}
    assert {(r["id"], r["at"]): r["problem"] for r in files.amend_problems(base, typed.unionByName(extra)).collect()} == {(1, 2): "the amendment is no object", (9, 1): "unknown run", (2, 1): "the stored result is no object"}
    assert files.run_result(base, 2) == "broken"
    with pytest.raises(ValueError):
        files.run_result(base, 3)
    (tmp_path / "c.json").write_text('{"kind": "development", "version": "1", "sources": {"A": "https://a.example"}, "cases": [{"id": "1", "question": "q", "evidence": [{"source": "A", "start_line": 1, "end_line": 2}]}, {"id": "2", "question": " ", "evidence": []}]}')
    c = files.cases(spark, str(tmp_path / "c.json"))
    assert c.where("id = '1'").first()["evidence"][0]["source"] == "https://a.example"
    assert [(r["id"], r["problem"]) for r in files.invalid_cases(c).collect()] == [("2", "the question is blank")]
    assert isinstance(dt.date.today(), dt.date)
