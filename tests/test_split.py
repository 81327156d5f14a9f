import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import split

GUIDE = "\n".join(["# Title", "", "Source: https://a.example", "License: CC0", "", "Adapted from a page.", "", "First words.", "## Part", "We need:", "- one", "- two"] + [f"line {i}" for i in range(30)])
PROCEDURE = "\n".join(["# Steps", "", "Do this:", "", "Then run", "```bash", "# not a heading", "run it", "```", "Warning: careful.", "", "", "## Empty", "## Next", "", "words"])
LONG_LIST = "\n".join(["# H"] + [f"x{i}" for i in range(18)] + ["take:"] + [f"- item {i}" for i in range(5)])


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", f"h{i}", t, "clash") for i, t in enumerate(texts)], "doc_id string, hash string, text string, section string")


def rows(df):
    return sorted((r["doc_id"], r["start_line"], r["end_line"], r["section"], r["kind"]) for r in df.collect())


def baseline(text):
    """Brute force: walk the lines."""
    out, section, start, n, fenced = [], T.BODY_SECTION, 1, 0, False
    lines = text.split("\n")

    def close(end):
        if n and any(x.strip() for x in lines[start - 1 : end]):
            out.append((start, end, section))

    for i, line in enumerate(lines, 1):
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
        m = None if fenced else re.match(r"#{1,6}\s+(.+)$", line)
        if m or n == 20:
            close(i - 1)
            start, n = i, 0
        if m:
            section = m[1]
        n += 1
    close(len(lines))
    return out


@pytest.mark.parametrize("text", [GUIDE, PROCEDURE, LONG_LIST, "a\nb", "\n\n\n", "# only"])
def test_baseline_against_brute_force(spark, text):
    got = [(s, e, sec) for _, s, e, sec, _ in rows(split.split_lines(docs(spark, text)))]
    assert got == baseline(text)


def test_every_chunk_is_its_lines(spark):
    d = docs(spark, GUIDE, PROCEDURE, LONG_LIST)
    whole = {r["doc_id"]: r["text"].split("\n") for r in d.collect()}
    for f in (split.split_lines, split.split_blocks, split.split_procedures):
        for r in f(d).collect():
            assert r["text"] == "\n".join(whole[r["doc_id"]][r["start_line"] - 1 : r["end_line"]])
            assert r["text"].strip()


def test_blocks_peel_and_keep_lists(spark):
    got = rows(split.split_blocks(docs(spark, GUIDE, LONG_LIST)))
    assert ("d0", 1, 7, T.METADATA_SECTION, "metadata") in got
    assert ("d0", 8, 8, "Title", "body") in got
    assert ("d0", 9, 28, "Part", "body") in got
    # the colon line that would be the twentieth stays with its first item
    assert ("d1", 1, 21, "H", "body") in got and ("d1", 22, 25, "H", "body") in got


def test_procedures(spark):
    got = rows(split.split_procedures(docs(spark, PROCEDURE)))
    assert got == [("d0", 1, 3, "Steps", "body"), ("d0", 5, 9, T.CODE_SECTION % "Steps", "body"), ("d0", 10, 10, "Steps", "body"), ("d0", 14, 16, "Next", "body")]


def test_null_empty_and_fallback(spark):
    d = docs(spark, None, "", "  \n\t", "no heading\nat all")
    for name in (split.LINES, split.BLOCK, split.PROCEDURE):
        assert rows(split.split(d, name)) == [("d3", 1, 2, T.BODY_SECTION, "body")]
    with pytest.raises(ValueError):
        split.split(d, "other")
    assert split.split_lines(d.limit(0)).count() == 0


def pages(spark):
    head, p = "Guide to things", []
    for i in range(1, 6):
        p.append([head, f"body of page {i}", "more words here", f"page {i} of 5"])
    p[0] = ["# Guide", "Source: x", "Text begins."]
    return spark.createDataFrame([("d", "h", p), ("one", "h", [["a", "b"]]), ("none", "h", [])], "doc_id string, hash string, pages array<array<string>>")


def test_pages(spark):
    f = {(r["edge"], r["key"]): r["pages"] for r in split.page_furniture(pages(spark)).collect()}
    assert f == {("top", "Guide to things"): 4, ("bottom", "page # of #"): 4}
    got = split.split_pages(pages(spark)).where("doc_id = 'd'").orderBy("start_line").collect()
    assert [(r["start_line"], r["end_line"], r["kind"], r["page"]) for r in got][:5] == [(1, 2, "metadata", 1), (3, 3, "body", 1), (4, 4, "metadata", 2), (5, 6, "body", 2), (7, 7, "metadata", 2)]
    assert all(r["kind"] == "metadata" for r in got if r["text"] in ("Guide to things",) or r["text"].startswith("page "))


def test_suspect_pages(spark):
    d = spark.createDataFrame([("d", "h", [["a b"] * 14, ["whole lines of text"] * 14, ["a"] * 5])], "doc_id string, hash string, pages array<array<string>>")
    assert [(r["page"], r["lines"], r["short"]) for r in split.suspect_pages(d).collect()] == [(1, 14, 14)]


def test_census_and_preview(spark):
    d = docs(spark, GUIDE)
    c = split.split_lines(d)
    assert split.census(c).first()["chunks"] == c.count()
    p = split.preview(c, d.select("doc_id", F.col("text").alias("snapshot"))).orderBy("start_line").collect()
    assert p[0]["before"] == "" and p[1]["before"] == "\nFirst words."
