import json

from corpusloom import cli


def call(spark, capsys, root, *args):
    code = cli.main(["--root", str(root), *args], spark)
    out = capsys.readouterr()
    return code, json.loads(out.out) if code == 0 else out.err


def test_commands(spark, capsys, tmp_path):
    doc, root = tmp_path / "a.md", tmp_path / "root"
    doc.write_text("# Guide\napple pie\n\n# Other\nplain words\n")
    about = ("--source", "https://a.example", "--title", "t", "--license", "l")
    assert call(spark, capsys, root, "import", str(doc), *about)[1]["status"] == "imported"
    assert call(spark, capsys, root, "import", str(doc), *about)[1]["status"] == "unchanged"
    found = call(spark, capsys, root, "search", "apple")[1]["candidates"]
    assert [c["section"] for c in found] == ["Guide"]
    assert call(spark, capsys, root, "read", found[0]["id"])[1]["title"] == "t"
    assert call(spark, capsys, root, "index")[1]["vectors"] == 2
    assert len(call(spark, capsys, root, "search", "apple", "--mode", "vector")[1]["candidates"]) == 2
    doc.write_text("# Guide\npear pie\n")
    assert call(spark, capsys, root, "update", str(doc), "--source", "https://a.example")[1]["status"] == "updated"
    assert call(spark, capsys, root, "search", "apple")[1]["candidates"] == []
    assert call(spark, capsys, root, "search", "pear", "--mode", "vector")[0] == 2  # the index is stale
    assert call(spark, capsys, root, "read", found[0]["id"]) == (2, "error: the chunk is retired\n")
    assert call(spark, capsys, root, "read", "x") == (2, "error: unknown chunk\n")
    for bad in (("search", " "), ("search", "x", "--limit", "21"), ("delete", "https://no.example"), ("update", str(doc), "--source", "no"), ("run", "1"), ("import", str(doc), *about[:2], "--title", " ", "--license", "l")):
        assert call(spark, capsys, root, *bad)[0] == 2
    cases = tmp_path / "c.json"
    cases.write_text(json.dumps({"kind": "development", "version": "1", "sources": {"A": "https://a.example"}, "cases": [{"id": "1", "question": "pear", "evidence": [{"source": "A", "start_line": 2, "end_line": 2}]}]}))
    got = call(spark, capsys, root, "eval", str(cases))[1]
    assert got["cases"][0]["recall"] == 1.0 and got["report"]["complete"] is False
    assert call(spark, capsys, root, "budget")[1]["available"] == 10_000_000
    assert [d["title"] for d in call(spark, capsys, root, "docs")[1]] == ["t"]
    assert call(spark, capsys, root, "delete", "https://a.example")[0] == 0 and call(spark, capsys, root, "docs")[1] == []
