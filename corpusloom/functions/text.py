"""Line, token and markup helpers as Column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns, labels and aliases that decide results
TOKEN = r"[a-z0-9_]+|[一-鿿]+"
HEADING = r"(?U)^#{1,6}\s+(.+)$"
FENCE = r"(?U)^\s*(```|~~~)"
META_LINE = r"(?iU)^\s*(Source|Publisher|License|Retrieved|Title|Author|Date)\s*[:：]"
ADAPT_NOTE = r"(?iU)^\s*(This is a (selected )?excerpt|Formatting and|Adapted from|Note:)"
LIST_ITEM = r"(?U)^\s*([-*+]|\d+[.)])\s+"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
BODY_SECTION = "(正文)"
METADATA_SECTION = "(说明性元数据)"
CODE_SECTION = "代码（%s）"
ALIASES = (("提示注入", "prompt injection"), ("工具权限", "tool permissions"), ("最小权限", "least privilege"), ("间接注入", "indirect injection"))
QUESTION_PART = r"[^？?；;\n]+[？?；;\n]*|[？?；;\n]+"


def lines(text: Column) -> Column:
    """Lines as a text splits into them: any line break, no empty last line; a null or empty text has none."""
    parts = F.split(text, LINE_BREAK, -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(parts)


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def tokens(text: Column) -> Column:
    """Terms of a text in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def expanded(query: Column) -> Column:
    """A query in lower case with the English of every alias that it contains appended."""
    out = F.lower(query)
    for term, english in ALIASES:
        out = F.when(F.contains(query, F.lit(term)), F.concat(out, F.lit(" " + english))).otherwise(out)
    return out


def search_terms(query: Column) -> Column:
    return tokens(expanded(query))


def question_parts(query: Column) -> Column:
    """array<struct<id, text>>: the parts between question marks, semicolons and line breaks, trimmed, blank ones out, ids q1, q2, ..."""
    raw = F.regexp_extract_all(query, F.lit(QUESTION_PART), F.lit(0))
    kept = F.filter(F.transform(raw, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    return F.transform(kept, lambda p, i: F.struct(F.concat(F.lit("q"), i + 1).alias("id"), p.alias("text")))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the code points, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def is_metadata_block(block: Column) -> Column:
    """Of an array of lines: there are non-blank lines and all of them are provenance lines."""
    real = F.filter(block, lambda x: ~is_blank(x))
    return (F.size(real) > 0) & F.forall(real, lambda x: x.rlike(META_LINE))


def chunk_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)
