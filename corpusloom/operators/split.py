"""Splitters: documents to line-addressed chunks.

A document becomes its chunks in the scan's own stage, without exploding lines and without an exchange. Page splitting is
a fold over the lines of one row. The splitters for texts run as Python functions in Arrow batches: a fold in the JVM,
whose state grows by copying, took twice their time, and an index form of it fifteen times.

Input: (doc_id, hash, text) and, for pages, (doc_id, hash, pages array<array<string>>). Output columns: CHUNK_COLUMNS.
Null or blank texts give no chunk.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import text as T

# Names of the splitters and the line budget
LINES, BLOCK, PROCEDURE, PAGES = "heading-lines-v1:20", "heading-block-v2", "heading-procedure-v3", "pdf-pages-v1"
BUDGET = 20
CHUNK_COLUMNS = ["id", "doc_id", "section", "start_line", "end_line", "text", "version", "active", "kind", "page"]


def _emit(rows: DataFrame, splitter: str, spans: Column, kind: Column, page: Column | None = None) -> DataFrame:
    """Chunks of (doc_id, hash, ls) by spans array<struct<start, end, section>>; blank ones drop out."""
    flat = rows.withColumn("span", F.explode(spans)).withColumn("block", F.slice("ls", F.col("span.start"), F.col("span.end") - F.col("span.start") + 1)).withColumn("text", F.array_join("block", "\n"))
    flat = flat.where(~T.is_blank(F.col("text")))
    id_parts = [F.col("doc_id"), F.col("hash"), F.lit(splitter), *([page.cast("string")] if page is not None else []), F.col("span.start").cast("string"), F.col("span.end").cast("string")]
    return flat.select(
        T.chunk_id(*id_parts).alias("id"), "doc_id", F.col("span.section").alias("section"), F.col("span.start").alias("start_line"), F.col("span.end").alias("end_line"),
        "text", F.col("hash").alias("version"), F.lit(True).alias("active"), kind.alias("kind"), (page if page is not None else F.lit(None)).cast("int").alias("page"),
    )


def _peel(rows: DataFrame) -> DataFrame:
    """Of rows with u struct<start, end, section> and ls: adds parts, u itself or provenance and body of it.

    Provenance between a heading and its body becomes a unit of its own, with the heading line; line numbers stay. The
    steps are columns of their own so that no line is matched twice.
    """
    boiler = lambda x: x.rlike(T.META_LINE) | x.rlike(T.ADAPT_NOTE)
    rows = rows.withColumn("block", F.slice("ls", F.col("u.start"), F.col("u.end") - F.col("u.start") + 1))
    # only a block that opens with a heading can be peeled; 0 body, 1 blank, 2 provenance
    kinds = F.transform("block", lambda x, i: F.when(i == 0, F.when(x.rlike(T.HEADING), 3).otherwise(4)).when(T.is_blank(x), 1).when(boiler(x), 2).otherwise(0))
    rows = rows.withColumn("marks", F.when(F.element_at("block", 1).rlike(T.HEADING), kinds))
    rows = rows.withColumn("body_at", F.array_position("marks", 0).cast("int"))
    lead = F.when(F.col("body_at") > 0, F.slice("marks", 1, F.col("body_at") - 1)).otherwise(F.col("marks"))
    rows = rows.withColumn("peel", F.coalesce(F.array_contains(lead, 2), F.lit(False)))
    part = lambda a, z, name: F.struct(a.alias("start"), z.alias("end"), name.alias("section"))
    start, end, meta = F.col("u.start"), F.col("u.end"), F.lit(T.METADATA_SECTION)
    cut_at = start + F.col("body_at") - 1
    parts = F.when(F.col("peel") & (F.col("body_at") == 0), F.array(part(start, end, meta))).when(F.col("peel"), F.array(part(start, cut_at - 1, meta), part(cut_at, end, F.col("u.section")))).otherwise(F.array(part(start, end, F.col("u.section"))))
    return rows.withColumn("parts", parts).drop("block", "marks", "body_at", "peel")


# ---- procedures -----------------------------------------------------------------------------------------------------

_HEAD, _FENCED = re.compile(r"^#{1,6}\s+(.+)$"), re.compile(r"^\s*(```|~~~)")
_ITEM = re.compile(T.LIST_ITEM.replace("(?U)", ""))
_PROVENANCE, _NOTE = re.compile(T.META_LINE.replace("(?iU)", ""), re.I), re.compile(T.ADAPT_NOTE.replace("(?iU)", ""), re.I)


def _opened(lines: list[str], fences: bool) -> list[tuple[str, int, int]]:
    """Non-blank sections (title, first, last) opened by headings; with `fences`, a heading inside a fence is none."""
    out: list[list] = []
    inside = False
    for n, line in enumerate(lines, 1):
        if fences and _FENCED.match(line):
            inside = not inside
        head = None if inside else _HEAD.match(line)
        if head or not out:
            out.append([head[1] if head else T.BODY_SECTION, n, n])
        else:
            out[-1][2] = n
    return [(t, a, z) for t, a, z in out if any(x.strip() for x in lines[a - 1 : z])]


def _parted(lines: list[str], first: int, last: int) -> int:
    """Number of lines at the start of a headed section that are its heading and provenance; 0 where there is none to peel."""
    rows = lines[first - 1 : last]
    if not _HEAD.match(rows[0]):
        return 0
    n = next((i for i in range(1, len(rows)) if rows[i].strip() and not _PROVENANCE.match(rows[i]) and not _NOTE.match(rows[i])), len(rows))
    return n if any(_PROVENANCE.match(x) or _NOTE.match(x) for x in rows[1:n]) else 0


def block_chunks(lines: list[str]) -> list[tuple[str, int, int, str]]:
    """(section, start, end, kind) of blocks: opened by any heading line (fences play no part), provenance peeled off, cut at
    the budget unless the text so far ends in a colon and a list item follows."""
    out = []
    for title, first, last in _opened(lines, False):
        n = _parted(lines, first, last)
        for name, a, z in [(T.METADATA_SECTION, first, first + n - 1), (title, first + n, last)] if n else [(title, first, last)]:
            start, colon = a, False
            for i in range(a, z + 1):
                bare = lines[i - 1].rstrip()
                colon = bare.endswith((":", "：")) if bare else colon
                full = i - start + 1 >= BUDGET and not (colon and i < z and _ITEM.match(lines[i]))
                if full or i == z:
                    rows = [x for x in lines[start - 1 : i] if x.strip()]
                    if rows:
                        meta = name == T.METADATA_SECTION or all(_PROVENANCE.match(x) for x in rows)
                        out.append((name, start, i, "metadata" if meta else "body"))
                    start, colon = i + 1, False
    return out


def procedure_chunks(lines: list[str]) -> list[tuple[str, int, int, str]]:
    """(section, start, end, kind) of the pieces of a procedure.

    Sections open at headings outside fences; provenance under a heading is peeled off with the heading. A fence with the
    prose right before it is one piece; other prose ends at blank lines or 20 lines. A section without body has no piece,
    and a heading belongs to the first piece of its section (blank lines between them stay in the piece, so every piece is
    exactly its lines).
    """
    parts: list[list] = []
    for title, first, last in _opened(lines, True):
        n = _parted(lines, first, last)
        if n:
            parts.append([T.METADATA_SECTION, first, first + n - 1])
        if not n:
            parts.append([title, first, last])
        elif first + n <= last:
            # what follows a peeled title keeps the last real title before it, else its own
            real = [p[0] for p in parts if p[0] != T.METADATA_SECTION]
            parts.append([real[-1] if real else title, first + n, last])
    out = []
    for title, first, last in parts:
        headed = bool(_HEAD.match(lines[first - 1]))
        if headed and not any(x.strip() for x in lines[first:last]):
            if title == T.METADATA_SECTION:
                out.append((title, first, last, "metadata"))
            continue
        for k, (a, z) in enumerate(_pieces(lines, first + headed, last)):
            a = first if headed and not k else a
            fenced = any(_FENCED.match(x) for x in lines[a - 1 : z])
            name = T.CODE_SECTION % title if fenced and title not in (T.METADATA_SECTION, T.BODY_SECTION) else title
            out.append((name, a, z, "metadata" if title == T.METADATA_SECTION else "body"))
    return out


def _pieces(lines: list[str], first: int, last: int) -> list[tuple[int, int]]:
    out, start, n = [], None, first
    while n <= last:
        line = lines[n - 1]
        if _FENCED.match(line):
            end = next((m for m in range(n + 1, last + 1) if _FENCED.match(lines[m - 1])), last)
            out.append((n if start is None else start, end))
            start, n = None, end
        elif not line.strip():
            if start is not None:
                out.append((start, n - 1))
            start = None
        else:
            start = n if start is None else start
            if n - start + 1 >= BUDGET:
                out.append((start, n))
                start = None
        n += 1
    return [*out, (start, last)] if start is not None else out


def line_chunks(lines: list[str]) -> list[tuple[str, int, int, str]]:
    """(section, start, end, kind) of the baseline."""
    out, inside, title, start = [], False, T.BODY_SECTION, 1
    for n, line in enumerate(lines, 1):
        inside ^= bool(_FENCED.match(line))
        head = None if inside else _HEAD.match(line)
        if n > start and (head or n - start >= BUDGET):
            out.append((title, start, n - 1, "body"))
            start = n
        title = head[1] if head else title
    if lines:
        out.append((title, start, len(lines), "body"))
    return [x for x in out if any(r.strip() for r in lines[x[1] - 1 : x[2]])]


RULES = {LINES: line_chunks, BLOCK: block_chunks, PROCEDURE: procedure_chunks}


def own_lines(text: str | None) -> list[str]:
    """Lines as T.lines gives them; Python's line breaks are those of T.LINE_BREAK."""
    return text.splitlines() if text else []


def chunk_name(doc: str, version: str, splitter: str, start: int, end: int) -> str:
    return hashlib.sha256(f"{doc}:{version}:{splitter}:{start}:{end}".encode()).hexdigest()


def split_by_name(docs: DataFrame) -> DataFrame:
    """Chunks of (doc_id, hash, text, splitter) by each row's own text splitter, in one pass; other splitters give none."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, version, text, splitter in zip(b["doc_id"], b["hash"], b["text"], b["splitter"]):
                if splitter not in RULES:
                    continue
                ls = own_lines(text)
                for section, a, z, k in RULES[splitter](ls):
                    out.append((chunk_name(doc, version, splitter, a, z), doc, section, a, z, "\n".join(ls[a - 1 : z]), version, True, k))
            if out:
                yield pd.DataFrame(out, columns=CHUNK_COLUMNS[:-1])

    chunks = docs.select("doc_id", "hash", "text", "splitter").mapInPandas(run, f"id string, doc_id {kind}, section string, start_line int, end_line int, text string, version string, active boolean, kind string")
    return chunks.withColumn("page", F.lit(None).cast("int"))


def _by_lines(docs: DataFrame, splitter: str) -> DataFrame:
    return split_by_name(docs.select("doc_id", "hash", "text", F.lit(splitter).alias("splitter")))


def split_lines(docs: DataFrame) -> DataFrame:
    """Baseline: a heading outside fences or the 20-line budget starts a chunk; every chunk is body."""
    return _by_lines(docs, LINES)


def split_blocks(docs: DataFrame) -> DataFrame:
    """Blocks by heading; see block_chunks."""
    return _by_lines(docs, BLOCK)


def split_procedures(docs: DataFrame) -> DataFrame:
    """Procedures; see procedure_chunks."""
    return _by_lines(docs, PROCEDURE)


# ---- pages ----------------------------------------------------------------------------------------------------------


def _edge_key(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), r"(?U)\d+", "#")


def page_furniture(docs: DataFrame) -> DataFrame:
    """(doc_id, edge, key, pages): first or last non-blank lines, digits aside, that repeat on at least half of the pages (2 at least).

    One row of arrays per document; counting is per document, so there is no exchange.
    """
    edges = F.transform(F.filter("pages", lambda p: F.exists(p, lambda x: ~T.is_blank(x))), lambda p: F.filter(p, lambda x: ~T.is_blank(x)))
    rows = docs.select("doc_id", F.size(F.filter("pages", lambda p: F.size(p) > 0)).alias("total"), edges.alias("real"))
    tops, bottoms = F.transform("real", lambda p: _edge_key(F.element_at(p, 1))), F.transform("real", lambda p: _edge_key(F.element_at(p, -1)))
    out = None
    for edge, keys in (("top", tops), ("bottom", bottoms)):
        part = rows.where("total >= 2").withColumn("keys", keys).select("doc_id", F.lit(edge).alias("edge"), "total", "keys", F.explode(F.array_distinct("keys")).alias("key"))
        part = part.select("doc_id", "edge", "key", F.size(F.filter("keys", lambda k: k == F.col("key"))).alias("pages"), "total")
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("pages") >= F.greatest(F.lit(2), F.floor((F.col("total") + 1) / 2))).select("doc_id", "edge", "key", "pages")


def is_suspect(page: Column) -> Column:
    """Of a page's lines: at least 12 are not blank, and over 60 % of those have 3 characters or fewer."""
    real = F.filter(page, lambda x: ~T.is_blank(x))
    short = F.filter(real, lambda x: F.length(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")) <= 3)
    return (F.size(real) >= 12) & (F.size(short) > 0.6 * F.size(real))


def suspect_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page, lines, short): pages of at least 12 non-blank lines of which over 60 % have 3 characters or fewer."""
    page = docs.select("doc_id", F.posexplode("pages").alias("at", "p")).select("doc_id", (F.col("at") + 1).alias("page"), F.transform(F.filter("p", lambda x: ~T.is_blank(x)), lambda x: F.length(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))).alias("n"))
    return page.select("doc_id", "page", F.size("n").alias("lines"), F.size(F.filter("n", lambda k: k <= 3)).alias("short")).where("lines >= 12 and short > 0.6 * lines")


def split_pages(docs: DataFrame) -> DataFrame:
    """Chunks never cross a page; headings start a chunk; running headers and footers are metadata of their own; title provenance is peeled off."""
    marks = page_furniture(docs).groupBy("doc_id").agg(F.collect_list(F.when(F.col("edge") == "top", F.col("key"))).alias("tops"), F.collect_list(F.when(F.col("edge") == "bottom", F.col("key"))).alias("bottoms"))
    none = F.array().cast("array<string>")
    rows = docs.join(marks, "doc_id", "left").select("doc_id", "hash", "pages", F.coalesce("tops", none).alias("tops"), F.coalesce("bottoms", none).alias("bottoms"))

    def page(p, i):
        real = F.transform(p, lambda x: ~T.is_blank(x))
        first, last = F.array_position(real, True), F.size(p) - F.array_position(F.reverse(real), True) + 1
        return F.transform(
            p,
            lambda x, j: F.struct(
                (i + 1).cast("int").alias("page"), x.alias("line"), x.rlike(T.FENCE).alias("fence"), F.when(x.rlike(T.HEADING), F.regexp_extract(x, T.HEADING, 1)).alias("head"),
                (((j + 1 == first) & F.array_contains("tops", _edge_key(x))) | ((j + 1 == last) & F.array_contains("bottoms", _edge_key(x)))).alias("edge"),
            ),
        )

    rows = rows.withColumn("pl", F.flatten(F.transform("pages", page))).withColumn("ls", F.transform("pl", lambda x: x["line"]))
    zero = F.struct(F.array().cast("array<struct<start:int,section:string,edge:boolean,page:int>>").alias("starts"), F.lit(0).alias("at"), F.lit(False).alias("fenced"), F.lit(T.BODY_SECTION).alias("section"), F.lit(0).alias("page"), F.lit(True).alias("open"))

    def step(s, x):
        head = x["head"].isNotNull() & ~s["fenced"]
        section = F.when(head & ~x["edge"], x["head"]).otherwise(s["section"])
        new = s["open"] | x["edge"] | (s["page"] != x["page"]) | head
        mark = F.struct((s["at"] + 1).alias("start"), section.alias("section"), x["edge"].alias("edge"), x["page"].alias("page"))
        return F.struct(F.when(new, F.concat(s["starts"], F.array(mark))).otherwise(s["starts"]).alias("starts"), (s["at"] + 1).alias("at"), F.when(x["fence"], ~s["fenced"]).otherwise(s["fenced"]).alias("fenced"), section.alias("section"), x["page"].alias("page"), x["edge"].alias("open"))

    rows = rows.withColumn("starts", F.aggregate("pl", zero, step, lambda s: s["starts"]))
    spans = F.transform("starts", lambda s, i: F.struct(s["start"].alias("start"), F.when(i + 1 < F.size("starts"), F.try_element_at("starts", (i + 2).cast("int"))["start"] - 1).otherwise(F.size("ls")).alias("end"), s["section"].alias("section"), s["edge"].alias("edge"), s["page"].alias("page")))
    rows = rows.select("doc_id", "hash", "ls", F.explode(spans).alias("s"))
    rows = _peel(rows.withColumn("u", F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.section").alias("section"))))
    spans = F.when(~F.col("s.edge") & (F.size("parts") > 1), F.col("parts")).otherwise(F.array("u"))
    kind = F.when(F.col("s.edge") | ((F.col("span.section") == T.METADATA_SECTION)), "metadata").otherwise("body")
    return _emit(rows, PAGES, spans, kind, F.col("s.page"))


def split(docs: DataFrame, splitter: str) -> DataFrame:
    """By the splitter's name; a document without any heading falls back to the baseline under the two structured ones."""
    if splitter == LINES:
        return split_lines(docs)
    if splitter == PAGES:
        return split_pages(docs)
    if splitter not in (BLOCK, PROCEDURE):
        raise ValueError(f"unknown splitter: {splitter}")
    headed = F.exists(T.lines(F.col("text")), lambda x: x.rlike(T.HEADING))
    own = {BLOCK: split_blocks, PROCEDURE: split_procedures}[splitter]
    return own(docs.where(headed)).unionByName(split_lines(docs.where(~headed)))


def census(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunks, metadata, body, mean_chars) per document."""
    meta = F.count_if(F.col("kind") == "metadata")
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), meta.alias("metadata"), (F.count(F.lit(1)) - meta).alias("body"), F.round(F.avg(F.length("text")), 0).cast("bigint").alias("mean_chars"))


def preview(chunks: DataFrame, docs: DataFrame, around: int = 2) -> DataFrame:
    """(id, kind, start_line, end_line, chars, before, after): a chunk with the lines around it in its document."""
    ls = F.split("snapshot", "\n", -1)
    rows = chunks.join(docs.select("doc_id", "snapshot"), "doc_id").withColumn("ls", ls)
    low = F.greatest(F.lit(1), F.col("start_line") - around)
    before = F.slice("ls", low, F.col("start_line") - low)
    after = F.slice("ls", F.col("end_line") + 1, F.lit(around))
    return rows.select("id", "kind", "start_line", "end_line", F.length("text").alias("chars"), F.array_join(before, "\n").alias("before"), F.array_join(after, "\n").alias("after"))
