"""Lines repeated across one source's documents: heavy-hitter summaries, exact recount, removal.

1. Every document becomes the 64-bit hashes of its lines' letters (tags, entities, digits, signs and case left out).
2. Each partition builds one Misra-Gries summary per source. A summary with k counters over n line occurrences
   undercounts by at most n / (k + 1); k is SLACK * n / (share * documents), so the summed error of all partitions
   stays under share * documents / SLACK and no line that reaches the share can be lost. Summaries merge by addition.
3. Candidates (estimate plus error reaches the threshold) are counted exactly in a second pass.
4. Confirmed lines are removed with per-source sets, broadcast when their counted size is within the bound.

A hash stands for a line only within its source; with 10^9 distinct lines in one source and 10^3 repeated ones a
false match has a chance of about 10^-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusloom.session import cut, maybe_broadcast

SHARE = 0.10  # of the documents of a source
LEAST = 5  # documents
LETTERS = 8  # fewer letters: the line does not count
SLACK = 2.0  # summed summary error is under SHARE / SLACK of a source's documents


def source_key(column: str = "source"):
    """A source without outer white space and case; null stays null."""
    return F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", ""))


def line_hashes(text: str):
    """array<bigint>, one entry a line split at \\n: the hash of the line's letters, 0 where it has fewer than LETTERS."""

    def one(line):
        bare = F.regexp_replace(line, r"<[^>]*>|&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);", "")
        # (?U) letters of any script; sharp s is folded as upper-casing folds it
        letters = F.replace(F.lower(F.regexp_replace(bare, r"[^\p{L}]+", "")), F.lit("ß"), F.lit("ss"))
        return F.when(F.length(letters) >= LETTERS, F.xxhash64(letters)).otherwise(F.lit(0).cast("bigint"))

    return F.transform(F.split(F.col(text), "\n", -1), one)


def hashed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, src, hashes) of every document; null texts have no lines, null sources drop out (no source, no repetition)."""
    return docs.select(
        F.col(id_col), source_key(source).alias("src"), F.coalesce(line_hashes(text), F.array().cast("array<bigint>")).alias("hashes")
    ).where("src is not null")


def _shrink(counts: pd.DataFrame, docs: dict, lines: dict, errors: dict, share: float) -> pd.DataFrame:
    kept = []
    for src, part in counts.groupby("src", sort=False):
        k = int(np.ceil(SLACK * lines[src] / max(1e-9, share * docs[src]))) + 1
        if len(part) > k:
            ordered = np.sort(part["n"].to_numpy())[::-1]
            cut_at = int(ordered[k])
            errors[src] = errors.get(src, 0) + cut_at
            part = part.assign(n=part["n"] - cut_at)
            part = part[part["n"] > 0]
        kept.append(part)
    return pd.concat(kept) if kept else counts


def summarise(share: float = SHARE, room: int = 400_000):
    """mapInPandas function: one mergeable summary per source and partition, as rows (src, key, n); key null has the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs: dict = {}
        lines: dict = {}
        errors: dict = {}
        counts = None
        for b in batches:
            sizes = b["keys"].str.len().to_numpy()
            for s, n, d in zip(*(x.tolist() for x in _sums(b["src"].to_numpy(), sizes))):
                lines[s] = lines.get(s, 0) + n
                docs[s] = docs.get(s, 0) + d
            if not sizes.sum():
                continue
            flat = pd.DataFrame({"src": np.repeat(b["src"].to_numpy(), sizes), "key": np.concatenate(b["keys"].to_numpy())})
            new = flat.groupby(["src", "key"], sort=False).size().rename("n").reset_index()
            counts = new if counts is None else pd.concat([counts, new]).groupby(["src", "key"], sort=False)["n"].sum().reset_index()
            if len(counts) > room:
                counts = _shrink(counts, docs, lines, errors, share)
                if len(counts) > room // 2:  # many sources in one partition: this summary is done, another begins; their errors add up to no more than one's
                    yield counts[["src", "key", "n"]].astype({"n": "int64"})
                    if errors:
                        yield pd.DataFrame({"src": list(errors), "key": pd.array([None] * len(errors), dtype="Int64"), "n": list(errors.values())})
                    docs, lines, errors, counts = {}, {}, {}, None
        if counts is not None:
            yield _shrink(counts, docs, lines, errors, share)[["src", "key", "n"]].astype({"n": "int64"})
            if errors:
                yield pd.DataFrame({"src": list(errors), "key": pd.array([None] * len(errors), dtype="Int64"), "n": list(errors.values())})

    return run


def _sums(src, sizes):
    names, at = np.unique(src.astype(str), return_inverse=True)
    return names, np.bincount(at, sizes, len(names)).astype(int), np.bincount(at, minlength=len(names))


def confirmed_lines(lines: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(src, key, docs): lines in at least `share` and at least `least` of the documents of their source, counted exactly.

    `lines` has (src, hashes). Blank documents count as documents. An empty input gives no row.
    """
    keys = lines.select("src", F.array_distinct(F.filter("hashes", lambda h: h != 0)).alias("keys"))
    totals = keys.groupBy("src").agg(F.count(F.lit(1)).alias("docs_in_source"))
    parts = keys.mapInPandas(summarise(share), "src string, key bigint, n bigint")
    sums = parts.groupBy("src", "key").agg(F.sum("n").alias("n"))
    errors = sums.where("key is null").select("src", F.col("n").alias("err"))
    candidates = cut(
        sums.where("key is not null")
        .join(totals, "src")
        .join(errors, "src", "left")
        .where((F.col("n") + F.coalesce("err", F.lit(0)) >= share * F.col("docs_in_source")) & (F.col("n") + F.coalesce("err", F.lit(0)) >= least))
        .select("src", "key", "docs_in_source")
    )
    few = maybe_broadcast(candidates, candidates.count(), 64)
    exact = keys.select("src", F.explode("keys").alias("key")).join(few, ["src", "key"]).groupBy("src", "key").agg(F.count(F.lit(1)).alias("docs"), F.first("docs_in_source").alias("docs_in_source"))
    return exact.where((F.col("docs") >= share * F.col("docs_in_source")) & (F.col("docs") >= least))


def line_sets(confirmed: DataFrame) -> DataFrame:
    """(src, bad): the confirmed lines of a source as one array; at most lines-per-document / share entries each."""
    return confirmed.groupBy("src").agg(F.collect_list("key").alias("bad"))


def _with_sets(rows: DataFrame, confirmed: DataFrame, how: str) -> DataFrame:
    sets = cut(line_sets(confirmed))
    size = sets.agg(F.coalesce(F.sum(F.size("bad")), F.lit(0))).first()[0]
    return rows.join(maybe_broadcast(sets, size, 16), "src", how)


def repeated_line_numbers(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(id, line_no from 1) of every line that repeats excessively within its source."""
    lines = cut(hashed(docs, id_col, text, source))
    hit = _with_sets(lines, confirmed_lines(lines, share, least), "inner")
    flags = F.transform("hashes", lambda h: (h != 0) & F.array_contains("bad", h))
    return hit.select(id_col, F.posexplode(flags).alias("at", "bad_line")).where("bad_line").select(id_col, (F.col("at") + 1).cast("int").alias("line_no"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE, least: int = LEAST, counted: DataFrame | None = None) -> DataFrame:
    """(id, removed, text): every row's text without the confirmed lines. Null text stays null with removed 0.

    `counted`, if given, is the table of documents that decides which lines repeat (chunks are cleaned by their documents).
    """
    base = docs if counted is None else counted
    confirmed = confirmed_lines(cut(hashed(base, "doc_id", "text", "source")) if counted is not None else cut(hashed(docs, id_col, text, source)), share, least)
    rows = docs.select(F.col(id_col), F.col(text).alias("raw"), source_key(source).alias("src"), F.split(F.col(text), "\n", -1).alias("ls"), line_hashes(text).alias("hashes"))
    hit = _with_sets(rows, confirmed, "left")
    bad = F.coalesce("bad", F.array().cast("array<bigint>"))
    keep = F.filter(F.arrays_zip("ls", "hashes"), lambda z: ~F.array_contains(bad, z["hashes"]))
    return hit.select(
        id_col,
        F.when(F.col("raw").isNull(), 0).otherwise(F.size("ls") - F.size(keep)).alias("removed"),
        F.when(F.col("raw").isNotNull(), F.array_join(F.transform(keep, lambda z: z["ls"]), "\n")).alias("text"),
    )
