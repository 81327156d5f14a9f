"""How characteristic a term is of its record: log-likelihood ratio on the two-by-two table of term counts.

The table of a term in a record: its count in the record (a) and in the rest (b), the other tokens of the record
(n1 - a) and of the rest (n2 - b). G2 = 2 * sum(observed * ln(observed / expected)); it is negative where the record
uses the term less often than the rest does.

Plan: one exchange on the record id removes repeated rows; a record's counts come from its own sorted terms, without
another. Texts are split once: the counts are written as one row a record and read again for the totals and for the
scores. Term totals are pre-aggregated before their exchange. The terms that make up at least 1 / HEAD of all tokens (at
most HEAD of them, whatever the size of the data) are joined by broadcast, and only what they leave over goes through an
exchange on the term: no frequent term gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.session import cut, written

HEAD = 20_000
SIGNIFICANT = 10.83  # fixed value: the 0.999 quantile of the chi-square distribution with one degree of freedom


def terms_of(text: Column) -> Column:
    """Runs of a-z, 0-9 and _ with at least one letter, of the lower-cased text."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)), lambda t: t.rlike("[a-z]"))


def record_terms(records: DataFrame, id_col: str = "id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(record, *keep, tokens, terms array<struct<term, tf>>). Repeated ids count once; null or term-less texts give no row."""
    once = records.select(F.col(id_col).alias("record"), *keep, F.col(text).alias("body_text")).where("record is not null").dropDuplicates(["record"])
    tokens = once.select("record", *keep, F.sort_array(terms_of(F.col("body_text"))).alias("ts")).where(F.size("ts") > 0)
    # a term's run in the sorted terms starts where it differs from the one before
    runs = tokens.select("record", *keep, "ts", F.filter(F.sequence(F.lit(0), F.size("ts") - 1), lambda i: (i == 0) | (F.get("ts", i) != F.get("ts", i - 1))).alias("starts"))
    ends = lambda j: F.coalesce(F.get("starts", j + 1), F.size("ts"))
    return runs.select("record", *keep, F.size("ts").alias("tokens"), F.transform("starts", lambda a, j: F.struct(F.get("ts", a).alias("term"), (ends(j) - a).cast("bigint").alias("tf"))).alias("terms"))


def flattened(counted: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(record, *keep, tokens, term, tf) of record_terms."""
    return counted.select("record", *keep, "tokens", F.inline("terms"))


def term_totals(tf: DataFrame) -> DataFrame:
    """(term, cf, df) over all records."""
    return tf.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))


def g2(a, b, n1, n2) -> Column:
    """Signed log-likelihood ratio of a two-by-two table."""

    def part(observed, row, column):
        expected = row * column / total
        return F.when(observed > 0, observed * F.ln(observed / expected)).otherwise(F.lit(0.0))

    a, b, n1, n2 = (x.cast("double") for x in (a, b, n1, n2))
    total = n1 + n2
    score = 2 * (part(a, n1, a + b) + part(b, n2, a + b) + part(n1 - a, n1, total - a - b) + part(n2 - b, n2, total - a - b))
    return F.when(a * n2 >= b * n1, score).otherwise(-score)


def distinctive_terms(
    records: DataFrame, id_col: str = "id", text: str = "text", keep: tuple[str, ...] = (), min_tf: int = 1, df_range: tuple[int, int] | None = None, where: str | None = None
) -> DataFrame:
    """(record, *keep, term, tf, cf, df, score) for every term of every record.

    min_tf, df_range and where choose which scores are wanted; totals always cover all records. Empty input: no row.
    """
    counted = written(record_terms(records, id_col, text, keep))
    tf = flattened(counted, keep)
    totals = cut(term_totals(tf))
    everything = totals.agg(F.coalesce(F.sum("cf"), F.lit(0))).first()[0]
    wanted = tf.where(F.col("tf") >= min_tf)
    if where:
        wanted = wanted.where(where)
    edge = max(1, -(-everything // HEAD))
    asked = F.col("df").between(*df_range) if df_range else F.lit(True)
    marked = wanted.join(F.broadcast(totals.where(F.col("cf") >= edge)), "term", "left")  # at most HEAD terms
    columns = ["record", *keep, "tokens", "term", "tf", "cf", "df"]
    rest = marked.where("cf is null").drop("cf", "df").join(totals.where((F.col("cf") < edge) & asked), "term")
    joined = marked.where(F.col("cf").isNotNull() & asked).select(*columns).unionByName(rest.select(*columns))
    score = g2(F.col("tf"), F.col("cf") - F.col("tf"), F.col("tokens"), F.lit(everything) - F.col("tokens"))
    return joined.select("record", *keep, "term", "tf", "cf", "df", score.alias("score"))
