"""Corpus life cycle as DataFrame to DataFrame operators: import, update, delete, read, liveness, fingerprints.

documents(id, title, source, license, acquired, hash, splitter, snapshot) holds current versions only; chunks keeps every
version, retired ones with active = false. Nothing here collects; publishing is a write of the returned tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import text as T
from corpusloom.session import cut

from . import split

DOCUMENTS = "id string, title string, source string, license string, acquired string, hash string, splitter string, snapshot string"
CHUNKS = "id string, doc_id string, section string, start_line int, end_line int, text string, version string, active boolean, kind string, page int"
DOCUMENT_COLUMNS = ["id", "title", "source", "license", "acquired", "hash", "splitter", "snapshot"]


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def document_id(source: Column) -> Column:
    return F.sha2(trimmed(source), 256)


def with_pages(incoming: DataFrame) -> DataFrame:
    """incoming with a column pages array<array<string>>, null for texts; the text of a page document is its lines."""
    rows = incoming if "pages" in incoming.columns else incoming.withColumn("pages", F.lit(None).cast("array<array<string>>"))
    return rows.withColumn("text", F.when(F.col("pages").isNotNull(), F.array_join(F.flatten("pages"), "\n")).otherwise(F.col("text")))


def invalid(incoming: DataFrame) -> DataFrame:
    """(source, problem) of rows that must not be imported: blank metadata, no date, blank text, unknown splitter or one that
    does not fit the form, pages whose lines are in no reading order."""
    rows = with_pages(incoming)
    blank = lambda c: trimmed(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    paged = F.col("pages").isNotNull()
    problem = (
        F.when(blank("source"), "source is blank")
        .when(blank("title"), "title is blank")
        .when(blank("license"), "license is blank")
        .when(F.col("acquired").cast("string").try_cast("date").isNull(), "acquired is no date")
        .when(blank("text"), "text is blank")
        .when(F.col("splitter").isNotNull() & ~F.col("splitter").isin(split.LINES, split.BLOCK, split.PROCEDURE, split.PAGES), "unknown splitter")
        .when(paged & (F.col("splitter") != split.PAGES), "a text splitter for pages")
        .when(~paged & (F.col("splitter") == split.PAGES), "the page splitter for a text")
        .when(paged & F.exists("pages", split.is_suspect), "suspect reading order")
    )
    return rows.select("source", problem.alias("problem")).where("problem is not null")


def effective_splitter(text: Column, requested: Column, paged: Column | None = None) -> Column:
    """The requested splitter, the baseline by default and for a text without a heading; pages have their own."""
    headed = F.exists(T.lines(text), lambda x: x.rlike(T.HEADING))
    asked = F.coalesce(requested, F.lit(split.LINES))
    return F.when(F.lit(False) if paged is None else paged, split.PAGES).when(asked.isin(split.BLOCK, split.PROCEDURE) & ~headed, split.LINES).otherwise(asked)


def import_status(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming(source, title, license, acquired, text, splitter, optional pages) with id, hash, splitter (effective) and status imported | updated | unchanged.

    A full key match of content hash and effective splitter is unchanged. Of repeated rows of a source the last by date, then
    by hash, counts. A page break counts as content.
    """
    rows = with_pages(incoming)
    content = F.when(F.col("pages").isNotNull(), F.array_join(F.transform("pages", lambda p: F.array_join(p, "\n")), "\f")).otherwise(F.col("text"))
    rows = rows.withColumns({"id": document_id(F.col("source")), "hash": F.sha2(content, 256), "splitter": effective_splitter(F.col("text"), F.col("splitter"), F.col("pages").isNotNull())})
    last = F.max_by(F.struct(*(c for c in rows.columns if c != "id")), F.struct(F.coalesce(F.col("acquired").cast("string"), F.lit("")), "hash"))
    rows = rows.groupBy("id").agg(last.alias("r")).select("id", "r.*")
    old = current.select("id", F.col("hash").alias("old_hash"), F.col("splitter").alias("old_splitter"))
    status = F.when(F.col("old_hash").isNull(), "imported").when((F.col("old_hash") == F.col("hash")) & (F.col("old_splitter") == F.col("splitter")), "unchanged").otherwise("updated")
    return rows.join(old, "id", "left").withColumn("status", status).drop("old_hash", "old_splitter")


def inherited(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Update rows (source, text and optional title, license, acquired, splitter) with what they omit taken from the current version; unknown sources drop out."""
    old = current.select(F.col("id"), *(F.col(c).alias(f"old_{c}") for c in ("title", "license", "acquired", "splitter")))
    rows = incoming.withColumn("id", document_id(F.col("source"))).join(old, "id")
    return rows.select("source", "text", *(F.coalesce(F.col(c), F.col(f"old_{c}")).alias(c) for c in ("title", "license", "acquired", "splitter")))


def chunked(rows: DataFrame) -> DataFrame:
    """Chunks of import rows (id, hash, text, splitter, pages) by each row's own splitter: one pass for texts, one for pages."""
    docs = rows.select(F.col("id").alias("doc_id"), "hash", "text", "splitter", "pages")
    paged = split.split_pages(docs.where(F.col("splitter") == split.PAGES).select("doc_id", "hash", "pages"))
    return split.split_by_name(docs.where(F.col("splitter") != split.PAGES)).unionByName(paged)


def import_documents(documents: DataFrame, chunks: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables after an import. Old chunks of changed documents retire; a chunk that comes back is reactivated, not doubled."""
    status = import_status(documents, incoming)
    changed = cut(status.where("status <> 'unchanged'"))
    fresh = changed.withColumn("snapshot", F.col("text")).select(*DOCUMENT_COLUMNS)
    docs = documents.select(*DOCUMENT_COLUMNS).join(changed.select("id"), "id", "left_anti").select(*DOCUMENT_COLUMNS).unionByName(fresh)
    new = cut(chunked(changed))
    touched = changed.select(F.col("id").alias("doc_id"), F.lit(True).alias("touched"))
    old = chunks.join(new.select("id"), "id", "left_anti").join(touched, "doc_id", "left").withColumn("active", F.col("active") & F.col("touched").isNull())
    return docs, old.select(*split.CHUNK_COLUMNS).unionByName(new.select(*split.CHUNK_COLUMNS))


def unknown_sources(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, problem) of sources that cannot be updated or deleted: blank, or without a document."""
    known = documents.select("id", F.lit(True).alias("known"))
    rows = sources.select("source", document_id(F.coalesce("source", F.lit(""))).alias("id")).distinct().join(known, "id", "left")
    problem = F.when(trimmed(F.coalesce("source", F.lit(""))) == "", "source is blank").when(F.col("known").isNull(), "unknown source")
    return rows.select("source", problem.alias("problem")).where("problem is not null")


def delete_documents(documents: DataFrame, chunks: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables after deleting (source); chunks retire but stay."""
    gone = sources.select(document_id(F.col("source")).alias("id")).distinct()
    docs = documents.join(gone, "id", "left_anti")
    mark = gone.select(F.col("id").alias("doc_id"), F.lit(True).alias("gone"))
    return docs, chunks.join(mark, "doc_id", "left").withColumn("active", F.col("active") & F.col("gone").isNull()).select(*chunks.columns)


def read_chunks(chunks: DataFrame, documents: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Active chunks (of `ids`, if given) with their document; version is the document's. Documents are narrowed before the join."""
    c = chunks.where("active").drop("version")
    if ids is not None:
        c = c.join(ids.select("id").distinct(), "id", "left_semi")
    d = documents.select(F.col("id").alias("doc_id"), "title", "source", "license", "acquired", F.col("hash").alias("version"))
    return c.join(d, "doc_id")


def liveness(chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """evidence(id, version) with status ok | retired | version_changed | unknown."""
    now = chunks.select("id", F.col("active").alias("live"), F.col("version").alias("now")).dropDuplicates(["id"])
    status = F.when(F.col("live").isNull(), "unknown").when(~F.col("live"), "retired").when(~F.col("now").eqNullSafe(F.col("version")), "version_changed").otherwise("ok")
    return evidence.join(now, "id", "left").select("id", "version", status.alias("status"))


def fingerprint(chunks: DataFrame) -> DataFrame:
    """(chunks, fingerprint): an order-free summary of the active chunks' ids and texts that changes with any of them.

    Sums of 64-bit hash parts add up partially on every task; nothing is gathered or sorted.
    """
    once = chunks.where("active").select("id", F.sha2(F.concat_ws(":", "id", F.sha2(F.coalesce("text", F.lit("")), 256)), 256).alias("h")).dropDuplicates(["id"])
    part = lambda a: F.coalesce(F.sum(F.conv(F.substring("h", a, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return once.agg(F.count(F.lit(1)).alias("chunks"), F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), part(1), part(9), part(17), part(25)), 256).alias("fingerprint"))


def stale(stored: DataFrame, chunks: DataFrame, encoder: str) -> DataFrame:
    """(stale): whether a stored index (fingerprint, encoder) no longer fits the chunks or the encoder."""
    now = fingerprint(chunks).select(F.col("fingerprint").alias("now"))
    meta = stored.select("fingerprint", "encoder").limit(1)
    return now.join(F.broadcast(meta), now["now"] == meta["fingerprint"], "left").select((F.col("fingerprint").isNull() | (F.col("encoder") != encoder)).alias("stale"))


def manifest_mismatches(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, problem) of manifest(file, sha256) against files(file, content): missing or different content."""
    have = files.select("file", F.sha2("content", 256).alias("actual"))
    problem = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.lower("sha256"), "different")
    return manifest.join(have, "file", "left").select("file", problem.alias("problem")).where("problem is not null")


def migrated(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of an older layout with the columns it lacks: version from the document, active, kind body, page null."""
    rows = chunks
    if "version" not in rows.columns:
        rows = rows.withColumn("version", F.lit(None).cast("string"))
    rows = rows.join(documents.select(F.col("id").alias("doc_id"), F.col("hash").alias("doc_hash")), "doc_id", "left").withColumn("version", F.coalesce(F.nullif(F.col("version"), F.lit("")), F.col("doc_hash"), F.lit("")))
    for name, value in (("active", F.lit(True)), ("kind", F.lit("body")), ("page", F.lit(None).cast("int"))):
        if name not in rows.columns:
            rows = rows.withColumn(name, value)
    return rows.select(*split.CHUNK_COLUMNS)


def rebuilt(documents: DataFrame, splitter: str) -> DataFrame:
    """Chunks of the stored snapshots under one text splitter, as a throw-away corpus to compare splitters on; the usual fallback holds."""
    docs = documents.select("id", "hash", F.col("snapshot").alias("text"), F.lit(None).cast("array<array<string>>").alias("pages"))
    return chunked(docs.withColumn("splitter", effective_splitter(F.col("text"), F.lit(splitter))))
