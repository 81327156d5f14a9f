"""Retrieval, batch first: a retriever maps queries(query_id, text) to ranked(query_id, id, rank, score).

Chunks are split into terms once: what a chunk holds of the queries' terms is kept as one short row of numbers, and only
that row goes through an exchange (repeated chunks count once) and is written. Statistics come from these rows. A task takes
a block of queries and runs over the written rows, slice by slice: sums of short numbers, shared by queries that begin with the
same terms, tell which rows can reach the k best so far, and only those are scored exactly. So a frequent term never multiplies
rows, and little more than k rows a query leave the tasks. Vectors are searched the same way. Texts are joined after top-k.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions import text as T
from corpusloom.session import arrow_files, cut, written_at

# Parameters of the scores
K1, B, RRF_K, MOST = 1.5, 0.75, 60, 20
QUERY_BLOCK = 4096  # queries of a task
QUERY_SCAN = 16 * QUERY_BLOCK  # queries, about, that one job answers; more take further jobs over the same rows
CELLS = 16 << 20  # of a task's matrix of terms by chunks
SLICE = 8192  # rows a task scores at once, at most


def check_arguments(query: str | None, limit: int) -> None:
    if query is not None and not query.strip():
        raise ValueError("the query is blank")
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit must lie between 1 and {MOST}")


def one_query(spark, text: str, query_id: str = "q") -> DataFrame:
    check_arguments(text, 1)
    return spark.createDataFrame([(query_id, text)], "query_id string, text string")


def refused(queries: DataFrame) -> DataFrame:
    """(query_id, problem) of a batch's queries that a single call would refuse; they get no candidates."""
    return queries.where(T.is_blank(F.col("text"))).select("query_id", F.lit("the query is blank").alias("problem"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct terms of every query, aliases expanded; blank queries have none."""
    return queries.select("query_id", F.explode(F.array_distinct(T.search_terms(F.col("text")))).alias("term"))


def active_once(chunks: DataFrame) -> DataFrame:
    return chunks.where("active").select("id", "kind", "text").dropDuplicates(["id"])


def top(scored: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The first k of every query; the rank limit works before the exchange, so a query's candidates are never gathered whole."""
    w = Window.partitionBy(by).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Terms:
    """Which of `words` (by number) texts hold; made for batches of texts, as passes over their bytes, which find the terms of T.TOKEN."""

    def __init__(self, words: list[str]):
        import pyarrow as pa

        self.words, self.values = max(1, len(words)), pa.array(words, pa.string())
        self.kinds = np.zeros(256, np.uint8)
        self.kinds[list(b"abcdefghijklmnopqrstuvwxyz0123456789_")] = 1

    def found(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(terms, bounds): numbers of all terms in order, -1 for one that is no word; the terms of text i lie from bounds[i] up to bounds[i + 1]."""
        import pyarrow as pa
        import pyarrow.compute as pc

        one = "\x00".join(t.replace("\x00", " ") if t else "" for t in texts) + "\x00"
        data = np.frombuffer(one.lower().encode(), np.uint8)
        kind = self.kinds[data]
        han = np.flatnonzero((data >= 0xE4) & (data <= 0xE9))  # first bytes of U+4000 to U+9FFF
        han = han[(data[han] > 0xE4) | (data[han + 1] >= 0xB8)]  # from U+4E00
        for i in range(3):
            kind[han + i] = 2
        begin = np.flatnonzero((kind > 0) & (kind != np.r_[np.uint8(0), kind[:-1]]))
        kept = np.cumsum(kind > 0, dtype=np.int32)  # bytes of terms, up to and with each
        edge = np.r_[kept[begin] - 1, kept[-1]].astype(np.int32)
        terms = pa.StringArray.from_buffers(len(begin), pa.py_buffer(edge), pa.py_buffer(data[kind > 0]))
        number = pc.fill_null(pc.index_in(terms, value_set=self.values), -1).to_numpy(zero_copy_only=False)
        return number, np.r_[0, np.searchsorted(begin, np.flatnonzero(data == 0))] if texts else np.zeros(1, int)

    def counted(self, terms: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple:
        """Arrow arrays (ts, tfs) of rows, each the terms from first up to last; rows may share terms."""
        import pyarrow as pa

        kept = np.r_[0, np.cumsum(terms >= 0)]  # only words are laid out
        numbers, a, n = terms[terms >= 0], kept[first], kept[last] - kept[first]
        row = np.repeat(np.arange(len(n)), n)
        own = numbers[np.arange(len(row)) + np.repeat(a - (np.cumsum(n) - n), n)]
        key, times = np.unique(row * self.words + own, return_counts=True)
        edge = pa.array(np.searchsorted(key, np.arange(len(n) + 1) * self.words), pa.int32())
        return tuple(pa.ListArray.from_arrays(edge, pa.array(x.astype(np.int32))) for x in (key % self.words, times))


def held_terms(chunks: DataFrame, words: list[str]) -> str:
    """Path of written rows (id, length, ts, tfs) in folders by body: of every active chunk once, which of `words` (by number) it holds, and how often; without terms its length is 1."""
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast(words)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        terms, seen = Terms(shared.value), set()
        for b in batches:
            new = [not (i in seen or seen.add(i)) for i in b.column("id").to_pylist()]
            b = b.filter(pa.array(new))
            found, bounds = terms.found(b.column("text").to_pylist())
            ts, tfs = terms.counted(found, bounds[:-1], bounds[1:])
            yield pa.RecordBatch.from_arrays([b.column("id"), pc.fill_null(pc.equal(b.column("kind"), "body"), False), pa.array(np.maximum(1, np.diff(bounds)), pa.int32()), ts, tfs], ["id", "body", "length", "ts", "tfs"])

    # few large row groups must not leave cores idle: the exchange comes before the work, by id, so that a task sees all repeats
    # of a chunk; its number of partitions is not made fewer: each is a file, of which tasks take their share
    rows = chunks.where("active and id is not null").select("id", "kind", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    once = rows.mapInArrow(run, "id string, body boolean, length int, ts array<int>, tfs array<int>")
    return written_at(once.sortWithinPartitions("body", "id"), "body")


def _whole(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a column of arrays."""
    import pyarrow as pa

    a = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return a.offsets.to_numpy(), a.values.to_numpy(zero_copy_only=False)


def _shares(blocks: int, spark) -> int:
    """Into how many parts the files go, so that a few blocks of queries keep all cores busy too."""
    return max(1, -(-3 * spark.sparkContext.defaultParallelism // max(1, blocks)))


class Best:
    """The k best (key, id, score) of each of n queries: highest key, then lowest id."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n)]
        self.least = np.full(n, -np.inf)  # key of the last place where all are taken

    def add(self, at: np.ndarray, key: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """at: numbers of queries in rising order."""
        edges = np.r_[0, np.flatnonzero(np.diff(at)) + 1, len(at)] if len(at) else [0]
        key, ids, score = (-key).tolist(), ids.tolist(), score.tolist()
        for a, z in zip(edges[:-1], edges[1:]):
            e = at[a]
            own = self.rows[e] = sorted(self.rows[e] + list(zip(key[a:z], ids[a:z], score[a:z])))[: self.k]
            if len(own) == self.k:
                self.least[e] = -own[-1][0]


def _tables(at, names: list[str], rows: int) -> Iterator:
    """The files' rows by id, files together as long as they hold no more than so many rows."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    held, n = [], 0
    for name in [*names, None]:
        t = pq.ParquetFile(at.open_input_file(name)).read(columns=["id", "length", "ts", "tfs"]) if name else None
        if held and (t is None or n + len(t) > rows):
            one = pa.concat_tables(held)
            yield (one.take(pa.compute.sort_indices(one["id"])) if len(held) > 1 else one).combine_chunks()
            held, n = [], 0
        if t is not None:
            held, n = [*held, t], n + len(t)


def _best_in_task(path: str, sets: list[np.ndarray], weight: np.ndarray, often: np.ndarray, avgdl: float | None, k: int, parts: int):
    """mapInPandas function over numbers of tasks: the k best rows of a part of held_terms for every query of a block.

    sets: terms of queries, sorted so that neighbours begin alike; weight: what a term gives (idf or 1); often: the terms that
    many rows hold, which are summed over all rows, the others only where they are; avgdl None counts terms instead of weighing
    them. Whole numbers of few bits, weights rounded up, pick what can be among the best; what is picked is scored in 64 bits.
    """
    block, cells = QUERY_BLOCK, CELLS  # as they are on the driver

    def search(number: int) -> Iterator[pd.DataFrame]:
        first, part = number // parts * block, number % parts
        own = sets[first : first + block]
        used = np.unique(np.concatenate(own))
        place = np.full(len(weight), -1)
        place[used] = np.arange(len(used))
        w, wide = weight[used], often[used]
        column = np.cumsum(wide) - 1  # of a term summed over all rows
        asked = [place[q] for q in own]
        size = np.array([len(q) for q in asked])
        start, flat = np.cumsum(size) - size, np.concatenate(asked)
        few = [q[~wide[q]].tolist() for q in asked]
        asked = [column[q[wide[q]]].tolist() for q in asked]
        alike = [0] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(asked, asked[1:])]
        most = np.bincount(np.repeat(np.arange(len(own)), size), w[flat]) * (K1 + 1 if avgdl is not None else 1)
        small = size.max() < (4096 if avgdl is not None else 256)
        kind = np.uint32 if not small else np.uint16 if avgdl is not None else np.uint8
        scale = 60000 / most.max() if avgdl is not None else 1
        step = int(max(64, min(SLICE * (2 if avgdl is not None else 4), cells // max(1, wide.sum()))))
        m = np.zeros((wide.sum(), step), kind)
        sums = np.zeros((max(map(len, asked)) + 2, step), kind)  # by how many terms are summed up; the last with the others too
        best, bonus = Best(len(own), k), 1e6 if avgdl is not None else 0.5  # body decides first or breaks ties
        at, names = arrow_files(path)
        for body in (True, False):
            for t in _tables(at, [n for n in names if f"/body={str(body).lower()}/" in n][part::parts], 8 * SLICE):
                row_ids, length = t["id"].to_numpy(), t["length"].to_numpy().astype(float)
                (edge, ts), (_, tfs) = _whole(t["ts"]), _whole(t["tfs"])
                for a in range(0, len(row_ids), step):
                    z = min(len(row_ids), a + step)
                    low = best.least - bonus * body  # score that a row must reach
                    if (low > most + 1).all():
                        continue
                    inside = slice(edge[a], edge[z])
                    row, col, tf = np.repeat(np.arange(z - a), np.diff(edge[a : z + 1])), place[ts[inside]], tfs[inside].astype(float)
                    hit = col >= 0
                    row, col, tf = row[hit], col[hit], tf[hit]
                    value = w[col] * (1 if avgdl is None else tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[a:z][row] / avgdl)))
                    number = np.ceil(value * scale).astype(kind)
                    dense = wide[col]
                    m[column[col[dense]], row[dense]] = number[dense]
                    by = np.flatnonzero(~dense)
                    by = by[np.argsort(col[by], kind="stable")]
                    few_rows, few_numbers = row[by], number[by]
                    few_edge = np.searchsorted(col[by], np.arange(len(used) + 1)).tolist()
                    rows, upto = list(m[:, : z - a]), list(sums[:, : z - a])
                    # a sum of numbers is at least the score by scale, and less than one a term above it
                    need = (np.maximum(1, np.ceil(low)) - 1 if avgdl is None else np.maximum(0, np.ceil((low - 1e-6) * scale) - 1)).tolist()
                    skip, open_ = (low > most + 1).tolist(), np.isneginf(low).tolist()
                    found, common = [], 0
                    for e, q in enumerate(asked):
                        common = min(common, alike[e])
                        if skip[e]:
                            continue
                        for i in range(common, len(q)):
                            np.add(upto[i], rows[q[i]], out=upto[i + 1])
                        common = len(q)
                        total = upto[len(q)]
                        others = [(few_edge[i], few_edge[i + 1]) for i in few[e] if few_edge[i] < few_edge[i + 1]]
                        if others:
                            upto[-1][:] = total
                            total = upto[-1]
                            for x, y in others:
                                total[few_rows[x:y]] += few_numbers[x:y]
                        high = int(total.max())
                        if high <= need[e]:
                            continue
                        if avgdl is None:  # from the highest count down, to where k rows have it
                            while high > need[e] + 1 and np.count_nonzero(total >= high) < k:
                                high -= 1
                            c = np.flatnonzero(total >= high)
                            if len(c) > k:
                                more = total[c] > high
                                c = np.concatenate([c[more], c[~more][: k - np.count_nonzero(more)]])  # rows lie by id
                        else:
                            least = need[e] + 1
                            if open_[e] and len(total) > k:
                                least = max(least, int(np.partition(total, len(total) - k)[len(total) - k]) - int(size[e]) - 2)
                            c = np.flatnonzero(total >= least)
                            if len(c) > 4 * k:
                                v = total[c]
                                c = c[v >= int(np.partition(v, len(c) - k)[len(c) - k]) - int(size[e]) - 2]
                        found.append((e, c))
                    if found:
                        pe, pc = np.repeat([e for e, _ in found], [len(c) for _, c in found]), np.concatenate([c for _, c in found])
                        n = size[pe]
                        pair = np.repeat(np.arange(len(pe)), n)
                        term = flat[np.arange(len(pair)) + np.repeat(start[pe] - (np.cumsum(n) - n), n)]
                        held, wanted = row * len(used) + col, pc[pair] * len(used) + term
                        where = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
                        score = np.round(np.bincount(pair, np.where(held[where] == wanted, value[where], 0.0), len(pe)), 6)
                        keep = (score > 0) & (score + bonus * body >= best.least[pe])
                        pe, pc, score = pe[keep], pc[keep], score[keep]
                        best.add(pe, score + bonus * body, row_ids[a:z][pc], score)
                    m[column[col[dense]], row[dense]] = 0
        out = [(first + e, i, -key - s > bonus / 2, s) for e, rows in enumerate(best.rows) for key, i, s in rows]
        if out:
            yield pd.DataFrame(out, columns=["at", "id", "body", "score"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number in b["id"]:
                yield from search(int(number))

    return run


@dataclass(frozen=True)
class Held:
    """A batch of queries, QUERY_SCAN at a time, with what the chunks hold of their terms; several retrievers can share it."""

    kind: str  # type of query ids
    scans: list[tuple[list, list[np.ndarray]]]  # ids, numbers of the terms of each
    path: str  # of held_terms
    n: int  # chunks
    avgdl: float
    df: np.ndarray  # chunks that hold each term


def asked_terms(queries: DataFrame) -> tuple[str, list[str], list]:
    """(kind, words, scans) of a batch: the type of its ids, the distinct terms, and queries as in Held."""
    asked = cut(queries.select("query_id", F.array_distinct(T.search_terms(F.col("text"))).alias("terms")).where("size(terms) > 0"))
    words = sorted(r["w"] for r in asked.select(F.explode("terms").alias("w")).distinct().collect())  # the words of the queries
    number = {w: i for i, w in enumerate(words)}
    scans = max(1, -(-asked.count() // QUERY_SCAN))
    out = []
    for x in range(scans):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(scans)) == x).orderBy("query_id").collect()  # about QUERY_SCAN short rows
        if part:
            out.append(([r["query_id"] for r in part], [np.array([number[w] for w in r["terms"]]) for r in part]))
    return asked.schema["query_id"].dataType.simpleString(), words, out


def statistics(rows: DataFrame, words: int) -> dict[str, tuple[int, float, np.ndarray]]:
    """Of rows (name, length, ts) for every name: (rows, mean length, rows that hold each word)."""
    out = {r["name"]: (r["n"], r["mean"], np.zeros(words)) for r in rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).collect()}
    for name, t, c in rows.select("name", F.explode("ts").alias("t")).groupBy("name", "t").agg(F.count(F.lit(1)).alias("df")).collect():  # one row a word of the queries
        out[name][2][t] = c
    return out


def held(queries: DataFrame, chunks: DataFrame) -> Held:
    kind, words, scans = asked_terms(queries)
    path = held_terms(chunks, words)
    rows = chunks.sparkSession.read.schema("id string, length int, ts array<int>, tfs array<int>").parquet(path)
    n, mean, df = statistics(rows.withColumn("name", F.lit("")), len(words)).get("", (0, 1.0, np.zeros(len(words))))
    return Held(kind, scans, path, n, float(mean), df)


def _term_batches(batch: Held, spark, k: int, weigh: bool) -> DataFrame:
    """(query_id, id, rank, score): the k best of every query."""
    import pyarrow as pa

    out = spark.createDataFrame([], f"query_id {batch.kind}, id string, rank int, score double")
    weight = np.log1p((batch.n - batch.df + 0.5) / (batch.df + 0.5)) if weigh else np.ones(len(batch.df))
    order_by = [F.desc("body"), F.desc("score"), F.col("id")] if weigh else [F.desc("score"), F.desc("body"), F.col("id")]
    for ids, terms in batch.scans:
        often = np.bincount(np.concatenate(terms), minlength=len(weight))
        alike: dict[tuple, list] = {}  # queries that ask for the same of what is held; frequent terms first, so that sums are shared
        for i, t in zip(ids, terms):
            t = t[batch.df[t] > 0]
            if len(t):
                alike.setdefault(tuple(sorted(zip((-often[t]).tolist(), t.tolist()))), []).append(i)
        if alike:
            order = sorted(alike)
            blocks = -(-len(order) // QUERY_BLOCK)
            parts = _shares(blocks, spark)
            f = _best_in_task(batch.path, [np.array([t for _, t in x]) for x in order], weight, batch.df > batch.n / 100, batch.avgdl if weigh else None, k, parts)
            found = spark.range(0, blocks * parts, 1, blocks * parts).mapInPandas(f, "at int, id string, body boolean, score double")
            # ranked once for queries that ask for the same, then given to each of them
            of = pa.table({"at": pa.array(np.repeat(np.arange(len(order), dtype=np.int32), [len(alike[x]) for x in order])), "query_id": pa.array([i for x in order for i in alike[x]])})
            of = spark.createDataFrame(of).select("at", F.col("query_id").cast(batch.kind).alias("query_id"))
            part = top(found, k, *order_by, by="at").join(F.broadcast(of), "at")  # at most about QUERY_SCAN short rows
            out = out.unionByName(part.select("query_id", "id", "rank", "score"))
    return out


def keyword(queries: DataFrame, chunks: DataFrame, k: int = 5, batch: Held | None = None) -> DataFrame:
    """Number of query terms a chunk has; ties: body before others, then id."""
    check_arguments(None, k)
    return _term_batches(batch or held(queries, chunks), chunks.sparkSession, k, False)


def bm25_parts(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings(id, kind, length, term, tf), lengths(n, avgdl)) of the active chunks; a chunk without terms has length 1."""
    rows = active_once(chunks).select("id", "kind", T.tokens(F.coalesce("text", F.lit(""))).alias("ts")).select("id", "kind", "ts", F.greatest(F.lit(1), F.size("ts")).alias("length"))
    postings = rows.select("id", "kind", "length", F.explode("ts").alias("term")).groupBy("id", "kind", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    return postings, rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avgdl"))


def bm25(queries: DataFrame, chunks: DataFrame, k: int = 5, batch: Held | None = None) -> DataFrame:
    """Body chunks precede others whatever their score; then score (rounded to 6), then id."""
    check_arguments(None, k)
    return _term_batches(batch or held(queries, chunks), chunks.sparkSession, k, True)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _nearest_in_task(path: str, ids: list, q: np.ndarray, k: int, parts: int):
    """mapInPandas function over numbers of tasks: the k best of a part of the written vectors for every query of a block.

    Products in 32 bits pick what can be among the best so far, with room for their error; what is picked is scored in 64 bits.
    """
    block, few = QUERY_BLOCK, 256  # few: queries of a matrix product, so that it stays in the cache

    def search(number: int) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        first, part = number // parts * block, number % parts
        own = q[first : first + block]
        wide = np.abs(own).max(initial=0)
        lists: dict[str, Best] = {}  # by how often an id came before: a list holds an id once
        at, names = arrow_files(path)
        for name in names[part::parts]:
            best = lists.setdefault(re.search(r"/nth=(\d+)/", name)[1], Best(len(own), k))
            t = pq.ParquetFile(at.open_input_file(name)).read(columns=["id", "embedding"])
            row_ids = t["id"].to_numpy()
            edge, values = _whole(t["embedding"])
            fit = np.flatnonzero(np.diff(edge) == own.shape[1])
            for a in range(0, len(fit), SLICE):
                here = fit[a : a + SLICE]
                x = values[edge[here][:, None] + np.arange(own.shape[1])].astype(float)
                real = ~np.isnan(x).any(axis=1)
                here, x = here[real], x[real]
                kind = np.float32 if wide * np.abs(x).max(initial=0) * own.shape[1] < 1e30 else np.float64
                small, narrow = x.T.astype(kind), own.astype(kind)
                room = 1e-6 + 2.0**-21 * (own.shape[1] + 2) * np.linalg.norm(own, axis=1) * np.linalg.norm(x, axis=1).max(initial=0)
                for low in range(0, len(own), few):
                    score = narrow[low : low + few] @ small
                    need = best.least[low : low + few] - room[low : low + few]
                    if len(here) > k and np.isneginf(need).any():
                        last = np.partition(score, len(here) - k, axis=1)[:, len(here) - k]
                        need = np.where(np.isneginf(need), last - 2 * room[low : low + few], need)
                    j, c = np.divmod(np.flatnonzero(score >= need[:, None].astype(kind)), max(1, len(here)))
                    j += low
                    exact = np.round(np.einsum("ij,ij->i", own[j], x[c]), 6)
                    keep = exact >= best.least[j]
                    j, c, exact = j[keep], c[keep], exact[keep]
                    order = np.lexsort((c, -exact, j))  # rows of a file lie by id
                    j, c, exact = j[order], c[order], exact[order]
                    keep = np.arange(len(j)) - np.searchsorted(j, j) < k
                    best.add(j[keep], exact[keep], row_ids[here[c[keep]]], exact[keep])
        out = [(ids[first + e], i, s) for best in lists.values() for e, rows in enumerate(best.rows) for _, i, s in rows]
        if out:
            yield pd.DataFrame(out, columns=["query_id", "id", "score"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number in b["id"]:
                yield from search(int(number))

    return run


def vector(queries: DataFrame, vectors: DataFrame, k: int = 5, live: DataFrame | None = None) -> DataFrame:
    """queries(query_id, embedding) against vectors(id, embedding) by dot product, exact, no floor; ties by id.

    The vectors are written once; a task holds QUERY_BLOCK queries and runs over all of them, or over a part where the blocks
    are few. Rows without an embedding or of another length are left out, repeated ids count once (with their best score).
    """
    check_arguments(None, k)
    spark = vectors.sparkSession
    rows = vectors.where("embedding is not null and id is not null").select("id", "embedding")
    if live is not None:
        rows = rows.join(live.where("active").select("id").distinct(), "id", "left_semi")
    asked = cut(queries.where("embedding is not null").select("query_id", "embedding"))
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
    each = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").groupBy("id").agg(F.collect_list("embedding").alias("es")).select("id", F.posexplode("es").alias("nth", "embedding"))
    path = written_at(each.sortWithinPartitions("nth", "id"), "nth")
    scans = max(1, -(-asked.count() // QUERY_SCAN))
    out = spark.createDataFrame([], schema)
    for n in range(scans):
        scan = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(scans)) == n).orderBy("query_id").collect()  # about QUERY_SCAN rows
        dims = max((len(r["embedding"]) for r in scan), default=0)
        kept = [r for r in scan if len(r["embedding"]) == dims]
        if kept:
            blocks = -(-len(kept) // QUERY_BLOCK)
            parts = _shares(blocks, spark)
            f = _nearest_in_task(path, [r["query_id"] for r in kept], np.array([r["embedding"] for r in kept], np.float64), k, parts)
            out = out.unionByName(spark.range(0, blocks * parts, 1, blocks * parts).mapInPandas(f, schema))
    once = out.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return top(once, k, F.desc("score"), "id").select("query_id", "id", "rank", "score")


def pooled(windows: DataFrame) -> DataFrame:
    """windows(id, embedding): unit mean of the windows' vectors: (id, embedding)."""
    d = windows.select("id", F.posexplode("embedding").alias("at", "x")).groupBy("id", "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    v = d.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda z: z["m"]).alias("v"))
    norm = F.greatest(F.sqrt(dot(F.col("v"), F.col("v"))), F.lit(1e-12))
    return v.select("id", F.transform("v", lambda x: x / norm).alias("embedding"))


def rrf(ranked: list[tuple[str, DataFrame, float]], k: int = 5, pool: int | None = None) -> DataFrame:
    """(query_id, id, rank, score, contributions): reciprocal rank fusion of (name, ranked, weight) lists, each read to `pool` (max(k, 10) by default)."""
    check_arguments(None, k)
    depth = pool or max(k, 10)
    rows = None
    for name, r, weight in ranked:
        part = r.where(F.col("rank") <= depth).select("query_id", "id", F.lit(name).alias("name"), "rank", F.lit(float(weight)).alias("weight"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") / (RRF_K + F.col("rank"))), 9).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "rank")))).alias("contributions"))
    return top(fused, k, F.desc("score"), "id").select("query_id", "id", "rank", "score", "contributions")


def inactive_candidates(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates that are no active chunk; must be empty before fusion."""
    return ranked.join(chunks.where("active").select("id").distinct(), "id", "left_anti")


def fused(ranked: list[tuple[str, DataFrame, float]], chunks: DataFrame, k: int = 5, pool: int | None = None) -> DataFrame:
    """rrf, refusing lists with a candidate that is no active chunk: a retired one means that an index is stale."""
    kept = [(name, cut(r), weight) for name, r, weight in ranked]
    for name, r, _ in kept:
        bad = inactive_candidates(r.select("id").distinct(), chunks).head(1)
        if bad:
            raise ValueError(f"{name} returned a chunk that is not active: {bad[0]['id']}")
    return rrf(kept, k, pool)


def excluding(retrieve, queries: DataFrame, chunks: DataFrame, excluded: DataFrame, k: int = 5) -> DataFrame:
    """Oversample, drop chunks of excluded documents(doc_id), cut to k in the retriever's own order; may return fewer than k."""
    gone = cut(excluded.select("doc_id").distinct())
    n = gone.count()
    wide = cut(retrieve(queries, chunks, min(MOST, k + n + 3)))
    of = chunks.where("active").select("id", "doc_id").join(F.broadcast(wide.select("id").distinct()) if wide.count() <= 100_000 else wide.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    kept = wide.join(of, "id").join(F.broadcast(gone) if n <= 100_000 else gone, "doc_id", "left_anti")
    return top(kept.withColumnRenamed("rank", "was"), k, F.col("was")).select("query_id", "id", "rank", "score")


def rank_of(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, id, rank): where each of wanted(query_id, id) stands in the list, null where it does not."""
    return wanted.select("query_id", "id").distinct().join(ranked.select("query_id", "id", "rank"), ["query_id", "id"], "left")


def supplied(evidence: DataFrame, k: int = 5) -> DataFrame:
    """A retriever's answer from given evidence(query_id, id, at): the first k in the order `at`, all with score 1."""
    check_arguments(None, k)
    return top(evidence, k, F.col("at"), F.col("id")).select("query_id", "id", "rank", F.lit(1.0).alias("score"))


def term_mismatch(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, han_terms, other_terms, alias_hit, candidates, zero): what of a query can match at all."""
    han = lambda t: t.rlike("^[一-鿿]+$")
    ts = T.search_terms(F.col("text"))
    alias = F.expr(" or ".join(f"contains(text, '{a}')" for a, _ in T.ALIASES))
    n = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))
    rows = queries.select("query_id", F.size(F.filter(ts, han)).alias("han_terms"), F.size(F.filter(ts, lambda t: ~han(t))).alias("other_terms"), alias.alias("alias_hit"))
    return rows.join(n, "query_id", "left").select("query_id", "han_terms", "other_terms", "alias_hit", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.col("candidates").isNull().alias("zero"))
