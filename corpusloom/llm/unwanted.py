"""Abusive, hateful or sexual language: non-negative positive-unlabelled learning on sentences, scores for documents.

Raters confirm documents, language is abusive in a sentence. A sentence is described by its words, by the letter
sequences in them and by pairs of neighbours, after disguises are undone (signs for letters, stretched or spaced-out
letters). Of these the features count that confirmed documents hold LIFT times as often as they occur in all documents. A sentence becomes the set of its features (a pattern); sentences without any share one empty
pattern, so the whole collection shrinks, without loss for the classifier, to a table of patterns and their counts.

Confirmed documents are bags: each gives the sentences that the classifier, fitted on the other folds, takes for abusive
(witnesses; at first the one with the most evidence), in ROUNDS rounds, and a confirmed document without any drops out, as
raters err. Between rounds a linear classifier in numpy is fitted by the class-prior-corrected risk (see descend); the
prior is estimated in each round from the tails of all documents' and the witnesses' scores. The mean of
the folds' classifiers scores the documents by their highest sentence; the boundary lies where, at the base rate that the
prior states, a sentence is as likely abusive as not by the scores that held-out confirmed documents reach.

Fitting uses at most about POSITIVE confirmed and NEGATIVE cleared documents; the unlabelled side of the risk is all
documents. Up to LOCAL distinct patterns the sums of a step are taken on the driver, beyond that as partial sums of tasks.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusloom.session import cut

from .repeated_lines import source_key

POSITIVE, NEGATIVE = 4000, 8000  # labelled documents used for fitting, about, at most
LIFT, LEAST = 3.0, 2  # a feature is as many times as frequent in confirmed documents, and in so many of them
CLEARED = 0.2  # share of the negative risk that cleared documents give
DECAY = 1e-3  # of weights, as a share of the prior
ROUNDS, FOLDS, STEPS = 2, 3, 150
GROUP = 4  # confirmed documents in a stretch of scores, at least
LOCAL = 300_000  # distinct patterns the driver holds at most
BITS = 20

# Signs that stand for letters in disguised words
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e", "|": "i"})

_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060\ufeff]")
_SPACED = re.compile(r"(?<![^\W_])[^\W_]([ .·\-_*~])[^\W_](?:\1[^\W_])+(?![^\W_]|[.·\-_*~][^\W_](?![^\W_]))")
_MAYBE_SPACED = re.compile(r"([ .·\-_*~])[^\W_]\1[^\W_](?![^\W_])")  # cheaper, and true of every text with a match
_TOKEN = re.compile(r"[a-zäöüßñáéíóú]+(?![@$!#*|€\w])|[\n。！？]|[.!?]+(?=\s|$)|[一-鿿]|[@$]?[^\W_一-鿿]+(?:[@$!#*|€]+[^\W_一-鿿]+)*")
_RUN = re.compile(r"(.)\1{2,}")
_DOUBLE = re.compile(r"(.)\1+")
_BREAKS = frozenset("\n.!?。！？")

def _word_of(raw: str) -> str:
    """A token with its disguise undone: signs for letters, stretched letters; a number becomes 0, the end of a sentence the empty word."""
    if raw[0] in _BREAKS:
        return ""
    w = raw
    if not w.isalpha():
        w = "0" if w.isdigit() else w.translate(SIGNS)
    return _RUN.sub(r"\1", w) if len(w) > 2 else w


def _raw(text: str) -> list[str]:
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    if _MAYBE_SPACED.search(text):
        text = _SPACED.sub(lambda m: m[0].replace(m[1], ""), text)
    return _TOKEN.findall(text.lower())


def words_of(text: str) -> list[str]:
    """The words of a text; the empty word ends a sentence. Han characters are words of their own."""
    return [_word_of(r) for r in _raw(text)]


def sentences(text: str) -> list[list[str]]:
    """The words of every sentence that has any."""
    out, now = [], []
    for w in words_of(text):
        if w:
            now.append(w)
        elif now:
            out.append(now)
            now = []
    return [*out, now] if now else out


def _hash(s: str) -> int:
    h = zlib.crc32(s.encode())
    return (h ^ (h >> 13)) & ((1 << BITS) - 1)


def _pair_hash(a, b):
    """Of two word hashes, numbers or arrays."""
    h = a * 1000003 + b * 7919
    return (h ^ (h >> 13)) & ((1 << BITS) - 1)


def word_features(word: str) -> list[int]:
    """Of the word itself, of its letter sequences, and of it with signs as gaps."""
    bare = _DOUBLE.sub(r"\1", word)
    marked = f"<{bare}>"
    grams = {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)} if len(bare) > 2 and "一" > bare[0] else set()
    return [_hash("w" + word), *(_hash("g" + g) for g in grams if "#" not in g and "*" not in g)]


class _Codes(dict):
    """Codes of raw tokens; an unknown one is learnt."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, raw: str) -> int:
        n = self[raw] = self.learn(raw)
        return n


class Reader:
    """Reads texts as word codes, vectorised: code 0 ends a sentence; the features of a word are computed once."""

    def __init__(self, index: np.ndarray | None = None):
        #: of every feature: its number among the chosen ones or -1; None keeps all
        self.index = index
        self._forget()

    def _forget(self) -> None:
        self.code = _Codes(self._learn)
        self.hash, self.features = [0], [np.zeros(0, np.int64)]

    def _learn(self, raw: str) -> int:
        w = _word_of(raw)
        n = 0
        if w:
            n = len(self.hash)
            self.hash.append(_hash("w" + w))
            f = np.unique(np.array(word_features(w), np.int64))
            if self.index is not None:
                f = self.index[f]
                f = f[f >= 0]
            self.features.append(f)
        return n

    def read(self, texts: list[str | None]):
        """(codes, sentence of every code, document of every sentence, position and hash of every pair of neighbours); a code 0 ends each text."""
        if len(self.code) > 500_000:
            self._forget()
        flat, sizes = [], []
        for t in texts:
            before = len(flat)
            if t:
                flat.extend(map(self.code.__getitem__, _raw(t)))
            flat.append(0)
            sizes.append(len(flat) - before)
        c = np.array(flat, np.int64)
        sentence = np.cumsum(c == 0) - (c == 0)
        document = np.repeat(np.arange(len(texts)), sizes)[c == 0]
        h = np.array(self.hash, np.int64)[c]
        second = np.flatnonzero((c[1:] > 0) & (c[:-1] > 0)) + 1 if len(c) else np.zeros(0, np.int64)
        return c, sentence, document, second, _pair_hash(h[second - 1], h[second])

    def counts(self, texts: list[str | None], groups: np.ndarray) -> np.ndarray:
        """[2, features]: occurrences in all texts, and in how many texts of group 1, by distinct word or pair."""
        c, sentence, document, second, pair = self.read(texts)
        out = np.zeros((2, 1 << BITS))
        words, own = self.spread(np.bincount(c[c > 0], minlength=len(self.hash))), groups == 1
        out[0] = words + np.bincount(pair, minlength=1 << BITS)
        if own.any():
            real = np.flatnonzero((c > 0) & own[document[sentence]])
            held = np.unique(document[sentence[real]] * len(self.hash) + c[real]) % len(self.hash)
            some = own[document[sentence[second]]]
            pairs = np.unique(document[sentence[second[some]]] * (1 << BITS) + pair[some]) % (1 << BITS)
            out[1] = self.spread(np.bincount(held, minlength=len(self.hash))) + np.bincount(pairs, minlength=1 << BITS)
        return out

    def spread(self, n: np.ndarray) -> np.ndarray:
        """Counts of features from counts of words."""
        at = np.flatnonzero(n)
        if not len(at):
            return np.zeros(1 << BITS)
        return np.bincount(np.concatenate([self.features[i] for i in at]), np.repeat(n[at], [len(self.features[i]) for i in at]), 1 << BITS)

    def patterns(self, texts: list[str | None]) -> list[list[np.ndarray]]:
        """Of every document: the distinct sets of chosen features that its sentences hold; sentences without any are left out."""
        c, sentence, document, second, pair = self.read(texts)
        held = np.array([len(f) for f in self.features])
        words = np.flatnonzero(held[c])
        hit = self.index[pair]
        pairs = np.flatnonzero(hit >= 0)
        s = np.concatenate([np.repeat(sentence[words], held[c[words]]), sentence[second[pairs]]])
        f = np.concatenate([*(self.features[i] for i in c[words]), hit[pairs]]).astype(np.int64) if len(words) + len(pairs) else np.zeros(0, np.int64)
        width = int(self.index.max(initial=0)) + 1
        key = np.unique(s * width + f)
        s, f = key // width, (key % width).astype(np.int32)
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        out: list[dict[bytes, np.ndarray]] = [{} for _ in texts]
        for a, z in zip(starts, [*starts[1:], len(s)]):
            out[document[s[a]]].setdefault(f[a:z].tobytes(), f[a:z])
        return [list(d.values()) for d in out]


class Rows:
    """Patterns as a sparse matrix: sets of feature numbers, the value of each 1 / sqrt(1 + size)."""

    def __init__(self, patterns: list, width: int):
        self.n, self.width = len(patterns), width
        sizes = np.array([len(p) for p in patterns], np.int64)
        self.feature = np.concatenate([*map(np.asarray, patterns)]).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(self.n), sizes)
        self.scale = 1 / np.sqrt(1.0 + sizes)

    def scores(self, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        """[patterns, models] for weights [features, models]."""
        return np.stack([np.bincount(self.row, w[self.feature, k], self.n) * self.scale + b[k] for k in range(w.shape[1])], 1)

    def transposed(self, g: np.ndarray) -> np.ndarray:
        """[features, models] of [patterns, models]."""
        g = g * self.scale[:, None]
        return np.stack([np.bincount(self.feature, g[self.row, k], self.width) for k in range(g.shape[1])], 1)


def _soft(s: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, s)


def _sig(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def negative_sums(rows: Rows, counts: np.ndarray, w: np.ndarray, b: np.ndarray):
    """Summed loss as negatives, [kinds of count, models], and its gradients by weights and bias; sums over parts of the rows add up."""
    s = rows.scores(w, b)
    soft, sig = _soft(s), _sig(s)
    return counts.T @ soft, np.stack([rows.transposed(n[:, None] * sig) for n in counts.T]), counts.T @ sig


class Corpus:
    """The patterns of all documents with how often they occur (in all, in cleared documents), on the driver while they are few."""

    def __init__(self, table: DataFrame, width: int):
        self.table, self.width = table, width
        if table.count() <= LOCAL:
            p = table.toPandas()
            self.rows, self.counts = Rows(p["pattern"].tolist(), width), p[["everywhere", "cleared"]].to_numpy(float)
        else:
            self.rows = None

    def sums(self, w: np.ndarray, b: np.ndarray):
        if self.rows is not None:
            return negative_sums(self.rows, self.counts, w, b)
        shape = (2, self.width + 2, w.shape[1])

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(shape)
            for x in batches:
                loss, by_w, by_b = negative_sums(Rows(x["pattern"].tolist(), shape[1] - 2), x[["everywhere", "cleared"]].to_numpy(float), w, b)
                total += np.concatenate([by_w, by_b[:, None], loss[:, None]], 1)
            at = np.flatnonzero(total)
            yield pd.DataFrame({"at": at, "x": total.ravel()[at]})

        got = self.table.mapInPandas(part, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
        total = np.zeros(shape).ravel()
        total[got["at"].to_numpy()] = got["x"].to_numpy()
        total = total.reshape(shape)
        return total[:, -1], total[:, :-2], total[:, -2]

    def tail(self, w: np.ndarray, b: float, edges: np.ndarray) -> np.ndarray:
        """How many occurrences score at least each edge."""

        def local(rows: Rows, n: np.ndarray) -> np.ndarray:
            s = rows.scores(w[:, None], np.array([b]))[:, 0]
            order = np.argsort(s)
            above = np.r_[np.cumsum(n[order][::-1])[::-1], 0]
            return above[np.searchsorted(s[order], edges)]

        if self.rows is not None:
            return local(self.rows, self.counts[:, 0])
        width = self.width

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = sum((local(Rows(x["pattern"].tolist(), width), x["everywhere"].to_numpy(float)) for x in batches), np.zeros(len(edges)))
            yield pd.DataFrame({"at": np.arange(len(edges)), "x": total})

        got = self.table.mapInPandas(part, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas().sort_values("at")
        return got["x"].to_numpy()


def stretches(best: np.ndarray, tail_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges, confirmed, everywhere) from the top: stretches of at least GROUP of the confirmed documents' best scores, and how much of the corpus lies in each."""
    ordered = np.sort(best)[::-1]
    size = max(GROUP, len(best) // 40)
    edges = np.unique(ordered[np.minimum(np.arange(size - 1, len(best) + size - 1, size), len(best) - 1)])[::-1]
    own = np.array([(best >= e).sum() for e in edges], float)
    return edges, np.diff(np.r_[0, own]), np.maximum(np.diff(np.r_[0, tail_of(edges)]), 0.5)


def lowest(edges: np.ndarray, gain: np.ndarray, loss: np.ndarray) -> float | None:
    """The edge down to which, from the top, the stretches gain most over what they lose; a stretch that falls short is made up for by better ones below. None if there is nothing to gain."""
    sums = np.cumsum(gain - loss)
    return float(edges[int(np.argmax(sums))]) if sums.max(initial=0) > 0 else None


def mixture_prior(witness: np.ndarray, edges: np.ndarray, tail: np.ndarray, total: float) -> float:
    """Share of positives in a mixture: the least ratio of its tail to the witnesses' tail, over the edges that keep half of the witnesses."""
    own = np.array([(witness >= e).mean() for e in edges])
    some = own >= 0.5
    return float(np.clip((tail[some] / total / own[some]).min(), 1 / total, 0.5)) if some.any() else 1 / total


def descend(corpus: Corpus, p: Rows, weights: np.ndarray, prior: float, total: float, cleared: float, steps: int = STEPS):
    """Weights [features, models] and biases of the non-negative risk, by Adam; weights [witnesses, models] say whose witness is whose.

        prior * R+(witnesses) + (1 - CLEARED) * max(0, R-(all) - prior * R-(witnesses)) + CLEARED * (1 - prior) * R-(cleared)

    While the corrected part is negative it has no gradient. All documents take part, their pattern-less sentences as one row.
    """
    k = weights.shape[1]
    share = prior * weights / np.maximum(1e-9, weights.sum(0))
    w, b = np.zeros((p.width, k)), np.full(k, np.log(prior / (1 - prior)))
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    gamma = CLEARED if cleared else 0.0
    for step in range(1, steps + 1):
        loss, by_w, by_b = corpus.sums(w, b)
        s = p.scores(w, b)
        sig = _sig(s)
        corrected = loss[0] / total - (share * _soft(s)).sum(0)
        free = (1 - gamma) * (corrected > 0)
        on_p = share * (sig - 1) - free * share * sig
        c = gamma * (1 - prior) / max(1.0, cleared)
        grads = (p.transposed(on_p) + free * by_w[0] / total + c * by_w[1] + prior * DECAY * w, on_p.sum(0) + free * by_b[0] / total + c * by_b[1])
        for i, (x, y) in enumerate(zip((w, b), grads)):
            m[i] = 0.9 * m[i] + 0.1 * y
            v[i] = 0.99 * v[i] + 0.01 * y * y
            x -= 0.2 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + prior * 1e-4)
    return w, b


def fit(bags: list[list], corpus: Corpus, width: int, docs: float, total: float, cleared: float, evidence: np.ndarray) -> tuple[np.ndarray, float, float] | None:
    """(weights, bias, prior), the boundary at 0, from the patterns of every confirmed document and of the corpus; None without a pattern.

    evidence: log lift of every feature, for the first choice of witnesses.
    """
    flat = [(i, x) for i, bag in enumerate(bags) for x in bag]
    if not flat:
        return None
    bag = np.array([i for i, _ in flat])
    p = Rows([x for _, x in flat], width)
    score = p.scores(evidence[:, None], np.zeros(1))[:, 0]
    fold = bag % FOLDS
    tail_of = lambda edges: corpus.tail(evidence, 0.0, edges)
    for round_ in range(ROUNDS + 1):
        best = _best_of_bags(bag, score)
        edges, own, everywhere = stretches(np.r_[score[best], np.full(len(bags) - best.sum(), -1e9)], tail_of)
        # confirmed documents stand out: a stretch holds LIFT times the share of them that it holds of all documents
        edge = lowest(edges, own / len(bags), LIFT * everywhere / docs)
        if edge is None:
            # held-out documents do not stand out, as with few labels: the witnesses of the round before and the risk's own boundary stay
            if round_:
                return w, b, prior
            edge = -np.inf
        witness = best if edge == -np.inf else score >= edge
        prior = mixture_prior(score[witness & best], edges, np.cumsum(everywhere), total)
        if round_ == ROUNDS:
            break
        # every document is judged by a model that has not seen it, so that a wrong label cannot vouch for itself
        weights = np.stack([(witness & (fold != k)).astype(float) for k in range(FOLDS)], 1)
        w, b = descend(corpus, p, weights, prior, total, cleared)
        score = p.scores(w, b)[np.arange(len(bag)), fold]
        w, b = w.mean(1), float(b.mean())
        tail_of = lambda edges, w=w, b=b: corpus.tail(w, b, edges)
    # the boundary at the base rate: down to where half of what lies in a stretch is accounted for by positives
    expected = prior * total * own / max(1, (witness & best).sum())
    boundary = lowest(edges, expected, 0.5 * everywhere)
    return w, b if boundary is None else b - boundary + 1e-6, prior


def _best_of_bags(bag: np.ndarray, score: np.ndarray) -> np.ndarray:
    order = np.lexsort((-score, bag))
    best = np.zeros(len(bag), bool)
    best[order[np.r_[True, bag[order][1:] != bag[order][:-1]]]] = True
    return best


def confirmed(labels: DataFrame) -> DataFrame:
    """(doc_id, bad): the raters' majority; a rater counts once a document and category, ties count as bad, null votes do not count."""
    votes = labels.where("doc_id is not null and category is not null").select("doc_id", F.coalesce("rater", F.lit("")).alias("rater"), F.lower(F.trim("category")).alias("c")).distinct()
    n = votes.groupBy("doc_id").agg(F.count_if(F.col("c") != "none").alias("b"), F.count_if(F.col("c") == "none").alias("g"))
    return n.select("doc_id", (F.col("b") >= F.col("g")).alias("bad"))


def labelled_ids(labels: DataFrame) -> dict[int, int]:
    """Group of the labelled documents that fitting uses: 1 confirmed, 2 cleared; at most twice POSITIVE and NEGATIVE, by a hash of the id."""
    marks = cut(confirmed(labels))
    bad, good = marks.agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first()
    out = {}
    for group, where, n, most in ((1, "bad", bad, POSITIVE), (2, "not bad", good, NEGATIVE)):
        kept = marks.where(where).where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(min(1_000_000, 1 + 1_000_000 * most / max(1, n))))
        out |= {int(r[0]): group for r in kept.select("doc_id").limit(2 * most).collect()}
    return out


def _groups(ids: dict[int, int], doc_ids: pd.Series) -> np.ndarray:
    return np.array([ids.get(int(i), 0) for i in doc_ids], np.int64)


def _counted(rows: DataFrame, ids: dict[int, int], only: np.ndarray | None) -> DataFrame:
    """(f, everywhere, confirmed): occurrences of features, and confirmed documents that hold them, a row a task and feature; f = -1 counts the documents."""
    keep = np.arange(1 << BITS) if only is None else np.unique(only)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, total, docs = Reader(), np.zeros((2, 1 << BITS)), np.zeros(2)
        for x in batches:
            g = _groups(ids, x["doc_id"])
            total += reader.counts(x["text"].tolist(), g)
            docs += len(g), (g == 1).sum()
        at = keep[total[0, keep] > 0]
        yield pd.DataFrame({"f": np.r_[at, -1], "everywhere": np.r_[total[0, at], docs[0]].astype(np.int64), "confirmed": np.r_[total[1, at], docs[1]].astype(np.int64)})

    return rows.mapInPandas(run, "f int, everywhere bigint, confirmed bigint")


def features(rows: DataFrame, ids: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The features that confirmed documents hold LIFT times as often as they occur in all documents, with their log lift; counted over all documents."""
    sums = lambda df: df.groupBy("f").agg(F.sum("everywhere").alias("everywhere"), F.sum("confirmed").alias("confirmed"))
    chosen = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(i,) for i, g in ids.items() if g == 1], "doc_id bigint")), "doc_id")  # a bounded list
    held = sums(_counted(chosen, ids, None)).where((F.col("f") >= 0) & (F.col("confirmed") >= LEAST)).select("f").toPandas()["f"].to_numpy(np.int64)
    c = sums(_counted(rows, ids, held)).toPandas()
    docs = c[c["f"] == -1].iloc[0] if (c["f"] == -1).any() else {"everywhere": 1, "confirmed": 1}
    c = c[c["f"] >= 0]
    bad, every = c["confirmed"].to_numpy(float), c["everywhere"].to_numpy(float)
    lift = ((bad - 0.5) / max(1, docs["confirmed"])) / ((every + 0.5) / max(1, docs["everywhere"]))  # half a document less, as its own counts
    ok = (bad >= LEAST) & (lift >= LIFT)
    return c["f"].to_numpy(np.int64)[ok], np.log(lift[ok])


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score): probability-like score of every document, 0.5 at the boundary; blank or null text scores 0.

    Without a confirmed document, or where confirmed documents share no words, there is nothing to learn from and every score
    is null. Repeated rows of a document give repeated rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_key().alias("source"), "text").where("doc_id is not null")
    nothing = rows.select("doc_id", "source", F.lit(None).cast("double").alias("score"))
    ids = labelled_ids(labels)
    if 1 not in ids.values():
        return nothing
    chosen, evidence = features(rows, ids)
    if not len(chosen):
        return nothing
    index = np.full(1 << BITS, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    shared = spark.sparkContext.broadcast(index)  # 4 MB, fixed by BITS

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shared.value)
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "source": x["source"], "words": x["text"].map(lambda t: bool(t and t.strip())), "grp": _groups(ids, x["doc_id"]).astype(np.int32), "patterns": reader.patterns(x["text"].tolist())})

    found = cut(rows.mapInPandas(find, "doc_id bigint, source string, words boolean, grp int, patterns array<array<int>>"))
    n = found.groupBy("grp").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("patterns")).alias("held")).toPandas().set_index("grp")
    total = float(n.to_numpy().sum())
    cleared = float(n.loc[2].sum()) if 2 in n.index else 0.0
    flat = found.select("grp", F.explode("patterns").alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("everywhere"), F.count_if(F.col("grp") == 2).alias("cleared"))
    empty = found.agg(F.array().cast("array<int>").alias("pattern"), F.count(F.lit(1)).alias("everywhere"), F.count_if(F.col("grp") == 2).alias("cleared"))
    corpus = Corpus(cut(flat.unionByName(empty)), len(chosen))
    bags = [[np.array(x) for x in r[0]] for r in found.where("grp = 1").orderBy("doc_id").select("patterns").collect()]  # of a bounded list
    model = fit(bags, corpus, len(chosen), float(n["docs"].sum()), total, cleared, evidence)
    if model is None:
        return nothing
    w, b, _ = model

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            sizes = x["patterns"].str.len().to_numpy()
            s = Rows([p for d in x["patterns"] for p in d], len(w)).scores(w[:, None], np.array([b]))[:, 0]
            best = np.full(len(x), b)
            np.maximum.at(best, np.repeat(np.arange(len(x)), sizes), s)
            yield pd.DataFrame({"doc_id": x["doc_id"], "source": x["source"], "score": np.where(x["words"], _sig(best), 0.0)})

    return found.mapInPandas(score, "doc_id bigint, source string, score double")


def rates(scores: DataFrame) -> DataFrame:
    """(source, documents, unwanted, rate): by source; a null source is its own row."""
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("score") > 0.5).alias("unwanted")).withColumn("rate", F.col("unwanted") / F.col("documents"))
