"""Same or near-same records across splits: an exact prefix-filter join on rare shingles, evaluation side indexed.

Questions become sets of content shingles (words, numbers, runs of Han characters; the words a question is framed with
are left out, one-letter slips are mended towards the frequent words of the collection). A shingle weighs
ln(1 + N / df), so rare ones (the component's name) carry the set. Two sets are joined if their weighted Jaccard
similarity is at least THRESHOLD. With all sets in one order, heaviest first, a pair that reaches t must share a shingle
among those whose remaining weight is still at least t of the total: only these prefixes are indexed (evaluation) and
probed (training). Pairs then pass the length filter (total weights within t of each other), the position filter (what
remains from the first common shingle must suffice) and the exact overlap. An exact check of component, object, number,
condition and sense follows. Evidence goes through the same join with passages (source and quoted phrases) as shingles
and a threshold of 1: the prefix is the rarest passage.

Equal sets are joined once, as one class per side; classes are expanded to records at the end.
"""

from __future__ import annotations


import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.session import cut

THRESHOLD = 0.8
FREQUENT = 0.005  # share of classes from which a shingle counts as frequent; at most len / FREQUENT of them exist

# Words that frame a question, not what it is about
FRAME_WORDS = frozenset(
    "a an and are is was be been being it its the this that these those of on in at by to for from with into out as or than then so "
    "what which who whom whose where when why how whether while if do does did done has have had may might can could must shall should will would "
    "please tell me i like know quick question short according guide thanks thank you many much long number "
    "there possible get back put place kept keep keeps stored store stores held hold change edit role allowed "
    "handling handle treat treated need needs ask asks sign off approval name list risks risk dangers danger sharing shared share "
    "check checks verified verify pass happens happen occurs occur affected affect once raised after above level error "
    "refuse refuses reject rejects settings setting options option limit limits restrict restricts show shows display displays displayed "
    "restore restores copy day plan retention been say says about hello hi dear one".split()
)
FRAME_CHARS = "的得地在中里把被会怎样如何对待处理为什么哪些个有谁可以修改由角色负责动存放位置是受到影响报出现号错误后列共享去危险风需要做检查验证针按方案下保留多久时清除高于级超过拒绝挡原因请问想了解一根据资料简单说和与及吗呢，。"
SENSES = (
    ("place", r"\bwhere\b|\bplace\b|存放|位置"),
    ("edit", r"\bwho (?:may|can|could)\b|\brole\b|谁可以|角色"),
    ("refuse", r"\brefuses?\b|\brejects?\b|拒绝|挡下"),
    ("keep", r"\bhow long\b|\bretention\b|保留|清除"),
    ("count", r"\bhow many\b|\bnumber\b|多少"),
    ("checks", r"\bchecks?\b|\bverif|检查|验证"),
    ("restore", r"\brestore\b|\bget\b.*\bback\b|恢复"),
    ("risks", r"\brisks?\b|\bdangers?\b|风险|危险"),
    ("settings", r"\bsettings?\b|\boptions?\b"),
    ("approval", r"\bask for approval\b|\bsign off\b"),
    ("error", r"\bhappens?\b|\boccurs?\b|\baffected\b|错误|号"),
    ("treat", r"\bdo with\b|\btreat\b|处理|对待"),
)

_SENSES = tuple((n, re.compile(p)) for n, p in SENSES)
_WORD = re.compile(r"\d+|[一-鿿]+|[^\W\d_一-鿿]+")
_HAN_FRAME = re.compile("[" + FRAME_CHARS + "]+")


def plain(text: str) -> str:
    """Compatibility form, lower case, one space, without invisible format characters."""
    t = unicodedata.normalize("NFKC", text)
    t = "".join(c for c in t if unicodedata.category(c) != "Cf")
    return re.sub(r"\s+", " ", t).strip().lower()


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(plain(text)) if text else []


def within_one(a: str, b: str) -> bool:
    """One insertion, deletion, substitution or swap of neighbours apart at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:])


class Mender:
    """Maps a word that is not frequent to the one frequent word one slip away, if there is exactly one."""

    def __init__(self, frequent: list[str]):
        self.known = {w for w in frequent if w.isalpha() and w.isascii()} | FRAME_WORDS
        self.near: dict[str, set[str]] = {}
        for w in self.known:
            if len(w) >= 4:
                for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
                    self.near.setdefault(v, set()).add(w)
        self.memo: dict[str, str] = {}

    def __call__(self, w: str) -> str:
        if len(w) < 4 or w in self.known or not (w.isascii() and w.isalpha()):
            return w
        if w not in self.memo:
            found: set[str] = set()
            for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
                found |= {x for x in self.near.get(v, ()) if within_one(w, x)}
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[w] = next(iter(found)) if len(found) == 1 else w
        return self.memo[w]


def content(words: list[str]) -> list[str]:
    """The set of shingles of a question that say what it is about, sorted."""
    out = set()
    for w in words:
        if "一" <= w[0] <= "鿿":
            out.update(x for x in _HAN_FRAME.split(w) if x)
        elif w[0].isdigit():
            out.add("#" + (w.lstrip("0") or "0"))
        elif w not in FRAME_WORDS:
            out.add(w)
    return sorted(out)


def sense_of(words: list[str]) -> str:
    text = " ".join(words)
    return next((n for n, p in _SENSES if p.search(text)), "")


def _words(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in series:
        yield s.map(lambda t: words_of(t) if isinstance(t, str) else [])


def _parsed(frequent: list[str]):
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        mend = Mender(frequent)
        for s in series:
            mended = s.map(lambda ws: [mend(w) for w in ws])
            yield pd.DataFrame({"shingles": mended.map(content), "sense": mended.map(sense_of)})

    return run


def question_classes(cases: DataFrame) -> DataFrame:
    """(case, held, shingles, sense): questions as shingle sets. Null, blank or framing-only questions drop out."""
    words = F.pandas_udf(_words, "array<string>")
    w = cut(cases.where("question is not null").select("case", "held", words("question").alias("words")))
    n = max(1, w.count())
    frequent = [r[0] for r in w.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").count().where(F.col("count") >= max(5, FREQUENT * n)).select("w").collect()]  # at most len / FREQUENT words
    parsed = F.pandas_udf(_parsed(frequent), "shingles array<string>, sense string")
    return w.select("case", "held", parsed("words").alias("p")).select("case", "held", "p.*").where("size(shingles) > 0")


def weighted(classes: DataFrame) -> DataFrame:
    """(cls, held, total, row array<struct<w, s, rest>>): the shingles of every class, heaviest first, with the weight that remains from each on."""
    n = classes.count()
    flat = classes.select("cls", "held", F.explode("shingles").alias("s"))
    df = flat.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    edge = max(2, n // 1000)
    head = F.broadcast(df.where(F.col("df") >= edge))  # at most 1000 x shingles of a class
    tail = df.where(F.col("df") < edge)
    marked = flat.join(head, "s", "left")
    full = marked.where("df is not null").select("cls", "held", "s", "df").unionByName(marked.where("df is null").drop("df").join(tail, "s").select("cls", "held", "s", "df"))
    w = F.round(F.log1p(F.lit(float(n)) / F.col("df")), 9)
    row = F.reverse(F.array_sort(F.collect_list(F.struct(w.alias("w"), "s"))))
    sized = full.groupBy("cls", "held").agg(row.alias("r")).withColumn("total", F.aggregate("r", F.lit(0.0), lambda a, x: a + x["w"]))
    rest = F.transform("r", lambda x, i: F.struct(x["w"].alias("w"), x["s"].alias("s"), (F.col("total") - F.aggregate(F.slice("r", 1, i), F.lit(0.0), lambda a, y: a + y["w"])).alias("rest")))
    return sized.select("cls", "held", "total", rest.alias("row"))


def prefix_join(sets: DataFrame, t: float) -> DataFrame:
    """(a, b, similarity): classes a of training and b of evaluation with weighted Jaccard similarity of at least t."""
    eps = 1e-6
    prefix = sets.select("cls", "held", "total", F.explode(F.filter("row", lambda x: x["rest"] >= F.lit(t) * F.col("total") - eps)).alias("x")).select("cls", "held", "total", F.col("x.s").alias("s"), F.col("x.rest").alias("rest"))
    index = prefix.where("held").select(F.col("cls").alias("b"), F.col("total").alias("tb"), F.col("rest").alias("rb"), "s")
    probe = prefix.where("not held").select(F.col("cls").alias("a"), F.col("total").alias("ta"), F.col("rest").alias("ra"), "s")
    need = t / (1 + t) * (F.col("ta") + F.col("tb")) - eps
    near = (
        probe.join(index, "s")
        .where((F.col("ta") >= t * F.col("tb") - eps) & (F.col("tb") >= t * F.col("ta") - eps))  # length filter
        .where(F.least("ra", "rb") >= need)  # position filter, true of the first common shingle of every pair that reaches t
        .select("a", "b")
        .distinct()
    )
    left = sets.where("not held").select(F.col("cls").alias("a"), F.col("row").alias("row_a"), F.col("total").alias("ta"))
    right = sets.where("held").select(F.col("cls").alias("b"), F.col("row").alias("row_b"), F.col("total").alias("tb"))
    both = near.join(left, "a").join(right, "b")
    names = F.transform("row_b", lambda x: x["s"])
    common = F.aggregate(F.filter("row_a", lambda x: F.array_contains(names, x["s"])), F.lit(0.0), lambda a, x: a + x["w"])
    sim = common / (F.col("ta") + F.col("tb") - common)
    return both.select("a", "b", sim.alias("similarity"), F.transform("row_a", lambda x: x["s"]).alias("sa"), names.alias("sb")).where(F.col("similarity") >= t - eps)


def same_question(sa: Column, sb: Column, na: Column, nb: Column) -> Column:
    """The exact check: the same component, object, numbers and condition, which leaves no content shingle on one side only, and no other sense."""
    return (F.size(F.array_except(sa, sb)) == 0) & (F.size(F.array_except(sb, sa)) == 0) & ((na == nb) | (na == "") | (nb == ""))


def prepared(cases: DataFrame) -> DataFrame:
    """(case, held, question, evidence), one row a case id; rows without id or known split drop out."""
    held = F.when(F.lower(F.trim("split")) == "train", F.lit(False)).when(F.lower(F.trim("split")).isin("development", "holdout"), F.lit(True))
    return cases.select(F.col("id").alias("case"), held.alias("held"), "split", "question", "evidence").where("case is not null and held is not null").dropDuplicates(["case"])


def question_links(cases: DataFrame, t: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(links(a, b), members(case, held, cls)): classes of questions that ask the same, training to evaluation."""
    q = cut(question_classes(cases).withColumn("cls", F.xxhash64(F.array_join("shingles", "\u0001"), "sense")))
    classes = q.groupBy("cls", "held").agg(F.first("shingles").alias("shingles"), F.first("sense").alias("sense"))
    sets = cut(weighted(classes))
    near = prefix_join(sets, t)
    sense = classes.groupBy("cls").agg(F.first("sense").alias("sense"))
    links = (
        near.join(sense.select(F.col("cls").alias("a"), F.col("sense").alias("na")), "a")
        .join(sense.select(F.col("cls").alias("b"), F.col("sense").alias("nb")), "b")
        .where(same_question(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb")))
        .select("a", "b")
    )
    return links, q.select("case", "held", "cls")


def question_pairs(cases: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """(train, held): case ids whose questions ask the same."""
    return _expand(*question_links(cases, t))


def _expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    t = members.where("not held").select(F.col("cls").alias("a"), F.col("case").alias("train"))
    h = members.where("held").select(F.col("cls").alias("b"), F.col("case").alias("held_case"))
    return pairs.join(t, "a").join(h, "b").select("train", "held_case").distinct()


def passages(cases: DataFrame) -> DataFrame:
    """(case, held, ps array<struct<key, start, end>>): distinct evidence passages; key is source and the quoted phrases as a set, without case and spacing."""
    phrase = "array_sort(array_distinct(filter(transform(coalesce(e.must_include, array()), p -> lower(regexp_replace(p, '(?U)[\\\\s\\\\u200b\\\\ufeff]+', ''))), p -> p is not null)))"
    ps = f"array_sort(array_distinct(transform(filter(evidence, e -> e is not null and e.source is not null and e.start_line is not null and e.end_line is not null), e -> struct(concat_ws('\u0001', array(e.source), {phrase}) as key, e.start_line as start, e.end_line as end))))"
    return cases.where("evidence is not null").select("case", "held", F.expr(ps).alias("ps")).where("size(ps) > 0")


def evidence_links(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links(a, b), members(case, held, cls)): classes of evidence that quotes the same passages, one for one, on overlapping lines."""
    p = cut(passages(cases))
    keyed = p.withColumn("shingles", F.expr("array_sort(array_distinct(transform(ps, x -> x.key)))")).withColumn("cls", F.xxhash64(F.array_join("shingles", "\u0002"), F.size("ps")))
    classes = keyed.groupBy("cls", "held").agg(F.first("shingles").alias("shingles"))
    near = prefix_join(cut(weighted(classes)), 1.0).where((F.size(F.array_except("sa", "sb")) == 0) & (F.size(F.array_except("sb", "sa")) == 0)).select("a", "b")
    # equal sets of lines join as one class of members
    lines = keyed.select("case", "held", "cls", "ps", F.xxhash64("cls", F.to_json("ps")).alias("own"))
    kinds = lines.groupBy("own", "held").agg(F.first("cls").alias("cls"), F.first("ps").alias("ps"))
    a = kinds.where("not held").select(F.col("cls").alias("a"), F.col("own").alias("oa"), F.col("ps").alias("pa"))
    b = kinds.where("held").select(F.col("cls").alias("b"), F.col("own").alias("ob"), F.col("ps").alias("pb"))
    covered = "forall({0}, x -> exists({1}, y -> x.key = y.key and x.start <= y.end and y.start <= x.end))"
    same = near.join(a, "a").join(b, "b").where(F.expr(covered.format("pa", "pb")) & F.expr(covered.format("pb", "pa"))).select(F.col("oa").alias("a"), F.col("ob").alias("b"))
    return same, lines.select("case", "held", F.col("own").alias("cls"))


def evidence_pairs(cases: DataFrame) -> DataFrame:
    """(train, held): case ids whose evidence quotes the same passages."""
    return _expand(*evidence_links(cases))


def overlaps(cases: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """(case_a, case_b, by_question, by_evidence): pairs of a training and an evaluation case, smaller id first. Empty input: no row."""
    rows = cut(prepared(cases))
    both = question_pairs(rows, t).withColumn("by_question", F.lit(True)).join(evidence_pairs(rows).withColumn("by_evidence", F.lit(True)), ["train", "held_case"], "full")
    return both.select(
        F.least("train", "held_case").alias("case_a"), F.greatest("train", "held_case").alias("case_b"), "train", "held_case", F.coalesce("by_question", F.lit(False)).alias("by_question"), F.coalesce("by_evidence", F.lit(False)).alias("by_evidence")
    )


def overlap_report(cases: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """(split, source, pairs, held_cases, train_cases) of the overlaps by split and by evidence source of the evaluation case; source null where it has no evidence.

    Pairs are counted from classes of equal cases, never written out: a training case counts by its classes of question
    and evidence, an evaluation case by its classes, split and sources.
    """
    rows = cut(prepared(cases))
    sides = []
    for links, members in (question_links(rows, t), evidence_links(rows)):
        sides.append((cut(links.distinct()), members.select("case", "cls")))
    (by_q, q), (by_e, e) = sides
    own = rows.select("case", "held", "split", F.array_sort(F.array_distinct(F.transform("evidence", lambda x: F.regexp_extract(x["source"], r"^[a-z]+://([^/]+)", 1)))).alias("sources"))
    own = own.join(q.withColumnRenamed("cls", "q"), "case", "left").join(e.withColumnRenamed("cls", "e"), "case", "left")
    trains = cut(own.where("not held").groupBy("q", "e").agg(F.count(F.lit(1)).alias("trains")).withColumn("tc", F.xxhash64("q", "e")))
    helds = cut(own.where("held").groupBy("q", "e", "split", "sources").agg(F.count(F.lit(1)).alias("helds")).withColumn("hc", F.xxhash64("q", "e", "split", "sources")))

    def linked(links: DataFrame, key: str) -> DataFrame:
        return trains.join(links.withColumnRenamed("a", key), key).select("tc", "b").join(helds.withColumnRenamed(key, "b"), "b").select("tc", "hc")

    pairs = cut(linked(by_q, "q").unionByName(linked(by_e, "e")).distinct().join(trains.select("tc", "trains"), "tc").join(helds.select("hc", "helds", "split", "sources"), "hc"))
    flat = pairs.withColumn("source", F.explode_outer("sources"))
    cell = lambda df, x, count, name: df.select("split", "source", x, count).distinct().groupBy(F.col("split").alias(f"{name}_split"), F.col("source").alias(f"{name}_source")).agg(F.sum(count).alias(name))
    out = flat.groupBy("split", "source").agg(F.sum(F.col("trains") * F.col("helds")).alias("pairs"))
    for part, name in ((cell(flat, "hc", "helds", "held_cases"), "held_cases"), (cell(flat, "tc", "trains", "train_cases"), "train_cases")):
        out = out.join(part, F.col("split").eqNullSafe(F.col(f"{name}_split")) & F.col("source").eqNullSafe(F.col(f"{name}_source")))
    return out.select("split", "source", "pairs", "held_cases", "train_cases")
