"""One ranking per run from scores of different scale: a random walk on ranks.

From an item the walk picks one kind of score and jumps to an item ranked strictly higher by it, all alike (it stays
where none is higher); with 1 - DAMPING it jumps to any item. Only ranks enter, so no score's range counts. A step costs
one sorted prefix sum per score: an item of the kind's order gets the sum of (mass / number above) over all items below.
Items are ordered by their stationary mass, then by mean rank, then by id. Missing scores rank last, together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

DAMPING = 0.85
TOLERANCE = 1e-13
STEPS = 300
CELLS = 1 << 21  # of a padded array of scores, at most, unless one run alone has more

_SCHEMA = (
    "struct<parameters: struct<order: map<string, string>>,"
    " candidates: array<struct<id: string, scores: map<string, string>, contributions: array<struct<retriever: string, score: string>>>>,"
    " lists: map<string, array<struct<id: string, score: string>>>, _corrupt_record: string>"
)


def run_scores(runs: DataFrame) -> DataFrame:
    """(run_id, kinds, up, ids, item, kind, value): names of kinds and candidates and the scores of a run as flat arrays, from any of the three layouts.

    Repeated run ids count once. Null, cut-off or score-less JSON and runs without parameters.order give no row.
    Values that are no finite number are missing.
    """
    once = runs.select(F.col("id").alias("run_id"), "result").where("run_id is not null and result is not null").dropDuplicates(["run_id"])
    r = once.select("run_id", F.from_json("result", _SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).where("r._corrupt_record is null")
    order = F.expr("transform(map_entries(r.parameters.order), e -> struct(e.key as kind, lower(e.value) <> 'asc' as up))")
    flat = F.expr(
        "concat("
        " flatten(transform(coalesce(r.candidates, array()), c -> transform(coalesce(map_entries(c.scores), array()), e -> struct(c.id as item, e.key as kind, e.value as value)))),"
        " flatten(transform(coalesce(r.candidates, array()), c -> transform(filter(coalesce(c.contributions, array()), x -> x is not null), e -> struct(c.id as item, e.retriever as kind, e.score as value)))),"
        " flatten(transform(coalesce(map_entries(r.lists), array()), l -> transform(filter(coalesce(l.value, array()), x -> x is not null), e -> struct(e.id as item, l.key as kind, e.score as value)))))"
    )
    items = F.expr("array_distinct(filter(concat(transform(coalesce(r.candidates, array()), c -> c.id), transform(s, x -> x.item)), x -> x is not null))")
    return (
        r.select("run_id", "r", order.alias("o"), flat.alias("s"))
        .select("run_id", F.expr("transform(o, x -> x.kind)").alias("kinds"), F.expr("transform(o, x -> x.up)").alias("up"), items.alias("ids"), F.expr("filter(s, x -> x.item is not null and x.kind is not null and x.value is not null)").alias("s"))
        .where("size(kinds) > 0 and size(ids) > 0")
        .select("run_id", "kinds", "up", "ids", F.col("s.item").alias("item"), F.col("s.kind").alias("kind"), F.expr("transform(s, x -> try_cast(x.value as double))").alias("value"))
    )


def stationary(scores: np.ndarray, kinds: np.ndarray, items: np.ndarray, damping: float = DAMPING) -> np.ndarray:
    """Stationary mass [runs, n] of the walk; scores [runs, kinds, n], higher is better, -inf where missing.

    kinds and items have the number of real kinds and items of a run; what is beyond is padding.
    """
    runs, most, n = scores.shape
    real = np.arange(n)[None, :] < items[:, None]
    used = np.arange(most)[None, :] < kinds[:, None]
    keyed = np.where(real[:, None, :], scores, -np.inf)
    # padding goes behind the missing ones
    order = np.lexsort((np.broadcast_to(~real[:, None, :], keyed.shape), -keyed), axis=2)
    ranked = np.take_along_axis(keyed, order, 2)
    at = np.broadcast_to(np.arange(n), ranked.shape)
    new = np.ones(ranked.shape, bool)
    new[:, :, 1:] = ranked[:, :, 1:] != ranked[:, :, :-1]
    start = np.maximum.accumulate(np.where(new, at, 0), axis=2)  # number of items strictly above
    last = np.ones(ranked.shape, bool)
    last[:, :, :-1] = new[:, :, 1:]
    end = np.flip(np.minimum.accumulate(np.flip(np.where(last, at, n), 2), axis=2), 2)  # last place of the tie
    top = start == 0
    share = np.where(top, 0.0, 1.0 / np.maximum(start, 1)) * used[:, :, None]
    mass = real / np.maximum(items[:, None], 1)
    back = np.argsort(order, axis=2)
    padded = np.zeros((runs, most, n + 1))
    for _ in range(STEPS):
        sorted_mass = np.take_along_axis(np.broadcast_to(mass[:, None, :], order.shape), order, 2)
        padded[:, :, :n] = np.flip(np.cumsum(np.flip(sorted_mass * share, 2), 2), 2)
        gained = np.take_along_axis(padded, end + 1, 2) + np.where(top, sorted_mass, 0.0)
        step = (np.take_along_axis(gained, back, 2) * used[:, :, None]).sum(1) / np.maximum(kinds[:, None], 1)
        after = np.where(real, damping * step + (1 - damping) / np.maximum(items[:, None], 1), 0.0)
        after /= np.maximum(after.sum(1, keepdims=True), 1e-300)
        moved = np.abs(after - mass).max(initial=0.0)
        mass = after
        if moved < TOLERANCE:
            break
    return mass


def number_above(scores: np.ndarray) -> np.ndarray:
    """Of every item in its kind: how many score strictly higher; ties share the number."""
    order = (-scores).argsort(2, kind="stable")
    ranked = np.take_along_axis(scores, order, 2)
    new = np.ones(ranked.shape, bool)
    new[:, :, 1:] = ranked[:, :, 1:] != ranked[:, :, :-1]
    start = np.maximum.accumulate(np.where(new, np.arange(ranked.shape[2]), 0), axis=2)
    return np.take_along_axis(start, order.argsort(2), 2)


def _rank(damping: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            items, kinds = (np.maximum(1, b[c].str.len().to_numpy()) for c in ("ids", "kinds"))
            shape = [np.ceil(np.log2(x)).astype(int) for x in (items, kinds)]  # runs of like shape share one padded array
            for _, part in b.groupby(shape, sort=False):
                cells = part["ids"].str.len().max() * part["kinds"].str.len().max()
                step = max(1, CELLS // max(1, int(cells)))
                for first in range(0, len(part), step):
                    yield _rank_part(part.iloc[first : first + step], damping)

    return run


def _rank_part(b: pd.DataFrame, damping: float) -> pd.DataFrame:
    items, kinds = b["ids"].str.len().to_numpy(), b["kinds"].str.len().to_numpy()
    n, most = int(items.max()), int(kinds.max())
    scores = np.full((len(b), most, n), -np.inf)
    present = np.zeros((len(b), most), bool)
    for i, (up, names, own_kinds, item, kind, value) in enumerate(zip(b["up"], b["ids"], b["kinds"], b["item"], b["kind"], b["value"])):
        if not len(item):
            continue
        place = {x: j for j, x in enumerate(names)}
        of = {x: j for j, x in enumerate(own_kinds)}
        item, kind, value = np.array([place[x] for x in item]), np.array([of.get(x, -1) for x in kind]), np.asarray(value, float)
        ok = (kind >= 0) & (item >= 0) & np.isfinite(value)
        item, kind = item[ok], kind[ok]
        value = np.where(np.asarray(up, bool)[kind], value[ok], -value[ok])
        np.maximum.at(scores[i], (kind, item), value)  # an item listed twice keeps its better score
        present[i, kind] = True
    ids = b["ids"].to_numpy()
    mass = stationary(scores, kinds, items, damping)
    place = number_above(scores)
    mean = np.where(np.arange(most)[None, :, None] < kinds[:, None, None], place, 0).sum(1) / np.maximum(kinds[:, None], 1)
    out = []
    for i, run_id in enumerate(b["run_id"]):
        m, own = items[i], np.asarray(ids[i])
        best = np.lexsort((own, mean[i, :m], -np.round(mass[i, :m], 12)))
        out.append(pd.DataFrame({"run_id": run_id, "chunk_id": own[best], "place": np.arange(1, m + 1), "mass": mass[i, :m][best], "kinds": int(present[i].sum())}))
    return pd.concat(out) if out else pd.DataFrame({"run_id": [], "chunk_id": [], "place": [], "mass": [], "kinds": []})


def combined_ranking(runs: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(run_id, chunk_id, place, mass, kinds): every candidate of every readable run with an order; place 1 is the best.

    kinds is the number of kinds of score with at least one usable value.
    """
    return run_scores(runs).mapInPandas(_rank(damping), "run_id bigint, chunk_id string, place int, mass double, kinds int")
