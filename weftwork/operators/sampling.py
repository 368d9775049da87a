"""Seeded samples: uniform, systematic, and a stratified draw with quotas and floors."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.text import word_count
from weftwork.operators.ordering import numbered
from weftwork.session import materialize


def priority(seed: int | str, id_col: Column) -> Column:
    """A place in a seeded random order that depends on the id only: 16 hexadecimal digits."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")), 256), 1, 16)


def uniform(df: DataFrame, n: int, seed: int | str, id_col: str) -> DataFrame:
    return df.orderBy(priority(seed, F.col(id_col)), id_col).limit(n)


def systematic(df: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    """About ``n`` rows of each group, every k-th from the first on, k = rows // n and at least 1."""
    d = numbered(df, order, by, "_at", "_total").withColumn("_k", F.greatest(F.lit(1), F.floor(F.col("_total") / n)))
    return d.where("_at % _k = 0 and _at / _k < " + str(n)).drop("_at", "_total", "_k")


def prepared(docs: DataFrame, mentions: DataFrame, flag: Column, prio: Column, text: str = "body") -> DataFrame:
    """``docs(id, source, <text>)``, ``mentions(document_id, entity)`` -> what ``draw`` takes: ``(id, source, words, entities, flag, prio)``."""
    sets = mentions.groupBy(F.col("document_id").alias("_id")).agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    d = docs.select("id", "source", word_count(F.col(text)).alias("words"), flag.alias("flag"), prio.alias("prio"))
    return d.join(sets, d["id"] == sets["_id"], "left").select("id", "source", "words", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), "flag", "prio")


def _greedy(pool: pd.DataFrame, available: dict, in_entity: dict, quotas: dict, total: int, least: int, floors: dict) -> dict[int, str]:
    """The rules of ``draw`` over a bounded frame in order of priority; document -> what it was picked for."""
    quota = dict(quotas)
    want = {s: min(math.ceil(q * least / total), available.get(s, 0)) for s, q in quota.items()}
    spare_of = lambda s: available.get(s, 0) - want[s]
    while sum(want.values()) < least:
        open_ = [s for s in quota if want[s] < min(available.get(s, 0), quota[s])]
        if open_:
            want[max(open_, key=spare_of)] += 1
            continue
        givers, takers = [s for s in quota if quota[s] > want[s]], [s for s in quota if available.get(s, 0) > quota[s]]
        if not givers or not takers:
            break
        quota[min(givers, key=spare_of)] -= 1
        quota[max(takers, key=lambda s: available.get(s, 0) - quota[s])] += 1

    rows = list(pool.itertuples(index=False))
    picked: dict[int, str] = {}
    taken = {(s, f): 0 for s in quota for f in (True, False)}

    def pick(r, why: str) -> None:
        picked[r.id] = why
        taken[r.source, bool(r.flag)] += 1

    def full(s: str) -> bool:
        return taken[s, True] + taken[s, False] >= quota[s]

    held = {e: 0 for e in floors}
    for e in sorted(floors, key=lambda e: (in_entity.get(e, 0), e)):
        held[e] = sum(1 for r in rows if r.id in picked and e in r.entities)
        seen: dict[str, int] = {}
        queue = []
        for r in rows:
            if e in r.entities and r.id not in picked:
                queue.append((not r.flag, seen.get(r.source, 0), r.source, r))
                seen[r.source] = seen.get(r.source, 0) + 1
        for *_, r in sorted(queue, key=lambda x: x[:3]):
            if held[e] >= floors[e]:
                break
            if not full(r.source) and (r.flag or taken[r.source, False] < quota[r.source] - want[r.source]):
                pick(r, f"floor:{e}")
                held[e] += 1
    for s in quota:
        own = [r for r in rows if r.source == s]
        for flag, limit in ((True, want[s]), (False, None), (True, None)):
            for r in own:
                if full(s) or limit is not None and taken[s, True] >= limit:
                    break
                if r.flag == flag and r.id not in picked:
                    pick(r, "quota")
    for r in sorted((r for r in rows if r.id not in picked), key=lambda r: (not r.flag, -r.prio, r.r, r.id)):
        if len(picked) >= total:
            break
        pick(r, "shortfall_fill")
    return picked


def draw(
    docs: DataFrame, quotas: dict[str, int], total: int, least_flagged: int, floors: dict[str, int] | None = None,
    seed: int = 42, min_words: int = 20, exclude: DataFrame | None = None,
) -> DataFrame:
    """``docs(id, source, words, entities, flag, prio)`` -> the drawn rows with ``picked_for`` and ``stratum``.

    The pool are documents of the quota sources with enough words and an entity, by priority and
    then in a seeded order of ids. Flagged documents are wanted first, in shares of the quotas; each
    entity gets its floor, the scarcest first and from all sources in turn; sources are filled to
    their quotas, and a source's shortfall goes to the others.

    Only as many rows as the rules can ever reach leave the executors: the first of each (source,
    flag) and of each (entity, source, flag). Counts of what is available come from the whole pool.
    """
    floors = floors or {}
    pool = docs.where(F.col("source").isin(list(quotas)) & (F.col("words") >= min_words) & (F.size("entities") > 0))
    pool = pool.withColumn("r", priority(seed, F.col("id")))
    if exclude is not None:
        pool = pool.join(exclude.select("id"), "id", "left_anti")
    # Read several times below, while what comes in may be costly.
    pool = materialize(pool, "draw-pool")
    order = [F.desc("prio"), F.asc("r"), F.asc("id")]
    reach = 2 * max(total, sum(quotas.values())) + sum(floors.values())
    first = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    near = pool.withColumn("_n", first(["source", "flag"])).where(F.col("_n") <= reach).drop("_n")
    if floors:
        named = pool.withColumn("_e", F.explode(F.array_intersect("entities", F.array(*map(F.lit, floors)))))
        named = named.withColumn("_n", first(["_e", "source", "flag"])).where(F.col("_n") <= reach).drop("_n", "_e")
        near = near.unionByName(named).dropDuplicates(["id"])
    available = {r["source"]: r["n"] for r in pool.where("flag").groupBy("source").agg(F.count("*").alias("n")).collect()}
    in_entity = {r["e"]: r["n"] for r in pool.select(F.explode("entities").alias("e")).where(F.col("e").isin(list(floors))).groupBy("e").agg(F.count("*").alias("n")).collect()} if floors else {}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["prio", "r", "id"], ascending=[False, True, True], ignore_index=True)
        picked = _greedy(frame, available, in_entity, quotas, total, least_flagged, floors)
        return pd.DataFrame({"id": list(picked), "picked_for": list(picked.values())}).astype({"id": "int64"})

    chosen = near.select("id", "source", "flag", "prio", "r", "entities", F.lit(0).alias("all")).groupBy("all").applyInPandas(run, "id long, picked_for string")
    stratum = F.concat("source", F.lit("/"), F.when(F.col("flag"), "flagged").otherwise("other"))
    return pool.join(F.broadcast(chosen), "id").withColumn("stratum", stratum).drop("r")


def coverage(sample: DataFrame, entities: list[str]) -> DataFrame:
    """One row of counts: rows, flagged, several entities, and rows of each entity."""
    return sample.agg(F.count("*").alias("n"), F.count_if("flag").alias("flagged"), F.count_if(F.size("entities") > 1).alias("several"), *[F.count_if(F.array_contains("entities", e)).alias(f"with_{e}") for e in entities])
