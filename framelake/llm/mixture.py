"""Records of several sources in target shares of the total size, small sources repeated up to a cap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.tokens import with_token_counts
from framelake.operators.lookup import is_small
from framelake.storage import write_table

SEED = 20
#: Most sources with a target; targets are settings, held on the driver.
MOST_SOURCES = 10_000
#: Parts that one round of the search for the cut of a source's seeded order looks at, and its rounds.
PARTS, ROUNDS = 1024, 3


@dataclass(frozen=True)
class Share:
    """What a source gets: ``size`` of the mixture, so ``epochs`` uses of each of its records on average."""

    source: str
    target: float
    available: int
    size: float
    epochs: float


def water_fill(targets: dict[str, tuple[float, float]], available: dict[str, int], total: float | None = None) -> list[Share]:
    """Sizes by source for ``targets`` {source: (weight, most uses of a record)}.

    Each source asks for its weight's share of ``total`` (all records that have a target, once, where None).
    Sources that ask for more than their cap allows get the cap, and what they leave is asked of the others
    in proportion to their weights, until nothing changes. Weights that are null, negative or not finite
    count as 0, as does a null cap; where all sources are at their cap the mixture is smaller than asked.
    """
    weight = {s: (w if w is not None and 0 < w < float("inf") else 0.0) for s, (w, _) in targets.items()}
    cap = {s: available.get(s, 0) * max(0.0, float(c or 0)) for s, (_, c) in targets.items()}
    whole = sum(weight.values())
    left = float(sum(available.get(s, 0) for s in targets if weight[s] > 0) if total is None else total)
    size = dict.fromkeys(targets, 0.0)
    free = {s for s in targets if weight[s] > 0}
    while free:
        asked = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / asked >= cap[s]}
        if not over:
            for s in free:
                size[s] = left * weight[s] / asked
            break
        for s in sorted(over):
            size[s] = cap[s]
            left -= cap[s]
        left = max(0.0, left)
        free -= over
    return [
        Share(s, weight[s] / whole if whole else 0.0, available.get(s, 0), size[s], size[s] / available[s] if available.get(s) else 0.0) for s in sorted(targets)
    ]


def clean_source(column: Column) -> Column:
    """Trimmed, lower-cased, with ``_`` between words; null where nothing is left."""
    text = F.regexp_replace(F.lower(F.trim(column)), r"[\s\-]+", "_")
    return F.when(text != "", text)


def _cuts(records: DataFrame, goal: dict[str, float]) -> dict[str, float]:
    """Of each source the point of the seeded order [0, 1) up to which records add up to its goal.

    Every round sums the tokens in PARTS parts of the interval that still holds the point, so the driver
    sees sources times PARTS numbers a round, whatever the number of records.
    """
    low, width, held = dict.fromkeys(goal, 0.0), 1.0, dict.fromkeys(goal, 0.0)
    for _ in range(ROUNDS):
        edges = _literal(low)
        part = F.floor((F.col("order") - edges) / F.lit(width) * PARTS).cast("int")
        within = records.where((F.col("order") >= edges) & (F.col("order") < edges + F.lit(width)))
        sums = within.groupBy("key", part.alias("part")).agg(F.sum("tokens").alias("n")).where(F.col("part").between(0, PARTS - 1))
        by: dict[str, dict[int, int]] = {}
        for r in sums.collect():
            by.setdefault(r["key"], {})[r["part"]] = r["n"]
        width /= PARTS
        for s in goal:
            part_no, have = 0, held[s]
            while part_no < PARTS - 1 and have + by.get(s, {}).get(part_no, 0) <= goal[s]:
                have += by.get(s, {}).get(part_no, 0)
                part_no += 1
            low[s], held[s] = low[s] + part_no * width, have
    return low


def _literal(values: dict[str, float]) -> Column:
    """A map from source to number as a column; 0 for other sources."""
    if not values:
        return F.lit(0.0)
    return F.coalesce(F.element_at(F.create_map(*[x for s, v in values.items() for x in (F.lit(s), F.lit(float(v)))]), F.col("key")), F.lit(0.0))


def mixture(spark: SparkSession, documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, shares). Records: ``doc_id, source, tokens, uses``, one row for each record used.

    A source's record is used floor(epochs) times, and once more if it comes early enough in the source's
    seeded order to make up the fraction; so no record is used more than its source's max_repeats, and a
    source misses its size by less than a record. Spellings of a source that differ in case, outer spaces
    and hyphens are one; of repeated targets the greatest weight counts. Records without tokens or without a
    target are not used. Shares: ``source, target_share, available_tokens, epochs, mixture_tokens,
    actual_share`` for each target and each source without one (target 0, not used; null as '').
    """
    records = with_token_counts(documents, None, vocabulary).select("doc_id", clean_source(F.col("source")).alias("key"), "tokens")
    order = F.pmod(F.xxhash64("doc_id", "key", "tokens", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    records = write_table(records.withColumn("order", order), "mixture-sizes")
    wanted = targets.select(clean_source(F.col("source")).alias("key"), "target_weight", "max_repeats").where("key is not null").groupBy("key")
    wanted = wanted.agg(F.max(F.struct(F.nanvl("target_weight", F.lit(None).cast("double")).alias("w"), F.col("max_repeats").alias("r"))).alias("m"))
    if not is_small(wanted, MOST_SOURCES):
        raise ValueError(f"more than {MOST_SOURCES} targets")
    asked = {r["key"]: (r["m"]["w"], r["m"]["r"]) for r in wanted.collect()}
    held = records.groupBy("key").agg(F.sum("tokens").alias("available"))
    names = spark.createDataFrame([(s,) for s in asked], "key string")
    available = {r["key"]: r["available"] for r in held.join(F.broadcast(names), "key", "left_semi").collect()}
    shares = water_fill(asked, available, total)
    whole = {s.source: float(int(s.epochs)) for s in shares}
    goal = {s.source: s.size - int(s.epochs) * s.available for s in shares if s.available}
    cuts = _cuts(records.where(F.col("tokens") > 0), {s: g for s, g in goal.items() if g >= 1}) if goal else {}
    uses = (_literal(whole) + F.when(F.col("order") < _literal(cuts), 1).otherwise(0)).cast("int")
    used = records.where("tokens > 0").withColumn("uses", uses).where("uses > 0").select("doc_id", F.col("key").alias("source"), "tokens", "uses")
    return used, _report(spark, used, held, shares)


def _report(spark: SparkSession, used: DataFrame, held: DataFrame, shares: list[Share]) -> DataFrame:
    plan = spark.createDataFrame([(s.source, s.target, s.epochs) for s in shares], "source string, target_share double, epochs double")
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("mixture_tokens"))
    every = held.select(F.coalesce("key", F.lit("")).alias("source"), F.col("available").alias("available_tokens"))
    joined = every.join(plan, "source", "full").join(got, "source", "left").na.fill(0)
    total = joined.agg(F.sum("mixture_tokens").alias("total")).withColumn("one", F.lit(1))  # one row
    return (
        joined.withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
        .select("source", F.round("target_share", 6).alias("target_share"), "available_tokens", F.round("epochs", 6).alias("epochs"), "mixture_tokens",
                F.round(F.coalesce(F.try_divide("mixture_tokens", "total"), F.lit(0.0)), 6).alias("actual_share"))
    )


def broken_promises(records: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, records, over_cap, foreign``: of each target its records used, those used too often, and those not its own.

    ``records`` is the first frame of :func:`mixture`; document ids have to be unique.
    """
    caps = targets.select(clean_source(F.col("source")).alias("source"), "max_repeats").where("source is not null").groupBy("source").agg(F.max("max_repeats").alias("cap"))
    own = documents.select("doc_id", clean_source(F.col("source")).alias("own"))
    got = records.join(own, "doc_id").join(F.broadcast(caps) if is_small(caps, MOST_SOURCES) else caps, "source", "right")
    return got.groupBy("source").agg(
        F.count("doc_id").alias("records"), F.count_if(F.col("uses") > F.col("cap")).alias("over_cap"), F.count_if(F.col("doc_id").isNotNull() & ~F.col("own").eqNullSafe(F.col("source"))).alias("foreign")
    )
