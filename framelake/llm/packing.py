"""Items into containers of fixed capacity under several limits at once.

Vector bin packing: an item is a vector (tokens, segments, loss-bearing tokens), a container has a limit for
each. Bins are filled one after the other; the next item of a bin is the one, of those that still fit, whose
vector has the greatest dot product with what is left in the bin, each dimension measured in its limit and
weighted by how scarce it is over all items. It is chosen anew after every placement. Documents are spread over groups by a hash; each group is
packed by one task, and what its last bins leave open is the only loss of packing groups apart.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.tokens import with_token_counts
from framelake.operators.lookup import is_small
from framelake.storage import write_table

#: Items of one packing group on average; bounds a task and the share of half-open last bins.
GROUP_ITEMS = 8_000
#: A container takes at most one segment for so many tokens of its capacity.
TOKENS_PER_SEGMENT = 16
#: Loss-bearing tokens a container may hold, as a share of its capacity.
LOSS_SHARE = 0.95

#: Kinds of items looked at together when a bin is filled.
BLOCK = 128

#: Most kinds of containers; they are settings, held on the driver, and more of them are an error.
MOST_KINDS = 1000

_SENTENCE = re.compile(r"[.!?。:\n]")


def prompt_of(text: str) -> str:
    """The first sentence of a text, which takes the part of the instruction and bears no loss."""
    end = _SENTENCE.search(text)
    return text[: end.end()] if end else ""


def fill_bins(vectors: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The bin of each item; ``vectors`` (n, k) and ``limits`` (k,) are non-negative.

    Every placement takes, of the items that fit into what is left of the bin, the one of the greatest dot product with
    it, so the choice changes as the bin fills. An item that exceeds a limit by itself is put alone into a bin of its
    own. Ties go to the item of the larger first dimension, then the next; equal items in their given order.

    Items of one vector are one kind. Kinds are looked at in blocks by falling first dimension; a block whose greatest
    values in each dimension could not beat the best one so far ends the search, as those behind it can't either.
    """
    bins = np.full(len(vectors), -1, dtype=np.int64)
    alone = (vectors > limits).any(axis=1)
    next_bin = int(alone.sum())
    bins[alone] = np.arange(next_bin)
    rest = np.flatnonzero(~alone)
    if not len(rest):
        return bins
    kinds, kind_of, left = np.unique(vectors[rest], axis=0, return_inverse=True, return_counts=True)
    kinds, left, last = kinds[::-1], left[::-1].copy(), len(left) - 1
    order = np.argsort(last - kind_of.ravel(), kind="stable")
    heads = np.concatenate([[0], np.cumsum(left)])[:-1].copy()
    members = rest[order]
    scale = np.where(limits > 0, limits, 1).astype(float)
    units = kinds / scale
    weight = (units * left[:, None]).sum(axis=0)
    weight = weight / weight.max() if weight.max() > 0 else np.ones(len(limits))
    number = np.arange(len(kinds))
    todo = len(rest)
    while todo:
        # Kinds that are used up are left out from time to time; until then they only make the bounds looser.
        alive = left > 0
        kinds, units, left, number = kinds[alive], units[alive], left[alive], number[alive]
        weighted = units * weight
        bounds = np.maximum.accumulate(weighted[::-1])[::-1]  # greatest values from here on
        falling = -kinds[:, 0]
        used_up, most = 0, max(BLOCK, len(kinds) // 4)
        while todo and used_up <= most:
            room = limits.astype(np.int64).copy()
            while True:
                free = room / scale
                best, score = -1, -1.0
                at = int(np.searchsorted(falling, -room[0], side="left"))
                while at < len(kinds):
                    if best >= 0 and bounds[at] @ free <= score:
                        break
                    stop = min(at + BLOCK, len(kinds))
                    fits = np.flatnonzero((left[at:stop] > 0) & (kinds[at:stop] <= room).all(axis=1))
                    if len(fits):
                        scores = weighted[at:stop][fits] @ free
                        top = int(scores.argmax())
                        if scores[top] > score:
                            best, score = at + int(fits[top]), float(scores[top])
                    at = stop
                if best < 0:
                    break
                bins[members[heads[number[best]]]] = next_bin
                heads[number[best]] += 1
                left[best] -= 1
                used_up += left[best] == 0
                todo -= 1
                room -= kinds[best]
            next_bin += 1
    return bins


def cut_items(sizes: DataFrame, containers: DataFrame, loss_share: float = LOSS_SHARE) -> DataFrame:
    """One row for each container kind and piece: ``container_kind, capacity, doc_id, piece, start, tokens, loss``.

    A text of at most the capacity is one piece. A longer one is cut into full pieces and a rest; a piece
    whose loss-bearing tokens would exceed their limit is cut at that limit instead.
    """
    kinds = containers.where("capacity_tokens > 0 and container_kind is not null").groupBy("container_kind").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    if not is_small(kinds, MOST_KINDS):
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    listed = [F.struct(F.lit(r["container_kind"]).cast("string").alias("container_kind"), F.lit(r["capacity"]).cast("bigint").alias("capacity")) for r in kinds.collect()]
    each = F.array(*listed) if listed else F.array().cast("array<struct<container_kind:string,capacity:bigint>>")
    step = F.greatest(F.lit(1), F.floor(F.col("capacity") * loss_share)).cast("bigint")
    first = F.least(F.col("capacity"), F.col("prompt_tokens") + step)
    both = sizes.where("tokens > 0").withColumn("_kind", F.explode(each)).select("*", "_kind.*")
    more = F.when(F.col("tokens") > F.col("capacity"), F.ceil((F.col("tokens") - first) / step)).otherwise(0).cast("int")
    pieces = both.withColumns({"_first": first, "_step": step}).withColumn("piece", F.explode(F.sequence(F.lit(0), more)))
    cut = F.col("tokens") > F.col("capacity")
    start = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("_first") + (F.col("piece") - 1) * F.col("_step"))
    pieces = pieces.withColumn("start", start.cast("bigint"))
    size = F.when(~cut, F.col("tokens")).when(F.col("piece") == 0, F.col("_first")).otherwise(F.least(F.col("_step"), F.col("tokens") - F.col("start")))
    return pieces.select(
        "container_kind", "capacity", "doc_id", "piece", "start", size.alias("size"),
        (size - F.greatest(F.lit(0), F.least(size, F.col("prompt_tokens") - F.col("start")))).alias("loss"),
    )


_PLACED = "container_kind string, container_id string, capacity bigint, doc_id bigint, piece int, start_token bigint, n_tokens bigint, loss_tokens bigint, segment_no int, loss_limit bigint"


def pack_documents(
    documents: DataFrame,
    containers: DataFrame,
    group_items: int = GROUP_ITEMS,
    tokens_per_segment: int = TOKENS_PER_SEGMENT,
    loss_share: float = LOSS_SHARE,
    vocabulary: str | None = None,
) -> DataFrame:
    """Every document in containers of every kind: one row for each piece and the container that holds it.

    Limits of a container: its capacity in tokens, one segment for ``tokens_per_segment`` tokens of the
    capacity, and ``loss_share`` of the capacity in loss-bearing tokens (those behind the first sentence), which
    ``loss_limit`` tells. A text may not be cut unless it exceeds the capacity; one that fits but has more
    loss-bearing tokens than their limit gets a container for itself, whose ``loss_limit`` is raised to them. So no
    container exceeds the limits it is written with. Texts without tokens take no room and are left out; so are kinds without a name or a positive capacity; of a repeated kind the largest capacity
    counts. Rows with a null doc_id are packed like others. An empty table gives no rows.
    """
    sizes = write_table(with_token_counts(documents, prompt_of, vocabulary), "token-sizes")
    items = cut_items(sizes, containers, loss_share)
    # As many groups as a kind's pieces need; there are at most MOST_KINDS kinds. Pieces of one text may go to
    # different groups, so that one huge text fills no group by itself.
    held = items.groupBy("container_kind").count().collect()
    if not held:
        return sizes.sparkSession.createDataFrame([], _PLACED)
    groups = F.element_at(F.create_map(*[x for r in held for x in (F.lit(r["container_kind"]), F.lit(max(1, round(r["count"] / group_items))))]), F.col("container_kind"))
    items = items.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "size"), groups))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        capacity = int(pdf["capacity"].iloc[0])
        limits = np.array([capacity, max(1, capacity // tokens_per_segment), max(1, int(capacity * loss_share))])
        vectors = np.column_stack([pdf["size"], np.ones(len(pdf), dtype=np.int64), pdf["loss"]]).astype(np.int64)
        bins = fill_bins(vectors, limits)
        loss_limit = np.maximum(limits[2], vectors[:, 2])
        kind, group = pdf["container_kind"].iloc[0], int(pdf["group"].iloc[0])
        return pd.DataFrame(
            {"container_kind": kind, "container_id": [f"{kind}-{group}-{b}" for b in bins], "capacity": capacity, "doc_id": pdf["doc_id"], "piece": pdf["piece"]}
            | {"start_token": pdf["start"], "n_tokens": pdf["size"], "loss_tokens": pdf["loss"], "segment_no": pd.Series(bins).groupby(bins).cumcount().to_numpy(), "loss_limit": loss_limit}
        )

    return items.groupBy("container_kind", "group").applyInPandas(pack, _PLACED)


def packing_report(placed: DataFrame) -> DataFrame:
    """``container_kind, containers, pieces, tokens, fill, raised``: fill is tokens over the capacity of all containers.

    ``raised`` counts the containers whose limit of loss-bearing tokens was raised for a single text.
    """
    each = placed.groupBy("container_kind", "container_id").agg(
        F.first("capacity").alias("capacity"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.max("loss_limit").alias("loss_limit")
    )
    least = placed.groupBy("container_kind").agg(F.min("loss_limit").alias("usual"))  # one row a kind
    return each.join(F.broadcast(least), "container_kind").groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / F.sum("capacity"), 4).alias("fill"),
        F.count_if(F.col("loss_limit") > F.col("usual")).alias("raised"),
    )


def broken_limits(placed: DataFrame, tokens_per_segment: int = TOKENS_PER_SEGMENT) -> DataFrame:
    """``container_kind, documents, over_capacity, over_segments, over_loss, cut_short, gaps``; all but documents should be 0.

    Containers over one of their limits; texts that were cut though they fit; and pieces that don't begin where the one
    before ends. Containers and texts are grouped by their ids, so no group is large but that of one text's pieces.
    """
    held = placed.groupBy("container_kind", "container_id").agg(
        F.first("capacity").alias("c"), F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.sum("loss_tokens").alias("l"), F.max("loss_limit").alias("limit")
    )
    most = F.greatest(F.lit(1), F.floor(F.col("c") / tokens_per_segment))
    by_container = held.groupBy("container_kind").agg(
        F.count_if(F.col("t") > F.col("c")).alias("over_capacity"), F.count_if(F.col("n") > most).alias("over_segments"),
        F.count_if((F.col("l") > F.col("limit")) | ((F.col("limit") > F.greatest(F.lit(1), F.floor(F.col("c") * LOSS_SHARE))) & (F.col("n") > 1))).alias("over_loss"),
    )
    # The pieces of a text lie end to end from 0 where their starts and lengths add up like those of a line of pieces.
    texts = placed.groupBy("container_kind", "doc_id").agg(
        F.first("capacity").alias("c"), F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.count_distinct("start_token").alias("starts")
    )
    by_text = texts.groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("t") <= F.col("c")) & (F.col("n") > 1)).alias("cut_short"), F.count_if((F.col("end") != F.col("t")) | (F.col("starts") != F.col("n"))).alias("gaps")
    )
    return by_text.join(by_container, "container_kind").select("container_kind", "documents", "over_capacity", "over_segments", "over_loss", "cut_short", "gaps")
