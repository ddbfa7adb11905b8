"""Repeated and nearly repeated files of new batches against everything accepted before.

The index is a folder of tables: members (which class of equal texts an entry belongs to), classes (one row for each
distinct shingle set, with its vector and sketch), graphs (small-world graphs of each shard of the history), centres
(how a large shard is cut into pieces), and similar (pairs of classes found similar). A new batch makes a shard of its
own; every FAN shards of a tier are compacted into one of the next tier, and those it replaces are deleted, so a batch
is searched against a number of shards that grows with the logarithm of the batches. A shard of more than SHARD_NODES
texts is cut by nearest centre, and a search enters only the pieces of the nearest centres. Of the texts only those of
the new entries are shingled, and those that a search proposes. Equal texts are one node, so a group of copies costs
one search.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm import nsw
from framelake.llm.shingles import SKETCH_WORDS, VECTOR_DIMS, jaccard, shingle_sets, sketches
from framelake.operators.lookup import BROADCAST_ROWS, is_small, lookup_join
from framelake.storage import drop_path, new_path, path_exists, write_table

WIDTH = 3
SIMILARITY = 0.6
#: Most bits in which sketches of similar texts differ; at similarity 0.64 the mean is 50, the deviation 6.3.
RADIUS = 72
#: Nodes of one graph; a shard with more is cut into pieces.
SHARD_NODES = 100_000
#: Most centres by which a shard is cut; beyond that, and where many texts are nearest to one centre, a hash cuts on.
MOST_CENTRES = 4_096
#: Pieces of the nearest centres that a node is put into, and the share of near copies whose piece a search has to enter.
PIECE_HOMES, ENTERED = 2, 0.998
#: Shards of a tier that are compacted into one of the next.
FAN = 4
TIERS = 3
#: Near copies by which the beam of a graph and the entered pieces are tuned.
PROBES = 512
#: Queries of one search task.
QUERY_BLOCK = 10_000
#: Members of a group that one task of the final expansion pairs with a partner.
GROUP_BLOCK = 1000

_SALTS, _CENTRES = 1 << 20, 1 << 12

#: 64 hexadecimal digits with separators between them, behind any words that a colon, an equals sign or a slash ends.
_WRITTEN = r"^[^0-9a-z]*(?:[a-z][a-z0-9_. -]*[:=/]\s*)*(?:0x|sha[^0-9a-z]*256[^0-9a-z]*)?((?:[0-9a-f][^0-9a-z]*){64})$"


def complete_checksum(column: Column) -> Column:
    """The 64 lower-case hexadecimal digits of a checksum in any writing, else null.

    The usual writings are recognised without a regular expression; what they leave is tried by a general one.
    """
    text = F.translate(F.lower(column), " \t\r\n:=-._", "")
    for prefix in ("sha256", "0x"):
        text = F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1 << 20)).otherwise(text)
    usual = (F.length(text) == 64) & (F.translate(text, "0123456789abcdef", "") == "")
    general = F.regexp_replace(F.regexp_extract(F.lower(column), _WRITTEN, 1), "[^0-9a-f]", "")
    return F.when(usual, text).when(F.length(text) >= 64, F.nullif(general, F.lit("")))


def entries_of(processed: DataFrame) -> DataFrame:
    """``entry_id, batch_no, checksum, doc_id``: each entry once, by its latest delivery."""
    row = F.struct("accepted_at", "batch_no", complete_checksum(F.col("checksum")).alias("checksum"), "doc_id")
    one = processed.where("entry_id is not null and batch_no is not null").groupBy("entry_id").agg(F.max(row).alias("m"))
    return one.select("entry_id", "m.batch_no", "m.checksum", "m.doc_id")


_FEATURES = "doc_id bigint, class_key string, vector binary, sketch binary"


def text_features(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, class_key, vector, sketch`` of the texts with at least ``width`` words.

    ``class_key`` is a 128-bit hash of the shingle set: texts of one key have similarity 1.
    """
    import xxhash

    out = pa.schema([("doc_id", pa.int64()), ("class_key", pa.string()), ("vector", pa.binary()), ("sketch", pa.binary())])

    def run(batches):
        for batch in batches:
            grams, singles = shingle_sets(batch.column(1).to_pylist(), width)
            good = [i for i, g in enumerate(grams) if len(g)]
            grams, singles = [grams[i] for i in good], [singles[i] for i in good]
            vectors, bits = sketches(grams, singles)
            keys = [xxhash.xxh3_128_hexdigest(g.tobytes()) for g in grams]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(good, pa.int64())), pa.array(keys, pa.string()), pa.array([v.tobytes() for v in vectors.astype(np.float16)], pa.binary()), pa.array([b.tobytes() for b in bits], pa.binary())],
                schema=out,
            )

    return documents.select(F.col("doc_id").cast("bigint"), "text").where("doc_id is not null and text is not null").mapInArrow(run, _FEATURES)


@dataclass(frozen=True)
class Shard:
    """A shard over the batch ranks (after, upto], searched by batches of ranks (upto, until]; ``centres`` cut it."""

    number: int
    after: int
    upto: int
    until: float
    centres: int


def _centres(nodes: int, shard_nodes: int) -> int:
    """Two for each SHARD_NODES nodes, as each is put into PIECE_HOMES pieces; one where all fit into one graph."""
    return min(MOST_CENTRES, PIECE_HOMES * math.ceil(nodes / shard_nodes)) if nodes > shard_nodes else 1


def shard_schedule(nodes: list[int], fan: int = FAN, tiers: int = TIERS, shard_nodes: int = SHARD_NODES) -> list[Shard]:
    """All shards of a history with ``nodes[r]`` new classes in the batch of rank r.

    Rank 0, the initial stock, is a segment of its own. Of the later ranks 1, 2, ... each is a shard of tier
    0, and every run of fan^t of them one of tier t, which replaces those it covers.
    """
    shards = [Shard(0, -1, 0, math.inf, _centres(nodes[0], shard_nodes))] if nodes else []
    for rank in range(1, len(nodes)):
        for tier in range(tiers):
            span = fan**tier
            if rank % span:
                break
            held = sum(nodes[rank - span + 1 : rank + 1])
            until = math.ceil(rank / (span * fan)) * span * fan if tier + 1 < tiers else math.inf
            if until > rank:  # at a tier's own end the next tier takes over at once
                shards.append(Shard(rank * tiers + tier + 1, rank - span, rank, until, _centres(held, shard_nodes)))
    return shards


def _unpack(column: pd.Series, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=dtype).reshape(-1, width)


def _vectors(column: pd.Series) -> np.ndarray:
    return _unpack(column, np.float16, VECTOR_DIMS).astype(np.float32)


def _sketches(column: pd.Series) -> np.ndarray:
    return _unpack(column, np.uint64, SKETCH_WORDS)


def _probes(vectors: np.ndarray, bits: np.ndarray, seed: int = 5, most: int = PROBES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Artificial near copies of nodes (vectors, sketches, and which nodes), as the texts of a similarity from SIMILARITY to 1 would have them.

    Two sets of equal size and similarity s share c = 2s / (1 + s) of their members, so their votes on a random
    direction have the correlation c: each probe's votes are drawn by it, at the length that votes have, and as
    many bits of its sketch flip. Words that two texts share beyond their shingles only bring them nearer.
    """
    rng = np.random.default_rng(seed)
    pick = rng.choice(len(vectors), size=min(most, len(vectors)), replace=False)
    similarity = rng.uniform(SIMILARITY, 1, size=(len(pick), 1))
    shared = 2 * similarity / (1 + similarity)
    votes = vectors[pick] * np.sqrt(rng.chisquare(vectors.shape[1], size=(len(pick), 1)))
    moved = shared * votes + np.sqrt(1 - shared**2) * rng.standard_normal(votes.shape)
    flips = np.packbits(rng.random((len(pick), bits.shape[1] * 64)) < np.arccos(shared) / np.pi, axis=1).view(np.uint64)
    return (moved / np.linalg.norm(moved, axis=1, keepdims=True)).astype(np.float32), bits[pick] ^ flips, pick


def fit_centres(sample: pd.DataFrame, count: int) -> tuple[np.ndarray, int]:
    """``count`` centres and how many of the nearest ones a search enters, of sampled rows ``vector, sketch``.

    So many are entered that of artificial near copies of further sampled rows the share ENTERED has one of its
    original's PIECE_HOMES nearest centres among them.
    """
    vectors, bits = _vectors(sample["vector"]), _sketches(sample["sketch"])
    centres, rest = vectors[:count], slice(count, None) if len(vectors) > count else slice(None)
    probes, _, origin = _probes(vectors[rest], bits[rest], most=len(vectors))
    homes = np.argsort(-(vectors[rest][origin] @ centres.T), axis=1)[:, :PIECE_HOMES]
    order = np.argsort(-(probes @ centres.T), axis=1)
    place = (order[:, :, None] == homes[:, None, :]).any(axis=2).argmax(axis=1)
    return centres, min(len(centres), int(np.quantile(place, ENTERED, method="higher")) + 1)


def nearest_centres(spark: SparkSession, fitted: dict[int, tuple[np.ndarray, int]], of_nodes: bool):
    """A function of (shard number, vector) that gives the centres of the pieces a node is put into or a search enters."""
    held = spark.sparkContext.broadcast(fitted)  # of shards with more than one centre; at most MOST_CENTRES each

    @F.pandas_udf("array<int>")
    def nearest(numbers: pd.Series, vectors: pd.Series) -> pd.Series:
        out = [[0]] * len(numbers)
        for number in numbers.unique():
            if number in held.value:
                own = np.flatnonzero(numbers == number)
                centres, entered = held.value[number]
                order = np.argsort(-(_vectors(vectors.iloc[own]) @ centres.T), axis=1, kind="stable")
                for at, row in zip(own, order[:, : PIECE_HOMES if of_nodes else entered].tolist(), strict=True):
                    out[at] = row
        return pd.Series(out, dtype=object)

    return nearest


def build_graphs(nodes: DataFrame) -> DataFrame:
    """``shard, graph, reps, recall`` of rows ``shard, rep, vector, sketch``."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        vectors, bits = _vectors(pdf["vector"]), _sketches(pdf["sketch"])
        graph = nsw.Graph.build(vectors, bits)
        recall = graph.tune(_probes(vectors, bits)[:2], RADIUS)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "graph": [graph.to_bytes()], "reps": [pdf["rep"].to_numpy(np.int64).tobytes()], "nodes": [len(pdf)], "beam": [graph.beam], "recall": [recall]})

    return nodes.groupBy("shard").applyInPandas(build, "shard bigint, graph binary, reps binary, nodes bigint, beam int, recall double")


def search_graphs(graphs: DataFrame, queries: DataFrame) -> DataFrame:
    """``a, b`` (a < b): classes whose sketches are near, of queries ``shard, block, rep, vector, sketch``."""
    empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return empty
        graph, reps = nsw.Graph.from_bytes(held["graph"].iloc[0]), np.frombuffer(held["reps"].iloc[0], dtype=np.int64)
        query, node = graph.search(_vectors(asked["vector"]), _sketches(asked["sketch"]), RADIUS)
        own = asked["rep"].to_numpy(np.int64)[query]
        other = reps[node]
        return pd.DataFrame({"a": np.minimum(own, other), "b": np.maximum(own, other)})[own != other].drop_duplicates()

    # Renamed, as both sides of the cogroup come from the queries.
    blocks = queries.select(F.col("shard").alias("of_shard"), F.col("block").alias("of_block")).distinct()
    held = blocks.join(graphs.select(F.col("shard").alias("of_shard"), "graph", "reps"), "of_shard")
    return queries.groupBy("shard", "block").cogroup(held.groupBy("of_shard", "of_block")).applyInPandas(search, "a bigint, b bigint")


def rerank(candidates: DataFrame, documents: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The candidate pairs ``a, b`` (document ids) whose texts' shingle sets have at least ``similarity``."""
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    if is_small(wanted):
        wanted = F.broadcast(wanted)
    texts = documents.select(F.col("doc_id").cast("bigint"), "text").where("doc_id is not null").join(wanted, "doc_id", "left_semi")

    def shingle(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), width)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "shingles"])

    sets = texts.mapInArrow(shingle, "doc_id bigint, shingles binary").groupBy("doc_id").agg(F.min("shingles").alias("shingles"))

    def compare(batches):
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    return candidates.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(compare, "a bigint, b bigint")


def expand_pairs(rows: DataFrame) -> DataFrame:
    """``entry_id_a, entry_id_b`` of rows that share ``key`` but not ``batch_no``, at least one of them new.

    ``rows`` has ``key, entry_id, batch_no, is_new``. Only groups of several batches with a new row are kept, once, as a
    table. The members of a large group are cut into blocks, and its new rows copied to each, so no task
    holds a group.
    """
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("batch_no").alias("lo"), F.max("batch_no").alias("hi"), F.max("is_new").alias("any_new"))
    wide = groups.where("lo < hi and any_new").select("key", F.ceil(F.col("n") / GROUP_BLOCK).cast("int").alias("blocks"))
    held = write_table(rows.join(wide, "key"), "groups")
    return _met(held.where("is_new"), held)


def _met(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs of rows of both sides that share ``key``; ``held`` is cut into its ``blocks``, ``asked`` copied to each."""
    l = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("l")
    r = held.withColumn("block", F.pmod(F.xxhash64("entry_id"), F.col("blocks")).cast("int")).alias("r")
    once = (F.col("l.batch_no") != F.col("r.batch_no")) & (~F.col("r.is_new") | (F.col("l.entry_id") < F.col("r.entry_id")))
    met = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.block") == F.col("r.block")) & once)
    return met.select(F.least("l.entry_id", "r.entry_id").alias("entry_id_a"), F.greatest("l.entry_id", "r.entry_id").alias("entry_id_b"))


def _known(df: DataFrame, asked: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose key is asked for; few keys are broadcast, so that a large history isn't shuffled for them."""
    keys = asked.select(on).distinct()
    return df.join(F.broadcast(keys) if is_small(keys) else keys, on, "left_semi")


def _listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the schedule as a frame, broadcast while they are few."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


class DedupIndex:
    """The growing index at ``path``. Any number of batches may be ingested at once, and entries of a batch in several waves.

    The ranks of the shard schedule are the batches of each wave, in the order of waves and then of batch_no: entries that
    come late to a known batch, or batches below the highest, get ranks of their own and are searched against all earlier ones.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, shard_nodes: int = SHARD_NODES) -> None:
        self.spark, self.path, self.shard_nodes = spark, path or new_path(spark, "dedup"), shard_nodes

    _SCHEMAS = {
        "entries": "entry_id bigint, batch_no bigint, checksum string, doc_id bigint",
        "classes": "class_key string, rep bigint, first bigint, vector binary, sketch binary",
        "members": "rep bigint, batch_no bigint, entry_id bigint",
        "similar": "a bigint, b bigint",
        "graphs": "graph binary, reps binary, nodes bigint, beam int, recall double",
        "centres": "number bigint, centre int, vector binary, entered int, salts int",
        "candidates": "a bigint, b bigint",
        "texts": "doc_id bigint, first bigint, class_key string, vector binary, sketch binary",
    }
    _FOLDERS = {"graphs": ("number", "shard")}  # a shard's graphs lie in a folder of their own, to be deleted as a whole

    def table(self, name: str, wave: int | None = None) -> DataFrame:
        schema = T.StructType.fromDDL(", ".join([self._SCHEMAS[name], "wave int", *(f"{c} bigint" for c in self._FOLDERS.get(name, ()))]))
        if not path_exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return df if wave is None else df.where(F.col("wave") == wave)

    def _append(self, df: DataFrame, name: str, wave: int) -> DataFrame:
        """A wave's rows as a folder of its own: repeated after a failure, it overwrites only itself."""
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*self._FOLDERS.get(name, ())).parquet(f"{self.path}/{name}/wave={wave}")
        return self.table(name, wave).drop("wave")

    def ingest(self, processed: DataFrame, documents: DataFrame, build_last: bool = True) -> DataFrame:
        """Accept batches; ``entry_id_a, entry_id_b`` of each pair with at least one entry of them.

        A pair has different batches, and the same complete checksum or documents whose sets of three
        successive words have a Jaccard similarity of at least 0.6. Entries that are already known are
        ignored; null ids and batch numbers, null checksums and documents match nothing. ``build_last`` false
        leaves out shards that only a later wave would search.
        """
        old = self.table("entries")
        wave = (old.agg(F.max("wave")).first()[0] or 0) + 1
        fresh = entries_of(processed)
        if wave > 1:
            fresh = fresh.join(old.select("entry_id"), "entry_id", "left_anti")
        entries = self._append(fresh, "entries", wave)

        firsts = entries.where("doc_id is not null").groupBy("doc_id").agg(F.min("batch_no").alias("first"))
        texts = self._append(lookup_join(text_features(self._texts_of(firsts, documents)), firsts, ["doc_id"], "inner").select("doc_id", "first", "class_key", "vector", "sketch"), "texts", wave)
        grouped = texts.groupBy("class_key").agg(F.min("doc_id").alias("rep"), F.min("first").alias("first"), F.min("vector").alias("vector"), F.min("sketch").alias("sketch"))
        earlier = self.table("classes").where(F.col("wave") < wave).select("class_key", "rep")
        if wave > 1:
            earlier = _known(earlier, texts, "class_key")
            grouped = grouped.join(earlier, "class_key", "left_anti")
        classes = self._append(grouped, "classes", wave)

        keyed = lookup_join(entries.where("doc_id is not null"), texts.select("doc_id", "class_key").groupBy("doc_id").agg(F.min("class_key").alias("class_key")), ["doc_id"], "inner")
        known = classes.select("class_key", "rep")
        members = self._append(lookup_join(keyed, known.unionByName(earlier) if wave > 1 else known, ["class_key"], "inner").select("rep", "batch_no", "entry_id"), "members", wave)

        self._search(members, documents, wave, build_last)
        return self._pairs(entries, members, wave)

    def _texts_of(self, firsts: DataFrame, documents: DataFrame) -> DataFrame:
        """The documents of new entries. Where these are most of all documents, all are read rather than shuffled."""
        if 2 * firsts.count() > documents.count():
            return documents
        return _known(documents.select(F.col("doc_id").cast("bigint"), "text"), firsts, "doc_id")

    def _pairs(self, entries: DataFrame, members: DataFrame, wave: int) -> DataFrame:
        """The pairs of a wave's entries; of the history only rows that share a key with them are read on."""
        new = F.lit(True).alias("is_new")
        sums = entries.where("checksum is not null").select(F.concat(F.lit("sum "), "checksum").alias("key"), "entry_id", "batch_no", new)
        groups = members.select(F.concat(F.lit("class "), "rep").alias("key"), "entry_id", "batch_no", new).unionByName(sums)
        similar = self.table("similar").select("a", "b").distinct()
        both = similar.unionByName(similar.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if wave > 1:
            before, past = F.col("wave") < wave, F.lit(False).alias("is_new")
            own = _known(self.table("members").where(before), members, "rep").select(F.concat(F.lit("class "), "rep").alias("key"), "entry_id", "batch_no", past)
            held = _known(self.table("entries").where(before), entries.where("checksum is not null"), "checksum").select(F.concat(F.lit("sum "), "checksum").alias("key"), "entry_id", "batch_no", past)
            groups = groups.unionByName(own).unionByName(held)
            both = _known(both, members.select(F.col("rep").alias("a")), "a")
        near = members.select(F.col("rep").alias("a"), "entry_id", "batch_no").join(both, "a").select(F.col("b").alias("key"), "entry_id", "batch_no")
        everyone = self.table("members").select(F.col("rep").alias("key"), "entry_id", "batch_no", (F.col("wave") == wave).alias("is_new"))
        # Equal texts and equal checksums are groups alike; their keys differ in the first word.
        return expand_pairs(groups).unionByName(self._across(near, everyone)).distinct()

    def _across(self, asked: DataFrame, members: DataFrame) -> DataFrame:
        """Pairs between the new members of a class (``asked``, with the key of the partner) and a similar class."""
        own = _known(members, asked, "key")
        sizes = own.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / GROUP_BLOCK).cast("int").alias("blocks"))
        return _met(asked.join(sizes, "key"), own.join(sizes, "key"))

    def _search(self, members: DataFrame, documents: DataFrame, wave: int, build_last: bool) -> None:
        spark, classes = self.spark, self.table("classes")
        # One row for each batch of a wave; the schedule needs nothing else on the driver.
        ranks = [(r["wave"], r["batch_no"]) for r in self.table("entries").select("wave", "batch_no").distinct().orderBy("wave", "batch_no").collect()]
        counts = {(r["wave"], r["first"]): r["n"] for r in classes.groupBy("wave", "first").agg(F.count(F.lit(1)).alias("n")).collect()}
        asked = {(wave, r["batch_no"]): r["n"] for r in members.groupBy("batch_no").agg(F.countDistinct("rep").alias("n")).collect()}
        new_from = next((i for i, r in enumerate(ranks) if r[0] == wave), len(ranks))
        shards = shard_schedule([counts.get(r, 0) for r in ranks], shard_nodes=self.shard_nodes)
        last = len(ranks) - 1
        searched = [s for s in shards if any(s.upto < q <= s.until for q in range(max(new_from, s.upto + 1), len(ranks)))]
        self._build([s for s in shards if s.upto >= new_from and (s in searched or (build_last and s.until > last))], ranks, classes, wave)

        plan = [
            (b, s.number, max(1, math.ceil(sum(asked.get(x, 0) for x in ranks[s.upto + 1 :]) / QUERY_BLOCK)))
            for s in searched
            for q, (_, b) in enumerate(ranks)
            if q >= new_from and s.upto < q <= s.until
        ]
        if not plan:
            self._append(spark.createDataFrame([], "a bigint, b bigint"), "similar", wave)
            return
        visible = _listed(spark, plan, "batch_no bigint, number bigint, blocks int")
        who = members.select("rep", "batch_no").distinct().join(visible, "batch_no").select("rep", "number", "blocks").distinct()
        own = classes if wave == 1 else _known(classes, members, "rep")
        queries = lookup_join(who, own.select("rep", "vector", "sketch"), ["rep"], "inner")
        fitted, pieces = self._centres([s.number for s in searched])
        if fitted:
            queries = queries.withColumn("centre", F.explode(nearest_centres(spark, fitted, False)("number", "vector")))
            queries = lookup_join(queries, pieces, ["number", "centre"], "inner").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        else:  # every shard is one piece
            queries = queries.withColumns({"centre": F.lit(0), "salt": F.lit(0)})
        queries = queries.select(_shard(), F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), "rep", "vector", "sketch")
        candidates = self._append(search_graphs(self.table("graphs").where(F.col("number").isin([s.number for s in searched])), queries).distinct(), "candidates", wave)
        self._append(rerank(candidates, documents), "similar", wave)
        for s in shards:  # replaced by a shard of the next tier in this wave, for all batches to come
            if build_last and new_from <= s.until <= last:
                drop_path(spark, f"{self.path}/graphs/wave={ranks[s.upto][0]}/number={s.number}")

    def _build(self, wanted: list[Shard], ranks: list[tuple[int, int]], classes: DataFrame, wave: int) -> None:
        spark = self.spark
        rank_of = [(*r, s.number) for s in wanted for r in ranks[s.after + 1 : s.upto + 1]]
        if not rank_of:
            return
        nodes = classes.join(_listed(spark, rank_of, "wave int, first bigint, number bigint"), ["wave", "first"]).select("number", "rep", "vector", "sketch")
        fitted, rows = {}, [(s.number, 0, None, 1) for s in wanted if s.centres == 1]
        for s in (s for s in wanted if s.centres > 1):
            # At most MOST_CENTRES rows and the probes' ones, by a seeded order.
            sample = nodes.where(F.col("number") == s.number).orderBy(F.xxhash64("rep", F.lit(17)), "rep").limit(s.centres + PROBES).toPandas()
            fitted[s.number] = fit_centres(sample, s.centres)
            rows += [(s.number, i, v.astype(np.float16).tobytes(), fitted[s.number][1]) for i, v in enumerate(fitted[s.number][0])]
        held = {}
        if fitted:  # one row for each centre
            nodes = nodes.withColumn("centre", F.explode(nearest_centres(spark, fitted, True)("number", "vector")))
            sizes = nodes.where(F.col("number").isin(list(fitted))).groupBy("number", "centre").count().collect()
            held = {(r["number"], r["centre"]): max(1, math.ceil(r["count"] / self.shard_nodes)) for r in sizes}
        rows = [(*r, held.get(r[:2], 1)) for r in rows]
        pieces = spark.createDataFrame(rows, self._SCHEMAS["centres"])
        self._append(pieces, "centres", wave)
        if fitted:
            nodes = lookup_join(nodes, pieces.select("number", "centre", "salts"), ["number", "centre"], "inner").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")))
        else:
            nodes = nodes.withColumns({"centre": F.lit(0), "salt": F.lit(0)})
        graphs = build_graphs(nodes.select(_shard(), "rep", "vector", "sketch"))
        self._append(graphs.withColumn("number", F.floor(F.col("shard") / (_CENTRES * _SALTS)).cast("bigint")), "graphs", wave)

    def _centres(self, numbers: list[int]) -> tuple[dict[int, tuple[np.ndarray, int]], DataFrame]:
        """Centres of the shards that have several, and ``number, centre, salts`` of all."""
        own = self.table("centres").where(F.col("number").isin(numbers))
        fitted = {}
        for number, rows in own.where("vector is not null").select("number", "centre", "vector", "entered").toPandas().sort_values("centre").groupby("number"):
            fitted[int(number)] = (_vectors(rows["vector"]), int(rows["entered"].iloc[0]))
        return fitted, own.select("number", "centre", "salts")

    def classes_of_entries(self) -> DataFrame:
        """``entry_id, batch_no, class_id, copies, similar_classes``: one row for each entry with a text of three words.

        The class is that of equal shingle sets, named by its smallest document; ``similar_classes`` counts the classes of
        a similarity of at least SIMILARITY. Nothing is expanded into pairs of copies.
        """
        members, similar = self.table("members").select("rep", "entry_id", "batch_no"), self.table("similar").select("a", "b").distinct()
        links = similar.select("a").unionByName(similar.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("rep")).agg(F.count(F.lit(1)).alias("similar_classes"))
        sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies")).join(links, "rep", "left")
        return members.join(sizes, "rep").select("entry_id", "batch_no", F.col("rep").alias("class_id"), "copies", F.coalesce("similar_classes", F.lit(0)).cast("bigint").alias("similar_classes"))


def _shard() -> Column:
    """The number of a graph by shard, centre and salt."""
    return (F.col("number") * F.lit(_CENTRES * _SALTS) + F.col("centre") * _SALTS + F.col("salt")).cast("bigint").alias("shard")


def duplicate_pairs(spark: SparkSession, processed: DataFrame, documents: DataFrame) -> DataFrame:
    """All pairs of a history, ingested in one wave: each batch is searched against the shards before it."""
    return DedupIndex(spark).ingest(processed, documents, build_last=False)


def duplicate_classes(spark: SparkSession, processed: DataFrame, documents: DataFrame) -> DataFrame:
    """The classes of a history's entries, with the number of similar classes in other batches' first texts."""
    index = DedupIndex(spark)
    index.ingest(processed, documents, build_last=False)
    return index.classes_of_entries()
