import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import dedup_index, nsw
from framelake.llm.dedup_index import DedupIndex, complete_checksum, duplicate_pairs, expand_pairs, shard_schedule
from framelake.llm.shingles import jaccard, shingle_sets, sketches, words
from framelake.storage import new_path

FILES = "entry_id bigint, batch_no bigint, accepted_at timestamp, checksum string, doc_id bigint, shard string, a int"
DOCS = "doc_id bigint, text string, class_key string"
T0 = datetime(2025, 1, 1)


def corpus(n=150, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.5:
            own = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 2, 30])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(40, 90))))
        docs.append((i, texts[-1], "clash"))
    return docs


def brute(files, docs):
    """Pairs by definition; files are (entry, batch, checksum, doc)."""
    text = {d: t for d, t, _ in docs}
    sets = {d: s for d, s in zip(text, shingle_sets(list(text.values()), 3)[0])}
    out = set()
    for i, a in enumerate(files):
        for b in files[i + 1 :]:
            same = a[2] is not None and a[2] == b[2]
            near = a[3] in sets and b[3] in sets and jaccard(sets[a[3]], sets[b[3]]) >= 0.6
            if a[1] != b[1] and (same or near):
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def frames(spark, files, docs):
    rows = [(e, b, T0, c, d, "clash", 0) for e, b, c, d in files]
    return spark.createDataFrame(rows, FILES), spark.createDataFrame(docs, DOCS)


def library(seed=5):
    docs = corpus()
    rng = random.Random(seed)
    files = [(i, rng.choice([1, 1, 1, 2, 3, 4, 5, 6, 7]), rng.choice([None, f"{rng.randrange(60):064x}", f"{i:064x}"]), rng.choice([None, i % 150, i % 150])) for i in range(330)]
    files += [(1000 + i, 1 + i % 7, "f" * 64, 0) for i in range(120)]  # one group of copies over all batches
    return files, docs


def test_pairs_against_brute_force(spark):
    files, docs = library()
    docs += [(900, None, "x"), (901, "", "x"), (902, "two words", "x"), (903, "long " * 200_000, "x")]
    files += [(2000 + i, 1 + i % 3, None, d) for i, d in enumerate([900, 901, 902, 902, 903, 903, 12345])]
    p, d = frames(spark, files, docs)
    again = p.where("entry_id % 10 = 0").withColumn("accepted_at", F.lit(datetime(2025, 2, 1)))
    rows = [tuple(r) for r in duplicate_pairs(spark, p.unionByName(again), d).collect()]
    want = brute(files, [x for x in docs if x[1]])
    assert len(rows) == len(set(rows)) and set(rows) <= want
    assert len(set(rows)) >= 0.98 * len(want)


def test_waves_give_what_one_wave_gives(spark):
    files, docs = library(8)
    p, d = frames(spark, files, docs)
    index = DedupIndex(spark, new_path(spark, "test-index"))
    found = set()
    for lo, hi in ((1, 1), (2, 4), (5, 5), (6, 7)):
        wave = {tuple(r) for r in index.ingest(p.where(f"batch_no between {lo} and {hi}"), d).collect()}
        assert not wave & found
        found |= wave
    whole = {tuple(r) for r in duplicate_pairs(spark, p, d).collect()}
    want = brute(files, docs)
    assert found <= want and len(found) >= 0.98 * len(want) and len(whole ^ found) <= 0.02 * len(want)
    assert index.table("graphs").select(F.min("recall")).first()[0] >= 0.9
    assert index.ingest(p.where("batch_no = 7"), d).count() == 0  # known entries are ignored


def test_a_shard_cut_by_centres(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(900)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=60)), "x") for i in range(600)]
    docs += [(1000 + i, " ".join(rng.choice(vocabulary) if rng.random() < 0.05 else w for w in docs[i][1].split()), "x") for i in range(200)]
    docs += [(2000 + i, " ".join(f"c{j}" for j in range(50)) + f" end{i} and{i}", "x") for i in range(300)]  # a crowd about one centre
    docs += [(2900, " ".join(f"c{j}" for j in range(50)) + " other end", "x")]
    files = [(i, 1 if d < 1000 or 2000 <= d < 2900 else 2, None, d) for i, (d, _, _) in enumerate(docs)]
    p, d = frames(spark, files, docs)
    index = DedupIndex(spark, new_path(spark, "test-centres"), shard_nodes=60)
    got = {tuple(r) for r in index.ingest(p, d).collect()}
    want = brute(files, docs)
    assert len(want) > 400 and got <= want and len(got) >= 0.98 * len(want)
    centres = index.table("centres").where("vector is not null")
    first = centres.where("number = 0").agg(F.count("*").alias("n"), F.max("entered").alias("entered"), F.max("salts").alias("salts")).first()
    assert first.n == 30 and first.entered < first.n and first.salts > 1
    assert index.table("graphs").agg(F.max("nodes")).first()[0] < 120


def test_a_batch_reads_only_its_own_part(spark, monkeypatch):
    docs = corpus(300, 4)
    files = [(i, 1 + (i >= 260) + (i >= 290), f"{i % 280:064x}", i) for i in range(300)]
    p, d = frames(spark, files, docs)
    index = DedupIndex(spark, new_path(spark, "test-part"))
    index.ingest(p.where("batch_no = 1"), d).count()
    held = []
    real = dedup_index.write_table
    monkeypatch.setattr(dedup_index, "write_table", lambda df, label: held.append(real(df, label)) or held[-1])
    found = {tuple(r) for r in index.ingest(p.where("batch_no = 2"), d).collect()}
    found |= {tuple(r) for r in index.ingest(p.where("batch_no = 3"), d).collect()}
    assert index.table("texts").groupBy("wave").count().orderBy("wave").collect() == [(1, 260), (2, 30), (3, 10)]  # texts shingled
    keys = [{r.key for r in h.select("key").distinct().collect()} for h in held]
    new = [{f"sum {i % 280:064x}" for i in span} for span in (range(260, 290), range(290, 300))]
    assert all({k for k in own if k.startswith("sum")} <= asked for own, asked in zip(keys, new))
    want = {x for x in brute(files, docs) if x[1] >= 260}
    assert found <= want and len(found) >= 0.98 * len(want)


def test_replaced_shards_are_deleted(spark):
    docs = corpus(90, 6)
    p, d = frames(spark, [(i, 1 + i // 15, None, i) for i in range(90)], docs)
    index = DedupIndex(spark, new_path(spark, "test-shards"))
    for span in ("<= 4", "= 5", "= 6"):
        index.ingest(p.where(f"batch_no {span}"), d)
    # The initial stock, ranks 1-4 compacted, and rank 5.
    assert sorted(r.number for r in index.table("graphs").select("number").distinct().collect()) == [0, 4 * 3 + 2, 5 * 3 + 1]


def test_classes_instead_of_pairs(spark):
    text = " ".join(f"a{i}" for i in range(60))
    docs = [(1, text, "x"), (2, text.upper(), "x"), (3, text + " end", "x"), (4, "quite another text", "x"), (5, "two words", "x")]
    p, d = frames(spark, [(10, 1, None, 1), (11, 2, None, 2), (12, 3, None, 3), (13, 3, None, 4), (14, 3, None, 5), (15, 3, None, None)], docs)
    got = sorted(tuple(r) for r in dedup_index.duplicate_classes(spark, p, d).collect())
    assert got == [(10, 1, 1, 2, 1), (11, 2, 1, 2, 1), (12, 3, 3, 1, 1), (13, 3, 4, 1, 0)]


def test_empty_tables(spark):
    p, d = frames(spark, [], [])
    assert duplicate_pairs(spark, p, d).count() == 0
    p, d = frames(spark, [(1, 1, None, None), (2, 2, None, None), (3, 3, "a" * 64, None), (4, 4, "A" * 64, None)], [])
    assert [tuple(r) for r in duplicate_pairs(spark, p, d).collect()] == [(3, 4)]


def test_checksum_writings(spark):
    good = "0123456789abcdef" * 4
    spelt = [good, good.upper(), f" {good} ", "sha256:" + good, "SHA-256=" + good.upper(), "0x" + good, "-".join(good[i : i + 2] for i in range(0, 64, 2)), " ".join(good[i : i + 8] for i in range(0, 64, 8))]
    spelt += ["hash:" + good, "checksum = " + good.upper(), "SHA-256: 0x" + good, "sha256/" + good, "sum: hash: " + "/".join(good[i : i + 4] for i in range(0, 64, 4)), ",".join(good), "sha_256 " + good]
    rows = spark.createDataFrame([(s,) for s in [*spelt, good[:32], good + "0", "g" * 64, "", None]], "c string").select(complete_checksum(F.col("c")).alias("k"))
    assert [r.k for r in rows.collect()] == [good] * len(spelt) + [None] * 5


def test_schedule_covers_history_once():
    nodes = [70, *[5] * 40]
    for fan, tiers in ((4, 3), (2, 4), (3, 1)):
        shards = shard_schedule(nodes, fan, tiers, 20)
        for q in range(1, len(nodes)):
            seen = sorted(r for s in shards if s.upto < q <= s.until for r in range(s.after + 1, s.upto + 1))
            assert seen == list(range(q)), (fan, tiers, q)
        if tiers > 1:
            assert max(sum(s.upto < q <= s.until for s in shards) for q in range(1, len(nodes))) < len(nodes) - 1
    assert shard_schedule([], 4, 3) == [] and shards[0].centres == 8


@pytest.mark.parametrize("n", [1, 2, 65, 1500])
def test_graph_recall_against_exhaustive_search(n):
    rng = np.random.default_rng(n)
    base = rng.standard_normal((n, 64)).astype(np.float32)
    near = base[rng.integers(0, n, 200)] + 0.45 * rng.standard_normal((200, 64)).astype(np.float32)
    plane = rng.standard_normal((64, 256)).astype(np.float32)

    def views(x):
        v = x @ plane
        short = v[:, :48] / np.linalg.norm(v[:, :48], axis=1, keepdims=True)
        return short.astype(np.float32), np.packbits(v > 0, axis=1).view(np.uint64)

    graph = nsw.Graph.build(*views(base))
    queries = views(near)
    graph.tune(queries, 60)
    truth = {(i, int(j)) for i in range(200) for j in np.flatnonzero(nsw.hamming(queries[1][i][None], graph.sketches) <= 60)}
    got = set(zip(*(x.tolist() for x in graph.search(*queries, 60))))
    assert got <= truth and len(got) >= 0.98 * len(truth)
    assert graph.beam <= len(graph.starts) - 1 and sorted(np.unique(graph.members).tolist()) == list(range(n))
    again = nsw.Graph.from_bytes(graph.to_bytes())
    assert set(zip(*(x.tolist() for x in again.search(*queries, 60)))) == got


def test_crowded_neighbourhood_is_found_whole():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((1, 12)) + 0.01 * rng.standard_normal((700, 12))
    v = np.vstack([v, rng.standard_normal((300, 12))])
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    bits = np.zeros((1000, 4), np.uint64)
    bits[700:] = rng.integers(0, 2**63, (300, 4))
    graph = nsw.Graph.build(v, bits)
    query, node = graph.search(v[:1], bits[:1], 10, beam=8)
    assert set(node.tolist()) == set(range(700))


def test_sketch_distance_follows_similarity():
    a = " ".join(f"a{i}" for i in range(200))
    b = " ".join(f"a{i}" if i % 13 else "z" for i in range(200))
    grams, singles = shingle_sets([a, b, "other words entirely here now", None, ""], 3)
    vectors, bits = sketches(grams, singles)
    assert 0.55 < jaccard(grams[0], grams[1]) < 0.7
    assert nsw.hamming(bits[0][None], bits[1][None])[0] < 72 < nsw.hamming(bits[0][None], bits[2][None])[0]
    assert not bits[3].any() and not vectors[4].any() and words(None) == [] and words("Ä_b1-C") == ["ä", "b1", "c"]
    assert len(shingle_sets(["a b c", "a b"], 3)[0][0]) == 1 and len(shingle_sets(["a b c", "a b"], 3)[0][1]) == 0


def test_expand_large_group(spark):
    rows = spark.range(3000).select(F.lit("k").alias("key"), F.col("id").alias("entry_id"), (F.col("id") % 2).alias("batch_no"), F.lit(True).alias("is_new"))
    assert expand_pairs(rows).distinct().count() == 1500 * 1500


def test_probes_are_as_hard_as_pairs_at_the_limit():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**63, 200).astype(np.uint64) for _ in range(400)]
    near = [np.concatenate([s[:154], rng.integers(0, 2**63, 46).astype(np.uint64)]) for s in sets]
    assert 0.61 < jaccard(np.sort(sets[0]), np.sort(near[0])) < 0.64
    none = [np.empty(0, np.uint64)] * 400
    (v, b), (w, c) = sketches(sets, none), sketches(near, none)
    probes, bits, pick = dedup_index._probes(v, b, most=400)
    cosine, gap = (probes * v[pick]).sum(axis=1), nsw.hamming(bits, b[pick])
    assert np.quantile(cosine, 0.05) < np.median((v * w).sum(axis=1)) and np.quantile(gap, 0.95) > np.median(nsw.hamming(b, c)) - 2


def test_late_entries_of_known_batches(spark):
    text = [" ".join(f"{t}{i}" for i in range(60)) for t in "abc"]
    docs = [(10 * t + k, f"{own} end{k}", "x") for t, own in enumerate(text) for k in range(3)]
    waves = [[(1, 1, None, 0), (2, 3, None, 10)], [(3, 1, None, 11), (4, 2, None, 20)], [(5, 3, None, 21), (6, 4, None, 12)]]
    index = DedupIndex(spark, new_path(spark, "test-late"))
    got = [sorted(tuple(r) for r in index.ingest(*frames(spark, wave, docs)).collect()) for wave in waves]
    assert got == [[], [(2, 3)], [(2, 6), (3, 6), (4, 5)]]
