import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.llm.mixture import mixture, water_fill

DOCS = "doc_id bigint, text string, source string, tokens string, uses int"
TARGETS = "source string, target_weight double, max_repeats int, key string"

names = st.sampled_from("abcdef")


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(names, st.tuples(st.floats(0, 100), st.integers(0, 5)), max_size=6), st.dictionaries(names, st.integers(0, 1000), max_size=6))
def test_water_fill(targets, available):
    shares = {s.source: s for s in water_fill(targets, available)}
    total = sum(available.get(s, 0) for s, (w, _) in targets.items() if w > 0)
    assert sum(s.size for s in shares.values()) <= total + 1e-6
    free = []
    for name, s in shares.items():
        cap = targets[name][1] * available.get(name, 0)
        assert 0 <= s.size <= cap + 1e-6
        if targets[name][0] > 1e-9 and s.size < cap - 1e-6:
            free.append(s.size / targets[name][0])
    assert not free or max(free) - min(free) <= 1e-6 * max(1.0, max(free))  # the sources below their cap keep their proportions
    if free:
        assert abs(sum(s.size for s in shares.values()) - total) < 1e-3


def test_caps_and_redistribution():
    got = {s.source: round(s.size) for s in water_fill({"a": (1, 10), "b": (1, 1), "c": (2, 1)}, {"a": 100, "b": 100, "c": 1000}, 1000)}
    assert got == {"a": 300, "b": 100, "c": 600}


def run(spark, docs, targets, **kw):
    return mixture(spark, spark.createDataFrame([(*d, "clash", 0) for d in docs], DOCS), spark.createDataFrame([(*t, "clash") for t in targets], TARGETS), **kw)


def test_mixture_shares_and_repeats(spark):
    docs = [(i, "some words to read " * (1 + i % 5), ["big", "BIG ", "b-ig", "small", "other", None][0 if i % 3 else (i // 3) % 6]) for i in range(3000)]
    targets = [("big", 5.0, 1), ("small", 4.0, 3), ("ghost", 1.0, 4), ("small", 1.0, 9), (None, 9.0, 1), ("zero", 0.0, 1)]
    used, shares = run(spark, docs, targets, total=9000.0)
    by = {r.source: r for r in shares.collect()}
    assert by["small"].target_share == 0.4 and by["ghost"].mixture_tokens == 0 and by["other"].target_share == 0 and by["other"].mixture_tokens == 0
    assert used.agg(F.max(F.when(F.col("source") == "small", F.col("uses")))).first()[0] <= 3 and used.where("source = 'big'").agg(F.max("uses")).first()[0] == 1
    assert abs(by["big"].mixture_tokens - 5000) < 60 and abs(by["small"].mixture_tokens - 4000) < 60
    assert used.where("source = 'other'").count() == 0
    again = run(spark, docs, targets, total=9000.0)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, used.collect()))
    other = run(spark, docs, targets, total=9000.0, seed=1)[0]
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, used.collect()))


@pytest.mark.parametrize("docs, targets", [([], [("a", 1.0, 1)]), ([(1, "x y", "a")], []), ([(1, None, "a"), (2, "", "a")], [("a", 1.0, 2)]), ([(1, "x y", "a")], [("a", None, None)])])
def test_nothing_to_mix(spark, docs, targets):
    used, shares = run(spark, docs, targets)
    assert used.count() == 0 and shares.where("mixture_tokens > 0").count() == 0
