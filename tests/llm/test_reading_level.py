from datetime import datetime

import numpy as np

from framelake.llm import gbrt
from framelake.llm.reading_level import FOLDS, MOST_LABELLED, cross_validated, fold_of, graded, labelled_rows, nested_validation, opinions, profile, train, validation_report
from framelake.llm.text_features import NAMES, feature_rows
from framelake.session import table


def test_trees_learn_and_generalise():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (1500, 6)).astype(np.float32)
    y = np.where(x[:, 0] > 0.2, 3.0, 0.0) + 2 * x[:, 1] * (x[:, 2] > 0) + rng.normal(0, 0.1, 1500)
    model = gbrt.fit(x[:1000], y[:1000], np.ones(1000))
    assert np.mean((model.predict(x[1000:]) - y[1000:]) ** 2) < 0.1 * y.var()
    assert np.allclose(gbrt.fit(x[:1], y[:1], np.ones(1)).predict(x[:3]), y[0])
    assert np.allclose(gbrt.fit(x[:50], np.full(50, 4.0), np.ones(50)).predict(x[:3]), 4.0)


def test_isotonic():
    x, y = np.array([1.0, 2, 3, 4, 5]), np.array([1.0, 3, 2, 4, 4])
    knots = gbrt.isotonic(x, y, np.ones(5))
    assert np.allclose(np.interp(x, *knots), [1, 2.5, 2.5, 4, 4])


def test_features_of_odd_texts():
    odd = ["", "   ", "!!!", "a", "IMG_0001.jpg /a/b.png", "No stop at all and so on", "1) one\n2) two", "É " * 50_000, "x" * 300_000, "😀 🙂 fine", "\x1e"]
    f = feature_rows(odd)
    assert f.shape == (len(odd), len(NAMES)) and np.isfinite(f).all() and not f[:3].any()
    assert np.allclose(f, np.concatenate([feature_rows([t]) for t in odd]), atol=1e-4)  # a text's features depend on no other's
    easy, hard = feature_rows(["The cat sat. The dog ran. We had fun.", "Notwithstanding the epistemological heterogeneity of contemporary documentation, practitioners privilege methodological granularity."])
    assert hard[NAMES.index("flesch_kincaid")] > easy[NAMES.index("flesch_kincaid")] + 10
    assert feature_rows([]).shape == (0, len(NAMES))


def test_features_by_hand():
    text = "Anna, who was tired, had been carried home. Is the home far? See /tmp/a.txt now!"
    f = dict(zip(NAMES, feature_rows([text])[0].tolist(), strict=True))
    close = lambda a, b: abs(a - b) < 1e-4
    # Sentences of 8, 4 and 2 words: anna who was tired had been carried home | is the home far | see now.
    assert close(f["log_words"], np.log1p(14)) and close(f["log_sentences"], np.log1p(3)) and close(f["sentence_words_50"], 4)
    assert close(f["commas"], 2 / 3) and close(f["questions"], 1 / 3) and close(f["exclamations"], 1 / 3) and close(f["auxiliaries"], 4 / 14)
    assert close(f["subordinated_sentences"], 1 / 3) and close(f["passives"], 2 / 3)
    assert close(f["words_before_auxiliary"], (2 + 0 + 2) / 3)
    assert close(f["overlap_mean"], 0.5 * (1 / 5)) and close(f["overlap_share"], 0.5)  # "home" of anna, tired, been, carried, home
    assert close(f["once_only"], 12 / 13)


def test_opinions(spark):
    t = datetime(2025, 1, 1)
    rows = [(1, "a", "low", t), (1, "a", " HIGH", datetime(2025, 2, 1)), (1, "b", "high", t), (1, "b", "high", t), (2, None, "mid", t), (3, "a", None, t), (4, "a", "hard", t), (None, "a", "low", t)]
    got = {r.doc_id: (r.grade, r.raters) for r in opinions(spark.createDataFrame(rows, "doc_id bigint, rater string, band string, labelled_at timestamp")).collect()}
    assert got == {1: (15.0, 2.0), 2: (8.5, 1.0)}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    documents, labels = table(spark, d, "documents"), table(spark, d, "reading_labels")
    reader, checked = train(documents, labels)
    nested = nested_validation(spark, checked)
    assert nested["band"].notna().all() and checked["fold"].nunique() == FOLDS
    sure = nested[(nested["raters"] >= 2) & nested["grade"].isin([2.0, 8.5, 15.0])]
    want = sure["grade"].map({2.0: "low", 8.5: "mid", 15.0: "high"}).to_numpy()
    assert len(sure) > 20 and (sure["band"].to_numpy() == want).mean() > 0.9
    bands = graded(documents, reader)
    en = documents.where("lang = 'en' and text rlike '\\\\S'")
    assert bands.count() == en.count() and profile(bands).count() > 3 and validation_report(spark, checked).count() > 3
    assert labelled_rows(documents, labels, 10).count() == 10 and MOST_LABELLED >= 1000


def test_few_labels_none_and_empty(spark):
    d = "/root/testdata/sf0.001"
    documents, labels = table(spark, d, "documents"), table(spark, d, "reading_labels")
    reader, checked = train(documents, labels)
    assert 2 < len(checked) < 30 and reader.model is not None and graded(documents, reader).where("band is null").count() == 0
    one = labels.where(labels.doc_id == int(checked["doc_id"].iloc[0]))
    reader, checked = train(documents, one)
    assert len(checked) == 1 and checked["raw"].isna().all() and len({r.grade for r in graded(documents, reader).collect()}) == 1
    reader, checked = train(documents, labels.limit(0))
    assert reader.model is None and len(checked) == 0
    rows = graded(documents, reader)
    assert rows.count() == rows.where("band is null and grade is null").count() > 0
    assert graded(documents.limit(0), reader).count() == 0 and validation_report(spark, checked).count() == 0
    assert len(cross_validated(labelled_rows(documents.limit(0), labels))) == 0


def test_a_source_lies_in_one_fold():
    import pandas as pd

    sources = pd.Series(["a"] * 50 + ["b"] * 30 + ["c"] * 20 + ["d"] * 20 + ["e", None])
    fold = fold_of(sources, 3)
    assert sorted(fold_of(pd.Series(["a"] * 10), 5).tolist()) == sorted(list(range(5)) * 2)
    assert all(len(set(fold[(sources.fillna("") == s).to_numpy()])) == 1 for s in sources.fillna("").unique())
