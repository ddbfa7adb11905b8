"""How demanding a text is to read, learnt from raters' opinions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import gbrt
from framelake.llm.mixture import clean_source
from framelake.llm.text_features import NAMES, feature_rows

#: The school years that stand for a band, and the bands in order.
GRADES = {"low": 2.0, "mid": 8.5, "high": 15.0}
BANDS = ("low", "mid", "high")
#: Most labelled documents a model is fitted on, the ones that come first in a seeded order.
MOST_LABELLED = 20_000
FOLDS = 5
#: Tasks that compute the features of the labelled documents.
TRAINING_TASKS = 24


@dataclass
class Reader:
    """A fitted model, the calibration of its raw grades, and the grades at which the bands part.

    Without any labelled document there is no model; grades are then NaN and bands None.
    """

    model: gbrt.Model | None
    knots: tuple[np.ndarray, np.ndarray]
    limits: tuple[float, float]

    def grades(self, x: np.ndarray) -> np.ndarray:
        if self.model is None:
            return np.full(len(x), np.nan)
        return np.interp(self.model.predict(x), *self.knots)

    def bands(self, grades: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(grades), None, np.array(BANDS, dtype=object)[np.searchsorted(self.limits, grades, side="right") % len(BANDS)])


def readable(documents: DataFrame) -> DataFrame:
    """Documents with lang exactly ``en`` and a text that is more than white space."""
    return documents.where((F.col("lang") == "en") & F.col("text").rlike(r"\S"))


def opinions(labels: DataFrame) -> DataFrame:
    """``doc_id, grade, raters``: the mean grade of a document's raters, each rater's last opinion once.

    Bands are trimmed and compared without case; other values and nulls don't count, nor do rows without
    doc_id. Rows without rater count as one rater.
    """
    band = F.lower(F.trim("band"))
    known = labels.where(band.isin(*BANDS) & F.col("doc_id").isNotNull())
    last = known.groupBy("doc_id", "rater").agg(F.max(F.struct("labelled_at", band.alias("band"))).alias("m"))
    grade = F.element_at(F.create_map(*[x for b, g in GRADES.items() for x in (F.lit(b), F.lit(g))]), F.col("m.band"))
    return last.groupBy("doc_id").agg(F.avg(grade).alias("grade"), F.count(F.lit(1)).cast("double").alias("raters"))


def _with_features(documents: DataFrame, keep: list[str]) -> DataFrame:
    kinds = {n: documents.schema[n].dataType.simpleString() for n in keep}
    schema = ", ".join([*(f"{n} {t}" for n, t in kinds.items()), "x array<float>"])

    def run(batches):
        for batch in batches:
            rows = feature_rows(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(list(rows), pa.list_(pa.float32()))], names=[*keep, "x"])

    return documents.select(*keep, "text").mapInArrow(run, schema)


def labelled_rows(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``doc_id, source, grade, raters, x`` of at most ``most`` labelled documents, by a seeded order."""
    texts = readable(documents).select("doc_id", clean_source(F.col("source")).alias("source"), "text")
    # The choice is made on ids, so no task gathers texts; it has at most ``most`` rows and may be broadcast.
    rated = texts.select("doc_id").join(opinions(labels), "doc_id").distinct()
    picked = rated.orderBy(F.xxhash64("doc_id", F.lit(31)), "doc_id").limit(most)
    return _with_features(texts.join(F.broadcast(picked), "doc_id").repartition(TRAINING_TASKS, "doc_id"), ["doc_id", "source", "grade", "raters"])


def fold_of(sources: pd.Series, folds: int = FOLDS) -> np.ndarray:
    """A fold for each row such that a source lies in one fold, the largest source first to the emptiest fold.

    Where all rows are of one source, they are dealt out in turn instead.
    """
    named = sources.fillna("")
    if named.nunique() < 2:
        return np.arange(len(named)) % folds
    held = np.zeros(folds)
    fold = {}
    for source, n in named.value_counts(sort=False).sort_index().sort_values(ascending=False, kind="stable").items():
        fold[source] = int(held.argmin())
        held[fold[source]] += n
    return named.map(fold).to_numpy()


def _held_out(spark, pdf: pd.DataFrame, left_out: list[tuple[int, ...]]) -> pd.DataFrame:
    """``model, row, raw``: of each set of folds left out of a fit, the raw grades of their rows; one task for each fit."""
    x = np.array(pdf["x"].tolist(), dtype=np.float32).reshape(-1, len(NAMES))
    held = spark.sparkContext.broadcast((x, pdf["grade"].to_numpy(), pdf["raters"].to_numpy(), pdf["fold"].to_numpy(), left_out))

    def run(batches):
        for batch in batches:
            for model in batch["model"]:
                x, y, w, fold, left_out = held.value
                out = np.isin(fold, left_out[model])
                test = np.flatnonzero(out)
                if len(test) and not out.all():
                    yield pd.DataFrame({"model": model, "row": test, "raw": gbrt.fit(x[~out], y[~out], w[~out]).predict(x[test])})

    tasks = spark.createDataFrame([(i,) for i in range(len(left_out))], "model int").repartitionByRange(len(left_out), "model")
    return tasks.mapInPandas(run, "model int, row bigint, raw double").toPandas()


def cross_validated(rows: DataFrame) -> pd.DataFrame:
    """``doc_id, source, grade, raters, x, fold, raw``: raw is the grade by a model fitted without the row's fold.

    Folds go by source. A row has no raw grade only where there is no row outside its fold. At most MOST_LABELLED
    rows come to the driver.
    """
    pdf = rows.toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)
    pdf["fold"] = fold_of(pdf["source"])
    if pdf.empty:
        return pdf.assign(raw=np.nan)
    raw = _held_out(rows.sparkSession, pdf, [(f,) for f in range(FOLDS)]).set_index("row")["raw"]
    return pdf.assign(raw=raw.reindex(range(len(pdf))).to_numpy())


def _calibration(checked: pd.DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], tuple[float, float]]:
    """Knots and limits of rows ``raw, grade, raters``; those without a raw grade don't count."""
    known = checked[checked["raw"].notna()]
    y, w = known["grade"].to_numpy(), known["raters"].to_numpy()
    knots = gbrt.isotonic(known["raw"].to_numpy(), y, w)
    return knots, _best_limits(np.interp(known["raw"], *knots), y, w)


def _best_limits(grades: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The two grades that part the bands with the fewest disagreements with the raters."""
    nearest = np.abs(truth[:, None] - np.array([GRADES[b] for b in BANDS])).argmin(axis=1)
    limits = []
    for k in (1, 2):
        middle = (GRADES[BANDS[k - 1]] + GRADES[BANDS[k]]) / 2
        tried = np.linspace(GRADES[BANDS[k - 1]] + 1, GRADES[BANDS[k]] - 1, 45)
        wrong = np.array([(weight * ((grades >= t) != (nearest >= k))).sum() for t in tried])
        best = tried[wrong <= wrong.min() + 1e-9]
        limits.append(float(best[np.abs(best - middle).argmin()]))
    return limits[0], max(limits)


def train(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[Reader, pd.DataFrame]:
    """The reader and the cross-validation it was calibrated by."""
    checked = cross_validated(labelled_rows(documents, labels, most))
    knots, limits = _calibration(checked)
    x = np.array(checked["x"].tolist(), dtype=np.float32).reshape(-1, len(NAMES))
    model = gbrt.fit(x, checked["grade"].to_numpy(), checked["raters"].to_numpy()) if len(checked) else None
    return Reader(model, knots, limits), checked


def nested_validation(spark, checked: pd.DataFrame) -> pd.DataFrame:
    """Adds ``calibrated`` and ``band`` of rows that neither the model, nor the calibration, nor the limits have seen.

    ``checked`` is what :func:`cross_validated` gives. For an outer fold the calibration and the limits come from the
    other folds, whose raw grades are by models fitted without the outer fold and their own: one model for each pair of
    folds. Rows of a fold that leaves no other with a raw grade have neither.
    """
    out = checked.assign(calibrated=np.nan, band=None)
    if checked.empty:
        return out
    pairs = [(f, g) for f in range(FOLDS) for g in range(f)]
    raw = _held_out(spark, checked, pairs)
    for f in range(FOLDS):
        own = raw[raw["model"].isin([i for i, p in enumerate(pairs) if f in p])]
        inner = checked.loc[own["row"]].assign(raw=own["raw"].to_numpy())
        inner = inner[inner["fold"] != f]
        outer = checked.index[(checked["fold"] == f) & checked["raw"].notna()]
        if len(inner) and len(outer):
            knots, limits = _calibration(inner)
            grades = np.interp(checked.loc[outer, "raw"], *knots)
            out.loc[outer, "calibrated"] = grades
            out.loc[outer, "band"] = Reader(None, knots, limits).bands(grades)
    return out


def graded(documents: DataFrame, reader: Reader) -> DataFrame:
    """``doc_id, source, grade, band`` of every readable document; a repeated document is graded each time.

    Grade and band are null where the reader was trained on no labelled document.
    """
    held = documents.sparkSession.sparkContext.broadcast(reader)
    out = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("grade", pa.float64()), ("band", pa.string())])

    def run(batches):
        for batch in batches:
            grades = held.value.grades(feature_rows(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grades, pa.float64(), from_pandas=True), pa.array(held.value.bands(grades).tolist(), pa.string())], schema=out)

    texts = readable(documents).select(F.col("doc_id").cast("bigint"), clean_source(F.col("source")).alias("source"), "text")
    return texts.mapInArrow(run, "doc_id bigint, source string, grade double, band string")


def profile(grades: DataFrame) -> DataFrame:
    """``source, documents, mean_grade, low, mid, high`` of the corpus."""
    counts = [F.count_if(F.col("band") == b).alias(b) for b in BANDS]
    return grades.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("grade"), 3).alias("mean_grade"), *counts)


def validation_report(spark, checked: pd.DataFrame) -> DataFrame:
    """``source, documents, mean_error, agreement`` of the labelled documents, by :func:`nested_validation`.

    ``agreement`` is the share whose band is the one nearest to its raters' mean.
    """
    schema = "source string, documents bigint, mean_error double, agreement double"
    known = nested_validation(spark, checked)
    known = known[known["band"].notna()]
    if known.empty:
        return spark.createDataFrame([], schema)
    nearest = np.array(BANDS)[np.abs(known["grade"].to_numpy()[:, None] - np.array([GRADES[b] for b in BANDS])).argmin(axis=1)]
    rows = pd.DataFrame({"source": known["source"].fillna(""), "error": (known["calibrated"] - known["grade"]).abs(), "right": known["band"].to_numpy() == nearest})
    by = rows.groupby("source").agg(documents=("right", "size"), mean_error=("error", "mean"), agreement=("right", "mean")).reset_index()
    return spark.createDataFrame(by.round(4), schema)
