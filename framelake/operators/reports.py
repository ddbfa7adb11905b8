"""Counts and summaries of a library or a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.text import format_bytes_report, percentage, reason_code, reason_text
from framelake.operators.lookup import lookup_join
from framelake.operators.ranking import spread_rank

# Fixed values.
PHOTO_EXTENSIONS = (".jpg", ".jpeg", ".png", ".heic", ".gif", ".bmp", ".tiff", ".tif", ".cr2", ".cr3", ".nef", ".arw", ".dng", ".orf", ".rw2", ".raf", ".pef", ".srw")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".wmv", ".m4v", ".webm", ".flv", ".3gp", ".mts", ".m2ts")
LEVELS = ("district", "city", "county", "state", "country")
OTHER, NO_EXTENSION = "(other)", "(no extension)"


def location_counts(files: DataFrame) -> DataFrame:
    """``level, key, n``: files by value of each location level, without case; null and blank values don't count."""
    pairs = F.array(*[F.struct(F.lit(v).alias("level"), F.lower(F.col(f"location.{v}")).alias("key")) for v in LEVELS])
    return files.where("location is not null").select(F.inline(pairs)).where(F.trim("key") != "").groupBy("level", "key").agg(F.count(F.lit(1)).alias("n"))


def copy_statistics(files: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: files, photos, videos, located, distinct countries and cities (without case), bytes, dates."""
    ext = F.lower("ext")
    city = F.coalesce("location.city", "location.district")
    # Partial sums by (country, city) first, which is combined before the shuffle; then few rows are left to count apart.
    keyed = files.groupBy(F.when(F.trim("location.country") != "", F.lower("location.country")).alias("country"), F.when(F.trim(city) != "", F.lower(city)).alias("city")).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(ext.isin(*PHOTO_EXTENSIONS)).alias("photos"), F.count_if(ext.isin(*VIDEO_EXTENSIONS)).alias("videos"),
        F.count_if(F.col("location").isNotNull()).alias("located"), F.sum("length").alias("bytes"), F.min(F.unix_micros(ts)).alias("earliest"), F.max(F.unix_micros(ts)).alias("latest"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return keyed.agg(
        total("files").alias("total_files"), total("photos").alias("photos"), total("videos").alias("videos"), total("located").alias("with_location"),
        F.count_distinct("country").alias("countries"), F.count_distinct("city").alias("cities"), total("bytes").alias("total_bytes"),
        F.min("earliest").alias("earliest_us"), F.max("latest").alias("latest_us"),
    )


def extension_breakdown(files: DataFrame) -> DataFrame:
    """``ext, n`` without case; files without extension are left out."""
    return files.where(F.col("ext") != "").groupBy(F.lower("ext").alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def top_with_other(counts: DataFrame, key: str, k: int) -> DataFrame:
    """``key, n, percent``: the k most frequent keys (ties by key) and one row for all others.

    The top k are found by a sort with a limit, which keeps k rows of each task, and the rest is a total less
    the top: no task sees all keys.
    """
    top = counts.orderBy(F.desc("n"), key).limit(k)
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).withColumn("_one", F.lit(1))
    of_top = top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("held")).withColumn("_one", F.lit(1))
    rest = whole.join(F.broadcast(of_top), "_one").where("total > held").select(F.lit(OTHER).alias(key), (F.col("total") - F.col("held")).alias("n"))
    listed = top.select(key, "n").unionByName(rest).withColumn("_one", F.lit(1))
    return listed.join(F.broadcast(whole), "_one").select(key, F.col("n").cast("bigint").alias("n"), percentage(F.col("n"), F.col("total")).alias("percent"))


def unknown_report(files: DataFrame) -> DataFrame:
    """``kind, key, n``: files without location by reason and by extension, in one pass."""
    keys = F.array(
        F.struct(F.lit("reason").alias("kind"), F.col("unknown_reason").alias("key")),
        F.struct(F.lit("extension").alias("kind"), F.when(F.coalesce("ext", F.lit("")) == "", NO_EXTENSION).otherwise(F.lower("ext")).alias("key")),
    )
    return files.where(F.col("location").isNull() & (F.col("unknown_reason") != "None")).select(F.inline(keys)).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))


def unknown_files(files: DataFrame) -> DataFrame:
    """``file_id, name, reason_text, reason_code`` of the files the report counts."""
    return files.where(F.col("location").isNull() & (F.col("unknown_reason") != "None")).select(
        "file_id", "name", reason_text(F.col("unknown_reason")).alias("reason_text"), reason_code(F.col("unknown_reason")).alias("reason_code")
    )


def running_progress(operations: DataFrame, batch: str, order: str, size: str) -> DataFrame:
    """Adds ``done, done_bytes, percent`` in the order of ``order`` within each ``batch``; null sizes count as 0.

    The order is cut into ranges whose totals are added up, so a batch of any size is spread over all tasks.
    """
    whole = operations.groupBy(batch).agg(F.count(F.lit(1)).alias("_all"))
    out = spread_rank(operations, [batch], [order], "done", sums={"done_bytes": size})
    return lookup_join(out, whole, [batch], "inner").withColumn("percent", percentage(F.col("done"), F.col("_all"))).drop("_all")


def remaining_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Elapsed time for each finished item times what is left; null before the first."""
    return F.try_divide(elapsed, done) * (total - done)


def remaining_seconds_of(done: int, total: int, elapsed: float) -> float | None:
    """As :func:`remaining_seconds` for one run on the driver."""
    return round(elapsed / done * (total - done), 1) if done else None


def first_rows(rows: DataFrame, order: str, most: int = 100) -> tuple[list, int]:
    """The first ``most`` rows by ``order``, and how many there are beyond them."""
    return rows.orderBy(order).limit(most).collect(), max(0, rows.count() - most)


def unknown_text(files: DataFrame, most: int = 100) -> str:
    """The report of files without location: by reason, by extension, and the first ``most`` with "and N more"."""
    counts = unknown_report(files).collect()
    lines = [f"Files without location: {sum(r['n'] for r in counts if r['kind'] == 'reason'):,}"]
    for kind in ("reason", "extension"):
        of = sorted((r for r in counts if r["kind"] == kind), key=lambda r: (-r["n"], r["key"]))
        lines += [f"By {kind}:", *(f"  {r['key']}: {r['n']:,}" for r in of)]
    shown, more = first_rows(unknown_files(files), "name", most)
    lines += ["Files:", *(f"  [{r['reason_code']}] {r['name']}: {r['reason_text']}" for r in shown), *([f"  ... and {more:,} more"] if more else [])]
    return "\n".join(lines)


def summary_text(stats: DataFrame, files: DataFrame | None = None, most: int = 15) -> str:
    """A one-row frame of :func:`copy_statistics` as a report; with ``files``, also the most frequent extensions, countries and cities."""
    r = stats.withColumn("size", format_bytes_report(F.col("total_bytes"))).first()
    lines = [f"Files: {r['total_files']:,}  Photos: {r['photos']:,}  Videos: {r['videos']:,}", f"With location: {r['with_location']:,}  Countries: {r['countries']:,}  Cities: {r['cities']:,}", f"Size: {r['size']}"]
    if files is not None:
        counts = location_counts(files)
        tops = {"extension": top_with_other(extension_breakdown(files), "ext", most).withColumnRenamed("ext", "key")}
        tops |= {level: top_with_other(counts.where(F.col("level") == level).select("key", "n"), "key", most) for level in ("country", "city")}
        for title, top in tops.items():
            rows = sorted(top.collect(), key=lambda r: (r["key"] == OTHER, -r["n"], r["key"]))
            lines += [f"By {title}:", *(f"  {r['key']}: {r['n']:,} ({r['percent']}%)" for r in rows)] if rows else []
    return "\n".join(lines)
