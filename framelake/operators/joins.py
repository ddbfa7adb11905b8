"""Joins between files: pairs, related files, sidecars, borrowed positions, existing and duplicate files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values.
PAIR_PHOTOS = (".heic", ".heif", ".jpg", ".jpeg")
PAIR_VIDEOS = (".mov",)


def live_pairs(files: DataFrame) -> DataFrame:
    """Videos take the location of the photo of the same folder and stem (without case) if they have none.

    Needs ``file_id, dir, stem, ext, path, location, unknown_reason, ts_source``. Of several photos the
    first by path wins, but one with a location before one without; photos with neither a location nor a
    date of their own are no partners. Returns the files with ``location`` and ``unknown_reason`` updated
    and ``paired_with`` (the photo's file_id, null where nothing was taken over).
    """
    key = [F.col("dir").alias("_dir"), F.lower("stem").alias("_stem")]
    worth = F.lower("ext").isin(*PAIR_PHOTOS) & (F.col("location").isNotNull() | (F.col("ts_source") != "created"))
    # min over a struct combines before the shuffle; a window would move every photo of a stem.
    best = F.min(F.struct(F.col("location").isNull().alias("bare"), "path", "file_id", "location"))
    photos = files.where(worth).groupBy(*key).agg(best.alias("_photo"))
    video = F.lower("ext").isin(*PAIR_VIDEOS) & F.col("location").isNull()
    joined = files.join(photos, (F.col("dir") == F.col("_dir")) & (F.lower("stem") == F.col("_stem")) & video, "left")
    got = F.col("_photo.location").isNotNull()
    return joined.withColumns(
        {
            "location": F.coalesce("location", "_photo.location"),
            "unknown_reason": F.when(got, F.lit("None")).otherwise(F.col("unknown_reason")),
            "paired_with": F.when(got, F.col("_photo.file_id")),
        }
    ).drop("_dir", "_stem", "_photo")


def nearest_position(files: DataFrame, window_minutes: int | None, seconds: Column | None = None) -> DataFrame:
    """``file_id, from_id, lat, lon, gap_us``: for rows without coordinates the nearest in time that has some.

    Needs ``file_id, ts, lat, lon, needs_position``. The gap is at most the window, inclusive; ties go to the
    later candidate, then to the smaller file_id. Each candidate is put into its bucket of one window's width
    and both next to it, so rows meet their candidates by an equi-join; of the candidates of a bucket and
    instant only the smallest id is kept, which loses nothing. No window or one of 0 gives no rows.
    """
    span = (window_minutes or 0) * 60_000_000
    bucket = lambda c: F.floor(c / F.lit(max(span, 1)))
    timed = files.where(F.col("ts").isNotNull()).withColumn("_us", F.unix_micros("ts"))
    if span <= 0:
        timed = timed.where(F.lit(False))
    have = timed.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy("_us").agg(F.min(F.struct("file_id", "lat", "lon")).alias("_c"))
    near = have.select(F.col("_us").alias("_cus"), "_c", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bucket(F.col("_us")) + d)).alias("_b"))
    asking = timed.where("needs_position").select("file_id", "_us")
    # Instants, not rows, are searched, so many files of one instant are one lookup; both sides lie on one
    # timeline and the nearest before and after come by window, per bucket.
    none = F.lit(None).cast("struct<file_id:bigint,lat:double,lon:double>")
    instants = asking.select("_us").distinct().select(bucket(F.col("_us")).alias("_b"), "_us", F.lit(1).alias("_ask"), none.alias("_c"))
    events = instants.unionByName(near.select("_b", F.col("_cus").alias("_us"), F.lit(0).alias("_ask"), "_c"))
    at = F.when(F.col("_c").isNotNull(), F.struct(F.col("_us").alias("us"), F.col("_c").alias("c")))
    before = F.last(at, ignorenulls=True).over(W.partitionBy("_b").orderBy("_us", "_ask").rowsBetween(W.unboundedPreceding, 0))
    after = F.last(at, ignorenulls=True).over(W.partitionBy("_b").orderBy(F.desc("_us"), "_ask").rowsBetween(W.unboundedPreceding, 0))
    found = events.withColumns({"_before": before, "_after": after}).where("_ask = 1")
    back, ahead = F.col("_us") - F.col("_before.us"), F.col("_after.us") - F.col("_us")
    later = F.col("_after").isNotNull() & (F.col("_before").isNull() | (ahead <= back))
    picked = found.select("_us", F.when(later, F.col("_after")).otherwise(F.col("_before")).alias("_p"), F.when(later, ahead).otherwise(back).alias("gap_us")).where(F.col("gap_us") <= span)
    return asking.join(picked, "_us").select("file_id", F.col("_p.c.file_id").alias("from_id"), F.col("_p.c.lat").alias("lat"), F.col("_p.c.lon").alias("lon"), "gap_us")


def related_files(files: DataFrame, mode: str = "strict") -> DataFrame:
    """``main_id, related_id`` of files of one folder whose names belong together, without case.

    ``strict``: the related name starts with the main stem and ``.`` or ``_``, or has the same stem;
    ``loose``: the related stem starts with the main stem. Every prefix of a stem that can be a main stem
    becomes a join key, so the join is an equi-join and no folder's files meet all pairwise.
    """
    if mode not in ("none", "strict", "loose"):
        raise ValueError(f"unknown mode {mode!r}")
    mains = files.select(F.col("file_id").alias("main_id"), F.lower("path").alias("_main"), "dir", F.lower("stem").alias("_key"))
    stem, name = F.lower("stem"), F.lower("name")
    lengths = F.sequence(F.lit(1), F.greatest(F.length(stem), F.lit(1)))
    prefixes = F.transform(lengths, lambda n: F.substring(stem, F.lit(1), n))
    if mode == "strict":
        prefixes = F.filter(prefixes, lambda p: (p == stem) | F.substring(name, F.length(p) + 1, F.lit(1)).isin(".", "_"))
    others = files.select(F.col("file_id").alias("related_id"), F.lower("path").alias("_other"), "dir", F.explode(F.array_distinct(prefixes)).alias("_key"))
    if mode == "none":
        others = others.where(F.lit(False))
    return mains.join(others, ["dir", "_key"]).where(F.col("_main") != F.col("_other")).select("main_id", "related_id")


def related_destination(main_name: Column, main_destination: Column, related_name: Column) -> Column:
    """Where a related file goes beside its main file's destination."""
    stem = lambda n: F.regexp_replace(n, r"\.[^.]*$", "")
    ext = F.regexp_extract(related_name, r"(\.[^.]*)$", 1)
    folder = F.regexp_extract(main_destination, r"^(.*/)?[^/]*$", 1)
    last = F.regexp_extract(main_destination, r"([^/]*)$", 1)
    suffix = F.when(stem(related_name).startswith(stem(main_name)), F.substring(stem(related_name), F.length(stem(main_name)) + 1, F.lit(1 << 30))).otherwise(F.lit(""))
    return F.when(related_name == F.concat(main_name, ext), F.concat(folder, last, ext)).otherwise(F.concat(folder, stem(last), suffix, ext))


def sidecar_matches(files: DataFrame, sidecars: DataFrame, extensions: tuple[str, ...] = (".xmp", ".json")) -> DataFrame:
    """``file_id, sidecar_path``: of each file the first sidecar by extension, ``name + ext`` before ``stem + ext``.

    Both frames have ``dir, name`` (files also ``file_id, stem``); names compare without case.
    """
    tries = [(n, i * 2 + j, e) for i, e in enumerate(extensions) for j, n in enumerate(("name", "stem"))]
    wanted = F.array(*[F.struct(F.lit(order).alias("order"), F.concat(F.lower(n), F.lit(e)).alias("key")) for n, order, e in tries])
    asked = files.select("file_id", F.col("dir").alias("_dir"), F.explode(wanted).alias("w")).select("file_id", "_dir", "w.*")
    held = sidecars.select(F.col("dir").alias("_dir"), F.lower("name").alias("key"), F.col("path").alias("sidecar_path"))
    return asked.join(held, ["_dir", "key"]).groupBy("file_id").agg(F.min(F.struct("order", "sidecar_path")).alias("m")).select("file_id", F.col("m.sidecar_path").alias("sidecar_path"))


def not_existing(plan: DataFrame, existing: DataFrame, column: str = "destination") -> DataFrame:
    """The rows whose destination, without case, isn't among the existing ones."""
    return plan.join(existing.select(F.lower(column).alias("_held")).distinct(), F.lower(F.col(column)) == F.col("_held"), "left_anti")


def first_of_checksum(files: DataFrame) -> DataFrame:
    """``checksum, first_path``: the first path of each checksum, without case; blank ones are left out."""
    key = F.lower(F.trim("checksum"))
    return files.where(key != "").groupBy(key.alias("checksum")).agg(F.min("path").alias("first_path"))


def duplicate_of(files: DataFrame) -> DataFrame:
    """``file_id, path, original``: files whose checksum an earlier path has."""
    first = first_of_checksum(files)
    keyed = files.select("file_id", "path", F.lower(F.trim("checksum")).alias("checksum"))
    return keyed.join(first, "checksum").where(F.lower("path") != F.lower("first_path")).select("file_id", "path", F.col("first_path").alias("original"))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """``checksum, n, first_path, path``: one row for each file whose checksum several files have.

    The groups' sizes and first paths are aggregated and joined back, so no group is gathered in one row,
    however many copies it has.
    """
    keyed = files.select(F.lower(F.trim("checksum")).alias("checksum"), "path").where("checksum <> ''")
    groups = keyed.groupBy("checksum").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")).where("n > 1")
    return keyed.join(groups, "checksum").select("checksum", "n", "first_path", "path")
