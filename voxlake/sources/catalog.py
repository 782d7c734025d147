"""File catalogue: scan, pair, number, describe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions import paths as fp
from voxlake.operators.ranks import sorted_rank


def scan_folder(spark: SparkSession, root: str, extensions: Sequence[str] = fp.IMAGE_EXTENSIONS, recursive: bool = True) -> DataFrame:
    """File listing (path, name, length, modified); file contents are never read."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(root)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )
    return scan_filter(listed, extensions)


def scan_filter(files: DataFrame, extensions: Sequence[str] = fp.IMAGE_EXTENSIONS) -> DataFrame:
    """Keep the accepted endings; hidden files are dropped."""
    path = F.col("path")
    keep = files.filter(fp.allowed(path, extensions) & ~fp.is_hidden(path))
    return keep.withColumn("name", fp.file_name(path))


def with_path_parts(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.select(
        "*",
        fp.folder(path).alias("dir"),
        fp.stem(path).alias("stem"),
        fp.extension(path).alias("ext"),
        fp.base_key(path).alias("base"),
        fp.is_mask(path).alias("is_mask"),
    )


def pair_images(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images with the mask of the same folder, base and ending; second result: images without one."""
    parts = with_path_parts(scan_filter(files))
    on = ["dir", "base", "ext"]
    images = parts.filter(~F.col("is_mask")).select(*on, F.col("path").alias("image"))
    masks = parts.filter("is_mask").select(*on, F.col("path").alias("mask"))
    return images.join(masks, on), images.join(masks, on, "left_anti")


def pair_any_extension(images: DataFrame, masks: DataFrame) -> DataFrame:
    """First <stem>_seg.* mask by path, else a mask file of the same name; images with neither are dropped."""
    raw = with_path_parts(images).withColumn("name", fp.file_name(F.col("path")))
    other = with_path_parts(masks).withColumn("name", fp.file_name(F.col("path")))
    by_stem = other.filter("is_mask").groupBy("dir", F.col("base").alias("stem")).agg(F.min("path").alias("m1"))
    by_name = other.filter(~F.col("is_mask")).groupBy("dir", "name").agg(F.min("path").alias("m2"))
    both = raw.join(by_stem, ["dir", "stem"], "left").join(by_name, ["dir", "name"], "left")
    how = F.when(F.col("m1").isNotNull(), "stem").otherwise("name")
    return both.filter("coalesce(m1, m2) is not null").select(
        F.col("path").alias("image"), F.coalesce("m1", "m2").alias("mask"), how.alias("matched_by")
    )


def pair_by_intersection(files: DataFrame) -> DataFrame:
    """Base names present both as image and as label, by one grouping."""
    parts = with_path_parts(files)
    rows = parts.groupBy("dir", "base").agg(
        F.min(F.when(~F.col("is_mask"), F.col("path"))).alias("image"),
        F.min(F.when(F.col("is_mask"), F.col("path"))).alias("label"),
    )
    return rows.filter("image is not null and label is not null")


def channel_files(channels: DataFrame) -> DataFrame:
    """(stem, index, channel) to the output file of each channel."""
    safe = fp.safe_channel(F.col("channel"), F.col("index"))
    return channels.withColumn("file", F.concat("stem", F.lit("_"), safe, F.lit(".tiff")))


def slice_files(volumes: DataFrame, stem: Column) -> DataFrame:
    """One row per z slice with its image, mask and zero-padded frame names."""
    rows = volumes.select("volume_id", "nz", stem.alias("stem"), F.explode(F.sequence(F.lit(0), F.col("nz") - 1)).alias("z"))
    z = F.col("z").cast("string")
    base = F.concat("stem", F.lit("_z"), z)
    width = F.length((F.col("nz") - 1).cast("string"))
    return rows.select(
        "volume_id",
        "z",
        F.concat(base, F.lit(".tiff")).alias("image"),
        F.concat(base, F.lit("_seg.tiff")).alias("mask"),
        F.lpad(z, width, F.lit("0")).alias("frame"),
    )


def case_ids(names: DataFrame) -> DataFrame:
    """set, case number and channel from <set>_<case>_000<channel>.<ext>."""
    pattern = r"^(.+)_(\d+)_000(\d+)\."
    part = lambda i: F.regexp_extract("name", pattern, i)
    rows = names.filter(F.col("name").rlike(pattern))
    return rows.select(part(1).alias("set"), part(2).cast("bigint").alias("case"), part(3).cast("bigint").alias("channel"))


def number_cases(files: DataFrame, existing: DataFrame) -> DataFrame:
    """(set, path) numbered by sorted path inside each set, after the highest number in use."""
    used = case_ids(existing).groupBy("set").agg(F.max("case").alias("_last"))
    ranked = sorted_rank(files.select("set", "path"), ["set"], ["path"], "_position")
    number = F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("_position") - 1
    rows = ranked.join(used, "set", "left").withColumn("case", number)
    return rows.select("set", "path", "case", F.format_string("%s_%03d_0000.tiff", "set", "case").alias("new_name"))


def next_dataset_id(folders: DataFrame) -> DataFrame:
    # Fixed value: the pattern of dataset folders.
    number = F.regexp_extract("name", r"^Dataset(\d+)(_|$)", 1).try_cast("bigint")
    return folders.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_id"))


def manifest(names: DataFrame, ending: str = ".tiff") -> DataFrame:
    """Per set: distinct cases, channel map, labels and file ending, also as JSON text."""
    rows = case_ids(names).groupBy("set").agg(F.countDistinct("case").alias("cases"), F.max("channel").alias("last"))
    entry = lambda i: F.struct(F.concat(F.lit("Channel "), i.cast("string")), i.cast("string"))
    channels = F.map_from_entries(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("last")), entry))
    labels = F.struct(F.lit(0).alias("background"), F.lit(1).alias("foreground"))
    body = F.to_json(
        F.struct(
            channels.alias("channel_names"), labels.alias("labels"), F.col("cases").alias("cases"), F.lit(ending).alias("file_ending")
        )
    )
    return rows.select("set", "cases", (F.col("last") + 1).alias("channels"), body.alias("manifest"))


def path_attributes(files: DataFrame) -> DataFrame:
    """Dataset id and name, trainer, configuration and fold from folder names; the deepest match wins."""
    parts = F.split("path", "/")
    dataset = F.element_at(F.filter(parts, lambda p: p.rlike(r"^Dataset\d{3}_.+")), -1)
    run = F.element_at(F.filter(parts, lambda p: p.contains("__")), -1)
    last = lambda text, sep: F.element_at(F.split(text, sep), -1)
    # The pattern of dataset folders, and the separator of a run's parts.
    return files.select(
        "path",
        F.regexp_extract(dataset, r"^Dataset(\d{3})_(.+)", 1).alias("dataset_id"),
        F.regexp_extract(dataset, r"^Dataset(\d{3})_(.+)", 2).alias("dataset_name"),
        F.split(run, "__")[0].alias("trainer"),
        last(F.element_at(parts, -3), "__").alias("config"),
        last(F.element_at(parts, -2), "_").alias("fold"),
    )


def subject_catalog(files: DataFrame, out_root: str) -> DataFrame:
    """Subject, session, contrast, output folder, and the first number of the quality text."""
    name = fp.file_name(F.col("path"))
    pieces = F.split(name, "_")
    subject = F.replace(pieces[0], F.lit("sub-"), F.lit(""))
    session = F.replace(pieces[1], F.lit("ses-"), F.lit(""))
    stem = fp.stem(F.col("path"))
    out_dir = F.concat(F.lit(f"{out_root}/sub-"), subject, F.lit("/ses-"), session, F.lit("/anat"))
    # Fixed value: the pattern of a number in the quality text.
    number = F.regexp_extract("quality_text", r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", 0)
    return files.filter(fp.extension(F.col("path")).isin(".nii", ".nii.gz")).select(
        "path",
        subject.alias("subject"),
        session.alias("session"),
        F.when(F.col("path").contains("T1w"), "T1w").otherwise("T2w").alias("suffix"),
        F.regexp_replace(stem, "_(T1w|T2w)$", "").alias("stem"),
        out_dir.alias("out_dir"),
        fp.best_effort(number).alias("quality"),
    )


# The sidecar's keys, reference prefix and quality text are a file format.
RAW = "bids:raw:"
QUALITY_TEXT = "Quality index [0, 1], where a higher value indicates better quality (0 being the worst)."


def sidecars(
    derived: DataFrame, quality: Column | None = None, sources: Column | None = None, skull_stripped: Column | bool = True, kind: Column | None = None
) -> DataFrame:
    """(path, source) derived files to their JSON text: sources, spatial reference, skull-stripped flag, quality, type.

    One text per derived file, made from its own row. ``sources`` is an array of paths, else the one source; the spatial
    reference is ``source``. Null quality or type are left out.
    """
    raw = lambda c: F.concat(F.lit(RAW), c)
    listed = F.array(raw(F.col("source"))) if sources is None else F.transform(sources, raw)
    flag = skull_stripped if isinstance(skull_stripped, Column) else F.lit(skull_stripped)
    fields = [listed.alias("Sources"), raw(F.col("source")).alias("SpatialReference"), flag.alias("SkullStripped")]
    if quality is not None:
        fields.append(F.when(quality.isNotNull(), F.struct(quality.cast("double").alias("value"), F.lit(QUALITY_TEXT).alias("description"))).alias("QI"))
    if kind is not None:
        fields.append(kind.alias("Type"))
    return derived.select("path", F.to_json(F.struct(*fields)).alias("sidecar"))


def name_mapping(numbered: DataFrame) -> DataFrame:
    """(set, path, new_name, line): the original and the new name of each case, also as a line of JSON."""
    return numbered.select("set", "path", "new_name", F.to_json(F.create_map("path", "new_name")).alias("line"))


def place_labels(labels: DataFrame, data: DataFrame, existing: DataFrame) -> DataFrame:
    """Where each label file goes: beside the image of the same stem with _seg, unless that file exists."""
    rows = with_path_parts(labels).select("path", "dir", "stem", "ext")
    known = with_path_parts(data).select("dir", "stem").distinct().withColumn("_known", F.lit(True))
    target = F.concat("dir", F.lit("/"), "stem", F.lit("_seg"), "ext")
    taken = existing.select(F.col("path").alias("target")).distinct().withColumn("_taken", F.lit(True))
    joined = rows.withColumn("target", target).join(known, ["dir", "stem"], "left").join(taken, "target", "left")
    status = F.when(F.col("_known").isNull(), "skip").when(F.col("_taken"), "conflict").otherwise("move")
    return joined.select("path", F.when(status != "skip", F.col("target")).alias("target"), status.alias("status"))


def unique_names(folders: DataFrame) -> DataFrame:
    """(seq, path) folders: the first of equal paths stays, equal display names get a number in brackets."""
    once = folders.groupBy("path").agg(F.min("seq").alias("seq")).withColumn("base", fp.file_name(F.col("path")))
    ranked = sorted_rank(once, ["base"], ["seq"], "_i")
    shown = F.when(F.col("_i") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), (F.col("_i") - 1).cast("string"), F.lit(")")))
    return ranked.select("path", "seq", shown.alias("display_name"))
