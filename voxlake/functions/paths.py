"""Column functions over file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings the catalogue accepts.
IMAGE_EXTENSIONS = (".tif", ".tiff", ".nii", ".nii.gz")

EXTENSION = r"(?i)(\.nii\.gz|\.[^./]+)$"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), EXTENSION, 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), EXTENSION, "")


def base_key(path: Column) -> Column:
    """Stem without a trailing _seg in any case: what an image and its masks share."""
    return F.regexp_replace(stem(path), r"(?i)_seg$", "")


def is_mask(path: Column) -> Column:
    return F.lower(stem(path)).endswith("_seg")


def is_hidden(path: Column) -> Column:
    return file_name(path).startswith(".")


def allowed(path: Column, extensions=IMAGE_EXTENSIONS) -> Column:
    return extension(path).isin(*extensions)


def safe_channel(name: Column, index: Column) -> Column:
    """Channel name for a file name; a name that is just its index becomes C<index>."""
    plain = F.when(name == index.cast("string"), F.concat(F.lit("C"), index.cast("string"))).otherwise(name)
    return F.regexp_replace(plain, "[^A-Za-z0-9_-]", "_")


def best_effort(text: Column) -> Column:
    """Number when the text reads as one, else null (whole numbers and decimals alike)."""
    return F.coalesce(text.try_cast("bigint").cast("double"), text.try_cast("double"))
