"""File names, keys and templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    """PJ01."""
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """PJ01: without folders and the last suffix."""
    return F.regexp_replace(basename(path), r"[.][^.]*$", "")


def with_suffix(path: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(path, r"[.][^./]*$", ""), F.lit(suffix))


def crop_image(name: Column, strict: bool = True) -> Column:
    """PJ02: the image of a crop, the text before _cropped; strict raises where there is none."""
    key = F.split_part(name, F.lit("_cropped"), F.lit(1))
    return F.when(F.contains(name, F.lit("_cropped")), key).otherwise(F.raise_error(F.concat(F.lit("no crop name: "), name)) if strict else key)


def crop_name(image: Column, place: Column) -> Column:
    """PJ03: image_cropped, image_cropped_1, ... for place 0, 1, ..."""
    return F.concat(image, F.lit("_cropped"), F.when(place > 0, F.concat(F.lit("_"), place.cast("string"))).otherwise(""))


def fraction_text(x: Column) -> Column:
    """PJ04: four decimals without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x), "0+$", ""), "[.]$", "")


def expand(template: str, values: dict[str, object]) -> str:
    """PJ05: ${key} replaced one key after the other."""
    for key, value in values.items():
        template = template.replace("${" + key + "}", str(value))
    return template
