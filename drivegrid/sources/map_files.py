"""Occupancy maps as files: a description (YAML) and the image that it names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drivegrid.sources.binary import read_map_images

# fixed values: thresholds of a description that gives none
OCCUPIED, FREE = 0.65, 0.196


@dataclass
class MapFiles:
    """``grids``: path, image, resolution, origin_x, origin_y, width, height; ``cells``: path,
    cx, cy, obstacle, observed_free, unknown; ``violations``: path, code."""

    grids: DataFrame
    cells: DataFrame
    violations: DataFrame


def _last(key: str) -> Column:
    """Value of the last line that gives ``key``."""
    found = F.regexp_extract_all(F.col("value"), F.lit(rf"(?m)^[ \t]*{key}:[ \t]*(.*?)[ \t\r]*$"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def parse_descriptions(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Descriptions (``path, value``: the whole text) to (grids, violations)."""
    c = F.col
    bare = F.regexp_replace(_last("image"), "^([\"'])(.*)\\1$", "$2")
    raw = _last("origin")
    inside = F.regexp_extract(raw, r"\[([^\]]*)\]", 1)
    parts = F.filter(F.split(F.trim(F.regexp_replace(inside, ",", " ")), r"\s+"), lambda t: t != "")
    number = lambda key, default: F.when(_last(key).isNull(), F.lit(default)).otherwise(_last(key).try_cast("double"))
    d = texts.select("path", "value").withColumns({
        "image": bare, "resolution": _last("resolution").try_cast("double"), "negate": F.coalesce(_last("negate").isin("1", "true", "yes"), F.lit(False)),
        "occupied": number("occupied_thresh", OCCUPIED), "free": number("free_thresh", FREE), "_raw": raw, "_o": F.transform(parts, lambda t: t.try_cast("double")),
    })
    at = lambda k: F.when(c("_raw").isNull(), 0.0).otherwise(F.get("_o", F.lit(k)))
    d = d.withColumns({"origin_x": at(0), "origin_y": at(1), "_z": at(2)})
    codes = F.array_compact(F.array(
        F.when(F.coalesce(c("image"), F.lit("")) == "", F.lit("image_missing")), F.when(~F.coalesce(c("resolution") > 0, F.lit(False)), F.lit("resolution_not_positive")),
        F.when(c("origin_x").isNull() | c("origin_y").isNull() | c("_z").isNull(), F.lit("origin_invalid")),
        F.when(~F.coalesce((c("free") >= 0) & (c("occupied") <= 1) & (c("free") < c("occupied")), F.lit(False)), F.lit("thresholds_invalid")),
    ))
    d = d.withColumn("_codes", codes)
    folder = F.regexp_replace("path", "[^/]*$", "")
    image = F.when(c("image").startswith("/") | c("image").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), c("image")).otherwise(F.concat(folder, F.regexp_replace("image", r"^\./", "")))
    good = d.filter(F.size("_codes") == 0).select("path", image.alias("image"), "resolution", "origin_x", "origin_y", "negate", "occupied", "free")
    return good, d.select("path", F.explode("_codes").alias("code"))


def read_maps(spark: SparkSession, descriptions: str, images: str) -> MapFiles:
    """All maps described under ``descriptions`` with their images under ``images``. Bright
    pixels are free unless negated; image rows run downwards. A faulty map gives violations
    and no cells; the others are not affected."""
    c = F.col
    texts = spark.read.text(descriptions, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    grids, bad = parse_descriptions(texts)
    # one spelling of a path: no scheme of local files, no steps back
    step = r"/(?!\.\.?/)[^/]+/\.\./"
    plain = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "^file:/*", "/"), step, "/"), step, "/"), step, "/")
    pixels = read_map_images(spark, images, strict=False).withColumn("_image", plain(c("path"))).drop("path")
    sizes = pixels.groupBy("_image").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.max("max_value").alias("_top"), F.count("*").alias("_n"), F.min("pixel").alias("_lo"), F.max("pixel").alias("_hi"))
    j = grids.withColumn("_image", plain(c("image"))).join(sizes, "_image", "left")
    code = (
        F.when(c("width").isNull(), "image_not_found").when(~c("_top").between(1, 255), "image_header_unsupported").when(c("_n") != c("width") * c("height"), "image_truncated")
        .when((c("_lo") < 0) | (c("_hi") > c("_top")), "pixel_out_of_range")
    )
    j = j.withColumn("code", code)
    good = j.filter("code IS NULL")
    p = pixels.drop("width", "height").join(good.select("_image", "path", "height", "negate", "occupied", "free"), "_image")
    share = c("pixel") / c("max_value").cast("double")
    dark = F.when(c("negate"), share).otherwise(1.0 - share)
    o, f = dark > c("occupied"), dark < c("free")
    cells = p.select("path", c("col").alias("cx"), (c("height") - 1 - c("row")).alias("cy"), o.alias("obstacle"), (~o & f).alias("observed_free"), (~o & ~f).alias("unknown"))
    return MapFiles(good.select("path", "image", "resolution", "origin_x", "origin_y", "width", "height"), cells, bad.unionByName(j.filter("code IS NOT NULL").select("path", "code")))
