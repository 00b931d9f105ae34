"""Readers of manifests, annotations, photo metadata, predictions and folders."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.paths import stem
from tallyframe.operators.relations import lookup, require_empty

#: The manifest's columns and the image types that are read.
COLUMNS = ("path", "label", "label_orig", "source", "group", "split", "license", "url", "md5", "phash", "roi", "device", "paper_path")
IMAGES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff", "gif")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest CSV, all columns text, empty fields null; phash_bits is its hexadecimal hash as a BIGINT."""
    df = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in COLUMNS), enforceSchema=False)
    return df.withColumn("phash_bits", hex_bits(F.col("phash")))


def hex_bits(h: Column) -> Column:
    """16 hexadecimal digits as the 64 bits of a BIGINT."""
    half = lambda i: F.conv(F.substring(h, i, 8), 16, 10).cast("long")
    return F.when(h.rlike("^[0-9a-fA-F]{16}$"), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def trainval(manifest: DataFrame, labels: tuple[str, ...], sources: tuple[str, ...]) -> DataFrame:
    """The rows open to training: split, label and source filters, which reach the scan; paths must be unique."""
    rows = manifest.where((F.col("split") == "trainval") & F.col("label").isin(*labels) & F.col("source").isin(*sources))
    require_empty(rows.groupBy("path").count().where("count > 1").select("path"), "repeated paths")
    return rows


def frozen_reader(rows: DataFrame, frozen: DataFrame, safe: DataFrame) -> DataFrame:
    """Rows outside frozen groups; every one left must be on the list of safe paths."""
    left = rows.join(frozen.select("group").distinct(), "group", "left_anti")
    require_empty(left.join(safe.select("path"), "path", "left_anti").select("path"), "paths that are not known to be safe")
    return left


def test_rows(manifest: DataFrame, confirmed: bool) -> DataFrame:
    """The test split, behind an explicit word."""
    if not confirmed:
        raise PermissionError("the test split is read once, with confirmed=True")
    return manifest.where(F.col("split") == "test")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """file, cls, cx, cy, w, h of each line of annotation files with five or more fields; other lines are left out."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), p.alias("p")).where(F.size("p") >= 5)
    return rows.select("file", F.expr("try_cast(p[0] AS int)").alias("cls"), *[F.expr(f"try_cast(p[{i}] AS double)").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"), 1)])


def annotation_issues(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with issues: what is wrong with each, sorted; five numbers, finite, sides above 0, inside the image."""
    p = F.split(F.trim(value), r"\s+")
    n = [F.expr(f"try_cast(try_element_at(split(trim(`{value}`), '\\\\s+'), {i}) AS double)") for i in range(1, 6)]
    bad = F.lit(False)
    for x in n:
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    _, cx, cy, w, h = n
    out = (cx - w / 2 < -1e-6) | (cx + w / 2 > 1 + 1e-6) | (cy - h / 2 < -1e-6) | (cy + h / 2 > 1 + 1e-6)
    five = F.size(p) == 5
    rules = [F.when(~five, "field_count"), F.when(five & bad, "not_a_number"), F.when(five & ~bad & ((w <= 0) | (h <= 0)), "empty_box"), F.when(five & ~bad & out, "out_of_bounds")]
    return lines.withColumn("issues", F.array_sort(F.array_compact(F.array(*rules))))


def class_names(spark: SparkSession, path: str) -> list[str]:
    """The list after names: in a dataset description."""
    line = spark.read.text(path).where(F.col("value").rlike(r"^\s*names\s*:")).select(F.regexp_extract("value", r"names\s*:\s*(\[.*\])", 1).alias("l")).first()
    if line is None:
        raise ValueError(f"no names in {path}")
    return json.loads(line["l"].replace("'", '"'))


def scan_folders(spark: SparkSession, root: str, source: str, glob: str = "*") -> DataFrame:
    """path, source, split_orig, label_orig, stem, bytes of the images under root/<split>/<class>/. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", F.col("length").alias("bytes"))
    parts = F.split("path", "/")
    kept = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGES))
    return kept.select("path", F.lit(source).alias("source"), F.element_at(parts, -3).alias("split_orig"), F.element_at(parts, -2).alias("label_orig"), stem(F.col("path")).alias("stem"), "bytes")


def scan_annotated(spark: SparkSession, root: str, source: str, names: list[str]) -> DataFrame:
    """As scan_folders for root/<split>/images with sibling labels folders; label_orig joins an image's classes by |,
    "(no_label)" where it has none; n_boxes counts its boxes."""
    images = scan_folders(spark, f"{root}/*/images", source).withColumn("split_orig", F.element_at(F.split("path", "/"), -3)).withColumn("key", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    boxes = read_annotations(spark, f"{root}/*/labels/*.txt").withColumn("key", F.regexp_extract("file", r"([^/]+)\.txt$", 1)).withColumn("split_orig", F.element_at(F.split("file", "/"), -3))
    name = F.try_element_at(F.array(*map(F.lit, names)), F.col("cls") + 1)
    per = boxes.groupBy("split_orig", "key").agg(F.array_join(F.sort_array(F.collect_set(name)), "|").alias("classes"), F.count("*").alias("n_boxes"))
    out = images.drop("label_orig").join(per, ["split_orig", "key"], "left")
    return out.select("path", "source", "split_orig", F.coalesce(F.nullif("classes", F.lit("")), F.lit("(no_label)")).alias("label_orig"), "stem", "bytes", F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"))


SOURCES: dict[str, Callable[..., DataFrame]] = {"folder": scan_folders, "annotated": scan_annotated}


def scan(kind: str, *args: object, **options: object) -> DataFrame:
    if kind not in SOURCES:
        raise ValueError(f"unknown source {kind!r}; known: {sorted(SOURCES)}")
    return SOURCES[kind](*args, **options)


def read_semicolon_csv(spark: SparkSession, path: str) -> DataFrame:
    """A ;-separated CSV with a header; a byte order mark in front of the first name goes."""
    df = spark.read.csv(path, sep=";", header=True)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def photos_with_devices(photos: DataFrame, devices: DataFrame, name: str = "name_paper") -> tuple[DataFrame, DataFrame]:
    """(photos with their device's name, rejects). Identical repeats of a name count once, conflicting ones all go."""
    first = photos.columns
    per = photos.groupBy(name).agg(F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in first])).alias("_n"))
    both = photos.distinct().join(per, name)
    dim = devices.select("device_id", F.col("name").alias("device"))
    return lookup(both.where("_n = 1").select(*first), dim, "device_id", "device", "?"), both.where("_n > 1").select(*first).withColumn("reason", F.lit("conflicting_metadata"))


def read_predictions(spark: SparkSession, path: str, prefix: str = "prob_", classes: tuple[str, ...] = ("light", "medium", "dark")) -> DataFrame:
    """path, label, prediction and prob_<class> of a prediction CSV, whatever the prefix; probabilities must be finite
    and sum to one within 1e-6."""
    df = spark.read.csv(path, header=True)
    p = [F.col(f"{prefix}{c}").cast("double") for c in classes]
    total = sum(p[1:], p[0])
    rest = [c for c in ("path", "source", "group", "label", "prediction") if c in df.columns]
    ok = F.coalesce(F.abs(total - 1) <= 1e-6, F.lit(False))
    checked = [F.when(ok, x).otherwise(F.raise_error("probabilities do not sum to one").cast("double")).alias(f"prob_{c}") for x, c in zip(p, classes, strict=True)]
    return df.select(*rest, *checked)


def survey(spark: SparkSession, root: str) -> DataFrame:
    """folder, extension, files, bytes, images under a root. Contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return f.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), ext.alias("extension")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.count_if(ext.isin(*IMAGES)).alias("images"))


def data_dir(variable: str = "TALLYFRAME_DATA", settings: str = "tallyframe.json") -> str:
    """The data folder: from the environment, else from a settings file; never a silent default."""
    found = os.environ.get(variable)
    if not found and Path(settings).is_file():
        found = json.loads(Path(settings).read_text()).get("data_dir")
    if not found or not Path(found).is_dir():
        raise FileNotFoundError(f"set {variable} or data_dir in {settings} to an existing folder")
    return found


def refill(cache: DataFrame, rows: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], config: str | None = None) -> DataFrame:
    """The cache with what it lacked computed; every row must be in it then. config: the digest of the settings that the
    values hang on; of a cache with a column config only values of that digest count, and they come back without it."""
    if config is not None:
        cache = cache.where(F.col("config") == config).drop("config")
    todo = rows.join(cache.select(key), key, "left_anti")
    full = cache.unionByName(compute(todo))
    require_empty(rows.join(full.select(key), key, "left_anti").select(key), "rows without a cached value")
    return full
