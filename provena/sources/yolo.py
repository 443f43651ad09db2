"""YOLO TXT datasets: images beside (or above) label files with one normalised box a line."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.errors import BoxOutOfBounds, InvalidAnnotation, InvalidBox, MalformedSource, SourceNotFound
from provena.functions.boxes import finite, from_yolo, yolo_out_of_bounds
from provena.functions.ids import int_id, str_id
from provena.operators.numbering import number_in_order
from provena.runtime import materialize, small
from provena.sources.dataset import Dataset
from provena.sources.images import dimensions

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp")
CLASS_FILES = ("classes.txt", "obj.names")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity|nan)$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def number(c: Column) -> Column:
    """A float as text, null if it is none."""
    return F.when(c.rlike(NUMBER), F.regexp_replace(c, r"^\+", "").try_cast("double"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """``line`` texts into ``tokens, class_id, cx, cy, nw, nh, error`` (error null where the line is well formed)."""
    # each step's columns are made once, by a generator, so that later filters do not copy their expressions
    t = F.split(stripped(F.col("line")), r"\s+")
    rows = lines.filter(stripped(F.col("line")) != "").select("*", F.explode(F.array(t)).alias("tokens"))

    def token(i: int) -> Column:
        return F.try_element_at("tokens", F.lit(i + 1))

    cls = F.when(token(0).rlike(r"^[+-]?\d+$"), F.regexp_replace(token(0), r"^\+", "").try_cast("bigint"))
    parts = F.struct(cls.alias("class_id"), *[number(token(i + 1)).alias(n) for i, n in enumerate(("cx", "cy", "nw", "nh"))])
    rows = rows.select("*", F.inline(F.array(parts)))
    values = [F.col(n) for n in ("cx", "cy", "nw", "nh")]
    none = F.lit(False)
    for v in values:
        none = none | v.isNull()
    error = (
        F.when(F.size("tokens") != 5, "token_count")
        .when(F.col("class_id").isNull() | none, "not_numeric")
        .when(F.col("class_id") < 0, "class_negative")
        .when(~finite(*values), "not_finite")
        .when((F.col("nw") <= 0) | (F.col("nh") <= 0), "side_not_positive")
    )
    return rows.withColumn("error", error)


def orphans(labels: DataFrame, images: DataFrame, key: str = "stem") -> DataFrame:
    """Label stems without an image."""
    return labels.join(images, key, "left_anti")


def _listing(spark: SparkSession, folder: str, pattern: str, with_content: bool) -> DataFrame:
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    cols = [F.col("path"), name.alias("file_name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem")]
    return rows.select(*cols, *(["content"] if with_content else []))


def resolve_classes(data_dir: str, labels_dir: str, classes) -> dict[int, str]:
    """A list, a dict, a file, or the first class file found; a blank line uses up its number."""
    if isinstance(classes, dict):
        return {int(k): str(v) for k, v in classes.items()}
    if isinstance(classes, list | tuple):
        return {i: str(v) for i, v in enumerate(classes)}
    path = classes
    if path is None:
        path = next((p for d in (data_dir, labels_dir) for n in CLASS_FILES if os.path.isfile(p := os.path.join(d, n))), None)
        if path is None:
            return {}
    elif not os.path.isfile(path):
        raise SourceNotFound(f"no class file {path}")
    with open(path, encoding="utf-8") as f:
        return {i: line.strip() for i, line in enumerate(f) if line.strip()}


def read_yolo(
    spark: SparkSession, data_dir: str, images_dir: str | None = None, labels_dir: str | None = None, classes=None,
    default_dims: tuple[int, int] | None = None, name: str | None = None, strict_bounds: bool = False, strict_orphans: bool | None = None,
) -> Dataset:
    if not os.path.isdir(data_dir):
        raise SourceNotFound(f"no folder {data_dir}")
    if default_dims is not None and (len(default_dims) != 2 or any(isinstance(d, bool) or d <= 0 for d in default_dims)):
        raise MalformedSource("default dimensions are two positive numbers")
    inner = os.path.join(data_dir, "images")
    images_dir = images_dir or (inner if os.path.isdir(inner) else data_dir)
    inner = os.path.join(data_dir, "labels")
    labels_dir = labels_dir or (inner if os.path.isdir(inner) else images_dir)
    for d in (images_dir, labels_dir):
        if not os.path.isdir(d):
            raise SourceNotFound(f"no folder {d}")
    names = resolve_classes(data_dir, labels_dir, classes)
    # suffixes in any mixture of cases
    glob = "*{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x) for x in IMAGE_SUFFIXES) + "}"
    found = _listing(spark, images_dir, glob, True)
    found = found.withColumn("dims", dimensions(F.col("content"))).drop("content")
    if default_dims is not None:
        fallback = F.struct(F.lit(int(default_dims[0])).alias("width"), F.lit(int(default_dims[1])).alias("height"))
        found = found.withColumn("dims", F.coalesce("dims", fallback))
    found = materialize(number_in_order(found, F.col("file_name"), "ordinal", 0), "yolo-images")
    if not found.limit(1).count():
        raise SourceNotFound(f"no images in {images_dir}")
    if found.filter("dims is null").limit(1).count():
        raise MalformedSource("an image's dimensions cannot be read and no default is given")

    def by_stem(folder: str) -> DataFrame:
        files = _listing(spark, folder, "*.txt", True).filter(~F.col("file_name").isin(*CLASS_FILES))
        return files.select("stem", F.decode("content", "utf-8").alias("value"))

    labels, beside = by_stem(labels_dir), by_stem(images_dir)
    # Spark's readers leave out empty files, so label files are listed by name
    stems = sorted(os.path.splitext(n)[0] for n in os.listdir(labels_dir) if n.endswith(".txt") and n not in CLASS_FILES)
    named = spark.createDataFrame([(x,) for x in stems], "stem string")
    lost = [r["stem"] for r in orphans(named, found).orderBy("stem").collect()]
    strict = strict_bounds if strict_orphans is None else strict_orphans
    if lost and strict:
        raise InvalidAnnotation(f"labels without an image: {', '.join(lost)}")
    warnings = [f"label file without an image: {x}.txt" for x in lost]
    joined = found.join(labels, "stem", "left").join(beside.withColumnRenamed("value", "beside"), "stem", "left")
    lines = joined.select("stem", "ordinal", "dims", F.posexplode(F.split(F.coalesce("value", "beside", F.lit("")), "\r?\n")).alias("line_no", "line"))
    parsed = materialize(parse_lines(lines), "yolo-lines")
    wrong = parsed.filter("error is not null").orderBy("ordinal", "line_no").limit(1).collect()
    if wrong:
        where = f"{wrong[0]['stem']}.txt line {wrong[0]['line_no'] + 1}: {wrong[0]['error']}"
        raise (InvalidBox if wrong[0]["error"] in ("side_not_positive", "not_finite") else InvalidAnnotation)(where)
    known = spark.createDataFrame(sorted(names.items()), "class_id bigint, class_name string")
    if names:
        unknown = parsed.join(small(known), "class_id", "left_anti").orderBy("ordinal", "line_no").limit(1).collect()
        if unknown:
            raise InvalidAnnotation(f"unknown class {unknown[0]['class_id']} in {unknown[0]['stem']}.txt")
    cx, cy, nw, nh = (F.col(c) for c in ("cx", "cy", "nw", "nh"))
    spill = yolo_out_of_bounds(cx, cy, nw, nh)
    if strict_bounds and parsed.filter(spill).limit(1).count():
        raise BoxOutOfBounds("a box reaches beyond its image")
    box = from_yolo(cx, cy, nw, nh, F.col("dims.width"), F.col("dims.height"))
    parsed = parsed.join(small(known), "class_id", "left")
    note = F.when(spill, F.array(F.lit("box reaches beyond the image"))).otherwise(F.array().cast("array<string>"))
    annotations = number_in_order(parsed, [F.col("ordinal"), F.col("line_no")], "number").select(
        str_id(F.col("stem")).alias("image_id"),
        F.col("line_no").cast("bigint").alias("ann_ordinal"),
        int_id(F.col("number")).alias("annotation_id"),
        F.col("class_id").alias("category_id"),
        F.col("class_name").alias("category_name"),
        *[c.alias(n) for n, c in box.items()],
        F.struct("cx", "cy", F.col("nw").alias("w"), F.col("nh").alias("h")).alias("norm"),
        (box["width"] * box["height"]).alias("area"),
        F.lit(0).alias("iscrowd"),
        note.alias("warnings"),
    )
    collected = annotations.groupBy("image_id").agg(F.flatten(F.collect_list("warnings")).alias("warnings"))
    sides = [F.col("dims.width").alias("width"), F.col("dims.height").alias("height")]
    images = found.select(str_id(F.col("stem")).alias("image_id"), "ordinal", "file_name", *sides, F.col("path").alias("file_path"))
    images = images.join(collected, "image_id", "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))
    if not names and parsed.limit(1).count():
        warnings.append("annotations without class names")
    categories = spark.createDataFrame(sorted(names.items()), "category_id bigint, name string")
    return Dataset(name or os.path.basename(os.path.normpath(data_dir)), "yolo", data_dir, images, annotations, categories, warnings)
