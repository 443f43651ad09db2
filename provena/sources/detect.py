"""Which format a source has, and loading it."""

from __future__ import annotations

import glob
import os

from pyspark.sql import SparkSession

from provena.errors import MalformedSource, SourceNotFound
from provena.sources.coco import read_coco
from provena.sources.dataset import Dataset
from provena.sources.yolo import CLASS_FILES, read_yolo

FORMATS = ("coco", "yolo")


def detect_format(source: str) -> str:
    """A ``.json`` file is COCO; a folder with labels/, images/ or a class file is YOLO, one with a single JSON file COCO, else YOLO."""
    if os.path.isfile(source):
        if source.lower().endswith(".json"):
            return "coco"
        raise MalformedSource(f"no dataset format for {source}")
    if not os.path.isdir(source):
        raise SourceNotFound(f"nothing at {source}")
    marks = [os.path.isdir(os.path.join(source, d)) for d in ("labels", "images")] + [os.path.isfile(os.path.join(source, f)) for f in CLASS_FILES]
    if any(marks):
        return "yolo"
    return "coco" if len(glob.glob(os.path.join(glob.escape(source), "*.json"))) == 1 else "yolo"


def load_dataset(spark: SparkSession, source: str, format: str | None = None, **options) -> Dataset:
    kind = format.strip().lower() if format else detect_format(source)
    if kind not in FORMATS:
        raise MalformedSource(f"unknown format {format}")
    if kind == "yolo":
        return read_yolo(spark, source, **options)
    if os.path.isdir(source):
        files = glob.glob(os.path.join(glob.escape(source), "*.json"))
        if not files:
            raise SourceNotFound(f"no JSON file in {source}")
        if len(files) > 1:
            raise MalformedSource(f"several JSON files in {source}")
        options.setdefault("image_dir", source)
        source = files[0]
    return read_coco(spark, source, **options)
