"""The tables of a labelled image dataset, and checks that need one action."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.functions.ids import lookup_id
from provena.runtime import small


@dataclass
class Dataset:
    name: str
    format: str
    root: str
    images: DataFrame  # image_id, ordinal, file_name, width, height, file_path, warnings
    annotations: DataFrame  # image_id, ann_ordinal, annotation_id, category_id, category_name, xmin, ymin, width, height, norm, area, iscrowd, warnings
    categories: DataFrame  # category_id, name
    warnings: list[str] = field(default_factory=list)

    def counts(self) -> DataFrame:
        return self.images.agg(F.count(F.lit(1)).alias("image_count")).join(self.annotations.agg(F.count(F.lit(1)).alias("annotation_count")))

    def get_image(self, wanted: str | int) -> DataFrame:
        """The image of an id; an id of the other type with the same number text is taken where none is exact."""
        kind = "int" if isinstance(wanted, int) else "str"
        w = F.struct(F.lit(kind).alias("id_type"), F.lit(str(wanted)).alias("id"))
        return self.images.withColumn("_rank", lookup_id(w, F.col("image_id"))).filter("_rank is not null").orderBy("_rank").limit(1).drop("_rank")

    def with_category_names(self) -> DataFrame:
        """Annotations with a name: their own, else the category table's."""
        names = self.categories.select("category_id", F.col("name").alias("_name"))
        joined = self.annotations.join(small(names), "category_id", "left")
        return joined.withColumn("category_name", F.coalesce("category_name", "_name")).drop("_name")

    def category_names(self) -> DataFrame:
        """``category_id, name`` of all categories in use or listed: the category table's name, else the first in order of the annotations' own."""
        listed = self.categories.filter(F.trim("name") != "").select("category_id", F.trim("name").alias("listed"))
        own = self.annotations.filter("category_id is not null").groupBy("category_id").agg(F.min(F.when(F.trim("category_name") != "", F.col("category_name"))).alias("own"))
        return own.join(listed, "category_id", "full").select("category_id", F.coalesce("listed", "own").alias("name"))

    def first_names(self) -> DataFrame:
        """``image_id, category_id, name``: by image the first annotation of a category tells its name, or the next that has one."""
        named = self.with_category_names().filter("category_id is not null")
        first = F.min(F.when(F.col("category_name").isNotNull(), F.struct("ann_ordinal", "category_name")))
        return named.groupBy("image_id", "category_id").agg(first.alias("f")).select("image_id", "category_id", F.col("f.category_name").alias("name"))

    def create_views(self, prefix: str = "") -> None:
        for table in ("images", "annotations", "categories"):
            getattr(self, table).createOrReplaceTempView(prefix + table)
