"""Form templates: a directory of small JSON files, one per form type."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.conform import template_leaves


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(form_type, template) for every ``*.json`` below ``path``."""
    return (
        spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
        .select(F.regexp_replace(F.url_decode(F.col("_metadata.file_name")), r"\.json$", "").alias("form_type"),
                F.col("value").alias("template"))
    )


def available_forms(templates: DataFrame) -> DataFrame:
    return templates.select("form_type").orderBy("form_type")


def load_template(templates: DataFrame, form_type: str) -> dict:
    """One template: exact name first, then any case. A directory holds a few dozen small files."""
    hit = (
        templates.where(F.lower("form_type") == form_type.lower())
        .orderBy((F.col("form_type") == form_type).desc(), "form_type").limit(1).collect()
    )
    if not hit:
        raise FileNotFoundError(f"no template for form {form_type!r}")
    return json.loads(hit[0]["template"])


def template_dim(spark: SparkSession, templates: dict[str, dict]) -> DataFrame:
    """Leaf dimension of several templates (bounded by the number of form fields)."""
    rows = [r for form, t in templates.items() for r in template_leaves(t, form)]
    return spark.createDataFrame(rows, "form_type string, path string, key string, leaf_type string, is_list boolean")
