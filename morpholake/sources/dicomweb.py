"""DICOM JSON documents as tables of studies, series and instances, by JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags by field.
TAGS = {
    "study_uid": "0020000D", "series_uid": "0020000E", "instance_uid": "00080018", "patient_name": "00100010", "patient_id": "00100020", "study_date": "00080020", "study_description": "00081030", "series_description": "0008103E",
    "modality": "00080060", "modalities": "00080061", "series_number": "00200011", "instance_number": "00200013", "slice_location": "00201041", "rows": "00280010", "cols": "00280011", "n_series": "00201206", "n_instances": "00201208",
}


def text_of(json: Column, field: str) -> Column:
    """The first value as a string; of a person's name the alphabetic form; null if there is none."""
    at = f"$['{TAGS[field]}'].Value[0]"
    whole = F.get_json_object(json, at)
    return F.when(whole.startswith("{"), F.get_json_object(json, f"{at}.Alphabetic")).otherwise(whole)


def number_of(json: Column, field: str) -> Column:
    return text_of(json, field).try_cast("double")


def studies(documents: DataFrame, json: str = "json") -> DataFrame:
    """One row per document; modalities fall back to the single modality, in an array, empty if there is none."""
    j = F.col(json)
    several = F.from_json(F.get_json_object(j, f"$['{TAGS['modalities']}'].Value"), "array<string>")
    one = F.array_compact(F.array(text_of(j, "modality")))
    return documents.select(
        F.coalesce(text_of(j, "study_uid"), F.lit("")).alias("study_uid"), *(text_of(j, c).alias(c) for c in ("patient_name", "patient_id", "study_date", "study_description")),
        F.when(F.size(several) > 0, several).otherwise(one).alias("modalities"), *(number_of(j, c).alias(c) for c in ("n_series", "n_instances")),
    )


def series(documents: DataFrame, json: str = "json") -> DataFrame:
    j = F.col(json)
    return documents.select(*(F.coalesce(text_of(j, c), F.lit("")).alias(c) for c in ("study_uid", "series_uid")), text_of(j, "modality").alias("modality"), number_of(j, "series_number").alias("series_number"), text_of(j, "series_description").alias("series_description"), number_of(j, "n_instances").alias("n_instances"))


def instances(documents: DataFrame, json: str = "json") -> DataFrame:
    j = F.col(json)
    return documents.select(*(F.coalesce(text_of(j, c), F.lit("")).alias(c) for c in ("study_uid", "series_uid", "instance_uid")), *(number_of(j, c).alias(c) for c in ("instance_number", "rows", "cols")), text_of(j, "slice_location").alias("slice_location"))


def study_tree(instance_rows: DataFrame) -> DataFrame:
    """study_uid and its series, each with its instances in order: two groupings, no driver."""
    order = F.struct(F.coalesce("instance_number", F.lit(0.0)).alias("number"), F.col("instance_uid").alias("uid"))
    per_series = instance_rows.groupBy("study_uid", "series_uid").agg(F.array_sort(F.collect_list(order)).alias("images"))
    return per_series.groupBy("study_uid").agg(F.array_sort(F.collect_list(F.struct("series_uid", "images"))).alias("series"))
