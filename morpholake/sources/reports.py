"""Measurement reports as JSON content trees (TID 1500), and multipart bodies: built and read by Spark's JSON functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_up
from ..operators.graph import dealt
from ..operators.running import running_sum

CODE = "array<struct<CodeValue:string,CodingSchemeDesignator:string,CodeMeaning:string>>"
POINTS = "array<struct<RelationshipType:string,ValueType:string,GraphicType:string,GraphicData:array<double>>>"
VALUE = f"array<struct<NumericValue:double,MeasurementUnitsCodeSequence:{CODE}>>"
ITEM = f"struct<RelationshipType:string,ValueType:string,ConceptNameCodeSequence:{CODE},TextValue:string,ConceptCodeSequence:{CODE},MeasuredValueSequence:{VALUE},ContentSequence:{POINTS}>"
GROUP = f"struct<RelationshipType:string,ValueType:string,ConceptNameCodeSequence:{CODE},ContentSequence:array<{ITEM}>>"
TREE = f"struct<Modality:string,SOPClassUID:string,SeriesUID:string,ConceptNameCodeSequence:{CODE},ContentSequence:array<struct<RelationshipType:string,ValueType:string,ConceptNameCodeSequence:{CODE},ContentSequence:array<{GROUP}>>>>"
#: Codes of the template.
REPORT, MEASUREMENTS, GROUP_CODE, TRACKING, FINDING = ("126000", "Imaging Measurement Report"), ("126010", "Imaging Measurements"), ("125007", "Measurement Group"), ("112039", "Tracking Identifier"), ("121071", "Finding")
REPORT_CLASS = "1.2.840.10008.5.1.4.1.1.88.11"
SUFFIX = " · SR import"
#: Numbers of one document; with a few points each they are about a megabyte.
MOST = 1000


def _code(value: Column, scheme: str, meaning: Column) -> Column:
    return F.array(F.struct(value.alias("CodeValue"), F.lit(scheme).alias("CodingSchemeDesignator"), meaning.alias("CodeMeaning")))


def _named(pair: tuple[str, str]) -> Column:
    return _code(F.lit(pair[0]), "DCM", F.lit(pair[1]))


def _item(kind: str, name: Column, **more: Column) -> Column:
    """An item of the common shape; what it lacks is null and left out of the JSON."""
    fields = {"RelationshipType": F.lit("CONTAINS"), "ValueType": F.lit(kind), "ConceptNameCodeSequence": name, "TextValue": F.lit(None), "ConceptCodeSequence": F.lit(None), "MeasuredValueSequence": F.lit(None), "ContentSequence": F.lit(None)} | more
    return F.struct(*(c.alias(n) for n, c in fields.items())).cast(ITEM)


def build(rows: DataFrame, scheme: str = "99LOCAL", prefix: str = "finding", most: int = MOST) -> DataFrame:
    """series, part (from 0), json: the report of each series.  rows: series, row_no, kind, label, value, unit, points (array of u, v).

    Groups are the labels in order of first appearance; values keep two digits.  A report of over `most` numbers goes on in
    further parts, each a whole document; a group that is cut there has the same tracking identifier in both.  So no task
    holds more than a part, however large the series."""
    rows = rows.select("series", "row_no", "kind", "label", "value", "unit", "points")
    groups = running_sum(rows.groupBy("series", "label").agg(F.min("row_no").alias("first")), ["series"], ["first", "label"], F.lit(1), "k")
    groups = groups.select(F.col("series").alias("_series"), F.col("label").alias("_label"), "k")
    grouped = rows.join(groups, F.col("series").eqNullSafe(F.col("_series")) & F.col("label").eqNullSafe(F.col("_label"))).drop("_series", "_label")
    placed = running_sum(grouped, ["series"], ["k", "row_no"], F.lit(1), "_at").withColumn("part", F.floor((F.col("_at") - 1) / most))
    name = _code(F.col("label"), scheme, F.col("label"))

    def number(x: Column) -> Column:
        points, unit = x["points"], F.nullif(x["unit"], F.lit(""))
        flat = F.flatten(F.transform(points, lambda p: F.array(p["u"], p["v"])))
        shape = F.when(F.size(points) > 2, "POLYLINE").when(F.size(points) == 2, "LINE").otherwise("POINT")
        scoord = F.array(F.struct(F.lit("INFERRED FROM").alias("RelationshipType"), F.lit("SCOORD").alias("ValueType"), shape.alias("GraphicType"), flat.alias("GraphicData")))
        measured = F.array(F.struct(half_up(x["value"], 2).alias("NumericValue"), _code(F.coalesce(unit, F.lit("1")), "UCUM", F.coalesce(unit, F.lit("no units"))).alias("MeasurementUnitsCodeSequence")))
        return _item("NUM", _code(x["kind"], scheme, F.col("label")), MeasuredValueSequence=measured, ContentSequence=scoord)

    numbers = F.transform("numbers", number)
    tracking = _item("TEXT", _named(TRACKING), TextValue=F.concat(F.lit(f"{prefix}."), F.col("k").cast("string")))
    finding = _item("CODE", _named(FINDING), ConceptCodeSequence=name)
    group = F.struct(F.lit("CONTAINS").alias("RelationshipType"), F.lit("CONTAINER").alias("ValueType"), _named(GROUP_CODE).alias("ConceptNameCodeSequence"), F.concat(F.array(tracking, finding), numbers).alias("ContentSequence"))
    # Dealt by part first: both groupings are then within a task.
    parts = dealt(placed, "series", "part").groupBy("series", "part", "k", "label").agg(F.array_sort(F.collect_list(F.struct("row_no", "kind", "value", "unit", "points"))).alias("numbers"))
    whole = parts.groupBy("series", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", group.alias("g")))), lambda x: x["g"]).alias("groups"))
    container = F.array(F.struct(F.lit("CONTAINS").alias("RelationshipType"), F.lit("CONTAINER").alias("ValueType"), _named(MEASUREMENTS).alias("ConceptNameCodeSequence"), F.col("groups").alias("ContentSequence")))
    tree = F.struct(F.lit("SR").alias("Modality"), F.lit(REPORT_CLASS).alias("SOPClassUID"), F.col("series").cast("string").alias("SeriesUID"), _named(REPORT).alias("ConceptNameCodeSequence"), container.alias("ContentSequence"))
    return whole.select("series", "part", F.to_json(tree).alias("json"))


def _must(ok: Column, value: Column, message: str, kind: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast(kind))


def read(documents: DataFrame, json: str = "json", series: str = "series") -> DataFrame:
    """series, part (where documents have it), group_no, item_no, label, kind, value, unit, points of reports that build() made;
    labels get SUFFIX.  Groups and items are numbered within their document.

    What is no such report raises tid1500-import, tid1500-bad-code, tid1500-bad-num or tid1500-bad-scoord."""
    top = F.get(F.filter(F.col("tree.ContentSequence"), lambda c: c["ValueType"] == "CONTAINER"), 0)
    name = F.get(top["ConceptNameCodeSequence"], 0)["CodeMeaning"]
    keys = [series, *(c for c in ("part",) if c in documents.columns)]
    parsed = documents.select(*keys, F.from_json(json, TREE).alias("tree"))
    groups = _must((name == MEASUREMENTS[1]) & (F.size(top["ContentSequence"]) > 0), top["ContentSequence"], "tid1500-import: missing Imaging Measurements container", f"array<{GROUP}>")
    exploded = parsed.select(*keys, F.posexplode(groups).alias("group_no", "g"))
    numbers = F.filter(F.col("g.ContentSequence"), lambda c: c["ValueType"] == "NUM")
    items = exploded.select(*keys, "group_no", F.posexplode(_must(F.size(numbers) > 0, numbers, "tid1500-import: group carries no NUM measurements", f"array<{ITEM}>")).alias("item_no", "n"))
    label = F.get(F.col("n.ConceptNameCodeSequence"), 0)["CodeMeaning"]
    measured = F.get(F.col("n.MeasuredValueSequence"), 0)
    scoord = F.get(F.filter(F.col("n.ContentSequence"), lambda c: c["ValueType"] == "SCOORD"), 0)["GraphicData"]
    data = F.coalesce(scoord, F.array().cast("array<double>"))
    pairs = F.when(F.size(data) > 0, F.transform(F.sequence(F.lit(0), F.floor(F.size(data) / 2).cast("int") - 1), lambda i: F.struct(F.get(data, 2 * i).alias("u"), F.get(data, 2 * i + 1).alias("v")))).otherwise(F.array().cast("array<struct<u:double,v:double>>"))
    even = (F.size(data) % 2 == 0) & ~F.exists(data, lambda x: x.isNull() | F.isnan(x))
    kind = F.when(label.startswith("angle"), "angle").when(label.startswith("roi"), "roi").otherwise("length")
    return items.select(
        *keys, "group_no", "item_no", F.concat(_must(F.length(label) > 0, label, "tid1500-bad-code", "string"), F.lit(SUFFIX)).alias("label"), kind.alias("kind"), _must(measured["NumericValue"].isNotNull(), measured["NumericValue"], "tid1500-bad-num", "double").alias("value"),
        F.coalesce(F.get(measured["MeasurementUnitsCodeSequence"], 0)["CodeMeaning"], F.lit("")).alias("unit"), _must(even, pairs, "tid1500-bad-scoord", "array<struct<u:double,v:double>>").alias("points"),
    )


def parts_of(body: bytes, boundary: str) -> Iterator[tuple[str, str | None, bytes]]:
    """(content type, location, body) of the parts of a multipart body; exactly one line break before a delimiter is its own."""
    mark = b"--" + boundary.encode()
    at = body.find(mark)
    if not boundary or at < 0:
        raise ValueError("multipart boundary not found")
    while True:
        at += len(mark)
        if body[at : at + 2] == b"--":
            return
        at += 2 * (body[at : at + 2] == b"\r\n")
        end = body.find(mark, at)
        if end < 0:
            raise ValueError("multipart body truncated: missing closing boundary")
        head, _, data = body[at:end].partition(b"\r\n\r\n")
        headers = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in head.decode("latin-1").split("\r\n") if ":" in line)}
        yield headers.get("content-type", "").split(";")[0].strip().lower(), headers.get("content-location"), data.removesuffix(b"\r\n")
        at = end


def multipart(documents: DataFrame, body: str = "body", boundary: str = "boundary") -> DataFrame:
    """part_no, content_type, location, content of multipart bodies (binary) with their boundary, one row per part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, mark in zip(batch.column(0), batch.column(1), strict=True):
                out = [(k, *p) for k, p in enumerate(parts_of(data.as_py(), mark.as_py()))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.string(), pa.binary()), strict=True)], names=["part_no", "content_type", "location", "content"])

    return documents.select(body, boundary).mapInArrow(run, "part_no int, content_type string, location string, content binary")
