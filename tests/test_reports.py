import json

import pytest

from morpholake.sources import reports

ROWS = [("s", 1, "length", "Nodule 1", 20.125, "mm", [(0.0, 1.0), (2.0, 3.0)]), ("s", 2, "roi", "roi a", 5.0, "", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]), ("s", 3, "length", "Nodule 1", 1.0, "mm", []), ("t", 4, "angle", "angle x", 30.0, "deg", [(1.0, 1.0)])]


def test_reports_round_trip(spark):
    rows = spark.createDataFrame(ROWS, "series string, row_no int, kind string, label string, value double, unit string, points array<struct<u:double,v:double>>")
    built = reports.build(rows)
    tree = json.loads(built.filter("series = 's'").first().json)
    groups = tree["ContentSequence"][0]["ContentSequence"]
    assert [g["ContentSequence"][0]["TextValue"] for g in groups] == ["finding.1", "finding.2"] and len(groups[0]["ContentSequence"]) == 4
    assert [c["GraphicType"] for g in groups for n in g["ContentSequence"][2:] for c in n["ContentSequence"]] == ["LINE", "POINT", "POLYLINE"]
    back = reports.read(built).orderBy("series", "group_no", "item_no").collect()
    assert [(r.series, r.label, r.kind, r.value, r.unit, [tuple(p) for p in r.points]) for r in back] == [
        ("s", "Nodule 1 · SR import", "length", 20.13, "mm", [(0.0, 1.0), (2.0, 3.0)]), ("s", "Nodule 1 · SR import", "length", 1.0, "mm", []), ("s", "roi a · SR import", "roi", 5.0, "no units", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]), ("t", "angle x · SR import", "angle", 30.0, "deg", [(1.0, 1.0)]),
    ]


def test_a_large_report_is_cut_into_parts(spark):
    made = [("s", k, "length", f"L{k // 3 % 2}", float(k), "mm", []) for k in range(12)] + [("s", 12, "length", "M", 12.0, "mm", []), (None, 13, "roi", "roi N", 1.0, "mm", [])]
    rows = spark.createDataFrame(made, "series string, row_no int, kind string, label string, value double, unit string, points array<struct<u:double,v:double>>")
    built = reports.build(rows, most=4)
    trees = {(r.series, r.part): json.loads(r.json)["ContentSequence"][0]["ContentSequence"] for r in built.collect()}
    named = {k: [(g["ContentSequence"][0]["TextValue"], len(g["ContentSequence"]) - 2) for g in t] for k, t in trees.items()}
    assert named == {("s", 0): [("finding.1", 4)], ("s", 1): [("finding.1", 2), ("finding.2", 2)], ("s", 2): [("finding.2", 4)], ("s", 3): [("finding.3", 1)], (None, 0): [("finding.1", 1)]}
    back = reports.read(built).filter("series = 's'").orderBy("part", "group_no", "item_no").collect()
    assert [r.value for r in back] == [0.0, 1.0, 2.0, 6.0, 7.0, 8.0, 3.0, 4.0, 5.0, 9.0, 10.0, 11.0, 12.0]


@pytest.mark.parametrize(("doc", "name"), [({}, "tid1500-import"), ({"ContentSequence": [{"ValueType": "CONTAINER", "ConceptNameCodeSequence": [{"CodeMeaning": "Imaging Measurements"}], "ContentSequence": [{"ValueType": "CONTAINER", "ContentSequence": []}]}]}, "tid1500-import")])
def test_other_trees_are_refused(spark, doc, name):
    with pytest.raises(Exception, match=name):
        reports.read(spark.createDataFrame([("s", json.dumps(doc))], "series string, json string")).collect()


def test_multipart(spark):
    body = b"preamble\r\n--B\r\nContent-Type: application/dicom; x=1\r\nContent-Location: /a\r\n\r\nab\r\n\r\n--B\r\nContent-Type: text/plain\r\n\r\n\r\n--B--\r\n"
    rows = reports.multipart(spark.createDataFrame([(body, "B")], "body binary, boundary string")).orderBy("part_no").collect()
    assert [(r.content_type, r.location, bytes(r.content)) for r in rows] == [("application/dicom", "/a", b"ab\r\n"), ("text/plain", None, b"")]
    for bad, name in ((b"x", "not found"), (b"--B\r\nA: b\r\n\r\nx", "truncated")):
        with pytest.raises(ValueError, match=name):
            list(reports.parts_of(bad, "B"))
