"""Files cut at any byte: JSON documents and CSV with quoted line breaks against the parsers of the standard library."""

import csv
import io
import json
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql.types import LongType, StringType, StructField, StructType

from segrisk.sources import blocks, geojson, tables

PROPERTIES = StructType([StructField("id", LongType()), StructField("s", StringType())])


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few hundred bytes, so that many tasks share a file."""
    names = {"spark.sql.files.maxPartitionBytes": "900", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def features(n, seed=1):
    rng = random.Random(seed)

    def value():
        return rng.choice(["a{b", "}", "\\", '"}', "é{", 'x\\\\"{', "", '{"type":"x"}', "\n", "日本", "\\\\"])

    return [
        {
            "type": "Feature",
            "properties": {"id": i, "s": value(), "o": {"k": value(), "l": [{}, {"m": value()}]}},
            "geometry": {"type": "Point", "coordinates": [1.5, i]},
            "long": "y{" * (1500 if i == 50 else 600 if i % 37 == 0 else rng.choice([0, 5])),
        }
        for i in range(n)
    ]


def document(found):
    crs = {"type": "name", "properties": {"name": "x}{"}}
    return {"type": "FeatureCollection", "crs": crs, "features": found, "end": {"a": "{"}}


@pytest.mark.parametrize("layout", [{"ensure_ascii": False}, {"indent": 1}, {"separators": (",", ":")}])
def test_features_across_blocks(spark, tmp_path, tiny_splits, layout):
    want = features(90)
    for name, own in (("a", want[:60]), ("b", want[60:]), ("c", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps(document(own), **layout) + "\n\n", encoding="utf-8")
    assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 20
    texts = [json.loads(r.text) for r in blocks.scan_objects(spark, str(tmp_path)).collect()]
    found = sorted((t for t in texts if t.get("type") == "Feature"), key=lambda t: t["properties"]["id"])
    assert found == want and len(texts) == len(want) + 2 * 3
    points = geojson.scan_geojson_points(spark, str(tmp_path), PROPERTIES, layout="collection")
    assert sorted(tuple(r) for r in points.collect()) == [
        (f["properties"]["id"], f["properties"]["s"], 1.5, float(f["properties"]["id"])) for f in want
    ]


def test_cut_off_document_raises(spark, tmp_path, tiny_splits):
    (tmp_path / "a.json").write_text(json.dumps(document(features(30)))[:2500])
    with pytest.raises(PySparkException, match="not a whole GeoJSON feature"):
        geojson.scan_geojson_points(spark, str(tmp_path), PROPERTIES, layout="collection").collect()


def test_structure_equals_a_scalar_scan():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(['"', "{", "}", "\\\\", '\\"', "\\n", "a", "é"]) for _ in range(rng.randrange(1, 40)))
        for inside in (False, True):
            state, escaped, want = inside, False, []
            for i, c in enumerate(text.encode()):
                c = chr(c)
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == '"':
                    state = not state
                elif c in "{}" and not state:
                    want.append((i, 1 if c == "{" else -1))
            at, step, end = blocks.json_structure(np.frombuffer(text.encode(), np.uint8), inside)
            assert list(zip(at.tolist(), step.tolist(), strict=True)) == want and end == state


def test_quoted_lines_across_blocks(spark, tmp_path, tiny_splits):
    rng = random.Random(3)
    values = ["a", "b\nc", 'q"x\n"y', "z" * 900, "", "\n\n", "é,\n", "\n" * 600]
    rows = [[str(i), rng.choice(values), "end"] for i in range(300)]
    for name, own, last in (("a", rows[:200], "\n"), ("b", rows[200:], "")):
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(own)
        (tmp_path / f"{name}.csv").write_text(out.getvalue()[: -1 if not last else None], encoding="utf-8")
    texts = [r.text for r in blocks.scan_quoted_lines(spark, str(tmp_path)).collect()]
    found = [next(csv.reader(io.StringIO(t, newline=""))) for t in texts]
    assert sorted(found, key=lambda r: int(r[0])) == rows


def test_crashes_with_line_breaks(spark, tmp_path, tiny_splits):
    rows = [["LATITUDE", "LONGITUDE", "DATE", "NOTE"]]
    rows += [[str(40 + i / 100), "-79.5", f"d{i}", random.Random(i).choice(["x", 'a\n"b",c', "y\n" * 300])] for i in range(100)]
    for name, own in (("a", rows[:61]), ("b", [rows[0], *rows[61:]])):
        with open(tmp_path / f"{name}.csv", "w", newline="") as file:
            csv.writer(file, lineterminator="\n").writerows(own)
    found = tables.scan_crash_csv(spark, str(tmp_path), multi_line=True)
    assert found.columns == ["latitude", "longitude", "date", "note"]
    want = [(40 + i / 100, -79.5, r[2], r[3]) for i, r in enumerate(rows[1:])]
    assert sorted(map(tuple, found.collect())) == sorted(want)
