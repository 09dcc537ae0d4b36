import json
import math
import os
from urllib.parse import urlparse

import pytest
from helpers import roads_df
from pyspark.errors import PySparkException
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from segrisk.session import materialise, materialise_all, new_path, shared_dir, temporary
from segrisk.sources.bundle import ROAD_PROPERTIES, dataset_profile, export_parquet, load_dataset, scan_parquet_roads
from segrisk.sources.geojson import export_geojson, scan_geojson_lines, scan_geojson_points
from segrisk.sources.tables import scan_crash_csv, scan_road_class, scan_speed

ROADS = [
    (1, [[(-79.4, 43.65), (-79.39, 43.66)]], "D1"),
    (2, [[(-79.4, 43.65), (-79.39, 43.66)], [(-79.3, 43.6), (-79.2, 43.7), (-79.1, 43.7)]], None),
    (3, None, 'quote " and \\ slash'),
]


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_attribute_csv_by_name_with_missing_tokens(spark, tmp_path):
    path = write(
        tmp_path,
        "speed.csv",
        "OBJECTID;SPEED_LIMIT;ORN_ROAD_NET_ELEMENT_ID\n1;50;10\n2;;11\n3;NA;12.0\n4;nan;\n5;7e1;13\n",
    )
    rows = [tuple(r) for r in scan_speed(spark, path).collect()]
    assert rows == [(10, 50.0), (11, None), (12, None), (None, None), (13, 70.0)]
    classes = write(tmp_path, "class.csv", "ORN_ROAD_NET_ELEMENT_ID;ROAD_CLASS\n1;Local / Street\n2;N/A\n")
    assert [tuple(r) for r in scan_road_class(spark, classes).collect()] == [(1, "Local / Street"), (2, None)]
    with pytest.raises(ValueError, match="speed_limit"):
        scan_speed(spark, classes)
    bad = write(tmp_path, "bad.csv", "ORN_ROAD_NET_ELEMENT_ID;SPEED_LIMIT\n1;fast\n")
    with pytest.raises(PySparkException):
        scan_speed(spark, bad).collect()


def test_crash_csv_keeps_other_columns(spark, tmp_path):
    text = 'ACCNUM,DATE,LATITUDE,LONGITUDE,STREET\n1,"1/2/2020 3:04:05 PM",43.5,-79.5,"KING, W ""X"""\n2,,,NaN,None\n'
    df = scan_crash_csv(spark, write(tmp_path, "crashes.csv", text))
    assert dict(df.dtypes)["latitude"] == "double"
    assert [tuple(r) for r in df.collect()] == [
        ("1", "1/2/2020 3:04:05 PM", 43.5, -79.5, 'KING, W "X"'),
        ("2", None, None, None, None),
    ]


def collection(features):
    return {"type": "FeatureCollection", "name": "roads", "features": features}


def feature(properties, geometry):
    return {"type": "Feature", "properties": properties, "geometry": geometry}


@pytest.mark.parametrize("layout", ["lines", "collection"])
def test_geojson_geometries(spark, tmp_path, layout):
    features = [
        feature({"ogf_id": 1, "district": "A"}, {"type": "LineString", "coordinates": [[1, 2], [3, 4, 9]]}),
        feature(
            {"ogf_id": 2}, {"type": "MultiLineString", "coordinates": [[[1, 2], [3, 4]], [[5, 6], [7.5, 8]]]}
        ),
        feature({"ogf_id": 3}, None),
    ]
    if layout == "lines":
        # The layout of common writers: a header line, one feature per line with commas, a footer line.
        lines = ",\n".join(json.dumps(f) for f in features)
        text = '{\n"type": "FeatureCollection",\n"features": [\n' + lines + "\n]\n}\n"
    else:
        text = json.dumps(collection(features), indent=2)
    df = scan_geojson_lines(spark, write(tmp_path, "roads.geojson", text), ROAD_PROPERTIES, layout)
    rows = {r.ogf_id: ([[tuple(v) for v in line] for line in r.lines] if r.lines else None) for r in df.collect()}
    assert rows == {
        1: [[(1, 2), (3, 4)]],
        2: [[(1, 2), (3, 4)], [(5, 6), (7.5, 8)]],
        3: None,
    }
    with pytest.raises(ValueError, match="EPSG:3857"):
        scan_geojson_lines(spark, "x", ROAD_PROPERTIES, crs="EPSG:3857")
    with pytest.raises(ValueError, match="layout"):
        scan_geojson_lines(spark, "x", ROAD_PROPERTIES, layout="tiles")


KEY = StructType([StructField("ogf_id", LongType())])


def as_lines(folder, *features):
    return write(folder, "features.geojson", "\n".join(map(json.dumps, features)))


def test_points_and_their_geometry_types(spark, tmp_path):
    point = {"type": "Point", "coordinates": [1, 2]}
    path = as_lines(tmp_path, feature({"ogf_id": 1}, point), feature({"ogf_id": 2}, None),
                    feature({"ogf_id": 3}, {"type": "MultiPoint", "coordinates": [[5, 6]]}))
    rows = scan_geojson_points(spark, path, KEY).collect()
    assert {r.ogf_id: (r.longitude, r.latitude) for r in rows} == {1: (1, 2), 2: (None, None), 3: (5, 6)}
    for bad in (
        {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]},
        {"type": "Point", "coordinates": ["x", 2]},
        {"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [5, 6], [1, 2]]]},
    ):
        with pytest.raises(PySparkException, match="cannot read this geometry"):
            scan_geojson_points(spark, as_lines(tmp_path, feature({"ogf_id": 1}, bad)), KEY).collect()


@pytest.mark.parametrize(
    "bad",
    [
        {"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [5, 6], [1, 2]]]},
        {"type": "LineString", "coordinates": [[1, "x"], [3, 4]]},
        {"type": "LineString", "coordinates": [[1], [3, 4]]},
        {"type": "MultiLineString", "coordinates": [[[1, 2], [3, None]]]},
    ],
)
def test_lines_that_cannot_be_read_raise(spark, tmp_path, bad):
    with pytest.raises(PySparkException, match="cannot read this geometry"):
        scan_geojson_lines(spark, as_lines(tmp_path, feature({"ogf_id": 1, "district": "A"}, bad)), ROAD_PROPERTIES).collect()


def test_properties_in_any_case_and_ids_in_any_form(spark, tmp_path):
    line = {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}
    path = as_lines(tmp_path, *(feature({"OGF_ID": i, "District": "A"}, line) for i in (12, 13.0, "14", " 15.0 ", None)))
    rows = scan_geojson_lines(spark, path, ROAD_PROPERTIES).collect()
    assert [(r.ogf_id, r.district) for r in rows] == [(12, "A"), (13, "A"), (14, "A"), (15, "A"), (None, "A")]
    for wrong in (12.7, "12a", "1e3"):
        with pytest.raises(PySparkException, match="not a whole number"):
            scan_geojson_lines(spark, as_lines(tmp_path, feature({"ogf_id": wrong, "district": "A"}, line)), ROAD_PROPERTIES).collect()
    with pytest.raises(ValueError, match="district"):
        scan_geojson_lines(spark, as_lines(tmp_path, feature({"ogf_id": 1}, line)), ROAD_PROPERTIES)


def test_csv_ids_and_headers(spark, tmp_path):
    folder = tmp_path / "speed"
    folder.mkdir()
    write(folder, "a.csv", "ORN_ROAD_NET_ELEMENT_ID;SPEED_LIMIT\n12.0;50\n")
    assert [tuple(r) for r in scan_speed(spark, str(folder)).collect()] == [(12, 50.0)]
    write(folder, "b.csv", "SPEED_LIMIT;ORN_ROAD_NET_ELEMENT_ID\n70;2\n")
    with pytest.raises(Exception, match="b.csv"):
        scan_speed(spark, str(folder)).collect()
    fraction = write(tmp_path, "f.csv", "ORN_ROAD_NET_ELEMENT_ID;SPEED_LIMIT\n12.7;50\n")
    with pytest.raises(PySparkException, match="not a whole number"):
        scan_speed(spark, fraction).collect()
    text = 'ACCNUM,DATE,LATITUDE,LONGITUDE,STREET\n1,x,43.5,-79.5,"KING\nWEST"\n'
    crashes = scan_crash_csv(spark, write(tmp_path, "k.csv", text), multi_line=True)
    assert crashes.first().STREET == "KING\nWEST" if "STREET" in crashes.columns else crashes.first().street == "KING\nWEST"


@pytest.mark.parametrize(
    "text",
    [
        json.dumps(collection([feature({"ogf_id": 1}, None)])),
        json.dumps(collection([feature({"ogf_id": 1}, None)]), indent=1),
        json.dumps(feature({"ogf_id": 1}, None)) + '\n{"type": "Feature", "properties": {"ogf_id": 2}, "geom',
    ],
)
def test_features_are_never_lost_silently(spark, tmp_path, text):
    path = write(tmp_path, "roads.geojson", text)
    with pytest.raises(PySparkException, match="layout='collection'"):
        scan_geojson_lines(spark, path, ROAD_PROPERTIES).collect()


def test_export_round_trip(spark, tmp_path):
    roads = roads_df(spark, ROADS).selectExpr("*", "IF(ogf_id = 1, double('NaN'), 0.1) AS score")
    path = str(tmp_path / "out")
    export_geojson(roads, path)
    properties = StructType([*ROAD_PROPERTIES.fields, StructField("score", DoubleType())])
    back = scan_geojson_lines(spark, path, properties).orderBy("ogf_id").collect()
    for row, (ogf_id, lines, district) in zip(back, ROADS, strict=True):
        assert (row.ogf_id, row.district) == (ogf_id, district)
        assert (row.lines and [[tuple(v) for v in line] for line in row.lines]) == lines
    assert [r.score for r in back] == [None, 0.1, 0.1]
    texts = {json.loads(r.value)["properties"]["ogf_id"]: json.loads(r.value) for r in spark.read.text(path).collect()}
    assert texts[1]["geometry"]["type"] == "LineString" and texts[2]["geometry"]["type"] == "MultiLineString"
    assert texts[3]["geometry"] is None and texts[1]["properties"]["score"] is None
    table = str(tmp_path / "table")
    export_parquet(roads, table)
    assert spark.read.parquet(table).count() == 3
    with pytest.raises(ValueError, match="lines"):
        export_geojson(roads.drop("lines"), path)


def test_bundle_and_profile(spark, tmp_path):
    roads = str(tmp_path / "roads.geojson")
    export_geojson(roads_df(spark, ROADS), roads)
    ids = "ORN_ROAD_NET_ELEMENT_ID"
    dataset = load_dataset(
        spark,
        roads=roads,
        speed=write(tmp_path, "s.csv", f"{ids};SPEED_LIMIT\n1;50\n1;60\n"),
        lanes=write(tmp_path, "l.csv", f"{ids};NUMBER_OF_LANES\n1;2\n"),
        road_class=write(tmp_path, "c.csv", f"{ids};ROAD_CLASS\n"),
        crashes=write(tmp_path, "k.csv", "LATITUDE,LONGITUDE,DATE\n43.65,-79.4,bad\n"),
    )
    rows = {r.table_name: (r.n_rows, r.column_names) for r in dataset_profile(dataset).collect()}
    assert rows["roads"] == (3, "ogf_id,district,lines") and rows["speed"][0] == 2
    assert rows["road_class"] == (0, f"{ids.lower()},road_class") and rows["crashes"][0] == 1
    parquet = str(tmp_path / "roads.parquet")
    dataset.roads.write.parquet(parquet)
    assert load_dataset(
        spark, roads=parquet, **{k: str(tmp_path / f"{f}.csv") for k, f in
                                 zip(("speed", "lanes", "road_class", "crashes"), "slck", strict=True)}
    ).roads.count() == 3
    wrong = str(tmp_path / "wrong.parquet")
    dataset.roads.selectExpr("string(ogf_id) AS ogf_id", "lines", "district").write.parquet(wrong)
    with pytest.raises(ValueError, match="ogf_id"):
        scan_parquet_roads(spark, wrong)
    points = as_lines(tmp_path, feature({"DATE": "bad"}, {"type": "Point", "coordinates": [-79.4, 43.65]}))
    files = {k: str(tmp_path / f"{f}.csv") for k, f in zip(("speed", "lanes", "road_class"), "slc", strict=True)}
    loaded = load_dataset(spark, roads=parquet, crashes=points, **files)
    assert [tuple(r) for r in loaded.crashes.collect()] == [("bad", -79.4, 43.65)]


def test_materialised_tables_live_in_the_shared_folder(spark):
    assert new_path(spark, "t").startswith(shared_dir(spark) + "/")
    df = materialise(spark.createDataFrame([(1, math.pi)], "a int, b double"), "t")
    assert [tuple(r) for r in df.collect()] == [(1, math.pi)]
    assert shared_dir(spark) in df.inputFiles()[0]


def test_temporary_tables(spark):
    with temporary(spark) as keep:
        inside, other = materialise_all(a=spark.range(3), b=spark.range(4))
        with temporary(spark) as keep_inside:
            deep = materialise(inside.union(other), "deep")
            result = keep_inside(deep.groupBy("id").count(), "result")
            folders = [urlparse(df.inputFiles()[0]).path for df in (deep, inside, other, result)]
        assert list(map(os.path.exists, folders)) == [False, True, True, True]
        kept = keep(result, "kept")
    assert not any(map(os.path.exists, folders))
    assert sorted(map(tuple, kept.collect())) == [(0, 2), (1, 2), (2, 2), (3, 1)]
    with pytest.raises(ZeroDivisionError), temporary(spark):
        folders = [urlparse(materialise(spark.range(3), "a").inputFiles()[0]).path]
        raise ZeroDivisionError
    assert not any(map(os.path.exists, folders))
