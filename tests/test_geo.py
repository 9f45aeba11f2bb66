import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import geo


def square(x, y, side):
    return [[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]


FEATURES = [
    ("Antioquia", "Polygon", [square(-76, 5, 2)]),
    ("Bolívar", "MultiPolygon", [[square(-75, 8, 1)], [square(-74, 9, 3), square(-73, 10, 1)]]),
    ("Bogotá", "Point", [-74.1, 4.6]),
    ("Odd", "LineString", [[0, 0], [1, 1]]),
    ("Broken", "Polygon", "x"),
    (None, "Point", [0, 0]),
]


def feature(name, kind, coordinates):
    return {"type": "Feature", "properties": {"department": name, "n": 3}, "geometry": {"type": kind, "coordinates": coordinates}}


@pytest.fixture(scope="module", params=[False, True])
def features(spark, tmp_path_factory, request):
    path = tmp_path_factory.mktemp("geo") / "departments.geojson"
    rows = [feature(*f) for f in FEATURES]
    path.write_text("\n".join(map(json.dumps, rows)) if request.param else json.dumps({"type": "FeatureCollection", "features": rows}, indent=1))
    return geo.read_features(spark, str(path), "department", lines=request.param)


def test_features(features):
    rows = {r.name: r for r in features.withColumns({"box": geo.box(F.col("shape")), "area": geo.area(F.col("shape"))}).collect()}
    assert set(rows) == {"Antioquia", "Bolívar", "Bogotá", "Odd", "Broken"}
    assert rows["Bolívar"].key == "bolivar" and rows["Bolívar"].properties["n"] == "3"
    assert tuple(rows["Antioquia"].box) == (-76, 5, -74, 7) and tuple(rows["Bolívar"].box) == (-75, 8, -71, 12) and tuple(rows["Bogotá"].box) == (-74.1, 4.6, -74.1, 4.6)
    assert (rows["Antioquia"].area, rows["Bolívar"].area, rows["Bogotá"].area) == (4, 9, 0)
    assert rows["Odd"].box is None and rows["Odd"].area is None and not rows["Broken"].box


def test_joins_by_name_and_alias(spark, features):
    users = spark.createDataFrame([(1, "ANTIOQUIA "), (2, "bolivar"), (3, "Santafé"), (4, "Nowhere"), (5, None)], "user_id int, department string")
    aliases = {"Santa fe": "Bogota", "Santafe": "Bogotá"}
    shaped = {r.user_id: r.kind for r in geo.with_shape(users, "department", features.unionByName(features), aliases).collect()}
    assert shaped == {1: "Polygon", 2: "MultiPolygon", 3: "Point", 4: None, 5: None}
    assert [(r.name, r.n) for r in geo.unmatched(users, "department", features, aliases).collect()] == [("Nowhere", 1)]
    valued = {r.name: r.value for r in geo.with_value(features, users, "department", "user_id", aliases).collect()}
    assert valued == {"Antioquia": 1, "Bolívar": 2, "Bogotá": 3, "Odd": None, "Broken": None}
    assert geo.with_shape(users.limit(0), "department", features).columns == ["user_id", "department", "kind", "shape"]
