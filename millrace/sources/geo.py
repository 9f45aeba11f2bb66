"""GeoJSON as typed columns, and joining figures to places by their folded names.

A feature becomes a row: its name, the folded key to join on, its properties, and its shape as
polygons of rings of (longitude, latitude), whatever of Polygon, MultiPolygon and Point it was.
Boxes and areas are expressions over these columns. A file that holds one collection is one task;
files with a feature a line (``lines``) are read in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X

FEATURE = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
POINT, RING, POLYGON, SHAPE = "array<double>", "array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"


def shape_of(kind: Column, coordinates: Column) -> Column:
    """Polygons of any geometry; null for kinds that have no place of their own here, and for coordinates that can't be read."""
    point = F.from_json(coordinates, POINT)
    return (
        F.when(kind == "MultiPolygon", F.from_json(coordinates, SHAPE))
        .when(kind == "Polygon", F.array(F.from_json(coordinates, POLYGON)))
        .when((kind == "Point") & (F.size(point) >= 2), F.array(F.array(F.array(point))))
    )


def read_features(spark: SparkSession, path: str, name: str, lines: bool = False) -> DataFrame:
    """(name, key, properties, kind, shape) of a file's features, by the property that names them; features without that name are left out."""
    if lines:
        rows = spark.read.schema(FEATURE).json(path)
    else:
        rows = spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(T.StructType.fromDDL(FEATURE)))])).json(path, multiLine=True).select(F.inline("features"))
    label = F.col("properties")[name]
    kind = F.col("geometry.type")
    return rows.where(label.isNotNull()).select(label.alias("name"), X.fold(label).alias("key"), "properties", kind.alias("kind"), shape_of(kind, F.col("geometry.coordinates")).alias("shape"))


def corners(shape: Column) -> Column:
    """All points of a shape's outer rings."""
    return F.flatten(F.transform(shape, lambda polygon: polygon[0]))


def box(shape: Column) -> Column:
    """struct<west, south, east, north>; null without points."""
    x, y = F.transform(corners(shape), lambda p: p[0]), F.transform(corners(shape), lambda p: p[1])
    return F.when(F.size(corners(shape)) > 0, F.struct(F.array_min(x).alias("west"), F.array_min(y).alias("south"), F.array_max(x).alias("east"), F.array_max(y).alias("north")))


def ring_area(ring: Column) -> Column:
    """Twice the signed area of a ring, in square degrees."""
    turn = F.transform(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, i: ring[i][0] * p[1] - p[0] * ring[i][1])
    return F.aggregate(turn, F.lit(0.0), lambda a, b: a + b)


def area(shape: Column) -> Column:
    """Square degrees of a shape, holes taken off."""
    polygon = lambda p: F.abs(ring_area(p[0])) - F.aggregate(F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda r: F.abs(ring_area(r))), F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(F.transform(shape, polygon), F.lit(0.0), lambda a, b: a + b) / 2


def place_key(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """The folded name, or that of the feature it is another name of."""
    key = X.fold(name)
    if not aliases:
        return key
    other = F.create_map(*[X.fold(F.lit(x)) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(other, key), key)


def with_shape(df: DataFrame, name: str, features: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """df with kind and shape of the feature that each row's place names; null where there is none. Doubled names keep the first by properties."""
    one = features.groupBy("key").agg(F.min_by(F.struct("kind", "shape"), F.to_json("properties")).alias("__feature"))
    keyed = df.withColumn("__key", place_key(F.col(name), aliases))
    return keyed.join(one.withColumnRenamed("key", "__key"), "__key", "left").select(*df.columns, "__feature.kind", "__feature.shape")


def unmatched(df: DataFrame, name: str, features: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(name, n): places of df that no feature has, and their rows."""
    keyed = df.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), place_key(F.col(name), aliases).alias("key"))
    return keyed.join(features.select("key"), "key", "left_anti").groupBy("name").agg(F.count("*").alias("n"))


def with_value(features: DataFrame, figures: DataFrame, name: str, value: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Every feature with the sum of a figure over the rows that name it; null for features without rows, which a map leaves blank."""
    sums = figures.groupBy(place_key(F.col(name), aliases).alias("key")).agg(F.sum(value).alias("value"))
    return features.join(sums, "key", "left")
