"""Buildings and roads from map extracts in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayside.functions import text

# Tags that are kept, and the kinds of road that are drawn.
KEPT_TAGS = ("building", "name", "height", "building:levels", "amenity", "addr:street", "addr:housenumber")
ROAD_TYPES = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "unclassified", "living_street", "pedestrian", "footway")

EXTRACT = "elements array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"


def read_map_elements(spark: SparkSession, path: str) -> DataFrame:
    """The elements (type, id, tags, geometry) of extracts, a file of one JSON document each; null lists have none."""
    return spark.read.schema(EXTRACT).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")


def map_features(elements: DataFrame, road_types: tuple[str, ...] | None = ROAD_TYPES) -> DataFrame:
    """osm_id, kind (building, road), height_m, highway, name, tags, path of ways.

    Places without both coordinates go, then ways of under two places. A way with a building tag is a building if four places
    are left, and nothing else; others with a highway tag are roads, where ``road_types`` is given only of these types. Buildings
    keep ``KEPT_TAGS`` and get a height, to the centimetre; an element that neighbouring extracts repeat is given once,
    with the most places.
    """
    path = F.filter("geometry", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    tag = lambda *names: F.coalesce(*[F.nullif(F.col("tags")[n], F.lit("")) for n in names])
    ways = elements.filter("type = 'way'").withColumn("path", path).filter(F.size("path") >= 2)
    house, way = F.col("tags")["building"].isNotNull(), F.col("tags")["highway"].isNotNull()
    drawn = F.col("tags")["highway"].isin(*road_types) if road_types else F.lit(True)
    kind = F.when(house, F.when(F.size("path") >= 4, "building")).when(way & drawn, "road")
    once = F.row_number().over(Window.partitionBy("id").orderBy(F.size("path").desc(), F.to_json("path"), F.to_json("tags")))
    found = ways.withColumn("kind", kind).filter("kind is not null").withColumn("_n", once).filter("_n = 1")
    building = F.col("kind") == "building"
    return found.select(
        F.col("id").alias("osm_id"), "kind", F.when(building, F.round(text.building_height(tag("height", "building:height"), tag("building:levels", "levels")), 2)).alias("height_m"),
        F.when(~building, F.col("tags")["highway"]).alias("highway"), F.when(~building, F.coalesce(F.col("tags")["name"], F.lit(""))).alias("name"),
        F.when(building, F.map_filter("tags", lambda k, _: k.isin(*KEPT_TAGS))).alias("tags"), "path",
    )
