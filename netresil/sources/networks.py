"""Road networks from OSM XML, GeoJSON and Parquet; metric histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netresil.functions.expressions import haversine_m
from netresil.functions.projection import wgs84_to_utm
from netresil.sources.osm import RANGE_BYTES, OsmSource

GEOJSON = (
    "type STRING, crs STRUCT<properties: STRUCT<name: STRING>>, features ARRAY<STRUCT<"
    "type: STRING, geometry: STRUCT<type: STRING, coordinates: ARRAY<ARRAY<DOUBLE>>>, properties: MAP<STRING, STRING>>>"
)
HISTORY = (
    "epoch INT, train_loss DOUBLE, train_iou DOUBLE, train_prec DOUBLE, train_rec DOUBLE, val_loss DOUBLE, "
    "val_iou DOUBLE, val_dice DOUBLE, val_prec DOUBLE, val_rec DOUBLE, val_breaks DOUBLE"
)


def read_osm(spark: SparkSession, path: str, zone: int = 43, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Nodes and undirected way segments of an OSM extract.

    Coordinates a node lacks default to 0. A segment's ``highway`` is the list
    of classes tagged on its way; ways without one are no roads. An XML file is
    read by one task per ``range_bytes``, see ``netresil.sources.osm``.
    """
    spark.dataSource.register(OsmSource)
    osm = spark.read.format("osm_xml").option("path", path).option("rangeBytes", range_bytes)
    raw = osm.option("element", "node").load()
    zero = F.lit(0.0)
    lon, lat = F.coalesce("lon", zero), F.coalesce("lat", zero)
    x, y = wgs84_to_utm(lon, lat, zone)
    nodes = raw.select(
        F.col("id").alias("node_id"), x.alias("x"), y.alias("y"), lon.alias("lon"), lat.alias("lat"),
        F.lit(0).alias("row"), F.lit(0).alias("col"),
    )
    ways = osm.option("element", "way").load()
    highway = F.transform(F.filter("tags", lambda t: t["k"] == "highway"), lambda t: t["v"])
    roads = ways.where(F.size(highway) > 0).select(F.col("id").alias("way_id"), highway.alias("highway"), "refs")
    n = F.size("refs")
    pairs = F.when(n > 1, F.arrays_zip(F.slice("refs", F.lit(1), n - 1).alias("u"), F.slice("refs", F.lit(2), n - 1).alias("v")))
    segs = roads.select("way_id", "highway", F.posexplode(pairs).alias("seq", "p")).select("way_id", "seq", "highway", "p.u", "p.v")
    a = nodes.select(F.col("node_id").alias("u"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    edges = segs.where(F.col("u") != F.col("v")).join(a, "u").join(b, "v").select(
        F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"), "way_id", "seq", "highway",
        haversine_m(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")).alias("length_m"),
    )
    return nodes, edges


def number_parallel(edges: DataFrame) -> DataFrame:
    """Key 0, 1, ... for the edges between two nodes, the shortest first."""
    w = Window.partitionBy("src", "dst").orderBy("length_m", "way_id", "seq")
    return edges.withColumn("edge_key", (F.row_number().over(w) - 1).cast("int"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of the lines in a feature collection: ``file, feature, seq, lon, lat``.

    Collections without features and features without geometry give no rows.
    """
    doc = spark.read.schema(GEOJSON).json(path, multiLine=True)
    return geojson_vertices(doc.withColumn("file", F.input_file_name()))


def geojson_vertices(documents: DataFrame) -> DataFrame:
    """Vertices of parsed collections ``file, features``."""
    feats = documents.select("file", F.posexplode("features").alias("feature", "f")).where(F.col("f.geometry.type") == "LineString")
    return feats.select("file", "feature", F.posexplode("f.geometry.coordinates").alias("seq", "p")).select(
        "file", "feature", "seq", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat")
    )


def vertices_to_segments(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive vertices of each line as segments, by equi-join on the next one."""
    nxt = vertices.select(*keys, (F.col("seq") - 1).alias("seq"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return vertices.select(*keys, "seq", F.col("lon").alias("lon1"), F.col("lat").alias("lat1")).join(nxt, [*keys, "seq"])


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def read_history(spark: SparkSession, runs: dict[str, str]) -> DataFrame:
    """Histories of several runs, tagged; a run whose file is missing is left out."""
    out = None
    for run, path in runs.items():
        if not _exists(spark, path):
            continue
        df = spark.read.schema(HISTORY).json(path, multiLine=True).select(F.lit(run).alias("run"), "*")
        out = df if out is None else out.unionByName(df)
    return spark.createDataFrame([], f"run STRING, {HISTORY}") if out is None else out


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def tile_catalog(spark: SparkSession, root: str, glob: str = "*.tif", directory: str | None = None) -> DataFrame:
    """Files under ``root`` by name pattern: ``path, stem``; file contents are not read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root).select("path")
    if directory is not None:
        df = df.where(F.col("path").contains(f"/{directory}/"))
    return df.withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))


def write_metrics(doc: DataFrame, path: str) -> None:
    doc.coalesce(1).write.mode("overwrite").json(path)  # one small document


def write_features(features: DataFrame, path: str) -> None:
    """GeoJSON features, one per line."""
    features.select("feature").write.mode("overwrite").text(path)
