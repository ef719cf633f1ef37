"""Sources (S) and sinks (K): write with the library or plain Spark, read back, compare with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfold import sinks, sources
from gridfold.functions.geomtext import geojson_of, wkt_of
from gridfold.functions.measure import area
from gridfold.functions.project import reproject
from gridfold.functions.props import json_value
from gridfold.plans.catalog import Catalog
from gridfold.registry.base import BP, PC, PO, ctes, customers, event_rows, orders, part_boxes, query, table, xy
from gridfold.schema import computed
from gridfold.session import new_path
from gridfold.streaming import appended_count, read_appended, stream_append

NAMED = ctes(PC) + "SELECT fid, round(lng, 6) AS lng, round(lat, 6) AS lat, c_name FROM pc"
PLACED = ctes(PO) + "SELECT fid, round(lng, 6) AS lng, round(lat, 6) AS lat FROM po"


def _named(df):
    return df.select("fid", *xy(), json_value(F.col("properties"), "c_name").alias("c_name"))


def _placed(df):
    return df.select("fid", *xy())


def _documents(spark, d, size=100):
    """Feature texts with an id member, ``size`` to a document."""
    one = customers(spark, d).select(
        (F.col("fid") / size).cast("bigint").alias("page"),
        sinks.feature_text(
            F.col("geom"), F.concat(F.lit('{"id":'), F.col("fid"), F.lit(","), F.expr("substr(properties, 2)"))
        ).alias("feature"),
    )
    listed = F.array_join(F.collect_list("feature"), ",")
    return one.groupBy("page").agg(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), listed, F.lit("]}")).alias("value")
    )


@query("S1_read_geojson", NAMED)
def s1(spark, d):
    path = new_path(spark, "geojson")
    _documents(spark, d).select("value").write.text(path)
    return _named(sources.read_geojson(spark, path, lines=True, fid_property="id"))


@query("S1_split_documents", NAMED)
def s1_split(spark, d):
    """Documents that tasks cut into features by their byte ranges."""
    return _named(sources.read_geojson(spark, _pages(spark, d), fid_property="id", split=True))


@query("S2_geojson_crs", "SELECT c_custkey AS fid, 'EPSG:' || (32600 + c_nationkey)::VARCHAR AS crs FROM customer")
def s2(spark, d):
    code = (F.col("c_nationkey") + 32600).cast("string")
    doc = F.concat(
        F.lit('{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:EPSG::'),
        code,
        F.lit('"}},"features":[]}'),
    )
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("fid"), doc.alias("value"))
    return docs.select("fid", sources.document_crs(docs).alias("crs"))


def _csv(spark, df, sep=","):
    path = new_path(spark, "csv")
    df.write.csv(path, header=True, sep=sep, quote='"', escape='"')
    return path


@query("S3_read_csv", "SELECT c_custkey AS fid, c_name || '; \"' || c_mktsegment || '\"' AS label FROM customer")
def s3(spark, d):
    label = F.concat("c_name", F.lit('; "'), "c_mktsegment", F.lit('"'))
    rows = table(spark, d, "customer").select("c_custkey", label.alias("label"), F.lit(" ").alias("blank"))
    path = _csv(spark, rows, ";")
    out = sources.read_csv_features(spark, path, table=True, fid_column="c_custkey")
    return out.select("fid", json_value(F.col("properties"), "label").alias("label"))


@query("S3_csv_line_ends", "SELECT c_custkey AS fid, c_name || chr(10) || '\"' || chr(13) || chr(10) || c_mktsegment AS label FROM customer")
def s3_lines(spark, d):
    """Line ends and quotes inside quoted fields; files are cut by their byte ranges."""
    label = F.concat("c_name", F.lit('\n"\r\n'), "c_mktsegment")
    rows = table(spark, d, "customer").select("c_custkey", label.alias("label"))
    out = sources.read_csv_features(spark, _csv(spark, rows), table=True, fid_column="c_custkey")
    return out.select("fid", json_value(F.col("properties"), "label").alias("label"))


def _numbers(spark, d):
    b = F.col("bbox")
    return customers(spark, d).select(
        F.col("fid").alias("id"),
        json_value(F.col("properties"), "c_name").alias("c_name"),
        b["xmin"].alias("x"),
        b["ymin"].alias("y"),
        "geom",
    )


@query("S4_csv_lat_lng", NAMED)
def s4(spark, d):
    rows = _numbers(spark, d).select("id", "c_name", F.col("y").alias("Latitude"), F.col("x").alias("Lon"))
    return _named(sources.read_csv_features(spark, _csv(spark, rows), fid_column="id"))


@query("S5_csv_pair", NAMED)
def s5(spark, d):
    rows = _numbers(spark, d).select("id", "c_name", F.concat_ws(", ", "y", "x").alias("LatLng"))
    return _named(sources.read_csv_features(spark, _csv(spark, rows), fid_column="id"))


@query("S6_csv_geometry_text", ctes(BP) + "SELECT fid, round((xmax - xmin) * (ymax - ymin), 9) AS area FROM bp")
def s6(spark, d):
    g = F.col("geom")
    text = F.when(F.col("fid") % 2 == 0, wkt_of(g)).otherwise(geojson_of(g))
    rows = part_boxes(spark, d).select(F.col("fid").alias("id"), text.alias("The_Geom"), F.lit(1).alias("lat"), F.lit(2).alias("lng"))
    out = sources.read_csv_features(spark, _csv(spark, rows), fid_column="id")
    return out.select("fid", F.round(area(g), 9).alias("area"))


def _lines(spark, df):
    path = new_path(spark, "json")
    df.write.json(path)
    return path


@query("S7_json_array", NAMED)
def s7(spark, d):
    rows = _numbers(spark, d).select("id", "c_name", F.col("y").alias("lat"), F.col("x").alias("lng"))
    return _named(sources.read_json_array(spark, _lines(spark, rows), lines=True, fid_property="id"))


@query("S7_json_array_shape", NAMED)
def s7_shape(spark, d):
    rows = _numbers(spark, d).select("id", "c_name", geojson_of(F.col("geom")).alias("geo_shape"))
    return _named(sources.read_json_array(spark, _lines(spark, rows), lines=True, fid_property="id"))


BLANKS = NAMED + " WHERE fid % 3 <> 1"


def _blanks(spark, d):
    """A third of the rows, the first one among them, has no position."""
    return _numbers(spark, d).withColumn("geom", F.when(F.col("id") % 3 != 1, F.col("geom")))


@query("S5_csv_pair_blank_first", BLANKS)
def s5_blank(spark, d):
    pair = F.when(F.col("geom").isNotNull(), F.concat_ws(", ", "y", "x"))
    rows = _blanks(spark, d).select("id", "c_name", pair.alias("spot"))
    return _named(sources.read_csv_features(spark, _csv(spark, rows.orderBy("id")), fid_column="id"))


@query("S6_csv_geometry_blank_first", BLANKS)
def s6_blank(spark, d):
    rows = _blanks(spark, d).select("id", "c_name", wkt_of(F.col("geom")).alias("outline"))
    return _named(sources.read_csv_features(spark, _csv(spark, rows.orderBy("id")), fid_column="id"))


@query("S7_json_blank_first", BLANKS)
def s7_blank(spark, d):
    rows = _blanks(spark, d).select("id", "c_name", geojson_of(F.col("geom")).alias("shape")).orderBy("id")
    path = new_path(spark, "json")
    rows.write.option("ignoreNullFields", "false").json(path)
    return _named(sources.read_json_array(spark, path, lines=True, fid_property="id"))


@query("S8_read_geoparquet", NAMED)
def s8(spark, d):
    path = new_path(spark, "parquet")
    with_id = customers(spark, d).withColumn(
        "properties", F.concat(F.lit('{"id":'), F.col("fid"), F.lit(","), F.expr("substr(properties, 2)"))
    )
    sinks.write_parquet(with_id, path)
    return _named(sources.read_geoparquet(spark, path, fid_column="id"))


@query("S9_table_only", "SELECT event_id AS fid, json_extract_string(props, '$.k') AS k, true AS no_geometry FROM events")
def s9(spark, d):
    rows = event_rows(spark, d).select(F.col("fid").alias("id"), json_value(F.col("properties"), "k").alias("k"))
    out = sources.read_csv_features(spark, _csv(spark, rows), fid_column="id")
    return out.select("fid", json_value(F.col("properties"), "k").alias("k"), F.col("geom").isNull().alias("no_geometry"))


@query("S10_format_resolution", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'geoparquet' WHEN 2 THEN 'geojson'
  WHEN 3 THEN 'geoparquet' ELSE 'geojson' END AS format FROM pages""")
def s10(spark, d):
    k = F.col("page_id") % 5
    tail = (
        F.when(k == 0, "/a.b.TSV?x=.json").when(k == 1, "/exports/parquet").when(k == 2, "/a.JSON#top").when(k == 3, "/p.geoparquet").otherwise("/data.bin")
    )
    stem = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", sources.format_column(F.concat(stem, tail)).alias("format"))


@query("S11_projected_guard", "SELECT count(*)::BIGINT AS n, true AS refused FROM customer")
def s11(spark, d):
    flat = customers(spark, d).withColumn("geom", reproject(F.col("geom"), "EPSG:4326", "EPSG:3857"))
    rows = flat.select(F.col("fid").alias("id"), wkt_of(F.col("geom")).alias("wkt"))
    path = _csv(spark, rows)
    try:
        sources.read_csv_features(spark, path)
        refused = False
    except ValueError:
        refused = True
    read = sources.read_csv_features(spark, path, crs="EPSG:3857")
    return read.agg(F.count(F.lit(1)).alias("n")).withColumn("refused", F.lit(refused))


@query("S12_reproject_on_load", PLACED)
def s12(spark, d):
    flat = computed(orders(spark, d), geom=reproject(F.col("geom"), "EPSG:4326", "EPSG:32610"))
    rows = flat.select(F.col("fid").alias("id"), wkt_of(F.col("geom")).alias("wkt"))
    return _placed(sources.read_csv_features(spark, _csv(spark, rows), crs="EPSG:32610", fid_column="id"))


@query("S13_value_typing", """SELECT event_id AS fid, CASE WHEN event_id % 2 = 0 THEN 'number' ELSE 'text' END AS kind,
  CASE WHEN event_id % 2 = 0 THEN value END AS value FROM events""")
def s13(spark, d):
    mixed = F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")).otherwise(F.concat(F.lit("v"), F.col("value")))
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), mixed.alias("v"))
    out = sources.read_csv_features(spark, _csv(spark, rows), table=True, fid_column="id")
    v = F.from_json("properties", "map<string,variant>")["v"]
    number = F.schema_of_variant(v).isin("BIGINT", "DOUBLE") | F.schema_of_variant(v).startswith("DECIMAL")
    return out.select(
        "fid",
        F.when(number, "number").otherwise("text").alias("kind"),
        F.when(number, json_value(F.col("properties"), "v").cast("double")).alias("value"),
    )


def _pages(spark, d, size=100):
    path = new_path(spark, "pages")
    # One document per page key and file; a document holds ``size`` features.
    _documents(spark, d, size).repartition("page").write.partitionBy("page").text(path)
    return f"{path}/page=*"


@query("S14_read_pages", NAMED)
def s14(spark, d):
    out = sources.read_pages(spark, _pages(spark, d))
    back = out.withColumn("fid", json_value(F.col("properties"), "id").cast("bigint"))
    return _named(back)


@query("S14_pages_blank_first", BLANKS)
def s14_blank(spark, d):
    """Plain pages; no item of the first one has a shape."""
    rows = _numbers(spark, d).withColumn("page", (F.col("id") % 3 + 2) % 3)
    item = F.to_json(F.struct("id", "c_name", F.when(F.col("page") != 0, geojson_of(F.col("geom"))).alias("shape")), {"ignoreNullFields": "false"})
    many = rows.select((F.col("page") * 1000 + F.floor(F.col("id") / 300)).alias("page"), item.alias("item"))
    docs = many.groupBy("page").agg(F.concat(F.lit("["), F.array_join(F.collect_list("item"), ","), F.lit("]")).alias("value"))
    path = new_path(spark, "pages")
    docs.repartition("page").write.partitionBy("page").text(path)
    out = sources.read_pages(spark, f"{path}/page=*")
    return _named(out.withColumn("fid", json_value(F.col("properties"), "id").cast("bigint")))


def _arriving(spark, d):
    """Pages for a stream.  A larger table comes in larger pages, of a hundred features at least, some thousand files in all."""
    return _pages(spark, d, max(100, table(spark, d, "customer").count() // 1000))


@query("T1_restarted_count", "SELECT count(*)::BIGINT AS features, count(*)::BIGINT AS ids, count(*)::BIGINT AS counted FROM customer")
def t1_count(spark, d):
    """A stream that is stopped and started again: numbered items, and the count kept beside them."""
    pages, data, mark = _arriving(spark, d), new_path(spark, "appended"), new_path(spark, "progress")
    for _ in range(2):
        stream_append(spark, pages, data, mark, max_files_per_trigger=7).awaitTermination()
    found = read_appended(spark, data).agg(F.count(F.lit(1)).alias("features"), F.countDistinct("fid").alias("ids"))
    return found.withColumn("counted", F.lit(appended_count(spark, data)))


@query("T1_stream_append", NAMED)
def t1(spark, d):
    pages, data, mark = _arriving(spark, d), new_path(spark, "appended"), new_path(spark, "progress")
    stream_append(spark, pages, data, mark, max_files_per_trigger=20, fid_property="id").awaitTermination()
    return _named(read_appended(spark, data))


@query("K1_write_geojson", NAMED)
def k1(spark, d):
    path = new_path(spark, "geojson")
    sinks.write_geojson(customers(spark, d), path)
    schema = "geometry struct<type:string,coordinates:array<double>>, properties struct<c_name:string>"
    rows = spark.read.schema(schema).json(path)
    xyc = F.col("geometry.coordinates")
    key = F.regexp_extract("properties.c_name", r"(\d+)$", 1).cast("bigint")
    return rows.select(key.alias("fid"), F.round(xyc[0], 6).alias("lng"), F.round(xyc[1], 6).alias("lat"), F.col("properties.c_name").alias("c_name"))


@query("K2_write_csv", ctes(PC) + """SELECT c_name, c_mktsegment, c_nationkey::VARCHAR AS c_nationkey,
  round(c_acctbal, 2) AS c_acctbal, round(lng, 6) AS lng, round(lat, 6) AS lat FROM pc""")
def k2(spark, d):
    path = new_path(spark, "csv")
    sinks.write_csv(customers(spark, d), path)
    rows = spark.read.csv(path, header=True)
    return rows.select(
        "c_name", "c_mktsegment", "c_nationkey", F.round(F.col("c_acctbal").cast("double"), 2).alias("c_acctbal"),
        F.round(F.regexp_extract("geometry", r"^POINT \((\S+) (\S+)\)$", 1).cast("double"), 6).alias("lng"),
        F.round(F.regexp_extract("geometry", r"^POINT \((\S+) (\S+)\)$", 2).cast("double"), 6).alias("lat"),
    )


@query("K3_write_parquet", ctes(BP) + """SELECT round((xmin + xmax) / 2, 6) AS x, round((ymin + ymax) / 2, 6) AS y,
  round((xmax - xmin) * (ymax - ymin), 9) AS area, p_brand, p_name, p_size::VARCHAR AS p_size FROM bp JOIN part ON p_partkey = fid""")
def k3(spark, d):
    from gridfold.functions import kernel
    from gridfold.functions.measure import centroid

    path = new_path(spark, "parquet")
    sinks.write_parquet(part_boxes(spark, d), path)
    rows = computed(spark.read.parquet(path), geom=kernel.unpack(F.col("geometry")))
    c = computed(rows, c=centroid(F.col("geom")))
    return c.select(F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"), F.round(area(F.col("geom")), 9).alias("area"), "p_brand", "p_name", "p_size")


def _catalog(spark, d):
    catalog = Catalog(spark)
    catalog.register("customers", customers(spark, d))
    catalog.register("parts", part_boxes(spark, d))
    return catalog


@query("K6_run_outputs", """SELECT * FROM (VALUES ('customers', 'csv', 'complete', (SELECT count(*) FROM customer)::BIGINT),
  ('missing', 'csv', 'error', NULL), ('parts', 'parquet', 'complete', (SELECT count(*) FROM part)::BIGINT)) t(source, format, status, n)""")
def k6(spark, d):
    specs = [
        {"source": "customers", "format": "csv"},
        {"source": "missing", "format": "csv"},
        {"source": "parts", "format": "parquet"},
    ]
    folder = new_path(spark, "outputs")
    status = sinks.run_outputs(_catalog(spark, d), specs, folder)
    counts = spark.read.csv(f"{folder}/customers.csv", header=True).select(F.lit("customers").alias("source"))
    counts = counts.unionByName(spark.read.parquet(f"{folder}/parts.parquet").select(F.lit("parts").alias("source")))
    counts = counts.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return status.join(counts, "source", "left").select("source", "format", "status", "n")


@query("K7_bundle", """SELECT 'parts near' AS name, './data/parts-near' AS url, (SELECT count(*) FROM part WHERE p_size > 25)::BIGINT AS n
  UNION ALL SELECT 'Parts! Near', './data/parts-near-2', (SELECT count(*) FROM part WHERE p_size <= 25)::BIGINT""")
def k7(spark, d):
    catalog = Catalog(spark)
    parts = part_boxes(spark, d)
    size = json_value(F.col("properties"), "p_size").cast("int")
    catalog.register("big", parts.where(size > 25), name="parts near")
    catalog.register("small", parts.where(size <= 25), name="Parts! Near")
    folder = new_path(spark, "bundle")
    manifest = sinks.write_bundle(catalog, folder)
    big = spark.read.text(f"{folder}/data/parts-near").select(F.lit("parts near").alias("name"))
    small = spark.read.text(f"{folder}/data/parts-near-2").select(F.lit("Parts! Near").alias("name"))
    counts = big.unionByName(small).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return manifest.join(counts, "name").select("name", "url", "n")


