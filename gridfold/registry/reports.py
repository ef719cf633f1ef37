"""Preview, catalog order and declared pipelines (L, W, C)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold import operators as ops
from gridfold import sinks
from gridfold.plans.catalog import Catalog, backfill_order
from gridfold.plans.pipeline import run_pipeline
from gridfold.registry.base import (
    BL, BP, PC, PO, Z, ctes, customers, event_rows, lots, orders, part_boxes, query, table, zones,
)
from gridfold.functions.props import json_value
from gridfold.session import new_path


@query("L1_preview", "SELECT c_acctbal::VARCHAR AS c_acctbal, c_mktsegment, c_name, c_nationkey::VARCHAR AS c_nationkey FROM customer ORDER BY c_custkey LIMIT 50")
def l1(spark, d):
    return ops.preview(customers(spark, d), 50, order_by="fid")


LOADED = "SELECT source AS id, count(*)::BIGINT AS n, max(doc_id) AS last FROM documents GROUP BY source"


def _sources(spark, d):
    """A dataset catalog made from the documents table: one dataset per source."""
    per = table(spark, d, "documents").groupBy(F.col("source").alias("id"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("loaded_at"))


@query("W2_order_backfill", f"SELECT id, row_number() OVER (ORDER BY last, id)::INTEGER AS layer_order FROM ({LOADED})")
def w2(spark, d):
    return backfill_order(_sources(spark, d).withColumn("layer_order", F.lit(None).cast("int"))).select("id", "layer_order")


@query("W1_chunk_numbering", ctes(BP) + """, e AS (SELECT min(xmin) AS x, min(ymin) AS y, max(xmax) - min(xmin) AS w, max(ymax) - min(ymin) AS h FROM bp)
SELECT least(floor(((xmin + xmax) / 2 - x) / w * 64), 63)::INTEGER AS cx, least(floor(((ymin + ymax) / 2 - y) / h * 64), 63)::INTEGER AS cy,
  count(*)::BIGINT AS n, true AS salted FROM bp, e GROUP BY ALL""")
def w1(spark, d):
    """Chunks that the dissolve unites first: a cell of the middle of each shape, split over salts."""
    from gridfold.functions import kernel
    from gridfold.operators.combine import SALTS, chunked

    chunks = chunked(part_boxes(spark, d).select("fid", kernel.pack(F.col("geom")).alias("wkb"), "bbox"))
    in_range = F.bool_and(F.col("salt").between(0, SALTS - 1))
    return chunks.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), in_range.alias("salted"))


@query("L2_list_datasets", """SELECT * FROM (VALUES ('parts', 1, (SELECT count(*) FROM part)::BIGINT), ('customers', 2, (SELECT count(*) FROM customer)::BIGINT),
  ('orders', 3, (SELECT count(*) FROM orders)::BIGINT)) t(id, layer_order, feature_count)""")
def l2(spark, d):
    catalog = Catalog(spark)
    for name, df, hidden in (
        ("orders", orders(spark, d), False), ("events", event_rows(spark, d), True),
        ("customers", customers(spark, d), False), ("parts", part_boxes(spark, d), False),
    ):
        catalog.register(name, df, hidden=hidden)
        catalog.refresh_count(name)
    catalog.reorder(["parts", "customers", "orders"])
    return catalog.datasets().select("id", "layer_order", "feature_count")


SPEC = {
    "operations": [
        {"type": "contains", "inputs": ["zones", "customers"], "output": "inside", "params": {"mode": "within"}},
        {"type": "attribute", "input": "inside", "output": "rich", "params": {"property": "c_acctbal", "operator": ">", "value": 1000}},
        {"type": "join", "inputs": ["names", "rich"], "output": "named", "params": {"sourceKey": "n_nationkey", "targetKey": "c_nationkey"}},
        {"type": "union", "inputs": ["named", "customers"], "output": "all"},
    ]
}


def _frames(spark, d):
    from gridfold.schema import table_only

    n = table(spark, d, "nation")
    names = table_only(n, F.to_json(F.struct("n_nationkey", "n_name")), F.col("n_nationkey"))
    return {"zones": zones(spark, d), "customers": customers(spark, d), "names": names}


@query("C6_run_pipeline", ctes(PC, Z) + """SELECT coalesce(n_name, '-') AS nation, count(*)::BIGINT AS n FROM (
  SELECT nation.n_name FROM pc p LEFT JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 1000 AND EXISTS (
    SELECT 1 FROM z b WHERE p.lng > b.xmin AND p.lng < b.xmax AND p.lat > b.ymin AND p.lat < b.ymax)
  UNION ALL SELECT NULL FROM pc) GROUP BY 1""")
def c6(spark, d):
    catalog, _ = run_pipeline(spark, SPEC, frames=_frames(spark, d))
    nation = F.coalesce(json_value(F.col("properties"), "n_name"), F.lit("-")).alias("nation")
    return catalog.get("all").groupBy(nation).agg(F.count(F.lit(1)).alias("n"))


STEPS = ctes(PC, Z) + """, inside AS (SELECT c_acctbal FROM pc p WHERE EXISTS (
    SELECT 1 FROM z b WHERE p.lng > b.xmin AND p.lng < b.xmax AND p.lat > b.ymin AND p.lat < b.ymax)),
  c AS (SELECT (SELECT count(*) FROM inside) AS i, (SELECT count(*) FROM inside WHERE c_acctbal > 1000) AS r, (SELECT count(*) FROM pc) AS n)
SELECT {} FROM (SELECT unnest([
  {{'output_id': 'inside', 'type': 'contains', 'inputs': 'zones,customers', 'exec_order': 0, 'features': i, 'taken': n + (SELECT count(*) FROM z)}},
  {{'output_id': 'rich', 'type': 'attribute', 'inputs': 'inside', 'exec_order': 1, 'features': r, 'taken': i}},
  {{'output_id': 'named', 'type': 'join', 'inputs': 'names,rich', 'exec_order': 2, 'features': r, 'taken': r + (SELECT count(*) FROM nation)}},
  {{'output_id': 'all', 'type': 'union', 'inputs': 'named,customers', 'exec_order': 3, 'features': r + n, 'taken': r + n}}], recursive := true) FROM c)"""


def _sizes(catalog: Catalog):
    """Rows of each dataset of a catalog."""
    per = [catalog.get(e["id"]).agg(F.lit(e["id"]).alias("id"), F.count(F.lit(1)).alias("n")) for e in catalog.entries()]
    return reduce(DataFrame.unionByName, per)


@query("C7_lineage", STEPS.format("output_id, type, inputs, exec_order, features::BIGINT AS features"))
def c7(spark, d):
    """Lineage of a pipeline with the rows that each step gave."""
    catalog, _ = run_pipeline(spark, SPEC, frames=_frames(spark, d))
    sizes = _sizes(catalog).select(F.col("id").alias("output_id"), F.col("n").alias("features"))
    return catalog.lineage().withColumn("inputs", F.array_join("inputs", ",")).drop("params").join(sizes, "output_id")


CHAIN_ZONES = "p.lng > b.xmin AND p.lng < b.xmax AND p.lat > b.ymin AND p.lat < b.ymax"
CHAIN_MEET = "p.lng BETWEEN b.xmin AND b.xmax AND p.lat BETWEEN b.ymin AND b.ymax"


@query("C6_chain", ctes(PO, Z, BL, BP) + f"""SELECT fid FROM po p WHERE o_totalprice > 1000
  AND EXISTS (SELECT 1 FROM bp b WHERE {CHAIN_MEET}) AND EXISTS (SELECT 1 FROM z b WHERE {CHAIN_ZONES})
  AND NOT EXISTS (SELECT 1 FROM bl b WHERE {CHAIN_MEET})""")
def c6_chain(spark, d):
    """Five spatial operations one after the other."""
    parts = part_boxes(spark, d)
    met = ops.intersection(ops.attribute(orders(spark, d), "o_totalprice", ">", 1000), parts)
    inside = ops.contains(zones(spark, d), met, mode="within")
    outside = ops.difference(inside, lots(spark, d), mode="exclude")
    cut = ops.intersection(outside, parts, mode="clip")
    return ops.intersection(cut, parts).select("fid")


@query("C8_persist_restore", ctes(BP, BL) + """SELECT count(*)::BIGINT AS n FROM bp a WHERE EXISTS (SELECT 1 FROM bl b
  WHERE a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax)""")
def c8(spark, d):
    spec = {"operations": [{"type": "intersection", "inputs": ["parts", "lots"], "output": "near"}]}
    frames = {"parts": part_boxes(spark, d), "lots": lots(spark, d)}
    folder = new_path(spark, "catalog")
    run_pipeline(spark, spec, Catalog(spark, folder), frames)
    again, _ = run_pipeline(spark, spec, Catalog(spark, folder), frames)
    return again.get("near").agg(F.count(F.lit(1)).alias("n"))


@query("C6_changed_data", ctes(BP, BL) + """SELECT count(*)::BIGINT AS n FROM bp a WHERE EXISTS (SELECT 1 FROM bl b
  WHERE a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax)""")
def c6_changed(spark, d):
    """The same names over other data: the stored result of the first run doesn't answer for the second."""
    spec = {"operations": [{"type": "intersection", "inputs": ["parts", "lots"], "output": "near"}]}
    parts, folder = part_boxes(spark, d), new_path(spark, "catalog")
    run_pipeline(spark, spec, Catalog(spark, folder), {"parts": parts.where("fid % 2 = 0"), "lots": lots(spark, d)})
    again, _ = run_pipeline(spark, spec, Catalog(spark, folder), {"parts": parts, "lots": lots(spark, d)})
    return again.get("near").agg(F.count(F.lit(1)).alias("n"))


@query("C8_second_session", ctes(BP, BL) + f"""SELECT id, layer_order, inputs, CASE WHEN id = 'near' THEN (SELECT count(*) FROM bp a WHERE EXISTS (SELECT 1 FROM bl b
  WHERE a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax)) END::BIGINT AS n
  FROM (VALUES ('lots', 1, NULL), ('parts', 2, NULL), ('near', 3, 'parts,lots')) t(id, layer_order, inputs)""")
def c8_second(spark, d):
    """A catalog opened on the folder of another one: datasets, order, lineage and the stored result."""
    spec = {"operations": [{"type": "intersection", "inputs": ["parts", "lots"], "output": "near"}]}
    folder = new_path(spark, "catalog")
    first, _ = run_pipeline(spark, spec, Catalog(spark, folder), {"parts": part_boxes(spark, d), "lots": lots(spark, d)})
    first.reorder(["lots", "parts", "near"])
    later = Catalog(spark, folder)
    inputs = later.lineage().select(F.col("output_id").alias("id"), F.array_join("inputs", ",").alias("inputs"))
    n = later.get("near").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.lit("near"))
    return later.datasets().select("id", "layer_order").join(inputs, "id", "left").join(n, "id", "left")


@query("L3_list_lineage", STEPS.format("output_id, exec_order, taken::BIGINT AS taken"))
def l3(spark, d):
    """Steps of a pipeline in order with the rows that their inputs held."""
    catalog, _ = run_pipeline(spark, SPEC, frames=_frames(spark, d))
    steps = catalog.lineage().select("output_id", "exec_order", F.explode("inputs").alias("id"))
    return steps.join(_sizes(catalog), "id").groupBy("output_id", "exec_order").agg(F.sum("n").alias("taken"))


def _counted(spark, d) -> Catalog:
    catalog = Catalog(spark)
    catalog.register("orders", orders(spark, d))
    catalog.register("parts", part_boxes(spark, d))
    catalog.register("parts/big", ops.attribute(part_boxes(spark, d), "p_size", ">", 25))
    catalog.record("near", "intersection", ["parts", "orders"], {}, 0)
    return catalog


def _counts(catalog: Catalog):
    for entry in catalog.entries():
        catalog.refresh_count(entry["id"])
    return catalog.datasets().select("id", "name", "feature_count")


N = {k: f"(SELECT count(*) FROM {v})::BIGINT" for k, v in (("orders", "orders"), ("parts", "part"), ("big", "part WHERE p_size > 25"))}


@query("C1_register_replaces", f"SELECT 'orders' AS id, 'Second' AS name, {N['orders']} AS feature_count")
def c1(spark, d):
    catalog = Catalog(spark)
    catalog.register("orders", part_boxes(spark, d), name="First")
    catalog.register("orders", orders(spark, d), name="Second")
    return _counts(catalog)


@query("C2_lookup", f"""SELECT 'parts' AS id, true AS known, {N['parts']} AS n UNION ALL SELECT 'parts/big', true, {N['big']}
  UNION ALL SELECT 'part', false, NULL UNION ALL SELECT 'orders', true, {N['orders']}""")
def c2(spark, d):
    """Which ids are there, what they hold, and that others are refused."""
    catalog = _counted(spark, d)

    def looked_up(id: str) -> DataFrame:
        try:
            return catalog.get(id).agg(F.lit(id).alias("id"), F.lit(catalog.exists(id)).alias("known"), F.count(F.lit(1)).alias("n"))
        except KeyError:
            return spark.range(1).select(F.lit(id).alias("id"), F.lit(catalog.exists(id)).alias("known"), F.lit(None).cast("long").alias("n"))

    return reduce(DataFrame.unionByName, [looked_up(i) for i in ("orders", "part", "parts", "parts/big")])


@query("U4_missing_sources", f"SELECT 'near' AS id, {N['parts']} AS others UNION ALL SELECT 'nowhere', {N['parts']}")
def u4(spark, d):
    """Sources that outputs name and the catalog lacks, each once, with the rows of the one that is there."""
    catalog = _counted(spark, d)
    outputs = [
        {"source": ["near", "parts"], "format": "tiles"}, {"source": "nowhere", "format": "csv"},
        {"source": "near", "format": "csv"}, {"source": "far", "format": "tiles", "params": {"extractZoom": 3, "bbox": [0, 0, 1, 1]}},
    ]
    gone = F.array(*[F.lit(i) for i in sinks.missing_sources(catalog, outputs)])
    return catalog.get("parts").agg(F.count(F.lit(1)).alias("others")).select(F.explode(gone).alias("id"), "others")


@query("C3_rename", f"""SELECT 'open_orders' AS id, 'Open Orders!' AS name, {N['orders']} AS feature_count, true AS in_lineage
  UNION ALL SELECT 'parts', 'parts', {N['parts']}, true UNION ALL SELECT 'parts/big', 'parts/big', {N['big']}, false""")
def c3(spark, d):
    catalog = _counted(spark, d)
    catalog.rename("orders", "Open Orders!")
    used = catalog.lineage().select(F.explode("inputs").alias("id"), F.lit(True).alias("used"))
    out = _counts(catalog).join(used, "id", "left")
    return out.select("id", "name", "feature_count", F.coalesce("used", F.lit(False)).alias("in_lineage"))


@query("C4_delete", f"SELECT 'orders' AS id, 'orders' AS name, {N['orders']} AS feature_count")
def c4(spark, d):
    catalog = _counted(spark, d)
    catalog.delete("parts")
    return _counts(catalog)


@query("C5_reorder", f"""SELECT 'parts' AS id, 3 AS layer_order, {N['parts']} AS feature_count UNION ALL SELECT 'orders', 1, {N['orders']}
  UNION ALL SELECT 'parts/big', 2, {N['big']}""")
def c5(spark, d):
    catalog = _counted(spark, d)
    catalog.reorder(["parts", "parts/big", "orders"])
    catalog.swap("parts", "orders")
    counts = _counts(catalog).drop("name")
    return catalog.datasets().select("id", "layer_order").join(counts, "id").select("id", "layer_order", "feature_count")
