"""SQL functions over WKB for shapes that built-in functions cannot compute.

The functions live in a small jar (sources next to it) that calls the geometry
jar shipped with Spark.  They run on the executors inside ordinary plans.
"""

from __future__ import annotations

import hashlib
import shutil
import subprocess
import tempfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, DoubleType, StructType

KERNEL = Path(__file__).resolve().parent.parent / "kernel"
JAR = KERNEL / "shapes.jar"
STAMP = KERNEL / "shapes.sources.sha256"
_MARK = "spark.gridfold.kernel"


def sources() -> list[Path]:
    return sorted((KERNEL / "src").rglob("*.java"))


def source_digest() -> str:
    return hashlib.sha256(b"".join(p.read_bytes() for p in sources())).hexdigest()


def build() -> Path:
    """Compile the sources against the jars of this PySpark (needs a JDK)."""
    import pyspark

    jars = Path(pyspark.__file__).parent / "jars" / "*"
    out = Path(tempfile.mkdtemp(prefix="gridfold-kernel-"))
    subprocess.run(
        ["javac", "-nowarn", "-Xlint:none", "-cp", str(jars), "-d", str(out / "classes"), *map(str, sources())], check=True
    )
    subprocess.run(["jar", "cf", str(out / "shapes.jar"), "-C", str(out / "classes"), "gridfold"], check=True)
    shutil.copy(out / "shapes.jar", JAR)
    STAMP.write_text(source_digest() + "\n")
    return JAR


def install(spark: SparkSession) -> None:
    """Register the functions once per session."""
    if spark.conf.get(_MARK, None) == "on":
        return
    from gridfold.schema import BBOX, GEOM

    jar = JAR if JAR.exists() else build()
    spark.sql(f"ADD JAR '{jar}'")
    wkb, number, flag = BinaryType(), DoubleType(), BooleanType()
    shape: DataType = StructType.fromDDL(f"g {GEOM}")["g"].dataType
    box: DataType = StructType.fromDDL(f"b {BBOX}")["b"].dataType
    for name, result in {
        "Pack": wkb,
        "Unpack": shape,
        "Buffer": wkb,
        "Simplify": wkb,
        "Repair": wkb,
        "Intersection": wkb,
        "Difference": wkb,
        "Intersects": flag,
        "Contains": flag,
        "Distance": number,
        "IsEmpty": flag,
        "Bounds": box,
        "Area": number,
    }.items():
        spark.udf.registerJavaFunction(f"gf_{name.lower()}", f"gridfold.kernel.Shapes${name}", result)
    for name in ("To", "From"):
        spark.udf.registerJavaFunction(f"gf_{name.lower()}_plane", f"gridfold.kernel.Plane${name}", wkb)
    jvm = spark._jvm
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    union = loader.loadClass("gridfold.kernel.UnionAgg").newInstance()
    udaf = jvm.org.apache.spark.sql.functions.udaf(union, jvm.org.apache.spark.sql.Encoders.BINARY())
    spark._jsparkSession.udf().register("gf_union", udaf)
    spark.conf.set(_MARK, "on")


def pack(geom: Column) -> Column:
    """Geometry struct to WKB."""
    return F.call_function("gf_pack", geom)


def unpack(wkb: Column) -> Column:
    """WKB to geometry struct."""
    return F.call_function("gf_unpack", wkb)


def to_plane(wkb: Column, plane: Column) -> Column:
    """Degrees to the metric plane ``(lon0, y0)``; unchanged when the plane is NULL."""
    return F.call_function("gf_to_plane", wkb, plane["lon0"], plane["y0"])


def from_plane(wkb: Column, plane: Column) -> Column:
    """Metric plane to degrees; unchanged when the plane is NULL."""
    return F.call_function("gf_from_plane", wkb, plane["lon0"], plane["y0"])


def buffer(wkb: Column, distance: Column, quad_segs: int) -> Column:
    return F.call_function("gf_buffer", wkb, distance, F.lit(quad_segs))


def simplify(wkb: Column, tolerance: Column) -> Column:
    return F.call_function("gf_simplify", wkb, tolerance)


def repair(wkb: Column) -> Column:
    return F.call_function("gf_repair", wkb)


def intersection(a: Column, b: Column) -> Column:
    return F.call_function("gf_intersection", a, b)


def difference(a: Column, b: Column) -> Column:
    return F.call_function("gf_difference", a, b)


def intersects(a: Column, b: Column) -> Column:
    return F.call_function("gf_intersects", a, b)


def contains(a: Column, b: Column) -> Column:
    return F.call_function("gf_contains", a, b)


def distance(a: Column, b: Column) -> Column:
    return F.call_function("gf_distance", a, b)


def is_empty(wkb: Column) -> Column:
    return F.call_function("gf_isempty", wkb)


def bounds(wkb: Column) -> Column:
    """Envelope; NULL for a NULL or empty shape."""
    return F.call_function("gf_bounds", wkb)


def area(wkb: Column) -> Column:
    """Planar area, holes subtracted, in squared coordinate units."""
    return F.call_function("gf_area", wkb)


def union_agg(wkb: Column) -> Column:
    """Aggregate: union of all shapes of a group, combined before the shuffle as well."""
    return F.call_function("gf_union", wkb)
