"""The nine operations, and inspection of feature frames."""

from gridfold.operators.attribute import attribute, flatten
from gridfold.operators.combine import append, dedup_features, dissolve, merge, union
from gridfold.operators.distance import distance
from gridfold.operators.inspect import bounds, feature_count, geometry_types, preview, property_keys, with_geometry
from gridfold.operators.keyjoin import join
from gridfold.operators.shape import buffer, centroid, clip_to_bbox, explode_vertices, make_valid, numeric_properties, simplify, vertex_arrays
from gridfold.operators.spatial import contains, difference, intersection

__all__ = [
    "append",
    "attribute",
    "bounds",
    "buffer",
    "centroid",
    "clip_to_bbox",
    "contains",
    "dedup_features",
    "difference",
    "dissolve",
    "distance",
    "explode_vertices",
    "vertex_arrays",
    "feature_count",
    "flatten",
    "geometry_types",
    "intersection",
    "join",
    "make_valid",
    "merge",
    "numeric_properties",
    "preview",
    "property_keys",
    "simplify",
    "union",
    "with_geometry",
]
