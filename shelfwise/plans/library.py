"""All queries of the engine. Importing a module registers its queries."""

from shelfwise.plans import cells, imports, more, queue  # noqa: F401
from shelfwise.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

#: Columns whose SQL type is a decimal or a wide integer by its literals or sums, and the type of the query's column.
_TYPES = {
    **{(q, "confidence"): "double" for q in ("d2_number_cells", "d3_multi_cells", "d4_enum_cells", "d9_missing_photo", "d10_junk_keys", "z1_moved_components", "r3_d14_out_of_range", "g3_from_subtype", "g4_from_name", "g6_from_sleep", "g9_best", "x12_compare")},
    **{(q, "scale"): "double" for q in ("f26_scale_hints", "x6_scales", "x16_numeric_fields")},
    ("x11_consensus", "middle"): "double",
    ("x12_conflicts", "sources"): "integer",
    ("v9_statistics", "tokens_in"): "bigint",
    ("v9_statistics", "tokens_out"): "bigint",
    ("t5_half_of_errors", "errors"): "bigint",
}
for (_query, _column), _type in _TYPES.items():
    ORACLE_SQL[_query] = f"SELECT * REPLACE (cast({_column} AS {_type}) AS {_column}) FROM ({ORACLE_SQL[_query]})"
