"""Target schemas of a mart, from analysis only (no job).

For every table of a spec, in publish order (dimensions, then facts), the
``StructType`` its build produces, with the declared constraints attached as
field metadata - Spark's file tables cannot enforce them, the checks do:

* dimension key: ``{"primary_key": true, "not_null": true}``;
* dimension attribute whose source field is non-nullable: ``{"not_null": true}``;
* fact key: ``{"not_null": true, "references": ["dim.key", ...]}`` (every
  dimension the key maps to);
* fact metric: ``{"not_null": true, "aggregation": ...}``.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from starmart.operators.dims import build_dimension
from starmart.operators.facts import build_fact, fact_keys
from starmart.spec import MartSpec, validate_spec


def _with_meta(field: T.StructField, meta: dict) -> T.StructField:
    return T.StructField(field.name, field.dataType, field.nullable, {**(field.metadata or {}), **meta})


def target_schemas(spec: MartSpec, tables: Mapping[str, DataFrame]) -> dict[str, T.StructType]:
    """``{table name: StructType}`` for every dimension then every fact of ``spec``."""
    validate_spec(spec, tables)
    out: dict[str, T.StructType] = {}
    for d in spec.dimensions:
        schema = build_dimension(d, tables, broadcast_rows=0, split_hot=False).schema
        src = tables[d.source_table].schema
        fields = []
        for f in schema.fields:
            if f.name == d.key_column:
                fields.append(_with_meta(f, {"primary_key": True, "not_null": True}))
            elif f.name in src.fieldNames() and not src[f.name].nullable:
                fields.append(_with_meta(f, {"not_null": True}))
            else:
                fields.append(f)
        out[d.name] = T.StructType(fields)
    for fact in spec.facts:
        schema = build_fact(fact, tables, spec, broadcast_rows=0, split_hot=False).schema
        refs: dict[str, list[str]] = {}
        for key, d in spec.dimensions_of(fact):
            refs.setdefault(key, []).append(f"{d.name}.{d.key_column}")
        keys = set(fact_keys(fact))
        aggs = {m.name: m.aggregation for m in fact.metrics}
        fields = []
        for f in schema.fields:
            if f.name in keys:
                meta = {"not_null": True}
                if f.name in refs:
                    meta["references"] = refs[f.name]
                fields.append(_with_meta(f, meta))
            elif f.name in aggs:
                fields.append(_with_meta(f, {"not_null": True, "aggregation": aggs[f.name]}))
            else:
                fields.append(f)
        out[fact.name] = T.StructType(fields)
    return out


def describe(schemas: Mapping[str, T.StructType]) -> str:
    """A readable listing (one line per column) of :func:`target_schemas`."""
    lines = []
    for name, schema in schemas.items():
        lines.append(name)
        for f in schema.fields:
            m = f.metadata or {}
            flags = [k.upper().replace("_", " ") for k in ("primary_key", "not_null") if m.get(k)]
            if m.get("references"):
                flags.append("REFERENCES " + ", ".join(m["references"]))
            lines.append(f"  {f.name} {f.dataType.simpleString()}" + (" " + " ".join(flags) if flags else ""))
    return "\n".join(lines)
