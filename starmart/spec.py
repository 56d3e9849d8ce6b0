"""Declarative mart specification: facts, dimensions, metrics, questions.

A ``MartSpec`` is plain data (frozen dataclasses, loadable from JSON).  The
build functions in :mod:`starmart.operators` turn it into lazy DataFrames;
nothing here touches Spark except :func:`validate_spec`, which only reads
``df.schema`` (no job is started).

Compared with a bare "facts + dimensions" model the spec carries what a Spark
build needs to be exact:

* ``Fact.key_map``  – fact foreign key -> dimension name (sides may be named
  differently, e.g. ``o_custkey`` -> ``dim_customer`` keyed on ``c_custkey``);
* ``Fact.joins``    – many-to-one joins of secondary sources into the primary;
* ``Fact.time_column`` / ``time_grain`` / ``filters`` – the question's period
  and fixed conditions, applied in the plan (not just recorded);
* ``Dimension.dedupe`` / ``Dimension.joins`` – opt-in de-duplication and
  snowflake arms (e.g. customer -> nation -> region).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, Mapping, Sequence

from starmart.errors import IntentError, SpecError, UnknownTableError

# The closed set of aggregations and of time grains.
AGGREGATIONS = ("sum", "count", "count_distinct", "avg", "min", "max")
TIME_GRAINS = ("daily", "weekly", "monthly", "quarterly", "yearly")

# Filter key with range semantics: lower bound on the year of the time column.
YEAR_FROM = "year_from"


@dataclass(frozen=True)
class Metric:
    """One measure of a fact.

    ``expression`` is a SQL aggregate (``SUM(a * (1 - b))``); when it is absent
    the aggregate is built from ``aggregation`` and ``source_column``
    (``source_column=None`` with ``count`` means ``COUNT(*)``).  The expression
    is what is computed; ``aggregation`` decides the result type and whether the
    metric can be re-aggregated.
    """

    name: str
    aggregation: str
    source_column: str | None = None
    expression: str | None = None
    description: str = ""
    additive: bool | None = None
    # count_distinct only: estimate with a mergeable HLL sketch of 2**lg_config_k buckets
    approximate: bool = False
    lg_config_k: int = 12
    # the source table at whose grain the metric is aggregated, if its columns do not tell
    table: str | None = None

    def __post_init__(self):
        if self.approximate and (self.aggregation != "count_distinct" or self.expression is not None):
            raise SpecError(f"Metric '{self.name}': approximate applies to a count_distinct of a column only.")
        if self.aggregation not in AGGREGATIONS:
            raise SpecError(
                f"Metric '{self.name}' aggregation '{self.aggregation}' is not one of "
                f"{sorted(AGGREGATIONS)}."
            )
        if self.expression is None and self.source_column is None and self.aggregation != "count":
            raise SpecError(
                f"Metric '{self.name}' needs a source_column or an expression "
                f"(only count may stand alone as COUNT(*))."
            )

    @property
    def is_additive(self) -> bool:
        """Can a coarser grain be computed from this metric's values alone?"""
        if self.additive is not None:
            return self.additive
        if self.approximate:
            return True  # sketches merge
        # An opaque expression is not assumed to decompose.
        if self.expression is not None:
            return False
        return self.aggregation in ("sum", "count", "min", "max")


@dataclass(frozen=True)
class Join:
    """Many-to-one join of ``table`` into the rows built so far.

    The right side must be unique on ``right_on``; the build guards this inside
    the same job (a duplicate key fails the job instead of inflating sums).
    """

    table: str
    left_on: tuple[str, ...]
    right_on: tuple[str, ...]
    how: str = "left"

    def __post_init__(self):
        object.__setattr__(self, "left_on", _as_tuple(self.left_on))
        object.__setattr__(self, "right_on", _as_tuple(self.right_on))
        if len(self.left_on) != len(self.right_on) or not self.left_on:
            raise SpecError(
                f"Join to '{self.table}' needs the same non-zero number of left and "
                f"right key columns, got {list(self.left_on)} / {list(self.right_on)}."
            )
        if self.how not in ("left", "inner"):
            raise SpecError(f"Join to '{self.table}': how must be 'left' or 'inner'.")


@dataclass(frozen=True)
class Dimension:
    name: str
    source_table: str
    key_column: str
    attribute_columns: tuple[str, ...] = ()
    dedupe: bool = False
    joins: tuple[Join, ...] = ()
    description: str = ""

    def __post_init__(self):
        object.__setattr__(self, "attribute_columns", _as_tuple(self.attribute_columns))
        object.__setattr__(self, "joins", tuple(_coerce(Join, j) for j in self.joins))

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.key_column, *self.attribute_columns)


@dataclass(frozen=True)
class Fact:
    name: str
    source_tables: tuple[str, ...]
    metrics: tuple[Metric, ...]
    dimension_keys: tuple[str, ...] = ()
    grain: str = ""
    joins: tuple[Join, ...] = ()
    # fact key -> dimension name (or list of names sharing that key)
    key_map: Mapping[str, str | Sequence[str]] = field(default_factory=dict)
    time_column: str | None = None
    time_grain: str | None = None
    filters: Mapping[str, str] = field(default_factory=dict)
    description: str = ""

    def __post_init__(self):
        object.__setattr__(self, "source_tables", _as_tuple(self.source_tables))
        object.__setattr__(self, "dimension_keys", _as_tuple(self.dimension_keys))
        object.__setattr__(self, "metrics", tuple(_coerce(Metric, m) for m in self.metrics))
        object.__setattr__(self, "joins", tuple(_coerce(Join, j) for j in self.joins))
        object.__setattr__(self, "key_map", {
            k: (v if isinstance(v, str) else tuple(v)) for k, v in dict(self.key_map).items()})
        object.__setattr__(self, "filters", dict(self.filters))
        if not self.source_tables:
            raise SpecError(f"Fact '{self.name}' has no source table.")
        if self.time_grain is not None and self.time_grain not in TIME_GRAINS:
            raise SpecError(
                f"Fact '{self.name}' time_grain '{self.time_grain}' is not one of "
                f"{sorted(TIME_GRAINS)}."
            )
        if self.time_grain is not None and self.time_column is None:
            raise SpecError(f"Fact '{self.name}' has a time_grain but no time_column.")
        names = [m.name for m in self.metrics]
        if len(set(names)) != len(names):
            raise SpecError(f"Fact '{self.name}' repeats a metric name: {names}.")
        keys = list(self.dimension_keys) + (["period"] if self.time_grain is not None else [])
        if len(set(keys)) != len(keys):
            raise SpecError(f"Fact '{self.name}' repeats a key: {keys}.")
        clash = sorted(set(names) & set(keys))
        if clash:
            raise SpecError(f"Fact '{self.name}' metric names {clash} collide with its keys {keys}.")

    @property
    def primary_table(self) -> str:
        return self.source_tables[0]

    def metric(self, name: str) -> Metric:
        for m in self.metrics:
            if m.name == name:
                return m
        raise SpecError(
            f"Fact '{self.name}' has no metric '{name}'. "
            f"Available metrics: {sorted(m.name for m in self.metrics)}."
        )


@dataclass(frozen=True)
class Intent:
    """A question: metrics by dimension attributes per period, with filters."""

    required_metrics: tuple[str, ...]
    required_dimensions: tuple[str, ...]
    filters: Mapping[str, str] = field(default_factory=dict)
    time_granularity: str = "daily"
    subject_area: str = ""
    raw_input: str = ""
    notes: str = ""

    def __post_init__(self):
        object.__setattr__(self, "required_metrics", _as_tuple(self.required_metrics))
        object.__setattr__(self, "required_dimensions", _as_tuple(self.required_dimensions))
        object.__setattr__(self, "filters", dict(self.filters))


@dataclass(frozen=True)
class MartSpec:
    mart_name: str
    facts: tuple[Fact, ...]
    dimensions: tuple[Dimension, ...] = ()
    description: str = ""
    intent: Intent | None = None

    def __post_init__(self):
        object.__setattr__(self, "facts", tuple(_coerce(Fact, f) for f in self.facts))
        object.__setattr__(self, "dimensions", tuple(_coerce(Dimension, d) for d in self.dimensions))
        if self.intent is not None:
            object.__setattr__(self, "intent", _coerce(Intent, self.intent))
        names = [t.name for t in (*self.facts, *self.dimensions)]
        dupes = sorted({n for n in names if names.count(n) > 1})
        if dupes:
            raise SpecError(f"Mart '{self.mart_name}' repeats table names: {dupes}.")

    def dimension(self, name: str) -> Dimension:
        for d in self.dimensions:
            if d.name == name:
                return d
        raise SpecError(
            f"Mart '{self.mart_name}' has no dimension '{name}'. "
            f"Available dimensions: {sorted(d.name for d in self.dimensions)}."
        )

    def fact(self, name: str) -> Fact:
        for f in self.facts:
            if f.name == name:
                return f
        raise SpecError(
            f"Mart '{self.mart_name}' has no fact '{name}'. "
            f"Available facts: {sorted(f.name for f in self.facts)}."
        )

    def dimensions_of(self, fact: Fact) -> list[tuple[str, Dimension]]:
        """(fact key, dimension) pairs this fact references.

        An explicit ``key_map`` entry wins; otherwise a dimension whose key has
        the same name as a fact key matches.  Every match is returned (two
        dimensions may share a key name; all of them are checked).
        """
        pairs: list[tuple[str, Dimension]] = []
        for key in fact.dimension_keys:
            if key in fact.key_map:
                target = fact.key_map[key]
                for name in ([target] if isinstance(target, str) else target):
                    pairs.append((key, self.dimension(name)))
                continue
            pairs.extend((key, d) for d in self.dimensions if d.key_column == key)
        return pairs

    def source_tables(self) -> list[str]:
        """Every source table the mart reads (dimension sources and arms, fact
        sources and joins), sorted."""
        names = set()
        for d in self.dimensions:
            names.add(d.source_table)
            names.update(j.table for j in d.joins)
        for f in self.facts:
            names.update(f.source_tables)
            names.update(j.table for j in f.joins)
        return sorted(names)

    # -- JSON ---------------------------------------------------------------
    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> "MartSpec":
        return _coerce(cls, data)

    @classmethod
    def from_json(cls, text: str) -> "MartSpec":
        return cls.from_dict(json.loads(text))

    def to_dict(self) -> dict:
        return _to_plain(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, sort_keys=False)


# ---------------------------------------------------------------------------
# Preconditions (driver side, schema only)
# ---------------------------------------------------------------------------


def validate_intent(intent: Intent) -> None:
    """Every fault of the intent, in one error."""
    faults = []
    grain = intent.time_granularity
    if grain not in TIME_GRAINS:
        faults.append(f"no such time grain: {grain!r} (choose from {', '.join(sorted(TIME_GRAINS))})")
    faults += [f"{field} is empty" for field in ("required_metrics", "required_dimensions") if not getattr(intent, field)]
    if faults:
        raise IntentError("; ".join(faults))


def table_columns(tables: Mapping[str, Any], name: str, owner: str) -> list[str]:
    if name not in tables:
        raise UnknownTableError(
            f"{owner} references source table '{name}' which is not loaded. "
            f"Available tables: {sorted(tables)}."
        )
    return list(tables[name].columns)


def _require(column: str, available: Sequence[str], what: str) -> None:
    if column not in available:
        raise SpecError(f"{what} '{column}' does not exist. Available columns: {sorted(available)}.")


def validate_dimension(dim: Dimension, tables: Mapping[str, Any]) -> None:
    owner = f"Dimension '{dim.name}'"
    cols = table_columns(tables, dim.source_table, owner)
    reachable = list(cols)
    for j in dim.joins:
        right = table_columns(tables, j.table, f"{owner} join")
        for c in j.left_on:
            _require(c, reachable, f"{owner} join key")
        for c in j.right_on:
            _require(c, right, f"{owner} join key in '{j.table}'")
        clash = sorted(set(right) & set(reachable) - (set(j.right_on) & set(j.left_on)))
        if clash:
            raise SpecError(
                f"{owner}: joining arm '{j.table}' would duplicate columns {clash}; "
                f"rename them in the source first."
            )
        reachable += [c for c in right if c not in reachable]
    _require(dim.key_column, cols, f"{owner} key_column in '{dim.source_table}'")
    for attr in dim.attribute_columns:
        _require(attr, reachable, f"{owner} attribute_column")


def fact_reachable_columns(fact: Fact, tables: Mapping[str, Any]) -> list[str]:
    owner = f"Fact '{fact.name}'"
    reachable = list(table_columns(tables, fact.primary_table, owner))
    for t in fact.source_tables[1:]:
        table_columns(tables, t, owner)
    joined = {fact.primary_table}
    for j in fact.joins:
        right = table_columns(tables, j.table, f"{owner} join")
        for c in j.left_on:
            _require(c, reachable, f"{owner} join key")
        for c in j.right_on:
            _require(c, right, f"{owner} join key in '{j.table}'")
        clash = sorted(set(right) & set(reachable) - (set(j.right_on) & set(j.left_on)))
        if clash:
            raise SpecError(
                f"{owner}: joining '{j.table}' would duplicate columns {clash}; "
                f"rename them in the source first."
            )
        reachable += [c for c in right if c not in reachable]
        joined.add(j.table)
    missing = [t for t in fact.source_tables if t not in joined]
    if missing:
        raise SpecError(
            f"{owner} lists source tables {missing} without a join declaring how they "
            f"attach to '{fact.primary_table}'."
        )
    return reachable


def validate_fact(fact: Fact, tables: Mapping[str, Any], spec: MartSpec | None = None) -> None:
    owner = f"Fact '{fact.name}'"
    reachable = fact_reachable_columns(fact, tables)
    for key in fact.dimension_keys:
        _require(key, reachable, f"{owner} dimension key")
    for m in fact.metrics:
        if m.source_column is not None:
            _require(m.source_column, reachable, f"{owner} metric '{m.name}' source_column")
    if fact.time_column is not None:
        _require(fact.time_column, reachable, f"{owner} time_column")
    for k in fact.filters:
        if k == YEAR_FROM:
            if fact.time_column is None:
                raise SpecError(f"{owner} filter '{YEAR_FROM}' needs a time_column.")
        else:
            _require(k, reachable, f"{owner} filter column")
    if spec is not None:
        for k, target in fact.key_map.items():
            if k not in fact.dimension_keys:
                raise SpecError(f"{owner} key_map names '{k}', which is not a dimension key.")
            for dname in ([target] if isinstance(target, str) else target):
                spec.dimension(dname)


def validate_spec(spec: MartSpec, tables: Mapping[str, Any]) -> None:
    """Raise the first precondition failure, naming object and column."""
    for dim in spec.dimensions:
        validate_dimension(dim, tables)
    for fact in spec.facts:
        validate_fact(fact, tables, spec)
    if spec.intent is not None:
        validate_intent(spec.intent)


# ---------------------------------------------------------------------------
# helpers
# ---------------------------------------------------------------------------


def _as_tuple(value) -> tuple:
    if value is None:
        return ()
    if isinstance(value, str):
        return (value,)
    return tuple(value)


def _coerce(cls, value):
    if isinstance(value, cls):
        return value
    if not isinstance(value, Mapping):
        raise SpecError(f"Cannot build {cls.__name__} from {type(value).__name__}.")
    known = {f.name for f in fields(cls)}
    unknown = sorted(set(value) - known)
    if unknown:
        raise SpecError(f"{cls.__name__} got unknown fields {unknown}; known: {sorted(known)}.")
    return cls(**dict(value))


def _to_plain(obj):
    if is_dataclass(obj):
        return {f.name: _to_plain(getattr(obj, f.name)) for f in fields(obj)}
    if isinstance(obj, (list, tuple)):
        return [_to_plain(x) for x in obj]
    if isinstance(obj, Mapping):
        return {k: _to_plain(v) for k, v in obj.items()}
    return obj
