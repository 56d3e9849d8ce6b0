"""Star queries: metrics by dimension attributes per period, and roll-ups.

``star_rollup`` plans a fact -> dimension(s) query in one of two shapes:

* every needed dimension passes the broadcast size check -> the fact rows
  stream through broadcast hash joins and are aggregated once (partial
  aggregation map-side, a single small shuffle);
* otherwise, when all metrics decompose, the fact is first aggregated to
  (period, foreign keys) partial states - a hot foreign key collapses to one
  row per period before any shuffle - then joined to the dimensions and merged.
  Non-decomposable metrics join the raw rows, with hot fact keys split off
  into a broadcast join of their few dimension rows.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmart.errors import IntentError, NonAdditiveMetricError, SpecError
from starmart.functions.grain import PERIOD, coarser_or_equal, period
from starmart.functions.metrics import aggregate, decompose, decomposable, merge_for_published
from starmart.operators.dims import dimension_rows
from starmart.operators.facts import apply_filters, fact_rows, read_columns
from starmart.operators.grains import drill_across, parts as grain_parts
from starmart.plans.joins import broadcast_bound, fits_broadcast, skew_split_join, unique_on
from starmart.spec import YEAR_FROM, Dimension, Fact, Intent, MartSpec, fact_reachable_columns, validate_intent


def fact_row_columns(fact: Fact, tables: Mapping[str, DataFrame]) -> list[str]:
    return fact_reachable_columns(fact, tables)


def attribute_column(attr: str) -> str:
    """The column of a requested attribute, which may be qualified: ``dimension.column``
    or ``fact_key.column``."""
    return attr.rsplit(".", 1)[-1]


def output_names(by: Sequence[str]) -> dict[str, str]:
    """Result column of each requested attribute: its column, or with the qualifier in
    front (``dimension_column``) where another one has the same."""
    columns = [attribute_column(a) for a in dict.fromkeys(by)]
    return {a: attribute_column(a) if columns.count(attribute_column(a)) == 1 else a.replace(".", "_") for a in by}


def resolve_attributes(by: Sequence[str], fact: Fact, spec: MartSpec, row_columns: Sequence[str]):
    """Map each requested attribute to (fact key, dimension) or to the fact itself.

    A plain name must be reachable in one way only (dimensions of the same source and
    key give the same values); a name qualified by a dimension or by a fact key says
    which way is meant.  Returns arms (fact key, dimension, attributes) and the
    attributes that are columns of the fact's rows."""
    arms: dict[tuple[str, str], list[str]] = {}
    dims: dict[tuple[str, str], Dimension] = {}
    degenerate: list[str] = []
    links = spec.dimensions_of(fact)
    for attr in by:
        column, qualifier = attribute_column(attr), attr.rpartition(".")[0]
        hits = [(key, dim) for key, dim in links
                if (column in dim.attribute_columns or column == dim.key_column) and qualifier in ("", dim.name, key)]
        if len({(key, dim.source_table, dim.key_column) for key, dim in hits}) > 1:
            ways = sorted(f"{dim.name}.{column} by {key}" for key, dim in hits)
            raise IntentError(f"Attribute '{attr}' can be reached in more than one way ({', '.join(ways)}) and their values may differ. "
                              f"Ask for one of them as dimension.{column} or fact_key.{column}.")
        hit = hits[0] if hits else None
        if hit is None:
            if attr in row_columns:
                degenerate.append(attr)
                continue
            raise IntentError(
                f"Dimension attribute '{attr}' is neither an attribute of a dimension of fact "
                f"'{fact.name}' ({sorted(d.name for _, d in links)}) nor a column of its rows."
            )
        k = (hit[0], hit[1].name)
        dims[k] = hit[1]
        arms.setdefault(k, []).append(attr)
    return [(key, dims[(key, name)], attrs) for (key, name), attrs in arms.items()], degenerate


def _merge_arms(arms):
    """One dimension side per (fact key, source table, key column): dimensions
    of the same entity (e.g. customer attributes and customer -> region arms)
    become one scan, one uniqueness guard and one join.  Arms joining the same
    table differently, or a different ``dedupe``, stay separate."""
    merged: dict[tuple, tuple[Dimension, list[str]]] = {}
    for fk, dim, attrs in arms:
        k = (fk, dim.source_table, dim.key_column, dim.dedupe)
        if k in merged:
            have, have_attrs = merged[k]
            joins = list(have.joins)
            conflict = False
            for j in dim.joins:
                same = [x for x in joins if x.table == j.table]
                if same and same[0] != j:
                    conflict = True
                    break
                if not same:
                    joins.append(j)
            if not conflict:
                merged[k] = (replace(have, name=f"{have.name}+{dim.name}",
                                     attribute_columns=tuple(dict.fromkeys(have.attribute_columns
                                                                           + dim.attribute_columns)),
                                     joins=tuple(joins)),
                             have_attrs + [a for a in attrs if a not in have_attrs])
                continue
            k = k + (dim.name,)
        merged[k] = (dim, list(attrs))
    return [(k[0], d, a) for k, (d, a) in merged.items()]


def star_rollup(
    fact: Fact,
    tables: Mapping[str, DataFrame],
    spec: MartSpec,
    by: Sequence[str],
    grain: str | None = None,
    filters: Mapping[str, str] | None = None,
    metrics: Sequence[str] | None = None,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """``by`` attributes (+ ``period``) and the chosen metrics of ``fact``.

    ``filters`` may name columns of the fact's rows (applied to the rows, before
    any join) or attributes of its dimensions (applied to the dimension side
    before the join, which then becomes an inner join).
    """
    if metrics is not None:
        fact = replace(fact, metrics=tuple(fact.metric(m) for m in metrics))
    if grain is not None:
        fact = replace(fact, time_grain=grain)
    dim_filters: dict[str, str] = {}
    if filters:
        row_cols = set(fact_row_columns(fact, tables))
        links = spec.dimensions_of(fact)
        own = {k: v for k, v in filters.items() if k in row_cols or k == YEAR_FROM}
        for k, v in filters.items():
            if k in own:
                continue
            if not any(attribute_column(k) in d.attribute_columns and k.rpartition(".")[0] in ("", d.name, key) for key, d in links):
                raise IntentError(
                    f"filter '{k}' is neither a column of fact '{fact.name}' nor an attribute of its "
                    f"dimensions {sorted(d.name for _, d in links)}.")
            dim_filters[k] = v
        fact = replace(fact, filters={**fact.filters, **own})
    if not fact.metrics:
        raise IntentError(f"star query on '{fact.name}' needs at least one metric.")
    asked = list(by) + [k for k in dim_filters if k not in by]
    if fact.joins:
        arms, degenerate = resolve_attributes(asked, fact, spec, fact_row_columns(fact, tables))
        needed = list(dict.fromkeys([fk for fk, _, _ in arms] + degenerate))
        grains = grain_parts(fact, tables, needed)
        if len(grains) > 1 or grains[0].fact is not fact:
            # every metric at the grain of its own table, then the answers by their keys
            answers = [star_rollup(p.fact, p.tables, spec, by, filters=dim_filters, broadcast_rows=broadcast_rows) for p in grains]
            return drill_across(answers, ([PERIOD] if fact.time_grain is not None else []) + list(output_names(by).values()), fact.metrics)
    rows = fact_rows(fact, tables, broadcast_rows)
    arms, degenerate = resolve_attributes(asked, fact, spec, rows.columns)
    arms = _merge_arms(arms)
    periods = [PERIOD] if fact.time_grain is not None else []
    bound = broadcast_bound(rows.sparkSession, broadcast_rows)

    # Dimension sides: key + needed attributes only, guarded unique on the key.
    sides = []
    for i, (fk, dim, attrs) in enumerate(arms):
        key_alias = f"__k{i}"
        # Attributes named like a column of the fact rows or of another side get an internal alias.
        taken = {*rows.columns, *(n for s in sides for n in s[4].values())}
        names = {a: (f"__a{i}_{attribute_column(a)}" if attribute_column(a) in taken else attribute_column(a)) for a in attrs}
        cols = [dim.key_column] + [c for c in dict.fromkeys(map(attribute_column, attrs)) if c != dim.key_column]
        side = dimension_rows(dim, tables, cols, broadcast_rows)
        here = {attribute_column(a): v for a, v in dim_filters.items() if a in attrs}
        side = apply_filters(side, here, None)
        # Bounded by the dimension's source table (its rows bound the dimension's).
        small = fits_broadcast(side, bound, upper_bound_of=tables[dim.source_table])
        side = unique_on(side, [dim.key_column], f"dimension '{dim.name}'")
        side = side.select(F.col(dim.key_column).alias(key_alias),
                           *[F.col(c).alias(next(n for a, n in names.items() if attribute_column(a) == c)) for c in cols if c != dim.key_column])
        names.update({a: key_alias for a in attrs if attribute_column(a) == dim.key_column})
        sides.append((fk, key_alias, side, small, names, "inner" if here else "left"))

    labels = output_names(by)
    out_keys = periods + [labels[a] for a in by]
    asked_keys = periods + list(by)

    def out_col(attr):
        for _, _, _, _, names, _ in sides:
            if attr in names:
                return F.col(names[attr]).alias(labels[attr])
        return F.col(attr)

    all_small = all(s[3] for s in sides)
    if not all_small and all(decomposable(m) for m in fact.metrics):
        parts = [decompose(m, rows.schema) for m in fact.metrics]
        pre_keys = periods + list(dict.fromkeys([s[0] for s in sides] + degenerate))
        for p in parts:
            pre_keys += [k for k in p.extra_keys if k not in pre_keys]
        states = [s for p in parts for s in p.states] or [F.count(F.lit(1)).alias("__rows")]
        pre = rows.groupBy(*pre_keys).agg(*states)
        # one row per key has no hot key; with a period, other keys or a distinct argument one may repeat
        joined = _join_sides(pre, sides, split_hot=len(pre_keys) > 1)
        merged = joined.groupBy(*[out_col(a) for a in asked_keys]).agg(
            *[m for p in parts for m in p.merges] or [F.count(F.lit(1)).alias("__rows")])
        return merged.select(*out_keys, *[p.finish for p in parts])

    salt_by = list(dict.fromkeys([*periods, *degenerate, *(s[0] for s in sides), *read_columns(fact, rows)]))
    joined = _join_sides(rows, sides, split_hot=True, salt_by=salt_by)
    return joined.groupBy(*[out_col(a) for a in asked_keys]).agg(
        *[aggregate(m, rows.schema) for m in fact.metrics])


def _join_sides(df: DataFrame, sides, split_hot: bool = False, salt_by: Sequence[str] | None = None) -> DataFrame:
    """Join the dimension sides: broadcast when small; otherwise a shuffle join,
    whose hot fact keys are salted when a key may repeat."""
    for fk, key_alias, side, small, _, how in sides:
        if small:
            rhs = F.broadcast(side)
            df = df.join(rhs, df[fk] == rhs[key_alias], how)
        elif split_hot:
            df = skew_split_join(df, side, [fk], [key_alias], how, salt_by=salt_by)
        else:
            df = df.join(side, df[fk] == side[key_alias], how)
    return df


def rollup_states(
    states: DataFrame,
    fact: Fact,
    keys: Sequence[str],
    grain: str | None = None,
) -> DataFrame:
    """Roll a state-form fact (``build_fact_states``) up to ``keys`` (+ period).

    Exact for every aggregation: sums merge in their exact input type, averages
    as Σsum/Σcount, count-distinct from its kept argument.
    """
    schema = _source_schema(states, fact)
    parts = [decompose(m, schema) for m in fact.metrics]
    group = list(keys)
    if grain is not None:
        check_grain(fact, grain)
        states = states.withColumn(PERIOD, period(PERIOD, grain))
        group = [PERIOD] + group
    merges = [m for p in parts for m in p.merges]
    merged = states.groupBy(*group).agg(*merges) if group else states.agg(*merges)
    return merged.select(*group, *[p.finish for p in parts])


def rollup_fact(fact_df: DataFrame, fact: Fact, keys: Sequence[str], grain: str | None = None,
                rows: DataFrame | None = None) -> DataFrame:
    """Roll an already published (conformed) fact up to a coarser grain.

    Allowed for sum/count/min/max; avg and count_distinct are not re-aggregable
    and raise ``NonAdditiveMetricError`` (recompute them from the source).
    ``rows`` (the fact's row-level input, types only) makes DECIMAL sums exact.
    """
    merges = [merge_for_published(m, rows) for m in fact.metrics]
    group = list(keys)
    if grain is not None:
        check_grain(fact, grain)
        fact_df = fact_df.withColumn(PERIOD, period(PERIOD, grain))
        group = [PERIOD] + group
    missing = [k for k in keys if k not in fact_df.columns]
    if missing:
        raise SpecError(f"Fact '{fact.name}' has no columns {missing} to roll up by.")
    return fact_df.groupBy(*group).agg(*merges) if group else fact_df.agg(*merges)


def check_grain(fact: Fact, grain: str) -> None:
    """A published period can be summed to ``grain`` only if each one lies inside one of its periods."""
    if fact.time_grain is None:
        raise SpecError(f"Fact '{fact.name}' has no period to roll up.")
    if not coarser_or_equal(fact.time_grain, grain):
        raise NonAdditiveMetricError(
            f"Fact '{fact.name}' at grain '{fact.time_grain}' cannot be rolled up exactly to '{grain}'."
        )


def _source_schema(states: DataFrame, fact: Fact):
    """Schema used for type conformance of rolled-up metrics: the state columns
    stand in for min/max sources whose original type they keep."""
    from pyspark.sql import types as T
    fields = list(states.schema.fields)
    for m in fact.metrics:
        if m.aggregation in ("min", "max") and m.source_column is not None:
            s = f"{m.name}__s"
            for f in states.schema.fields:
                if f.name == s:
                    fields.append(T.StructField(m.source_column, f.dataType, True))
    return T.StructType(fields)


def answer(intent: Intent, spec: MartSpec, tables: Mapping[str, DataFrame], fact_name: str | None = None,
           broadcast_rows: int | None = None) -> DataFrame:
    """Answer "metrics by dimension attributes per period" for an intent.

    The fact is the one named, or the single fact holding every required metric.
    Metrics that no single fact holds are asked of the one fact that has each, and the
    answers meet by the attributes (which those facts must share) and the period.
    """
    validate_intent(intent)

    def of(fact: Fact, metrics: Sequence[str]) -> DataFrame:
        return star_rollup(fact, tables, spec, intent.required_dimensions, grain=intent.time_granularity,
                           filters=intent.filters, metrics=metrics, broadcast_rows=broadcast_rows)

    if fact_name is not None:
        return of(spec.fact(fact_name), intent.required_metrics)
    holding = {r: [f for f in spec.facts if any(m.name == r for m in f.metrics)] for r in intent.required_metrics}
    all_ = [f for f in spec.facts if all(f in fs for fs in holding.values())]
    if len(all_) == 1:
        return of(all_[0], intent.required_metrics)
    unclear = {r: [f.name for f in fs] for r, fs in holding.items() if len(fs) != 1}
    if unclear:
        raise IntentError(f"metrics must belong to exactly one fact, or the fact be named; found {unclear}.")
    by_fact: dict[str, list[str]] = {}
    for r, (f,) in holding.items():
        by_fact.setdefault(f.name, []).append(r)
    answers = [of(spec.fact(name), metrics) for name, metrics in by_fact.items()]
    metrics = [holding[r][0].metric(r) for r in intent.required_metrics]
    return drill_across(answers, [PERIOD, *output_names(intent.required_dimensions).values()], metrics)
