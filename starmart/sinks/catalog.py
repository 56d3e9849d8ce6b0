"""Publishing a mart into a catalog database as bucketed tables.

Dimensions are bucketed (and sorted) on their key and facts on the foreign key
of their first dimension, all with the same bucket count, so a star join of a
published fact with its dimension is a sort-merge join without a shuffle on
either side.  Each run writes new tables ``<name>__<run_id>``; after the checks
pass the mart moves to the run at once, by metadata only.  One view of one row,
``<mart>__current``, holds the run: this module's readers look it up once and read
that run's tables.  For SQL on the views ``<name>`` a switch has three steps
(:func:`switch_statements`): every view first holds the old and the new run, each
under the condition that the pointer names it; the pointer moves, by a single
statement; then every view becomes the new run's plain table.  Before the second
step all views show the old run, after it the new one, so no query meets two; a
switch that breaks off stands on one run and the next one starts from there.  One
publisher a mart at a time.  Earlier runs stay readable (``run_id``).
"""

from __future__ import annotations

import re
import uuid
from dataclasses import replace
from typing import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmart.errors import CheckFailedError, IntentError, NonAdditiveMetricError, SpecError
from starmart.functions.grain import PERIOD, period
from starmart.functions.metrics import merge_published, state_name
from starmart.operators import distinct
from starmart.operators.checks import check_report, failures
from starmart.operators.dims import build_dimension
from starmart.operators.facts import apply_filters, build_fact, fact_keys, fact_rows
from starmart.operators.grains import drill_across
from starmart.operators.profile import stats_row_counts
from starmart.operators.star import answer, attribute_column, check_grain, output_names, resolve_attributes
from starmart.plans.joins import broadcast_bound, fits_broadcast, row_count, unique_on
from starmart.session import exchanges_for
from starmart.spec import YEAR_FROM, Fact, Intent, MartSpec, Metric, validate_intent, validate_spec


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# Table property: the key column whose uniqueness the checks of this run have proven.
UNIQUE = "starmart.unique"
# Table property: the rows of the published table, from its statistics.
ROWS = "starmart.rows"


def _property(spark: SparkSession, table: str, name: str) -> str | None:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}.get(name)


def _proven_unique(spark: SparkSession, table: str, key: str) -> bool:
    return _property(spark, table, UNIQUE) == key


def _pointer(spec: MartSpec, database: str) -> str:
    return f"{_q(database)}.{_q(re.sub(r'[^A-Za-z0-9_]', '_', spec.mart_name) + '__current')}"


def _physical(database: str, name: str, run_id: str) -> str:
    return f"{_q(database)}.{_q(name + '__' + run_id)}"


def current_run(spark: SparkSession, spec: MartSpec, database: str) -> str | None:
    """The run that ``database`` shows of the mart (``None``: nothing is published)."""
    pointer = _pointer(spec, database)
    return spark.table(pointer).first()["run_id"] if spark.catalog.tableExists(pointer) else None


def _names(spark: SparkSession, spec: MartSpec, database: str, run_id: str | None) -> Callable[[str], str]:
    """The tables of one run by their logical names; the pointer is read once."""
    run = run_id or current_run(spark, spec, database)
    return lambda name: f"{_q(database)}.{_q(name)}" if run is None else _physical(database, name, run)


def switch_statements(spark: SparkSession, spec: MartSpec, database: str, names: Sequence[str], run_id: str) -> list[str]:
    """The statements that move the mart to ``run_id``, in order.  Between any two of them
    all views show the same run.  A view whose columns differ between the runs has those of
    both until the last step, null where a run lacks them; a table that only the new run has
    is empty until the pointer moves."""
    old = current_run(spark, spec, database)
    pointer = _pointer(spec, database)
    move = f"CREATE OR REPLACE VIEW {pointer} AS SELECT '{run_id}' AS run_id"
    view = lambda name, body: f"CREATE OR REPLACE VIEW {_q(database)}.{_q(name)} AS {body}"
    plain = [view(name, f"SELECT * FROM {_physical(database, name, run_id)}") for name in names]
    if old is None:
        return [move, *plain]
    both = []
    for name in names:
        runs = [r for r in (old, run_id) if spark.catalog.tableExists(_physical(database, name, r))]
        fields = {r: {f.name.lower(): f for f in spark.table(_physical(database, name, r)).schema.fields} for r in runs}
        every = {**fields[run_id], **{k: f for k, f in fields[runs[0]].items() if k not in fields[run_id]}}
        parts = []
        for r in runs:
            columns = ", ".join(_q(f.name) if k in fields[r] else f"CAST(NULL AS {f.dataType.simpleString()}) AS {_q(f.name)}" for k, f in every.items())
            parts.append(f"SELECT {columns} FROM {_physical(database, name, r)} WHERE (SELECT run_id FROM {pointer}) = '{r}'")
        both.append(view(name, " UNION ALL ".join(parts)))
    return [*both, move, *plain]


def _execute(spark: SparkSession, statement: str) -> None:
    spark.sql(statement)


def ensure_database(spark: SparkSession, database: str, location: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_q(database)} LOCATION '{location}'")


def _write_bucketed(df: DataFrame, table: str, key: str | None, buckets: int, spread: int = 1) -> None:
    """Write ``df`` bucketed on ``key``.  The rows of a bucket meet in ``spread`` write
    tasks, dealt by their other columns, so a key that many rows share (a fact's
    foreign key) does not end in one task and one file."""
    if key is None:
        df.write.format("parquet").saveAsTable(table)
        return
    bucket = F.pmod(F.hash(F.col(key)), F.lit(buckets))  # as the writer computes it
    deal = [bucket]
    if spread > 1:
        deal.append(F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(spread)))
    (df.repartition(buckets * spread, *deal).write.format("parquet")
       .bucketBy(buckets, key).sortBy(key).saveAsTable(table))


def sets_name(fact: str, metric: str) -> str:
    """The published table of the sets behind an exact distinct count."""
    return f"{fact}__{metric}__sets"


def publish_to_catalog(spec: MartSpec, tables: Mapping[str, DataFrame], database: str, location: str,
                       buckets: int = 64, run_id: str | None = None, check: bool = True,
                       analyze: bool = True) -> dict[str, str]:
    """Build, write (bucketed), check and publish ``spec``; returns view -> table of this run.

    With ``analyze`` every written table gets ``ANALYZE TABLE … COMPUTE
    STATISTICS`` (Parquet row counts come mostly from file footers), so
    Catalyst plans later joins on real sizes and row counts can be read from
    the catalog without a scan."""
    validate_spec(spec, tables)
    spark = next(iter(tables.values())).sparkSession
    ensure_database(spark, database, location)
    run_id = run_id or uuid.uuid4().hex[:12]
    written: dict[str, str] = {}
    for d in spec.dimensions:
        name = _physical(database, d.name, run_id)
        _write_bucketed(build_dimension(d, tables), name, d.key_column, buckets)
        written[d.name] = name
    for f in spec.facts:
        links = spec.dimensions_of(f)
        key = links[0][0] if links else None
        name = _physical(database, f.name, run_id)
        with exchanges_for(spark, max(row_count(tables[t]) for t in f.source_tables)) as filled:
            spread = max(8, -(-filled // buckets))
            _write_bucketed(build_fact(f, tables, spec, states=True), name, key, buckets, spread)
            written[f.name] = name
            for m in distinct.set_metrics(f):
                sets, _ = distinct.metric_sets(f, m, tables, spec)
                logical = sets_name(f.name, m.name)
                written[logical] = _physical(database, logical, run_id)
                _write_bucketed(sets, written[logical], key, buckets, spread)
    if analyze:
        for physical in written.values():
            spark.sql(f"ANALYZE TABLE {physical} COMPUTE STATISTICS")
    if check:
        named = {d.name for d in spec.dimensions} | {f.name for f in spec.facts}
        report = check_report(spec, tables, built={k: spark.table(v) for k, v in written.items() if k in named})
        checks_table = _physical(database, "checks", run_id)
        report.coalesce(1).write.format("parquet").saveAsTable(checks_table)  # the run's evidence
        bad = failures(spark.table(checks_table))
        if bad:
            raise CheckFailedError(f"mart '{spec.mart_name}' run {run_id}: {len(bad)} check(s) failed; "
                                   f"views not moved.", bad)
    rows = {r["table_name"]: r["row_count"] for r in stats_row_counts(spark, [f"{n}__{run_id}" for n in written], database).collect()} if analyze else {}
    for logical, physical in written.items():
        key = next((d.key_column for d in spec.dimensions if d.name == logical), None)
        known = {UNIQUE: key if check else None, ROWS: rows.get(f"{logical}__{run_id}")}
        known = ", ".join(f"'{k}' = '{v}'" for k, v in known.items() if v is not None)
        if known:
            spark.sql(f"ALTER TABLE {physical} SET TBLPROPERTIES ({known})")
    for statement in switch_statements(spark, spec, database, list(written), run_id):
        _execute(spark, statement)
    return {f"{_q(database)}.{_q(logical)}": physical for logical, physical in written.items()}


def rollup_published(spark: SparkSession, spec: MartSpec, database: str, fact_name: str, by: Sequence[str],
                     grain: str | None = None, broadcast_rows: int | None = None,
                     tables: Mapping[str, DataFrame] | None = None,
                     filters: Mapping[str, str] | None = None, run_id: str | None = None) -> DataFrame:
    """Answer "metrics by dimension attributes per period" from a published mart.

    sum/count/min/max are re-aggregated from their values, averages and
    approximate distinct counts from the state columns published beside them
    (this needs ``tables``), exact distinct counts of a column from the sets
    published beside the fact (``distinct``).  Dimensions that
    pass the size check are broadcast; larger ones join the fact bucket to
    bucket (no shuffle) when both were published with the same bucket count.
    Each published dimension joins on its own (bucket to bucket).  ``filters``
    may name fact keys, ``year_from`` (on the published period) or dimension
    attributes (applied to the dimension side; the join becomes inner).
    ``tables`` (the sources, read for types only) makes DECIMAL sums exact.
    All that is read is of one run: the current one, or ``run_id``.
    """
    name_of = _names(spark, spec, database, run_id)
    fact = spec.fact(fact_name)
    rows = fact_rows(fact, tables, split_hot=False) if tables is not None else None
    links = spec.dimensions_of(fact)
    bound = broadcast_bound(spark, broadcast_rows)
    keys = fact_keys(fact)
    filters = dict(filters or {})
    fact_filters = {k: v for k, v in filters.items() if k in keys}
    if YEAR_FROM in filters:
        if PERIOD not in keys or fact.time_grain == "weekly":
            raise IntentError(f"'{YEAR_FROM}' needs a published period that starts every year "
                              f"(fact '{fact.name}' grain: {fact.time_grain}).")
        fact_filters[YEAR_FROM] = filters[YEAR_FROM]
    dim_filters = {k: v for k, v in filters.items() if k not in fact_filters}
    if grain is not None:
        check_grain(fact, grain)
    # One side per published dimension: each joins bucket to bucket (merging
    # dimensions here would replace the bucketed key by a derived one).
    arms, _ = resolve_attributes(list(by) + [k for k in dim_filters if k not in by], fact, spec, keys)
    labels, column, sides = output_names(by), {}, []
    for i, (fk, dim, attrs) in enumerate(arms):
        here = {attribute_column(a): v for a, v in dim_filters.items() if a in attrs}
        frame = apply_filters(spark.table(name_of(dim.name)), here, None)
        column.update({a: f"__a{i}_{attribute_column(a)}" for a in attrs})
        frame = frame.select(F.col(dim.key_column).alias(f"__k{i}"), *[F.col(c).alias(f"__a{i}_{c}") for c in dict.fromkeys(map(attribute_column, attrs))])
        small = fits_broadcast(frame, bound)
        if not _proven_unique(spark, name_of(dim.name), dim.key_column):
            frame = unique_on(frame, [f"__k{i}"], f"dimension '{dim.name}'")
        sides.append((fk, f"__k{i}", F.broadcast(frame) if small else frame, "inner" if here else "left"))

    def placed(name: str) -> DataFrame:
        """A published table of the fact's keys, with the result's keys in their place."""
        df = spark.table(name_of(name))
        others = [c for c in df.columns if c not in keys]
        df = apply_filters(df, fact_filters, PERIOD if YEAR_FROM in fact_filters else None)
        if grain is not None:
            df = df.withColumn(PERIOD, period(PERIOD, grain))
        for fk, key_alias, frame, how in sides:
            df = df.join(frame, df[fk] == frame[key_alias], how)
        return df.select(*([PERIOD] if grain is not None else []), *[F.col(column.get(a, a)).alias(labels[a]) for a in by], *others)

    group = ([PERIOD] if grain is not None else []) + [labels[a] for a in by]
    kept = [m for m in distinct.set_metrics(fact) if spark.catalog.tableExists(name_of(sets_name(fact.name, m.name)))]
    plain = [m for m in fact.metrics if m not in kept]
    answers = []
    if plain:
        main = placed(fact.name)
        answers.append(main.groupBy(*group).agg(*[merge_published(m, rows, main.columns)[0] for m in plain]))
    for m in kept:
        answers.append(distinct.count_sets(distinct.merge_sets(placed(sets_name(fact.name, m.name)), group), group, m.name))
    return answers[0] if len(answers) == 1 else drill_across(answers, group, fact.metrics)


def answer_published(spark: SparkSession, intent: Intent, spec: MartSpec, database: str, fact_name: str,
                     tables: Mapping[str, DataFrame] | None = None,
                     broadcast_rows: int | None = None, run_id: str | None = None) -> DataFrame:
    """An intent (metrics x attributes x grain x filters) answered from a
    published mart; only the intent's metrics are merged."""
    validate_intent(intent)
    fact = spec.fact(fact_name)
    sub = replace(fact, metrics=tuple(fact.metric(m) for m in intent.required_metrics))
    spec = replace(spec, facts=tuple(sub if f.name == fact.name else f for f in spec.facts))
    return rollup_published(spark, spec, database, fact_name, intent.required_dimensions,
                            grain=intent.time_granularity, broadcast_rows=broadcast_rows, tables=tables,
                            filters=intent.filters, run_id=run_id)


# -- choosing the fact ---------------------------------------------------------

def _mergeable(spark: SparkSession, fact: Fact, metrics: Sequence[Metric], name_of: Callable[[str], str]) -> bool:
    columns = spark.table(name_of(fact.name)).columns
    for m in metrics:
        if m in distinct.set_metrics(fact):
            if not spark.catalog.tableExists(name_of(sets_name(fact.name, m.name))):
                return False
        elif m.aggregation == "avg" or m.approximate:
            if m.expression is not None or state_name(m, "hll" if m.approximate else "s") not in columns:
                return False
        elif not m.is_additive:
            return False
    return True


def facts_for(spark: SparkSession, intent: Intent, spec: MartSpec, database: str, run_id: str | None = None) -> list[str]:
    """Published facts that can answer ``intent`` exactly, the smallest first.

    A fact can if it has every metric in a form that merges, holds the rows the intent
    asks for (its own fixed filters are among the intent's), has periods that lie inside
    the intent's, and reaches every attribute and every remaining filter by its keys.
    Facts that define a metric of the same name differently are ambiguous.  Sizes are the
    rows counted when a fact was published; nothing is read."""
    validate_intent(intent)
    defined: dict[str, set[Metric]] = {}
    for f in spec.facts:
        for m in f.metrics:
            defined.setdefault(m.name, set()).add(replace(m, description=""))
    unclear = sorted(r for r in intent.required_metrics if len(defined.get(r, ())) > 1)
    if unclear:
        raise IntentError(f"Metrics {unclear} are defined differently in several facts; name the fact.")
    name_of = _names(spark, spec, database, run_id)
    fitting = []
    for f in spec.facts:
        left = {k: v for k, v in intent.filters.items() if k not in f.filters}
        if any(intent.filters.get(k) != v for k, v in f.filters.items()) or not all(any(m.name == r for m in f.metrics) for r in intent.required_metrics):
            continue
        if not spark.catalog.tableExists(name_of(f.name)) or not _mergeable(spark, f, [f.metric(r) for r in intent.required_metrics], name_of):
            continue
        if YEAR_FROM in left and (f.time_grain in (None, "weekly")):
            continue
        try:
            check_grain(f, intent.time_granularity)
            resolve_attributes([*intent.required_dimensions, *(k for k in left if k != YEAR_FROM)], f, spec, fact_keys(f))
        except (IntentError, SpecError, NonAdditiveMetricError):
            continue
        rows = _property(spark, name_of(f.name), ROWS)
        fitting.append((float("inf") if rows is None else int(rows), f.name))
    return [name for _, name in sorted(fitting)]


def answer_from_mart(spark: SparkSession, intent: Intent, spec: MartSpec, database: str, tables: Mapping[str, DataFrame],
                     broadcast_rows: int | None = None) -> DataFrame:
    """``intent`` from the smallest published fact that can answer it, else from the sources;
    the plan of the result names what is read."""
    run = current_run(spark, spec, database)
    names = facts_for(spark, intent, spec, database, run_id=run)
    if not names:
        return answer(intent, spec, tables, broadcast_rows=broadcast_rows)
    own = spec.fact(names[0]).filters
    rest = replace(intent, filters={k: v for k, v in intent.filters.items() if k not in own})
    return answer_published(spark, rest, spec, database, names[0], tables=tables, broadcast_rows=broadcast_rows, run_id=run)
