"""Dependencies in source tables: minimal keys, inclusions (also of several columns),
and functional dependencies.

Each search first rules out by bounded statistics and then measures what is left
exactly:

* one aggregate pass per table counts rows and NULLs and sketches distinct values;
* a **bottom-k sample** of a column holds the hashes of its values below a bound that
  about ``k`` values pass.  It is complete below that bound, so one hash that a child
  has and a parent lacks refutes the inclusion for certain;
* survivors are measured: every column's distinct values get a bit, values that columns
  share meet in one grouping by ``bit_or``, and equal bit sets are counted.

What reaches the driver is a few numbers or at most some ``k`` hashes per column.
Long texts are compared by their SHA-256 (``compact``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations, product
from typing import Iterable, Mapping, NamedTuple, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.operators.profile import SKETCH_ERRORS, compact, key_like_columns, key_tests, sketch_sets, value_family
from starmart.spec import Dimension


class Columns(NamedTuple):
    """One or more columns of a table, in order."""

    table: str
    names: tuple[str, ...]


def _families(tables: Mapping[str, DataFrame], c: Columns) -> tuple[str, ...]:
    return tuple(value_family(tables[c.table].schema[n].dataType) for n in c.names)


def _value(tables: Mapping[str, DataFrame], c: Columns) -> Column:
    """The value of the columns, NULL if one of them is; equal across tables of the same families."""
    parts = [compact(F.col(f"`{n}`").cast(f), f) for n, f in zip(c.names, _families(tables, c))]
    if len(parts) == 1:
        return parts[0]
    whole = F.lit(True)
    for p in parts:
        whole = whole & p.isNotNull()
    return F.when(whole, F.struct(*[p.alias(f"v{i}") for i, p in enumerate(parts)]))


def _all(frames: Iterable[DataFrame]) -> DataFrame | None:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


# -- bottom-k samples -----------------------------------------------------------

_TOP = 1 << 63


@dataclass(frozen=True)
class Sample:
    """All hashes of a column's values below ``bound``."""

    bound: int
    hashes: frozenset

    def refutes(self, parent: "Sample") -> bool:
        """Does the parent lack a value of this column for certain?"""
        bound = min(self.bound, parent.bound)
        return any(h < bound and h not in parent.hashes for h in self.hashes)


def bottom_samples(tables: Mapping[str, DataFrame], distinct: Mapping[Columns, int], k: int = 256) -> dict[Columns, Sample]:
    """A sample of about ``k`` values of each column set, given estimates of their distinct
    values; one job, one aggregate pass per table, no row repeated."""
    order = list(distinct)
    bounds = [_TOP if distinct[c] <= k else -_TOP + int(2 * _TOP * k / distinct[c]) for c in order]
    frames = []
    for t in dict.fromkeys(c.table for c in order):
        own = [i for i, c in enumerate(order) if c.table == t]
        aggs = []
        for i in own:
            v = _value(tables, order[i])
            h = F.xxhash64(v)
            keep = v.isNotNull() if bounds[i] == _TOP else v.isNotNull() & (h < bounds[i])
            aggs.append(F.collect_set(F.when(keep, h)).alias(f"s{i}"))
        frames.append(tables[t].agg(*aggs).select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"s{i}").alias("s")) for i in own])).alias("x")).select("x.*"))
    found = _all(frames)
    return {order[r["i"]]: Sample(bounds[r["i"]], frozenset(r["s"])) for r in (found.collect() if found is not None else [])}


# -- exact meetings ---------------------------------------------------------------

_WORD = 62  # bits of a BIGINT in use


def meetings(tables: Mapping[str, DataFrame], pairs: Sequence[tuple[Columns, Columns]]) -> dict[tuple[Columns, Columns], int]:
    """How many distinct values both sides of each pair hold, and under ``(c, c)`` how many
    each column set has; the sides of a pair have the same families.  One job."""
    by_family: dict[tuple[str, ...], list[tuple[Columns, Columns]]] = {}
    for a, b in dict.fromkeys(pairs):
        by_family.setdefault(_families(tables, a), []).append((a, b))
    ids: dict[Columns, int] = {}
    frames = []
    for family, own in by_family.items():
        columns = list(dict.fromkeys(c for pair in own for c in pair))
        place = {c: i for i, c in enumerate(columns)}
        for c in columns:
            ids[c] = len(ids)
        words = -(-len(columns) // _WORD)
        # a task reads one column: a value that many of its rows hold is one row of it
        values = _all(
            tables[c.table].select(_value(tables, c).alias("v")).where(F.col("v").isNotNull()).select(
                "v", *[F.lit(1 << (i % _WORD) if i // _WORD == w else 0).cast("bigint").alias(f"m{w}") for w in range(words)])
            for c, i in place.items())
        masks = [f"m{w}" for w in range(words)]
        sets = values.groupBy("v").agg(*[F.bit_or(m).alias(m) for m in masks]).groupBy(*masks).agg(F.count(F.lit(1)).alias("n"))
        word = F.array(*masks)
        bit = lambda i: F.getbit(F.get(word, F.floor(i / _WORD).cast("int")), (i % _WORD).cast("int")) == 1
        asked = [(c, c) for c in columns] + [p for p in own if p[0] != p[1]]
        asked = F.array(*[F.struct(F.lit(place[a]).alias("a"), F.lit(place[b]).alias("b"), F.lit(ids[a]).alias("x"), F.lit(ids[b]).alias("y")) for a, b in asked])
        held = F.filter(asked, lambda p: bit(p["a"]) & bit(p["b"]))
        frames.append(sets.select("n", F.explode(held).alias("p")).groupBy("p.x", "p.y").agg(F.sum("n").alias("n")))
    found = _all(frames)
    name = {i: c for c, i in ids.items()}
    return {(name[r["x"]], name[r["y"]]): r["n"] for r in (found.collect() if found is not None else [])}


# -- minimal keys -------------------------------------------------------------------

def minimal_keys(tables: Mapping[str, DataFrame], names: Sequence[str] | None = None, max_width: int = 3,
                 rsd: float = 0.03) -> list[Columns]:
    """Every minimal key of up to ``max_width`` columns: no row has a NULL in it, no two
    rows agree on it, and neither holds for fewer of its columns.

    Level by level: sets that hold a smaller key are not minimal; sets whose columns
    multiply to fewer values than there are rows cannot be keys, nor can any set of a
    table whose rows repeat as a whole (a non-key of all columns); the others are
    sketched in one pass per table and the few that come near the row count are tested
    exactly, those of large tables after a look at whole groups of a hashed share.
    Estimates rule out at ``SKETCH_ERRORS`` standard errors only."""
    names = list(names if names is not None else tables)
    low, high = max(1 - SKETCH_ERRORS * rsd, 0.0), 1 + SKETCH_ERRORS * rsd
    first = {t: [(c,) for c in key_like_columns(tables[t])] for t in names}
    whole = {t: [tuple(c for (c,) in first[t])] if len(first[t]) > 1 else [] for t in names}
    seen = sketch_sets(tables, {t: first[t] + whole[t] for t in names if first[t]}, rsd)
    usable = {t: [s for s in first[t] if seen[t, s].nulls == 0] for t in names}
    keys: dict[str, list[tuple[str, ...]]] = {t: [] for t in names}
    open_ = [t for t in names if usable[t]]
    for width in range(1, max_width + 1):
        sets = {}
        for t in open_:
            rows = seen[t, usable[t][0]].rows
            all_ = seen.get((t, whole[t][0])) if whole[t] else None
            if all_ is not None and all_.nulls == 0 and all_.distinct < rows * low:
                continue
            fits = lambda s: math.prod(max(seen[t, (c,)].distinct, 1) * high for c in s) >= rows  # noqa: B023, E731
            sets[t] = [s for s in combinations([c for (c,) in usable[t]], width) if not any(set(k) <= set(s) for k in keys[t]) and fits(s)]
        new = {t: [s for s in ss if (t, s) not in seen] for t, ss in sets.items()}
        seen.update(sketch_sets(tables, {t: ss for t, ss in new.items() if ss}, rsd))
        near = [Columns(t, s) for t, ss in sets.items() for s in ss if seen[t, s].distinct >= seen[t, s].rows * low]
        for c, is_key in zip(near, key_tests(tables, near, [seen[c.table, c.names].rows for c in near])):
            if is_key:
                keys[c.table].append(c.names)
    return [Columns(t, k) for t in names for k in keys[t]]


# -- inclusions ---------------------------------------------------------------------

@dataclass(frozen=True)
class Inclusion:
    """Every value of ``child`` is one of ``parent``."""

    child: Columns
    parent: Columns
    child_distinct: int
    parent_distinct: int
    one_to_one: bool  # the child's values are unique in its table

    @property
    def parent_coverage(self) -> float:
        return self.child_distinct / self.parent_distinct


@dataclass(frozen=True)
class Found:
    inclusions: list[Inclusion]
    candidates: int  # pairs whose types agree
    measured: int    # of them not refuted by samples


def included(tables: Mapping[str, DataFrame], pairs: Sequence[tuple[Columns, Columns]], unique: Iterable[Columns] = (), k: int = 256,
             rsd: float = 0.03) -> Found:
    """Which pairs (child, parent) are inclusions.  ``unique``: column sets known to be keys."""
    unique = set(unique)
    pairs = [(c, p) for c, p in dict.fromkeys(pairs) if c != p and _families(tables, c) == _families(tables, p)]
    sets: dict[str, list[tuple[str, ...]]] = {}
    for c in dict.fromkeys(c for pair in pairs for c in pair):
        sets.setdefault(c.table, []).append(c.names)
    seen = sketch_sets(tables, sets, rsd)
    samples = bottom_samples(tables, {Columns(t, s): seen[t, s].distinct for t, ss in sets.items() for s in ss}, k)
    left = [(c, p) for c, p in pairs if samples[c].hashes and not samples[c].refutes(samples[p])]
    n = meetings(tables, left)
    out = [Inclusion(c, p, n[c, c], n[p, p], c in unique) for c, p in left if n.get((c, c), 0) > 0 and n.get((c, p), 0) == n[c, c]]
    return Found(sorted(out, key=lambda i: (i.child, i.parent)), len(pairs), len(left))


def inclusions(tables: Mapping[str, DataFrame], names: Sequence[str] | None = None, keys: Sequence[Columns] | None = None,
               k: int = 256, rsd: float = 0.03) -> Found:
    """Columns whose values all lie in a single-column key: foreign keys, one-to-one links
    (whose child is a key too) included.  Columns without a value are in nothing."""
    names = list(names if names is not None else tables)
    keys = minimal_keys(tables, names, max_width=1, rsd=rsd) if keys is None else keys
    parents = [key for key in keys if len(key.names) == 1]
    children = [Columns(t, (c,)) for t in names for c in key_like_columns(tables[t])]
    return included(tables, [(c, p) for p in parents for c in children], set(parents), k, rsd)


def composite_inclusions(tables: Mapping[str, DataFrame], names: Sequence[str] | None = None, max_width: int = 2,
                         keys: Sequence[Columns] | None = None, k: int = 256, rsd: float = 0.03) -> Found:
    """Inclusions in keys of two and more columns.

    A tuple with a NULL refers to nothing, and each child column must lie in the key's
    column of its place by itself too; candidates come from that.  Only tuples that pass this are
    sampled, and only those that no sample refutes are measured."""
    names = list(names if names is not None else tables)
    keys = minimal_keys(tables, names, max_width=max_width, rsd=rsd) if keys is None else keys
    wide = [key for key in keys if len(key.names) > 1]
    parts = [Columns(key.table, (c,)) for key in wide for c in key.names]
    children = [Columns(t, (c,)) for t in names for c in key_like_columns(tables[t])]
    single = included(tables, [(c, p) for p in dict.fromkeys(parts) for c in children], set(), k, rsd)
    inside: dict[tuple[Columns, str], list[str]] = {}
    for i in single.inclusions:
        inside.setdefault((i.parent, i.child.table), []).append(i.child.names[0])
    pairs = []
    for key in wide:
        for t in names:
            own = [[c] if t == key.table else [] for c in key.names]  # a column lies in itself
            choices = [inside.get((Columns(key.table, (c,)), t), []) + o for c, o in zip(key.names, own)]
            pairs += [(Columns(t, tuple(cs)), key) for cs in product(*choices) if len(set(cs)) == len(cs)]
    return included(tables, pairs, set(keys), k, rsd)


# -- functional dependencies -----------------------------------------------------------

def functional_dependencies(df: DataFrame, columns: Sequence[str] | None = None, groups: int = 1000, rsd: float = 0.03) -> list[tuple[str, str]]:
    """``(determinant, dependent)``: rows that agree on the first agree on the second, NULL
    being a value of its own.  Keys determine everything and columns of one value are
    determined by all; neither is listed.

    A determinant's whole groups, those of about ``groups`` hashed values, refute most
    dependencies; the others are measured by one aggregation per determinant with a
    smallest and a largest value per group (no row is repeated)."""
    columns = list(columns if columns is not None else key_like_columns(df))
    seen = sketch_sets({"t": df}, {"t": [(c,) for c in columns]}, rsd)
    stats = {c: seen["t", (c,)] for c in columns}
    slack = SKETCH_ERRORS * rsd
    varied = [c for c in columns if stats[c].distinct + (stats[c].nulls > 0) > 1]
    # a value for NULL may add one
    asked = {x: [a for a in varied if a != x and stats[a].distinct * (1 - slack) <= stats[x].distinct * (1 + slack) + 1] for x in varied}
    asked = _fixed(df, {x: a for x, a in asked.items() if a}, {x: groups / max(stats[x].distinct, 1) for x in varied})
    held = _fixed(df, asked, None)
    keys = {x for x, is_key in zip(held, key_tests({"t": df}, [Columns("t", (x,)) for x in held])) if is_key}
    return sorted((x, a) for x, found in held.items() if x not in keys for a in found)


def _fixed(df: DataFrame, asked: Mapping[str, Sequence[str]], share: Mapping[str, float] | None) -> dict[str, list[str]]:
    """Of the dependents asked for each determinant those that hold, over all rows or over
    the rows whose determinant is in a hashed share; one job."""
    frames = []
    for x, dependents in asked.items():
        rows = df
        if share is not None and share[x] < 1:
            rows = df.where(F.xxhash64(f"`{x}`") < -_TOP + int(2 * _TOP * share[x]))
        values = [compact(F.col(f"`{a}`"), df.schema[a].dataType.simpleString()) for a in dependents]
        group = compact(F.col(f"`{x}`"), df.schema[x].dataType.simpleString())
        per = rows.groupBy(group.alias("x")).agg(*[c for i, v in enumerate(values) for c in (
            F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.count(v).alias(f"n{i}"))], F.count(F.lit(1)).alias("n"))
        one = lambda i: (F.col(f"n{i}") == 0) | ((F.col(f"n{i}") == F.col("n")) & (F.col(f"lo{i}") == F.col(f"hi{i}")))
        whole = per.agg(*[F.coalesce(F.min(one(i)), F.lit(True)).alias(f"f{i}") for i in range(len(dependents))])
        frames.append(whole.select(F.explode(F.array(*[
            F.struct(F.lit(x).alias("x"), F.lit(a).alias("a"), F.col(f"f{i}").alias("holds")) for i, a in enumerate(dependents)])).alias("d")).select("d.*"))
    out: dict[str, list[str]] = {}
    found = _all(frames)
    for r in (found.where("holds").collect() if found is not None else []):
        out.setdefault(r["x"], []).append(r["a"])
    return out


def propose_dimensions(df: DataFrame, table: str, columns: Sequence[str] | None = None, **kw) -> list[Dimension]:
    """Dimensions hidden in a wide table: each determinant with what it determines, to be
    built with ``dedupe``; of columns that determine each other the first stands for all."""
    columns = list(columns if columns is not None else key_like_columns(df))
    held: dict[str, set[str]] = {}
    for x, a in functional_dependencies(df, columns, **kw):
        held.setdefault(x, set()).add(a)
    out, same = [], set()
    for x in [c for c in columns if c in held]:
        if x in same:
            continue
        same |= {a for a in held[x] if x in held.get(a, ())}
        out.append(Dimension(f"dim_{x}", table, x, tuple(a for a in columns if a in held[x]), dedupe=True))
    return out
