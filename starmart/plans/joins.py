"""Join strategy for many-to-one (fact -> dimension / secondary source) joins.

* The "one" side is guarded for uniqueness inside the same job: it is grouped
  on the join key (the shuffle a sort-merge join needs anyway), and a key seen
  twice raises instead of silently inflating sums.
* Broadcast only behind a size check: the rows of the right side (a plain count,
  which Parquet answers from its footers) and the bytes of its values, measured
  for strings instead of guessed.  Above the bounds the join stays a shuffle join.
* In a shuffle join, hot left keys (more than a set share of the rows, so at most
  a bounded number of them) and left rows with a NULL key are salted over all
  partitions, and the few right rows of hot keys are repeated for each salt
  (``skew_split_join``): one join, each side read once, and no task receives a
  third of the rows even without AQE's skew-join splitting.
"""

from __future__ import annotations

import weakref
from typing import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmart.session import dealt

# Default bounds on what is broadcast to every executor (overridable per session).
DEFAULT_BROADCAST_ROWS = 4_000_000
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024  # measured: beyond ~100 MB the pre-aggregated shuffle plan wins
BROADCAST_ROWS_CONF = "spark.starmart.broadcast.maxRows"
BROADCAST_BYTES_CONF = "spark.starmart.broadcast.maxBytes"

_COUNT_COL = "__starmart_n"

# Sizes already measured, per DataFrame object (held weakly: a query that checks
# the same table twice measures it once).
_SIZES: "weakref.WeakKeyDictionary[DataFrame, dict[str, int]]" = weakref.WeakKeyDictionary()


def broadcast_bound(spark: SparkSession, override: int | None = None) -> int:
    """Row bound for a broadcast side (explicit override wins)."""
    if override is not None:
        return override
    return int(spark.conf.get(BROADCAST_ROWS_CONF, str(DEFAULT_BROADCAST_ROWS)))


_FIXED_WIDTH = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}


def _measured(df: DataFrame, what: str, expr: Column) -> int:
    memo = _SIZES.setdefault(df, {})
    if what not in memo:
        memo[what] = int(df.agg(expr).first()[0] or 0)
    return memo[what]


def row_count(df: DataFrame) -> int:
    """The rows of ``df``, counted once."""
    return _measured(df, "rows", F.count(F.lit(1)))


def _value_bytes(df: DataFrame) -> Column | None:
    """Bytes of the values whose width varies (texts, binaries, nested values)."""
    total = None
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, (T.StringType, T.BinaryType)):
            size = F.octet_length(F.col(f"`{f.name}`"))
        elif isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            size = F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`"))))
        else:
            continue
        size = F.coalesce(size, F.lit(0)).cast("bigint")
        total = size if total is None else total + size
    return total


def fits_broadcast(df: DataFrame, max_rows: int, upper_bound_of: DataFrame | None = None) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and fits the byte bound.

    Rows are counted on ``upper_bound_of`` when given - a relation with at least
    as many rows as ``df`` (e.g. the source table of a projected dimension) -
    else on ``df`` itself: a plain count, which each task sums up for itself.
    Values of varying width are measured only when rows and fixed widths fit.
    """
    if max_rows <= 0:
        return False
    max_bytes = int(df.sparkSession.conf.get(BROADCAST_BYTES_CONF, str(DEFAULT_BROADCAST_BYTES)))
    rows = _measured(upper_bound_of if upper_bound_of is not None else df, "rows", F.count(F.lit(1)))
    fixed = rows * (8 + sum(_FIXED_WIDTH.get(type(f.dataType), 8) for f in df.schema.fields))
    if rows > max_rows or fixed > max_bytes:
        return False
    values = _value_bytes(df)
    return values is None or fixed + _measured(df, "bytes", F.sum(values)) <= max_bytes


def unique_on(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``df`` restricted to non-null keys, failing the job on a duplicate key.

    Rows with a null key can never match an equi-join, so dropping them keeps
    join results unchanged.
    """
    keys = list(keys)
    others = [c for c in df.columns if c not in keys]
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    rows = _SIZES.get(df, {}).get("rows", 0)  # as the size check counted them
    grouped = dealt(df.where(cond), rows, *keys).groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in others], F.count(F.lit(1)).alias(_COUNT_COL)
    )
    guard = F.when(
        F.col(_COUNT_COL) > 1,
        F.raise_error(F.concat(
            F.lit(f"{what}: join key {keys} is not unique (value "),
            F.to_json(F.struct(*keys)), F.lit(") - it would fan out the fact."),
        )),
    ).otherwise(F.lit(True))
    return grouped.where(guard).select(*df.columns)


def many_to_one(
    left: DataFrame,
    right: DataFrame,
    left_on: Sequence[str],
    right_on: Sequence[str],
    how: str = "left",
    what: str = "join",
    broadcast_rows: int | None = None,
    guard: bool = True,
    split_hot: bool = True,
    salt_by: Sequence[str] | None = None,
) -> DataFrame:
    """Join each left row to at most one right row.

    Small right side: broadcast.  Otherwise a shuffle join whose hot left keys
    are salted (``split_hot``; pass ``False`` when the left side has one row per
    join key, or for analysis only)."""
    spark = left.sparkSession
    bound = broadcast_bound(spark, broadcast_rows)
    small = fits_broadcast(right, bound)
    rhs = unique_on(right, right_on, what) if guard else right
    if small:
        rhs = F.broadcast(rhs)
    elif split_hot:
        return skew_split_join(left, rhs, left_on, right_on, how, salt_by=salt_by)
    if list(left_on) == list(right_on):
        return left.join(rhs, list(left_on), how)
    cond: Column | None = None
    for lk, rk in zip(left_on, right_on):
        c = left[lk] == rhs[rk]
        cond = c if cond is None else cond & c
    return left.join(rhs, cond, how)


# Share of the left rows above which a single key is "hot".
DEFAULT_HOT_FRACTION = 0.01
HOT_FRACTION_CONF = "spark.starmart.skew.hotFraction"
_HASHES = 1 << 16


def _key_shares(df: DataFrame, keys: Sequence[str], fraction: float) -> tuple[list[tuple], bool]:
    """Key values holding more than ``fraction`` of ``df``'s rows, and whether
    rows with a NULL in the key do.

    Rows are first counted per hash of the key: a hot key makes its hash hot, and a task
    holds a bounded number of hashes, however many keys there are.  Only the keys of
    hot hashes, mostly none, are then counted themselves.  Fewer than ``1 / fraction`` keys
    or hashes can exceed that share, so the limits (a per-task top-k, then the top-k of
    those) cut off no hot key."""
    keys, most = list(keys), int(1 / fraction) + 1
    seen, n = Observation(), F.count(F.lit(1)).alias(_COUNT_COL)
    dealt_to = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(_HASHES))
    top = df.observe(seen, F.count(F.lit(1)).alias("rows")).groupBy(dealt_to.alias("__hash")).agg(n).orderBy(F.desc(_COUNT_COL)).limit(most).collect()
    least = seen.get["rows"] * fraction if top else 0
    crowded = [r["__hash"] for r in top if r[_COUNT_COL] > least]
    if not crowded:
        return [], False
    top = df.where(dealt_to.isin(crowded)).groupBy(*keys).agg(n).orderBy(F.desc(_COUNT_COL)).limit(most).collect()
    hot = [tuple(r[k] for k in keys) for r in top if r[_COUNT_COL] > least]
    return [t for t in hot if None not in t], any(None in t for t in hot)


def hot_keys(df: DataFrame, keys: Sequence[str], fraction: float) -> list[tuple]:
    """Non-null key values holding more than ``fraction`` of ``df``'s rows."""
    return _key_shares(df, keys, fraction)[0]


_SALT = "__starmart_salt"


def _any_of(df: DataFrame, keys: Sequence[str], values: Sequence[tuple]) -> Column:
    test = F.lit(False)
    for row in values:
        same = F.lit(True)
        for k, v in zip(keys, row):
            same = same & (F.col(f"`{k}`") == F.lit(v))
        test = test | F.coalesce(same, F.lit(False))
    return test


def _has_hash(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _has_hash(t.elementType)
    if isinstance(t, T.StructType):
        return all(_has_hash(f.dataType) for f in t.fields)
    return not isinstance(t, (T.MapType, T.VariantType))


def _row_hash(df: DataFrame, columns: Sequence[str] | None) -> Column:
    names = [f.name for f in df.schema.fields if (columns is None or f.name in columns) and _has_hash(f.dataType)]
    return F.xxhash64(*[F.col("`" + n.replace("`", "``") + "`") for n in names])


def skew_split_join(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str],
                    how: str = "left", fraction: float | None = None, salt_by: Sequence[str] | None = None) -> DataFrame:
    """Many-to-one equi-join that never sends a hot key's rows to one task.

    ``right`` must be unique on ``right_on``.  Left rows of hot keys (see
    :func:`hot_keys`) and, if many, those with a NULL key get a salt, the
    right row of each hot key is repeated for each salt, and the salt joins the
    key.  A row's salt is a hash of its values in ``salt_by`` (default: all
    columns), so a task that runs again in another order deals its rows as
    before; rows equal in all of them share a salt.  Same result as ``left.join(right, ..., how)`` for ``how`` in inner /
    left / left_semi / left_anti (NULL keys match nothing either way).  Works
    without AQE's skew-join splitting."""
    spark = left.sparkSession
    fraction = fraction or float(spark.conf.get(HOT_FRACTION_CONF, str(DEFAULT_HOT_FRACTION)))
    left_on, right_on = list(left_on), list(right_on)
    hot, nulls = _key_shares(left.select(*left_on), left_on, fraction)
    if hot or nulls:
        salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # enough to even out over the tasks
        spread = _any_of(left, left_on, hot)
        if nulls:
            for k in left_on:
                spread = spread | F.col(f"`{k}`").isNull()
        left = left.withColumn(_SALT, F.when(spread, F.pmod(_row_hash(left, salt_by), F.lit(salts))).otherwise(0).cast("int"))
        copies = F.when(_any_of(right, right_on, hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        right = right.withColumn(_SALT, F.explode(copies))
        left_on, right_on = left_on + [_SALT], right_on + [_SALT]
    if left_on == right_on:
        return left.join(right, left_on, how).drop(_SALT)
    cond = None
    for lk, rk in zip(left_on, right_on):
        e = left[lk] == right[rk]
        cond = e if cond is None else cond & e
    return left.join(right, cond, how).drop(_SALT)
