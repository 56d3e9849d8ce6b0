"""Mixing sources to target weights by Pareto order sampling.

Sources, in code-point order with null last, take the weights in turn and share
the words of the whole table by them.  A target stops at ``max_copies`` times its
source's size; what exceeds it is shared anew by weight until no target is above.

Within a source every document is expected ``rate`` = target / source size times
(times its own weight relative to the word-weighted mean, if ``weight_col`` is
given, at most ``max_copies``).  The whole part are certain copies.  The
fraction p is drawn: documents are ranked by (u / (1 - u)) / (p / (1 - p)) with
u a uniform number from a hash of the document, which is Pareto's order sampling
with unequal probabilities, and the first in that order are taken until the
source's remaining words are reached.  So the drawn sample is fixed in words: it
misses the target by less than one document.

The order statistic is found without sorting a source in one task: ranks fall
into bins, words are summed per bin, and only the documents of the one bin in
which a source's remainder runs out are ordered.

Defined results: null and empty texts and those of white space have size 0 and
take no words; a null source is a source of its own; repeated rows have the same
rank and are taken one by one in it; a row whose source has no words gets no copy;
an empty table gives an empty table.  The same table always gives the same mix.
Columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starmart.llm.common import written

OUTPUTS = ("size", "source_size", "target", "copies", "taken")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_copies: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source.

    Water filling: with sources ordered by the share at which they fill up, the
    first k are full and the others share the rest by weight, for the smallest k
    at which none of the others is above its limit.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    rows = sizes.withColumn("__w", w).withColumn("__full_at", F.col("source_size") * max_copies / F.col("__w"))
    order = Window.orderBy("__full_at", F.col("source").isNull(), F.col("source").cast("binary"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.partitionBy(F.lit(0))
    full = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_copies
    rows = rows.withColumns({
        "__level": (F.sum("source_size").over(everyone) - full) / F.sum("__w").over(after),
        "__rank": F.row_number().over(order),
    })
    # the first source that its level does not fill (there is one: the limits add up to max_copies times all sizes)
    open_at = F.when(F.col("__level") <= F.col("__full_at"), F.struct("__rank", "__level"))
    rows = rows.withColumn("__level", F.min(open_at).over(everyone)["__level"])
    target = F.least(F.col("__level") * F.col("__w"), (F.col("source_size") * max_copies).cast("double"))
    return rows.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def uniform(seed: int, *cols: str) -> Column:
    """A number in (0, 1) from a hash of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) + F.lit(0.5)) / F.lit(float(2**53))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = (5, 2, 1), max_copies: int = 3, weight_col: str | None = None,
        seed: int = 7, bins: int = 4096, keep_text: bool = True) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (= copies * size) added.

    ``keep_text=False`` leaves the text out of the result (and of the table that
    is written on the way).
    """
    keep = [c for c in df.columns if c not in OUTPUTS and (keep_text or c != text_col)]
    # written once with row numbers: all later jobs read the same rows, and few of them the text
    base = written(df.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(id_col).alias("__id"),
        F.col(source_col).cast("string").alias("__source"),
        word_count(text_col).alias("__size"),
        uniform(seed, id_col, text_col).alias("__u"),
        (F.col(weight_col).cast("double") if weight_col else F.lit(1.0)).alias("__w"),
        F.monotonically_increasing_id().alias("__row"),
    ), "mix")
    per_source = base.groupBy(F.col("__source").alias("source")).agg(
        F.sum("__size").alias("source_size"),
        (F.sum(F.col("__w") * F.col("__size")) / F.nullif(F.sum("__size"), F.lit(0))).alias("__mean"),
    )
    per_source = written(per_source, "mix-sources")
    targets = source_targets(per_source.select("source", "source_size"), weights, max_copies)
    means = per_source.select(F.col("source").alias("__s"), "__mean")
    targets = targets.join(means, F.col("source").eqNullSafe(F.col("__s")))
    targets = written(targets.select(F.col("source").alias("__t"), "source_size", "target", "__mean"), "mix-targets")

    # expected copies, their whole part and the Pareto rank of the fraction; the bin is that rank mapped to [0, 1)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = F.least(rate * F.coalesce(F.col("__w") / F.col("__mean"), F.lit(1.0)), F.lit(float(max_copies)))
    rows = base.join(targets, F.col("__source").eqNullSafe(F.col("__t")))
    rows = rows.withColumn("__whole", F.floor(wanted + 1e-12).cast("long")).withColumn("__p", wanted - F.col("__whole"))
    odds = (F.col("__u") / (1 - F.col("__u"))) / (F.col("__p") / (1 - F.col("__p")))
    rows = rows.withColumn("__q", F.when(F.col("__p") > 1e-12, odds))
    rows = rows.withColumn("__bin", F.floor(F.col("__q") / (1 + F.col("__q")) * bins).cast("int"))

    left = rows.groupBy(F.col("__source").alias("__s")).agg((F.max("target") - F.sum(F.col("__whole") * F.col("__size"))).alias("__left"))
    per_bin = rows.where("__q is not null").groupBy("__source", "__bin").agg(F.sum("__size").alias("__words"))
    running = Window.partitionBy("__source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = F.col("__left") - F.col("__upto") + F.col("__words")
    cut = written(
        per_bin.withColumn("__upto", F.sum("__words").over(running))
        .join(left, F.col("__source").eqNullSafe(F.col("__s")))
        .where(F.col("__upto") > F.col("__left"))
        .groupBy("__s").agg(F.min(F.struct("__bin", room.alias("__room"))).alias("__cut"))
        .select("__s", F.col("__cut.__bin").alias("__cut_bin"), F.col("__cut.__room").alias("__room")),
        "mix-cut",
    )
    # within the cut bin, by rank: a document is taken if more than half of it fits
    order = Window.partitionBy("__source").orderBy("__q", "__id", "__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mine = F.struct("__q", "__id", "__row")
    edge = written(
        rows.join(cut, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bin") == F.col("__cut_bin")))
        .withColumn("__upto", F.sum("__size").over(order))
        .where(F.col("__upto") - F.col("__size") / 2 <= F.col("__room"))
        .groupBy(F.col("__source").alias("__e")).agg(F.max(mine).alias("__to")),
        "mix-edge",
    )
    rows = rows.join(cut, F.col("__source").eqNullSafe(F.col("__s")), "left").join(edge, F.col("__source").eqNullSafe(F.col("__e")), "left")
    drawn = (
        F.when(F.col("__q").isNull(), False)
        .when(F.col("__cut_bin").isNull() | (F.col("__bin") < F.col("__cut_bin")), True)
        .otherwise(F.coalesce((F.col("__bin") == F.col("__cut_bin")) & (mine <= F.col("__to")), F.lit(False)))
    )
    copies = F.col("__whole") + drawn.cast("long")
    return rows.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("__size").alias("size"), "source_size", "target",
        copies.alias("copies"), (copies * F.col("__size")).alias("taken"),
    )


def repeat(mixed: DataFrame) -> DataFrame:
    """One row for each copy that a mix takes, without the columns it added."""
    rows = mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.drop(*OUTPUTS, "__copy")
