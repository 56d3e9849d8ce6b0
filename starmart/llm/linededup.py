"""Line dedup by a log-template tree, with DataFrame functions only.

Every line is parsed at fixed depth: digits are masked, the first level is its
number of tokens, the next ``depth`` levels its leading tokens; that leaf holds
templates.  The rest of the line is cut into ``segments`` parts, and a template
keeps all of them but its variable fields ``<*>``: one part of a line of at least
``min_general`` tokens, any two parts from ``min_two`` tokens on (shorter lines keep
all parts).  So "Posted by alice in sports" and "Posted by bob in sports" are of one
template, as are long lines whose user and host differ in different parts.  Lines
that agree with a template of another document's line are the same template: the
line recurs.  A recurring template stays in the document with the smallest id and
its lines are dropped from all others.  Lines below ``min_tokens`` tokens (headings,
single words) are never dropped.

Per template only the smallest and largest document id are kept, by an
aggregation that combines before the shuffle, so a line in a third of all
documents is one row per task; the fewer than ``HOT`` templates that hold more than a
``HOT``-th of the rows are marked by a broadcast, the others by a join.  Templates are 64-bit hashes; two different ones
meet with probability of about (number of templates)**2 / 2**65.

Defined results: a null text stays null, an empty one empty; null ids count as one
document behind all others; ids that are no whole numbers are ordered as strings; rows that repeat id and text are treated alike; lines
end at ``\\n`` and the kept ones are joined by it, so untouched texts come back
byte for byte.  A document whose lines are all dropped has an empty text.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.llm.common import written

_LAST = 2**63 - 1  # stands for a null id
HOT = 1000


def _doc(df: DataFrame, id_col: str) -> Column:
    if df.select(id_col).schema[0].dataType.typeName() in ("byte", "short", "integer", "long"):
        return F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    return F.coalesce(F.concat(F.lit("0"), F.col(id_col).cast("string")), F.lit("1"))


def _normal(text: Column) -> Column:
    """Digits masked, and one space between the tokens of a line (its ends are trimmed per line)."""
    return F.regexp_replace(F.regexp_replace(text, "[0-9]+", "0"), r"[ \t\x0B\f\r]{2,}|[\t\x0B\f\r]", " ")


def line_templates(df: DataFrame, id_col: str, text_col: str, min_tokens: int, min_general: int, min_two: int, depth: int, segments: int) -> DataFrame:
    """(__doc, __hash of the text, __at, __key): a row for each template of each line that may be dropped."""
    lines = df.where(F.col(text_col).isNotNull()).select(
        _doc(df, id_col).alias("__doc"), F.xxhash64(text_col).alias("__hash"),
        F.posexplode(F.split(_normal(F.col(text_col)), "\n", -1)).alias("__at", "__raw"),
    ).select("__doc", "__hash", "__at", F.trim("__raw").alias("__line"))
    spaces = F.octet_length("__line") - F.octet_length(F.replace(F.col("__line"), F.lit(" "), F.lit("")))
    lines = lines.withColumn("__n", F.when(F.col("__line") == "", 0).otherwise(spaces + 1)).where(F.col("__n") >= min_tokens)
    n = F.col("__n")
    cut = [depth + F.floor((n - depth) * s / segments).cast("int") for s in range(segments + 1)]

    def part(s: int) -> Column:
        upto = F.call_function("substring_index", F.col("__line"), F.lit(" "), cut[s + 1])
        return F.xxhash64(F.call_function("substring_index", upto, F.lit(" "), cut[s] - cut[s + 1]))

    lines = lines.select(
        "__doc", "__hash", "__at", "__n", F.xxhash64(n, F.substring_index("__line", " ", depth)).alias("__leaf"),
        F.when(n < min_general, F.xxhash64("__line")).alias("__whole"),
        *[F.when(n >= min_general, part(s)).alias(f"__part{s}") for s in range(segments)],
    )

    def template(*fields: int) -> Column:
        return F.xxhash64("__leaf", *[F.lit(f) for f in fields], *[f"__part{s}" for s in range(segments) if s not in fields])

    exact = F.array(F.xxhash64("__leaf", "__whole"))
    one = F.array(*[template(s) for s in range(segments)])
    two = F.array(*[template(a, b) for a, b in combinations(range(segments), 2)])
    return lines.select("__doc", "__hash", "__at", F.explode(F.when(n >= min_two, two).when(n >= min_general, one).otherwise(exact)).alias("__key"))


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_tokens: int = 3,
                  min_general: int = 5, min_two: int = 12, depth: int = 2, segments: int = 4) -> DataFrame:
    """(__doc, __hash, __drops): for each text with recurring lines the sorted numbers of the lines to drop."""
    # written: both the counting and the marking read the parsed lines
    keys = written(line_templates(df, id_col, text_col, min_tokens, min_general, min_two, depth, segments), "line-templates")
    total = keys.count()
    recurring = written(
        keys.groupBy("__key").agg(F.min("__doc").alias("__first"), F.max("__doc").alias("__last"), F.count(F.lit(1)).alias("__rows"))
        .where(F.col("__first") < F.col("__last"))
        .select("__key", "__first", (F.col("__rows") * HOT > total).alias("__hot")), "line-recurring")
    hot, others = (recurring.where(F.col("__hot") == h).select("__key", "__first") for h in (True, False))
    marked = keys.join(F.broadcast(hot), "__key").unionByName(
        keys.join(F.broadcast(hot.select("__key")), "__key", "left_anti").join(others, "__key"))
    return (
        marked.where(F.col("__doc") > F.col("__first"))
        .groupBy("__doc", "__hash").agg(F.sort_array(F.collect_set("__at")).alias("__drops"))
    )


def drop_recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``df`` with the recurring lines taken out of ``text_col``, and ``n_lines`` and ``n_dropped`` added."""
    drops = dropped_lines(df, id_col, text_col, **params)
    rows = df.withColumns({
        "__doc": _doc(df, id_col),
        "__hash": F.xxhash64(text_col),
        "__lines": F.split(text_col, "\n", -1),  # below the join, so the lambda underneath reads a column
    })
    found = rows.join(drops, ["__doc", "__hash"], "left")
    # the kept lines are the runs between two dropped ones
    ends = F.concat("__drops", F.array(F.size("__lines")))
    after = lambda i: F.coalesce(F.get("__drops", i - 1), F.lit(-1)) + 1
    kept = F.flatten(F.transform(ends, lambda end, i: F.slice("__lines", after(i) + 1, end - after(i))))
    text = F.when(F.col("__drops").isNull(), F.array_join("__lines", "\n")).otherwise(F.array_join(kept, "\n"))
    return found.select(
        *[(text.alias(c) if c == text_col else F.col(f"`{c}`")) for c in df.columns if c not in ("n_lines", "n_dropped")],
        F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("__drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )
