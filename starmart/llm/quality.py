"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of the whole text are Spark column expressions.  Shallow trees grown on
a bounded sample of labelled rows give rules: every path from a root is a
conjunction of thresholds on statistics.  A logistic model with an L1 penalty
weighs the rules and keeps few of them, and those are compiled into one column
expression, so scoring is a projection that runs with the scan.

Fitting: at most ``sample`` labelled rows, those with the smallest hash of the id,
are brought to the driver as statistics (numbers only, no texts).  Trees are fitted
by least squares to the current residuals of a boosted ensemble, on deterministic
subsamples; the penalty is chosen on a fifth of the sample.

Defined results: a null text counts as the empty one, whose shares are all 0, and has
a score like any other; without a label of each kind to learn from, every score is the
share of label 1 (0.5 without any).  Null labels and null ids are not learned from;
repeated labels count as often as they occur.  An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = r"[^\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Names and expressions of the statistics of a (non-null) text."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return {
        "chars": F.char_length(text).cast("double"),
        "n_words": F.size(words).cast("double"),
        "n_distinct": F.size(F.array_distinct(words)).cast("double"),
        "n_lines": F.size(F.split(text, "\n")).cast("double"),
        "n_letters": count(r"\p{L}"),
        "n_upper": count(r"\p{Lu}"),
        "n_digits": count(r"\p{N}"),
        "n_stops": count(r"[.!?](?=\s|$)"),
        "n_pipes": count(r"[|<>{}\\\[\]=~^]"),
        "n_symbols": count(r"[^\p{L}\p{N}\s.,;:!?'\"()-]"),
        "n_bangs": count(r"[!?]{2,}"),
    }


def ratios(c) -> dict[str, Column]:
    """What rules are about, from the counted statistics (``c(name)`` gives a column)."""
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return {
        "log_chars": F.log1p(c("chars")),
        "log_words": F.log1p(c("n_words")),
        "word_length": per(c("chars"), c("n_words")),
        "distinct_share": per(c("n_distinct"), c("n_words")),
        "words_per_line": per(c("n_words"), c("n_lines")),
        "letter_share": per(c("n_letters"), c("chars")),
        "upper_share": per(c("n_upper"), c("n_letters")),
        "digit_share": per(c("n_digits"), c("chars")),
        "stops_per_word": per(c("n_stops"), c("n_words")),
        "pipes_per_word": per(c("n_pipes"), c("n_words")),
        "symbol_share": per(c("n_symbols"), c("chars")),
        "bangs_per_word": per(c("n_bangs"), c("n_words")),
    }


FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_share", "words_per_line", "letter_share", "upper_share",
    "digit_share", "stops_per_word", "pipes_per_word", "symbol_share", "bangs_per_word",
)


def with_features(df: DataFrame, text_col: str) -> DataFrame:
    """Add the features as columns ``__f_<name>``."""
    text = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    counted = df.withColumns({f"__s_{k}": v for k, v in statistics(text).items()})
    return counted.withColumns({f"__f_{k}": v for k, v in ratios(lambda n: F.col(f"__s_{n}")).items()}).drop(
        *[f"__s_{k}" for k in statistics(text)])


Rule = tuple[tuple[int, bool, float], ...]  # conditions (feature, above?, threshold)


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + rule_matrix(x, self.rules) @ np.array(self.weights))))

    def column(self) -> Column:
        """The score as a column expression over the feature columns."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            test = None
            for feature, above, threshold in rule:
                c = F.col(f"__f_{FEATURES[feature]}")
                one = c > F.lit(threshold) if above else c <= F.lit(threshold)
                test = one if test is None else test & one
            total = total + F.when(test, F.lit(float(weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f}  " + " and ".join(f"{FEATURES[f]} {'>' if up else '<='} {t:.4g}" for f, up, t in r) for r, w in zip(self.rules, self.weights)]


def rule_matrix(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for feature, above, threshold in rule:
            out[:, k] *= (x[:, feature] > threshold) if above else (x[:, feature] <= threshold)
    return out


def _best_split(codes: np.ndarray, residual: np.ndarray, cuts: list[np.ndarray], least: int) -> tuple[float, int, int] | None:
    """(gain, feature, cut) of the largest drop in squared error."""
    best, n, total = None, len(residual), residual.sum()
    for f, at in enumerate(cuts):
        if not len(at):
            continue
        cnt = np.cumsum(np.bincount(codes[:, f], minlength=len(at) + 1))[:-1]
        left = np.cumsum(np.bincount(codes[:, f], residual, len(at) + 1))[:-1]
        ok = (cnt >= least) & (n - cnt >= least)
        if not ok.any():
            continue
        gain = np.where(ok, left**2 / np.maximum(cnt, 1) + (total - left) ** 2 / np.maximum(n - cnt, 1) - total**2 / n, -1)
        k = int(np.argmax(gain))
        if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
            best = float(gain[k]), f, k
    return best


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int = 1) -> list[Rule]:
    """The paths of boosted trees, each rule once."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, 40) / 40)) for f in range(x.shape[1])]
    cuts = [np.unique(np.concatenate([c, np.quantile(x[:, f][y == 0], np.arange(1, 20) / 20)])) for f, c in enumerate(cuts)]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    rules: dict[Rule, None] = {}
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    logit = np.full(len(y), np.log(mean / (1 - mean)))
    for t in range(trees):
        residual = y - 1 / (1 + np.exp(-logit))
        rows = rng.random(len(y)) < 0.5
        use = rng.random(x.shape[1]) < 0.7  # other trees look at other statistics
        grown = 1 + t % depth

        def grow(at: np.ndarray, path: Rule, level: int) -> None:
            inside = at & rows
            value = residual[inside].sum() / (1 + inside.sum() * 0.25)
            found = _best_split(codes[inside], residual[inside], [c if use[f] else c[:0] for f, c in enumerate(cuts)], 10) if level < grown and inside.sum() >= 20 else None
            if found is None:
                logit[at] += 0.3 * np.clip(value * 4, -4, 4)
                return
            _, f, k = found
            for above in (False, True):
                branch = path + ((f, above, float(cuts[f][k])),)
                rules[branch] = None
                grow(at & ((codes[:, f] > k) if above else (codes[:, f] <= k)), branch, level + 1)

        grow(np.ones(len(y), bool), (), 0)
    return list(rules)


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """L1 logistic regression by accelerated proximal steps; the columns of r are scaled to unit deviation."""
    mu, sd = r.mean(axis=0), np.maximum(r.std(axis=0), 0.02)
    z = (r - mu) / sd
    w, b = np.zeros(z.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, vb, t = w.copy(), b, 1.0
    step = 4 * len(y) / max(1.0, np.linalg.norm(z.T @ z, 2) + len(y))
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(z @ v + vb))) - y
        nw = v - step * (z.T @ g) / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * g.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w / sd, b - float((w / sd) @ mu)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3) -> RuleModel:
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return RuleModel([], [], float(np.log(share / (1 - share))))
    rules = grow_rules(x, y, trees, depth)
    if not rules:
        return RuleModel([], [], float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))))
    r = rule_matrix(x, rules)
    check = np.arange(len(y)) % 5 == 0
    best = None
    for penalty in (0.03, 0.01, 0.003, 0.001, 0.0003):
        if len(set(y[~check])) < 2 or not check.any():
            best = (0.0, 0.003)
            break
        w, b = _lasso(r[~check], y[~check], penalty, 200)
        p = np.clip(1 / (1 + np.exp(-(r[check] @ w + b))), 1e-6, 1 - 1e-6)
        loss = -(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean()
        if best is None or loss < best[0] - 1e-4:
            best = (loss, penalty)
    w, b = _lasso(r, y, best[1])
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel([rules[k] for k in kept], [float(w[k]) for k in kept], b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample: int = 12_000) -> RuleModel:
    """Learn from at most ``sample`` rows of ``labels`` (id, label) and the texts of those ids."""
    chosen = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "__y").limit(sample)
    # the chosen ids (bounded by sample) meet the scan before any statistic is computed
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    got = with_features(rows, "__text").drop("__text").orderBy(F.xxhash64("__id"), "__id", "__y").limit(2 * sample).toPandas()
    x = got[[f"__f_{f}" for f in FEATURES]].to_numpy(np.float64)
    return fit_rules(x, got["__y"].to_numpy(np.float64))


def classify(df: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 if score >= threshold)."""
    rows = with_features(df.drop("score", "predicted"), text_col).withColumn("score", model.column())
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop(*[f"__f_{f}" for f in FEATURES])
