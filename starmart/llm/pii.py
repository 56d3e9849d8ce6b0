"""Personal data in texts: candidate spans scored by gradient boosting.

Four kinds: email, ip, card, phone.  Base spans follow fixed patterns and checks and
are always kept.  Beside them, generators of high recall propose spans that the
patterns miss (spelled-out or non-ASCII addresses, IPv6 and defanged addresses, national
phone numbers, shorter or oddly grouped card numbers; windows of neighbouring
digit groups are phone and card candidates of their own, so spans overlap freely).
Boosted trees score each candidate from its format and its context, a logistic curve
fitted on held-out rows calibrates the score, and a candidate is taken from its kind's
threshold on: the lowest one at which ``precision`` of the held-out candidates above it
are right.  Of overlapping candidates the likeliest stays; a candidate may hold base
spans of its kind but not cross any.

The trees learn from generated labelled texts (``labelled_pii``), as no table marks
personal data; their number is fixed, so the model does not depend on the corpus and a
text's spans depend on that text only.

The work is map-only.  All patterns are anchored at a rare character or at the start of
a run, and bounded or possessive from there, so time grows with the length of a text.

Defined results: a null or empty text has no spans; offsets count code points, ends are
exclusive; the same text always gives the same spans, so ties and repeated rows need no
care; an empty table gives an empty table; other columns pass through, and one named
like an output is replaced.
"""

from __future__ import annotations

import functools
import ipaddress
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

KINDS = ("email", "ip", "card", "phone")
SPANS = ArrayType(StructType([
    StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()),
    StructField("base", BooleanType()), StructField("score", DoubleType())]))


class Span(NamedTuple):
    kind: int
    start: int
    end: int


# -- base spans ---------------------------------------------------------------

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _base_emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches from each @ to both sides: a name ends at its @, so it begins where its
    run of characters does, or where the last match ended."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    spans = [Span(0, *m) for m in _base_emails(text)]
    small = lambda part: len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255
    spans += [Span(1, *m.span()) for m in _IP.finditer(text) if all(map(small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(Span(2, *m.span()))
    if "+" in text:
        spans += [Span(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return spans


# -- candidates ---------------------------------------------------------------

_NUMBERS = re.compile(r"(?<![0-9A-Za-z_])[+(]{0,2}[0-9]++(?:[\x20().\-/ ]{1,2}[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_DOT = r"\x20?(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?"
_QUAD = re.compile(rf"(?<![0-9A-Za-z.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9A-Za-z])")
_MARK = re.compile(r"\x20?@\x20?|\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?|\x20(?:at|AT)\x20(?=[\w-]{1,63}\x20(?:dot|DOT)\x20)")
_NAME_END = re.compile(r"[\w.%+-]{1,64}\Z")
_HOST = re.compile(r"[\w-]{1,63}(?:(?:\.|\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20)[\w-]{1,63}){0,4}")


CHAIN = 8  # digit groups


def candidates(text: str) -> Iterator[Span]:
    """Spans that may be personal data, overlapping ones included."""
    for m in _MARK.finditer(text):
        name = _NAME_END.search(text, max(0, m.start() - 64), m.start())
        host = _HOST.match(text, m.end())
        if name and host:
            yield Span(0, name.start(), host.end())
    if ":" in text:
        for m in _IPV6.finditer(text):
            yield Span(1, *m.span())
    for m in _QUAD.finditer(text):
        yield Span(1, *m.span())
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() < 7:
            continue
        yield from _windows(text, m.start(), [(g.start(), g.end()) for g in _GROUP.finditer(text, *m.span())])


def _windows(text: str, first: int, groups: list[tuple[int, int]]) -> Iterator[Span]:
    """Neighbouring digit groups that may be one number: all windows of a short chain; in a
    longer one (a list or a table) those without the separators around them inside."""
    gaps = [None, *(text[a:b] for (_, a), (b, _) in zip(groups, groups[1:])), None]  # gap i is before group i
    long = len(groups) > CHAIN
    for i, (a, _) in enumerate(groups):
        lead = first if i == 0 else a - (text[a - 1] in "+(")
        total, inside = 0, set()
        for j in range(i, len(groups)):
            if j > i:
                inside.add(gaps[j])
            total += groups[j][1] - groups[j][0]
            if total > 19 or (long and gaps[i] in inside):
                break
            if total < 7 or (long and gaps[j + 1] in inside):
                continue
            end = groups[j][1]
            start = a if "(" in text[lead:a] and ")" not in text[lead:end] else lead
            if total <= 15:
                yield Span(3, start, end)
            if total >= 13:
                yield Span(2, start, end)


# -- features -----------------------------------------------------------------

# Words that announce a kind, and words that announce other numbers.
WORDS = {
    "email": "mail email e-mail address adresse contact contacto kontakt write escribe schreiben courriel correo reply",
    "ip": "ip ipv4 ipv6 host server client address adresse ping login gateway dns serveur servidor",
    "card": "card cards credit debit visa mastercard amex karte kreditkarte tarjeta carte cc payment paid",
    "phone": "phone tel telephone telefon teléfono téléphone call fax mobile cell handy móvil llame appelez anrufen sms whatsapp",
    "other": "isbn issn order invoice version page pages date total price ref id serial sku part bestellung rechnung factura pedido commande facture token hash row rows lines year",
}
_CONTEXT = {k: frozenset(v.split()) for k, v in WORDS.items()}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?|ipv[46]")
_SPELLED = re.compile(r"\b(?:at|dot)\b", re.I)
_LAST = re.compile(r"[^\s.\])}]*\Z")
_SEPARATORS = " -./()"
BEFORE, AFTER = 40, 16


def features(text: str, span: Span) -> list[float]:
    body = text[span.start : span.end]
    digits = _digits(body)
    numbers = _GROUP.findall(body)
    groups = [len(g) for g in numbers] or [0]
    spelled = span.kind < 2  # may hold letters
    before, after = text[max(0, span.start - BEFORE) : span.start], text[span.end : span.end + AFTER]
    left, right = before[-1:] or " ", after[:1] or " "
    near = _WORD.findall(before.lower())
    close, far = set(near[-3:]), set(near)
    last = _LAST.search(body).group() if spelled else ""
    return [
        span.kind, len(body), len(digits), len(groups), *(groups + [0, 0, 0])[:4], groups[-1], max(groups), min(groups), len(set(digits)),
        *[body.count(c) for c in _SEPARATORS], body.count(":"), body.count("@"), spelled and sum(map(str.isalpha, body)), not body.isascii(),
        body.startswith("+"), body.startswith("("), digits.startswith("0"), digits.startswith("00"), int(digits[:1] or 0), int(digits[:2] or 0),
        bool(digits) and luhn(digits), span.kind == 1 and _valid_ip(body), max((int(g) for g in numbers if len(g) < 5), default=0),
        last.isalpha() and 2 <= len(last) <= 6, spelled and bool(_SPELLED.search(body)),
        left.isalnum(), left.isspace(), left in "+(=#$€£\"'/-.:", right.isalnum(), right.isspace(), right in "%)-/:.,;",
        right in "-/.:" and after[1:2].isdigit(), before[-2:-1].isdigit(), after[1:2].isdigit(),
        *[len(close & _CONTEXT[k]) for k in _CONTEXT], *[len(far & _CONTEXT[k]) for k in _CONTEXT],
    ]


def _valid_ip(body: str) -> bool:
    plain = re.sub(r"\s|[\[\]()]", "", body.replace("dot", "."))
    try:
        ipaddress.ip_address(plain)
    except ValueError:
        return False
    return True


# -- boosted trees ------------------------------------------------------------

_DEPTH = 4


@dataclass
class Trees:
    """Complete binary trees over binned features: node i has children 2 i + 1 and 2 i + 2."""

    feature: np.ndarray   # (trees, 2 ** depth - 1)
    cut: np.ndarray       # rows above it go right
    value: np.ndarray     # (trees, 2 ** depth): of the leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(_DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - len(feature)]
        return total


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, rate: float = 0.2, ridge: float = 1.0, bins: int = 24) -> Trees:
    """Trees by second-order gradient steps on the logistic loss."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], axis=1)  # bin b: above edge b - 1
    nodes, score = 2**_DEPTH - 1, np.zeros(len(y))
    out = Trees(np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes + 1)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(_DEPTH):
            first, n = 2**level - 1, 2**level
            best = np.zeros(n)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                at = (node - first) * (len(e) + 1) + binned[:, f]
                size = n * (len(e) + 1)
                gl, hl = (np.bincount(at, v, size).reshape(n, -1).cumsum(axis=1) for v in (g, h))
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                cut = np.argmax(gain[:, :-1], axis=1)
                top = gain[np.arange(n), cut]
                better = top > best + 1e-9
                best[better] = top[better]
                out.feature[t, first : first + n][better] = f
                out.cut[t, first : first + n][better] = e[cut[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), out.feature[t, node]] > out.cut[t, node])
        leaf = node - nodes
        gl, hl = (np.bincount(leaf, v, nodes + 1) for v in (g, h))
        out.value[t] = rate * gl / (hl + ridge)
        score += out.value[t][leaf]
    return out


@dataclass
class Model:
    trees: Trees
    slope: float
    offset: float
    threshold: tuple[float, ...]  # by kind; above 1: never

    def chances(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.scores(x) + self.offset)))


def _calibrated(score: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic curve from scores to chances, by Newton's method."""
    w, design = np.array([1.0, 0.0]), np.stack([score, np.ones(len(score))], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-design @ w))
        hess = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(hess, design.T @ (y - p) - 1e-3 * (w - [1.0, 0.0]))
    return float(w[0]), float(w[1])


def _threshold(chance: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest chance from which on ``precision`` of the candidates are right, 0.5 at least."""
    order = np.argsort(-chance)
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.diff(chance[order], append=-1) < 0  # equal chances go together
    good = np.flatnonzero((right >= precision) & last)
    return max(0.5, float(chance[order][good[-1]])) if len(good) else 2.0


def open_candidates(text: str, base: list[Span]) -> list[Span]:
    """Candidates that base spans leave open: clear of them, or holding some of their own kind."""
    starts: list[list[int]] = [[] for _ in KINDS]
    ends: list[list[int]] = [[] for _ in KINDS]
    for kind, start, end in base:  # of one kind: in order, apart from each other
        starts[kind].append(start)
        ends[kind].append(end)

    def is_open(c: Span) -> bool:
        for kind in range(len(KINDS)):
            i = bisect_right(ends[kind], c.start)
            while i < len(starts[kind]) and starts[kind][i] < c.end:
                held = kind == c.kind and c.start <= starts[kind][i] and ends[kind][i] <= c.end
                if not held or (starts[kind][i], ends[kind][i]) == (c.start, c.end):
                    return False
                i += 1
        return True

    return [c for c in dict.fromkeys(candidates(text)) if is_open(c)]


def train(labelled: Iterable[tuple[str, set[Span]]], precision: float = 0.99, held_out: int = 4) -> Model:
    """Trees from labelled texts; every ``held_out``-th eight of them calibrate instead."""
    x, y, side = [], [], []
    for i, (text, true) in enumerate(labelled):
        for c in open_candidates(text, base_spans(text)):
            x.append(features(text, c))
            y.append(c in true)
            side.append(i // 8 % held_out == 0)
    x, y, side = np.array(x, np.float64), np.array(y, np.float64), np.array(side)
    trees = boost(x[~side], y[~side])
    slope, offset = _calibrated(trees.scores(x[side]), y[side])
    model = Model(trees, slope, offset, ())
    chance, kind = model.chances(x[side]), x[side][:, 0]
    return Model(trees, slope, offset, tuple(_threshold(chance[kind == k], y[side][kind == k], precision) for k in range(len(KINDS))))


def select(spans: list[Span], chance: np.ndarray, model: Model) -> list[tuple[Span, float]]:
    """The likeliest of overlapping candidates, of those from their kind's threshold on."""
    order = sorted(((-p, s.start - s.end, s) for s, p in zip(spans, chance.tolist()) if p >= model.threshold[s.kind]))
    starts: dict[int, Span] = {}
    taken: list[tuple[Span, float]] = []
    for p, _, s in order:
        # what is taken is known by every place it covers; a candidate's length is bounded
        if not any(at in starts for at in range(s.start, s.end)):
            starts.update(dict.fromkeys(range(s.start, s.end), s))
            taken.append((s, -p))
    return taken


# -- the operator -------------------------------------------------------------

@functools.lru_cache(maxsize=2)
def default_model(texts: int = 6000, precision: float = 0.99) -> Model:
    from starmart.llm.labelled_pii import labelled_texts
    return train(labelled_texts(texts), precision)


def spans_of(texts: list[str], model: Model) -> list[list[tuple[Span, bool, float]]]:
    """(span, is base, chance) of each text, by kind and start."""
    bases = [base_spans(t) for t in texts]
    opens = [open_candidates(t, b) for t, b in zip(texts, bases)]
    x = np.array([features(t, c) for t, cs in zip(texts, opens) for c in cs], np.float64)
    chance = model.chances(x) if len(x) else np.zeros(0)
    out, at = [], 0
    for base, cs in zip(bases, opens):
        added = select(cs, chance[at : at + len(cs)], model)
        at += len(cs)
        out.append(sorted([(s, True, 1.0) for s in base] + [(s, False, p) for s, p in added]))
    return out


_HELD = 1 << 22  # characters searched at once


def find(df: DataFrame, model: Model | None = None, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Add ``spans_col``: kind, start, end, whether the span is a base one, and its chance."""
    shared = df.sparkSession.sparkContext.broadcast(model or default_model())

    def rows(texts: list[str]) -> Iterator[list[dict]]:
        for spans in spans_of(texts, shared.value):
            yield [{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "base": b, "score": p} for s, b, p in spans]

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))

    @F.arrow_udf(SPANS)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out, held, size = [], [], 0
            for value in batch:
                held.append(value.as_py() or "")
                size += len(held[-1])
                if size >= _HELD:
                    out += rows(held)
                    held, size = [], 0
            yield pa.array(out + list(rows(held)), kind)

    return df.withColumn(spans_col, search(F.col(text_col)))


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "spans", out_col: str = "redacted") -> DataFrame:
    """Add ``out_col``: the text with each span replaced by its kind in capitals; of overlapping spans the first covers the rest."""
    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            out = []
            for text, found in zip(texts.to_pylist(), spans.to_pylist()):
                parts, at = [], 0
                for s in sorted(found or [], key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
                    at = max(at, s["end"])
                out.append(None if text is None else "".join([*parts, text[at:]]))
            yield pa.array(out, pa.string())

    return df.withColumn(out_col, run(F.col(text_col), F.col(spans_col)))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
