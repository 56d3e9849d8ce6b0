"""Generated texts with labelled personal data, from which ``pii`` learns.

Each text is a line of invented words around one item: personal data in a form that the
base patterns miss, or another number or phrase that looks like it.  Contexts announce
the item's kind, another kind of number, or nothing.  Everything follows from a seeded
generator, so the texts are the same everywhere.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

from starmart.llm.pii import KINDS, Span, luhn

# Phrases before an item.
LEADS = {
    "email": ["mail:", "contact me at", "e-mail", "write to", "Kontakt:", "correo:", "courriel :", "reply to", "address:"],
    "ip": ["ip", "host", "login from", "server at", "client", "ping", "IPv6:", "gateway", "servidor", "the address"],
    "card": ["card", "credit card no.", "Visa", "Mastercard", "amex", "Kreditkarte", "tarjeta", "carte", "paid with card", "card number:"],
    "phone": ["tel.", "phone:", "call", "fax", "mobile", "Telefon", "teléfono", "téléphone :", "call me on", "WhatsApp", "cell"],
    "other": ["ISBN", "order no.", "invoice", "version", "page", "date", "total", "ref.", "id", "serial", "Rechnung", "pedido", "commande", "row", "token ="],
}
_TLDS = ["com", "org", "net", "de", "fr", "es", "io", "info", "edu"]
_SYLLABLES = ["the", "er", "on", "ing", "ti", "la", "que", "de", "ei", "sch", "ou", "ê", "ño", "re", "tion", "an", "st", "ü", "al", "mo"]


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3)))


def _number(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random, n: int, good: bool = True) -> str:
    head = r.choice(["34", "37"]) if n == 15 else r.choice(["36", "38", "30"]) if n == 14 else r.choice(["4", "51", "55", "60", "65"])
    body = head + _number(r, n - len(head) - 1)
    last = next(d for d in "0123456789" if luhn(body + d))
    return body + (last if good else str((int(last) + r.randint(1, 9)) % 10))


def _grouped(digits: str, sizes: list[int], by: str) -> str:
    parts, at = [], 0
    for n in sizes:
        parts.append(digits[at : at + n])
        at += n
    return by.join(p for p in [*parts, digits[at:]] if p)


def _email(r: random.Random) -> str:
    name = r.choice([_word(r), f"{_word(r)}.{_word(r)}", f"{_word(r)}{r.randint(1, 99)}"])
    host, tld = _word(r), r.choice(_TLDS)
    plain = lambda s: s.replace("ê", "e").replace("ü", "u").replace("ño", "no")
    form = r.randrange(6)
    if form == 0:
        return f"josé.{name}@{host}ü.{tld}"
    name, host = plain(name), plain(host)
    mark = r.choice([" (at) ", " [at] ", "(at)", "[at]", " [AT] ", "{at}"])
    if form < 3:
        return f"{name}{mark}{host}.{tld}"
    if form == 3:
        return f"{name}{mark}{host}{r.choice([' (dot) ', ' [dot] ', '[.]', '(dot)'])}{tld}"
    if form == 4:
        return f"{name} at {host} dot {tld}"
    return f"{name} @ {host}.{tld}"


def _ip(r: random.Random) -> str:
    if r.random() < 0.5:
        words = [f"{r.randrange(1, 65536):x}" for _ in range(8)]
        if r.random() < 0.5:
            cut = r.randint(1, 5)
            return ":".join(words[:cut]) + "::" + ":".join(words[cut + r.randint(1, 2) + 1 :])
        return ":".join(words)
    return r.choice(["[.]", "(.)", "[dot]", " . ", " [.] "]).join(str(r.randrange(1, 256)) for _ in range(4))


def _any_card(r: random.Random) -> str:
    n = r.choice([13, 14, 15, 15, 15, 16, 16])
    digits = _card(r, n)
    if n == 15:
        return _grouped(digits, [4, 6, 5], r.choice([" ", "-", "", "."]))
    if n == 16:
        return _grouped(digits, [4, 4, 4, 4], r.choice([".", "/", "  ", "- "]))
    return _grouped(digits, [4, 4, 4], r.choice([" ", "-", ""]))


def _national_phone(r: random.Random) -> str:
    d = str(r.randint(2, 9)) + _number(r, 9)
    return r.choice([
        f"({d[:3]}) {d[3:6]}-{d[6:]}", f"({d[:3]}) {d[3:6]} {d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"0{d[:3]}/{d[3:]}", f"0{d[:3]} {d[3:]}",
        f"0{d[0]} {d[1:3]} {d[3:5]} {d[5:7]} {d[7:9]}", f"0049 {d[:3]} {d[3:]}", f"00{d[:2]} {d[2:5]} {d[5:]}", f"1-{d[:3]}-{d[3:6]}-{d[6:]}", f"+49/{d[:3]}/{d[3:]}"])


def _bare_phone(r: random.Random) -> str:
    """Digits that only a context makes a phone number."""
    return r.choice([str(r.randint(2, 9)) + _number(r, r.randint(6, 9)), f"{r.randint(200, 999)}-{_number(r, 4)}", f"0{r.randint(1, 9)}{_number(r, 8)}"])


def _other(r: random.Random) -> str:
    y, m, d = r.randint(1950, 2035), r.randint(1, 12), r.randint(1, 28)
    return r.choice([
        lambda: f"{y}-{m:02}-{d:02}", lambda: f"{d:02}.{m:02}.{y}", lambda: f"{m:02}/{d:02}/{y}", lambda: f"{y}-{y + r.randint(1, 9)}", lambda: f"{y}-{m:02}-{d:02} {r.randrange(24):02}:{r.randrange(60):02}:{r.randrange(60):02}",
        lambda: f"{r.randrange(24):02}:{r.randrange(60):02}:{r.randrange(60):02}", lambda: "978-" + "-".join([_number(r, 1), _number(r, 2), _number(r, 6), _number(r, 1)]), lambda: _number(r, r.randint(7, 19)),
        lambda: _card(r, r.choice([13, 14, 15, 16, 16, 16]), good=False), lambda: _grouped(_card(r, 16, good=False), [4, 4, 4, 4], r.choice([" ", "-", "."])),
        lambda: f"{r.randint(1, 999)}.{_number(r, 3)}.{_number(r, 3)}", lambda: f"{r.randint(1, 999)}.{_number(r, 3)}.{_number(r, 3)}.{_number(r, 3)}", lambda: f"{r.randint(1, 20)}.{r.randint(0, 30)}.{r.randint(0, 30)}.{r.randint(256, 9999)}",
        lambda: " ".join(_number(r, r.randint(1, 4)) for _ in range(r.randint(4, 9))), lambda: "/".join(_number(r, 4) for _ in range(3)), lambda: f"({y}) {r.randint(100, 999)}-{r.randint(100, 999)}",
        lambda: f"{_word(r)} at {_word(r)} {_word(r)}", lambda: f"{_word(r)} @ {_word(r)}", lambda: f"@{_word(r)}", lambda: f"{r.randint(2, 90)} @ {r.randint(1, 99)}.{_number(r, 2)}", lambda: "\"" + "".join(r.choice("0123456789abcdef") for _ in range(40)) + "\"",
        lambda: f"{_word(r)}::{_word(r)}", lambda: f"{r.randint(1, 40)}:{r.randint(1, 40)}:{r.randint(1, 40)}", lambda: f"{r.randint(-90, 90)}.{_number(r, 6)}", lambda: f"{_number(r, 5)}-{_number(r, 4)}", lambda: f"{_number(r, 3)}-{_number(r, 2)}-{_number(r, 4)}",
    ])()


_MAKERS = {"email": _email, "ip": _ip, "card": _any_card, "phone": _national_phone}


def labelled_texts(n: int, seed: int = 12) -> Iterator[tuple[str, set[Span]]]:
    """``n`` texts with the spans of their personal data."""
    r = random.Random(seed)
    for i in range(n):
        kind = KINDS[i // 2 % len(KINDS)] if i % 2 else "other"
        lead = r.choice(LEADS[kind]) if r.random() < 0.5 else ""
        if kind == "other":
            item = _other(r)
        elif kind == "phone" and r.random() < 0.3:
            lead, item = lead or r.choice(LEADS["phone"]), _bare_phone(r)
        else:
            item = _MAKERS[kind](r)
            # shorter card numbers are one of ten numbers that pass by chance: only with a word for them
            if kind == "card":
                lead = lead or r.choice(LEADS["card"])
        before = " ".join([*(_word(r) for _ in range(r.randint(0, 6))), *([lead] if lead else [])])
        before += r.choice([" ", " ", " ", "\n", " (", ": ", ", "]) if before else ""
        after = r.choice([" ", " ", ". ", ", ", "\n", "; ", ") "]) + " ".join(_word(r) for _ in range(r.randint(1, 5)))
        yield before + item + after, set() if kind == "other" else {Span(KINDS.index(kind), len(before), len(before) + len(item))}
