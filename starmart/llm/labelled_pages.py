"""Labelled pages from which the HTML model learns.

Layouts are drawn at random (by a seed) from parts that web pages are made of: page
heads, menus, notices, adverts, sidebars, share bars, forms, reader comments, related
links and footers around an article, in semantic, class-named and table markup, with
and without helpful names.  Filler words are invented, so nothing is learned from
words.  ``data-label`` marks the top of content (1) and of what is not (0); elements
below inherit it, and the model never sees the mark.
"""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ren ta su vel dor an pi es tor qua lin be mar os ul fen gri".split()


class _Writer:
    def __init__(self, rng: random.Random) -> None:
        self.rng = rng

    def words(self, lo: int, hi: int) -> str:
        return " ".join("".join(self.rng.choices(_SYLLABLES, k=self.rng.randint(1, 3))) for _ in range(self.rng.randint(lo, hi)))

    def sentence(self) -> str:
        return self.words(2, 14).capitalize() + self.rng.choice(".....!?") + " "

    def prose(self, lo: int, hi: int) -> str:
        text = "".join(self.sentence() for _ in range(self.rng.randint(lo, hi))).strip()
        if self.rng.random() < 0.3:
            a, *rest = text.split(" ")
            text = f'{a} <a href="/x">{self.words(1, 3)}</a> {" ".join(rest)}'
        if self.rng.random() < 0.3:
            text = f"<b>{self.words(1, 4)}</b> {text}"
        if self.rng.random() < 0.15:
            text = "*** ".join(text.split(" "))
        return text

    def pick(self, *names: str) -> str:
        """One of the names as class or id, or none."""
        name = self.rng.choice([*names, ""])
        if not name:
            return ""
        kind = self.rng.choice(["class", "class", "id"])
        return f' {kind}="{name}"'

    def links(self, lo: int, hi: int) -> str:
        items = [f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>' for _ in range(self.rng.randint(lo, hi))]
        style = self.rng.randrange(3)
        if style == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        if style == 1:
            return " | ".join(items)
        return "".join(f"<div>{x}</div>" for x in items)


def _menu(w: _Writer) -> str:
    tag = w.rng.choice(["nav", "nav", "div", "ul"])
    name = w.pick("nav", "menu", "main-menu", "breadcrumb", "topbar", "navbar") if tag == "nav" else f' class="{w.rng.choice(["nav", "menu", "site-nav", "breadcrumbs menu"])}"'
    return f'<{tag}{name} data-label="0">{w.links(2, 8)}</{tag}>'


def _head(w: _Writer) -> str:
    tag = w.rng.choice(["header", "div"])
    name = w.pick("site-header", "masthead", "top") if tag == "header" else f' class="{w.rng.choice(["header", "masthead", "banner", "page-header"])}"'
    inner = w.rng.choice([f"<h1>{w.words(1, 4)}</h1>", f'<div class="logo">{w.words(1, 2)}</div><p>{w.sentence()}</p>', f"<a href='/'>{w.words(1, 3)}</a>"])
    return f'<{tag}{name} data-label="0">{inner}{_menu(w) if w.rng.random() < 0.5 else ""}</{tag}>'


def _foot(w: _Writer) -> str:
    tag = w.rng.choice(["footer", "footer", "div"])
    name = w.pick("footer", "site-footer", "legal") if tag == "footer" else f' class="{w.rng.choice(["footer", "copyright", "page-footer legal"])}"'
    inner = w.rng.choice([f"&copy; {w.words(1, 3)} &middot; {w.prose(1, 3)}", f"<p>{w.prose(1, 4)}</p>{w.links(2, 5)}", f"<p>&copy; 2021 {w.words(2, 5)}. {w.prose(1, 2)}</p>", f"{w.prose(1, 3)}\n{w.sentence()}"])
    return f'<{tag}{name} data-label="0">{inner}</{tag}>'


def _advert(w: _Writer) -> str:
    name = w.rng.choice(["ad", "ads", "advert", "ad-box", "sponsored", "promo", "advertisement"])
    tag = w.rng.choice(["div", "div", "aside", "section", "p"])
    inner = w.prose(1, 5) if tag == "p" or w.rng.random() < 0.6 else f"<p>{w.prose(1, 4)}</p>"
    return f'<{tag} {w.rng.choice(["class", "id"])}="{name}" data-label="0">{inner}</{tag}>'


def _notice(w: _Writer) -> str:
    name = w.rng.choice(["cookie", "cookie-notice", "consent", "notice", "newsletter", "popup modal", "alert", "subscribe"])
    tag = w.rng.choice(["div", "div", "section", "aside"])
    inner = w.rng.choice([w.prose(1, 4), f"<p>{w.prose(1, 4)}</p><button>{w.words(1, 2)}</button>", f"<h2>{w.words(1, 4)}</h2><p>{w.prose(1, 3)}</p>"])
    return f'<{tag} {w.rng.choice(["class", "id"])}="{name}" data-label="0">{inner}</{tag}>'


def _sidebar(w: _Writer) -> str:
    tag = w.rng.choice(["aside", "aside", "div", "section"])
    name = w.pick("sidebar", "side", "widget") if tag == "aside" else f' class="{w.rng.choice(["sidebar", "widget-area", "related", "right-rail", "popular"])}"'
    inner = w.rng.choice([w.prose(1, 5), f"<h3>{w.words(1, 4)}</h3>{w.links(2, 6)}", f"<h3>{w.words(1, 3)}</h3><p>{w.prose(1, 4)}</p>", f"<p>{w.prose(1, 3)}</p>"])
    return f'<{tag}{name} data-label="0">{inner}</{tag}>'


def _form(w: _Writer) -> str:
    inner = w.rng.choice([f"<label>{w.words(1, 3)}</label><input type='text'>", f"<p>{w.prose(1, 3)}</p><input name='q'><button>{w.words(1, 2)}</button>",
                          f"<fieldset><legend>{w.words(1, 3)}</legend><label>{w.words(1, 4)} <input></label></fieldset>{w.sentence()}",
                          f"<select><option>{w.words(1, 2)}</option><option>{w.words(1, 2)}</option></select><textarea>{w.sentence()}</textarea>"])
    return f'<form{w.pick("search", "login", "contact")} data-label="0">{inner}</form>'


def _comments(w: _Writer) -> str:
    one = w.rng.choice(['<div class="comment"><p>{}</p></div>', "<li><b>{}</b><p>{}</p></li>", '<article class="comment"><p>{}</p></article>', "<p>{}</p>", '<div class="reply"><span class="author">{}</span> {}</div>'])
    inner = "".join(one.format(w.words(1, 2), w.prose(1, 5)) if one.count("{}") == 2 else one.format(w.prose(1, 5)) for _ in range(w.rng.randint(1, 4)))
    tag = w.rng.choice(["div", "section", "ol" if one.startswith("<li") else "div"])
    head = f"<h3>{w.words(1, 3)}</h3>" if tag != "ol" and w.rng.random() < 0.5 else ""
    return f'<{tag} {w.rng.choice(["class", "id"])}="{w.rng.choice(["comments", "comment-list", "replies", "discussion", "reader-comments"])}" data-label="0">{head}{inner}</{tag}>'


def _share(w: _Writer) -> str:
    return f'<div class="{w.rng.choice(["share", "social", "social-share"])}" data-label="0">{w.links(1, 4)}</div>'


def _article(w: _Writer) -> str:
    blocks = []
    if w.rng.random() < 0.85:
        blocks.append(f"<h1>{w.words(2, 12).capitalize()}</h1>")
    for _ in range(w.rng.choice([1, 1, 2, 3, 4, 6, 9])):
        kind = w.rng.random()
        if kind < 0.7:
            end = w.rng.choice(["</p>", "</p>", "</p>", "", "<br>"])
            blocks.append(f"<p>{w.prose(1, 9)}{end}")
        elif kind < 0.78:
            blocks.append(f"<h{(n := w.rng.randint(2, 4))}>{w.words(1, 6)}</h{n}><p>{w.prose(1, 5)}</p>")
        elif kind < 0.84:
            blocks.append("<ul>" + "".join(f"<li>{w.words(1, 12)}</li>" for _ in range(w.rng.randint(2, 5))) + "</ul>")
        elif kind < 0.89:
            blocks.append(f"<blockquote><p>{w.prose(1, 4)}</p></blockquote>")
        elif kind < 0.93:
            blocks.append("<table>" + "".join("<tr>" + "".join(f"<td>{w.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(w.rng.randint(1, 4))) + "</table>")
        elif kind < 0.96:
            blocks.append(f"<figure><img src='a.png'><figcaption>{w.words(2, 9)}.</figcaption></figure><p>{w.words(1, 2)}.</p>")
        else:
            blocks.append(f"<pre>{w.words(3, 20)}</pre><p>{w.sentence()}</p>")
        if w.rng.random() < 0.12:
            blocks.append(w.rng.choice([_advert, _share, _notice, _sidebar, _form])(w))
    inner = "".join(blocks)
    if w.rng.random() < 0.2:
        inner += w.rng.choice([_comments, _share, _form, _sidebar])(w)
    style = w.rng.randrange(6)
    if style < 2:
        return f'<article{w.pick("post", "entry", "story")} data-label="1">{inner}</article>'
    if style == 2:
        return f'<main{w.pick("content", "main")} data-label="1">{w.rng.choice(["{}", "<article>{}</article>", "<section>{}</section>", "<div>{}</div>"]).format(inner)}</main>'
    if style == 3:
        return f'<div class="{w.rng.choice(["content", "article-body", "post entry", "story", "main-text", "entry-content"])}" data-label="1">{inner}</div>'
    if style == 4:
        return f'<section{w.pick("content", "article", "post")} data-label="1">{inner}</section>'
    return f'<div{w.pick("content", "main", "body")} data-label="1"><div>{inner}</div></div>'


def labelled_page(rng: random.Random) -> str:
    w = _Writer(rng)
    some = lambda share, part: part(w) if rng.random() < share else ""
    before = [some(0.4, _head), some(0.6, _menu), some(0.25, _notice), some(0.4, _advert), some(0.1, _form)]
    after = [some(0.2, _share), some(0.3, _comments), some(0.35, _sidebar), some(0.2, _advert), some(0.1, _form), some(0.1, _notice)]
    rng.shuffle(before)
    rng.shuffle(after)
    body = f"<!-- {w.words(1, 3)} -->" + "".join(before) + _article(w) + "".join(after)
    if rng.random() < 0.35:
        body = f'<div{w.pick("wrapper", "container", "page")}>{body}</div>'
    if rng.random() < 0.08:
        body = f"<table><tr><td data-label='0'>{w.links(2, 5)}</td><td>{body}</td></tr></table>"
    body += some(0.8, _foot)
    end = "</body></html>" if rng.random() < 0.85 else ""
    return f'<!DOCTYPE html><html lang="xx"><head><title>{w.words(2, 6)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{body}{end}'


def labelled_pages(n: int = 600, seed: int = 11) -> list[str]:
    rng = random.Random(seed)
    return [labelled_page(rng) for _ in range(n)]
