"""Labelled pages from which the extraction model is trained.

An element with data-label="1" is content and one with data-label="0" is not; elements without the mark are labelled as their parent.
The pages are written here for this purpose, one layout for each pair of words that sites use to name their parts.
"""

from __future__ import annotations

import math
from itertools import cycle
from random import Random

#: Words in class or id of what is no content, with a tag that often carries them.
AROUND = [
    ("nav", "nav"), ("div", "menu"), ("div", "navbar"), ("ul", "navigation"), ("div", "breadcrumb"), ("header", "header"), ("div", "masthead"),
    ("div", "topbar"), ("footer", "footer"), ("div", "bottom"), ("div", "copyright"), ("aside", "sidebar"), ("div", "side"), ("div", "widget"),
    ("div", "related"), ("div", "recommended"), ("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("section", "sponsored"),
    ("div", "promo"), ("div", "banner"), ("div", "cookie"), ("div", "consent"), ("div", "notice"), ("div", "alert"), ("div", "popup"),
    ("div", "modal"), ("div", "newsletter"), ("div", "subscribe"), ("form", "search"), ("form", "login"), ("form", "signup"), ("div", "share"),
    ("div", "social"), ("section", "comments"), ("div", "comment"), ("div", "reply"), ("div", "respond"), ("div", "discussion"), ("div", "pagination"),
    ("div", "toolbar"), ("div", "legal"), ("nav", ""), ("footer", ""), ("aside", ""), ("header", ""), ("form", ""), ("dialog", ""), ("footer", ""), ("nav", ""),
    ("menu", ""), ("aside", ""), ("header", ""), ("form", ""), ("footer", ""), ("div", "disclaimer"), ("div", "tags"), ("dialog", "dialog"), ("div", "announcement"),
]
#: The same for content.
INSIDE = [
    ("article", ""), ("article", "post"), ("main", "main"), ("div", "content"), ("div", "article"), ("div", "entry"), ("section", "story"),
    ("div", "text"), ("div", "body"), ("div", "page"), ("article", "article"), ("article", ""),
]
_WORDS = "the text of this part goes on with some more words that tell what it is about and end here".split()


def _text(draw: Random, least: float, most: float) -> str:
    """Some words: as many in each doubling between the two limits as in any other."""
    n = round(math.exp(draw.uniform(math.log(least), math.log(most))))
    return " ".join(_WORDS[(k * 7) % len(_WORDS)] for k in range(n))


def _around(draw: Random, tag: str, word: str, form: int) -> str:
    short, line, long = (lambda: _text(draw, 1, 8)), (lambda: _text(draw, 2, 60)), (lambda: _text(draw, 3, 150))
    link = '<a href="/x">One more page</a>'
    inner = [
        f"<ul><li>{link}</li><li>{link}</li><li>{link}</li></ul>",
        f"<p>{line()} {link}</p>",
        f"<p>{long()}</p><p>{short()}</p>",
        f"{line()}",
        f"<h3>{short()}</h3><div><p>{line()}</p><p>{long()}</p></div>",
        f'<label>{short()}</label><input name="q"><button>{short()}</button><span>{line()}</span>',
    ][form]
    named = f' {("class", "id")[form % 2]}="{word}"' if word else ""
    return f'<{tag}{named} data-label="0">{inner}</{tag}>'


def _inside(draw: Random, tag: str, word: str, form: int) -> str:
    short, line, long = (lambda: _text(draw, 1, 12)), (lambda: _text(draw, 2, 90)), (lambda: _text(draw, 5, 300))
    link = '<a href="/y">a source</a>'
    parts = [
        f"<h1>{line()}</h1><p>{long()}</p><p>{line()} {link} {long()}</p><p>{short()}</p>",
        f"<h1>{short()}</h1><p>{long()}</p><h2>{short()}</h2><ul><li>{line()}</li><li>{line()} {link}</li></ul><p><b>{line()}</b><br>{long()}</p>",
        f"<h1>{line()}</h1><blockquote><p>{line()}</p></blockquote><p>{long()} <em>{short()}</em></p><pre>{line()}</pre><p>{short()}</p>",
        f"<h2>{line()}</h2><div><p>{long()}</p><p>{short()}</p></div><table><tr><th>{short()}</th><td>{line()}</td></tr></table><p>{long()}</p>",
        f"<h1>{short()}</h1><figure><img><figcaption>{line()}</figcaption></figure><ol><li>{line()}</li><li>{short()}</li></ol><p>{line()}</p><p>{long()}</p>",
        f"<h1>{line()}</h1><p>{short()}</p>",
    ][form]
    named = f' class="{word}"' if word else ""
    return f'<{tag}{named} data-label="1">{parts}</{tag}>'


def pages() -> list[str]:
    inside, out, draw = cycle(INSIDE), [], Random(2)
    for k in range(0, 6 * len(AROUND)):
        before, after, within = (AROUND[(k * step + k // len(AROUND)) % len(AROUND)] for step in (1, 5, 7))
        tag, word = next(inside)
        content = _inside(draw, tag, word, k % 6)
        if k % 3 == 0:  # something foreign in the middle of the content
            content = content.replace("</h1>", "</h1>" + _around(draw, *within, (k // 3) % 6), 1)
        wrapped = f"<div>{content}</div>" if k % 4 == 0 else content
        parts = _around(draw, *before, (k + k // 6) % 6) + wrapped + _around(draw, *after, (k + 3) % 6)
        out.append(f'<html data-label="1"><body>{parts}</body></html>')
    return out
