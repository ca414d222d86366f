"""Labelled pages for the extraction model, made from a few layouts and a seed.

``data-content`` says whether an element's text is content; elements without it are labelled
like their parent.  The attribute is read for labels only.
"""

from __future__ import annotations

import random
import re

_SYLLABLES = "ka lo mi ren tas vel dor su pin gra tho ne wi bal cor".split()


def _words(rng: random.Random, low: int, high: int) -> str:
    n = rng.randint(low, high)
    words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return (" ".join(words)).capitalize()


def _sentences(rng: random.Random, n: int) -> str:
    return " ".join(_words(rng, 1, 22) + rng.choice("...!?") for _ in range(n))


def _links(rng: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/x">{_words(rng, 1, 3)}</a></li>' for _ in range(n))


def _content(rng: random.Random) -> str:
    parts = [f"<h1>{_words(rng, 1, 12)}</h1>"]
    if rng.random() < 0.2:  # many short paragraphs
        for _ in range(rng.randint(8, 60)):
            parts.append(f"<p>{_words(rng, 1, 4)}{rng.choice(['.', '!', ''])}</p>")
    for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9])):
        kind = rng.random()
        if kind < 0.6:
            parts.append(f"<p>{_sentences(rng, rng.randint(1, 6))}</p>")
        elif kind < 0.68:
            parts.append(f"<h2>{_words(rng, 1, 6)}</h2>")
        elif kind < 0.76:
            parts.append("<ul>" + "".join(f"<li>{_sentences(rng, 1)}</li>" for _ in range(3)) + "</ul>")
        elif kind < 0.82:
            parts.append(f"<blockquote><p>{_sentences(rng, 2)}</p></blockquote>")
        elif kind < 0.88:
            parts.append(f'<p>{_words(rng, 3, 9)} <a href="/y">{_words(rng, 1, 4)}</a> {_sentences(rng, 1)}</p>')
        elif kind < 0.92:
            parts.append(f"<table><tr><td>{_words(rng, 1, 3)}</td><td>{_words(rng, 1, 3)}</td></tr></table>")
        elif kind < 0.96:
            parts.append(f"<div>{_sentences(rng, 2)}</div>")
        else:
            name = rng.choice(["ad", "advert", "promo", "share", "related", "newsletter"])
            parts.append(f'<div class="{name}" data-content="0"><p>{_sentences(rng, 1)}</p></div>')
    return "".join(parts)


def _furniture(rng: random.Random) -> tuple[list[str], list[str]]:
    """Elements before and after the content."""
    links = _links(rng, rng.randint(2, 8))
    before = [
        rng.choice([f"<nav><ul>{links}</ul></nav>", f'<div class="menu"><ul>{links}</ul></div>',
                    f'<ul id="main-nav">{links}</ul>', f'<div role="navigation">{links}</div>']),
        rng.choice([f"<header><h2>{_words(rng, 1, 4)}</h2></header>",
                    f'<div id="header"><p>{_words(rng, 2, 6)}</p></div>',
                    f"<header><p>{_sentences(rng, 1)}</p></header>"]),
        rng.choice([f'<div class="cookie-notice"><p>{_sentences(rng, 2)}</p></div>',
                    f'<div class="ad">{_sentences(rng, 1)}</div>',
                    f'<div class="banner">{_words(rng, 3, 9)}</div>',
                    f'<div role="alert">{_sentences(rng, 1)}</div>']),
    ]
    comments = "".join(
        f'<div class="comment"><p>{_sentences(rng, rng.randint(1, 3))}</p></div>' for _ in range(3)
    )
    after = [
        rng.choice([f"<aside><h3>{_words(rng, 1, 3)}</h3><p>{_sentences(rng, 2)}</p></aside>",
                    f'<div class="sidebar"><p>{_sentences(rng, 2)}</p><ul>{links}</ul></div>']),
        rng.choice([f'<section class="comments"><h3>{_words(rng, 1, 2)}</h3>{comments}</section>',
                    f'<div id="comments">{comments}</div>', f'<ol class="commentlist"><li>{comments}</li></ol>']),
        rng.choice([f"<form><label>{_words(rng, 1, 3)}</label><button>{_words(rng, 1, 2)}</button></form>",
                    f"<form><p>{_sentences(rng, 1)}</p></form>"]),
        rng.choice([f"<footer>&copy; {_sentences(rng, 1)}</footer>",
                    f'<div class="footer"><p>{_sentences(rng, 1)}</p></div>']),
    ]
    pick = lambda items: [i for i in items if rng.random() < 0.7]
    before, after = pick(before), pick(after)
    rng.shuffle(before)
    return before, after


def _page(inner: str) -> str:
    return f'<html><head><title>x</title></head><body data-content="0">{inner}</body></html>'


def labelled_pages(n: int = 260, seed: int = 11) -> list[str]:
    rng = random.Random(seed)
    pages = []
    for _ in range(n):
        before, after = _furniture(rng)
        body = _content(rng)
        if rng.random() < 0.12:  # content without an element around it
            loose = re.sub(r"<(h1|h2|p|ul|blockquote|table|div)>", r'<\1 data-content="1">', body)
            pages.append(_page("".join(before) + loose + "".join(after)))
            continue
        inner = [after.pop(0)] if after and rng.random() < 0.15 else []
        inner = [f'<div data-content="0">{i}</div>' for i in inner]
        body += "".join(inner)
        body = rng.choice([
            f'<article data-content="1">{body}</article>',
            f'<article data-content="1">{body}</article>',
            f'<main data-content="1">{body}</main>',
            f'<main><article data-content="1">{body}</article></main>',
            f'<div class="content" data-content="1">{body}</div>',
            f'<div id="post-body" data-content="1">{body}</div>',
            f'<div class="entry" data-content="1"><div>{body}</div></div>',
            f'<section data-content="1">{body}</section>',
        ])
        page = "".join(before) + body + "".join(after)
        if rng.random() < 0.3:
            page = f'<div class="wrapper">{page}</div>'
        pages.append(_page(page))
    return pages + _nested_pages(random.Random(seed + 1), n // 6)


def _nested_pages(rng: random.Random, n: int) -> list[str]:
    """Pages and fragments whose content stands in plain elements inside each other."""
    pages = []
    for _ in range(n):
        before, after = _furniture(rng)
        inner = f"<p>{_sentences(rng, rng.randint(1, 4))}</p>" if rng.random() < 0.4 else _content(rng)
        for _ in range(rng.randint(1, 4)):
            inner = f"<div>{inner}</div>"
        inner = inner.replace("<div>", '<div data-content="1">', 1)
        if rng.random() < 0.4:
            before, after = [], []
        whole = "".join(before) + inner + "".join(after)
        if rng.random() < 0.3:  # a fragment without a body
            whole = whole.replace('<div data-content="1"><p>', '<p data-content="1">', 1)
            pages.append(whole)
        else:
            pages.append(_page(whole))
    return pages
