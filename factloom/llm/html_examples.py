"""The labelled table of page blocks: small pages in which a block of main text begins with "+" and any other with "-".

Written for this library after common kinds of pages: news, weblogs, manuals, shops, forums and bare pages, with and
without names for their parts. Texts of all lengths stand on both sides, so that neither length, place nor names alone
tell main text from the rest.
"""

from __future__ import annotations

import random
from itertools import product

WORDS = "the river rises in the hills and runs past three villages before it meets the sea at a wide and quiet bay".split()


class Texts:
    """Texts of main parts and of the rest, by one distribution of lengths: 1 to 80 words, most of them short."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def __call__(self) -> str:
        n = int(80 ** self.rng.random())
        return " ".join(WORDS[(k * 5) % len(WORDS)] for k in range(n))

    def paragraphs(self, mark: str, n: int, tag: str = "p") -> str:
        return "".join(f"<{tag}>{mark} {self()}</{tag}>" for _ in range(n))


def _links(mark: str, n: int, text: str = "item") -> str:
    return "<ul>" + "".join(f'<li><a href="/{i}">{mark} {text} {i}</a></li>' for i in range(n)) + "</ul>"


def _rest(t: Texts) -> dict[str, str]:
    """Parts that are not main text."""
    n, ps = t, t.paragraphs

    def card() -> str:
        return f'<article class="card"><h3><a href="/c">- {n()}</a></h3><p><a href="/c">- {n()}</a></p></article>'

    return {
        "nav": f"<nav>{_links('-', 4)}</nav>",
        "menu": f'<div class="menu">{_links("-", 3)}<p>- {n()}</p></div>',
        "header": f"<header><p>- {n()}</p><div>- {n()}</div></header>",
        "footer": f"<footer>- {n()} <p>- {n()}</p></footer>",
        "sidebar": f"<aside><h3>- more</h3>{ps('-', 2)}</aside>",
        "side": f'<div class="sidebar"><h2>- {n()}</h2>{ps("-", 1)}</div>',
        "ad": f'<div class="ad">- {n()}</div><div id="ads"><p>- {n()}</p></div>',
        "notice": f'<div class="cookie-notice"><p>- {n()}</p><button>- accept</button></div>',
        "form": f"<form><label>- your name</label><p>- {n()}</p><button>- send</button></form>",
        "comments": f'<section class="comments"><h2>- comments</h2><div class="comment">{ps("-", 2)}</div></section>',
        "related": f'<div class="related"><h3>- {n()}</h3>{_links("-", 3)}</div>',
        "readers": f'<article class="comment">{ps("-", 2)}</article><article id="reply-2" class="comment-body"><p>- {n()}</p></article>',
        "cards": f'<div class="related">{card()}{card()}</div>',
        "side_cards": f"<aside>{card()}{ps('-', 1)}</aside>",
        "side_list": f'<div id="sidebar">{card()}<p><a href="/m">- {n()}</a></p></div>',
        "share": f'<div class="share"><a href="/s">- share this</a></div><p class="tags">- <a href="/t">tags</a></p>',
        "legal": f'<div class="footer-legal"><p>- {n()}</p><p>- {n()}</p></div>',
        "signup": f'<div class="newsletter-signup"><h3>- {n()}</h3><p>- {n()}</p><form><button>- join</button></form></div>',
    }


_FRAMES = (
    "<article><h1>+ {title}</h1>{body}</article>",
    "<main><h1>+ {title}</h1>{body}</main>",
    '<div class="content"><h1>+ {title}</h1>{body}</div>',
    "<article><header><h1>+ {title}</h1></header>{body}{inner}</article>",
    "<article>{body}<ul><li>+ {title}</li><li>+ {title}</li></ul></article>",
    '<main><div class="post">{body}</div>{inner}</main>',
    "<article><h2>+ {title}</h2>{body}<blockquote>+ {title}</blockquote></article>",
    "<article><h1>+ {title}</h1>{inner}{body}<figure><img src=x><figcaption>+ {title}</figcaption></figure></article>",
    "<main><h1>+ {title}</h1><pre>+ {title}</pre><table><tr><th>+ a</th><td>+ {title}</td></tr></table>{body}</main>",
    "<article><dl><dt>+ {title}</dt><dd>+ {title}</dd></dl>{body}<h2>+ sources</h2><ul><li><a href=x>+ {title}</a></li><li><a href=y>+ {title}</a></li></ul></article>",
    '<article class="post comments-open"><p>+ {title}</p><div data-id="comments"><p>+ {title}</p></div>{body}</article>',
    '<div class="entry"><h2>+ {title}</h2>{body}{inner}</div>',
)
#: What can stand around a whole page.
_WRAPPERS = ("{page}", '<div class="layout has-sidebar">{page}</div>', "<form>{page}</form>", '<div class="page with-nav no-ads"><div>{page}</div></div>')
#: What can stand around the part with the article, where the rest is outside.
_AROUND = ("{main}", '<div class="sidebar-layout">{main}</div>', '<section class="banner">{main}</section>')


def _bare(t: Texts) -> list[str]:
    """Pages without names for their parts: only length and links tell."""
    n, ps = t, t.paragraphs
    return [
        f"<html><body><div>{_links('-', 5)}</div><h1>+ {n()}</h1>{ps('+', 3)}<div>{_links('-', 3)}</div></body></html>",
        f"<html><body>{ps('+', 2)}</body></html>",
        ps("+", 2, tag="div"),
        ps("+", 1),
        f"<body><h1>+ {n()}</h1><p>+ {n()}</p><p><a href=/>- home</a> <a href=/b>- back</a></p></body>",
        f"<body><div><a href=/>- home</a></div><div>+ {n()}<br>{n()}</div><div><a href=/i>- index</a> <a href=/n>next</a></div></body>",
        f"<body><table><tr><td><a href=/>- {n()}</a></td></tr><tr><td>+ {n()} <a href=/x>and</a> {n()}</td></tr></table></body>",
        f"<body>{ps('+', 2)}<p>+ {n()} river <a href=/x>like this</a> {n()} sea</p><ul><li>+ {n()}</li><li>+ {n()}</li></ul></body>",
    ]


_INNER = (("comments", "related", "ad"), ("form", "notice"), ("sidebar", "share"), ("side", "cards", "signup"), ("readers",))


def examples(rounds: int = 8) -> list[str]:
    t = Texts(5)
    pages = []
    for i, (_, frame) in enumerate(product(range(rounds), _FRAMES)):
        rest = _rest(t)
        names = list(rest)
        inner = "".join(rest[n] for n in _INNER[i % len(_INNER)])
        body = t.paragraphs("+", 1 + i % 4) + f'<p>+ {t()} <a href="/x">like this</a> {t()}</p>' * (i % 2)
        parts = frame.split("{title}")
        main = "".join(p + (t() if k < len(parts) - 1 else "") for k, p in enumerate(parts)).format(body=body, inner=inner)
        if frame.startswith(("<article", "<main")):
            main = _AROUND[i % len(_AROUND)].format(main=main)
        before = "".join(rest[n] for n in names[i % 3 :: 3])
        after = "".join(rest[n] for n in names[(i + 1) % 3 :: 3])
        page = _WRAPPERS[i % len(_WRAPPERS)].format(page=f"{before}{main}{after}")
        pages.append(f"<html><head><title>- {t()}</title></head><body>{page}</body></html>")
    for _ in range(rounds):
        pages += _bare(t)
    return pages
