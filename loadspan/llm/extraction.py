"""HTML extraction by a tree-structured graphical model (operator 6).

Each element of a page is content or not. An element's features give its own potential, and each parent and child
share a potential; messages passed up to the root and down again (sum-product, exact on a tree) give every element's
marginal. The potentials are fitted by maximum likelihood to labelled pages. The text of a page is that of the blocks
whose element is content with probability of at least 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loadspan.llm.chunks import slices
from loadspan.llm.dom import Page, features
from loadspan.llm.tables import small_batches

_FORM = '<form action="/s"><p>Sign up for more</p><input name="q"><button>Go</button></form>'
_WORDS = "the river bends near old stone mills where carts of grain once passed each morning before bells rang over fields".split()


def _prose(n: int, at: int = 0) -> str:
    return " ".join(_WORDS[(at + i * 7) % len(_WORDS)] for i in range(n)).capitalize() + "."


def labelled_pages() -> list[list[tuple[str, int]]]:
    """Pages as runs of (html, label): the elements that begin in a run of label 1, and only those, are content.

    Article parts vary in container, headings, lists, quotes, tables and unclosed tags; the parts around them hold
    menus, headers, footers, sidebars, notices, adverts, forms and reader comments under their usual tags and names; some stand inside the article.
    """
    links = lambda n: "".join(f'<li><a href="/{i}">{_WORDS[i]}</a></li>' for i in range(n))
    menus = [f"<nav><ul>{links(6)}</ul></nav>", f'<div class="menu"><ul>{links(9)}</ul></div>', f'<header class="site-header"><h2>Daily</h2><ul>{links(4)}</ul></header>', f'<div id="navbar"><a href="/">Home</a> <a href="/b">News</a></div><header><p>{_prose(6)}</p></header>']
    extras = [
        f'<div class="ad">{_prose(9)}</div>', f'<div class="cookie-notice"><p>{_prose(14)}</p><button>Accept</button></div>', f'<aside><h3>Related</h3><ul>{links(5)}</ul><p>{_prose(12)}</p></aside>',
        f'<div class="sidebar"><h3>More</h3><p>{_prose(20)}</p></div>', _FORM, f'<div class="newsletter"><p>{_prose(10)}</p>{_FORM}</div>', f'<div class="banner sponsored"><p>{_prose(16)}</p></div>', f'<div class="share"><a href="#">Share</a></div>',
    ]
    ends = [
        f"<footer>&copy; Site &middot; {_prose(5)}</footer>", f'<section class="comments"><h3>Comments</h3><p>{_prose(30)}</p><p>{_prose(8, 3)}</p></section><footer><p>{_prose(7)}</p></footer>',
        f'<div id="comments"><div class="comment"><p>{_prose(25)}</p></div></div><div class="footer">{_prose(6)}</div>', f'<div class="related-posts"><ul>{links(4)}</ul></div><footer><ul>{links(3)}</ul></footer>',
    ]
    bodies = [
        f"<h1>{_prose(5)}</h1><p>{_prose(60)}</p><p>{_prose(12, 2)}</p>", f"<h1>{_prose(3)}</h1><p><b>{_prose(8)}<br><p>{_prose(90, 5)}</p><p>{_prose(3)}</p>", f"<h1>{_prose(4)}</h1><p>{_prose(40)}</p><h2>{_prose(2)}</h2><ul><li>{_prose(6)}</li><li>{_prose(9)}</li></ul>",
        f"<p>{_prose(25)}</p><blockquote><p>{_prose(15, 4)}</p></blockquote><div>{_prose(30)}</div>", f"<h2>{_prose(4)}</h2><table><tr><td>{_prose(2)}</td><td>{_prose(3)}</td></tr></table><p>{_prose(35)}</p><p>{_prose(1)}</p>", f"<h1>{_prose(2)}</h1><p>{_prose(2)}</p><figure><figcaption>{_prose(6)}</figcaption></figure>",
        f"<h1>{_prose(8)}</h1>" + f"<p>{_prose(2)}</p><p><b>{_prose(1)}<br>" * 25,
    ]
    frames = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post-body">', "</div>"), ('<section class="story">', "</section>"), ("<main><article>", "</article></main>"), ('<div class="article-text"><div>', "</div></div>")]
    head = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>1</script></head><body>"
    pages = []
    for i in range(196):
        (a, b), body = frames[i % len(frames)], bodies[(i + i // 7) % len(bodies)]
        before = head + menus[i % len(menus)] + extras[i % len(extras)] * (i % 3 > 0)
        after = extras[(i // 3 + 3) % len(extras)] * (i % 2) + ends[(i // 2) % len(ends)] + "</body></html>" * (i % 5 > 0)
        inside = extras[(i // 5) % len(extras)] * (i % 4 == 3)
        pages.append([(before, 0), (a + body, 1), (inside, 0), (f"<p>{_prose(20 + i % 30, 1)}</p>" * (i % 4 > 1) + b, 1), (after, 0)])
    return pages


class ContentModel:
    """Feature weights (towards content) and the potential of each (parent, child) pair."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.pair = [[0.0, 0.0], [0.0, 0.0]]

    def unaries(self, rows: list[list[str]]) -> list[float]:
        get = self.weight.get
        return [sum(get(f, 0.0) for f in row) for row in rows]

    def marginals(self, parent: list[int], unary: list[float], expect: bool = False) -> tuple[list[float], list[list[float]]]:
        """(P(content) of each element, expected numbers of (parent, child) states if asked for)."""
        n = len(parent)
        e = [[exp(x) for x in row] for row in self.pair]
        # log odds; a message is the log ratio of what it says of state 1 and state 0
        inner, up, down = unary[:], [0.0] * n, [0.0] * n
        ratio = lambda odds, a, b: _log_mix(odds, a[0], a[1]) - _log_mix(odds, b[0], b[1])
        for i in range(n - 1, 0, -1):
            up[i] = ratio(inner[i], e[1], e[0])
            inner[parent[i]] += up[i]
        column = [[e[0][0], e[1][0]], [e[0][1], e[1][1]]]
        total = [[0.0, 0.0], [0.0, 0.0]]
        full = inner[:]
        for i in range(1, n):
            rest = full[parent[i]] - up[i]
            down[i] = ratio(rest, column[1], column[0])
            full[i] = inner[i] + down[i]
            if expect:
                q = [[e[0][0], e[0][1]], [e[1][0], e[1][1]]]
                p1, c1 = _sigmoid(rest), _sigmoid(inner[i])
                q = [[q[a][b] * (p1 if a else 1 - p1) * (c1 if b else 1 - c1) for b in (0, 1)] for a in (0, 1)]
                s = sum(map(sum, q))
                for a in (0, 1):
                    for b in (0, 1):
                        total[a][b] += q[a][b] / s
        return [_sigmoid(x) for x in full], total

    def fit(self, pages: list[tuple[list[int], list[list[str]], list[int]]], rounds: int = 60, l2: float = 0.05, rate: float = 0.25) -> ContentModel:
        """Adam on the likelihood of the labels of (parents, features, labels) pages."""
        names = sorted({f for _, rows, _ in pages for row in rows for f in row})
        number = {f: i for i, f in enumerate(names)}
        seen = np.zeros(len(names) + 4)
        for parent, rows, label in pages:
            for i, row in enumerate(rows):
                for f in row:
                    seen[number[f]] += label[i]
                if i:
                    seen[len(names) + 2 * label[parent[i]] + label[i]] += 1
        theta, m, v = np.zeros_like(seen), np.zeros_like(seen), np.zeros_like(seen)
        for t in range(1, rounds + 1):
            self.weight, self.pair = dict(zip(names, theta.tolist())), theta[len(names) :].reshape(2, 2).tolist()
            grad = seen - l2 * theta
            for parent, rows, _ in pages:
                p, pairs = self.marginals(parent, self.unaries(rows), True)
                for i, row in enumerate(rows):
                    for f in row:
                        grad[number[f]] -= p[i]
                grad[len(names) :] -= np.array(pairs).ravel()
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.weight, self.pair = dict(zip(names, theta.tolist())), theta[len(names) :].reshape(2, 2).tolist()
        return self

    def text(self, html: str) -> str:
        page = Page(html)
        p, _ = self.marginals(page.parent, self.unaries(features(page)))
        return "\n".join(page.blocks([x >= 0.5 for x in p]))


def _sigmoid(x: float) -> float:
    return 1 / (1 + exp(-x)) if x > -700 else 0.0


def _log_mix(odds: float, a: float, b: float) -> float:
    """log(a + b * exp(odds)), but for a factor that _log_mix of the same odds shares."""
    return log(a + b * exp(odds)) if odds < 0 else log(a * exp(-odds) + b)


def labelled_tree(runs: list[tuple[str, int]]) -> tuple[list[int], list[list[str]], list[int]]:
    """Parents, features and labels of a labelled page's elements."""
    page, html, labels = Page("".join(x for x, _ in runs)), "", [0]
    for piece, label in runs:
        html += piece
        labels += [label] * (len(Page(html).tag) - len(labels))
    return page.parent, features(page), labels


@lru_cache(maxsize=1)
def default_model() -> ContentModel:
    return ContentModel().fit([labelled_tree(p) for p in labelled_pages()])


def extracted(df: DataFrame, model: ContentModel | None = None, html: str = "html") -> DataFrame:
    """df's other columns and text: the main text of each page, its blocks joined by \\n.

    Null and empty pages, and pages without content, have the text ''. Pages count whole, whatever their length and
    however they end; rows that repeat give equal texts. A column named text is replaced.
    """
    model = model or default_model()
    names = [c for c in df.columns if c not in (html, "text")]
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html):
                texts = [model.text(h) if h else "" for h in part.column(html).to_pylist()]
                yield pa.record_batch([*(part.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "text"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in names)
    return df.select(*names, df[html].cast("string").alias(html)).mapInArrow(run, f"{fields}text string")
