"""Small labelled pages for the decision tree of the HTML extraction.

The pages are put together by a rule from kinds of regions and blocks, each with its
label, in the ways in which pages of news, blogs, manuals and forums are built. Only
numbers of words, links and the elements around matter to the tree; the words are
fillers.
"""

from __future__ import annotations

import random

FILLER = "a sample of plain words that stand for any text in some language with no meaning of their own at all".split()

# What surrounds an article: the opening tag, the end tag. Some hint at it, some do not.
WRAPPERS = (
    ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div id="content">', "</div>"), ('<section class="story">', "</section>"), ('<main><article class="entry">', "</article></main>"),
    ('<div id="main"><div class="entry-content">', "</div></div>"), ('<div role="main">', "</div>"), ("<table><tr><td>", "</td></tr></table>"), ("<div>", "</div>"), ("<div>", "</div>"), ('<div class="col-8"><div>', "</div></div>"), ("", ""),
    ('<div class="layout has-sidebar"><article>', "</article></div>"), ('<form id="aspnet"><div class="content">', "</div></form>"),
)
# Blocks of an article: tag, least and most words, share of linked words.
ARTICLE = (
    ("h1", 2, 14, 0.0), ("h2", 1, 9, 0.0), ("h3", 1, 8, 0.0), ("p", 25, 120, 0.03), ("p", 25, 120, 0.0), ("p", 12, 60, 0.1), ("p", 4, 14, 0.0), ("p", 1, 3, 0.0), ("li", 2, 30, 0.05), ("blockquote", 5, 50, 0.0),
    ("pre", 3, 60, 0.0), ("figcaption", 3, 18, 0.0), ("dd", 3, 30, 0.0), ("td", 1, 8, 0.0), ("p", 2, 12, 0.95), ("li", 2, 12, 1.0),
)
# Other regions: the opening tag, the end tag, the blocks' tag, least and most words of a block, least and most blocks, share of linked words, and whether such a region also stands inside an article.
OTHERS = (
    ("<nav><ul>", "</ul></nav>", "li", 1, 3, 3, 9, 1.0, False), ('<div class="menu">', "</div>", "div", 1, 3, 3, 8, 1.0, False), ("<ul>", "</ul>", "li", 1, 3, 4, 10, 1.0, False), ("<div>", "</div>", "div", 1, 4, 3, 8, 1.0, False),
    ("<header>", "</header>", "div", 1, 9, 1, 3, 0.3, False), ('<div id="header">', "</div>", "p", 2, 10, 1, 2, 0.2, False), ('<div class="breadcrumbs">', "</div>", "div", 2, 8, 1, 1, 0.8, True), ('<div class="site-banner">', "</div>", "p", 3, 25, 1, 2, 0.1, False),
    ("<footer>", "</footer>", "p", 3, 40, 1, 3, 0.1, False), ("<footer><ul>", "</ul></footer>", "li", 1, 4, 3, 8, 1.0, False), ('<div id="footer">', "</div>", "p", 4, 30, 1, 2, 0.3, False), ("<footer>", "</footer>", "p", 3, 20, 1, 2, 0.3, True),
    ("<aside>", "</aside>", "p", 5, 50, 1, 4, 0.3, True), ('<div class="sidebar">', "</div>", "p", 3, 40, 1, 5, 0.4, False), ('<div class="sidebar"><ul>', "</ul></div>", "li", 2, 9, 3, 8, 0.9, False), ('<div class="widget">', "</div>", "div", 2, 30, 1, 4, 0.4, False),
    ('<div class="cookie-notice">', "</div>", "p", 8, 60, 1, 2, 0.1, True), ('<div id="gdpr-consent">', "</div>", "p", 8, 60, 1, 3, 0.1, False), ('<section role="dialog">', "</section>", "p", 5, 40, 1, 2, 0.0, False), ('<div class="notice">', "</div>", "p", 4, 40, 1, 2, 0.05, True),
    ('<div class="ad">', "</div>", "p", 2, 60, 1, 2, 0.0, True), ('<div class="advert">', "</div>", "p", 2, 40, 1, 2, 0.5, True), ('<div class="sponsored-promo">', "</div>", "p", 3, 50, 1, 3, 0.2, True), ('<div id="ad-slot">', "</div>", "div", 1, 12, 1, 1, 0.0, True),
    ("<form>", "</form>", "p", 2, 25, 1, 4, 0.0, True), ('<form class="search">', "</form>", "div", 1, 4, 1, 2, 0.0, False), ('<div class="newsletter-signup">', "</div>", "p", 4, 35, 1, 3, 0.0, True), ('<div class="login-form">', "</div>", "div", 1, 6, 1, 3, 0.2, False),
    ('<section id="comments">', "</section>", "p", 2, 90, 1, 8, 0.02, True), ('<div class="comment-list"><div class="post-comment">', "</div></div>", "p", 2, 90, 1, 6, 0.02, True), ('<ol class="replies">', "</ol>", "li", 2, 80, 1, 6, 0.05, False), ('<div class="comments-body">', "</div>", "p", 3, 90, 1, 5, 0.0, True),
    ('<div class="related">', "</div>", "p", 3, 14, 2, 6, 1.0, True), ('<div class="related-posts"><ul>', "</ul></div>", "li", 3, 14, 2, 6, 1.0, True), ('<div class="share">', "</div>", "div", 1, 3, 1, 4, 0.9, True), ('<div class="tags">', "</div>", "div", 1, 2, 1, 5, 1.0, True),
    ('<div class="author-bio">', "</div>", "p", 5, 50, 1, 2, 0.1, True), ('<div class="pagination">', "</div>", "div", 1, 2, 2, 5, 1.0, False), ('<div style="display:none">', "</div>", "p", 2, 60, 1, 2, 0.0, True), ("<div>", "</div>", "p", 2, 9, 1, 1, 0.9, False),
    ("<div>", "</div>", "div", 1, 9, 1, 2, 0.0, False), ("<div>", "</div>", "span", 1, 12, 1, 1, 0.0, False), ("<td>", "</td>", "span", 1, 6, 1, 1, 0.0, False), ("<div>", "</div>", "div", 2, 12, 1, 3, 0.3, False), ("<td>", "</td>", "div", 1, 6, 2, 6, 1.0, False), ("<p>", "</p>", "span", 2, 10, 1, 1, 0.4, False),
    ('<div class="ad"><div class="content">', "</div></div>", "p", 2, 60, 1, 2, 0.05, True), ('<div id="cookie-banner"><div class="text">', "</div></div>", "p", 8, 60, 1, 2, 0.05, False), ('<ol class="commentlist"><li class="entry">', "</li></ol>", "p", 2, 80, 1, 3, 0.02, False),
    ('<section id="comments"><article>', "</article></section>", "p", 2, 90, 1, 4, 0.02, False), ('<div class="discussion"><div class="text">', "</div></div>", "p", 2, 70, 1, 4, 0.02, False),
)


def _words(rng: random.Random, n: int, linked: float) -> str:
    words = [rng.choice(FILLER) for _ in range(n)]
    k = round(n * linked + rng.random() - 0.5) if linked < 1 else n
    if k > 0:
        at = rng.randrange(n - min(k, n) + 1)
        words[at] = '<a href="#">' + words[at]
        words[min(at + k, n) - 1] += "</a>"
    return " ".join(words)


def _block(rng: random.Random, tag: str, least: int, most: int, linked: float) -> str:
    return f"<{tag}>{_words(rng, rng.randint(least, most), linked)}</{tag}>"


def _other(rng: random.Random, inside: bool) -> tuple[str, list[bool]]:
    begin, end, tag, least, most, few, many, linked, also_inside = rng.choice([o for o in OTHERS if o[-1]] if inside else OTHERS)
    n = rng.randint(few, many)
    return begin + "".join(_block(rng, tag, least, most, linked) for _ in range(n)) + end, [False] * n


def _article(rng: random.Random) -> tuple[str, list[bool]]:
    begin, end = rng.choice(WRAPPERS)
    told = any(w in begin for w in ("article", "main", "content", "story"))
    # Where nothing tells that an article begins, a linked block or a cell may as well be a menu's.
    kinds = [k for k in ARTICLE if told or k[3] < 0.5 and k[0] not in ("td", "dd", "li")]
    out, marks = [begin], []
    if rng.random() < 0.85:
        title = _block(rng, *ARTICLE[0])
        headed = told and "article" in begin and rng.random() < 0.3
        out.append(f"<header>{title}</header>" if headed else title)
        marks.append(True)
    weights = [4 if k[0] == "p" else 1 for k in kinds]
    for _ in range(rng.choice((1, 2, 3, 5, 8, 13, 20))):
        kind = rng.choices(kinds, weights)[0]
        n = rng.randint(2, 6) if kind[0] in ("li", "dd", "td") else 1
        around = {"li": ("<ul>", "</ul>"), "dd": ("<dl>", "</dl>"), "td": ("<table><tr>", "</tr></table>"), "figcaption": ("<figure>", "</figure>")}.get(kind[0], ("", ""))
        out.append(around[0] + "".join(_block(rng, *kind) for _ in range(n)) + around[1])
        marks += [True] * n
        if told and rng.random() < 0.12:
            text, own = _other(rng, True)
            out.append(text)
            marks += own
    return "".join(out) + end, marks


def labelled_pages(n: int, seed: int = 12) -> list[tuple[str, list[bool]]]:
    """``n`` pages with a mark for each of their text blocks in order: whether it is part of the article."""
    rng, pages = random.Random(seed), []
    for _ in range(n):
        before, after = ([_other(rng, False) for _ in range(rng.randint(0, 4))] for _ in range(2))
        parts = [*before, *([_article(rng)] if rng.random() < 0.97 else []), *after]
        head = "<!DOCTYPE html><html><head><title>sample</title><style>p{}</style><script>var a='<p>';</script></head><body>"
        pages.append((head + "".join(p for p, _ in parts) + "</body></html>", [m for _, marks in parts for m in marks]))
    return pages
