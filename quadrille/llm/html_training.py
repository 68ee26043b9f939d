"""Pages with known labels, on which the classifier of ``html_extract`` is trained.

Every page has an article and other parts in one of several layouts: semantic tags, classes
with plain or compound names, or no names at all; with noisy classes, forms around the page,
tables, short paragraphs, adverts inside the article. Pages are made from a seed alone.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

_SYLLABLES = "an ber co da el fi go ha in jo ka lu mi no or pe qui ra su ti ul va we xo yr za".split()
_SEMANTIC = {"nav": "nav", "footer": "footer", "sidebar": "aside", "header": "header", "article": "article"}
_NAMES = {"nav": ("menu", "nav", "navigation"), "footer": ("footer", "foot"), "sidebar": ("sidebar", "side", "widget"), "header": ("header", "masthead", "banner"), "article": ("content", "article", "post", "entry", "story"), "ad": ("ad", "ads", "sponsored", "promo"), "notice": ("cookie", "notice", "consent", "popup"), "comments": ("comments", "disqus", "replies"), "related": ("related", "recommended"), "form": ("newsletter", "subscribe", "login"), "crumbs": ("breadcrumb", "breadcrumbs"), "share": ("share", "social")}
_TOPICS = "post tag-news no-comments|article has-sidebar|entry category-legal|content format-standard|post type-post|news|story with-ads|col-8|x1 y2||".split("|")


class _Page:
    def __init__(self, rng: random.Random, style: str):
        self.rng, self.style, self.label = rng, style, {}

    def words(self, lo: int, hi: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi)))

    def text(self, lo: int, hi: int, content: bool, end: str = ".") -> str:
        while True:
            t = self.words(lo, hi).capitalize() + end
            if t not in self.label:
                self.label[t] = content
                return t

    def known(self, t: str, content: bool) -> str:
        self.label[t] = content
        return t

    def part(self, kind: str, inner: str) -> str:
        """The inner markup in an element that shows its kind as the page's style does."""
        r, name = self.rng, self.rng.choice(_NAMES[kind])
        tag, attrs = "div", ""
        if self.style == "semantic":
            tag = _SEMANTIC.get(kind, "div")
            if kind == "article" and r.random() < 0.3:
                tag = "main"
            attrs = f" class='{r.choice(_TOPICS)}'" if kind == "article" else f' class="{name}"' if tag == "div" and r.random() < 0.9 else ""
        elif self.style == "names":
            attrs = f' {r.choice(("class", "id"))}="{name}"'
        elif self.style == "parts":
            attrs = f' class="{r.choice(("site", "page1", "my", "c"))}-{name}{r.choice(("", "-1", "-box"))}"'
        elif r.random() < 0.5:
            attrs = f' class="css-{r.randrange(10**6):x}"'
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def links(self, n: int) -> str:
        items = [f'<a href="/{k}">{self.text(1, 4, False, "")}</a>' for k in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.rng.random() < 0.8 else "".join(f"<div>{x}</div>" for x in items)

    def advert(self) -> str:
        r = self.rng
        t = self.text(4, 16, False) if r.random() < 0.8 else self.known(f"Advertisement {r.randrange(10**6)}", False)
        return self.part("ad", t if r.random() < 0.6 else f"<p>{t}</p>")

    def article(self) -> str:
        r, found = self.rng, []
        head = f"<h1>{self.text(3, 10, True, '')}</h1>"
        if self.style == "semantic" and r.random() < 0.3:
            head = f"<header>{head}<p>{self.text(3, 8, True, '')}</p></header>"
        for k in range(r.randint(1, 9)):
            x = r.random()
            if x < 0.7:
                t = self.text(1, 3, True) if r.random() < 0.2 else self.text(8, 90, True)
                found.append(f"<p>{t}</p>" if r.random() < 0.9 else f"<div>{t}</div>")
            elif x < 0.78:
                found.append(f"<h2>{self.text(2, 7, True, '')}</h2>")
            elif x < 0.86:
                found.append("<ul>" + "".join(f"<li>{self.text(2, 14, True, r.choice(('.', '')))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.9:
                found.append(f"<blockquote><p>{self.text(5, 40, True)}</p></blockquote>")
            elif x < 0.93:
                found.append("<table>" + "".join(f"<tr><td>{self.text(1, 3, True, '')}</td><td>{self.text(1, 3, True, '')}</td></tr>" for _ in range(3)) + "</table>")
            elif x < 0.96:
                found.append(f'<p>{self.text(9, 30, True)}<br>{self.text(9, 30, True)}</p>')
            elif k and self.style not in ("bare", "plain"):
                found.append(self.advert())
        return self.part("article", head + "".join(found))

    def comments(self) -> str:
        return self.part("comments", "".join(f"<div><b>{self.text(1, 2, False, '')}</b></div><p>{self.text(3, 40, False)}</p>" for _ in range(self.rng.randint(1, 8))))

    def html(self) -> str:
        r = self.rng
        if self.style == "plain":  # an article or a piece of one, and nothing else
            cut = lambda t: t if r.random() < 0.5 else f"<body>{t}"
            return cut(self.article() if r.random() < 0.5 else "".join(f"<p>{self.text(1, 30, True, r.choice(('.', '')))}</p>" for _ in range(r.randint(1, 4))))
        maybe = lambda p, make: make() if r.random() < p else ""
        top = maybe(0.5, lambda: self.part("header", f"<div>{self.text(1, 4, False, '')}</div><p>{self.text(3, 9, False, '')}</p>"))
        top += maybe(0.9, lambda: self.part("nav", self.links(r.randint(2, 9)))) + maybe(0.3, lambda: self.part("crumbs", f'<a href="/">{self.text(1, 2, False, "")}</a>'))
        top += maybe(0.4, lambda: self.part("notice", f"<p>We use cookies. {self.text_after('We use cookies. ', 5, 15)}</p>"))
        top += maybe(0.5 if self.style != "bare" else 0.1, self.advert)
        side = maybe(0.5, lambda: self.part("sidebar", self.links(r.randint(2, 6)) if r.random() < 0.6 else "".join(f"<p>{self.text(4, 15, False)}</p>" for _ in range(r.randint(1, 3)))))
        low = maybe(0.4, lambda: self.part("related", self.links(r.randint(2, 6)))) + (maybe(0.35, self.comments) if self.style != "bare" else "")
        low += maybe(0.3, lambda: self.part("share", f"<div>{self.known(f'Share this {r.randrange(10**6)}', False)}</div>"))
        low += maybe(0.3, lambda: self.part("form", f"<form><p>{self.text(3, 9, False)}</p><label>{self.text(1, 2, False, '')}</label><input name=q></form>"))
        rights = f"{r.choice(('©', 'Copyright'))} {r.randint(1990, 2030)} "
        end = maybe(0.9, lambda: self.part("footer", f"<p>{rights}{self.text_after(rights, 2, 9)}</p>" if r.random() < 0.7 else f"{self.text(4, 15, False)}"))
        middle = (side, self.article()) if r.random() < 0.3 else (self.article(), side)
        body = top + "".join(middle) + low + end
        for _ in range(r.randint(0, 2)):
            body = f"<div class='{r.choice(('wrap', 'container', 'page', 'has-sidebar', 'side-by-side', 'with-footer', 'header-fixed', ''))}'>{body}</div>"
        if r.random() < 0.1:
            body = f"<form action='/'>{body}</form>"
        return f"<html><head><title>{self.words(2, 5)}</title></head><body class='{r.choice(('', 'has-sidebar', 'home'))}'>{body}</body></html>"

    def text_after(self, start: str, lo: int, hi: int) -> str:
        t = self.words(lo, hi) + "."
        self.label[start + t] = False
        return t


def labelled_pages(n: int, seed: int = 1, styles: tuple[str, ...] = ("semantic", "names", "parts", "bare", "plain")) -> Iterator[tuple[str, dict[str, bool]]]:
    """(page, whether each text of it is content)."""
    rng = random.Random(seed)
    for k in range(n):
        page = _Page(rng, styles[k % len(styles)])
        yield page.html(), page.label
