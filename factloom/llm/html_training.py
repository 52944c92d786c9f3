"""Labelled pages to train the extraction model on: a seeded generator of many page layouts.

Each element with a ``data-label`` is content (c), boilerplate (b) or a wrapper (w); others have their parent's
label. Words are invented, so that the model learns structure and not a language.
"""

from __future__ import annotations

import random

# Words that sites use in class and id attributes.
MENU = "nav menu navbar navigation topnav mainmenu breadcrumb breadcrumbs links skip pagination pager tabs".split()
HEADER = "header masthead site-header logo brand top topbar branding page-header".split()
FOOTER = "footer site-footer copyright colophon bottom legal credits page-footer".split()
SIDE = "sidebar side aside widget related popular trending recommended more-stories widget-area rail archive tags toc".split()
NOTICE = "cookie consent notice banner alert popup modal overlay gdpr paywall disclaimer newsletter message toast".split()
ADVERT = "ad ads advert advertisement sponsor sponsored promo promotion adsense banner-ad ad-slot dfp outbrain".split()
FORM = "form search login subscribe signup contact-form search-form newsletter-form".split()
SHARE = "share social sharing follow buttons social-links tools print byline-tools".split()
COMMENT = "comments comment comment-list discussion replies reply responses disqus respond comment-body commentlist thread".split()
CONTENT = "article post content main story entry article-body post-content entry-content story-body text body-text main-content hentry page-content".split()
WRAPPER = "wrapper container page site outer row layout grid wrap root app col inner".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int, stop: bool = True) -> str:
        r = self.r
        out = []
        for _ in range(r.randint(low, high)):
            out.append("".join(r.choice("bcdfghjklmnprstvwzéäñç") + r.choice("aeiouyü") for _ in range(r.randint(1, 4))) + ("," if r.random() < 0.06 else "." if r.random() < 0.08 else ""))
        text = " ".join(out).capitalize()
        return text + "." if stop and r.random() < 0.85 else text

    def attribute(self, names: list[str], always: bool = False) -> str:
        r = self.r
        if not always and r.random() < 0.25:
            return ""
        chosen = r.sample(names, min(len(names), r.randint(1, 2)))
        return f' {r.choice(["class", "class", "class", "id"])}="{" ".join(chosen)}"'

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/x">{self.words(1, 4, False)}</a>' for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice([" | ", " ", "\n"]).join(items)

    def element(self, label: str, tags: list[tuple[str, float]], names: list[str], body: str) -> str:
        tag = self.r.choices([t for t, _ in tags], [w for _, w in tags])[0]
        needs = tag in ("div", "section", "p", "ul") and label == "b"
        return f'<{tag} data-label="{label}"{self.attribute(names, needs)}>{body}</{tag}>'

    def paragraphs(self, low: int, high: int) -> str:
        r, out = self.r, []
        for k in range(r.randint(low, high)):
            kind = r.random()
            body = self.words(*r.choice([(1, 4), (4, 20), (20, 90), (60, 200)]))
            if r.random() < 0.15:
                body = f'{body} <a href="/y">{self.words(1, 3, False)}</a> {self.words(2, 20)}'
            if r.random() < 0.1:
                body = f"<b>{self.words(2, 6)}</b> {body}"
            if kind < 0.68:
                out.append(f"<p>{body}</p>" if r.random() < 0.8 else f"<p><b>{body}<br>")
            elif kind < 0.74:
                out.append(f"<h2>{self.words(1, 8, False)}</h2>")
            elif kind < 0.79:
                out.append("<ul>" + "".join(f"<li>{self.words(2, 15)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.83:
                out.append(f"<blockquote><p>{body}</p></blockquote>")
            elif kind < 0.86:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 5, False)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif kind < 0.89:
                out.append(f"<pre>{body}</pre>")
            elif kind < 0.92:
                out.append(f'<figure><img src="a.png"><figcaption>{self.words(3, 12)}</figcaption></figure>')
            elif kind < 0.96:
                out.append(f"<div>{body}</div>")
            else:
                out.append(f"<p>{self.words(2, 5)}</p>")
            if k and r.random() < 0.06:
                out.append(r.choice([self.advert, self.share, self.form, self.side])())
        return "".join(out)

    def menu(self) -> str:
        return self.element("b", [("nav", 5), ("div", 3), ("ul", 1)], MENU, self.links(3, 9))

    def header(self) -> str:
        body = f"<h1>{self.words(1, 4, False)}</h1>" if self.r.random() < 0.4 else f'<a href="/">{self.words(1, 3, False)}</a><p>{self.words(2, 8)}</p>'
        if self.r.random() < 0.5:
            body += self.menu()
        return self.element("b", [("header", 4), ("div", 3)], HEADER, body)

    def footer(self) -> str:
        body = f"&copy; {self.words(1, 3, False)} &middot; {self.words(2, 16)}" + (self.links(2, 6) if self.r.random() < 0.5 else f"<p>{self.words(3, 30)}</p>" if self.r.random() < 0.4 else "")
        return self.element("b", [("footer", 5), ("div", 3)], FOOTER, body)

    def side(self) -> str:
        body = "".join(f"<h3>{self.words(1, 4, False)}</h3>" + (self.links(2, 6) if self.r.random() < 0.6 else f"<p>{self.words(5, 50)}</p>") for _ in range(self.r.randint(1, 3)))
        return self.element("b", [("aside", 5), ("div", 4), ("section", 1)], SIDE, body)

    def notice(self) -> str:
        body = f"<p>{self.words(5, 40)}</p>" if self.r.random() < 0.6 else self.words(5, 40)
        body += f"<button>{self.words(1, 2, False)}</button>" if self.r.random() < 0.6 else ""
        return self.element("b", [("div", 8), ("section", 1), ("aside", 1), ("p", 1)], NOTICE, body)

    def advert(self) -> str:
        body = self.words(3, 30) if self.r.random() < 0.6 else f'<a href="/ad">{self.words(3, 12)}</a><p>{self.words(3, 25)}</p>'
        return self.element("b", [("div", 8), ("aside", 1), ("ins", 1), ("section", 1)], ADVERT, body)

    def form(self) -> str:
        body = f'<label>{self.words(1, 4, False)}</label><input name="q"><button>{self.words(1, 2, False)}</button>' + (f"<p>{self.words(3, 20)}</p>" if self.r.random() < 0.4 else "")
        return self.element("b", [("form", 1)], FORM, body)

    def share(self) -> str:
        return self.element("b", [("div", 4), ("ul", 1)], SHARE, self.links(2, 5))

    def comments(self) -> str:
        one = lambda: self.element("b", [("div", 4), ("li", 3), ("article", 3)], COMMENT, f"<b>{self.words(1, 2, False)}</b><p>{self.words(3, 60)}</p>" + (f"<p>{self.words(3, 40)}</p>" if self.r.random() < 0.3 else ""))
        body = (f"<h3>{self.words(1, 3, False)}</h3>" if self.r.random() < 0.7 else "") + "".join(one() for _ in range(self.r.randint(1, 6)))
        return self.element("b", [("section", 4), ("div", 4), ("aside", 1), ("ol", 1)], COMMENT, body)

    def article(self) -> str:
        title = f"<h1>{self.words(2, 12)}</h1>" if self.r.random() < 0.85 else ""
        if title and self.r.random() < 0.15:
            title = f"<header>{title}<p>{self.words(2, 10)}</p></header>"
        body = title + self.paragraphs(1, 10)
        if self.r.random() < 0.15:
            body += self.comments()
        if self.r.random() < 0.35:
            body = f'<div data-label="c"{self.attribute(CONTENT)}>{body}</div>'
        kind = self.r.choices(["article", "main", "div", "section", "td"], [6, 2, 3, 1, 0.3])[0]
        label = f'<{kind} data-label="c"{self.attribute(CONTENT, kind in ("div", "section"))}>{body}</{kind}>'
        return f"<table><tr>{label}</tr></table>" if kind == "td" else label

    def page(self) -> str:
        r = self.r
        top = [x() for x, p in ((self.notice, 0.3), (self.header, 0.5), (self.menu, 0.75), (self.advert, 0.5), (self.form, 0.15)) if r.random() < p]
        r.shuffle(top)
        low = [x() for x, p in ((self.comments, 0.35), (self.share, 0.2), (self.side, 0.5), (self.advert, 0.25), (self.form, 0.15), (self.footer, 0.85), (self.notice, 0.15)) if r.random() < p]
        middle = self.article() if r.random() < 0.93 else f'<div data-label="w"{self.attribute(WRAPPER)}>' + "".join(f'<p data-label="c">{self.words(15, 90)}</p>' for _ in range(r.randint(2, 6))) + "</div>"
        for _ in range(r.choice([0, 0, 1, 2])):
            inside = [middle, *(low[:1] if r.random() < 0.4 and low else [])]
            low = low[1:] if len(inside) > 1 else low
            middle = f'<{(t := r.choice(["div", "div", "main", "section"]))} data-label="w"{self.attribute(WRAPPER)}>{"".join(inside)}</{t}>'
        return f'<!DOCTYPE html><html data-label="w"><head><title>{self.words(2, 9)}</title></head><body data-label="w">{"".join(top)}{middle}{"".join(low)}</body></html>'


def labelled_pages(many: int, seed: int = 7) -> list[str]:
    """``many`` different pages, the same ones on every machine."""
    return [_Maker(seed * 1_000_003 + k).page() for k in range(many)]
