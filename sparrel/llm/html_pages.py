"""Labelled pages to train on: layouts drawn at random, of which it is known what is main text."""

from __future__ import annotations

import random

#: How pages call their parts.
MAIN = ["", "content", "post", "entry-content", "article-body", "story", "main-content", "post-body", "text"]
OTHER = {
    "menu": ("nav", ["", "menu", "navbar", "main-nav", "breadcrumb", "topnav", "navigation", "toc"]),
    "header": ("header", ["", "site-header", "masthead", "top", "page-header", "branding"]),
    "footer": ("footer", ["", "footer", "site-footer", "bottom", "copyright", "page-footer"]),
    "sidebar": ("aside", ["", "sidebar", "widget", "rail", "right-column", "side", "related", "popular"]),
    "notice": ("div", ["notice", "cookie-banner", "cookie", "consent", "alert", "gdpr-notice", "banner", "privacy", "message", "popup"]),
    "advert": ("div", ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "sponsor", "adsbygoogle"]),
    "form": ("form", ["", "subscribe", "newsletter", "search", "login", "contact-form", "signup"]),
    "comments": ("section", ["comments", "comment-list", "disqus", "responses", "discussion", "reader-comments", "replies", "comment-thread"]),
    "share": ("div", ["share", "social", "share-buttons", "tags", "meta", "related-posts", "author-box", "pagination"]),
}
_SYLLABLES = "an ber co del en fi gor hal in jo ka lem mi no or pa qui ra sen to un ver wi xa yo zu ch tion ment".split()


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[tuple[str, int]] = []
        self.html: list[str] = []

    def words(self, low: int, high: int) -> str:
        r = self.r
        words = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        text, start = [], True
        for w in words:
            text.append(w.capitalize() if start else w)
            start = r.random() < 0.08
            if start:
                text[-1] += r.choice([".", ".", ".", "?", "!"])
        return " ".join(text) + r.choice([".", ".", ".", ""])

    def tag(self, name: str, classes: str = "") -> str:
        r = self.r
        if not classes:
            return f"<{name}>"
        key = r.choice(["class", "class", "class", "id"])
        return f'<{name} {key}="{classes}">'

    def block(self, tag: str, text: str, label: int) -> None:
        """A block of text, with inline tags and end tags or without them."""
        r = self.r
        shown = text
        if r.random() < 0.15:
            k = text.find(" ")
            shown = f"<b>{text[:k]}</b>{text[k:]}" if k > 0 else f"<b>{text}"
        elif r.random() < 0.1:
            shown = f"<b>{text}<br>" if r.random() < 0.5 else text.replace(" ", ' <a href="/x">', 1) + "</a>"
        self.html.append(f"<{tag}>{shown}" + ("" if tag == "p" and r.random() < 0.15 else f"</{tag}>"))
        self.out.append((text, label))

    def prose(self, label: int, low: int, high: int, paragraphs: int) -> None:
        r = self.r
        for _ in range(paragraphs):
            kind = r.random()
            if kind < 0.08:
                self.block(r.choice(["h2", "h3"]), self.words(2, 6), label)
            elif kind < 0.14:
                self.html.append("<ul>")
                for _ in range(r.randint(2, 4)):
                    self.block("li", self.words(3, 14), label)
                self.html.append("</ul>")
            elif kind < 0.18:
                self.html.append("<blockquote>")
                self.block("p", self.words(low, high), label)
                self.html.append("</blockquote>")
            else:
                short = r.random() < 0.12
                self.block("p", self.words(1, 4) if short else self.words(low, high), label)

    def other(self, kind: str) -> None:
        """A part that isn't main text."""
        r = self.r
        tag, names = OTHER[kind]
        name = r.choice(names)
        if name and r.random() < 0.5:
            tag = r.choice(["div", "section", tag])
        self.html.append(self.tag(tag, name))
        if kind in ("menu", "share") or kind in ("footer", "sidebar") and r.random() < 0.5:
            listed = r.random() < 0.7
            if kind == "sidebar":
                self.block("h3", self.words(1, 3), 0)
            self.html.append("<ul>" if listed else "<div>")
            for _ in range(r.randint(2, 8)):
                text = self.words(1, 4).rstrip(".?!")
                self.html.append(f'<li><a href="/{r.random()}">{text}</a></li>' if listed else f'<p><a href="/x">{text}</a></p>')
                self.out.append((text, 0))
            self.html.append("</ul>" if listed else "</div>")
        elif kind == "comments":
            self.block("h3", self.words(1, 3), 0)
            for _ in range(r.randint(1, 6)):
                self.html.append(self.tag("div", r.choice(["comment", "reply", "", "comment-body"])))
                self.prose(0, 4, 50, r.randint(1, 2))
                self.html.append("</div>")
        elif kind == "form":
            self.block("label", self.words(1, 4), 0) if r.random() < 0.3 else self.block("p", self.words(2, 14), 0)
            self.html.append('<input type="text"><button>')
            text = self.words(1, 2)
            self.html.append(text + "</button>")
            self.out.append((text, 0))
        elif kind == "header" and r.random() < 0.6:
            self.block(r.choice(["h1", "h2", "div", "p"]), self.words(1, 5), 0)
            if r.random() < 0.5:
                self.other("menu")
        elif r.random() < 0.5:
            text = ("© " if kind == "footer" else "") + self.words(3, 25)
            self.html.append(text)
            self.out.append((text, 0))
        else:
            self.prose(0, 3, 40, r.randint(1, 2))
        self.html.append(f"</{tag}>")

    def main(self) -> None:
        r = self.r
        name = r.choice(MAIN)
        tag = "article" if r.random() < 0.6 else r.choice(["main", "div", "section"])
        if tag != "article" and not name:
            name = r.choice(MAIN[1:])
        wrap = r.random() < 0.3
        if wrap:
            self.html.append(self.tag(r.choice(["main", "div"]), r.choice(["", "page", "wrapper", "container", "content"])))
        if r.random() < 0.2:
            self.other(r.choice(["menu", "share"]))
        self.html.append(self.tag(tag, name))
        if r.random() < 0.85:
            self.block(r.choice(["h1", "h1", "h2"]), self.words(2, 10), 1)
        for _ in range(r.choice([1, 1, 2, 3])):
            self.prose(1, 6, 70, r.randint(1, 6))
            if r.random() < 0.3:
                self.other(r.choice(["advert", "share", "sidebar", "form", "notice"]))
        if r.random() < 0.2:
            self.other("comments")
        self.html.append(f"</{tag}>")
        if wrap:
            self.html.append("</div>" if r.random() < 0.5 else "</main>")

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        r = self.r
        self.html.append('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>t</title><style>p{margin:0}</style></head><body>')
        wrap = r.random() < 0.3
        if wrap:
            self.html.append(self.tag("div", r.choice(["page", "wrapper", "container", ""])))
        for kind, chance in (("notice", 0.3), ("header", 0.5), ("menu", 0.7), ("advert", 0.5), ("sidebar", 0.2)):
            if r.random() < chance:
                self.other(kind)
        self.main()
        for kind, chance in (("share", 0.3), ("comments", 0.4), ("form", 0.3), ("sidebar", 0.4), ("advert", 0.3), ("notice", 0.2), ("footer", 0.85)):
            if r.random() < chance:
                self.other(kind)
        if wrap:
            self.html.append("</div>")
        self.html.append("</body></html>")
        return "".join(self.html), self.out


def labelled_page(seed: int) -> tuple[str, list[tuple[str, int]]]:
    """A page, and (text, 1 if main text else 0) of its blocks in order."""
    return _Page(seed).page()
