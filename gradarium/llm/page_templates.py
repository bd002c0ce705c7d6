"""Pages made from random templates, with a known main text: the training data of the page classifier."""

from __future__ import annotations

import random

SYLLABLES = "ka lo mi ren tu sal ve dor ani pel qui zan eb or ist un gra fel ho wi ta".split()

NAMES = {
    "header": ["header", "site-header", "masthead", "top", "banner header", "topbar"],
    "nav": ["nav", "menu", "main-menu", "navbar", "navigation", "breadcrumbs"],
    "ad": ["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "banner-ad"],
    "notice": ["cookie-notice", "consent", "notice", "alert", "newsletter", "modal subscribe"],
    "sidebar": ["sidebar", "side", "widget-area", "rail", "related", "widgets"],
    "comments": ["comments", "comment-list", "discussion", "responses"],
    "footer": ["footer", "site-footer", "foot", "bottom", "copyright"],
    "share": ["share", "social", "share-bar", "tags"],
    "form": ["login", "search", "contact-form", "signup"],
    "content": ["content", "article", "post", "entry-content", "story", "article-body", "main-content", "text"],
}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.words = ["".join(self.r.choices(SYLLABLES, k=self.r.choice([1, 1, 2, 2, 3]))) for _ in range(400)]

    def prose(self, low: int, high: int) -> str:
        w = self.r.choices(self.words, k=self.r.randint(low, high))
        w[0] = w[0].capitalize()
        return " ".join(w)

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.prose(1, 22) + self.r.choice("....?!") for _ in range(self.r.randint(low, high)))

    def links(self, n: int) -> str:
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/{i}">{self.prose(1, 3)}</a></li>' for i in range(n)) + "</ul>"
        return " | ".join(f'<a href="/{i}">{self.prose(1, 2)}</a>' for i in range(n))

    def box(self, kind: str, tag: str | None, body: str, main: bool = False) -> str:
        """An element of its own tag (and, often, a telling name), or a div with a telling name."""
        own = tag if tag and self.r.random() < 0.6 else self.r.choice(["div", "div", "section"])
        named = own == "div" and not main or self.r.random() < 0.6
        if own == "section" and not main:
            named = True
        name = f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(NAMES[kind])}"' if named else ""
        return f'<{own}{name} data-main="{int(main)}">{body}</{own}>'

    def boilerplate(self, kind: str) -> str:
        r = self.r
        p = lambda a, b: f"<p>{self.sentences(a, b)}</p>" if r.random() < 0.6 else self.sentences(a, b)
        if kind == "header":
            return self.box("header", "header", f'<a href="/">{self.prose(1, 3)}</a>' + (p(1, 1) if r.random() < 0.5 else "") + (self.boilerplate("nav") if r.random() < 0.5 else ""))
        if kind == "nav":
            return self.box("nav", "nav", self.links(r.randint(3, 12)))
        if kind == "ad":
            return self.box("ad", None, p(1, 3))
        if kind == "notice":
            return self.box("notice", None, p(1, 2) + (f"<button>{self.prose(1, 2)}</button>" if r.random() < 0.6 else ""))
        if kind == "sidebar":
            return self.box("sidebar", "aside", "".join(f"<h3>{self.prose(1, 4)}</h3>" + (self.links(r.randint(3, 8)) if r.random() < 0.6 else p(1, 2)) for _ in range(r.randint(1, 4))))
        if kind == "comments":
            return self.box("comments", None, f"<h3>{self.prose(1, 3)}</h3>" + "".join(f'<div class="comment"><b>{self.prose(1, 2)}</b>{p(1, 4)}</div>' for _ in range(r.randint(1, 6))) + (self.boilerplate("form") if r.random() < 0.4 else ""))
        if kind == "share":
            return self.box("share", None, self.links(r.randint(2, 5)))
        if kind == "form":
            tag = "form" if r.random() < 0.8 else "div"
            name = f' class="{r.choice(NAMES["form"])}"' if tag == "div" or r.random() < 0.5 else ' action="/go"'
            return f'<{tag}{name} data-main="0">' + (p(1, 2) if r.random() < 0.6 else "") + f"<label>{self.prose(1, 3)}</label><input><button>{self.prose(1, 2)}</button></{tag}>"
        line = r.choice([f"&copy; {self.prose(1, 3)} &middot; {self.sentences(1, 2)}", f"<p>{self.sentences(1, 3)}</p>", f"{r.randint(1990, 2030)} {self.prose(1, 4)}", f"<div>{self.prose(2, 6)}</div><div>{self.prose(2, 6)}</div>"])
        return self.box("footer", "footer", line + (self.links(r.randint(2, 6)) if r.random() < 0.5 else ""))

    def article(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.85:
            head = f"<h1>{self.prose(3, 12)}</h1>"
            parts.append(f'<header data-main="1">{head}</header>' if r.random() < 0.1 else head)
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 14])):
            x = r.random()
            if x < 0.62:
                parts.append(f"<p>{self.sentences(1, r.choice([1, 2, 4, 8]))}" + r.choice(["</p>", "</p>", "</p>", ""]))
            elif x < 0.75:
                parts.append(f"<p><b>{self.sentences(1, 2)}<br>")
            elif x < 0.82:
                parts.append(f"<h2>{self.prose(2, 8)}</h2>")
            elif x < 0.86:
                parts.append("<ul>" + "".join(f"<li>{self.sentences(1, 1)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.9:
                parts.append(f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>")
            elif x < 0.905:
                parts.append(f"<figure><img src=a.png><figcaption>{self.sentences(1, 1)}</figcaption></figure>")
            elif x < 0.92:
                parts.append("<table>" + "".join(f"<tr><td>{self.prose(1, 3)}</td><td>{self.prose(1, 3)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif x < 0.95:
                parts.append(f"<div>{self.sentences(2, 5)}<br><br>{self.sentences(1, 5)}</div>")
            else:
                parts.append(f'<p>{self.sentences(1, 2)} <a href="/x">{self.prose(1, 4)}</a> {self.sentences(1, 3)}</p>')
        if not parts or r.random() < 0.1:
            parts.append(r.choice([f"<p><b>{self.sentences(1, 3)}<br>", f"<p>{self.sentences(1, 3)}</p>"]))
        for kind in ("ad", "share", "sidebar", "form", "notice", "comments"):
            if r.random() < 0.15:
                parts.insert(r.randint(1, len(parts)), self.boilerplate(kind))
        body = "".join(parts)
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            body = f"<div>{body}</div>"
        return self.box("content", r.choice(["article", "article", "main", None]), body, main=True)

    def page(self) -> str:
        r = self.r
        before = [k for k in ("notice", "header", "nav", "ad", "form") if r.random() < 0.5]
        after = [k for k in ("share", "comments", "sidebar", "ad", "nav", "form", "notice") if r.random() < 0.35]
        r.shuffle(before)
        parts = [*map(self.boilerplate, before), self.article(), *map(self.boilerplate, after)]
        body = "".join(parts)
        for _ in range(r.choice([0, 0, 1, 2])):
            body = f'<div{r.choice(["", f" class={chr(34)}wrap{chr(34)}", f" id={chr(34)}page{chr(34)}"])}>{body}</div>'
        if r.random() < 0.85:
            body += self.boilerplate("footer")
        return f"<!DOCTYPE html><html><head><title>{self.prose(2, 6)}</title>{r.choice(["<script>var a='</p>';</script>", "<script src=/a.js></script>", "<style>p { margin: 0 }</style>", ""])}</head><body>{body}</body></html>"
