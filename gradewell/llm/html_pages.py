"""Invented pages whose blocks are labelled by construction, to train the block labeller on."""

from __future__ import annotations

import html
import random

#: Name parts that sites use for each kind of part.
NAMES = {
    "menu": "nav navbar menu navigation topnav mainmenu breadcrumb breadcrumbs links toc pagination pager tabs".split(),
    "header": "header masthead banner top branding logo site topbar".split(),
    "footer": "footer bottom copyright colophon legal foot credits".split(),
    "sidebar": "sidebar aside related widget rail secondary popular recent tags side trending recommended".split(),
    "notice": "cookie cookies consent notice gdpr popup modal alert banner privacy subscribe newsletter overlay".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promoted adslot banner".split(),
    "form": "form search login signup subscribe contact newsletter input field".split(),
    "comments": "comments comment replies reply discussion disqus respond thread commentlist".split(),
    "content": "article content post entry main story body text page article-body".split(),
}
_TAGS = {
    "menu": ["nav", "nav", "div", "ul", "header"],
    "header": ["header", "header", "div"],
    "footer": ["footer", "footer", "div", "section"],
    "sidebar": ["aside", "aside", "div", "section"],
    "notice": ["div", "div", "section", "dialog", "aside"],
    "advert": ["div", "div", "aside", "section"],
    "form": ["form", "form", "div"],
    "comments": ["section", "div", "ol", "ul"],
}
#: Elements whose text is shown only where something else can't be.
FALLBACKS = ["noscript", "noscript", "iframe", "object", "svg", "canvas", "video", "audio", "template"]
#: Kinds whose bare tag says what they are; the others always carry a name.
_BARE = {"nav", "header", "footer", "aside", "form"}
_SYLLABLES = "an be ci do er fa go hi in jo ka le mi no on pe ri sa ti un va we xo ya ze th st ou re en".split()


class PageMaker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r, out = self.r, []
        for _ in range(r.randint(low, high)):
            w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
            out.append(w + r.choice(["", "", "", "", "", ",", "."]))
        text = " ".join(out)
        return (text[:1].upper() + text[1:]).rstrip(",.") + r.choice([".", ".", ""])

    def inline(self, text: str) -> str:
        """The text with stray inline markup, as pages have it; links only here and there."""
        r, words = self.r, text.split(" ")
        out = []
        for w in words:
            w = html.escape(w)
            x = r.random()
            out.append(f"<b>{w}</b>" if x < 0.01 else f'<a href="/{r.randint(1, 99)}">{w}</a>' if x < 0.02 else f"<b>{w}" if x < 0.025 else f"{w}<br>" if x < 0.035 else w)
        return " ".join(out)

    def opened(self, kind: str, tag: str) -> str:
        r = self.r
        named = tag not in _BARE or r.random() < 0.5
        parts = []
        if named:
            parts.append(r.choice(NAMES[kind]))
            if r.random() < 0.4:
                parts.append(r.choice([r.choice(NAMES[kind]), "wrap", "box", "inner", "block", "container", self.r.choice(_SYLLABLES) + self.r.choice(_SYLLABLES)]))
        if not parts:
            return f"<{tag}>"
        return f'<{tag} {r.choice(["class", "class", "id"])}="{r.choice(["-", " ", "_"]).join(parts)}">'

    def boilerplate(self, kind: str) -> str:
        r, tag = self.r, self.r.choice(_TAGS[kind])
        out = [self.opened(kind, tag)]
        for _ in range(r.choice([1, 1, 1, 2, 3])):
            if kind == "menu" or (kind in ("sidebar", "footer", "header") and r.random() < 0.4):
                items = [f'<a href="/x">{html.escape(self.words(1, 3))}</a>' for _ in range(r.randint(2, 8))]
                item = "li" if tag in ("ul", "ol") else r.choice(["li", "li", "div", "p"])
                body = "".join(f"<{item}>{x}" + (f"</{item}>" if r.random() < 0.9 else "") for x in items)
                out.append(body if tag in ("ul", "ol") or item != "li" else f"<ul>{body}</ul>")
            elif kind == "form":
                out.append(f"<label>{self.words(1, 3)}</label><input name='q'><button>{self.words(1, 2)}</button>")
            elif kind == "comments":
                item = "li" if tag in ("ul", "ol") else r.choice(["div", "p", "article", "div"])
                out += [f"<{item}{r.choice(['', ' class=comment', ' class=reply'])}>{f'<p>{self.inline(self.words(3, 60))}</p>' if r.random() < 0.6 else self.inline(self.words(3, 60))}</{item}>" for _ in range(r.randint(1, 4))]
            else:
                lead = "&copy; " + self.words(1, 2) + " &middot; " if kind == "footer" and r.random() < 0.6 else ""
                text = lead + self.inline(self.words(1, 45))
                wrap = r.choice(["", "", "p", "div", "h3"])
                out.append(f"<{wrap}>{text}</{wrap}>" if wrap else text)
        out.append(f"</{tag}>")
        return "".join(out)

    def fallback(self) -> str:
        tag = self.r.choice(FALLBACKS)
        inner = "title" if tag == "svg" else self.r.choice(["", "", "p", "div"])
        text = self.words(1, 20)
        return f"<{tag}>" + (f"<{inner}>{text}</{inner}>" if inner else text) + f"</{tag}>"

    def article(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.55:
            head, tail = "<article>" if r.random() < 0.6 else self.opened("content", "article"), "</article>"
        elif kind < 0.7:
            head, tail = "<main>", "</main>"
        else:
            tag = r.choice(["div", "section", "main"])
            head, tail = self.opened("content", tag).replace("<main>", "<main class=content>"), f"</{tag}>"
        out = [head]
        if r.random() < 0.8:
            h = f"<h1>{html.escape(self.words(2, 12))}</h1>"
            out.append(f"<header>{h}</header>" if r.random() < 0.1 else h)
        for _ in range(r.choice([1, 2, 3, 4, 6, 8, 12, 20])):
            x = r.random()
            if x < 0.82:
                out.append(f"<p>{self.inline(self.words(1, r.choice([4, 30, 120])))}" + ("</p>" if r.random() < 0.9 else ""))
            elif x < 0.88:
                out.append(f"<{(h := r.choice(['h2', 'h3']))}>{self.words(1, 6)}</{h}>")
            elif x < 0.93:
                out.append("<ul>" + "".join(f"<li>{self.inline(self.words(1, 25))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif x < 0.95:
                out.append(f"<blockquote>{self.inline(self.words(3, 30))}</blockquote>")
            elif x < 0.965:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif x < 0.975:
                out.append(f"<pre>{html.escape(self.words(3, 12))}</pre>")
            elif x < 0.985:
                out.append(f"<figure><figcaption>{self.words(2, 12)}</figcaption></figure>")
            elif x < 0.99:
                out.append("\x02" + self.fallback() + "\x03")
            else:
                out.append("\x02" + self.boilerplate(r.choice(["advert", "advert", "sidebar", "form", "notice"])) + "\x03")
        return "".join([*out, tail])

    def page(self) -> str:
        """HTML in which the main text stands between \\x01 and \\x04, and boilerplate inside it between \\x02 and \\x03."""
        r = self.r
        before = [self.boilerplate(k) for k in ("notice", "header", "menu", "advert", "form", "sidebar") if r.random() < 0.45]
        after = [self.boilerplate(k) for k in ("comments", "advert", "sidebar", "menu", "form", "footer", "notice") if r.random() < 0.45]
        before += [self.fallback() for _ in range(2) if r.random() < 0.15]
        r.shuffle(before)
        if r.random() < 0.5:
            r.shuffle(after)
        middle = "\x01" + self.article() + "\x04"
        if r.random() < 0.3:
            wrap = r.choice(['<div id="page">', "<div>", '<div class="wrapper">', '<div class="container">'])
            middle = wrap + middle + "</div>" if r.random() < 0.5 else wrap + "".join([*before, middle, *after]) + "</div>"
            if "\x01" in middle and before and middle.count(before[0]):
                before, after = [], []
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 10)}</title><style>p{{}}</style></head><body>" + "".join([*before, middle, *after]) + r.choice(["</body></html>", ""])
