"""Labelled pages in many layouts, made for training the block labeller.

A page is a random order of parts; each part writes its markup and tells, leaf by leaf, which
text is of the article. Names of classes and ids vary, and some pages have none that tell.
"""

from __future__ import annotations

import numpy as np

#: Names that pages give to their parts (fixed values).
NAMES = {
    "main": "article post content entry story text article-body post-content entry-content main-content story-body page-content articleBody richtext",
    "nav": "nav menu navigation navbar main-menu topnav site-nav breadcrumb breadcrumbs pagination pager toc sitenav",
    "header": "header site-header masthead banner topbar branding logo page-header",
    "footer": "footer site-footer colophon copyright legal bottom page-footer footer-links",
    "sidebar": "sidebar aside widget related related-posts recommended more-stories secondary trending rail most-read",
    "notice": "cookie cookie-banner consent gdpr notice alert disclaimer popup modal paywall cookie-notice privacy",
    "ad": "ad ads advert advertisement sponsored sponsor promo banner-ad ad-slot dfp adsbygoogle partner promotion",
    "form": "form newsletter subscribe signup login search searchbox contact-form register",
    "share": "share social sharing share-buttons social-links follow tags meta byline toolbar",
    "comments": "comments comment comment-list commentlist replies disqus responses discussion comment-body user-comments",
}
#: Words that such parts use in four languages (fixed values).
SAID = {
    "nav": "Home|About|News|Sport|Contact|World|Start|Über uns|Kontakt|Accueil|À propos|Inicio|Noticias|Next|Previous|Page 2|Archive",
    "header": "Daily News|The Journal|Independent since 1901|Magazin|Le Journal|El Diario|Sign in|Menu",
    "footer": "© 2024 All rights reserved|Privacy policy|Terms of use|Imprint|Impressum|Datenschutz|Mentions légales|Aviso legal|© example.com · contact",
    "sidebar": "Related articles|Most read|More from this author|Trending|Das könnte Sie interessieren|À lire aussi|Lo más leído",
    "notice": "We use cookies to improve this site.|By continuing you accept our cookies.|Wir verwenden Cookies.|Nous utilisons des cookies.|Usamos cookies.|Please disable your ad blocker.",
    "ad": "Advertisement|Sponsored content|Buy now and save|Special offer|Anzeige|Publicité|Publicidad|Learn more",
    "form": "Subscribe to our newsletter|Your email address|Sign up|Search|Log in|Password|Send|Abonnieren|S'inscrire|Suscribirse",
    "share": "Share on social media|Tweet|Email this|Print|Tags: city, water|5 min read|By the staff|Teilen|Partager|Compartir",
    "comments": "Reply|Report|3 comments|Leave a comment|Kommentare|Commentaires|Comentarios|posted 2 hours ago|anonymous says:",
}
SYLLABLES = "an er in on re th st en or ti es at nd le la de un ch ei sch ie ca mo pa ri so ta vi ló né ä ou".split()
TAGS = {"main": "article main div section td", "nav": "nav div ul", "header": "header div", "footer": "footer div", "sidebar": "aside div section", "notice": "div section dialog", "ad": "div aside section", "form": "form div", "share": "div ul section", "comments": "div section ol"}


class Maker:
    """A page in the making: markup, and (text, of the article or not) of each leaf in page order."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.parts, self.leaves = rng, [], []
        self.plain = rng.random() < 0.15
        self.tails = [("", ".", "!!"), ("***", "%%%", "###", "$$$", "&")][int(rng.random() < 0.15)]

    def one(self, options: str, by: str | None = None) -> str:
        found = options.split(by)
        return found[self.rng.integers(len(found))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def prose(self, lo: int, hi: int) -> str:
        n = int(self.rng.integers(lo, hi + 1))
        words = ["".join(SYLLABLES[i] for i in self.rng.integers(len(SYLLABLES), size=self.rng.integers(1, 4))) for _ in range(n)]
        ends = self.rng.random(n)
        marked = [x + ("." if e < 0.08 else "," if e < 0.16 else "") for x, e in zip(words, ends, strict=True)]
        text = " ".join(marked).capitalize()
        return (text.upper() if self.chance(0.05) else text) + (self.one(".|.|.|", "|") + str(self.rng.choice(self.tails)) if self.chance(0.8) else "")

    def leaf(self, text: str, main: bool) -> str:
        self.leaves.append((" ".join(text.split()), main))
        return text

    def opened(self, kind: str, semantic: float = 0.5) -> tuple[str, str]:
        options = TAGS[kind].split()
        tag = options[0] if self.chance(semantic) else self.one(TAGS[kind])
        names = self.one(NAMES[kind])
        if self.chance(0.3):
            names += " " + self.one("c-12 wide col-8 box css-1x2y clearfix mt-4 container")
        if self.plain and tag != "div":
            names = ""
        if kind == "main" and self.chance(0.3):
            names = self.one("css-a8 x1 col wrap") if self.chance(0.5) else ""
        attribute = f' {"id" if self.chance(0.2) else "class"}="{names}"' if names else ""
        return f"<{tag}{attribute}>", f"</{tag}>"

    def article(self) -> None:
        a, b = self.opened("main")
        self.parts.append(a)
        if self.chance(0.8):
            self.parts.append(f"<h1>{self.leaf(self.prose(3, 12), True)}</h1>")
        for _ in range(int(self.rng.integers(1, 14))):
            kind = self.rng.random()
            if kind < 0.72:
                text = self.leaf(self.prose(1, 90) if self.chance(0.65) else self.prose(1, 4), True)
                self.parts.append(f"<p>{text}</p>" if self.chance(0.75) else f"<p><b>{text}<br>" if self.chance(0.4) else f"<p>{text}" if self.chance(0.6) else f'<p>{text[:-1]}<a href="/x">{text[-1]}</a></p>')
            elif kind < 0.8:
                self.parts.append(f"<h2>{self.leaf(self.prose(2, 8), True)}</h2>")
            elif kind < 0.86:
                self.parts.append("<ul>" + "".join(f"<li>{self.leaf(self.prose(1, 20), True)}</li>" for _ in range(self.rng.integers(2, 6))) + "</ul>")
            elif kind < 0.9:
                self.parts.append(f"<blockquote>{self.leaf(self.prose(8, 50), True)}</blockquote>")
            elif kind < 0.93:
                self.parts.append("<table><tr>" + "".join(f"<td>{self.leaf(self.prose(1, 6), True)}</td>" for _ in range(self.rng.integers(2, 6))) + "</tr></table>")
            elif kind < 0.95:
                self.parts.append(f"<figure><img src='a.png'><figcaption>{self.leaf(self.prose(3, 15), True)}</figcaption></figure>")
            elif not self.plain:
                self.other(self.one("ad share sidebar form notice"))
        self.parts.append(b)

    def other(self, kind: str) -> None:
        a, b = self.opened(kind)
        said = lambda: self.one(SAID[kind], "|") if self.chance(0.6) else self.prose(1, 4)
        link = lambda: f'<a href="/{self.rng.integers(99)}">{self.leaf(said(), False)}</a>'
        self.parts.append(a)
        if a.startswith(("<ul", "<ol")) or kind in ("nav", "sidebar", "footer", "share") and self.chance(0.6):
            if kind == "sidebar" and not a.startswith("<ul"):
                self.parts.append(f"<h3>{self.leaf(said(), False)}</h3>")
            items = "".join(f"<li>{link()}</li>" for _ in range(self.rng.integers(2, 9)))
            self.parts.append(items if a.startswith(("<ul", "<ol")) else f"<ul>{items}</ul>")
        elif kind == "comments":
            if self.chance(0.6):
                self.parts.append(f"<h3>{self.leaf(said(), False)}</h3>")
            for _ in range(self.rng.integers(1, 6)):
                if self.chance(0.6):
                    self.parts.append(f"<div class='{self.one('author user meta comment-author')}'>{self.leaf(said(), False)}</div>")
                self.parts.append(f"<p>{self.leaf(self.prose(4, 60), False)}</p>")
        elif kind == "form":
            self.parts.append(f"<label>{self.leaf(said(), False)}</label><input name='q'><button>{self.leaf(said(), False)}</button>")
        else:
            text = self.prose(3, 40) if self.chance(0.55) else self.one(SAID[kind], "|")
            self.parts.append(f"<p>{self.leaf(text, False)}</p>" if self.chance(0.5) else self.leaf(text, False))
        self.parts.append(b)

    def page(self) -> str:
        head = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>"
        before = [k for k, p in (("notice", 0.3), ("header", 0.5), ("nav", 0.8), ("ad", 0.4), ("form", 0.15), ("sidebar", 0.2), ("share", 0.15)) if self.chance(p)]
        after = [k for k, p in (("share", 0.3), ("ad", 0.3), ("comments", 0.4), ("sidebar", 0.4), ("form", 0.2), ("nav", 0.2), ("footer", 0.8), ("notice", 0.15)) if self.chance(p)]
        wrapped = self.chance(0.4)
        self.parts.append(head + ("<div id='page'>" if wrapped else ""))
        for k in before:
            self.other(k)
        if self.chance(0.95):
            self.article()
        for k in after:
            self.other(k)
        self.parts.append("</body></html>")
        return "\n".join(self.parts) if self.chance(0.3) else "".join(self.parts)


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[tuple[str, bool]]]]:
    """n pages, each as its markup and (text, of the article or not) of its leaves."""
    out = []
    for i in range(n):
        maker = Maker(np.random.default_rng((seed, i)))
        out.append((maker.page(), maker.leaves))
    return out
