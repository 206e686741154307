"""Labelled pages for the extraction model, laid out by rule from common page conventions.

Text of the article stands between the marks OPEN and CLOSE, which are no characters of any language; the parser reads the
labels from them.  Pages are drawn with a fixed seed, so every driver fits the same model.
"""

from __future__ import annotations

import random

OPEN, CLOSE = "\ue000", "\ue001"
#: Conventions of public web pages for what is and is not part of an article.
ARTICLE_CLASSES = "content article-body post entry-content story main-content post-content article body-text text".split()
MENU_CLASSES = "menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc links main-menu".split()
AD_CLASSES = "ad ads advert advertisement sponsor sponsored promo banner ad-slot adsbox commercial".split()
SIDE_CLASSES = "sidebar side widget related recommended aside most-read trending rail".split()
NOTICE_CLASSES = "cookie cookie-notice notice consent gdpr alert popup modal newsletter subscribe paywall disclaimer".split()
COMMENT_CLASSES = "comments comment comment-list responses discussion replies disqus user-comments".split()
HEADER_CLASSES = "header site-header masthead top-bar branding logo page-header".split()
FOOTER_CLASSES = "footer site-footer copyright legal bottom colophon".split()
SHARE_CLASSES = "share social sharing tags meta-links buttons toolbar".split()
PLAIN_CLASSES = "wrapper container page row layout inner site outer has-sidebar no-sidebar with-menu ad-free".split()
#: Compound names whose parts mislead: the element is an article nevertheless.
ODD_CLASSES = "comment-worthy ad-free footer-note-style menu-less sidebar-left-layout header-large widget-free nav-below share-ready".split()


class Layout:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        syllables = "ta ro ne li ku sa mo vi de pa lo en ar it os".split()
        return " ".join("".join(self.r.choices(syllables, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 14).capitalize() + self.r.choice("...!?") for _ in range(self.r.randint(low, high)))

    def name(self, classes: list[str]) -> str:
        return f'{self.r.choice(["class", "class", "id"])}="{self.r.choice(classes)}"'

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.words(1, 1)}">{self.words(low, high)}</a>'

    def good(self, text: str) -> str:
        return f"{OPEN}{text}{CLOSE}"

    def nav(self) -> str:
        items = [self.link() for _ in range(self.r.randint(2, 9))]
        inner = "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.r.random() < 0.7 else " | ".join(items)
        return f"<nav>{inner}</nav>" if self.r.random() < 0.5 else f"<{(t := self.r.choice(['div', 'ul', 'section']))} {self.name(MENU_CLASSES)}>{inner}</{t}>"

    def header(self) -> str:
        inner = self.r.choice([f"<h1>{self.words(1, 3)}</h1><p>{self.words(2, 8)}</p>", self.link(), f"<span>{self.words(1, 4)}</span>{self.nav()}", f"<p>{self.words(2, 6)}</p>"])
        return f"<header>{inner}</header>" if self.r.random() < 0.5 else f"<div {self.name(HEADER_CLASSES)}>{inner}</div>"

    def footer(self) -> str:
        inner = self.r.choice([f"&copy; {self.words(1, 2)} &middot; {self.words(2, 20)}", f"<p>{self.sentences(1, 2)}</p>{self.link()}", self.nav(), f"<small>{self.words(3, 12)}.</small>"])
        return f"<footer>{inner}</footer>" if self.r.random() < 0.6 else f"<div {self.name(FOOTER_CLASSES)}>{inner}</div>"

    def aside(self) -> str:
        inner = f"<h3>{self.words(1, 3)}</h3>" + "".join(self.r.choice([f"<p>{self.sentences(1, 3)}</p>", f"<li>{self.link(2, 6)}</li>", f"<div>{self.words(3, 20)}</div>"]) for _ in range(self.r.randint(1, 5)))
        return f"<aside>{inner}</aside>" if self.r.random() < 0.4 else f"<{(t := self.r.choice(['div', 'section', 'aside']))} {self.name(SIDE_CLASSES)}>{inner}</{t}>"

    def advert(self) -> str:
        inner = self.r.choice([self.sentences(1, 3), f"<p>{self.sentences(1, 3)}</p>", self.link(2, 6), f"<span>{self.words(1, 3)}</span>{self.link(1, 5)}"])
        return f"<{(t := self.r.choice(['div', 'div', 'section', 'p', 'ins', 'aside']))} {self.name(AD_CLASSES)}>{inner}</{t}>"

    def notice(self) -> str:
        inner = self.r.choice([self.sentences(1, 3), f"<p>{self.sentences(1, 3)}</p><button>{self.words(1, 2)}</button>", f"<p>{self.sentences(1, 2)} {self.link()}</p>"])
        return f"<{(t := self.r.choice(['div', 'div', 'section', 'dialog']))} {self.name(NOTICE_CLASSES)}>{inner}</{t}>"

    def form(self) -> str:
        return f"<form><label>{self.words(1, 4)}</label><input><select><option>{self.words(1, 2)}</option><option>{self.words(1, 2)}</option></select><p>{self.sentences(1, 1)}</p><button>{self.words(1, 2)}</button></form>"

    def comments(self) -> str:
        one = lambda: f"<{(t := self.r.choice(['div', 'li', 'article']))} {self.name(['comment', 'comment-body', 'reply'])}><b>{self.words(1, 2)}</b><p>{self.sentences(1, 4)}</p></{t}>"
        inner = f"<h2>{self.words(1, 3)}</h2>" + "".join(one() if self.r.random() < 0.7 else f"<p>{self.sentences(1, 4)}</p>" for _ in range(self.r.randint(1, 6)))
        return f"<{(t := self.r.choice(['section', 'div', 'ol']))} {self.name(COMMENT_CLASSES)}>{inner}</{t}>"

    def share(self) -> str:
        return f"<div {self.name(SHARE_CLASSES)}>{self.words(1, 2)} {self.link()} {self.link()}</div>"

    def paragraph(self) -> str:
        text = self.sentences(1, 6) if self.r.random() < 0.85 else self.words(1, 4)
        kind = self.r.random()
        if kind < 0.45:
            return f"<p>{self.good(text)}</p>"
        if kind < 0.52:
            return f"<{(t := self.r.choice(['div', 'div', 'section', 'center', 'span', 'figure']))}>{self.good(text)}</{t}>"
        if kind < 0.56:
            return f"<div><p>{self.good(text)}</p><p>{self.good(self.sentences(1, 4))}</p></div>"
        if kind < 0.58:
            return f"<dl>{''.join(f'<dt>{self.good(self.words(1, 5))}</dt><dd>{self.good(self.sentences(1, 2))}</dd>' for _ in range(self.r.randint(1, 3)))}</dl>"
        if kind < 0.6:
            return f"<details><summary>{self.good(self.words(1, 6))}</summary><p>{self.good(text)}</p></details>"
        if kind < 0.61:
            return f"<p>{self.good(text)} <{(t := self.r.choice(['math', 'object', 'sub', 'q', 'cite', 'abbr', 'time', 'label']))}>{self.good(self.words(1, 3))}</{t}>{self.good(self.words(1, 6) + '.')}</p>"
        if kind < 0.615:
            inner = "".join(f"<mi>{self.good(self.words(1, 1)[:2])}</mi><mo>{self.good('=')}</mo>" for _ in range(self.r.randint(1, 3)))
            return f"<p>{self.good(text)} <math>{inner}</math> {self.good(self.words(1, 3))} <b><i>{self.good(self.words(1, 2))}</i></b></p>"
        if kind < 0.625:
            return f"<figure><img src=x><figcaption>{self.good(self.words(2, 12))}</figcaption></figure>"
        if kind < 0.75:
            return f"<p>{self.good(text)} <{(t := self.r.choice(['b', 'i', 'em', 'strong', 'a', 'span', 'code']))}>{self.good(self.words(1, 4))}</{t}> {self.good(self.words(1, 9) + '.')}</p>"
        if kind < 0.8:
            return f"<ul>{''.join(f'<li>{self.good(self.words(2, 12))}</li>' for _ in range(3))}</ul>"
        if kind < 0.85:
            return f"<blockquote><p>{self.good(text)}</p></blockquote>"
        if kind < 0.9:
            return f"<p><b>{self.good(text)}<br><p>{self.good(self.sentences(1, 3))}</p>"
        if kind < 0.93:
            return f"<table><tr><td>{self.good(self.words(1, 5))}</td><td>{self.good(self.words(1, 5))}</td></tr></table>"
        if kind < 0.96:
            return f"<pre>{self.good(self.words(4, 20))}</pre>"
        return f"<{(t := self.r.choice(['h2', 'h2', 'h3', 'h3', 'h4', 'h5', 'h6']))}>{self.good(self.words(1, 8))}</{t}>"

    def article(self) -> str:
        title = f"<{(t := self.r.choice(['h1', 'h1', 'h1', 'h2', 'h4']))}>{self.good(self.words(1, 12))}</{t}>" if self.r.random() < 0.65 else ""
        body = [self.paragraph() for _ in range(self.r.choice([0, 1, 1, 2, 3, 5, 8, 12]) if title else self.r.choice([1, 1, 2, 3, 5, 8]))]
        for part in (self.advert, self.share, self.notice, self.aside, self.form):
            if self.r.random() < 0.08:
                body.insert(self.r.randint(0, len(body)), part())
        if self.r.random() < 0.1:
            body.append(self.comments())
        inner = title + "".join(body)
        if self.r.random() < 0.2:
            inner = f"<{(t := self.r.choice(['div', 'section']))}>{inner}</{t}>"
        odd = "" if self.r.random() < 0.7 else f" {self.name([*ODD_CLASSES, self.words(1, 1), f'{self.words(1, 1)}-{self.words(1, 1)}', *PLAIN_CLASSES])}"
        kind = self.r.random()
        if title and kind < 0.62 and self.r.random() < 0.15:
            inner = inner.replace(title, f"<header>{title}</header>", 1)
        if kind < 0.35:
            return f"<article{odd}>{inner}</article>"
        if kind < 0.52:
            return f"<main{odd}>{inner}</main>"
        if kind < 0.62:
            return f"<main><article {self.name(ARTICLE_CLASSES)}>{inner}</article></main>"
        if kind < 0.82:
            return f"<{(t := self.r.choice(['div', 'section']))} {self.name(ARTICLE_CLASSES)}>{inner}</{t}>"
        if kind < 0.92:
            return f"<div{odd}>{inner}</div>"
        return inner

    def page(self) -> str:
        if self.r.random() < 0.06:
            return "".join(self.paragraph() for _ in range(self.r.randint(1, 4)))
        before = [p() for p in (self.header, self.nav, self.notice, self.advert, self.form) if self.r.random() < 0.35]
        after = [p() for p in (self.comments, self.aside, self.advert, self.nav, self.notice, self.form, self.share) if self.r.random() < 0.3]
        if self.r.random() < 0.2 and before:
            after.append(before.pop())
        inner = "".join(before) + (self.article() if self.r.random() < 0.97 else "") + "".join(after) + (self.footer() if self.r.random() < 0.8 else "")
        if self.r.random() < 0.35:
            inner = f"<div {self.name(PLAIN_CLASSES)}>{inner}</div>"
        head = f"<head><meta charset=utf-8><title>{self.words(1, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{inner}</body></html>" if self.r.random() < 0.9 else inner


class PlainLayout(Layout):
    """Pages of few signs: articles of short blocks without class names, or of bare text, between menus and footers that their tags or links tell."""

    def block(self) -> str:
        text = self.sentences(1, 1) if self.r.random() < 0.7 else self.sentences(2, 5)
        tag = self.r.choice(["div"] * 6 + ["p", "p", "section", "span"])
        return f"<{tag}>{self.good(text)}</{tag}>"

    def page(self) -> str:
        if self.r.random() < 0.15:
            return "\n".join(self.good(self.sentences(1, 3)) for _ in range(self.r.randint(1, 6)))
        title = f"<{(t := self.r.choice(['h1', 'h1', 'h2']))}>{self.good(self.words(1, 8))}</{t}>" if self.r.random() < 0.6 else ""
        inner = title + "".join(self.block() for _ in range(self.r.choice([1, 2, 2, 3, 5, 8, 12])))
        if self.r.random() < 0.15:
            inner = title + " ".join([self.good(self.sentences(1, 3)), *(f"<br>{self.good(self.sentences(1, 2))}" for _ in range(self.r.randint(0, 4)))])
        if self.r.random() < 0.4:
            inner = f"<div>{inner}</div>"
        links = [self.link() for _ in range(self.r.randint(2, 9))]
        menu = self.r.choice([f"<nav>{''.join(links)}</nav>", "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>", f"<div>{' '.join(links)}</div>", "<nav><ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul></nav>"])
        before = "".join(x for x in (f"<header>{self.words(1, 4)}</header>", menu) if self.r.random() < 0.6)
        after = "".join(x for x in (f"<aside>{self.sentences(1, 3)}</aside>", f"<form><label>{self.words(1, 2)}</label><input><button>{self.words(1, 1)}</button></form>") if self.r.random() < 0.2)
        foot = f"<footer>{self.r.choice([self.words(1, 6), '&copy; ' + self.words(1, 4), self.sentences(1, 1), self.link()])}</footer>" if self.r.random() < 0.7 else ""
        inner = f"{before}{inner}{after}{foot}"
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{inner}</body></html>" if self.r.random() < 0.7 else inner


def labelled_pages(n: int = 600, seed: int = 11) -> list[str]:
    """``n`` pages of many signs and a third as many of few."""
    return [Layout(seed * 100_003 + k).page() for k in range(n)] + [PlainLayout(seed * 100_003 + n + k).page() for k in range(n // 3)]
