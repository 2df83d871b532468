"""Invented web pages whose main text is known: the labelled rows that the extraction of
main texts is trained on.

A page is put together by rules from a seed: a layout (elements or bare ``div``s, with
telling, meaningless or no names), an article and the usual surroundings.  The words are
random syllables, so that a model can only learn from structure, names and density.
Runs of the main text begin with ``MARK``."""

from __future__ import annotations

import random

MARK = "\ue000"

#: Fixed word lists: usual names of page parts (class and id values).
NAMES = {
    "nav": "nav navbar menu main-menu navigation topnav breadcrumb breadcrumbs site-nav toc tabs pager pagination "
           "skip-link subnav mega-menu links language-switcher",
    "header": "header masthead site-header banner topbar logo branding tagline page-header top",
    "footer": "footer site-footer bottom colophon copyright legal page-footer foot footnote-bar credits imprint",
    "side": "sidebar aside widget rail secondary side-column related recommended popular trending most-read tags "
            "archive categories more-stories teaser author-box sidebar-right",
    "notice": "cookie consent gdpr notice alert banner popup modal overlay newsletter signup subscribe paywall "
              "cookie-notice message toast disclaimer warning",
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted adsense ad-slot ad-banner adbox dfp promotion",
    "form": "form search login contact search-form newsletter-form subscribe-form register poll survey",
    "comments": "comments comment comment-list replies reply respond discussion reader-comments disqus responses "
                "user-comments feedback comment-body",
    "share": "share social share-buttons social-links follow sharing toolbar print actions",
    "main": "article main content post entry story body text article-body post-content entry-content main-content "
            "story-body article-text news-text blog-post single",
    "plain": "container wrapper row col inner page site layout box block section grid clearfix outer panel area",
}
NAMES = {k: v.split() for k, v in NAMES.items()}
SYLLABLES = "an be co da el fi go ha in jo ka lo me no or pa qui ra se ti um ve wo xa yn zu ch st br é ü ñ ø ś ж ни по да".split()


class Page:
    """One random page."""

    def __init__(self, rng: random.Random, held_out: bool = False):
        self.rng = rng
        #: how the page names its parts: mostly telling, sometimes meaningless or not at all
        self.naming = rng.choices(["telling", "some", "meaningless", "none"], [50, 20, 15, 15])[0]
        self.semantic = rng.random() < (0.35 if self.naming == "telling" else 0.65)
        self.untidy = rng.random() < 0.4
        self.held_out = held_out

    # words ---------------------------------------------------------------------------
    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def words(self, low: int, high: int, stop: bool = True) -> str:
        rng, out = self.rng, []
        for _ in range(rng.randint(low, high)):
            w = self.word()
            out.append(w + ("," if rng.random() < 0.07 else "." if rng.random() < 0.06 else ""))
        text = " ".join(out).capitalize()
        if rng.random() < 0.1:
            text = text.replace(" ", rng.choice(["&nbsp;", " &amp; ", "\n  ", " &#8211; "]), 2)
        return text + ("." if stop and rng.random() < 0.9 else "")

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}/{self.rng.randint(1, 999)}">{text}</a>'

    # parts ---------------------------------------------------------------------------
    def name(self, kind: str) -> str:
        rng, naming = self.rng, self.naming
        if naming == "none" or naming == "some" and rng.random() < 0.5:
            return ""
        if naming == "meaningless":
            return f' class="css-{rng.randrange(16 ** 5):x}"' if rng.random() < 0.7 else ""
        names = NAMES[kind]
        names = names[::3] if self.held_out else [n for i, n in enumerate(names) if i % 3 or len(names) < 4 or i < 3]
        picked = rng.sample(names, min(len(names), rng.choice([1, 1, 2])))
        if rng.random() < 0.2:
            picked.append(rng.choice(NAMES["plain"]))
        if rng.random() < 0.2:
            picked = ["".join(p.title() for p in picked[0].split("-")), *picked[1:]]
        return f' {rng.choice(["class", "class", "class", "id"])}="{" ".join(picked)}"'

    def part(self, kind: str, element: str, inner: str) -> str:
        tag = element if self.semantic and self.rng.random() < 0.85 else "div"
        name = self.name(kind) if tag == "div" or self.rng.random() < 0.5 else ""
        out = f"<{tag}{name}>{inner}</{tag}>"
        if self.rng.random() < 0.25:
            out = f"<div{self.name('plain')}>{out}</div>"
        return out

    def items(self, low: int, high: int, words: tuple[int, int], linked: float = 1.0) -> str:
        rng = self.rng
        texts = [self.words(*words, stop=False) for _ in range(rng.randint(low, high))]
        texts = [self.link(t) if rng.random() < linked else t for t in texts]
        style = rng.random()
        if style < 0.6:
            close = "" if self.untidy and rng.random() < 0.5 else "</li>"
            return "<ul>" + "".join(f"<li>{t}{close}" for t in texts) + "</ul>"
        if style < 0.8:
            return rng.choice([" | ", " ", " · "]).join(texts)
        return "".join(f"<{t}>{x}</{t}>" for x in texts for t in [rng.choice(["div", "p"])])

    def paragraph(self, text: str) -> str:
        close = "" if self.untidy and self.rng.random() < 0.3 else "</p>"
        return f"<p>{text}{close}"

    def surroundings(self, kind: str) -> str:
        rng = self.rng
        if kind == "nav":
            return self.part("nav", "nav", self.items(2, 12, (1, 3)))
        if kind == "header":
            logo = rng.choice([self.link(self.words(1, 3, False)), f"<h1>{self.words(1, 3, False)}</h1>",
                               f"<p>{self.words(2, 8)}</p>", f"<span{self.name('header')}>{self.words(1, 4, False)}</span>"])
            return self.part("header", "header", logo + (self.items(2, 7, (1, 2)) if rng.random() < 0.6 else ""))
        if kind == "footer":
            inner = "" if rng.random() < 0.4 else self.items(2, 12, (1, 4))
            line = f"{rng.choice(['&copy; ', '© ', 'Copyright ', ''])}{rng.randint(1999, 2030)} {self.words(1, 16)}"
            site = f"&copy; {self.word()}.example.com {rng.choice(['&middot;', '|', '-'])} {self.words(2, 9)}"
            line = rng.choice([line, site])
            return self.part("footer", "footer", inner + rng.choice([line, f"<p>{line}</p>", f"<div>{line}</div>"]))
        if kind == "side":
            head = f"<h{rng.choice('234')}>{self.words(1, 4, False)}</h3>" if rng.random() < 0.7 else ""
            body = rng.choice([self.items(2, 10, (2, 12)), self.items(2, 8, (2, 12)), self.paragraph(self.words(5, 40)),
                               "".join(f"<div><h4>{self.link(self.words(3, 10))}</h4><p>{self.words(4, 25)}</p></div>"
                                       for _ in range(rng.randint(1, 5)))])
            return self.part("side", "aside", head + body)
        if kind == "notice":
            text = self.words(5, 45)
            button = rng.choice(["", f"<button>{self.words(1, 2, False)}</button>", self.link(self.words(1, 3, False))])
            return self.part("notice", "div", rng.choice([text, f"<p>{text}</p>"]) + button)
        if kind == "ad":
            text = self.words(2, 25)
            return self.part("ad", rng.choice(["aside", "div"]), rng.choice([text, text, self.link(text), f"<p>{text}</p>"]))
        if kind == "form":
            fields = "".join(f'<label>{self.words(1, 3, False)}</label><input name="{self.word()}">'
                             for _ in range(rng.randint(1, 4)))
            more = rng.choice(["", self.paragraph(self.words(4, 20)), "<select><option>a<option>b</select>"])
            return f"<form{self.name('form')}>{more}{fields}<button>{self.words(1, 2, False)}</button></form>"
        if kind == "share":
            return self.part("share", "div", self.items(2, 6, (1, 2)))
        comments = []
        for _ in range(rng.randint(1, 8)):
            who = f"<{t}{self.name('comments')}>{self.words(1, 3, False)}</{t}>" if (t := rng.choice(["b", "cite", "div", "span"])) else ""
            says = "".join(self.paragraph(self.words(3, 60)) for _ in range(rng.choice([1, 1, 2])))
            reply = self.link(self.words(1, 2, False)) if rng.random() < 0.5 else ""
            tag = rng.choice(["li", "div", "article"])
            comments.append(f"<{tag}{self.name('comments')}>{who}{says}{reply}</{tag}>")
        head = f"<h{rng.choice('234')}>{self.words(1, 4, False)}</h3>" if rng.random() < 0.7 else ""
        inner = "".join(comments)
        if "<li" in inner:
            inner = f"<ol{self.name('comments')}>{inner}</ol>"
        return self.part("comments", "section", head + inner + (self.surroundings("form") if rng.random() < 0.4 else ""))

    # the article ---------------------------------------------------------------------
    def main_text(self, low: int, high: int, stop: bool = True) -> str:
        rng, text = self.rng, self.words(low, high, stop)
        if rng.random() < 0.2 and text.count(" ") > 6:
            a, b, c = text.split(" ", 2)
            text = f"{a} {rng.choice([self.link(b), f'<b>{b}</b>', f'<em>{b}</em>'])} {c}"
        return MARK + text

    def block(self) -> str:
        rng, kind = self.rng, self.rng.random()
        size = rng.choice([(1, 8), (8, 40), (20, 90), (40, 160)])
        if kind < 0.72:
            return self.paragraph(self.main_text(*size))
        if kind < 0.80:
            return f"<h{(n := rng.choice('23'))}>{self.main_text(1, 8, False)}</h{n}>"
        if kind < 0.86:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.main_text(2, 20)}</li>" for _ in range(rng.randint(2, 6))) + f"</{tag}>"
        if kind < 0.90:
            return f"<blockquote>{rng.choice([self.main_text(*size), self.paragraph(self.main_text(*size))])}</blockquote>"
        if kind < 0.93:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.main_text(1, 4, False)}</td>" for _ in range(3)) + "</tr>"
                                       for _ in range(rng.randint(1, 4))) + "</table>"
        if kind < 0.96:
            return f'<figure><img src="x.png"><figcaption>{self.main_text(3, 15)}</figcaption></figure>'
        return f"<p><b>{self.main_text(2, 20)}<br>" + self.paragraph(self.main_text(*size))

    def article(self) -> str:
        rng = self.rng
        head = f"<h1>{self.main_text(2, 14, False)}</h1>" if rng.random() < 0.8 else ""
        if head and rng.random() < 0.15:
            head = f"<header>{head}</header>" if self.semantic else f"<div>{head}</div>"
        if rng.random() < 0.12:  # text straight in the article's element
            body = "<br><br>".join(self.main_text(10, 90) for _ in range(rng.randint(1, 6)))
        else:
            body = [self.block() for _ in range(rng.choice([1, 2, 4, 8, 16, 30]))]
            for kind in ("ad", "side", "share", "notice", "form", "nav"):
                if rng.random() < 0.1:
                    body.insert(rng.randint(0, len(body)), self.surroundings(kind))
            body = "".join(body)
        if rng.random() < 0.2:
            body = f"<div{self.name('main')}>{body}</div>"
        article = self.part("main", rng.choice(["article", "article", "main"]), head + body)
        return article

    def html(self) -> str:
        rng = self.rng
        before = [self.surroundings(k) for k, p in (("notice", .25), ("header", .55), ("nav", .7), ("ad", .4), ("form", .15))
                  if rng.random() < p]
        if rng.random() < 0.2:
            rng.shuffle(before)
        after = [self.surroundings(k) for k, p in (("share", .2), ("side", .35), ("comments", .35), ("side", .2), ("ad", .2),
                                                   ("nav", .15), ("footer", .75), ("notice", .15)) if rng.random() < p]
        main = self.article()
        if rng.random() < 0.3:  # main column and side column
            columns = [f"<div{self.name('plain')}>{main}</div>", self.surroundings("side")]
            if rng.random() < 0.3:
                columns.reverse()
            main = f"<div{self.name('plain')}>{''.join(columns)}</div>"
        if rng.random() < 0.15:
            main = f"<table><tr><td>{self.items(2, 9, (1, 3))}</td><td>{main}</td></tr></table>"
        body = "".join(before) + f"<!-- {self.word()} -->" + main + "".join(after)
        if rng.random() < 0.3:
            body = f"<div{self.name('plain')}>{body}</div>"
        head = f"<head><title>{self.words(2, 8, False)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head>"
        end = "" if self.untidy and rng.random() < 0.5 else "</body></html>"
        return f"<!DOCTYPE html><html>{head}<body>{body}{end}"


def pages(count: int, seed: int, held_out: bool = False) -> list[str]:
    """``count`` pages; ``held_out`` pages take their names from the part of the lists
    that other pages leave out."""
    return [Page(random.Random(f"{seed}:{held_out}:{k}"), held_out).html() for k in range(count)]
