"""Pages laid out by chance, with the main text marked, to learn from: layouts with and without telling tags and names."""

from __future__ import annotations

import random

#: In front of every run of the main text.
MARK = "\ue000"


class Layout:
    """One page: site parts around an article, each part in one of several dresses."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.sound = self.r.sample("an er on in th re ou ti en al it es or ar le si no ra te ma ko lu vi de sch ung ß é ñ ção".split(), 14)
        self.telling = self.r.random() < 0.75  # names tell what a part is
        self.semantic = self.r.random() < 0.65  # so do tags

    def word(self) -> str:
        return "".join(self.r.choice(self.sound) for _ in range(self.r.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentence(self, a: int = 3, b: int = 18) -> str:
        s = self.words(a, b)
        return s[:1].upper() + s[1:] + self.r.choice([".", ".", ".", "?", "!", ","])

    def prose(self, most: int = 8) -> str:
        return " ".join(self.sentence(1, 16) for _ in range(self.r.randint(1, most)))

    def box(self, inner: str, tag: str, names: str) -> str:
        tag = tag if self.semantic else "div"
        name = self.r.choice(names.split()) if self.telling or (tag == "div" and self.r.random() < 0.5) else self.r.choice(["", "", f"c{self.r.randint(1, 99)}", "wrap", "box", "row", "col"])
        how = self.r.choice(["class", "class", "id"])
        if name and self.r.random() < 0.3:
            name += self.r.choice([" clearfix", "-inner", "_1", " wide", "-box"])
        return f'<{tag} {how}="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    def links(self, a: int, b: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 4)}</a>' for _ in range(self.r.randint(a, b))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice([" | ", " ", "<br>"]).join(items)

    def menu(self) -> str:
        return self.box(self.links(3, 9), "nav", "nav menu navbar navigation main-menu breadcrumb toc pagination")

    def advert(self) -> str:
        return self.box(self.r.choice([self.sentence(2, 15), f"<p>{self.prose(3)}</p>", f'<a href="#">{self.sentence()}</a> {self.words(1, 4)}']), self.r.choice(["div", "div", "aside"]), "ad ads advert advertisement sponsored promo banner")

    def notice(self) -> str:
        return self.box(f"<p>{self.prose(3)}</p>" + self.r.choice(["", "<button>OK</button>", f'<a href="#">{self.word()}</a>']), self.r.choice(["div", "section", "aside", "dialog"]), "cookie cookie-notice consent notice alert popup newsletter gdpr-banner")

    def sidebar(self) -> str:
        parts = [self.r.choice([f"<h3>{self.words(1, 3)}</h3>{self.links(2, 7)}", f"<h4>{self.words(1, 3)}</h4><p>{self.prose(4)}</p>", self.advert()]) for _ in range(self.r.randint(1, 3))]
        return self.box("".join(parts), "aside", "sidebar side widget related recommended trending popular right-rail")

    def form(self) -> str:
        inner = f'<label>{self.words(1, 2)}</label><input type="text"><button>{self.word()}</button>' + self.r.choice(["", f"<p>{self.sentence()}</p>", f"<select><option>{self.word()}</option></select>"])
        return self.r.choice(["<form>{}</form>", '<form class="search">{}</form>', '<div class="login"><form>{}</form></div>']).format(inner)

    def comments(self) -> str:
        one = lambda: self.r.choice(["<li>{}</li>", "<div>{}</div>", '<div class="comment">{}</div>', '<article class="comment">{}</article>']).format(f"<b>{self.word()}</b> {self.r.choice(['', '<p>'])}{self.prose(5)}" + self.r.choice(["", f'<a href="#">{self.word()}</a>']))
        inner = "".join(one() for _ in range(self.r.randint(1, 6)))
        # what tells readers' words from the author's is a name or a heading of the part: it always has a name
        kept, self.telling = self.telling, True
        out = self.box(f"<h3>{self.words(1, 2)}</h3>" + (f"<ul>{inner}</ul>" if self.r.random() < 0.3 else inner), self.r.choice(["section", "div", "div", "aside"]), "comments comment-list replies discussion responses reader-comments")
        self.telling = kept
        return out

    def header(self) -> str:
        return self.box(self.r.choice([f'<a href="/">{self.words(1, 3)}</a>', f"<div>{self.words(1, 3)}</div>", f"<p>{self.words(2, 6)}</p>"]) + (self.menu() if self.r.random() < 0.4 else ""), "header", "header masthead site-header topbar logo")

    def footer(self) -> str:
        return self.box(self.r.choice([f"&copy; {self.word()}.example &middot; {self.prose(3)}", f"<p>&copy; 20{self.r.randint(10, 30)} {self.words(1, 6)}</p>", self.links(2, 6), f"<p>{self.prose(4)}</p>"]), "footer", "footer site-footer copyright legal bottom")

    def share(self) -> str:
        return self.box(self.links(2, 4), "div", "share social share-tools tags")

    def block(self, first: bool = False) -> str:
        r, k = self.r.random(), MARK
        if first or r < 0.08:
            return f"<h{self.r.choice('1123') if first else self.r.choice('234')}>{k}{self.words(1, 9)}</h{1}>"
        if r < 0.13:
            return "<ul>" + "".join(f"<li>{k}{self.sentence(1, 12)}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>"
        if r < 0.17:
            return f"<blockquote>{k}{self.prose(3)}</blockquote>" if self.r.random() < 0.6 else f"<blockquote><p>{k}{self.prose(3)}</p></blockquote>"
        if r < 0.20:
            return "<table>" + "".join(f"<tr><td>{k}{self.words(1, 3)}</td><td>{k}{self.words(1, 5)}</td></tr>" for _ in range(self.r.randint(2, 4))) + "</table>"
        if r < 0.23:
            return f'<figure><img src="x"><figcaption>{k}{self.sentence()}</figcaption></figure>'
        text = self.prose(12 if self.r.random() < 0.5 else 2) if self.r.random() < 0.9 else self.word()
        if self.r.random() < 0.2:
            text += f' <a href="/{self.word()}">{self.words(1, 3)}</a> {self.prose(2)}'
        if self.r.random() < 0.15:
            return f"<p><b>{k}{text}<br>"
        if self.r.random() < 0.06:
            return f"<div>{k}{text}</div>"
        return f"<p>{k}{text}</p>" if self.r.random() < 0.9 else f"<p>{k}{text}"

    def article(self) -> str:
        parts = [self.block(True)] if self.r.random() < 0.85 else []
        for _ in range(self.r.choice([0, 1, 2, 3, 5, 8, 14, 14, 50])):
            parts.append(self.block())
            if self.r.random() < 0.06:
                parts.append(self.r.choice([self.advert, self.share, self.notice, self.sidebar])())
        if self.r.random() < 0.06:
            return "".join(parts) or f"{MARK}{self.prose(4)}"  # nothing around the text
        return self.box("".join(parts) or f"<p>{MARK}{self.prose(2)}</p>", self.r.choice(["article", "article", "main", "section"]), "article content post entry main story article-body text")

    def page(self) -> str:
        r = self.r
        front = [p() for p in (self.header, self.menu, self.notice, self.advert, self.form, self.sidebar) if r.random() < 0.45]
        back = [p() for p in (self.share, self.sidebar, self.comments, self.advert, self.form, self.menu, self.notice) if r.random() < 0.4]
        r.shuffle(front)
        r.shuffle(back)
        main = self.article()
        if r.random() < 0.4:
            main = self.r.choice(["<div>{}</div>", '<div class="container">{}</div>', '<main id="main">{}</main>', '<div id="page"><div>{}</div></div>']).format("".join(back[:1]) + main + "".join(back[1:2]))
            back = back[2:]
        foot = [self.footer()] if r.random() < 0.85 else []
        head = f'<head><meta charset="utf-8"><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        return f"<!DOCTYPE html><html>{head}<body>{''.join(front)}{main}{''.join(back)}{''.join(foot)}" + r.choice(["</body></html>", "</body></html>", ""])


def sample_page(seed: int) -> str:
    return Layout(seed).page()
