"""Trains the node model of :mod:`millrace.llm.html_extract` on generated pages: ``python -m millrace.llm.html_train``.

Pages are drawn from many layouts, with and without telling names, so that the model can't lean on one sign alone. The
result is deterministic and lies beside this module as ``html_model.json``.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from millrace.llm.html_extract import Forest, features, parse

SYLLABLES = "an be co da el fi ga ho is jo ka le mi no or pa qu re st tu un va we xi yo ze er in on th ti en at ion".split()
SMALL = "the of and to in is that for on der die und in den de la le et les el los que y un".split()


class Writer:
    """Markup of one random page; ``spans`` notes whether each marked node is content."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.named = self.r.random() < 0.75
        self.semantic = self.r.random() < 0.6
        self.vocabulary = ["".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 5))) for _ in range(300)]

    def words(self, low: int, high: int) -> list[str]:
        return [self.r.choice(SMALL) if self.r.random() < 0.35 else self.r.choice(self.vocabulary) for _ in range(self.r.randint(low, high))]

    def sentence(self, low: int = 3, high: int = 22) -> str:
        w = self.words(max(low, 1), high)
        if len(w) > 8 and self.r.random() < 0.5:
            w[len(w) // 2] += ","
        return w[0].capitalize() + " " + " ".join(w[1:]) + self.r.choice([".", ".", ".", ".", "!", "?", ""])

    def prose(self, low: int, high: int) -> str:
        out = " ".join(self.sentence() for _ in range(self.r.randint(low, high)))
        if self.r.random() < 0.08:
            out = " ".join(x + self.r.choice(["***", "###", "&amp;&amp;&amp;", "$$$", "!!"]) for x in out.split(" "))
        if self.r.random() < 0.15:
            w = out.split(" ")
            k = self.r.randrange(len(w))
            w[k] = self.r.choice([f'<a href="/x">{w[k]}</a>', f"<b>{w[k]}</b>", f"<em>{w[k]}</em>", f"{w[k]}<br>"])
            out = " ".join(w)
        return out

    def names(self, kind: str) -> str:
        if not self.named or self.r.random() < 0.12:
            return self.r.choice(["", "", f' class="{self.r.choice("abcxyz")}{self.r.randint(1, 99)}"', f' class="css-{self.r.randint(1000, 9999)}"', ' class="row"', ' class="col-8"'])
        options = {
            "content": ["content", "article-body", "post-content", "entry-content", "main", "story-text", "article", "post", "page-content", "body-copy"],
            "menu": ["nav", "main-menu", "navbar", "breadcrumb", "site-navigation", "menu-list", "pagination", "toc"],
            "head": ["header", "site-header", "masthead", "top-bar", "branding"],
            "foot": ["footer", "site-footer", "page-foot", "copyright", "legal", "colophon"],
            "side": ["sidebar", "aside", "related-posts", "recommended", "widget-area", "trending", "more-stories", "popular"],
            "notice": ["cookie-notice", "consent-banner", "alert", "newsletter-signup", "notice", "popup", "gdpr", "subscribe-box", "privacy-notice", "message-bar"],
            "ad": ["ad", "ads", "advert", "sponsored", "promo-box", "ad-slot", "advertisement", "banner-ad"],
            "comment": ["comments", "comment-list", "discussion", "replies", "respond", "reader-comments", "comment"],
            "form": ["search-form", "login", "contact-form", "signup-form"],
            "share": ["share", "social-links", "tags", "post-meta", "byline"],
        }
        return f' {self.r.choice(["class", "class", "class", "id"])}="{self.r.choice(options[kind])}{self.r.choice(["", "", " clearfix", " mt-2", " wide"])}"'

    def links(self, n: int) -> str:
        items = [f'<a href="/{x}">{" ".join(self.words(1, 4))}</a>' for x in range(n)]
        style = self.r.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice([" | ", " ", " · ", " &middot; "]).join(items)

    def part(self, tags: list[str], kind: str, inner: str, label: int = 0) -> str:
        tag = tags[0] if self.semantic and self.r.random() < 0.8 else self.r.choice(tags + ["div"])
        return f'<{tag}{self.names(kind)} data-label="{label}">{inner}</{tag}>'

    def menu(self) -> str:
        return self.part(["nav", "div", "ul"][:2], "menu", self.links(self.r.randint(2, 12)))

    def head(self) -> str:
        inner = self.r.choice([f"<a href='/'>{self.sentence(1, 3)}</a>", f"<h1>{self.sentence(1, 3)}</h1>" if self.r.random() < 0.1 else f"<h2>{self.sentence(1, 3)}</h2>", f"<p>{self.sentence(2, 8)}</p>", self.sentence(2, 9)])
        return self.part(["header", "div"], "head", inner + (self.menu() if self.r.random() < 0.4 else ""))

    def foot(self) -> str:
        mark = self.r.choice(["&copy; ", "© ", "&copy; 2020 ", "Copyright ", ""])
        inner = self.r.choice([f"{mark}{self.sentence(1, 8)}", f"<p>{mark}{self.sentence(1, 10)}</p>", f"{mark}www.{self.r.choice(self.vocabulary)}.org &middot; {self.prose(1, 3)}", self.links(self.r.randint(2, 8)) + f"<p>{mark}{self.prose(1, 2)}</p>", f"<div>{self.prose(1, 2)}</div><div>{mark}{self.sentence(1, 5)}</div>"])
        return self.part(["footer", "div"], "foot", inner)

    def side(self) -> str:
        inner = self.r.choice([f"<h3>{self.sentence(1, 3)}</h3>{self.links(self.r.randint(2, 8))}", "".join(f"<div><h4><a href='/r'>{self.sentence(3, 8)}</a></h4><p>{self.sentence(4, 18)}</p></div>" for _ in range(self.r.randint(1, 5))), f"<p>{self.prose(1, 3)}</p>", f"<h3>{self.sentence(1, 3)}</h3><p>{self.prose(1, 2)}</p>"])
        return self.part(["aside", "div"], "side", inner)

    def notice(self) -> str:
        return self.part(["div", "section"], "notice", self.r.choice([f"<p>{self.prose(1, 2)}</p>", self.prose(1, 2)]) + self.r.choice(["", "<button>OK</button>", '<a href="/privacy">More</a>', '<input type="email"><button>Go</button>']))

    def ad(self) -> str:
        return self.part(["div", "aside"], "ad", self.r.choice([self.prose(1, 2), f"<p>{self.prose(1, 2)}</p>", f'<a href="//x"><img src="a.png">{self.sentence(2, 8)}</a>', f"<span>{self.sentence(2, 12)}</span>"]))

    def form(self) -> str:
        inner = "".join(f'<label>{self.sentence(1, 3)}</label><input name="f{x}">' for x in range(self.r.randint(1, 4))) + self.r.choice([f"<p>{self.sentence(3, 14)}</p>", ""]) + "<button>Send</button>"
        return f'<form{self.names("form")} data-label="0">{inner}</form>'

    def comments(self) -> str:
        one = lambda: self.r.choice([f"<div{self.names('comment')}><b>{self.sentence(1, 2)}</b><p>{self.prose(1, 4)}</p></div>", f"<li{self.names('comment')}><p>{self.prose(1, 3)}</p></li>", f"<article{self.names('comment')}><header>{self.sentence(1, 2)}</header><p>{self.prose(1, 3)}</p></article>"])
        return self.part(["section", "div"], "comment", self.r.choice([f"<h2>{self.r.randint(2, 40)} comments</h2>", f"<h3>{self.sentence(1, 2)}</h3>", ""]) + "".join(one() for _ in range(self.r.randint(1, 5))))

    def share(self) -> str:
        return self.part(["div", "ul"][:1], "share", self.links(self.r.randint(2, 5)))

    def content(self) -> str:
        r, out = self.r, []
        title = self.sentence(1, 14)
        h1 = f"<h1>{title}</h1>"
        if r.random() < 0.3:
            h1 = f"<header>{h1}</header>"
        out.append(h1 if r.random() < 0.92 else "")
        n = r.choices([1, 2, 3, 5, 8, 14, 30], [9, 6, 8, 8, 6, 3, 1])[0]
        soup = r.random() < 0.35
        paragraph_tag = r.choices(["p", "div"], [9, 1])[0]
        for k in range(n):
            x = r.random()
            body = self.prose(1, 1) if r.random() < 0.25 else self.prose(1, r.choice([2, 4, 9]))
            if r.random() < 0.12:
                body = self.sentence(0, 3)
            if k == 0 and r.random() < 0.25:
                body = title if r.random() < 0.7 else body
                out.append(r.choice([f"<p><b>{body}<br>", f"<p>{body}</p>"]))
            elif soup and r.random() < 0.3:
                out.append(f"<p><b>{body}<br>")
            elif x < 0.8:
                out.append(f"<{paragraph_tag}>{body}</{paragraph_tag}>")
            elif x < 0.86:
                out.append(f"<h2>{self.sentence(1, 7)}</h2>")
            elif x < 0.91:
                out.append("<ul>" + "".join(f"<li>{self.sentence(2, 12)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.94:
                out.append(f"<blockquote><p>{body}</p></blockquote>")
            elif x < 0.97:
                out.append("<table>" + "".join(f"<tr><td>{self.sentence(1, 3)}</td><td>{self.sentence(1, 5)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            else:
                out.append(f'<figure><img src="x.jpg"><figcaption>{self.sentence(2, 9)}</figcaption></figure>')
            if r.random() < 0.05:
                out.append(r.choice([self.ad, self.side, self.notice, self.form, self.share])())
        if r.random() < 0.1:
            out.append(self.links_in_text())
        if r.random() < 0.15:
            out.append(self.share())
        if r.random() < 0.12:
            out.append(self.comments())
        tag = "article" if self.semantic or r.random() < 0.3 else r.choice(["div", "div", "main", "section", "td"])
        if len(out) > 2 and r.random() < 0.12:
            cut, part = sorted(r.sample(range(1, len(out)), min(len(out) - 1, r.randint(1, 3)))), r.choice(["section", "div", "section"])
            out = [f"<{part}>{''.join(out[a:b])}</{part}>" for a, b in zip([0, *cut], [*cut, len(out)])]
        inner = "".join(out)
        if tag == "td":
            return f'<table data-label="1"><tr><td{self.names("content")} data-label="1">{inner}</td></tr></table>'
        if r.random() < 0.3:
            inner = f"<div{self.names('content')}>{inner}</div>"
        return f'<{tag}{self.names("content")} data-label="1">{inner}</{tag}>'

    def bare(self) -> str:
        """A page with hardly any markup: a heading or none, some paragraphs or loose text straight below the body, sometimes a footer or a menu."""
        r, out = self.r, []
        if r.random() < 0.5:
            out.append(f"<h{r.choice('112')}>{self.sentence(1, 6)}</h1>")
        for _ in range(r.choice([1, 1, 1, 2, 3, 6])):
            text = self.prose(1, r.choice([1, 2, 5]))
            out.append(r.choice([f"<p>{text}</p>", f"<p>{text}", f"<div>{text}</div>", f"{text}<br><br>", f"<h2>{self.sentence(1, 5)}</h2><p>{text}</p>"]))
        if r.random() < 0.15:
            out.append(self.links_in_text())
        inner = "".join(out)
        wrap = r.choice(["", "", "article", "main", "div", "center", "table"])
        if wrap == "table":
            links = " ".join(f"<a href=/{k}>{' '.join(self.words(1, 3))}</a>" for k in range(r.randint(2, 7)))
            side = r.choice(["", f'<td data-label="0">{links}</td>', f'<td width=150 data-label="0">{self.links(r.randint(2, 8))}</td>'])
            inner = f'<table data-label="1"><tr>{side}<td data-label="1">{inner}</td></tr>' + (f'<tr><td data-label="0">{r.choice(["Copyright", "&copy;", "(c)"])} {r.randint(1995, 2024)} {self.sentence(1, 4)}</td></tr>' if r.random() < 0.7 else "") + "</table>"
        elif wrap:
            inner = f'<{wrap} data-label="1">{inner}</{wrap}>'
        before = self.menu() if r.random() < 0.3 else ""
        after = self.foot() if r.random() < 0.4 else ""
        return f"<html><body>{before}{inner}{after}</body></html>"

    def split_content(self) -> str:
        """Two or three parts of one text side by side, each with a heading of its own, in no common element."""
        tag = self.r.choice(["section", "article", "div"])
        return "".join(f'<{tag}{self.names("content")} data-label="1"><h{1 + (k > 0)}>{self.sentence(1, 6)}</h{1 + (k > 0)}><p>{self.prose(1, 4)}</p></{tag}>' for k in range(self.r.randint(2, 3)))

    def links_in_text(self) -> str:
        """A list of links that belongs to the text, below a sentence that leads to it."""
        items = "".join(f'<li><a href="/s{k}">{self.sentence(2, 8)}</a>{self.r.choice(["", " " + self.sentence(2, 9)])}</li>' for k in range(self.r.randint(2, 5)))
        return f"<p>{self.sentence(3, 12)}</p><ul>{items}</ul>"

    def page(self) -> str:
        r = self.r
        if r.random() < 0.15:
            return self.bare()
        before, after = [], []
        for make, chance in ((self.head, 0.5), (self.menu, 0.75), (self.notice, 0.3), (self.ad, 0.45), (self.form, 0.2), (self.side, 0.15)):
            if r.random() < chance:
                before.append(make())
        if r.random() < 0.3:
            r.shuffle(before)
        for make, chance in ((self.share, 0.15), (self.side, 0.4), (self.comments, 0.4), (self.ad, 0.3), (self.form, 0.2), (self.notice, 0.2), (self.foot, 0.85), (self.notice, 0.1)):
            if r.random() < chance:
                after.append(make())
        comment = "<!-- ad 1 -->" if r.random() < 0.5 else ""
        content = "" if before and after and r.random() < 0.03 else self.split_content() if r.random() < 0.06 else self.content()
        middle = "".join(before) + comment + content + "".join(after[:-1])
        end = after[-1] if after else ""
        wrap = r.random()
        if wrap < 0.3:
            middle = f"<div{r.choice(['', ' id=wrapper', ' class=container', ' class=page'])} data-label=\"1\">{middle}</div>{end}"
        elif wrap < 0.4:
            middle = f'<main data-label="1">{middle}</main>{end}'
        else:
            middle += end
        return f"<!DOCTYPE html><html><head><title>{self.sentence(1, 6)}</title><style>p{{margin:0}}</style></head><body>{middle}</body></html>"


def labelled(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of one page's nodes. A node without a mark of its own has its parent's label."""
    tree = parse(Writer(seed).page())
    label = [1.0] * len(tree.tag)
    for i in range(1, len(label)):
        a = tree.attrs[i]
        label[i] = 1.0 if 'data-label="1"' in a or tree.tag[i] in ("html", "body") else 0.0 if 'data-label="0"' in a else label[tree.parent[i]]
    tree.attrs = [a.replace(' data-label="1"', "").replace(' data-label="0"', "") for a in tree.attrs]
    return features(tree)[1:], np.array(label[1:])


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.25, bins: int = 32, l2: float = 2.0) -> Forest:
    """Second-order boosting of the logistic loss over binned features; every level of a tree is split at once."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1).astype(np.int64)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    margin, inner = np.full(n, bias), 2**depth - 1
    all_f, all_t, all_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-6)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                slot = (at - first) * (bins + 1) + binned[:, f]
                gs = np.bincount(slot, g, nodes * (bins + 1)).reshape(nodes, bins + 1)
                hs = np.bincount(slot, h, nodes * (bins + 1)).reshape(nodes, bins + 1)
                gl, hl = gs.cumsum(1)[:, : len(cuts[f])], hs.cumsum(1)[:, : len(cuts[f])]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                k = gain.argmax(1)
                better = gain[np.arange(nodes), k] > best
                best = np.where(better, gain[np.arange(nodes), k], best)
                feature[first : first + nodes][better] = f
                threshold[first : first + nodes][better] = cuts[f][k[better]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf_of = at - inner
        leaf = rate * np.bincount(leaf_of, g, inner + 1) / (np.bincount(leaf_of, h, inner + 1) + l2)
        margin += leaf[leaf_of]
        all_f.append(feature)
        all_t.append(np.where(np.isinf(threshold), 1e30, threshold))
        all_l.append(leaf)
    return Forest(np.array(all_f), np.array(all_t, dtype=np.float32), np.array(all_l), bias)


def train(pages: int = 2000, **how: float) -> Forest:
    rows = [labelled(seed) for seed in range(pages)]
    return boost(np.concatenate([x for x, _ in rows]), np.concatenate([y for _, y in rows]), **how)


if __name__ == "__main__":
    train().dump(Path(__file__).with_name("html_model.json"))
