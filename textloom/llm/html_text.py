"""Main text of HTML pages: gradient-boosted trees over DOM-node features, and hierarchical decoding.

Each structural node gets features of itself (tag and attribute tokens as log-odds of being content), of its path from
the root, of its subtree (text, link, tag and punctuation density) and of its place among its siblings; boosted trees
turn them into the log-odds that the node is main text. Decoding then finds the likeliest consistent choice for the whole
tree: on a path from the root, nodes are outside at first, may become content once, and may be cut once after that; so
no descendant of a cut node is content, and no second content begins under it.

The trees are fitted here, on pages that a generator makes up with known answers: articles in various containers among
menus, headers, sidebars, notices, adverts, forms, related links and reader comments; right in the body or in no element
at all; in cells of a table; under names that say nothing; with short lists and lone headings. The generator is seeded, so every
fit gives the same trees; the first fit in a shared folder leaves them there for later ones.

Cases: a null or empty page has an empty text; text outside any element hangs on the root; unclosed or crossed tags are
closed as HTML implies; pages of any length are read whole; repeated rows give equal texts; an empty table gives an empty
result; columns besides the id, url and page aren't read.
"""

from __future__ import annotations

import functools
import hashlib
import inspect
import json
import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import boosting, dom
from textloom.llm.dom import Page, read
from textloom.llm.shared import exists, pieces, shared_folder

# Names that page templates give to what isn't main text, and to what is.
OTHER = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav mainmenu pager pagination tabs toc links",
    "header": "header masthead banner topbar branding logo site-header page-header tagline",
    "footer": "footer site-footer copyright legal colophon bottom credits page-footer",
    "aside": "sidebar aside widget rail secondary related recommended recommendations trending popular more-stories side teaser",
    "notice": "notice cookie consent gdpr alert announcement popup modal paywall overlay subscribe disclaimer toast message",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner-ad ad-slot affiliate",
    "form": "form newsletter signup login search contact-form subscribe-form registration feedback",
    "comments": "comments comment comment-list discussion replies reply responses disqus reader-comments commentlist user-comments",
    "share": "share social sharing social-share follow buttons tags meta byline author-bio",
}
MAIN = "content article post entry main story body text article-body post-content entry-content main-content story-body page-content blog-post articleBody".split()
# Words that such parts begin with.
TOLD = frozenset("sponsored advertisement advertisements ad ads promoted promotion copyright subscribe newsletter share follow tags related recommended trending comments comment replies reply cookies cookie login register ©".split())
SEMANTIC = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "notice": "div", "ad": "div", "comments": "section", "share": "div"}


class Maker:
    """Makes pages up. Nodes of main text carry the attribute data-y, which the reader doesn't look at."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choices("bcdfglmnprstvw", k=1) + self.r.choices("aeiou", k=1) + self.r.choices("lnrst ", k=1)).strip() for _ in range(90)]

    def word(self) -> str:
        return "".join(self.r.choices(self.syllables, k=self.r.choice((1, 1, 2, 2, 3))))

    def words(self, low: int, high: int) -> str:
        n, out = self.r.randint(low, high), []
        for i in range(n):
            w = self.word() + ("," if self.r.random() < 0.06 else "")
            out.append(w)
        text = " ".join(out).rstrip(",")
        return text[:1].upper() + text[1:] + "."

    def sentences(self, low: int, high: int) -> str:
        text = " ".join(self.words(3, 16) for _ in range(self.r.randint(low, high)))
        mood = self.r.random()
        if mood < 0.06:
            text = text.upper()
        elif mood < 0.14:
            text = " ".join(w + self.r.choice(["%%%", "***", "$$$", "!!", " |"]) for w in text.split())
        return text

    def attribute(self, names: list[str], chance: float = 0.8) -> str:
        if self.r.random() > chance:
            return ""
        name = self.r.choice(names)
        extra = self.r.choice(["", "", f" {self.word()}", f" {self.word()}-{self.r.randint(1, 9)}", " block", " clearfix", " row"])
        return f' {self.r.choice(["class", "class", "id"])}="{name}{extra}"'

    def unknown(self, chance: float = 0.5) -> str:
        """An attribute that says nothing."""
        return f' {self.r.choice(["class", "id"])}="{self.word()}{self.r.choice(["", "-" + self.word(), "_" + str(self.r.randint(1, 99))])}"' if self.r.random() < chance else ""

    def links(self, low: int, high: int) -> str:
        made = [f'<a href="/{self.word()}">{" ".join(self.word() for _ in range(self.r.choice((1, 1, 2, 4))))}</a>' for _ in range(self.r.randint(low, high))]
        how = self.r.random()
        if how < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in made) + "</ul>"
        return " | ".join(made) if how < 0.8 else "".join(f"<div>{x}</div>" for x in made)

    def other(self, kind: str) -> str:
        r = self.r
        tag = SEMANTIC[kind] if r.random() < 0.65 else r.choice(["div", "div", "section"])
        bare = tag not in ("div", "section")
        head = f"<{tag}{self.attribute(OTHER[kind].split(), 0.5 if bare else 1.0) or self.unknown(0.3)}>"
        if kind in ("nav", "share"):
            body = self.links(3, 9)
        elif kind == "header":
            body = r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 5)}</div>"]) + (self.links(2, 6) if r.random() < 0.6 else f"<p>{self.words(2, 9)}</p>")
        elif kind == "footer":
            body = r.choice([f"&copy; {self.word()}.example.org &middot; {self.sentences(1, 3)}", f"<p>{self.words(3, 14)}</p>{self.links(2, 6)}", f"<div>{self.sentences(1, 3)}</div>"])
        elif kind == "aside":
            body = f"<h3>{self.words(1, 4)}</h3>" * (r.random() < 0.6) + r.choice([self.links(3, 8), f"<p>{self.sentences(1, 4)}</p>", "".join(f"<p><a href='/x'>{self.words(3, 9)}</a></p>" for _ in range(r.randint(2, 6)))])
        elif kind == "form":
            body = f"<p>{self.words(2, 10)}</p><label>{self.word()}</label><input name='q'><button>{self.word()}</button>"
            body = f"<form>{body}</form>" if tag != "form" and r.random() < 0.7 else body
        elif kind == "comments":
            item = r.choice(["li", "div", "article", "p"])
            each = "".join(f"<{item}{self.attribute(['comment', 'reply', 'comment-body'], 0.6)}>{r.choice([f'<b>{self.word()}</b> ', f'<p>{self.word()}</p>', ''])}{r.choice(['', '<p>'])}{self.sentences(1, 5)}</{item}>" for _ in range(r.randint(1, 6)))
            body = f"<h3>{self.words(1, 3)}</h3>" * (r.random() < 0.6) + (f"<ol>{each}</ol>" if item == "li" else each)
        else:
            body = r.choice([self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p>", f"<p>{self.words(3, 12)}</p><button>{self.word()}</button>", f"<a href='/x'>{self.words(2, 8)}</a>"])
        if kind in ("ad", "aside", "form", "comments", "share") and r.random() < 0.35:
            word = r.choice({"ad": ["Sponsored", "Advertisement", "Ad", "Promoted"], "aside": ["Related", "Recommended", "Trending"], "form": ["Subscribe", "Newsletter", "Login"], "comments": ["Comments", "Replies"], "share": ["Share", "Follow", "Tags"]}[kind])
            body = r.choice([f"<h3>{word}</h3>{body}", f"{word}: {body}", f"<p>{word} {self.words(1, 4)}</p>{body}"])
            if kind == "ad" and r.random() < 0.5:
                return f"<div{self.unknown(0.6)}>{word}: {self.sentences(1, 2)}</div>"
        whole = f"{head}{body}</{tag}>"
        return f"<noscript>{whole}</noscript>" if kind == "notice" and r.random() < 0.15 else whole

    def main_block(self) -> str:
        r, y = self.r, " data-y"
        kind = r.random()
        if kind < 0.68:
            return f"<p{y}>{self.sentences(1, 9)}" + "</p>" * (r.random() < 0.9)
        if kind < 0.72:
            return f"<p{y}>{self.word().capitalize()}.</p>"
        if kind < 0.82:
            return f"<h{(h := r.choice('12234'))}{y}>{r.choice([self.words(1, 8), self.word().capitalize()])}</h{h}>"
        if kind < 0.87:
            tag = r.choice(["ul", "ol"])
            low, high = r.choice([(2, 14), (1, 1), (1, 3)])
            return f"<{tag}{y}>" + "".join(f"<li{y}>{self.words(low, high) if high > 1 else self.word()}</li>" for _ in range(r.randint(1, 6))) + f"</{tag}>"
        if kind < 0.91:
            return f"<blockquote{y}>" + r.choice([f"<p{y}>{self.sentences(1, 4)}</p>", self.sentences(1, 4)]) + "</blockquote>"
        if kind < 0.93:
            return f"<table{y}>" + "".join(f"<tr{y}>" + "".join(f"<td{y}>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>"
        if kind < 0.95:
            return f"<pre{y}>{self.sentences(1, 3)}</pre>"
        if kind < 0.955:
            return f"<noscript{y}><p{y}>{self.sentences(1, 6)}</p></noscript>"
        if kind < 0.97:
            return f"<figure{y}><img src='/i.png'><figcaption{y}>{self.words(2, 10)}</figcaption></figure>"
        return f"<div{y}>{self.sentences(1, 6)}{r.choice(['', f'<br>{self.sentences(1, 3)}'])}</div>"

    def inside(self) -> tuple[str, list[str]]:
        """A title, and blocks of main text with other parts among them."""
        r, y = self.r, " data-y"
        blocks = [self.main_block() for _ in range(r.choice((1, 2, 3, 5, 8, 12, 20)))]
        if r.random() < 0.4:
            blocks[0] = f"<p{y}><b>{self.sentences(1, 3)}<br>" + blocks[0]
        if r.random() < 0.15:
            blocks = [f"<p{y}>{r.choice(['<b>', ''])}{self.words(1, 7)}</p>"]
        titles = ["", f"<h1{y}>{self.words(2, 9)}</h1>", f"<h1{y}>{self.words(2, 9)}</h1>", f"<h1{y}>{self.word().capitalize()}</h1>", f"<center{y}><h1{y}>{self.words(1, 5)}</h1></center>", f"<header{y}><h1{y}>{self.words(2, 9)}</h1></header>"]
        return r.choice(titles), blocks

    def mixed(self, blocks: list[str]) -> list[str]:
        blocks = list(blocks)
        for kind in self.r.sample(["ad", "share", "aside", "notice", "form", "comments"], self.r.choice((0, 0, 0, 1, 1, 2))):
            blocks.insert(self.r.randint(1, len(blocks)), self.other(kind))
        return blocks

    def article(self) -> str:
        """Main text in an element of its own; now and then in plain boxes without a name that says so, or with parts of it in boxes."""
        r, y = self.r, " data-y"
        title, blocks = self.inside()
        blocks = self.mixed(blocks)
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        inside = title + "".join(blocks)
        if r.random() < 0.3:
            inside = title + f"<div{self.attribute(MAIN)}{y}>" + "".join(blocks) + "</div>"
        elif r.random() < 0.1:
            cut = r.randint(0, len(blocks))
            inside = title + "".join(blocks[:cut]) + f"<section{self.unknown()}{y}>" + "".join(blocks[cut:]) + "</section>"
        name = self.attribute(MAIN, 0.3 if tag in ("article", "main") else 1.0) if r.random() < 0.75 else self.unknown()
        return f"<{tag}{name}{y}>{inside}" + f"</{tag}>" * (r.random() < 0.97)

    def page(self) -> str:
        r = self.r
        how = r.random()
        if how < 0.14:
            return self.flat()
        if how < 0.2:
            return self.laid_out()
        if how < 0.215:
            return "<!-- data-y -->" + r.choice([self.sentences(1, 4), f"{self.sentences(1, 2)}<p data-y>{self.sentences(1, 4)}</p>", f"{self.words(3, 9)}\n\n{self.sentences(1, 9)}"])
        whole = self.article()
        after = "".join(self.other(k) for k in r.sample(["comments", "aside", "share", "ad", "form", "notice", "nav"], r.choice((0, 0, 1, 2, 3))))
        before = "".join(self.other(k) for k in r.sample(["nav", "notice", "ad", "share", "aside", "form"], r.choice((0, 0, 1, 2))))
        if r.random() < 0.45:
            shell = r.choice(["div", "main", "div"])
            whole = f"<{shell}{self.attribute(['container', 'wrapper', 'layout', 'page', 'site', 'inner'], 0.8)}>{before}{whole}{after}</{shell}>"
        else:
            whole = before + whole + after
        return self.framed(whole)

    def framed(self, whole: str, body: str = "") -> str:
        r = self.r
        top = "".join(self.other(k) for k in r.choice((["nav"], ["nav"], ["header"], ["header", "nav"], ["nav", "ad"], ["notice", "header"], [])))
        end = "".join(self.other(k) for k in r.choice((["footer"], ["footer"], ["footer"], ["aside", "footer"], [], ["notice"])))
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body{body}>{top}{whole}{end}</body></html>"

    def flat(self) -> str:
        """Main text right in the body, some of it in no element at all."""
        title, blocks = self.inside()
        blocks = blocks if self.r.random() < 0.6 else blocks[: self.r.choice((1, 2, 2, 3))]
        blocks = [b if self.r.random() < 0.75 else self.sentences(1, 4) for b in blocks]
        if self.r.random() < 0.3:
            blocks[0] = self.sentences(1, 4)
        title = title if self.r.random() < 0.7 else ""
        if self.r.random() < 0.4:
            return f"<html><body data-y>{title}{''.join(blocks)}</body></html>"
        return self.framed(title + "".join(self.mixed(blocks)), " data-y")

    def laid_out(self) -> str:
        """Columns as cells of a table."""
        title, blocks = self.inside()
        side = f"<td{self.unknown(0.3)}>{self.other(self.r.choice(['nav', 'aside', 'ad']))}</td>"
        own = f"<td{self.unknown(0.3)} data-y>{title}{''.join(self.mixed(blocks))}</td>"
        more = f"<tr><td>{self.other(self.r.choice(['ad', 'footer', 'nav']))}</td></tr>" if self.r.random() < 0.4 else ""
        if self.r.random() < 0.3:
            more = f"<tr><td>{self.r.choice(['Sponsored', 'Advertisement', 'Ad'])}: {self.sentences(1, 1)}</td></tr>"
        return self.framed(f"<table><tr>{''.join(self.r.choice([[side, own], [own, side], [own], [side, own, side]]))}</tr>{more}</table>")


def labelled(source: str) -> tuple[Page, np.ndarray]:
    """A made-up page and which of its nodes are main text: the attribute is read as a token, then taken away."""
    page = read(source.replace(" data-y", ' rel="isy"'))
    y = np.array(["isy" in t for t in page.tokens])
    y[0] = source.startswith("<!-- data-y -->")  # a page without elements, whose text hangs on the root
    page.tokens = [tuple(x for x in t if x != "isy") for t in page.tokens]
    return page, y


@dataclass
class Lexicon:
    """Log-odds of a node being main text, by its tag and by each attribute token. Unseen ones count as 0."""

    tags: dict[str, float]
    tokens: dict[str, float]

    @classmethod
    def learned(cls, pages: list[tuple[Page, np.ndarray]]) -> Lexicon:
        tags, tokens, inside_tags, inside_tokens, total, inside = Counter(), Counter(), Counter(), Counter(), 0, 0
        for page, y in pages:
            total, inside = total + len(y), inside + int(y.sum())
            for tag, own, label in zip(page.tag, page.tokens, y):
                tags[tag] += 1
                tokens.update(own)
                if label:
                    inside_tags[tag] += 1
                    inside_tokens.update(own)
        prior = math.log((inside + 1) / (total - inside + 1))

        def odds(seen: Counter, yes: Counter, least: int) -> dict[str, float]:
            return {k: math.log((yes[k] + 0.5) / (n - yes[k] + 0.5)) - prior for k, n in seen.items() if n >= least}

        return cls(odds(tags, inside_tags, 1), odds(tokens, inside_tokens, 8))


def features(pages: list[Page], lexicon: Lexicon) -> np.ndarray:
    """Rows of all pages' nodes, page after page."""
    out = []
    for page in pages:
        n = len(page.tag)
        tag = np.array([lexicon.tags.get(t, 0.0) for t in page.tag])
        low, high = np.zeros(n), np.zeros(n)
        path_low, path_high, path_tag_low, path_tag_high = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        parent, end, depth = np.array(page.parent), np.array(page.end), np.array(page.depth, float)
        known = lexicon.tokens
        for i, own in enumerate(page.tokens):
            if own:
                odds = [known.get(t, 0.0) for t in own]
                low[i], high[i] = min(0.0, *odds) if len(odds) > 1 else min(0.0, odds[0]), max(0.0, *odds) if len(odds) > 1 else max(0.0, odds[0])
            p = page.parent[i]
            if p >= 0:
                path_low[i], path_high[i] = min(path_low[p], low[i]), max(path_high[p], high[i])
                path_tag_low[i], path_tag_high[i] = min(path_tag_low[p], tag[i]), max(path_tag_high[p], tag[i])
        text, linked, marks, count, longest, told = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for node, block, in_links in page.blocks:
            size = len(block)
            text[node] += size
            linked[node] += min(in_links, size)
            marks[node] += block.count(",") + block.count(".")
            count[node] += 1
            longest[node] = max(longest[node], size)
            told[node] += block.split(None, 1)[0].strip(":.,!|").lower() in TOLD

        index = np.arange(n)

        def below(own: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0.0], np.cumsum(own)])
            return total[end] - total[index]

        whole, links = below(text), below(linked)
        all_text = max(1.0, whole[0])
        paragraphs = below(np.array([t == "p" for t in page.tag], float))
        items = below(np.array([t in ("li", "a") for t in page.tag], float) + np.array(page.links))
        controls = below(np.array(page.controls, float) + np.array([t in ("form", "button") for t in page.tag]))
        seen_before = np.concatenate([[0.0], np.cumsum(text)])[:-1]
        siblings, place, last = np.zeros(n), np.zeros(n), np.full(n, -1)
        before, after = np.zeros(n), np.zeros(n)
        nth: Counter = Counter()
        for i in range(1, n):
            p = page.parent[i]
            place[i] = nth[p]
            nth[p] += 1
            if last[p] >= 0:
                before[i] = whole[last[p]]
                after[last[p]] = whole[i]
            last[p] = i
        for p, c in nth.items():
            siblings[p] = c
        up = np.maximum(parent, 0)
        family = siblings[up]
        out.append(np.stack([
            tag, low, high, path_low, path_high, path_tag_low, path_tag_high, depth, place, family, place / np.maximum(1, family - 1), siblings,
            np.log1p(whole), whole / all_text, links / np.maximum(1, whole), (end - index) / (whole + 20), below(marks) / (whole + 20), below(count), whole / np.maximum(1, below(count)),
            np.log1p(text), np.log1p(longest), paragraphs, items, controls, (seen_before + whole / 2) / all_text, np.log1p(before), np.log1p(after),
            links[up] / np.maximum(1, whole[up]), np.log1p(whole[up]), tag[up], low[up], high[up], paragraphs[up], controls[up], told, below(told) / np.maximum(1, below(count)),
        ], axis=1))
    return np.concatenate(out) if out else np.empty((0, 36))


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Which nodes are content in the likeliest consistent choice: outside, then content, then cut, along every path."""
    n = len(odds)
    inside = np.minimum(0, odds) - np.log1p(np.exp(-np.abs(odds)))  # log p
    outside = inside - odds  # log (1 - p)
    best = [outside.tolist(), inside.tolist(), outside.tolist()]
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        cut, content, out = best[2][i], best[1][i], best[0][i]
        best[0][p] += max(out, content)
        best[1][p] += max(content, cut)
        best[2][p] += cut
    state = [0] * n
    state[0] = 1 if best[1][0] > best[0][0] else 0
    for i in range(1, n):
        up = state[page.parent[i]]
        state[i] = 2 if up == 2 else up if best[up][i] >= best[up + 1][i] else up + 1
    return np.array(state) == 1


@functools.lru_cache(maxsize=2)
def model(pages: int = 2400, seed: int = 11) -> tuple[Lexicon, boosting.Forest]:
    """The lexicon from one half of the made-up pages, the trees from the other, so that unseen names occur there."""
    maker = Maker(seed)
    made = [labelled(maker.page()) for _ in range(pages)]
    lexicon = Lexicon.learned(made[::2])
    rest = made[1::2]
    return lexicon, boosting.fit(features([p for p, _ in rest], lexicon), np.concatenate([y for _, y in rest]).astype(float))


def stored_model(spark: SparkSession) -> tuple[Lexicon, boosting.Forest]:
    """model(), from the shared folder if it is there; else it is fitted and left there. Its name has the sources it comes from."""
    sources = "".join(inspect.getsource(x) for x in (dom, boosting, Maker, Lexicon, labelled, features, model.__wrapped__))
    path = f"{shared_folder(spark)}/textloom/html-trees-{hashlib.sha256(sources.encode()).hexdigest()[:16]}"
    if exists(spark, f"{path}/_SUCCESS"):
        held = json.loads(spark.read.parquet(path).first().model)
        return Lexicon(held["tags"], held["tokens"]), boosting.Forest(*(np.array(held[x]) for x in ("feature", "threshold", "leaf")), held["base"])
    lexicon, forest = model()
    held = {"tags": lexicon.tags, "tokens": lexicon.tokens, "feature": forest.feature.tolist(), "threshold": forest.threshold.tolist(), "leaf": forest.leaf.tolist(), "base": forest.base}
    spark.createDataFrame([(json.dumps(held),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)
    return lexicon, forest


def main_text(pages: list[Page], lexicon: Lexicon, forest: boosting.Forest) -> list[str]:
    odds = forest.margin(features(pages, lexicon))
    out, at = [], 0
    for page in pages:
        content = decode(page, odds[at : at + len(page.tag)])
        at += len(page.tag)
        out.append("\n\n".join(block for node, block, _ in page.blocks if content[node]))
    return out


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points of the text) of every page. The trees (some 100 KB) go along with the task."""
    lexicon, forest = stored_model(pages.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html", 2 << 20):
                found = main_text([read(x) for x in part["html"].to_pylist()], lexicon, forest)
                yield pa.RecordBatch.from_arrays([part["id"], part["url"], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.coalesce(F.col(html_column), F.lit("")).alias("html"))
    kind = dict(chosen.dtypes)["id"]
    return chosen.mapInArrow(rows, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_column, "url": url_column})
