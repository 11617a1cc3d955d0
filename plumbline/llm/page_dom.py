"""Pages as trees of block elements and text runs, and the features of their nodes."""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTES = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Elements whose content is never text of the page, elements that stand alone, and elements that break a line of text.
SILENT = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "object", "svg", "math", "canvas", "audio", "video", "select", "datalist"}
RAW = {"script", "style", "title", "textarea", "iframe", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: What an opening tag ends, up to an element that shields it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set()), "option": ({"option"}, {"select"})}
KINDS = {t: k for k, ts in enumerate((("html", "body"), ("article", "main"), ("section",), ("div", "center"), ("nav", "menu"), ("header", "hgroup"), ("footer",), ("aside", "dialog"), ("form", "fieldset", "legend", "button", "option", "search"), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("p", "pre", "blockquote"), ("ul", "ol", "dl", "dir"), ("li", "dd", "dt"), ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("figure", "figcaption", "details", "summary", "address"))) for t in ts}
N_KINDS = 17
#: Attribute tokens by what they tell of an element.
TOLD = {
    w: k
    for k, ws in enumerate((
        "article content main post entry story body text prose page read",
        "nav navigation menu navbar breadcrumb breadcrumbs toc pagination pager links tabs",
        "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner partner teaser",
        "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe paywall disclaimer warning message",
        "comment comments reply replies discussion respond disqus feedback reader responses thread",
        "sidebar side aside widget related recommended trending popular rail secondary complementary",
        "footer foot copyright legal contentinfo colophon bottom",
        "header head masthead topbar logo brand top banner site",
        "share social follow tags meta byline author date print tools",
        "form search login signup signin register contact survey",
    ))
    for w in ws.split()
}
N_TOLD = 10


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    told: int = 0
    text: str = ""
    links: int = 0
    start: int = 0
    below: list[int] = field(default_factory=list)


def told_by(attributes: str) -> int:
    """Bits of TOLD for the words of an element's class, id, role and label."""
    out = 0
    for name, *values in ATTRIBUTES.findall(attributes):
        if name.lower() in ("class", "id", "role", "aria-label", "itemprop"):
            for w in WORDS.findall(html.unescape("".join(values))):
                k = TOLD.get(w.lower())
                if k is not None:
                    out |= 1 << k
    return out


def parse(page: str) -> list[Node]:
    """Nodes in page order, each after its parent; the first is the page. Text runs have the tag ''.

    A run is what stands between two breaks of a block: its references decoded, its white space folded. Tags left
    open, unmatched, cut off or out of place never fail: an end tag ends the nearest element of its name, if any.
    """
    nodes = [Node("html", -1, 0)]
    stack = [0]
    run: list[str] = []
    links = in_link = 0
    silent: list[str] = []
    opened: dict[str, int] = {}

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            top = stack[-1]
            nodes[top].below.append(len(nodes))
            nodes.append(Node("", top, nodes[top].depth + 1, 0, text, min(links, len(text)), at))
        links = 0

    def words(raw: str) -> None:
        nonlocal links
        if raw and not silent:
            text = html.unescape(raw) if "&" in raw else raw
            run.append(text)
            if in_link:
                links += len(text.strip())

    def close(names: set[str], shields: set[str]) -> None:
        if not any(opened.get(x) for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in names:
                flush()
                for j in stack[k:]:
                    opened[nodes[j].tag] -= 1
                del stack[k:]
                return
            if tag in shields:
                return

    at = 0
    for m in iter(lambda: TOKEN.search(page, at), None):
        words(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ending, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if silent:
            if tag == silent[-1]:
                if ending:
                    silent.pop()
                elif not attributes.endswith("/"):
                    silent.append(tag)
            continue
        if tag in SILENT:
            if not ending and not attributes.endswith("/"):
                if tag in RAW:
                    end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
                else:
                    silent.append(tag)
            continue
        if tag in VOID:
            if tag == "br":
                run.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag not in BLOCKS:
            if tag == "a":
                in_link = not ending
            continue
        flush()
        in_link = False
        if tag == "html":
            if not ending:
                nodes[0].told |= told_by(attributes)
            continue
        if ending:
            close({tag}, set())
            continue
        close({"p"}, {"table", "td", "th", "button", "caption"}) if tag not in ("button", "option") else None
        if tag in ENDS:
            close(*ENDS[tag])
        nodes[stack[-1]].below.append(len(nodes))
        nodes.append(Node(tag, stack[-1], nodes[stack[-1]].depth + 1, told_by(attributes) if attributes else 0, start=m.start()))
        stack.append(len(nodes) - 1)
        opened[tag] = opened.get(tag, 0) + 1
    words(page[at:])
    flush()
    return nodes


def features(nodes: list[Node], size: int) -> list[list[float]]:
    """One row a node: its subtree's text, links, punctuation and density, attribute words of its own and above it, depth, and how it compares with its siblings."""
    n = len(nodes)
    chars, links, stops, runs, elements, word_count, end = ([0.0] * n for _ in range(7))
    for k in range(n - 1, -1, -1):
        x = nodes[k]
        if x.tag == "":
            t = x.text
            chars[k], links[k], runs[k], word_count[k] = len(t), x.links, 1, t.count(" ") + 1
            stops[k] = t.count(".") + t.count(",") + t.count("!") + t.count("?") + t.count(";")
            end[k] = x.start
        else:
            elements[k] += 1
            end[k] = max(end[k], x.start)
        if x.parent >= 0:
            for sums in (chars, links, stops, runs, elements, word_count):
                sums[x.parent] += sums[k]
            end[x.parent] = max(end[x.parent], end[k])
    above, kinds_above, places, alike_n, biggest_n = ([0] * n for _ in range(5))
    for x in nodes:
        of_tag: dict[str, int] = {}
        for c in x.below:
            of_tag[nodes[c].tag] = of_tag.get(nodes[c].tag, 0) + 1
        most = max((chars[c] for c in x.below), default=0)
        for place, c in enumerate(x.below):
            places[c], alike_n[c], biggest_n[c] = place, of_tag[nodes[c].tag], most
    out = []
    total = max(1.0, chars[0])
    for k, x in enumerate(nodes):
        kind = KINDS.get(x.tag, N_KINDS - 1)
        p = max(x.parent, 0)
        if k:
            above[k] = above[p] | nodes[p].told
            kinds_above[k] = kinds_above[p] | 1 << KINDS.get(nodes[p].tag, N_KINDS - 1)
        siblings = nodes[p].below if k else [0]
        place, alike, biggest = places[k], alike_n[k], biggest_n[k]
        before = nodes[siblings[place - 1]] if place else None
        first = x.text[:1] if x.tag == "" else ""
        out.append([
            kind, KINDS.get(nodes[p].tag, N_KINDS - 1), x.depth, math.log1p(chars[k]), links[k] / max(1.0, chars[k]), stops[k] / max(1.0, word_count[k]), word_count[k] / max(1.0, runs[k]), math.log1p(runs[k]), math.log1p(elements[k]),
            chars[k] / max(1.0, end[k] - x.start + 1 if x.tag else chars[k] + 20), chars[k] / total, chars[k] / max(1.0, chars[p]), chars[k] / max(1.0, biggest), place, place / max(1, len(siblings) - 1), math.log1p(len(siblings)), alike / len(siblings),
            x.start / max(1, size), len(x.below), KINDS.get(before.tag, N_KINDS - 1) if before else -1, links[p] / max(1.0, chars[p]), word_count[p] / max(1.0, runs[p]), stops[p] / max(1.0, word_count[p]), float(first in "©®™»›|" and first != ""),
            *[float(x.told >> b & 1) for b in range(N_TOLD)], *[float(above[k] >> b & 1) for b in range(N_TOLD)], *[float(kinds_above[k] >> b & 1) for b in (1, 4, 5, 6, 7, 8, 12, 13)],
        ])
    return out
