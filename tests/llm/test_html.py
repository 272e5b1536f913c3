"""Operator 3 against a plain version: another parser, open elements searched one by one, neighbours looked up pair by pair."""

from __future__ import annotations

import random
import re
import time
from html.parser import HTMLParser

from quirework.llm import html_text as ht

BOUNDARY = "ul ol dl table article section div main nav aside footer header form body html".split()
CLOSES = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"]}


class Plain(HTMLParser):
    """Blocks as [text, link characters, dropped, in article, heading]; every search walks the whole stack."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.stack, self.found, self.now = [], [], None

    def inside(self, *names):
        return any(n in names for n, _ in self.stack)

    def handle_starttag(self, name, attrs):
        if name in ht.BLOCK:
            self.now = None
        elif name == "br":
            self.handle_data(" ")
        if name in ht.VOID:
            return
        wanted = CLOSES.get(name, []) + (["p"] if name in ht._P_CLOSERS else [])
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in wanted:
                del self.stack[k:]
                break
            if self.stack[k][0] in BOUNDARY:
                break
        article = self.inside("article", "main")
        drop = name not in ("article", "main") and (name in ht.DROPPED or (name == "header" and not article) or any(ht.MARKED.search(v or "") for k, v in attrs if k in ("class", "id")))
        self.stack.append((name, drop))

    def handle_endtag(self, name):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                del self.stack[k:]
                break
            if self.stack[k][0] in BOUNDARY and name not in BOUNDARY:
                break
        if name in ht.BLOCK:
            self.now = None

    def handle_data(self, data):
        if self.now is None:
            if data.isspace():
                return
            heading = any(re.fullmatch("h[1-6]", n) for n, _ in self.stack)
            self.now = ["", 0, any(d for _, d in self.stack), self.inside("article", "main"), heading]
            self.found.append(self.now)
        self.now[0] += data
        if self.inside("a"):
            self.now[1] += len(data.strip())

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")


def label(text, links, article, heading):
    """Good (1), bad (0), likely (2), open (3), in the order of the rules."""
    if links > 0.33 * len(text):
        return 0
    if len(text) < 70:
        return 2 if heading else 3
    words = [w.strip(".,;:!?\"'()[]{}*#%$&|<>-").lower() for w in text.split()]
    density = len([w for w in words if w in ht.WORDS]) / len(words)
    if len(text) >= 200:
        return 1 if density >= 0.15 or article else 0
    return 2 if density >= 0.15 or article else 0


def plain_text(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    blocks = [(" ".join(ht.html.unescape(b[0]).split()), *b[1:]) for b in parser.found]
    blocks = [b for b in blocks if b[0] and not b[2]]
    if any(b[3] for b in blocks):
        blocks = [b for b in blocks if b[3]]
    labels = [label(b[0], b[1], b[3], b[4]) for b in blocks]
    kept = []
    for i, (b, x) in enumerate(zip(blocks, labels, strict=True)):
        sides = [[(abs(i - j), labels[j]) for j in way if labels[j] < 2][:1] for way in (range(i - 1, -1, -1), range(i + 1, len(labels)))]
        near = sides[0] + sides[1]
        if x < 2:
            keep = x == 1
        elif not near:
            keep = b[3] or x == 2
        elif x == 2 and (1 in [y for _, y in near] or b[3]):
            keep = True
        else:
            keep = 1 in [y for d, y in near if d == min(near)[0]]
        if keep:
            kept.append(b[0])
    return "\n".join(kept)


def soup(r):
    names = "p div li ul b i a article nav h2 td tr table span section dt dd main header aside form".split()
    prose = ["the story of the town and the river that was in the north ", "brelka vomtra quendis altrumo pesk ", "short ", "x &amp; y ", "\n ", ""]
    out = []
    for _ in range(r.randrange(60)):
        n = r.choice(names)
        out.append(r.choice([f"<{n}>", f"</{n}>", f'<{n} class="{r.choice(["sidebar", "text", "promo box"])}">', "<br>", r.choice(prose) * r.randrange(9)]))
    return "".join(out)


def test_main_text_against_a_plain_version():
    r = random.Random(12)
    for _ in range(1500):
        page = soup(r)
        assert ht.main_text(page) == plain_text(page), page


def test_ten_megabytes_of_odd_tags():
    began = time.time()
    for page in ("<b>" * 1_400_000 + "</i>" * 1_400_000, "<li><ul>" + "<b>" * 700_000 + "<li></li>" * 800_000, "<p><div>" * 1_250_000):
        assert ht.main_text(page) == ""
    assert time.time() - began < 90
