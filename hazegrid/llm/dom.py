"""HTML to a tree of blocks with their text: one pass over the whole page, linear in its length.

Block elements are nodes, in page order; inline elements only mark links. A *run* is the text between two block borders,
with character references decoded and white space collapsed. Contents of scripts, styles, form controls, templates and
embedded objects are no text. Elements that HTML closes by itself (paragraphs, list items, cells, headings) are closed; an
end tag without its start is skipped; what an unclosed comment or tag swallows in HTML is swallowed here.
"""

from __future__ import annotations

import html
import re

_SPACE = r"[\x20\x09\x0A\x0C\x0D]"
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\x20\x09\x0A\x0C\x0D/>]*+)((?:[\x20\x09\x0A\x0C\x0D/]++|=|[^\x20\x09\x0A\x0C\x0D/>=]++(?:{_SPACE}*+={_SPACE}*+(?:\"[^\"]*+\"|'[^']*+'|[^\x20\x09\x0A\x0C\x0D>\"'][^\x20\x09\x0A\x0C\x0D>]*+)?+)?+)*+)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
DEAD = frozenset("head noscript template svg math object audio video canvas select datalist button textarea title script style iframe xmp noembed noframes map".split())
CONTROLS = frozenset("input select textarea button option fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_KEEPS_P = frozenset("body html tr td th tbody thead tfoot caption colgroup".split())
_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
         "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th"), **{h: tuple(HEADINGS) for h in HEADINGS}}
_FENCE = frozenset("ul ol dl table select html body".split())
_SCOPE = frozenset("td th caption table button object html".split())
_NEAR = 64  # levels looked up for an element that closes by itself


class Page:
    """Nodes in page order: ``tag``, ``parent`` (-1: none), ``stop`` (one behind the last descendant), ``words`` of their attributes,
    ``mark`` (value of data-label, inherited). Runs in page order: ``run_node``, ``run_text``, ``run_linked`` (characters in links)."""

    __slots__ = ("tag", "parent", "stop", "words", "mark", "controls", "run_node", "run_text", "run_linked")

    def __init__(self, source: str):
        self.tag, self.parent, self.stop, self.words, self.mark, self.controls = ["html"], [-1], [1], [()], [None], [0]
        self.run_node, self.run_text, self.run_linked = [], [], []
        _read(self, source)


def _read(page: Page, source: str) -> None:
    stack = [0]
    count = {"html": 1}  # open elements by tag
    paragraphs = [0]  # open paragraphs in each nested scope
    dead = 0
    link: int | None = None  # node in which the open link began
    held: list[str] = []
    linked = 0

    def close_run() -> None:
        nonlocal held, linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                page.run_node.append(stack[-1])
                page.run_text.append(text)
                page.run_linked.append(min(linked, len(text)))
            held, linked = [], 0

    def pop() -> str:
        nonlocal dead, link
        close_run()
        node = stack.pop()
        tag = page.tag[node]
        page.stop[node] = len(page.tag)
        count[tag] -= 1
        dead -= tag in DEAD
        if tag in _SCOPE:
            paragraphs.pop()
        if tag == "p":
            paragraphs[-1] -= 1
        if link is not None and link == node:
            link = None
        return tag

    def text(piece: str) -> None:
        nonlocal linked
        if not dead:
            piece = html.unescape(piece) if "&" in piece else piece
            held.append(piece)
            if link is not None:
                linked += len(piece.strip())

    at = 0
    while True:
        lt = source.find("<", at)
        if lt < 0:
            text(source[at:])
            break
        if lt > at:
            text(source[at:lt])
        m = _TAG.match(source, lt)
        if m is None:
            after = source[lt + 1:lt + 2]
            if source.startswith("<!--", lt):
                end = lt + 4 if source.startswith((">", "->"), lt + 4) else source.find("-->", lt + 4)
                end = source.find(">", end) if end >= 0 else -1
            elif after and after in "!?/":
                end = source.find(">", lt)
            elif after.isascii() and after.isalpha():
                end = -1
            else:
                text("<")
                at = lt + 1
                continue
            if end < 0:
                break
            at = end + 1
            continue
        at = m.end()
        tag = m.group(2).lower()
        if m.group(1):
            if tag == "a":
                link = None
            elif tag not in INLINE and tag not in ("html", "body") and count.get(tag):
                while pop() != tag:
                    pass
            continue
        if tag in INLINE:
            if tag == "a":
                link = stack[-1]
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close_run()
            page.controls[stack[-1]] += tag == "input"
            continue
        if tag in ("html", "body"):
            if tag == "html" or count.get("body"):
                continue
            while page.tag[stack[-1]] == "head":
                pop()
        if paragraphs[-1] and tag not in _KEEPS_P:
            while pop() != "p":
                pass
        if tag in _SELF:
            for back in range(1, min(len(stack), _NEAR) + 1):
                other = page.tag[stack[-back]]
                if other in _SELF[tag]:
                    for _ in range(back):
                        pop()
                    if tag in ("tr", "tbody", "tfoot"):  # cells, rows and groups close together
                        while page.tag[stack[-1]] in _SELF[tag]:
                            pop()
                    break
                if other in _FENCE or (tag in HEADINGS):
                    break
        close_run()
        node = len(page.tag)
        above = stack[-1]
        words, mark = (), page.mark[above]
        if m.group(3).strip():
            words, label = _attributes(m.group(3))
            mark = label or mark
        page.tag.append(tag)
        page.parent.append(above)
        page.stop.append(node + 1)
        page.words.append(words)
        page.mark.append(mark)
        page.controls.append(int(tag in CONTROLS))
        stack.append(node)
        count[tag] = count.get(tag, 0) + 1
        dead += tag in DEAD
        if tag in _SCOPE:
            paragraphs.append(0)
        if tag == "p":
            paragraphs[-1] += 1
        if tag in _RAW:
            end = _RAW[tag].search(source, at)
            if end is None:
                break
            at = end.start()
    while stack:
        pop() if page.tag[stack[-1]] != "html" or len(stack) > 1 else (close_run(), stack.pop())
    page.stop[0] = len(page.tag)


def _attributes(text: str) -> tuple[tuple[str, ...], str | None]:
    """Words of class, id, role and the like, and the label that training pages carry."""
    words, label = set(), None
    for m in _ATTRIBUTE.finditer(text):
        name = m.group(1).lower()
        value = m.group(2) or m.group(3) or m.group(4) or ""
        if name in ("class", "id", "role", "itemprop", "itemtype", "aria-label"):
            words.update(w.lower() for w in _WORD.findall(value))
        elif name == "data-label":
            label = value
        elif name in ("hidden", "aria-hidden"):
            words.add("hidden")
    return tuple(sorted(words)), label
