"""The main content of a page by scores of its blocks.

Paragraphs give points to what holds them: to their parent all, to its parent
half, further up less.  What a container has is weighed by the share of its text
outside links; the best one is the content, together with siblings that come near
it or read like prose.  Names of classes and identifiers leave page furniture out
first; where too little is left, everything is scored again with it, and where
that is too little as well, the declared main content stands in.
"""

from __future__ import annotations

import functools
import re

from .dom import HIDDEN, Node, by_tags, fallback_content, relation

#: characters of text that content has at least
ENOUGH = 120
# Names of furniture, names that speak for content, and what tags and names are worth.
FURNITURE = re.compile(r"(?:^|[\s_-])ads?(?:$|[\s_-])|advert|banner|breadcrumb|comment|community|cookie|disqus|footer|gdpr|header|legends|menu|nav|pager|pagination|popup|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|widget", re.I)
CONTENT = re.compile(r"article|body|column|content|main|shadow|story", re.I)
PRAISED = re.compile(r"article|body|content|entry|hentry|main|page|post|text|blog|story", re.I)
BLAMED = re.compile(r"hidden|banner|combx|comment|contact|foot|masthead|media|meta|outbrain|promo|related|scroll|share|sidebar|skyscraper|sponsor|shopping|tags|widget", re.I)
WORTH = {"div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header img li main nav ol p pre section table ul".split())
PROSE, LEVELS = frozenset({"p", "td", "pre"}), 5
MAY_BE_PROSE = PROSE | {"div", "section"}


def _names(n: Node) -> str:
    return f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}" if n.attrs else " "


@functools.lru_cache(maxsize=4096)
def _of_furniture(names: str) -> bool:
    return bool(FURNITURE.search(names)) and not CONTENT.search(names)


@functools.lru_cache(maxsize=4096)
def _weight(names: str) -> int:
    return 25 * (bool(PRAISED.search(names)) - bool(BLAMED.search(names)))


def _furniture(n: Node) -> bool:
    if n.tag in ("nav", "footer", "aside"):
        return True
    return bool(n.attrs) and n.tag not in ("body", "html", "article", "main", "a") and _of_furniture(_names(n))


@by_tags
def _visible(top: Node, strict: bool) -> list[Node]:
    """The nodes in document order, without what is hidden, and without furniture where strict."""
    tree, at, end, out = top.tree, top.at, top.end, []
    while at < end:
        n = tree[at]
        if n.tag in HIDDEN or strict and n is not top and (n.attrs or n.tag in ("nav", "footer", "aside")) and _furniture(n):
            at = n.end
            continue
        out.append(n)
        at += 1
    return out


@by_tags
def _prose(n: Node) -> bool:
    return n.tag in PROSE or n.tag in ("div", "section") and BLOCKS.isdisjoint([x.tag for x in n.tree[n.at + 1 : n.end]])


@by_tags
def _links(n: Node) -> list[Node]:
    return n.find("a")


def _link_share(n: Node) -> float:
    links = _links(n)
    whole = len(n.text()) if links else 0
    return sum(len(a.text()) for a in links) / whole if whole else 0.0


def _start(n: Node, strict: bool) -> float:
    return WORTH.get(n.tag, 0) + (_weight(_names(n)) if strict and n.attrs and _names(n).strip() else 0)


@by_tags
def _held_by(n: Node, strict: bool) -> list[tuple[float, int, Node]]:
    """The containers of a node that share its points: (where they start, by what points are divided, container)."""
    out = []
    for level, above in zip(range(LEVELS), n.above(), strict=False):
        if above.parent is None:
            break
        out.append((_start(above, strict), 1 if level == 0 else 2 if level == 1 else 3 * level, above))
    return out


@by_tags
def _may_score(body: Node, strict: bool) -> list[Node]:
    return [n for n in _visible(body, strict) if n.tag in MAY_BE_PROSE]


def _scored(body: Node, strict: bool) -> list[tuple[float, Node]]:
    """The containers with their scores, the first in the document first."""
    scores: dict[int, list] = {}
    for n in _may_score(body, strict):
        if len(text := n.text()) < 25 or not _prose(n):
            continue
        points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) // 100, 3)
        for start, share, above in _held_by(n, strict):
            held = scores.get(id(above))
            if held is None:
                held = scores[id(above)] = [start, above]
            held[0] += points / share
    return [(score * (1 - _link_share(n)), n) for score, n in scores.values()]


def _joins(n: Node, best: Node, scores: dict[int, float], least: float) -> bool:
    """Whether a sibling of the best container belongs to the content."""
    same = n.attrs.get("class") and n.attrs.get("class") == best.attrs.get("class")
    if scores.get(id(n), 0.0) + (0.2 * scores[id(best)] if same else 0) >= least:
        return True
    if n.tag != "p":
        return False
    text, share = n.text(), _link_share(n)
    return len(text) > 80 and share < 0.25 or 0 < len(text) <= 80 and share == 0 and bool(re.search(r"\.( |$)", text))


@by_tags
def _own(top: Node, strict: bool) -> tuple[list[Node], list[Node]]:
    """Of what is visible: the nodes that hold something, and those that are blocks."""
    seen = _visible(top, strict)
    return [n for n in seen if n.children], [n for n in seen if n.tag in ("p", "li", "blockquote") or n.tag in ("div", "section") and _prose(n)]


@by_tags
def _beside(best: Node, strict: bool) -> list[Node]:
    """A container and those of its siblings that may join it."""
    return [n for n in (best.parent.children if best.parent else [best]) if isinstance(n, Node) and (n is best or not (strict and _furniture(n)) and n.tag not in HIDDEN)]


def _by_scores(body: Node, strict: bool) -> list[tuple[str, str]] | None:
    """The blocks of the best container and what belongs to it; None where that is too little."""
    scored = _scored(body, strict)
    if not scored:
        return None
    most, best = max(scored, key=lambda x: x[0])
    by, least = {id(n): s for s, n in scored}, max(10.0, 0.2 * most)
    parts = [n for n in _beside(best, strict) if n is best or _joins(n, best, by, least)]
    own = [_own(p, strict) for p in parts]
    missing = ENOUGH
    for n in (n for held, _ in own for n in held):
        missing -= len(" ".join(n.raw().split()))
        if missing <= 0:
            break
    else:
        return None
    blocks = [(n.tag, text) for _, found in own for n in found if (text := n.text())]
    return blocks or [("text", p.text()) for p in parts]


@by_tags
def _declares(root: Node) -> bool:
    return root.first("main", "article") is not None or any(n.attrs.get("role") == "main" for n in root.walk())


def content(root: Node) -> tuple[list[tuple[str, str]], bool]:
    """(tag, text) blocks of the main content, and whether they were found by scores."""
    body = root.first("body") or root
    for strict in (True, False):
        if (blocks := _by_scores(body, strict)) is not None:
            return blocks, True
        if strict and _declares(root) and (declared := fallback_content(root)):
            return declared, False
    return fallback_content(root), False


@relation("tag: string, text: string, scored: boolean")
def main_blocks(root: Node) -> list[tuple]:
    """Blocks of the main content as read by scores, or of the declared one."""
    blocks, scored = content(root)
    return [(*b, scored) for b in blocks]
