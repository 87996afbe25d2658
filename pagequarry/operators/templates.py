"""Trees of pages that differ in their texts alone, built once.

Sites write many pages by one template.  A page of plain tags whose tags say the
same as those of an earlier page, as far as the reader of main content asks, gets
that page's tree with its own texts in it, and what follows from the tags alone
is worked out once (`Tree.memo`).  Other pages are read as they come.
"""

from __future__ import annotations

import functools
import sys

from . import dom

#: templates that are kept, markup that is remembered to see whether it comes again, and tags of a page that may be a template
TEMPLATES, MET, TAGS = 512, 4096, 200


@functools.lru_cache(maxsize=8192)
def _says(markup: str) -> str | None:
    """What a tag says to the reader of main content; None where it isn't plain."""
    kind, tag, attrs = dom._tag(markup)
    return None if kind == dom._ODD else sys.intern(repr((kind, tag, *map(attrs.get, ("class", "id", "role")))))


class Template:
    """A page's tree, with the places of the page's texts among its nodes' children and its pieces."""

    __slots__ = ("children", "pieces", "root")

    def __init__(self, root: dom.Node, texts: int):
        self.root, mark = root, {f"\0{i}\0": i for i in range(texts)}
        self.children = [(n, at, mark[c], n.tag in dom._RAW) for n in root.tree for at, c in enumerate(n.children) if isinstance(c, str) and c in mark]
        self.pieces = [(at, mark[p]) for at, p in enumerate(root.tree.pieces) if p in mark]
        root.tree.memo = {}

    def of(self, texts: list[str]) -> dom.Node:
        tree = self.root.tree
        for n in tree:
            n.said = None
        tree.json, pieces, read = None, tree.pieces, texts
        if any("&" in t for t in texts):
            read = [dom.decoded(t) for t in texts]
        for n, at, i, raw in self.children:
            n.children[at] = texts[i] if raw else read[i]
        for at, i in self.pieces:
            pieces[at] = read[i]
        return self.root


def _template(parts: list[str]) -> Template | None:
    """The template of a page, or nothing where a text doesn't stand alone, as in scripts that have tags."""
    marked = "".join(x if i % 2 or not x else f"\0{i // 2}\0" for i, x in enumerate(parts))
    root = dom._plain(marked)
    if root is None:
        return None
    found = Template(root, len(parts) // 2 + 1)
    return found if sorted(i for _, _, i, _ in found.children) == [i for i, x in enumerate(parts[::2]) if x] else None


_KEPT: dict[tuple, Template | None] = {}
_MET: dict[int, None] = {}


def tree_of(html: str) -> dom.Node:
    """A page's tree, whose tags may have the attributes of a like page's but for class, id and role; it holds until the next one is read."""
    parts = dom._MARKUP.split(html)
    texts = parts[::2]
    if len(texts) > TAGS or html.count("<") >= len(texts):  # a text has one
        return dom.parse(html)
    key = (*map(_says, parts[1::2]), *map(bool, texts))
    if None in key:
        return dom.parse(html)
    template = _KEPT.get(key)
    if template is None and key not in _KEPT:
        met = hash(key)
        if met not in _MET:
            if len(_MET) >= MET:
                _MET.pop(next(iter(_MET)))
            _MET[met] = None
            return dom.parse(html)
        if len(_KEPT) >= TEMPLATES:
            _KEPT.pop(next(iter(_KEPT)))
        template = _KEPT[key] = _template(parts)
    return dom.parse(html) if template is None else template.of(texts)
