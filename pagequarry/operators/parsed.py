"""One parse of a page, many relations.

`parse` reads each page's markup once and gives the rows of all relations asked
for as one table: (the page's columns, relation, pos, a struct for each relation,
of which the row's own is set).  Scripts give their data before any text is read,
text never holds scripts, and a heading that names an offer is no person.  `of`
gives one relation's rows.  Where several relations of many pages are needed at
different times, `write` lays the rows down by relation, and what reads one
relation later reads its files alone.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType

from ..functions import matcher
from . import dom, readability, templates

#: in the order in which a page is read: declared data, then structure, then text
RELATIONS = {
    "json_ld": dom.json_ld, "meta": dom.meta_tags, "logo": dom.logos, "cta": dom.calls_to_action, "reference": dom.third_party_refs, "language": dom.languages, "credential": dom.credential_texts, "navigation": dom.nav_links,
    "offer": dom.offerings, "person": dom.people, "testimonial": dom.testimonials, "question": dom.questions, "contact": dom.contacts, "title": dom.title, "heading": dom.headings, "item": dom.list_items, "main": readability.main_blocks,
}


def _read(root: dom.Node, wanted: list[str]) -> Iterable[tuple[str, list[tuple]]]:
    """The wanted relations' rows, relation by relation."""
    offers: set[str] = set()
    for name in (n for n in RELATIONS if n in wanted or n == "offer" and "person" in wanted):
        rows = RELATIONS[name].of_tree(root)
        if name == "offer":
            offers = {r[0].strip().lower() for r in rows if r[0]}
        if name == "person":
            rows = [r for r in rows if (r[0] or "").strip().lower() not in offers]
        if name in wanted:
            yield name, rows


def _facts(root: dom.Node, wanted: list[str]) -> Iterable[tuple[str, int, dict]]:
    for name, rows in _read(root, wanted):
        yield from ((name, pos, dict(zip(RELATIONS[name].names, r, strict=True))) for pos, r in enumerate(rows))


#: what stands in all markup that gives rows of a relation, in lower case; relations that aren't named may come from any markup
_HEADED = ("<h1", "<h2", "<h3", "<h4")
MARKS = {
    "meta": ("<meta",), "title": ("<title",), "heading": _HEADED, "item": ("<li",), "testimonial": ("<blockquote", "testimonial", "review", "quote-card"), "question": ("question", "<details", "accordion", "faq", "<strong", *_HEADED[1:]),
    "person": ("person", "team-member", "staff-member", "team-card", *_HEADED[1:]), "offer": ("product", "service", "offer", "menuitem", "course", "event", *_HEADED[1:]),
}
#: relations that need some elements' attributes and text alone, with these elements, and what in lower-case markup asks for the whole tree nevertheless; references in attributes may hide it
SKIMMED = {
    "json_ld": (frozenset({"script"}), None), "reference": (frozenset({"script", "iframe", "link"}), None), "meta": (frozenset({"meta"}), None), "title": (frozenset({"title"}), None), "credential": (frozenset({"footer"}), dom.MAY_BE_CREDENTIAL),
    "offer": (frozenset({"script"}), re.compile("<h[23]|<h4.*<[^<>]*(?:product|service|offer|pricing-card|menu-item)|<[^<>]*(?:product|service|offer|pricing-card|menu-item).*<h4", re.S)),
}
_TAG_REFERENCE = re.compile("<[^<>]*&")
#: letters may hide in references and in JSON's escapes
_ESCAPES = ("&#", "\\u")
#: characters of markup whose rows are handed on at once, however many pages a batch has
CHUNK = 1 << 20


def tree_of(html: str, wanted: list[str]) -> dom.Node:
    """As much of a page's tree as the wanted relations are read from."""
    if all(n in SKIMMED for n in wanted):
        low, odd = html.lower(), [x for x in (SKIMMED[n][1] for n in wanted) if x is not None]
        if not odd or not (_TAG_REFERENCE.search(low) if "&" in low else None) and not any(x.search(low) for x in odd):
            root = dom.skim(html, frozenset().union(*(SKIMMED[n][0] for n in wanted)))
            if root is not None:
                return root
    return templates.tree_of(html) if wanted == ["main"] else dom.parse(html)


def may_have(html: str, marks: frozenset[str]) -> bool:
    """Whether a page's markup can give rows, told without reading it as a tree."""
    if not marks or any(e in html for e in _ESCAPES):
        return True
    low = html.lower()
    return any(m in low for m in marks)


#: whole pages of plain tags, and the elements whose text is hidden or raw
_ALL_PLAIN = re.compile(rf"(?:[^<]++|<{dom.NAMED}{dom.ATTRS}/?+>|</{dom.NAMED}\s*+>|<!--[^-<>]++-->|<![dD][oO][cC][tT][yY][pP][eE][^<>]*+>)*+")
_HIDDEN_TAG = re.compile(rf"</?(?:{'|'.join(sorted(dom.HIDDEN))})(?![a-z0-9-])[^<>]*>")
_TAG = re.compile("<[^<>]*>")


class Said:
    """Whether a page's text may have any of some phrases, in any case and with any white space, told without reading it as a tree."""

    def __init__(self, phrases: Iterable[str]):
        all_ = {"".join(p.lower().split()) for p in phrases}
        self.phrases = tuple((p, i) for i, p in enumerate(sorted(all_)) if p)
        self.begun = tuple(sorted({p[:i] for p in all_ for i in range(1, len(p))}))

    def may_be_in(self, html: str) -> bool:
        # what is hidden may stand between two parts of a phrase, and where a tag ends is known of plain ones alone
        if not _ALL_PLAIN.fullmatch(html):
            return True
        parts = _HIDDEN_TAG.split(html.lower())
        for i, part in enumerate(parts):
            said = _TAG.sub("", part)
            for x in (said, dom.decoded(said).lower()) if "&" in said else (said,):
                x = "".join(x.split())
                if next(matcher.automaton(self.phrases).iter(x), None) or i < len(parts) - 1 and x.endswith(self.begun):
                    return True
        return False


def _may_have(html: Column, low: Column, marks: frozenset[str]) -> Column:
    """The same as an expression, so that such pages aren't handed to Python."""
    return functools.reduce(lambda x, y: x | y, [*[F.contains(html, F.lit(e)) for e in _ESCAPES], *[F.contains(low, F.lit(m)) for m in sorted(marks)]])


def parse(pages: DataFrame, relations: Iterable[str] | None = None, html: str = "html", saying: dict[str, Iterable[str]] | None = None) -> DataFrame:
    """The rows of the relations (all, if none is named) over the pages' markup, which goes; null markup gives no rows.

    saying: phrases for relations whose rows are asked for only where they have one of these; pages that can't may give none of the relation's rows.
    """
    asked = {n: Said(p) for n, p in (saying or {}).items()}
    wanted = [n for n in RELATIONS if relations is None or n in set(relations)]
    marks = frozenset(m for n in wanted for m in MARKS[n]) if all(n in MARKS for n in wanted) else frozenset()
    kind = ", ".join(f"{n}: struct<{RELATIONS[n].schema}>" for n in wanted)
    schema = StructType.fromDDL(f"relation: string, pos: int, {kind}")
    types = [to_arrow_type(schema[n].dataType) for n in wanted]

    def table_of(chunk: list[str | None]) -> pa.Array:
        """An array of rows for each page."""
        ends, names, places, rows = [0], [], [], {n: [] for n in wanted}
        for h in chunk:
            if h and may_have(h, marks):
                some = [n for n in wanted if n not in asked or asked[n].may_be_in(h)] if asked else wanted
                root = tree_of(h, some)
                for name, found in _read(root, some):
                    if found:
                        n = len(found)
                        names += [name] * n
                        places += range(n)
                        for other, held in rows.items():
                            held += found if other == name else [None] * n
                root.tree.part()
            ends.append(len(names))
        fields = [pa.array(names, pa.string()), pa.array(places, pa.int32()), *[pa.array(rows[n], t) for n, t in zip(wanted, types, strict=True)]]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=["relation", "pos", *wanted]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            held, size = [], 0
            for h in column.to_pylist():
                held.append(h)
                size += len(h or "")
                if size >= CHUNK:
                    yield table_of(held)
                    held, size = [], 0
            if held:
                yield table_of(held)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    facts = F.arrow_udf(run, ArrayType(schema))
    kept = [c for c in pages.columns if c != html]
    read = F.col(html)
    if marks:
        pages = pages.withColumn("__low", F.lower(html))
        read = F.when(_may_have(F.col(html), F.col("__low"), marks), F.col(html))
    return pages.select(*kept, F.explode(facts(read)).alias("__fact")).select(*kept, "__fact.*")


def of(rows: DataFrame, relation: str) -> DataFrame:
    """One relation's rows: the page's columns, pos and the relation's fields."""
    kept = [c for c in rows.columns if c not in RELATIONS and c not in ("relation", "pos")]
    return rows.filter(F.col("relation") == relation).select(*kept, "pos", f"{relation}.*")


def write(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy("relation").parquet(path)


def read(spark: SparkSession, path: str, relation: str) -> DataFrame:
    """One relation of rows laid down by `write`."""
    return of(spark.read.parquet(path), relation)
