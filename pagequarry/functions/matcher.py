"""All phrases of all dictionaries in one pass over a text.

An automaton (Aho-Corasick) of every phrase runs over a text once and gives the
numbers of those it has, in the dictionaries' order; what the numbers stand for
is looked up by expressions.  So a text is read once for any number of lists,
and the plan has no pattern for any of them.

`Phrases` finds phrases as they stand, in any case and inside words as well;
`Words` finds whole words in their matching form (`text.match_form`), singular
or with an s.  Null texts have no phrase; empty phrases are never found.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

#: stands between texts that are searched together, and in no phrase
APART = "\n"


@functools.lru_cache(maxsize=16)
def automaton(patterns: tuple[tuple[str, int], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for pattern, number in patterns:
        found.add_word(pattern, (*found.get(pattern, ()), number))
    found.make_automaton()
    return found


class Phrases:
    """Dictionaries of labelled phrases: {dictionary: {label: phrases}}."""

    def __init__(self, dictionaries: dict[str, dict[str, list[str]]]):
        self.ranges: dict[str, list[tuple[str, int, int]]] = {}
        self.phrases: list[str] = []
        for name, labelled in dictionaries.items():
            self.ranges[name] = []
            for label, phrases in labelled.items():
                self.ranges[name].append((label, len(self.phrases), len(self.phrases) + len(phrases)))
                self.phrases += phrases

    def patterns(self) -> list[tuple[str, int]]:
        return [(p.lower(), i) for i, p in enumerate(self.phrases) if p]

    def searched(self, *texts: Column) -> Column:
        return F.lower(F.concat_ws(APART, *texts))

    def hits(self, *texts: Column) -> Column:
        """The numbers of the phrases that any of the texts has, ascending."""
        patterns = tuple(self.patterns())

        def run(column: pd.Series) -> pd.Series:
            if not patterns:
                return pd.Series([[]] * len(column), dtype=object)
            found = automaton(patterns)
            return pd.Series([sorted({i for _, numbers in found.iter(x) for i in numbers}) if x else [] for x in column], dtype=object)

        run.__annotations__ = {"column": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, "array<int>")(self.searched(*texts))

    def labels(self, hits: Column, dictionary: str) -> Column:
        """The labels of a dictionary of which any phrase was found, in its order."""
        return F.array_compact(F.array(*[F.when(self.found(hits, dictionary, label), F.lit(label)) for label, _, _ in self.ranges[dictionary]]))

    def found(self, hits: Column, dictionary: str, label: str) -> Column:
        """Whether any phrase of a label was found."""
        at = next((a, b) for name, a, b in self.ranges[dictionary] if name == label)
        return F.exists(hits, lambda i: (i >= at[0]) & (i < at[1]))


class Words(Phrases):
    """The same for phrases of whole words."""

    def patterns(self) -> list[tuple[str, int]]:
        forms = [(" ".join("".join(c if c.isascii() and c.isalnum() else " " for c in p.lower()).split()), i) for i, p in enumerate(self.phrases)]
        return [(f" {form}{end} ", i) for form, i in forms if form for end in ("", "s")]

    def searched(self, *texts: Column) -> Column:
        return F.concat_ws(APART, *[F.concat(F.lit(" "), tx.match_form(t), F.lit(" ")) for t in texts])
