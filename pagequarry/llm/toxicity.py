"""Toxicity by a learned lexicon, matched with Levenshtein automata and weighed in context.

`learn` reads labelled documents and keeps a lexicon: terms (and stems, the
beginnings that many toxic terms share) that stand mostly in toxic documents.
The lexicon is a trie; it is intersected with the Levenshtein automata of its
terms, which gives one automaton that reads a token letter by letter and says
which term it is within how many edits of.  The automaton's states are made
when a token first needs them.

Each hit is looked at in its context window: a term between quotation marks or
after a reporting verb is quoted, one near a second-person pronoun is aimed.
How often documents with a hit of that term, number of edits and context are
toxic is counted on the labelled documents, each shrunk towards the share of
toxic documents.  A document's evidence joins its strongest hits as independent
causes; a quarter of the training documents, kept back from the lexicon, tells
how much evidence makes the score `THRESHOLD`.

Learning reads at most `MAX_TRAIN` labelled documents, those with the least
hash of their doc_id.  The lexicon is bounded as well: its `MAX_TERMS` strongest
terms and `MAX_STEMS` strongest stems are the classifier, at any size of the
corpus, and a document's evidence is that of its `TOP` strongest different hits.
Every whole text is scored, however long it is.

Nulls and edges: a null or empty text has no tokens and gets the score of
documents without hits.  Labels whose doc_id or toxic is null are not learnt
from; a doc_id with several labels counts as toxic if one of them says so.
Rows that share a doc_id are scored each by its own text.  Without labels, all
scores are equal.  Empty tables give empty tables.  Columns besides those
named are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold

MAX_TRAIN = 20_000
MAX_TERMS, MAX_STEMS = 3000, 500
MIN_TOXIC = 3
#: a term is worth an entry from this chance of toxicity on, and a hit from this one
ENTRY, HIT = 0.6, 0.5
STEM_LENGTHS = range(4, 9)
PRIOR = 8.0
#: of the training documents, every CALIBRATE-th is kept back to set the point at which a score reaches the threshold
CALIBRATE = 4
THRESHOLD = 0.7
TOP = 5
TOKEN = re.compile(r"[^\W_]+")
LEET = str.maketrans("013457", "oieast")
#: fixed values: verbs that report speech, second-person pronouns, and quotation marks
REPORTING = frozenset("said says say called calls wrote writes quoted quote quotes told sagte sagt nannte schrieb dit appelle écrit dijo dice llamó escribió".split())
SECOND_PERSON = frozenset("you your youre du dich dir ihr euch tu toi vous te usted ustedes".split())
OPEN_QUOTES, CLOSE_QUOTES = "\"“„«‘", "\"”“»’"
PLAIN, QUOTED, AIMED = 0, 1, 2
WINDOW_TOKENS, WINDOW_CHARS = 4, 80
#: tokens and states that a worker remembers at most
CACHE, STATES = 100_000, 25_000


def edits_for(term: str) -> int:
    """Edits that a term of this length may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class LexiconAutomaton:
    """Terms within their edits, and stems, as one automaton over letters."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.terms = terms + stems
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.stem_at: list[int] = [-1]
        self.limit: list[int] = [0]
        for i, t in enumerate(self.terms):
            stem, node = i >= len(terms), 0
            allowed = 0 if stem else edits_for(t)
            for ch in t:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    for column, value in ((self.children, {}), (self.ends, -1), (self.stem_at, -1), (self.limit, 0)):
                        column.append(value)
                self.limit[node] = max(self.limit[node], allowed)
                node = self.children[node][ch]
            self.limit[node] = max(self.limit[node], allowed)
            if stem:
                self.stem_at[node] = i
            else:
                self.ends[node] = i
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        #: of each state: the stem that begins the token so far, and the term that it is near with its edits
        self.stems: list[int] = []
        self.finals: list[tuple[int, int] | None] = []
        self._close({}, [(0, 0)])

    def state(self, items: tuple) -> int:
        if items not in self.states:
            self.states[items] = len(self.sets)
            self.sets.append(items)
            self.moves.append({})
            self.stems.append(next((self.stem_at[n] for n, e in items if e == 0 and self.stem_at[n] >= 0), -1))
            self.finals.append(min(((e, self.ends[n]) for n, e in items if self.ends[n] >= 0 and e <= edits_for(self.terms[self.ends[n]])), default=None))
        return self.states[items]

    def _close(self, best: dict[int, int], todo: list[tuple[int, int]]) -> int:
        """The state of these nodes, each with its least edits, and of those that letters left out lead to; -1 if there are none."""
        while todo:
            node, edits = todo.pop()
            if edits <= self.limit[node] and best.get(node, 9) > edits:
                best[node] = edits
                todo += [(other, edits + 1) for other in self.children[node].values()]
        return self.state(tuple(sorted(best.items()))) if best else -1

    def _step(self, at: int, ch: str) -> int:
        """The state after one more letter: kept letters, substitutions, letters too many, then letters left out."""
        todo: list[tuple[int, int]] = []
        for node, edits in self.sets[at]:
            if ch in self.children[node]:
                todo.append((self.children[node][ch], edits))
            todo.append((node, edits + 1))
            todo += [(other, edits + 1) for other in self.children[node].values()]
        return self._close({}, sorted(todo, key=lambda x: -x[1]))

    def match(self, token: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term, or of the longest stem that begins the token."""
        if len(self.sets) > STATES:
            self._reset()
        at, stem = 0, -1
        for ch in token:
            nxt = self.moves[at].get(ch)
            if nxt is None:
                nxt = self.moves[at][ch] = self._step(at, ch)
            if nxt < 0:
                return (stem, 0) if stem >= 0 else None
            at = nxt
            if self.stems[at] >= 0:
                stem = self.stems[at]
        final = self.finals[at]
        if final and (final[0] == 0 or stem < 0):
            return final[1], final[0]
        return (stem, 0) if stem >= 0 else None


def lowered(text: str) -> str:
    """The text in lower case, every letter at its own place: the few whose lower case is longer keep theirs."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


def tokens_of(text: str) -> list[str]:
    return [t if t.isalpha() else t.translate(LEET) for t in TOKEN.findall(lowered(text))]


class Matcher:
    """Hits of whole texts; remembers what tokens it has seen."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.automaton = LexiconAutomaton(terms, stems)
        self.known: set[str] = set()
        self.found: dict[str, tuple[int, int]] = {}

    def hits(self, text: str) -> dict[tuple[int, int, int], int]:
        """How often each (term, edits, context) stands in the text."""
        low = lowered(text)
        raw = set(TOKEN.findall(low))
        if len(self.known) > CACHE:
            self.known.clear()
            self.found.clear()
        for t in raw - self.known:
            self.known.add(t)
            m = self.automaton.match(t if t.isalpha() else t.translate(LEET)) if not t.isdigit() else None
            if m:
                self.found[t] = m
        there = raw & self.found.keys()
        if not there:
            return {}
        spans = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(low)]
        out: Counter = Counter()
        for i, (t, lo, hi) in enumerate(spans):
            if t in there:
                out[(*self.found[t], context(text, [s[0] for s in spans[max(0, i - WINDOW_TOKENS) : i + WINDOW_TOKENS + 1]], min(i, WINDOW_TOKENS), lo, hi))] += 1
        return out


#: the matcher of the last lexicon that this worker has seen; its states are worth keeping from task to task
_LAST: list[tuple[tuple, Matcher]] = []


def matcher_of(terms: list[str], stems: list[str]) -> Matcher:
    key = (tuple(terms), tuple(stems))
    if not _LAST or _LAST[0][0] != key:
        _LAST[:] = [(key, Matcher(terms, stems))]
    return _LAST[0][1]


def context(text: str, window: list[str], at: int, lo: int, hi: int) -> int:
    """Whether a term at lo..hi of the text, at place `at` of its window of tokens, is quoted, aimed or neither."""
    before, after = text[max(0, lo - WINDOW_CHARS) : lo], text[hi : hi + WINDOW_CHARS]
    opened = max(before.rfind(q) for q in OPEN_QUOTES)
    if opened >= 0 and any(q in after for q in CLOSE_QUOTES) and not any(before.rfind(q) > opened for q in "”»") and before.count('"') % 2 == (before[opened] == '"'):
        return QUOTED
    if REPORTING.intersection(window[:at]):
        return QUOTED
    return AIMED if SECOND_PERSON.intersection(window) else PLAIN


class Model(NamedTuple):
    terms: list[str]
    stems: list[str]
    chance: dict[tuple[int, int, int], float]
    base: float
    enough: float

    def evidence(self, hits: dict[tuple[int, int, int], int]) -> float:
        """Minus the logarithm of the chance that none of the strongest hits is a cause; terms count once each."""
        best: dict[int, float] = {}
        for h in hits:
            # a context never seen with its term says half of what the term says plainly
            p = self.chance.get(h) or self.chance.get((*h[:2], PLAIN), self.base) * (0.5 if h[2] == QUOTED else 1)
            best[h[0]] = max(best.get(h[0], 0), p)
        strong = sorted((p for p in best.values() if p >= HIT), reverse=True)[:TOP]
        weak = max((p for p in best.values() if p < HIT), default=0)
        return -sum(math.log1p(-p) for p in strong) - (0.01 * math.log1p(-weak))

    def score(self, hits: dict[tuple[int, int, int], int]) -> float:
        return 1 - (1 - THRESHOLD) ** (self.evidence(hits) / self.enough)


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(text, toxic) of the labelled documents that are learnt from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(fold() != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(CALIBRATE)) == 0
    # known has max_train rows of two numbers at most; the texts are read again for each use rather than stored
    return texts.join(F.broadcast(cut(known)), "doc_id").select("text", "toxic", held.alias("held"))


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        toxic, clean = Counter(), Counter()
        for text, label in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
            (toxic if label else clean).update({t for t in tokens_of(text) if len(t) >= 3 and not t.isdigit()})
        tokens = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array([toxic[t] for t in tokens], pa.int64()), pa.array([clean[t] for t in tokens], pa.int64())], ["token", "toxic", "clean"])


def _entries(counted: DataFrame, limit: int, at_least: int) -> list[str]:
    chance = F.col("toxic") / (F.col("toxic") + F.col("clean") + 1)
    rows = counted.filter((F.col("toxic") >= at_least) & (chance >= ENTRY)).orderBy((F.col("toxic") * chance).desc(), "token").limit(limit).select("token").collect()
    return [r.token for r in rows]


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A lexicon and the chances of its hits."""
    both = training_rows(docs, labels, max_train)
    train = both.filter("NOT held")
    counted = cut(train.mapInArrow(_count_tokens, "token string, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    terms = _entries(counted, MAX_TERMS, MIN_TOXIC)
    starts = F.explode(F.array(*[F.when(F.length("token") > n, F.substring("token", 1, n)) for n in STEM_LENGTHS]))
    stems = counted.select(starts.alias("stem"), "toxic", "clean").filter("stem IS NOT NULL").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("*").alias("n"))
    found = _entries(stems.filter((F.col("n") >= 3) & (F.col("toxic") >= 20 * F.col("clean"))).select(F.col("stem").alias("token"), "toxic", "clean"), MAX_STEMS, 2 * MIN_TOXIC)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of(terms, found)
        for b in batches:
            rows: dict[tuple, list[int]] = {}
            for text, label in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                for h in matcher.hits(text):
                    rows.setdefault(h, [0, 0])[0 if label else 1] += 1
            keys = list(rows)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int64()) for i in range(3)] + [pa.array([rows[k][i] for k in keys], pa.int64()) for i in range(2)], ["term", "edits", "ctx", "toxic", "clean"])

    rows = train.mapInArrow(count, "term long, edits long, ctx long, toxic long, clean long").groupBy("term", "edits", "ctx").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()
    total = train.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).first()
    base = ((total.toxic or 0) + 0.1) / (total.n + 2)
    # an edit leaves the prior less to say
    chance = {(r.term, r.edits, r.ctx): (r.toxic + PRIOR * base * 0.5**r.edits) / (r.toxic + r.clean + PRIOR) for r in rows}
    model = Model(terms, found, chance, base, 1.0)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of(terms, found)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.evidence(matcher.hits(x)) for x in b["text"].to_pylist()], pa.float64()), b["toxic"]], ["x", "toxic"])

    return model._replace(enough=_enough([(r.x, r.toxic) for r in both.filter("held").mapInArrow(weigh, "x double, toxic int").collect()]))


def _enough(weighed: list[tuple[float, int]]) -> float:
    """The evidence from which on documents count as toxic: between the two values where F1 is best, at least that of an even chance."""
    weighed = sorted(weighed, reverse=True)
    toxic, best, cut_at, hits = sum(t for _, t in weighed), -1.0, 1.0, 0
    for i, (x, t) in enumerate(weighed):
        hits += t
        below = weighed[i + 1][0] if i + 1 < len(weighed) else 0.0
        f1 = 2 * hits / (i + 1 + toxic)
        if below < x and f1 > best:
            best, cut_at = f1, (x + below) / 2
    return max(cut_at, math.log(2))


SCORES = "doc_id long, held_out boolean, score double, predicted int, n_hits int, n_quoted int"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """SCORES of every row of the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        matcher = matcher_of(m.terms, m.stems)
        for b in batches:
            scores, hits, quoted = [], [], []
            for text in b["text"]:
                h = matcher.hits(text.as_py() or "")
                scores.append(m.score(h))
                hits.append(sum(h.values()))
                quoted.append(sum(n for k, n in h.items() if k[2] == QUOTED))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(scores), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(hits, pa.int32()), pa.array(quoted, pa.int32())], [x.split()[0] for x in SCORES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 1).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORES)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text scores less than THRESHOLD, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        matcher = matcher_of(m.terms, m.stems)
        for b in batches:
            yield b.filter(pa.array([m.score(matcher.hits(x.as_py() or "")) < THRESHOLD for x in b["text"].cast(pa.string())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
