"""Toxicity by a lexicon: Levenshtein automata are intersected with a trie of terms, and what stands around a hit tells abuse from quotation.

The lexicon is learned: words, and beginnings of words, that toxic training texts hold far more often than others. A word of a text is run
through one automaton for all terms, made state by state as words need it (a state is a set of trie nodes with errors made so far, among
them exchanged neighbours); terms of 5 letters allow 1 error, of 9 letters 2. Misspelled forms of a term count as far as training texts
with them are toxic. A hit between quotation marks, or soon after a verb of speech, counts less; beside a word of address it counts more.
Sums, densities in windows of words and the number of different terms go into a logistic regression.

Bounds: SAMPLE labelled texts (drawn by a hash of the id) to learn from, TERMS terms. All texts are scored whole.
Nulls: null and empty texts have no hits and get the score of such texts; a null id counts as held out of nothing and is kept; repeated rows
get equal scores. Labels that are null or not 0 or 1 are passed over; without labels of both kinds every score is the share of toxic ones.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import Cut, pieces, words
from .language_id import held_out

SAMPLE = 12_000
TERMS = 4096
LEAST_ODDS = 1.0
WINDOW = 20
REMEMBERED = 400_000
QUOTED, ADDRESSED = 0.35, 1.25
SAYING = frozenset("said says wrote writes called quoted quote quotes states stated dit écrit cité appelle sagte sagt schrieb nannte zitat zitiert dijo dice escribió cita llamó".split())
ADDRESS = frozenset("you your you're u ur du dich dir sie toi vous tú usted eres".split())
EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
OPENING, CLOSING = "\"“«„‹‘", "\"”»“›’"


def bare(word: str) -> str:
    return EDGE.sub("", word.lower())


def allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def terms_of(word: str) -> list[str]:
    """A word, and its beginnings of 4 to 8 letters (a star at the end)."""
    return [word, *(word[:k] + "*" for k in range(4, min(9, len(word))))] if len(word) > 2 and word.isalpha() else []


class Automaton:
    """For a word, the term it matches best and the errors made, over all terms at once."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most = [0]
        for t in sorted(terms):
            n = 0
            self.most[0] = max(self.most[0], allowed(t))
            for c in t:
                if c not in self.children[n]:
                    self.children[n][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.most.append(0)
                n = self.children[n][c]
                self.most[n] = max(self.most[n], allowed(t))
            self.term[n] = t
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: dict[tuple[int, str], int] = {}
        self.found: list[tuple[str, int] | None] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, items: set[tuple[int, int, str]]) -> int:
        todo, full = list(items), set(items)
        while todo:  # a letter of the term left out
            n, e, wait = todo.pop()
            for m in [] if wait else self.children[n].values():
                if e < self.most[m] and (x := (m, e + 1, "")) not in full:
                    full.add(x)
                    todo.append(x)
        least: dict[tuple[int, str], int] = {}
        for n, e, wait in full:
            least[n, wait] = min(e, least.get((n, wait), 9))
        key = frozenset((n, e, w) for (n, w), e in least.items())
        if (k := self.ids.get(key)) is None:
            k = self.ids[key] = len(self.sets)
            self.sets.append(key)
            ends = [(e, self.term[n]) for n, e, w in key if not w and self.term[n] and e <= allowed(self.term[n])]
            self.found.append(min(ends)[::-1] if ends else None)
        return k

    def _next(self, state: int, c: str) -> int:
        out = set()
        for n, e, wait in self.sets[state]:
            if wait:
                if c == wait:
                    out.add((n, e, ""))
                continue
            kids = self.children[n]
            if c in kids:
                out.add((kids[c], e, ""))
            if e < self.most[n]:
                out.add((n, e + 1, ""))
            for x, m in kids.items():
                if e < self.most[m]:
                    if x != c:
                        out.add((m, e + 1, ""))
                    if (two := self.children[m].get(c)) is not None and x != c and e < self.most[two]:
                        out.add((two, e + 1, x))
        return self._state(out) if out else -1

    def match(self, word: str) -> tuple[str, int] | None:
        s = self.start
        for c in word:
            k = self.step.get((s, c))
            if k is None:
                if len(self.step) > REMEMBERED:
                    self.step.clear()
                k = self.step[s, c] = self._next(s, c)
            if k < 0:
                return None
            s = k
        return self.found[s]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    misspelled: dict[str, float] = field(default_factory=dict)
    coef: list[float] = field(default_factory=list)
    base: float = 0.0

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    def __init__(self, model: Model):
        self.model = model
        self.automaton = Automaton([t for t in model.weights if not t.endswith("*")])
        self.known: dict[str, tuple[str, float, bool] | None] = {}

    def hit(self, raw: str) -> tuple[str, float, bool] | None:
        """The term that a word stands for, its weight, and whether it is misspelled."""
        if raw in self.known:
            return self.known[raw]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        word, w, best = bare(raw), self.model.weights, None
        if len(word) > 2:
            for t in terms_of(word):
                if t in w and (best is None or w[t] > best[1]):
                    best = (t, w[t], False)
            if best is None and (m := self.automaton.match(word)) and m[1]:
                best = (m[0], w[m[0]] * self.model.misspelled.get(m[0], 1.0), True)
        self.known[raw] = best
        return best

    def features(self, tokens: list[str], at: list[int]) -> list[float]:
        """at: the places of hits."""
        if not at:
            return [0.0] * 5
        weigh, terms = [], set()
        for i in at:
            term, w, _ = self.hit(tokens[i])
            near = [tokens[j] for j in range(max(0, i - 8), min(len(tokens), i + 9))]
            before, after = tokens[max(0, i - 8) : i + 1], tokens[i : i + 9]
            opens = next((k for k in range(len(before) - 1, -1, -1) if before[k][0] in OPENING), None)
            closed = any(t.rstrip(".,;:!?")[-1:] in CLOSING for t in before[opens or 0 : -1]) if opens is not None else True
            quoted = opens is not None and not closed and any(t.rstrip(".,;:!?")[-1:] in CLOSING for t in after)
            said = any(bare(t) in SAYING for t in before[-5:-1])
            addressed = any(bare(t) in ADDRESS for t in near)
            weigh.append(w * (QUOTED if quoted or said else 1.0) * (ADDRESSED if addressed else 1.0))
            terms.add(term)
        dense = run = 0.0
        start = 0
        for k, i in enumerate(at):
            run += weigh[k]
            while at[start] <= i - WINDOW:
                run -= weigh[start]
                start += 1
            dense = max(dense, run)
        total = sum(weigh)
        return [math.log1p(total), dense / 10, math.log1p(len(terms)), total / math.sqrt(10 + len(tokens)), math.log1p(len(at))]

    def batch(self, texts: pa.Array) -> np.ndarray:
        codes, first, distinct = words(texts)
        is_hit = np.fromiter((self.hit(w) is not None for w in distinct), dtype=bool, count=len(distinct))
        out = np.zeros((len(texts), 5))
        flags = is_hit[codes] if len(codes) else np.zeros(0, dtype=bool)
        for k in np.unique(np.searchsorted(first, np.flatnonzero(flags), side="right") - 1).tolist():
            own = codes[first[k] : first[k + 1]].tolist()
            out[k] = self.features([distinct[c] for c in own], np.flatnonzero(flags[first[k] : first[k + 1]]).tolist())
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.model.coef:
            return np.full(len(x), self.model.base)
        c = np.array(self.model.coef)
        return 1 / (1 + np.exp(-np.clip(c[0] + x @ c[1:], -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> list[float]:
    """Logistic regression by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    c, r = np.zeros(a.shape[1]), ridge * np.diag([1e-3, *np.ones(x.shape[1])]) * max(1.0, math.sqrt(len(x)) / 10)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + r, a.T @ (p - y) + r @ c)
        c = c - step
        if np.abs(step).max() < 1e-8:
            break
    return c.tolist()


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, size: int) -> DataFrame:
    """t, y of at most `size` labelled rows that aren't held out, a row for each id and text."""
    own = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).cast("string").alias("_i")).agg(F.max(label_col).alias("y"))
    own = own.orderBy(F.xxhash64("_i", F.lit("toxicity")), "_i").limit(size)
    return docs.select(F.col(id_col).cast("string").alias("_j"), F.col(text_col).alias("t")).join(F.broadcast(own), F.col("_i") == F.col("_j")).select("t", F.col("y").cast("int").alias("y"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", size: int = SAMPLE) -> Model:
    cut = Cut(labelled_sample(docs, labels, id_col, text_col, label_col, size).dropDuplicates(), "labelled")
    sample = cut.df
    n1, n = (int(v or 0) for v in sample.agg(F.sum("y"), F.count("*")).first())
    if not n1 or n1 == n:
        cut.drop()
        return Model(base=n1 / n if n else 0.0)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                codes, first, distinct = words(part.column("t"))
                terms = [terms_of(bare(w)) for w in distinct]
                by = (Counter(), Counter())
                for k, y in enumerate(part.column("y").to_pylist()):
                    by[y].update({t for c in set(codes[first[k] : first[k + 1]].tolist()) for t in terms[c]})
                keys = sorted(by[0].keys() | by[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([by[0][t] for t in keys], pa.int64()), pa.array([by[1][t] for t in keys], pa.int64())], names=["term", "n0", "n1"])

    counts = sample.mapInArrow(counted, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n - n1 + 1))
    least = odds - 1.5 * F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    top = counts.where(F.col("n1") >= max(4, n1 // 100)).select("term", odds.alias("w"), least.alias("low")).where(F.col("low") > LEAST_ODDS)
    rows = top.orderBy(F.desc("low"), "term").limit(TERMS).collect()
    model = Model({r["term"]: r["w"] for r in rows}, base=n1 / n)

    def misspelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            for part in pieces(batch, "t"):
                codes, first, distinct = words(part.column("t"))
                forms = [h[0] if (h := matcher.hit(w)) and h[2] else None for w in distinct]
                at = np.flatnonzero(np.fromiter((f is not None for f in forms), dtype=bool, count=len(forms))[codes]) if len(codes) else []
                own = {(int(np.searchsorted(first, i, side="right")) - 1, forms[codes[i]]) for i in at}
                y = part.column("y").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([t for _, t in own], pa.string()), pa.array([y[k] for k, _ in own], pa.int32())], names=["term", "y"])

    for r in sample.mapInArrow(misspelt, "term string, y int").groupBy("term").agg(F.sum("y").alias("a"), F.count("*").alias("n")).collect():
        share = (r["a"] + 2.0) / (r["n"] + 2.5)
        model.misspelled[r["term"]] = max(0.0, (share - model.base) / (1 - model.base))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            for part in pieces(batch, "t"):
                x = matcher.batch(part.column("t"))
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    rows = sorted(sample.mapInArrow(made, "y int, x array<double>").collect())
    model.coef = _fit(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], dtype=float))
    cut.drop()
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the score as a further column; a column of docs with its name is replaced."""
    docs = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            for part in pieces(batch, text_col):
                yield part.append_column(name, pa.array(matcher.score(matcher.batch(part.column(text_col)))))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
