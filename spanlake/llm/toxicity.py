"""Toxicity scores: Levenshtein automata over a lexicon trie, and context windows.

The lexicon is learned from labelled texts: words, and stems that many words begin
with, whose rate in toxic texts is a large multiple of that in clean ones. A trie of
the lexicon is intersected with Levenshtein automata (longer terms allow more
edits) into one deterministic automaton over bytes, which then reads all words of
a batch side by side, one byte position at a time. A large lexicon is dealt over
several automata (``TERMS_PER_AUTOMATON``).

Each hit is scored in a window of words around it: words that in the labelled texts
stand near hits of clean texts lower it, quotation marks around it take most of
its weight, and edits some. A text's score is a logistic function of the summed
hit scores, fitted on the same texts.

Terms and context words are counted over all labelled texts and chosen by evidence
and rate; a term's evidence must outweigh the number of terms it is chosen among.
Only the logistic fit uses a bounded sample (``SAMPLE_TOXIC``, ``SAMPLE_CLEAN``, by a
hash of the id). Scoring reads every text whole.

Rows: a null or empty text, or one without hits, has the base score of texts
without hits; a null ``doc_id`` counts as the empty text for the fold; labels that
are null are ignored, of several labels for an id the largest counts; without toxic
labels all scores are 0; rows that repeat an id are scored one by one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.langid import fold
from spanlake.llm.shared import expanded, slices, squeezed, stored, text_buffer

SAMPLE_TOXIC, SAMPLE_CLEAN = 2500, 5000
#: A term's least number of toxic texts, least rate against clean texts, and least
#: evidence (texts times log rate).
MIN_TEXTS, MIN_RATIO, MIN_EVIDENCE = 3, 5.0, 14.0
#: Clean texts that a context word is near a hit in.
MIN_CONTEXT = 3
TERMS_PER_AUTOMATON = 300
#: Distinct terms that a worker counts before it passes them on.
COUNTED_TERMS = 1 << 18
#: Letters of the shortest stem, and the share of a stem's texts that makes one way of going on the term.
STEM, DOMINANT = 3, 0.85
#: (letters, edits): words and stems of so many letters allow so many edits.
WORD_EDITS, STEM_EDITS = ((10, 2), (5, 1)), ((7, 1),)
WINDOW = 6
#: Weight kept per edit and in quotation marks, before the labelled texts have a say;
#: texts that this first guess counts for.
EDIT_FACTOR, QUOTED_FACTOR, GUESS_TEXTS = 0.6, 0.15, 4
THRESHOLD = 0.7
SLICE_BYTES = 1 << 20

# ------------------------------------------------------------------ words

_SIGN = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789@$*":
    _SIGN[_c] = _c
for _c in range(65, 91):
    _SIGN[_c] = _c + 32
_SIGN[128:] = np.arange(128, 256)
#: Quotation marks as UTF-8: opening, closing, and those that do both.
OPENING, CLOSING, EITHER = ("“", "„", "‘", "‚", "«", "‹"), ("”", "’", "»", "›"), ('"',)


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes of words (letters, digits and ``@ $ *``); 0 between words.

    Latin-1 punctuation (UTF-8 C2 xx) and general punctuation (E2 80 xx) part words.
    """
    out = _SIGN[data]
    if len(data) > 1:
        lead, next_ = data[:-1], data[1:]
        latin = np.flatnonzero(lead == 0xC2)
        out[latin] = 0
        out[latin + 1] = 0
        upper = np.flatnonzero((lead == 0xC3) & (next_ >= 0x80) & (next_ <= 0x9E) & (next_ != 0x97)) + 1
        out[upper] += 0x20
        general = np.flatnonzero((lead == 0xE2) & (next_ == 0x80))
        for k in range(3):
            out[np.minimum(general + k, len(out) - 1)] = 0
    return out


def split_words(signs: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word and the index of each text's first word (len+1)."""
    solid = signs != 0
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(signs))]
    begins[edge] = solid[edge]
    ends[edge - 1] = solid[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


# ------------------------------------------------------------------ automaton


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool  # any ending may follow
    weight: float

    @property
    def edits(self) -> int:
        return next((k for n, k in (STEM_EDITS if self.stem else WORD_EDITS) if len(self.text) >= n), 0)


class Automaton:
    """Deterministic automaton of a lexicon trie under edits (in bytes).

    A state is a set of trie nodes, each with the fewest edits that reach it; a
    node is kept while some term below it allows as many.
    """

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[int, int]] = [{}]
        self.here: list[list[int]] = [[]]
        self.budget = [0]
        for i, term in enumerate(terms):
            node = 0
            self.budget[0] = max(self.budget[0], term.edits)
            for c in term.text.encode():
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.here.append([])
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], term.edits)
            self.here[node].append(i)
        self._determine()

    def _closed(self, nodes: dict[int, int]) -> frozenset:
        """With the nodes that are reached by letters the word leaves out."""
        work = list(nodes.items())
        while work:
            node, e = work.pop()
            for child in self.children[node].values():
                if e + 1 <= self.budget[child] and nodes.get(child, 99) > e + 1:
                    nodes[child] = e + 1
                    work.append((child, e + 1))
        return frozenset(nodes.items())

    def _step(self, state: frozenset, c: int) -> frozenset:
        out: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.budget[node] and out.get(node, 99) > e:
                out[node] = e

        for node, e in state:
            put(node, e + 1)  # a letter too many
            if any(self.terms[i].stem and e <= self.terms[i].edits for i in self.here[node]):
                put(node, e)
            for d, child in self.children[node].items():
                put(child, e + (c != d))
        return self._closed(out)

    def _accepts(self, state: frozenset) -> tuple[int, int]:
        found = [(e, -self.terms[i].weight, i) for node, e in state for i in self.here[node] if e <= self.terms[i].edits]
        return (min(found)[2], min(found)[0]) if found else (-1, 0)

    def _determine(self) -> None:
        letters = sorted({c for x in self.children for c in x})
        start = self._closed({0: 0})
        number = {frozenset(): 0, start: 1}
        rows, work = [np.zeros(256, np.int32), None], [start]
        while work:
            state = work.pop()
            row = np.empty(256, np.int32)
            for c in [-1, *letters]:  # -1: a letter that no term has
                after = self._step(state, c)
                if after not in number:
                    number[after] = len(number)
                    rows.append(None)
                    work.append(after)
                if c < 0:
                    row[:] = number[after]
                else:
                    row[c] = number[after]
            rows[number[state]] = row
        self.table = np.array(rows)
        accepts = [self._accepts(s) for s in number]
        self.term = np.array([t for t, _ in accepts], np.int32)
        self.errors = np.array([e for _, e in accepts], np.int32)

    def read(self, signs: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that are terms: their indices, terms and edits."""
        words, terms, errors = [], [], []
        alive, state, at = np.arange(len(start)), np.ones(len(start), np.int32), start
        while len(alive):
            done = at == end[alive]
            if done.any():
                hit = np.flatnonzero(done)
                hit = hit[self.term[state[hit]] >= 0]
                words.append(alive[hit])
                terms.append(self.term[state[hit]])
                errors.append(self.errors[state[hit]])
                alive, state, at = alive[~done], state[~done], at[~done]
            state = self.table[state, signs[at]]
            on = state != 0
            alive, state, at = alive[on], state[on], at[on] + 1
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
        words, terms, errors = (np.concatenate(x) for x in (words, terms, errors))
        order = np.argsort(words)
        return words[order], terms[order], errors[order]


class Lexicon:
    """Terms in order of their spelling over automata of ``TERMS_PER_AUTOMATON`` each."""

    def __init__(self, terms: list[Term]):
        self.terms = sorted(terms, key=lambda t: (t.text, t.stem))
        self.first = list(range(0, len(terms), TERMS_PER_AUTOMATON))
        self.automata = [Automaton(self.terms[i : i + TERMS_PER_AUTOMATON]) for i in self.first]
        self.weight = np.array([t.weight for t in self.terms])

    def read(self, signs: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that are terms: their indices, terms and edits; of several terms the
        one with the fewest edits, then the greatest weight."""
        found = [a.read(signs, start, end) for a in self.automata]
        if len(found) == 1:
            return found[0]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
        words, errors = (np.concatenate([f[k] for f in found]) for k in (0, 2))
        terms = np.concatenate([f[1] + i for f, i in zip(found, self.first)])
        order = np.lexsort((terms, -self.weight[terms], errors, words))
        words = words[order]
        best = np.ones(len(words), bool)
        best[1:] = words[1:] != words[:-1]
        return words[best], terms[order][best], errors[order][best]


# ------------------------------------------------------------------ hits in context


@dataclass
class Hit:
    text: int  # row in the batch
    term: int
    errors: int
    quoted: bool
    near: list[str]


def quoted(left: str, right: str) -> bool:
    """A quotation opens before the word and closes after it, within the window."""
    opens = left.count('"') % 2 == 1 and '"' in right
    for a in OPENING:
        at = left.rfind(a)
        opens = opens or (at >= 0 and not any(c in left[at + 1 :] for c in CLOSING) and any(c in right for c in CLOSING))
    return opens


def hits(column: pa.Array, automaton: Automaton | Lexicon) -> tuple[list[Hit], np.ndarray]:
    """Hits of all texts, and each text's number of words."""
    data, offsets = text_buffer(column)
    signs = word_bytes(data)
    start, end, first = split_words(signs, offsets)
    words, terms, errors = automaton.read(signs, start, end)
    text = np.searchsorted(first, words, side="right") - 1
    out = []
    for w, t, e, i in zip(words.tolist(), terms.tolist(), errors.tolist(), text.tolist()):
        lo, hi = max(int(first[i]), w - WINDOW), min(int(first[i + 1]), w + WINDOW + 1)
        # the marks just outside the outer words belong to the window
        a = max(int(offsets[i]), int(start[lo]) - 4)
        b = min(int(offsets[i + 1]), int(end[hi - 1]) + 4)
        left = data[a : start[w]].tobytes().decode(errors="ignore")
        right = data[end[w] : b].tobytes().decode(errors="ignore")
        near = [signs[start[j] : end[j]].tobytes().decode(errors="ignore") for j in range(lo, hi) if j != w]
        out.append(Hit(i, t, e, quoted(left, right), near))
    return out, np.diff(first)


@dataclass
class Model:
    automaton: Automaton | Lexicon
    context: dict[str, float] = field(default_factory=dict)  # log-odds of toxic against clean
    weights: dict[tuple[int, int], float] = field(default_factory=dict)  # of a term with so many edits
    coefficients: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 0.0, -4.0]))

    def hit_score(self, hit: Hit) -> float:
        around = max(-4.0, min(4.0, sum(self.context.get(w, 0.0) for w in hit.near)))
        weight = self.weights.get((hit.term, hit.errors))
        if weight is None:
            weight = self.automaton.terms[hit.term].weight * EDIT_FACTOR**hit.errors
        return weight * 2 / (1 + math.exp(-around)) * (QUOTED_FACTOR if hit.quoted else 1.0)

    def features(self, column: pa.Array) -> np.ndarray:
        """Summed hit scores, their rate per thousand words, and words, as logarithms, and 1."""
        total = np.zeros(len(column))
        found, n_words = hits(column, self.automaton)
        for hit in found:
            total[hit.text] += self.hit_score(hit)
        return np.column_stack([np.log1p(total), np.log1p(1000 * total / (n_words + 20)), np.log1p(n_words), np.ones(len(total))])

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.coefficients, -30, 30)))


# ------------------------------------------------------------------ learning


def _terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each label that hold a word, or words with a stem."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def counted() -> pa.RecordBatch:
        names = list(set(counts[0]) | set(counts[1]))
        out = pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([counts[1][x] for x in names], pa.int64()), pa.array([counts[0][x] for x in names], pa.int64())],
            ["term", "toxic", "clean"],
        )
        counts[0].clear()
        counts[1].clear()
        return out

    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            data, offsets = text_buffer(part.column("text"))
            signs = word_bytes(data)
            raw = np.where(signs == 0, 32, signs).astype(np.uint8).tobytes()
            for i, toxic in enumerate(part.column("toxic").to_pylist()):
                words = set(raw[offsets[i] : offsets[i + 1]].decode(errors="ignore").split())
                counts[toxic].update({w + "\n" for w in words} | {w[:k] for w in words for k in range(STEM, len(w) + 1)})
                if len(counts[0]) + len(counts[1]) > COUNTED_TERMS:
                    yield counted()
    yield counted()


def choose_terms(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> list[Term]:
    """Lexicon from candidate counts (whole words end in a newline, stems do not).

    From each shortest candidate stem, the way is followed as long as one letter
    goes on in nearly all of its texts; it ends at a word or at a stem that branches.
    """

    def weight(x: str) -> float:
        t, c = counts[x]
        return math.log((t + 0.5) / (n_toxic + 1) * (n_clean + 1) / (c + 0.5))

    stems = {x for x in counts if not x.endswith("\n")}
    following: dict[str, list[str]] = {}
    for x in stems:
        following.setdefault(x[:-1], []).append(x)
    out = []
    for x in sorted(stems):
        if x[:-1] in stems:
            continue
        while True:
            n = counts[x][0]
            if counts.get(x + "\n", (0, 0))[0] >= DOMINANT * n:
                out.append((n, Term(x, False, weight(x + "\n"))))
                break
            best = max(following.get(x, []), key=lambda y: (counts[y][0], y), default=None)
            if best is None or counts[best][0] < DOMINANT * n:
                out.append((n, Term(x, True, weight(x))))
                break
            x = best
    out += [(counts[w][0], Term(w[:-1], False, weight(w))) for w in counts if w.endswith("\n") and len(w) <= STEM]
    out.sort(key=lambda y: (-y[0], y[1].text))
    return [t for _, t in out]


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic coefficients by Newton steps, slightly held back."""
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + 1e-4 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """All texts that have a label (0 or 1): doc_id, text, toxic."""
    own = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    return stored(expanded(squeezed(docs).join(stored(own, "toxic-labels"), "doc_id")), "toxic-texts")


def surroundings(texts: DataFrame, terms: list[Term]) -> dict[int, int]:
    """Of each term, the number of different surroundings in ``texts``: three words
    before it or three after it, whichever are fewer. Copies of a text count once."""
    shared = texts.sparkSession.sparkContext.broadcast(({t.text: i for i, t in enumerate(terms) if not t.stem}, {t.text: i for i, t in enumerate(terms) if t.stem}))

    def around(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, stems = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                data, offsets = text_buffer(part.column("text"))
                signs = word_bytes(data)
                raw = np.where(signs == 0, 32, signs).astype(np.uint8).tobytes()
                seen = set()
                for a, b in zip(offsets[:-1], offsets[1:]):
                    words = raw[a:b].decode(errors="ignore").split()
                    for j, w in enumerate(words):
                        found = [whole[w]] if w in whole else []
                        found += [stems[w[:k]] for k in range(STEM, len(w) + 1) if w[:k] in stems] if stems else []
                        if found:
                            before, after = words[max(0, j - 3) : j], words[j + 1 : j + 4]
                            if min(len(before), len(after)) < 3:  # at an edge both sides count
                                before = after = [*before, "", *after]
                            seen |= {(t, side, zlib.crc32(" ".join(x).encode())) for t in found for side, x in ((0, before), (1, after))}
                rows = sorted(seen)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["term", "side", "words"])

    rows = texts.mapInArrow(around, "term long, side long, words long").distinct().groupBy("term", "side").count()
    return {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.min("count").alias("n")).collect()}


def strong(counted: DataFrame, toxic: int, clean: int) -> DataFrame:
    """The counted terms (term, toxic, clean) whose rate and evidence pass.

    The likelihood ratio of the term's share of toxic texts against that of all texts
    bounds how likely chance gives such a share, so among so many terms less than one
    is expected to pass by chance.
    """
    t, c = F.col("toxic"), F.col("clean")
    ratio = (t + 0.5) * (clean + 1) / ((c + 0.5) * (toxic + 1))
    base = (toxic + 0.5) / (toxic + clean + 1)
    n = t + c
    likelihood = t * F.log(t / (n * base)) + F.when(c > 0, c * F.log(c / (n * (1 - base)))).otherwise(0.0)
    least = math.log(max(1, counted.count()))
    passed = counted.filter((t >= MIN_TEXTS) & (ratio >= MIN_RATIO) & (t * F.log(ratio) >= MIN_EVIDENCE) & (likelihood >= least))
    # evidence of one text: a term needs as much from texts that are no copies
    per_text = F.least(likelihood / least, t * F.log(ratio) / MIN_EVIDENCE) / t
    return passed.select("term", "toxic", "clean", F.greatest(F.lit(MIN_TEXTS), F.ceil(1 / per_text)).alias("least"))


def learn(documents: DataFrame, labels: DataFrame, n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN) -> Model | None:
    """Model from ``documents`` (doc_id, text) and ``labels`` (doc_id, toxic); null without toxic texts."""
    texts = labelled(documents, labels)
    size = {int(r["toxic"]): r["count"] for r in texts.groupBy("toxic").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic:
        return None
    counted = texts.mapInArrow(_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # a term in fewer toxic texts is never chosen, but counts among those chosen from
    counted = stored(counted.filter(F.col("toxic") > 0), "toxic-terms")
    kept = strong(counted, toxic, clean).collect()
    terms = choose_terms({r["term"]: (r["toxic"], r["clean"]) for r in kept}, toxic, clean)
    least = {r["term"]: r["least"] for r in kept}
    met = surroundings(texts.filter("toxic = 1"), terms)
    terms = [t for i, t in enumerate(terms) if met.get(i, 0) >= least[t.text if t.stem else t.text + "\n"]]
    model = Model(Lexicon(terms))

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Once per text: the terms hit (with their edits) and the words near hits."""
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                label = part.column("toxic").to_pylist()
                found, _ = hits(part.column("text"), model.automaton)
                seen = {(h.text, w, -1, -1) for h in found for w in h.near} | {(h.text, "", h.term, h.errors) for h in found}
                rows = sorted(seen)
                columns = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.string()), (2, pa.int32()), (3, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([label[r[0]] for r in rows], pa.int32())], ["word", "term", "edits", "toxic"])

    seen = texts.mapInArrow(near, "word string, term int, edits int, toxic int").groupBy("word", "term", "edits")
    seen = stored(seen.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "toxic-context")
    # each term with at most two edits
    for r in seen.filter("term >= 0").collect():
        guess = model.automaton.terms[r["term"]].weight * EDIT_FACTOR ** r["edits"]
        known = math.log((r["t"] + 0.5) / (toxic + 1) * (clean + 1) / (r["c"] + 0.5))
        n = r["t"] + r["c"]
        model.weights[r["term"], r["edits"]] = max(0.0, (n * known + GUESS_TEXTS * guess) / (n + GUESS_TEXTS))
    # words that clean texts have near hits; a word seen there by chance moves little
    table = seen.filter(f"term < 0 and c >= {MIN_CONTEXT} and (t + 2) * {clean + 2}D < (c + 2) * {toxic + 2}D").collect()
    model.context = {r["word"]: math.log((r["t"] + 2) / (toxic + 2) * (clean + 2) / (r["c"] + 2)) for r in table}

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                x = model.features(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([lists, part.column("toxic")], ["x", "toxic"])

    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 20)) / (1 << 20)
    picked = [texts.filter((F.col("toxic") == k) & (draw < n / max(1, size.get(k, 0)))).limit(2 * n) for k, n in ((1, n_toxic), (0, n_clean))]
    sample = picked[0].unionByName(picked[1]).select("text", "toxic")
    rows = sorted((tuple(r["x"]), r["toxic"]) for r in sample.mapInArrow(measure, "x array<double>, toxic int").collect())
    model.coefficients = _fit_logistic(np.array([x for x, _ in rows]), np.array([y for _, y in rows], float))
    return model


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """``documents`` (with ``text``), then score and predicted, which replace columns
    of these names."""
    documents = documents.select(*(f"`{c}`" for c in documents.columns if c.lower() not in ("score", "predicted")))
    if model is None:
        return documents.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                s = shared.value.scores(shared.value.features(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*names, "score", "predicted"])

    schema = T.StructType([*documents.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return documents.mapInArrow(run, schema)


def toxicity(documents: DataFrame, labels: DataFrame, folds: int = 3, held_out_fold: int = 1) -> DataFrame:
    """Learn from labels outside the held-out fold, then score all ``documents``
    (doc_id, text): doc_id, held_out, score, predicted (and the text)."""
    model = learn(documents, labels.filter(fold(F.col("doc_id"), folds) != held_out_fold))
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"), (fold(F.col("doc_id"), folds) == held_out_fold).alias("held_out"))
    return score(docs, model)
