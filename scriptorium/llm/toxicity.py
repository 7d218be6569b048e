"""Toxicity scores from a learned lexicon, matched with its misspellings.

A lexicon of words and stems is learned from labelled documents. Its trie is intersected
with Levenshtein automata of distance one and determinised while words are read, so that
only states that a text reaches are ever made. Every match is weighed by its context:
a window of words tells whether it is aimed at somebody or only quoted. A logistic model
over the weights gives the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import add_fields, per_text, rows_from_texts, shingle_hashes, utf8, word_hashes, work_table

#: Labelled documents of each class that are learned from, shortest word with misspellings.
TRAIN_PER_CLASS, FUZZY_FROM = 2000, 5
#: Letters of a stem, and how many families of toxic documents a term needs at least.
STEM_LETTERS, LEAST_FAMILIES = range(3, 9), 4
#: Words on either side that make the context of a match, and what the context adds to its weight of one.
WINDOW, QUOTED, AIMED = 8, -0.75, 0.5
#: What a misspelling counts, against the word itself, if the sample has none.
FUZZY_SHARE = 0.8
EXACT, FUZZY, STEM = 1, 2, 3
#: Words that report speech, words that address somebody, and quotation marks.
REPORTING = "said says quote quoted quotes called word term wrote written cited dit disait cita dijo palabra sagte wort zitat".split()
ADDRESS = "you your yours toi vous votre dich dir euch usted tú".split()
MARKS = "\"“”„«»‹›"

_WORD_CHARS = np.zeros(65536, bool)
_WORD_CHARS[[k for k in range(65536) if chr(k).isalnum()]] = True
_IS_MARK = np.zeros(65536, bool)
_IS_MARK[[ord(c) for c in MARKS]] = True


def lowered(text: str) -> str:
    """The text in lower case, letter by letter, so that places stay those of the text."""
    low = text.lower()
    if len(low) != len(text):  # some capitals become two characters
        low = "".join(c if len(c) == 1 else o for o, c in zip(text, map(str.lower, text), strict=True))
    return low


def code_points(text: str) -> np.ndarray:
    """Code points of the lower-cased text."""
    return _points(lowered(text))


def _points(low: str) -> np.ndarray:
    return np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32)


def word_edges(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words, which are runs of letters and digits."""
    inside = _WORD_CHARS[np.minimum(points, 65535)]
    far = np.flatnonzero(points > 65535)
    if len(far):
        inside[far] = [chr(c).isalnum() for c in points[far]]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Automaton:
    """The lexicon's trie, intersected with Levenshtein automata, determinised as far as texts lead.

    A state holds the trie node that its letters spell, the nodes that they reach with one
    error, and the nodes any child of which they reach with one error; past a stem anything
    goes. So a lexicon of any alphabet takes memory in proportion to its letters. States
    and verdicts on words are remembered by each worker within fixed bounds; only the terms are
    sent to it. Words and stems of FUZZY_FROM letters or more match with one error.
    """

    #: Steps of states, and letters of words, that a worker remembers.
    STEPS, LETTERS = 200_000, 1_000_000

    def __init__(self, words: list[str], stems: list[str]):
        self.terms = words, stems
        self.children: list[dict[str, int]] = [{}]
        self.exact: set[int] = set()
        self.stems: set[int] = set()
        long, long_stems = set(), set()
        for kind, terms in ((EXACT, words), (STEM, stems)):
            for term in terms:
                node = 0
                for c in term:
                    if c not in self.children[node]:
                        self.children.append({})
                        self.children[node][c] = len(self.children) - 1
                    node = self.children[node][c]
                (self.exact if kind == EXACT else self.stems).add(node)
                if len(term) >= FUZZY_FROM:
                    long.add(node)
                    if kind == STEM:
                        long_stems.add(node)
        self.long, self.long_stems = long, long_stems
        #: Of every node: the grandchildren by their letter, and whether a child ends a long term, or stem.
        self.grandchildren: list[dict[str, list[int]]] = []
        for kids in self.children:
            by_letter: dict[str, list[int]] = {}
            for child in kids.values():
                for c, node in self.children[child].items():
                    by_letter.setdefault(c, []).append(node)
            self.grandchildren.append(by_letter)
        self.before_long = {n for n, kids in enumerate(self.children) if not long.isdisjoint(kids.values())}
        self.before_long_stem = {n for n, kids in enumerate(self.children) if not long_stems.isdisjoint(kids.values())}
        self._forget_states()
        self.known: dict[str, int] = {}
        self.known_letters = 0

    def __reduce__(self):
        return Automaton, self.terms

    def _forget_states(self) -> None:
        """Keep the state of no letters, as number 1; 0 is the dead state."""
        start = (0, frozenset(), (0,), False, False)
        self.states, self.numbers = [None, start], {start: 1}
        self.steps: list[dict[str, int]] = [{}, {}]
        self.verdicts, self.remembered = [0, 0], 0

    def _step(self, number: int, letter: str) -> int:
        node, late, near, past, late_past = self.states[number]
        after = {self.children[n][letter] for n in late if letter in self.children[n]}
        for n in near:
            after.update(self.grandchildren[n].get(letter, ()))
        late_past = late_past or not self.long_stems.isdisjoint(late) or not self.before_long_stem.isdisjoint(near)
        past = past or node in self.stems
        child, near = -1, ()
        if node >= 0:
            after.add(node)  # the letter is one too many
            child = self.children[node].get(letter, -1)
            near = (node,) if child < 0 else (node, child)  # the letter stands for another, or the next one is lacking
        target = 0
        if after or child >= 0 or past or late_past:
            state = (child, frozenset(after), near, past, late_past)
            target = self.numbers.get(state)
            if target is None:
                target = self.numbers[state] = len(self.states)
                self.states.append(state)
                self.steps.append({})
                self.verdicts.append(self._verdict(*state))
        self.steps[number][letter] = target
        self.remembered += 1
        return target

    def _verdict(self, node: int, late: frozenset, near: tuple[int, ...], past: bool, late_past: bool) -> int:
        if node in self.exact:
            return EXACT
        if past or node in self.stems:
            return STEM
        return FUZZY if late_past or not self.long.isdisjoint(late) or not self.before_long.isdisjoint(near) else 0

    def kind(self, word: str) -> int:
        """How a word matches: 0, EXACT, FUZZY or STEM."""
        if self.remembered > self.STEPS:
            self._forget_states()
        state = 1
        for letter in word:
            target = self.steps[state].get(letter)
            state = self._step(state, letter) if target is None else target
            if not state:
                return 0
        return self.verdicts[state]

    def match(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words; numbers and kinds of the words that match."""
        starts, ends = word_edges(points)
        low = points.tobytes().decode("utf-32-le", "replace")
        if self.known_letters > self.LETTERS:
            self.known, self.known_letters = {}, 0
        words = [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        for word in set(words).difference(self.known):
            self.known[word] = self.kind(word)
            self.known_letters += len(word)
        kinds = np.array([self.known[w] for w in words], np.int8)
        numbers = np.flatnonzero(kinds)
        return starts, ends, numbers, kinds[numbers]


@dataclass
class Model:
    """A fitted scorer. Terms and plain values are sent to the executors: no more than the telling terms of the sample, whose size is bounded."""

    automaton: Automaton
    ordinary: frozenset[str]
    weights: np.ndarray
    words: list[str]
    stems: list[str]

    def hits(self, text: str) -> list[tuple[int, int, int, float]]:
        """(start, end, kind, weight) of every match, in code points."""
        low = lowered(text)
        points = _points(low)
        starts, ends, numbers, kinds = self.automaton.match(points)
        out = []
        marks = np.flatnonzero(_IS_MARK[np.minimum(points, 65535)]) if len(numbers) else None
        for number, kind in zip(numbers.tolist(), kinds.tolist(), strict=True):
            a, b = int(starts[number]), int(ends[number])
            if kind == FUZZY and low[a:b] in self.ordinary:
                continue
            first, last = max(0, number - WINDOW), min(len(starts), number + WINDOW + 1)
            left, right = int(starts[first]), int(ends[last - 1])
            around = {low[starts[k] : ends[k]] for k in range(first, last) if k != number}
            between = np.searchsorted(marks, [left, a, b, right])
            quoted = between[1] > between[0] and between[3] > between[2] or bool(around & _REPORTING)
            out.append((a, b, kind, 1 + QUOTED * quoted + AIMED * bool(around & _ADDRESS)))
        return out

    def features(self, hits: list[tuple[int, int, int, float]]) -> tuple[float, float]:
        sure = sum(w for *_, kind, w in hits if kind != FUZZY)
        return float(np.log1p(sure)), float(np.log1p(sum(w for *_, kind, w in hits if kind == FUZZY)))

    def score(self, hits: list[tuple[int, int, int, float]]) -> float:
        return float(1 / (1 + np.exp(-(self.weights[0] + np.dot(self.weights[1:], self.features(hits))))))


_REPORTING, _ADDRESS = frozenset(REPORTING), frozenset(ADDRESS)


def _terms(text: str) -> set[tuple[str, str]]:
    """A text's distinct words of four letters or more, and the beginnings of longer ones."""
    low = lowered(text)
    words = {low[a:b] for a, b in zip(*map(np.ndarray.tolist, word_edges(_points(low))), strict=True) if b - a >= 4}
    return {("word", w) for w in words} | {("stem", w[:k]) for w in words for k in STEM_LETTERS if len(w) > k}


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(text, toxic) of at most ``per_class`` labelled documents of each class, those with the smallest id hashes."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = known.filter("toxic = 0").orderBy(*order).limit(per_class).unionByName(known.filter("toxic = 1").orderBy(*order).limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").select("text", "toxic")  # per_class bounds what is broadcast


def choose_terms(telling: list[tuple[str, str, int, int]]) -> tuple[list[str], list[str]]:
    """Words and stems out of (kind, term, toxic families, clean families), the most telling first.

    All words stay; a stem goes if it overlaps with a word or stem that is more telling.
    """
    good = {(k, t): (p, n) for k, t, p, n in telling}
    words: list[str] = []
    stems: list[str] = []
    for (kind, term), (p, n) in sorted(good.items(), key=lambda x: (-(x[1][0] - 20 * x[1][1]), x[0][0] == "stem", -len(x[0][1]), x[0][1])):
        if kind == "word":
            words.append(term)  # even if a stem covers it, as its misspellings go by the whole word
        elif not any(w.startswith(term) for w in words) and not any(s.startswith(term) or term.startswith(s) for s in stems):
            stems.append(term)
    return words, stems


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights, the intercept first, by Newton's method; both classes weigh the same."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    penalty = ridge * np.diag([0.0, *[1.0] * (x.shape[1] - 1)]) * 0.05
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + penalty @ w
        curve = (x * (share * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def telling_terms(sample: DataFrame, n_toxic: int, n_clean: int) -> list[tuple[str, str, int, int]]:
    """(kind, term, toxic families, clean families) of all terms that are frequent enough in toxic documents and rare in clean ones."""

    def families():
        def rows(part: pa.RecordBatch) -> list[pa.Array]:
            out = set()
            for text in part.column(0).to_pylist():
                shingles = shingle_hashes(word_hashes(text.encode("utf-8", "replace")), 3)
                family = int(shingles.min() >> np.uint64(1)) if len(shingles) else 0
                out |= {(kind, term, family) for kind, term in _terms(text)}
            return [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))]

        return rows

    def counted(label: int, name: str) -> DataFrame:
        rows = rows_from_texts(sample.filter(F.col("toxic") == label).select("text"), "kind string, term string, family long", families)
        return rows.distinct().groupBy("kind", "term").agg(F.count(F.lit(1)).alias(name))

    p, n = F.col("p"), F.coalesce(F.col("n"), F.lit(0))
    frequent = counted(1, "p").filter(p >= max(LEAST_FAMILIES, n_toxic * 0.004))
    both = frequent.join(counted(0, "n"), ["kind", "term"], "left")
    good = both.filter((p + 0.5) / (n_toxic + 1) >= 20 * (n + 0.5) / (n_clean + 1))
    return [tuple(r) for r in good.select("kind", "term", p, n).collect()]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Model:
    """Learn lexicon and weights from labelled documents.

    At most ``per_class`` documents of each class are used, whole, and written once as a
    work table. Term counts go by
    families of documents (by one MinHash value of their word triples), so that the words of
    one text with many copies don't pass for a lexicon. Every term that is telling enough
    is considered: words of four letters or more, and stems of three to eight, as the
    shorter ones have too many other uses to be told by counts alone. The driver gets the counts of those, and two numbers a document. Defined
    cases: labels other than 0 and 1, and those without a doc_id or a document, are not
    learned from; null texts are empty; a label repeated for a document counts once, and
    one that contradicts it for both classes; rows repeated under one doc_id count each, as
    one family if they are equal; without labelled documents of both classes, or in empty
    tables, every score is the share of toxic labels, or 0.
    """
    sample = work_table(training_sample(docs, labels, per_class), "toxicity-sample").select("toxic", "text")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    words, stems = choose_terms(telling_terms(sample, n_toxic, n_clean)) if n_toxic and n_clean else ([], [])
    model = Model(Automaton(words, stems), frozenset(), np.array([_log_odds(n_toxic, n_clean), 0.0, 0.0]), words, stems)
    if not words and not stems:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def near():
        def rows(part: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for toxic, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                low = lowered(text)
                out += [(w, toxic) for w in {low[a:b] for a, b, kind, _ in shared.value.hits(text) if kind == FUZZY}]
            return [pa.array([w for w, _ in out], pa.string()), pa.array([t for _, t in out], pa.int32())]

        return rows

    # What looks like a misspelling but is common in clean documents is a word of its own.
    forms = rows_from_texts(sample, "word string, toxic int", near).groupBy("word").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    model.ordinary = frozenset(r.word for r in forms.filter((F.col("n") + 0.5) / (n_clean + 1) * 5 > (F.col("p") + 0.5) / (n_toxic + 1)).filter("n > 0").collect())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def features():
        def rows(part: pa.RecordBatch) -> list[pa.Array]:
            found = [shared.value.features(shared.value.hits(t)) for t in part.column(1).to_pylist()]
            return [pa.array([x for x, _ in found], pa.float64()), pa.array([x for _, x in found], pa.float64()), part.column(0)]

        return rows

    seen = np.array(sorted(tuple(r) for r in rows_from_texts(sample, "sure double, fuzzy double, toxic int", features).collect()))
    x, y = seen[:, :2], seen[:, 2]
    model.weights = _logistic(x, y)
    # Misspellings are rare in a sample: whatever it shows, one counts between half and all of the word itself.
    model.weights[2] = np.clip(model.weights[2] if x[:, 1].any() else FUZZY_SHARE * model.weights[1], 0.5 * model.weights[1], model.weights[1])
    return model


def _log_odds(n_toxic: int, n_clean: int) -> float:
    return float(np.log((n_toxic + 1e-9) / (n_clean + 1e-9))) if n_toxic + n_clean else -50.0


HITS = "array<struct<start:int,end:int,kind:string,weight:double>>"
KINDS = {EXACT: "exact", FUZZY: "misspelled", STEM: "stem"}


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7, with_hits: bool = True) -> DataFrame:
    """Score every whole text.

    Adds score (0 to 1), predicted (1 if score >= ``threshold``) and, if ``with_hits``,
    hits: the matches with their places in code points, kind and context weight. Columns
    of those names are replaced. Defined cases: null is an empty text, whose score is that
    of no match; repeated rows are scored each; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["score", "hits"] if with_hits else ["score"]

    def make():
        def scored(part: pa.Array) -> list[pa.Array]:
            found = [shared.value.hits(t.decode("utf-8", "replace")) for t in part.to_pylist()]
            out = [pa.array([shared.value.score(h) for h in found], pa.float64())]
            if with_hits:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("weight", pa.float64())]))
                out.append(pa.array([[{"start": a, "end": b, "kind": KINDS[k], "weight": w} for a, b, k, w in h] for h in found], kind))
            return out

        return scored

    over = [c for c in docs.columns if c.lower() == "predicted"]
    out = add_fields(docs.drop(*over), per_text("score double" + f", hits {HITS}" * with_hits, make)(utf8("text")), names)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
