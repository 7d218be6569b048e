"""Language identification by string kernels.

The kernel of two texts counts the character n-grams, of one to three characters, that
occur in both (blended spectrum, presence only), divided by the geometric mean of the
kernels of each with itself. Landmark texts of every language give the Nystrom map of a
text, and one ridge regression for each language against the rest is fitted on it. Texts
are scored in batches: a presence matrix times the landmarks' presence matrix gives the
kernels, and a second product the languages' values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import add_fields, per_text, rows_from_texts, utf8, work_table

UNKNOWN = "und"
#: At most so many documents in all and of a language are learned from; landmarks in all.
TRAIN_DOCS, TRAIN_PER_LANGUAGE, LANDMARKS = 4000, 300, 128
#: Texts and n-grams of a block of the presence matrix, code points looked at in one go.
_BATCH, _BLOCK, _STRETCH = 64, 8192, 1 << 18

_LETTER = np.zeros(65536, bool)
_LETTER[[k for k in range(65536) if chr(k).isalpha()]] = True
_SPACE = 32


def _points(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with one space for all that stands between letters; none without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTER[np.minimum(points, 65535)]
    far = np.flatnonzero(points > 65535)
    if len(far):
        letter[far] = [chr(c).isalpha() for c in points[far]]
    if not letter.any():
        return np.zeros(0, np.uint32)
    c = np.where(letter, points, np.uint32(_SPACE))
    c = c[letter | np.concatenate(([True], letter[:-1]))]
    edge = np.array([_SPACE], np.uint32)
    return np.concatenate((edge[: int(c[0] != _SPACE)], c, edge[: int(c[-1] != _SPACE)]))


def grams(text: str) -> np.ndarray:
    """Codes of the distinct n-grams of a text, sorted; none if it has no letter.

    Letters are lower-cased and everything between them becomes one space. Three code
    points of 21 bits fit in a code, so n-grams never share one. Long texts are gone
    through in stretches, so that memory follows the distinct n-grams.
    """
    c = _points(text)
    found = [np.zeros(0, np.uint64)] * 3
    for k in range(0, len(c), _STRETCH):
        one = c[k : k + _STRETCH + 2].astype(np.uint64)
        two = one[:-1] << np.uint64(21) | one[1:]
        three = two[:-1] << np.uint64(21) | one[2:]
        found = [np.unique(np.concatenate((old, np.unique(new)))) if len(old) else np.unique(new) for old, new in zip(found, (one, two, three), strict=True)]
    return np.concatenate(found)


@dataclass
class Model:
    """The fitted classifier. Its size is that of its landmarks' distinct n-grams, 12 bytes for each of a landmark."""

    languages: list[str]
    vocabulary: np.ndarray  # all n-grams of landmarks, sorted
    first: np.ndarray  # where each n-gram's landmarks begin in holders
    holders: np.ndarray
    roots: np.ndarray  # of each landmark's number of n-grams
    values: np.ndarray  # landmarks x languages: Nystrom map and regression in one
    offsets: np.ndarray

    @classmethod
    def of(cls, languages: list[str], marks: list[np.ndarray]) -> Model:
        codes = np.concatenate([*marks, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(marks), dtype=np.int32), [len(x) for x in marks])
        order = np.argsort(codes, kind="stable")
        vocabulary, first = np.unique(codes[order], return_index=True)
        roots = np.sqrt([len(x) for x in marks]).astype(np.float32)
        return cls(languages, vocabulary, np.append(first, len(codes)).astype(np.int32), owner[order], roots, np.zeros((len(marks), len(languages)), np.float32), np.zeros(len(languages), np.float32))

    def kernels(self, found: list[np.ndarray]) -> np.ndarray:
        """Normalised kernels of texts with the landmarks: products of presence matrices, a block of the n-grams at a time."""
        at = [np.searchsorted(self.vocabulary, codes) for codes in found]
        at = [x[self.vocabulary[np.minimum(x, len(self.vocabulary) - 1)] == codes] for x, codes in zip(at, found, strict=True)]
        used = np.unique(np.concatenate([*at, np.zeros(0, np.int64)]))
        out = np.zeros((len(found), len(self.roots)), np.float32)
        for lo in range(0, len(used), _BLOCK):
            block = used[lo : lo + _BLOCK]
            present = np.zeros((len(found), len(block)), np.float32)
            for row, x in zip(present, at, strict=True):
                row[np.searchsorted(block, x[np.searchsorted(x, block[0]) : np.searchsorted(x, block[-1], "right")])] = 1
            counts = self.first[block + 1] - self.first[block]
            marks = np.zeros((len(block), len(self.roots)), np.float32)
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            marks[np.repeat(np.arange(len(block)), counts), self.holders[np.repeat(self.first[block], counts) + within]] = 1
            out += present @ marks
        return out / self.roots / np.sqrt([[max(1, len(x))] for x in found]).astype(np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        found = [grams(t) for t in texts]
        best, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [k for k, x in enumerate(found) if len(x)]
        for i in range(0, len(known) if self.languages else 0, _BATCH):
            part = known[i : i + _BATCH]
            scores = self.kernels([found[k] for k in part]) @ self.values + self.offsets
            for k, row in zip(part, scores, strict=True):
                best[k], score[k] = self.languages[row.argmax()], float(np.clip((row.max() + 1) / 2, 0, 1))
        return best, score


def training_sample(docs: DataFrame, total: int, per_language: int) -> DataFrame:
    """(lang, text): a bounded number of documents of every language, those with the smallest id hashes."""
    known = docs.filter("text is not null and lang is not null and doc_id is not null").select("doc_id", "lang")
    languages = max(1, known.select("lang").distinct().count())
    share = max(1, min(per_language, total // languages))
    ranked = known.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")))
    picked = ranked.filter(F.col("k") <= share).select("doc_id", "lang").distinct()
    texts = docs.filter("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").select("lang", "text")  # share bounds what is broadcast


def choose_landmarks(sizes: list[tuple[str, int, str]], landmarks: int) -> list[str]:
    """The digests of the landmark texts out of (lang, n-grams, digest): by language, of all sizes but the smallest fifth, evenly spread."""
    out: list[str] = []
    languages = sorted({lang for lang, _, _ in sizes})
    for lang in languages:
        own = sorted((n, digest) for at, n, digest in sizes if at == lang)
        count = min(len(own), max(1, landmarks // len(languages)))
        out += [own[k][1] for k in np.unique(np.linspace(len(own) * 0.2, len(own) - 1, count).astype(int))]
    return out


def fit(docs: DataFrame, total: int = TRAIN_DOCS, per_language: int = TRAIN_PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = 1e-2) -> Model:
    """Learn from the texts and non-null lang of ``docs``, a sample bounded by ``total`` and ``per_language``.

    The sample is one written table. Executors code its whole texts; the driver gets the
    n-grams of the landmarks, one row of kernels for each sampled text, and solves systems
    of the size of the landmarks. Defined cases: texts without a letter, and rows whose
    text, lang or doc_id is null, are not learned from; equal texts of one language count
    once, and of several languages for each; ties in the order of texts go by their
    digests; rows repeated under one doc_id count once if their text is the same; an empty
    table gives a model that knows no language.
    """
    sample = work_table(training_sample(docs, total, per_language), "language-sample")
    sample = sample.select("lang", F.sha2("text", 256).alias("digest"), "text").dropDuplicates(["lang", "digest"])

    def sized():
        return lambda part: [part.column(0), pa.array([len(grams(t)) for t in part.column(2).to_pylist()], pa.int64()), part.column(1)]

    sizes = [tuple(r) for r in rows_from_texts(sample, "lang string, n long, digest string", sized).filter("n > 0").collect()]
    languages = sorted({lang for lang, _, _ in sizes})
    chosen = choose_landmarks(sizes, landmarks)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"digest": batch["digest"], "codes": [grams(t).tobytes() for t in batch["text"]]})

    marks = sample.filter(F.col("digest").isin(chosen)).dropDuplicates(["digest"]).mapInPandas(coded, "digest string, codes binary")
    codes = {r.digest: np.frombuffer(r.codes, np.uint64) for r in marks.toLocalIterator()} if chosen else {}
    model = Model.of(languages, [codes[d] for d in chosen])
    if not languages:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compared():
        def rows(part: pa.RecordBatch) -> list[pa.Array]:
            found = [grams(t) for t in part.column(2).to_pylist()]
            some = [k for k, x in enumerate(found) if len(x)]
            near = [row.tobytes() for i in range(0, len(some), _BATCH) for row in shared.value.kernels([found[k] for k in some[i : i + _BATCH]])]
            return [part.column(0).take(pa.array(some, pa.int64())), pa.array(near, pa.binary())]

        return rows

    # Bounded by total: one row of kernels for each sampled text.
    seen = sorted((r.lang, bytes(r.near)) for r in rows_from_texts(sample, "lang string, near binary", compared).collect())
    model.values, model.offsets = solve(model, [lang for lang, _ in seen], np.array([np.frombuffer(x, np.float32) for _, x in seen], float), [codes[d] for d in chosen], ridge)
    return model


def solve(model: Model, known: list[str], near: np.ndarray, marks: list[np.ndarray], ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of the ridge regressions on the Nystrom map; all languages weigh the same."""
    among = model.kernels(marks).astype(float)
    size, vectors = np.linalg.eigh((among + among.T) / 2)
    kept = size > 1e-6 * size.max()
    root = vectors[:, kept] / np.sqrt(size[kept])  # the Nystrom map: kernels with the landmarks times this
    mapped = near @ root
    truth = np.array([[1.0 if lang == at else -1.0 for lang in model.languages] for at in known])
    weight = np.array([len(known) / len(model.languages) / known.count(at) for at in known])[:, None]
    centre, mean = (mapped * weight).sum(0) / weight.sum(), (truth * weight).sum(0) / weight.sum()
    system = (weight * (mapped - centre)).T @ (mapped - centre) + ridge * np.eye(mapped.shape[1])
    solved = np.linalg.solve(system, (weight * (mapped - centre)).T @ (truth - mean))
    return (root @ solved).astype(np.float32), (mean - centre @ solved).astype(np.float32)


def identify_language(docs: DataFrame, model: Model) -> DataFrame:
    """Predict the language of every whole text from the text alone.

    Adds lang_pred (a learned language) and score (0 to 1; columns of those names are
    replaced). Defined cases: a null text, one without any letter, or a model that has
    learned nothing gives ``und`` with score 0; on a tie the first language by name wins;
    repeated rows are predicted each; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def predicted(part: pa.Array) -> list[pa.Array]:
            best, score = shared.value.predict([t.decode() for t in part.to_pylist()])
            return [pa.array(best, pa.string()), pa.array(score, pa.float64())]

        return predicted

    return add_fields(docs, per_text("lang_pred string, score double", make)(utf8("text")), ["lang_pred", "score"])
