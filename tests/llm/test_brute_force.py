"""Operators that SQL can't express, against plain versions written apart from them, over the smallest tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex

from scriptorium.llm import near_dup, toxicity
from scriptorium.llm.queries import QUERIES
from tests.llm.test_queries import EXPRESSIONS, documents, valid


def grams(text):
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    t = " " + " ".join(letters) + " "
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} if letters else set()


def test_op1_equals_plain_kernel_ridge(spark, sample):
    docs = documents(spark, sample)
    sets = {i: grams(r.text) for i, r in docs.items()}
    learned = sorted({(r.lang, len(sets[i]), hashlib.sha256(r.text.encode()).hexdigest(), i) for i, r in docs.items() if r.lang and sets[i] and zlib.crc32(str(i).encode()) % 4 != 2})
    learned = list({x[:3]: x for x in reversed(learned)}.values())[::-1]  # equal texts of a language once
    languages = sorted({x[0] for x in learned})
    marks = []
    for lang in languages:
        own = [x for x in learned if x[0] == lang]
        marks += [sets[own[k][3]] for k in sorted({int(k) for k in np.linspace(len(own) * 0.2, len(own) - 1, min(len(own), 128 // len(languages)))})]

    def kernels(of):
        return np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in marks] for a in of])

    size, vectors = np.linalg.eigh(kernels(marks))
    root = vectors[:, size > 1e-6 * size.max()] / np.sqrt(size[size > 1e-6 * size.max()])
    x = kernels([sets[i] for *_, i in learned]) @ root
    y = np.array([[1.0 if lang == at else -1.0 for lang in languages] for at, *_ in learned])
    w = np.array([len(learned) / len(languages) / sum(at == b[0] for b in learned) for at, *_ in learned])[:, None]
    mx, my = (w * x).sum(0) / w.sum(), (w * y).sum(0) / w.sum()
    solved = np.linalg.solve((w * (x - mx)).T @ (x - mx) + 1e-2 * np.eye(x.shape[1]), (w * (x - mx)).T @ (y - my))
    rows = QUERIES["op1_language_id"](spark, sample).collect()
    scores = (kernels([sets[r.doc_id] or {"none"} for r in rows]) @ root - mx) @ solved + my
    for r, s in zip(rows, scores, strict=True):
        if not sets[r.doc_id]:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == languages[s.argmax()] and abs(r.score - min(1, max(0, (s.max() + 1) / 2))) < 1e-3


CANDIDATE = regex.compile(
    r"(?<![A-Za-z0-9_@.+:/-])(?:[+(]?[0-9](?:[0-9().\x20-]*[0-9])?(?![A-Za-z0-9_@]|[.+:/-]++[A-Za-z])"
    r"|(?=[A-Za-z_.+:/-]*+(?:[0-9@]|[(\[]at[)\]]))[A-Za-z0-9](?:[A-Za-z0-9_@.+:/()\[\]-]*[A-Za-z0-9])?)"
)


def secret(value):
    digits, letters = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value)
    return bool(regex.fullmatch(r"[A-Za-z0-9]{16,}", value) and digits >= 3 and letters >= 3 or regex.fullmatch(r"AKIA[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36,}", value))


def context(left, right):
    """80 code points before and 40 after, without words that go on beyond."""
    if len(left) > 80:
        k = len(left) - 81
        while k < len(left) and regex.match(r"\p{L}", left[k]):
            k += 1
        left = left[k:]
    if len(right) > 40:
        k = 41
        while k and regex.match(r"\p{L}", right[k - 1]):
            k -= 1
        right = right[:k]
    return left, right


def patterns(left, right):
    plain = lambda t: regex.sub("[0-9]", "9", regex.sub(r"[\x20\x09-\x0D]+", " ", t.lower()))
    left, right = plain(left), plain(right)
    if m := regex.search(r"\p{L}+[^\p{L}]{1,8}\p{L}+[^\p{L}]{0,6}$", left):
        yield "before", m[0] + "_"
    if m := regex.search(r"\p{L}+[^\p{L}]{0,4}[=:#][^\p{L}]{0,4}$", left):
        yield "label", m[0] + "_"
    if (m := regex.search(r"\p{L}+[^\p{L}]{0,6}$", left)) and (n := regex.match(r"[^\p{L}]{0,6}\p{L}+", right)):
        yield "around", m[0] + "_" + n[0]


def supported(edges, confidence, kinds):
    by_pattern = defaultdict(dict)
    for (pattern, _), values in edges.items():
        for v in values:
            by_pattern[pattern][v] = (confidence.get(v, 0.0), kinds.get(v), v in kinds and confidence[v] == 1.0)
    out = {}
    for pattern, values in by_pattern.items():
        parts = {}
        for c, kind, seed in values.values():
            if kind is not None:
                p = parts.setdefault(kind, [0, 0, kind, 0.0])
                p[0], p[1], p[3] = p[0] + seed, p[1] + (c >= 0.7), p[3] + c
        if parts:
            _, support, kind, total = max(map(tuple, parts.values()))
            if support >= 3 and support >= 0.05 * len(values):
                out[pattern] = (total / (len(values) + 1), kind)
    return out


def test_op2_equals_plain_bootstrapping(spark, sample):
    spans, edges, seeds = {}, defaultdict(set), {}
    for i, r in documents(spark, sample).items():
        text, base = r.text or "", []
        for kind, p in (*EXPRESSIONS.items(), ("candidate", CANDIDATE)):
            found = list(regex.finditer(p, text))
            bounds = [(0, 0), *(m.span() for m in found), (len(text), len(text))]
            for k, m in enumerate(found, 1):
                if kind == "candidate" and any(a < m.end() and m.start() < b for a, b, *_ in base if _[0] != "candidate") or kind != "candidate" and not valid(kind, m[0]):
                    continue
                base.append((*m.span(), kind, m[0], list(patterns(*context(text[bounds[k - 1][1] : m.start()], text[m.end() : bounds[k + 1][0]])))))
        spans[i] = base
        for *_, kind, value, around in base:
            seed = kind if kind != "candidate" else "secret" if secret(value) else None
            for type_, pattern in around:
                edges[pattern, type_].add(value.lower())
                if seed:
                    seeds[value.lower()] = min(seed, seeds.get(value.lower(), seed))
    confidence, kinds = dict.fromkeys(seeds, 1.0), dict(seeds)
    for _ in range(3):
        active = supported(edges, confidence, kinds)
        lack, given = defaultdict(dict), {}
        for (pattern, type_), values in edges.items():
            for v in values:
                if v not in seeds and pattern in active:
                    lack[v][type_] = max(lack[v].get(type_, (0.0, "", "")), (active[pattern][0], pattern, active[pattern][1]))
        for v, by_type in lack.items():
            given[v] = (1 - math.prod(1 - c for c, *_ in by_type.values()), max(by_type.values())[2])
        confidence = dict.fromkeys(seeds, 1.0) | {v: c for v, (c, _) in given.items()}
        kinds = dict(seeds) | {v: k for v, (_, k) in given.items()}
    sure = {p: x for p, x in supported(edges, confidence, kinds).items() if x[0] >= 0.7}
    order = list(EXPRESSIONS)
    for r in QUERIES["op2_pii"](spark, sample).collect():
        want = []
        for a, b, kind, value, around in spans[r.doc_id]:
            if kind == "candidate":
                hits = [(*sure[p], p) for _, p in around if p in sure]
                kind = "ctx_" + max((c, p, k) for c, k, p in hits)[2] if hits else None
            if kind:
                want.append((a, order.index(kind) if kind in order else len(order), kind, b))
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(want)), r.doc_id
        assert r.n_spans == len(want)


def near(word, term):
    """Whether one edit or none lies between the two."""
    if abs(len(word) - len(term)) > 1:
        return False
    k = next((k for k, (a, b) in enumerate(zip(word, term, strict=False)) if a != b), min(len(word), len(term)))
    return word[k + 1 :] == term[k + 1 :] or word[k:] == term[k + 1 :] or word[k + 1 :] == term[k:]


def test_op5_hits_and_scores_equal_a_plain_search(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sample}/labels.parquet"))
    assert model.words
    for r in toxicity.score_toxicity(docs, model).collect():
        words = [m.span() for m in regex.finditer(r"[^\W_]+", r.text)]
        low, want = r.text.lower(), []
        if len(low) != len(r.text):
            continue
        for n, (a, b) in enumerate(words):
            w = low[a:b]
            fuzzy = any(len(t) >= 5 and near(w, t) for t in model.words) or any(len(s) >= 5 and any(near(w[:k], s) for k in range(len(s) - 1, len(s) + 2)) for s in model.stems)
            kind = "exact" if w in model.words else "stem" if any(w.startswith(s) for s in model.stems) else "misspelled" if fuzzy and w not in model.ordinary else None
            if not kind:
                continue
            lo, hi = max(0, n - 8), min(len(words), n + 9)
            around = {low[x:y] for k, (x, y) in enumerate(words[lo:hi], lo) if k != n}
            marks = lambda t: any(c in toxicity.MARKS for c in t)
            quoted = marks(r.text[words[lo][0] : a]) and marks(r.text[b : words[hi - 1][1]]) or bool(around & set(toxicity.REPORTING))
            want.append((a, b, kind, 1 - 0.75 * quoted + 0.5 * bool(around & set(toxicity.ADDRESS))))
        assert [(h.start, h.end, h.kind, h.weight) for h in r.hits] == want, r.doc_id
        sure, odd = (math.log1p(sum(w for *_, k, w in want if (k == "misspelled") == x)) for x in (False, True))
        assert abs(r.score - 1 / (1 + math.exp(-(model.weights[0] + model.weights[1] * sure + model.weights[2] * odd)))) < 1e-9


def test_signatures_of_large_sets_tell_them_apart():
    rng = np.random.default_rng(3)
    hasher = near_dup.CirculantMinHash()
    a, b = (np.unique(rng.integers(0, 2**64, 300_000, np.uint64)) for _ in range(2))
    assert not set(hasher.band_keys(a, 85)) & set(hasher.band_keys(b, 85))
    # At the threshold, on either side of a border between two circles.
    for size in (1000, 65_400):
        whole = np.unique(rng.integers(0, 2**64, int(size / 0.85), np.uint64))
        part = np.sort(rng.permutation(whole)[: int(len(whole) * 0.86)])
        assert set(hasher.band_keys(whole, 85)) & set(hasher.band_keys(part, 85))


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_rare_prefix_pairs_hold_every_link_between_parts(spark, percent):
    """One passage is in all texts, and sizes lie close together, so that links cross the borders of size classes."""
    rng = random.Random(percent)
    passage = [f"p{i}" for i in range(40)]
    texts = {i: " ".join(passage[: rng.randrange(8, 41)] + [f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 8))]) for i in range(150)}
    texts |= {i: texts[i - 150] + rng.choice(["", " more"]) for i in range(150, 220)}
    rows = spark.createDataFrame([(i, i // 2, bytearray(t.encode())) for i, t in texts.items()], "id long, part long, text binary")
    pairs = {(r.a, r.b) for r in near_dup.rare_prefix_pairs(rows, 3, percent).collect()}

    def shingles(text):
        words = text.split()
        return {tuple(words[k : k + 3]) for k in range(len(words) - 2)} or {tuple(words)}

    sets = {i: shingles(t) for i, t in texts.items()}
    links = {(a, b) for a in sets for b in sets if a < b and a // 2 != b // 2 and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert links and links <= pairs
    assert all(a < b and a // 2 != b // 2 for a, b in pairs)
