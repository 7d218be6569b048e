"""op11 against a plain ranking of every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from scriptorium.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    documents, length = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for at, (i, c) in enumerate(counts):
            m = 100 - 50 + (50 * c.total() * documents) // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, at))
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i, _) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def got(spark, docs, items, k):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = lexical_search.search(d, spark.createDataFrame(items, "item_id long, text string"), k).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=repr)


def test_terms():
    texts = ["", "Ab-cd_é9\x7f{x}", "ÀB日本 ünï\x00q", "\x85\xa0a", "a" * 100_000]
    assert [[t.decode() for t in lexical_search.terms(x.encode())] for x in texts] == [plain_terms(x) for x in texts]


@pytest.mark.parametrize("k,seed", [(1, 1), (3, 2), (10, 3)])
def test_equals_plain_ranking(spark, k, seed):
    rng = random.Random(seed)
    words = [f"w{n}" for n in range(60)]
    odds = [1 / (n + 1) for n in range(60)]
    docs = [(n, " ".join(rng.choices(words, odds, k=rng.randrange(1, 80)))) for n in range(300)]
    docs += [(1000 + n, docs[7][1]) for n in range(40)] + [(7, docs[7][1]), (None, docs[7][1]), (2000, None), (2001, ""), (2002, " -- ")]
    items = [(n, " ".join(rng.choices(words, k=12))) for n in range(12)] + [(50, docs[7][1]), (51, "w0 w0 W1"), (52, "unknown"), (53, None), (54, ""), (None, "w3 w59"), (50, docs[7][1])]
    # A repeated row without further distinction can stand for its twin: only their ids and scores are compared.
    assert got(spark, docs, items, k) == plain(docs, items, k)


def test_pruning_does_prune_and_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, "One line that repeats itself"), (2, "日本語 word 😀"), (3, None)], "item_id long, text string")
    out = lexical_search.search(edge, items).collect()
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in out), key=repr) == plain(rows, [(1, "One line that repeats itself"), (2, "日本語 word 😀"), (3, None)], 50)
    assert lexical_search.search(empty, items).count() == 0 and lexical_search.search(edge, items.limit(0)).count() == 0


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    docs = [(n, " ".join(rng.choices(["the", "of", *(f"x{j}" for j in range(20))], [40, 30, *[1] * 20], k=30))) for n in range(200)]
    items = [(n, " ".join(rng.choices(["the", "of", *(f"x{j}" for j in range(20))], k=6))) for n in range(8)]
    monkeypatch.setattr("scriptorium.llm.common.BROADCAST_ROWS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert got(spark, docs, items, 5) == plain(docs, items, 5)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
