"""The corpus queries against SQL or brute force over the smallest tables."""

import hashlib
import re
import zlib
from array import array

import pytest

from scriptorium.llm import line_dedup
from scriptorium.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from tests.compare import difference


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sample, name):
    assert difference(spark, name, QUERIES[name], ORACLE_SQL[name], sample) is None


def documents(spark, sample):
    return {r.doc_id: r for r in spark.read.parquet(f"{sample}/documents.parquet").collect()}


def test_op1_held_out_accuracy(spark, sample):
    docs = documents(spark, sample)
    rows = QUERIES["op1_language_id"](spark, sample).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


EXPRESSIONS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_digest(text):
    spans = sorted((m.start(), n, kind, m.end()) for n, (kind, p) in enumerate(EXPRESSIONS.items()) for m in re.finditer(p, text or "") if valid(kind, m[0]))
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest(), [k for _, _, k, _ in spans]


def test_op2_base_spans(spark, sample):
    docs = documents(spark, sample)
    for r in QUERIES["op2_pii"](spark, sample).collect():
        digest, kinds = base_digest(docs[r.doc_id].text)
        assert r.base_sha256 == digest and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in EXPRESSIONS]


def test_op5_learns_only_from_its_part(spark, sample):
    rows = QUERIES["op5_toxicity"](spark, sample).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_op7_op8_equal_the_libraries(spark, sample):
    import sentencepiece
    from tokenizers import Tokenizer

    docs = documents(spark, sample)
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for r in QUERIES["op7_sentencepiece"](spark, sample).collect():
        ids = model.encode(docs[r.doc_id].text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(array("i", ids).tobytes()).hexdigest() and r.round_trip and r.parity in (True, None)
    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for r in QUERIES["op8_token_counts"](spark, sample).collect():
        n = len(whole.encode(docs[r.doc_id].text, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(docs[r.doc_id].text.encode()), n > 1024)


def test_pipeline_stages_against_brute_force(spark, sample):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sample}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dup", "decontaminate", "sentencepiece"]
    steps = dict(corpus_pipeline.STAGES)

    kept = steps["toxicity"](spark, docs, sample)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sample}/labels.parquet").collect()}
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    clean = [i for i, t in labels.items() if t == 0]
    assert kept.columns == docs.columns and sum(i in left for i in clean) >= 0.97 * len(clean)

    lines = steps["line_dedup"](spark, docs, sample)
    texts = {r.doc_id: r.text for r in docs.collect()}
    first: dict[bytes, int] = {}
    holders: dict[bytes, set] = {}
    for i in sorted(texts):
        for line in texts[i].encode().split(b"\n"):
            if (k := line_dedup.line_key(line, 10)) is not None:
                first.setdefault(k, i)
                holders.setdefault(k, set()).add(i)
    want = {}
    for i, t in texts.items():
        held = [x for x in t.split("\n") if (k := line_dedup.line_key(x.encode(), 10)) is None or len(holders[k]) < 2 or first[k] == i]
        if "\n".join(held).strip(" \t\n\r\x0b\x0c") or len(held) == len(t.split("\n")):
            want[i] = "\n".join(held)
    assert {r.doc_id: r.text for r in lines.collect()} == want

    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() if (w := t.lower().split())}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {r.doc_id for r in steps["near_dup"](spark, docs, sample).select("doc_id").collect()} == {i for i in texts if root(i) == i}

    def runs(text):
        w = text.encode().lower().split()
        n = min(5, len(w))
        return {b" " + b" ".join(w[k : k + n]) + b" " for k in range(len(w) - n + 1)} if w else set()

    items = [x for r in spark.read.parquet(f"{sample}/benchmark.parquet").collect() if (x := runs(r.text))]
    flat = {i: b" " + b" ".join(t.encode().lower().split()) + b" " for i, t in texts.items()}
    bad = {i for i, t in flat.items() for x in items if 100 * sum(run in t for run in x) >= 80 * len(x)}
    assert {r.doc_id for r in steps["decontaminate"](spark, docs, sample).select("doc_id").collect()} == set(texts) - bad and bad


def test_pipeline_runs(spark, sample):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sample)
    rows = out.select("doc_id", "n_tokens", "token_ids", "round_trip").collect()
    assert rows and all(len(r.token_ids) == r.n_tokens and r.round_trip for r in rows)
