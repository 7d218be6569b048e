"""Corpus operators on small tables made for them: rules, odd input, and brute force."""

import hashlib
import pickle
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import chat, components, decontaminate, language_id, line_dedup, near_dup, pii, quality, sentencepiece_codec, token_counts, toxicity
from scriptorium.llm.common import shingle_hashes, word_hashes
from scriptorium.llm.queries import tokenizer_path

# Odd input -----------------------------------------------------------------------


def same_rows(edge, out, extra=()):
    """As many rows as documents, and the documents' own columns apart from those replaced."""
    assert out.count() == edge.count()
    assert set(edge.columns) - set(out.columns) <= set(extra) and len(out.columns) == len({c.lower() for c in out.columns})


def test_language_on_odd_input(spark, edge, empty):
    model = language_id.fit(edge)
    out = language_id.identify_language(edge, model)
    same_rows(edge, out)
    got = {(r.doc_id, r.lang_pred == "und") for r in out.collect()}
    assert {i for i, u in got if u} == {1, 2, 3, 7} and all(r.score == 0 for r in out.filter("lang_pred = 'und'").collect())
    assert language_id.identify_language(empty, model).count() == 0
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.identify_language(edge, nothing).collect()} == {"und"}


def test_pii_on_odd_input(spark, edge, empty):
    out = pii.digest_spans(pii.find_pii(edge)).collect()
    assert len(out) == edge.count()
    row = next(r for r in out if r.doc_id == 11)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in out if r.doc_id in (1, 2, 3, 4))
    assert pii.digest_spans(pii.find_pii(empty)).count() == 0


def test_decontaminate_on_odd_input(spark, edge, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, "mail me: a.b@c.de, +1 (555)"), (4, "other words that never come"), (None, "x"), (5, "word word word word word word")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_overlaps(edge, items).collect()}
    assert got == {(4, 3), (11, 4), (9, 5)}
    assert decontaminate.decontaminate(edge, items).count() == edge.count() - 3
    assert decontaminate.benchmark_overlaps(empty, items).count() == 0 and decontaminate.benchmark_overlaps(edge, items.limit(0)).count() == 0


def test_lines_on_odd_input(spark, edge, empty):
    out = line_dedup.dedup_lines(edge)
    same_rows(edge, out)
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert got[6].n_dropped == 1 and got[6].text == "zz" and got[5].n_dropped == 0 and got[1].n_lines == 1
    assert out.filter("doc_id is null").first().n_dropped == 0 and got[8].n_dropped == 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_toxicity_on_odd_input(spark, edge, empty):
    labels = spark.createDataFrame([(5, 1), (6, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    for docs, known in ((edge, labels), (edge, labels.limit(0)), (edge, labels.filter("toxic = 1"))):
        out = toxicity.score_toxicity(docs, toxicity.fit(docs, known))
        same_rows(edge, out)
        assert all(0 <= r.score <= 1 for r in out.collect())
    assert toxicity.score_toxicity(empty, toxicity.fit(empty, labels)).count() == 0


def test_codec_on_odd_input(spark, edge, empty):
    out = sentencepiece_codec.encode_documents(edge, tokenizer_path("piece_bpe_32k.model"))
    same_rows(edge, out)
    assert all(r.round_trip and r.parity in (True, None) for r in out.collect()) and out.filter("doc_id = 1").first().n_tokens == 0
    assert sentencepiece_codec.encode_documents(empty, tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_counts_on_odd_input(spark, edge, empty):
    out = token_counts.count_tokens(edge, tokenizer_path("byte_bpe_50k.json"))
    same_rows(edge, out)
    whole = token_counts.load_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in edge.select("doc_id", "text").collect()}
    assert all(r.n_tokens == len(whole.encode(texts[r.doc_id]).ids) for r in out.collect())
    assert token_counts.count_tokens(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_near_duplicates_on_odd_input(spark, edge, empty):
    rows = {r.doc_id: r for r in near_dup.near_duplicates(edge).collect()}
    assert near_dup.near_duplicates(edge).count() == edge.count()
    assert all(rows[i].n_shingles == 0 and rows[i].kept for i in (1, 2, 3)) and rows[None].component_id is None and rows[None].kept
    assert rows[4].n_shingles == 1 and rows[9].n_shingles == 1 and rows[8].component_id == 8
    assert near_dup.near_duplicates(empty).count() == 0


def test_quality_on_odd_input(spark, edge, empty):
    out = quality.judge(quality.measure_documents(edge))
    same_rows(edge, out)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].base_failed and rows[1].n_words == 0 and rows[1].host_rate is None
    assert rows[9].n_repeat_words == 30000 and rows[9].base_failed and rows[5].n_dup_lines == 1
    assert quality.judge(quality.measure_documents(empty)).count() == 0


def test_stages_on_odd_input(spark, sample, edge, empty):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge, sample)
        assert out.select("doc_id").distinct().count() >= 10, name
        if name != "sentencepiece":
            assert out.columns == edge.columns and {r[0] for r in out.select("score").collect()} == {"own"}, name
        assert stage(spark, empty, sample).count() == 0, name


# Rules ---------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "a", "It's", "é", "12", "日本語", "😀", "<|endoftext|>", "\t", "...", "longword" * 5, "\x85", "\x1c"]), max_size=60))
def test_token_counts_of_chunks(parts):
    text = "".join(parts)
    counter = _counter()
    assert counter.count([text]) == counter.short([text]) == [counter.long(text)] == counter.whole([text])


def _counter(cache={}):
    if not cache:
        cache["c"] = token_counts.Counter(token_counts.load_tokenizer(tokenizer_path("byte_bpe_50k.json")), chunk=40, overlap=8)
    return cache["c"]


def test_token_counter_refuses_other_tokenizers():
    with pytest.raises(ValueError):
        token_counts.load_tokenizer(tokenizer_path("word_bpe_49k.json"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([" ", "   ", "\n", "a", "hello", "é", "日本語", "😀", "<s>", "\t", "...", "longword" * 3, "\x00", "ﬁ"]), max_size=30))
def test_codec_parity_and_round_trip(parts):
    text = "".join(parts)
    codec = _codec()
    encoded = codec.encode([text])
    assert codec.same([text], encoded) == [True] and codec.decode(encoded) == [text]


def _codec(cache={}):
    if not cache:
        cache["c"] = sentencepiece_codec.Codec(tokenizer_path("piece_bpe_32k.model"))
    return cache["c"]


def test_codec_of_a_unigram_model():
    """A small unigram model written by hand: scores decide, bytes stand for the rest."""

    def field(number, payload):
        return bytes([number << 3 | 2, len(payload)]) + payload

    import struct

    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{b:02X}>", 0, 6) for b in range(256)), ("▁", -3, 1), ("a", -3, 1), ("b", -3, 1), ("▁a", -2, 1), ("ab", -2.5, 1), ("▁ab", -4.0, 1)]
    model = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([k])) for p, s, k in pieces)
    model += field(2, b"\x18\x01" + b"\x98\x02\x01") + field(3, field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01")
    codec = sentencepiece_codec.Codec("", model)
    texts = ["ab a", "abab b", "é ab", ""]
    assert all(codec.same(texts, codec.encode(texts))) and codec.decode(codec.encode(texts)) == texts


def test_perfect_hash_is_minimal_and_exact():
    random_ = np.random.default_rng(1)
    h1, h2 = random_.integers(-(2**63), 2**63, (2, 5000))
    index = line_dedup.PerfectHash.load(line_dedup.PerfectHash.build(h1, h2, np.arange(5000), np.arange(5000)).dump())
    assert sorted(index.slots(index._code(h1, h2))) == list(range(5000))
    found, counts, keepers = index.probe(h1, h2)
    assert found.all() and (counts == np.arange(5000)).all() and (keepers == np.arange(5000)).all()
    assert not index.probe(*random_.integers(-(2**63), 2**63, (2, 5000)))[0].any()


def test_near_duplicates_equal_brute_force(spark):
    random_ = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = [[random_.choice(words) for _ in range(120)] for _ in range(12)]
    texts = []
    for k in range(160):
        w = list(base[k % 12] if k % 3 else random_.choice(base))
        for _ in range(random_.randint(0, 14)):
            w[random_.randrange(len(w))] = random_.choice(words)
        texts.append(" ".join(w[: random_.choice([120, 120, 110, 60])]))
    texts += texts[:20]
    sets = [set(zip(t.split(), t.split()[1:], t.split()[2:], strict=False)) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dup.near_duplicates(docs, 3, 85).collect()}
    assert got == {i: (root(i), len(sets[i])) for i in range(len(texts))}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 150), (150, 200)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}, 150: 150, 200: 150}


def test_word_hashes_follow_the_words():
    a, b = word_hashes(b" One two\tONE \n"), word_hashes("one zwei é".encode())
    assert a[0] == a[2] == b[0] and len({int(x) for x in (*a, *b)}) == 4
    assert len(shingle_hashes(a, 3)) == 1 and len(shingle_hashes(a, 5)) == 1 and len(shingle_hashes(word_hashes(b""), 3)) == 0


def test_many_short_items_cost_little():
    random_ = random.Random(9)
    words = [f"s{k}" for k in range(300)]
    items = [(k, " ".join(random_.choice(words) for _ in range(random_.randint(1, 4))).encode()) for k in range(2000)]
    texts = [" ".join(random_.choice(words) for _ in range(300)).encode() for _ in range(100)]
    index = decontaminate.ItemIndex(items, 5, 80)
    start = time.process_time()
    got = {(at, item) for at, item, _, _ in index.search(texts)}
    assert time.process_time() - start < 2.5
    assert got == {(at, k) for at, t in enumerate(texts) for k, x in items if b" " + x + b" " in b" " + t + b" "}


def test_items_in_many_blocks(spark):
    items = spark.range(600).selectExpr("id as item_id", "concat_ws(' ', 'x', id, id + 1, id + 2, id + 3, id + 4, 'y') as text")
    docs = spark.range(600).selectExpr("id as doc_id", "concat_ws(' ', 'some words ahead x', id, id + 1, id + 2, id + 3, id + 4, 'y and behind') as text")
    for scan_bytes in (1, 10**9):
        out = decontaminate.benchmark_overlaps(docs, items, block_items=150, scan_bytes=scan_bytes)
        assert out.count() == 600 and out.filter("doc_id <> item_id").count() == 0


def test_blocks_share_scans():
    assert decontaminate.scans({0: 50, 1: 40, 2: 70, 3: 200, 4: 1}, 100) == [[0, 1], [2], [3], [4]] and decontaminate.scans({}, 9) == []
    items = [(k, " ".join(f"m{(k * 7 + j) % 900}" for j in range(k % 30)).encode()) for k in range(400)]
    texts = [t + b" and more words behind" for _, t in items]
    whole = decontaminate.ItemIndex(items, 5, 80)
    parts = decontaminate.ItemIndex.merged([decontaminate.ItemIndex(items[k : k + 90], 5, 80) for k in range(0, 400, 90)])
    assert sorted(parts.search(texts)) == sorted(whole.search(texts)) and parts.search(texts)


def test_a_long_item_in_a_long_text_takes_linear_time():
    random_ = random.Random(3)
    words = [f"w{k}" for k in range(50_000)]
    item, around = (" ".join(random_.choices(words, k=n)).encode() for n in (50_000, 200_000))
    index = decontaminate.ItemIndex([(1, item)], 5, 80)
    start = time.process_time()
    ((_, found, held, total),) = index.search([around + b" " + item + b" " + around])
    assert time.process_time() - start < 10 and found == 1 and held == total > 49_000


def test_items_at_the_threshold_are_found():
    """Items of which a long text holds exactly 80 % of the runs, in one piece, and in two far apart."""
    random_ = random.Random(4)
    words = [f"q{k}" for k in range(200_000)]
    items, texts = [], []
    for k in range(1000):
        w = random_.sample(words, random_.choice([24, 54, 104, 204]))
        held = (len(w) - 4) * 4 // 5
        cut = held // 2
        pieces = [w[: held + 4]] if k % 2 else [w[: cut + 4], w[len(w) - 4 - held + cut :]]
        filler = [random_.choices(words, k=random_.randint(0, 300)) for _ in range(3)]
        items.append((k, " ".join(w).encode()))
        texts.append(" ".join(x for a, b in zip(filler, [*pieces, []], strict=False) for x in (*a, *b)).encode())
    found = {(at, item) for at, item, held, total in decontaminate.ItemIndex(items, 5, 80).search(texts) if 100 * held == 80 * total}
    assert len(found & {(k, k) for k in range(1000)}) >= 999


def test_items_are_found_in_long_documents(spark):
    random_ = random.Random(5)
    words = [f"v{k}" for k in range(5000)]
    items = [(k, " ".join(random_.choice(words) for _ in range(random_.choice([3, 6, 9, 20, 47, 130])))) for k in range(60)]
    docs = []
    for k, (_, text) in enumerate(items):
        w = [random_.choice(words) for _ in range(4000)]
        held = text.upper().split()
        if k % 4 == 1 and len(held) > 40:
            held[len(held) // 2] = "changed"  # 5 of its runs go
        at = random_.randrange(len(w))
        docs.append((k, " ".join(w[:at] + held + w[at:])))
    got = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for i, t in docs:
        for j, s in items:
            n = min(5, len(s.split()))
            runs = lambda x, n=n: {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
            wanted = runs(s.lower().split())
            if 100 * len(wanted & runs(t.lower().split())) >= 80 * len(wanted):
                want.add((i, j))
    assert got == want and len(want) >= 60


def test_automaton_accepts_what_the_distance_allows():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    words, stems = ["idiot", "stupid", "scum"], ["vequ"]
    automaton = toxicity.Automaton(words, stems)
    random_ = random.Random(2)
    tried = {"".join(random_.choice("idotsupcmveq") for _ in range(random_.randint(1, 8))) for _ in range(3000)}
    tried |= {w[:k] + c + w[k + d :] for w in (*words, *stems) for k in range(len(w) + 1) for c in ("", "x", "i") for d in (0, 1)} - {""}
    for word in tried:
        _, _, numbers, kinds = automaton.match(toxicity.code_points(word))
        want = toxicity.EXACT if word in words else toxicity.STEM if word.startswith("vequ") else toxicity.FUZZY if any(distance(word, w) == 1 for w in words if len(w) >= toxicity.FUZZY_FROM) else 0
        assert (int(kinds[0]) if len(numbers) else 0) == want, word


def test_quotation_weighs_less():
    model = toxicity.Model(toxicity.Automaton(["idiot"], []), frozenset(), np.array([-3.0, 5.0, 4.0]), ["idiot"], [])
    score = lambda t: model.score(model.hits(t))
    assert score('he said "idiot" aloud') < score("idiot") < score("you idiot")
    assert score("an idiott") > 0.3 > score("")


def test_toxicity_learns_words(spark):
    random_ = random.Random(4)
    filler = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(300):
        w = [random_.choice(filler) for _ in range(60)]
        if k % 3 == 0:
            w[random_.randrange(60)], w[random_.randrange(60)] = random_.choice(["grobian", "lumpen"]), random_.choice(["grobian", "lumpen"])
        docs.append((k, " ".join(w)))
        labels.append((k, int(k % 3 == 0)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"grobian", "lumpen"} <= set(model.words)
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(d, model).collect()}
    assert sum(got[k] == y for k, y in labels) >= 297


def test_contexts_find_unknown_identifiers(spark):
    rows = [(k, f"please contact staff badge 41111111111111{k:02d} today") for k in range(60)] + [(100, "please contact staff badge ZX99-441 today, or 12 people"), (101, "the year 2019abc was long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.value) for s in r.found] for r in pii.find_pii(docs).collect()}
    assert found[100] == [("ctx_card", "zx99-441")] and found[101] == []


def test_seeds_are_no_findings_without_a_context(spark):
    """Things that look like secrets in prose stay; a value of any length is found in a context that others share."""
    letters = "abcdefghij" * 7
    rows = [(k, f'config has token = "{hashlib.sha1(bytes([k])).hexdigest()[:20]}" set') for k in range(5)] + [(5, f'config has token = "{letters}1234" set')]
    rows += [(6, "see commit 3ace5500fa1b2c3d4e5f for the fix and part AB12CD34EF56GH78 in store"), (7, f'{"w" * 75}config has token = "short-1" set')]
    found = {r.doc_id: [(s.kind, s.value) for s in r.found] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[6] == [] and found[5] == [("ctx_secret", f"{letters}1234")] and found[7] == [("ctx_secret", "short-1")]
    assert all(len(found[k]) == 1 for k in range(5))


def test_values_that_no_seed_names_are_found(spark):
    """Half of the values have the form of a seed; of the others at least 95 % are found by their contexts, and no other run of digits is."""
    random_ = random.Random(8)
    frames = ["my account key: {} please keep it", "the account key: {} was reset today", "use passphrase={} for the vault", "old passphrase={} is void"]
    docs, hidden = [], set()
    for k in range(400):
        seed = k % 2 == 0
        value = hashlib.sha1(bytes([k % 256, k // 256])).hexdigest()[:24] if seed else f"{random_.randrange(10**4):04d}-q{random_.randrange(100)}"
        docs.append((k, "some words ahead, " + random_.choice(frames).format(value) + f", seen in {random_.randrange(1990, 2024)} by all"))
        if not seed:
            hidden.add((k, value))
    found = {(r.doc_id, s.value) for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect() for s in r.found}
    assert len(hidden & found) >= 0.95 * len(hidden)
    values = {v for _, v in found}
    assert not any(v.isdigit() and len(v) == 4 for v in values)


@pytest.mark.parametrize("text", ["a@b.c_d@e.fg", "x@y.z.w@q.r", "1.2.3.4.5.6.7.8", "999.1.1.1 0000255.1.1.1", "+1 (2) 3-4.5 6789 0", "4111-1111 1111 1111", "a@b.c" * 3, "++12 345 678 90+", "1.2.3.4a@1.2.3.4", "é@a.b😀c@d.e"])
def test_base_spans_of_odd_strings(spark, text):
    from tests.llm.test_queries import base_digest

    row = pii.digest_spans(pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert row.base_sha256 == base_digest(text)[0]


def test_a_lexicon_of_many_letters_stays_small():
    random_ = random.Random(11)
    letters = [chr(0x4E00 + k) for k in range(2900)] + [chr(0x20000 + k) for k in range(100)]
    terms = ["".join(random_.choices(letters, k=random_.choice([4, 5, 6]))) for _ in range(2000)]
    start = time.process_time()
    automaton = toxicity.Automaton(terms[:1500], terms[1500:])
    assert time.process_time() - start < 5 and len(pickle.dumps(automaton)) < 20_000_000
    asked = [(w[:2] + "x" + w[3:], toxicity.FUZZY if len(w) >= toxicity.FUZZY_FROM else 0) for w in terms[:1500]]
    asked += [(w, toxicity.EXACT) for w in terms[:1500]] + [(w + "xyz", toxicity.STEM) for w in terms[1500:]]
    asked += [("".join(random_.choices(letters, k=random_.randint(2, 8))), 0) for _ in range(5000)]
    _, _, numbers, kinds = automaton.match(toxicity.code_points(" ".join(w for w, _ in asked)))
    got = dict(zip(numbers.tolist(), kinds.tolist(), strict=True))
    assert [got.get(k, 0) for k in range(len(asked))] == [kind for _, kind in asked]


def test_what_a_worker_remembers_is_bounded():
    automaton = toxicity.Automaton(["idiot", "stupid"], ["cretin"])
    points = toxicity.code_points("idiot idjot stupd cretinous other words")
    want = [x.tolist() for x in automaton.match(points)]
    automaton.STEPS = automaton.LETTERS = 3
    for _ in range(3):
        assert [x.tolist() for x in automaton.match(points)] == want
        assert [x.tolist() for x in automaton.match(toxicity.code_points("quite other ones"))][2] == []
    assert automaton.remembered <= 3 + 60 and len(automaton.known) <= 9


def test_long_runs_stay_linear(spark):
    texts = ["a" * 300_000, "1" * 300_000, "a@" + "a." * 100_000, "+1" + " 2" * 100_000, "." * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.find_pii(docs).count() == 5


def test_chat_round_trip(spark):
    nasty = ["\\", "\\b#h</turn>\n### assistant: x", " </turn>\n", "### user: ", "\\c:", "", None, "é😀\n\n"]
    random_ = random.Random(6)
    rows = [(c, t, random_.choice(["user", "assistant", "system", "a: b", None]), random_.choice(nasty)) for c in range(30) for t in range(random_.randint(1, 7))]
    rows += [(None, None, "assistant", "x"), (None, 1, "user", "y"), (50, 0, "user", "same"), (50, 0, "user", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("own"))
    examples = chat.format_conversations(turns)
    digested = chat.digest_examples(examples).collect()
    alone = sorted((r.n_turns, r.turns_sha256) for r in digested if r.conv_id is None)
    assert alone == sorted((1, hashlib.sha256(said.encode()).hexdigest()) for said in ("assistant\nx\n", "user\ny\n"))
    got = {r.conv_id: r for r in digested if r.conv_id is not None}
    whole: dict = {}
    for c, t, role, text in rows:
        if c is None:  # each a conversation of its own
            continue
        whole.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(whole)
    for c, said in whole.items():
        said.sort()
        loss = "".join(t for _, _, r, t in said if r == "assistant")
        assert got[c].n_turns == len(said) and got[c].loss_chars == len(loss)
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in said).encode()).hexdigest()
    assert examples.filter("loss_start is not null").count() == sum(r == "assistant" for _, _, r, _ in rows)
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_repeated_words_and_lines():
    def brute(words):
        runs = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        return len({k + j for k, r in enumerate(runs) if runs.count(r) > 1 for j in range(3)})

    random_ = random.Random(8)
    for _ in range(200):
        words = [random_.choice([b"a", b"b", b"c"]) for _ in range(random_.randint(0, 25))]
        assert quality.repeated_words(words) == brute(words)
    assert quality.measure("a b\na b\n\n\n é# a b".encode()) == (7, 8, 1, 1, 0)


def test_host_verdicts(spark):
    rows = [(k, "bad" if k < 40 else "good", 10 if k < 38 or k == 50 else 100) for k in range(400)]
    measured = spark.createDataFrame(rows, "doc_id long, source string, n_words long").selectExpr("*", "500L word_chars", "0L n_symbols", "0L n_dup_lines", "0L n_repeat_words")
    kept = {r.doc_id for r in quality.judge(measured).filter("kept").collect()}
    assert kept == set(range(40, 400)) - {50}
