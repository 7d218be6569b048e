"""Operators do the whole job: no sample, no cap."""

import itertools
import random
from array import array

from scriptorium.llm import pii, sentencepiece_codec, toxicity
from scriptorium.llm.queries import tokenizer_path


def test_parity_is_checked_on_every_text():
    codec = sentencepiece_codec.Codec(tokenizer_path("piece_bpe_32k.model"))
    texts = ["", "é ﬁ ½", *(f"text {k} wrong" for k in range(64))]
    assert sentencepiece_codec._coded(codec, texts, False)[-1].to_pylist() == [True] * len(texts)
    # Another segmentation of a segment, which decodes to the same text.
    pieces = [p for p, _, _ in codec.model.pieces]
    codec.memory[" wrong"] = array("i", [pieces.index(p) for p in ("▁w", "r", "o", "n", "g")]).tobytes()
    *_, back, parity = sentencepiece_codec._coded(codec, texts, False)
    assert all(back.to_pylist()) and parity.to_pylist() == [True] * 2 + [False] * 64


def test_new_segments_are_encoded_many_at_a_time_and_all_compared():
    codec = sentencepiece_codec.Codec(tokenizer_path("piece_bpe_32k.model"))
    library, given = codec.oracle, []

    class Recording:
        def encode(self, texts, **options):
            given.extend([texts] if isinstance(texts, str) else texts)
            return library.encode(texts, **options)

    codec.oracle = Recording()
    texts = [" ".join(f"word{k}-{n}\u00e9" for n in range(50)) for k in range(100)] + ["a\nb \x07 c", "two  spaces ", " ", "x▁y ▁ z", "日本語 😀", "w" * 300 + " end"]
    packed, back, parity = codec.encode_packed(texts)
    assert [list(array("i", ids)) for ids in packed] == library.encode(texts) and all(parity)
    assert back == ["▁" not in t for t in texts]  # a mark decodes to a space
    assert len(given) <= 70 and all(f"word{k}-{n}" in "".join(given) for k in range(100) for n in range(50))
    assert codec.memory.keys() == codec.truth.keys() and not any(len(s) > 256 for s in codec.memory)


def test_a_difference_within_joined_segments_is_found(monkeypatch):
    """A library that splits one word otherwise: only texts that hold it differ, and get the library's ids."""
    codec = sentencepiece_codec.Codec(tokenizer_path("piece_bpe_32k.model"))
    library, names = codec.oracle, [p for p, _, _ in codec.model.pieces]
    whole, parts = library.encode("wrong"), [names.index(p) for p in ("▁w", "r", "o", "n", "g")]

    class Other:
        def encode(self, texts, **options):
            if isinstance(texts, str):
                return self.encode([texts])[0]
            return [[y for x in ids for y in (parts if x == whole[0] else [x])] for ids in library.encode(texts, **options)]

    assert len(whole) == 1
    codec.oracle = Other()
    texts = [f"text {k} " + ("wrong" if k % 3 == 0 else "right") for k in range(300)]
    packed, back, parity = codec.encode_packed(texts)
    assert parity == [k % 3 != 0 for k in range(300)] and all(back)
    assert [list(array("i", ids)) for ids in packed] == Other().encode(texts)


def test_parity_has_no_nulls(edge):
    out = sentencepiece_codec.encode_documents(edge, tokenizer_path("piece_bpe_32k.model"), with_ids=False)
    assert out.filter("parity is null or not parity").count() == 0


def test_stems_keep_their_words_and_tolerate_misspellings(spark):
    forms = ["idiot"] * 8 + ["idiots", "idioot"]
    docs = [(k, " ".join(f"w{(k * 31 + i * 17) % 97}q{i}" for i in range(40)) + (f" {forms[k // 2 % 10]} end{k}" if k % 2 else f" end{k}")) for k in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int"))
    assert "idiot" in model.words and any("idiots".startswith(s) for s in model.stems)
    held_out = spark.createDataFrame([(k, f"such an {w} here") for k, w in enumerate(["idjot", "ldiot", "iidiot", "idiots", "plain"])], "doc_id long, text string")
    assert {r.doc_id: len(r.hits) for r in toxicity.score_toxicity(held_out, model).collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0}
    kinds = {w: toxicity.Automaton([], ["cretin", "vequ"]).match(toxicity.code_points(w))[3].tolist() for w in ("cretinous", "cretjnous", "crxtjnous", "vexuous")}
    assert kinds == {"cretinous": [toxicity.STEM], "cretjnous": [toxicity.FUZZY], "crxtjnous": [], "vexuous": []}


def test_telling_terms_are_found_however_many_are_more_frequent(spark):
    # With their beginnings more than 8,192 terms, in every document.
    common = ["".join(w) for w in itertools.product("abcdefghijklmn", "opq", "rstuvwxyz", "klm", "efghijkl")]
    rare = ["".join(w) + "zzz" for w in itertools.product("abcdefghijkl", repeat=2)]
    docs = []
    for k in range(24):
        words = common + rare * (k >= 12)
        random.Random(k).shuffle(words)
        docs.append((k, " ".join(words)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame([(k, int(k >= 12)) for k in range(24)], "doc_id long, toxic int"))
    assert set(model.words) == set(rare)


def test_found_identifiers_make_new_patterns(spark):
    luhn = lambda n: sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(str(n)[::-1]))
    cards = [f"{n}{-luhn(n) % 10}" for n in range(411111111111100, 411111111111140)]
    rows = [(k, f"please contact staff badge {card} today") for k, card in enumerate(cards)]
    rows += [(100 + k, f"please contact staff badge ZX99-44{k} today and account no ZX99-44{k} again") for k in range(9)]
    rows += [(200, "with account no QQ77-123 again"), (201, "the year 2019abc was long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.value) for s in r.found] for r in pii.find_pii(docs).collect()}
    assert found[200] == [("ctx_card", "qq77-123")] and found[201] == []
