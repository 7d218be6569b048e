"""op12 against the libraries and plain sets of offsets."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from scriptorium.llm import token_alignment
from scriptorium.llm.common import space_segments
from scriptorium.llm.queries import QUERIES, tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))


def plain(libraries, texts):
    """(n_a, n_b, groups, links) of each text, from whole encodings; a token's bytes by the libraries' own ways back."""
    a, b = libraries
    # Byte-level text of each byte, by encoding it: the decoder is no help for parts of characters.
    shown = token_alignment.byte_alphabet()
    assert sorted(shown.values()) == list(range(256))
    out = []
    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a = [bytes(shown[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append((0, 0, [], []))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b)]
        groups, links, at = [], [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            to = [ends[0].index(cut) + 1, ends[1].index(cut) + 1]
            groups.append((ids_a[at[0] : to[0]], ids_b[at[1] : to[1]]))
            links.append((ids_a[to[0] - 1], ids_b[to[1] - 1]))
            at = to
        out.append((len(ids_a), len(ids_b), groups, links))
    return out


def shown(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def expected(libraries, rows):
    found = plain(libraries, [t for _, t in rows])
    counts = Counter(link for *_, links in found for link in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(
        (i, na, nb, len(g), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(shown(g).encode()).hexdigest() if g else "")
        for (i, _), (na, nb, g, links) in zip(rows, found, strict=True)
    )


HOSTILE = ["<|endoftext|> <s> </s> <unk> <0x0A>", "a ", "a  ", " ", "  ", "\n", " \n b", "a\n b\t c \r\n", "▁mark", "x▁ y", "日本語 テキスト 😀👩‍🚀", "é ﬁ ½ é", "\x00 \x1f z\x1fq r", "it's don't 'll 123 4567", "a" * 3000, " " * 500 + "x", "　 \xa0   q", "word " * 400, None, ""]


def test_query_equals_whole_encodings(spark, sample, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sample}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op12_token_alignment"](spark, sample).collect())) == expected(libraries, rows)


@pytest.mark.parametrize("broadcast", [True, False])
def test_hostile_texts(spark, libraries, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr("scriptorium.llm.common.BROADCAST_ROWS", -1)
    rng = random.Random(3)
    rows = [*enumerate(HOSTILE), (0, HOSTILE[0]), *((100 + k, "".join(rng.choices(["a", "the", " ", "  ", "\n", "é", "日", "'s", "<s>", "9", "\t", "."], k=40))) for k in range(300))]
    docs = spark.createDataFrame([(i, t, "own", "own") for i, t in rows], "doc_id long, text string, n_best string, align_row string")
    aligned = token_alignment.align_documents(docs, tokenizer_path(A), tokenizer_path(B))
    out = token_alignment.rate_links(aligned)
    assert [c for c in out.columns if c in ("align_row", "text", "n_best")] == ["text", "align_row", "n_best"]
    got = sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.alignment.encode()).hexdigest() if r.alignment else "") for r in out.collect())
    assert got == expected(libraries, rows)


def test_edge_and_empty(edge, empty):
    def rated(docs):
        return token_alignment.rate_links(token_alignment.align_documents(docs, tokenizer_path(A), tokenizer_path(B)))

    rows = rated(edge).collect()
    assert len(rows) == edge.count() and all((r.n_a > 0) == bool(r.text) and r.n_groups == r.n_links for r in rows)
    assert rated(empty).count() == 0


def test_memory_is_bounded_and_changes_nothing(libraries, monkeypatch):
    aligner = token_alignment.Aligner(tokenizer_path(A), tokenizer_path(B))
    monkeypatch.setattr(token_alignment, "MEMORY_BYTES", 20_000)
    monkeypatch.setattr(token_alignment, "CALL_SEGMENTS", 7)
    texts = [f"number {k} and {k * k} of many{k % 7}" for k in range(300)]
    found = [aligner.align(texts[k : k + 10]) for k in range(0, 300, 10)]
    assert [";".join(s[0] for s in parts) for part in found for parts in part] == [shown(g) for _, _, g, _ in plain(libraries, texts)]
    assert len(aligner.memory) < 200


def test_bits():
    rng = random.Random(1)
    for size in (1, 63, 64, 65, 1000):
        a, b = (sorted(rng.sample(range(1, size + 1), rng.randrange(1, size + 1))) for _ in range(2))
        cuts, upto_a, upto_b = token_alignment.shared_cuts(np.array(a), np.array(b), size)
        want = sorted(set(a) & set(b))
        assert cuts.tolist() == want
        assert (upto_a.tolist(), upto_b.tolist()) == ([sum(x <= c for x in a) for c in want], [sum(x <= c for x in b) for c in want])


def test_a_first_tokenizer_that_loses_bytes(libraries, tmp_path):
    """Without the letter q in its vocabulary A drops it; such texts have no tokens, their neighbours keep theirs."""
    import json

    with open(tokenizer_path(A)) as f:
        made = json.load(f)
    made["model"]["vocab"] = {k: v for k, v in made["model"]["vocab"].items() if "q" not in k}
    made["model"]["merges"] = [m for m in made["model"]["merges"] if "q" not in "".join(m)]
    (tmp_path / "lossy.json").write_text(json.dumps(made))
    aligner = token_alignment.Aligner(str(tmp_path / "lossy.json"), tokenizer_path(B))
    found = aligner.align(["the end", "a q here", "quick", "the here"])
    assert [";".join(s[0] for s in parts) for parts in found] == [shown(plain(libraries, [t])[0][2]) if "q" not in t else "" for t in ("the end", "a q here", "quick", "the here")]


class Counting:
    """A SentencePiece processor that counts the texts it is given."""

    def __init__(self, made):
        self.made, self.texts = made, 0

    def encode(self, texts, **options):
        self.texts += 1 if isinstance(texts, str) else len(texts)
        return self.made.encode(texts, **options)


def test_new_segments_are_encoded_many_at_a_time(libraries):
    aligner = token_alignment.Aligner(tokenizer_path(A), tokenizer_path(B))
    aligner.second = Counting(aligner.second)
    texts = [" ".join(f"word{k}-{n}" for n in range(50)) for k in range(100)] + ["ends in white \n", "two  spaces", " "]
    assert [";".join(s[0] for s in parts) for parts in aligner.align(texts)] == [shown(g) for _, _, g, _ in plain(libraries, texts)]
    assert aligner.second.texts <= 60


def test_segments_are_those_of_the_pattern():
    rng = random.Random(5)
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    texts = ["".join(rng.choices(["a", "é", "日", "😀", " ", "  ", "\n", "▁", *spaces], [40, 9, 9, 9, 40, 9, 9, 9, *[1] * len(spaces)], k=rng.randrange(30))) for _ in range(3000)]
    sliced = pa.array([None, "x", *texts, None, ""], pa.string()).slice(2)
    distinct, which, bounds = space_segments(sliced)
    want = [re.split(r"(?<=[^\s▁])(?= )", " " + t) if t else [] for t in [*texts, None, ""]]
    assert [[distinct[k] for k in which[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)] == want
    assert len(set(distinct)) == len(distinct) and space_segments(pa.array([None, ""], pa.string()))[0] == []
