import json
import random
import sys
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.operators import splitters
from scriptorium.operators.splitting import CharacterRules, HtmlRules, JsonRules, MarkdownRules, RecursiveRules, separators_for, to_json, token_windows
from scriptorium.plans import queries
from scriptorium.schema import documents


def test_merge_counts_separators_and_keeps_overlap():
    rules = CharacterRules(size=7, overlap=3, separator=" ")
    assert rules.split("aa bb cc dd") == ["aa bb", "bb cc", "cc dd"]


def test_long_piece_stays_whole_and_is_trimmed():
    assert CharacterRules(size=4, overlap=0, separator="|").split("a| longer |b") == ["a", "longer", "b"]


def test_overlap_must_be_smaller():
    with pytest.raises(ValueError):
        CharacterRules(size=5, overlap=5)


def test_recursive_uses_weaker_separators_only_where_needed():
    rules = RecursiveRules(size=10, overlap=0)
    assert rules.split("short\n\nthis one is longer") == ["short", "this one", "is longer"]


def test_recursive_without_empty_separator_leaves_long_words():
    assert RecursiveRules(size=4, overlap=0, separators=(" ",)).split("ab abcdefgh") == ["ab", " abcdefgh"]


def test_empty_and_blank():
    for rules in (CharacterRules(), RecursiveRules()):
        assert rules.split("") == [] and rules.split(" \n ") == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200))
def test_recursive_loses_nothing_but_blanks(text):
    chunks = RecursiveRules(size=20, overlap=0).split(text)
    assert "".join("".join(chunks).split()) == "".join(text.split())
    assert all(len(c) <= 20 for c in chunks)


def test_windows_closed_form():
    for n in range(60):
        starts, k = [], 0
        while n and (not starts or starts[-1] + 10 < n):
            starts.append(k * 7)
            k += 1
        assert token_windows(n, 10, 3) == len(starts)


def test_languages():
    assert separators_for("python")[:3] == ["\nclass ", "\ndef ", "\n\tdef "]
    assert separators_for("html")[-2:] == [" ", ""]
    with pytest.raises(ValueError):
        separators_for("cobol")


def test_markdown_scopes_and_fences():
    text = "# A\nintro\n\nmore\n## B\nx\n```\n# not a heading\n```\n# C\n#tag"
    assert MarkdownRules().split(text) == [
        ("intro  \nmore", {"Header 1": "A"}),
        ("x\n```\n# not a heading\n```", {"Header 1": "A", "Header 2": "B"}),
        ("#tag", {"Header 1": "C"}),
    ]


def test_markdown_keeps_headings_and_folds_bare_ones():
    assert MarkdownRules(strip_headings=False).split("# A\n## B\ntext") == [("# A  \n## B\ntext", {"Header 1": "A", "Header 2": "B"})]


def test_four_backticks_never_close():
    assert MarkdownRules().split("````\n# A\n````\n# B") == [("````\n# A\n````\n# B", {})]


def test_html_headings():
    page = "<body><h1>One</h1><p>a</p><div><p>b <b>bold</b></p></div><h2>Two</h2><p>c</body>"
    got = HtmlRules().split(page)
    assert got[0] == ("One", {"Header 1": "One"})
    assert ("Two", {"Header 1": "One", "Header 2": "Two"}) in got
    assert got[-1] == ("c", {"Header 1": "One", "Header 2": "Two"})


def test_html_heading_with_text_in_a_child_is_none():
    assert HtmlRules().split("<body><h1><b>x</b></h1></body>") == [("x", {})]


def test_json_rules():
    assert JsonRules().split("{}") == ["{}"]
    assert JsonRules().split("5") == [json.dumps({"undefined": 5}, indent=2)]
    big = {"a": "x" * 60, "b": {"c": "y" * 60, "d": [1, 2]}}
    chunks = [json.loads(c) for c in JsonRules(most=100, least=10).split(json.dumps(big))]
    assert chunks == [{"a": "x" * 60}, {"b": {"c": "y" * 60, "d": {"0": 1, "1": 2}}}]
    with pytest.raises(ValueError, match="Invalid JSON"):
        JsonRules().split("{")


def test_json_text_orders_indexes_first():
    assert to_json({"b": 1, "10": 2, "9": 3.0, "01": 4}) == '{"9":3,"10":2,"b":1,"01":4}'


def plain_merge(pieces, separator, size, overlap, length):
    """The rule as a loop: a chunk is full when the next piece would exceed the size; then pieces are dropped from its front."""
    chunks, held = [], []

    def total():
        return sum(map(length, held))

    for piece in pieces:
        over = lambda p=piece: total() + length(p) + len(held) * len(separator) > size
        if held and over():
            chunks.append(separator.join(held).strip())
            while total() > overlap or total() > 0 and over():
                held.pop(0)
        held.append(piece)
    return [c for c in [*chunks, separator.join(held).strip()] if c]


def test_merging_by_sums_equals_the_loop():
    rng = random.Random(7)
    for _ in range(3000):
        pieces = rng.choices(["a", "bb", "ccc dd", "eeeeeeeee", "é"], k=rng.randrange(30))
        size = rng.randrange(1, 20)
        overlap, separator, length = rng.randrange(size), rng.choice(["", "\n", "--"]), rng.choice([len, lambda x: 2 * len(x), lambda x: len(x) // 2])
        rules = CharacterRules(size, overlap, separator, length=length)
        assert rules.merge(pieces, separator) == plain_merge(pieces, separator, size, overlap, length)
        assert rules.merge("".join(pieces), "") == plain_merge(list("".join(pieces)), "", size, overlap, length)


def test_very_long_texts_take_a_step_for_each_chunk():
    began = time.process_time()
    assert len(RecursiveRules().split("x" * 5_000_000)) == 6250
    assert sum(map(len, RecursiveRules(overlap=0).split("ab cd " * 500_000))) > 2_900_000
    assert time.process_time() - began < 20


def test_columns_named_as_internal_ones(spark):
    docs = documents(spark.createDataFrame([(1, "# a\n\nb c", "own")], "doc_id long, text string, __text string"), "doc_id", "text").withColumn("chunks", F.lit("own")).withColumn("chunk_text", F.lit("own")).withColumn("__text", F.lit("own"))
    for split in (splitters.split_windows, splitters.split_recursively, splitters.split_markdown, splitters.split_html):
        assert {(r.chunks, r.chunk_text, r["__text"]) for r in split(docs).collect()} == {("own", "own", "own")}


def most_held(spark, split_with, many=2000):
    """How many results of ``split`` a Python worker holds at most, of ``many`` texts of 10,000 characters in one Arrow batch."""

    class Held(list):
        now = 0

        def __init__(self, made):
            super().__init__(made)
            Held.now += 1

        def __del__(self):
            Held.now -= 1

    def counted(make):
        return lambda text: Held(make(str(Held.now)))

    texts = spark.range(0, many, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("0123456789"), 1000).alias("text"))
    return max(int(r[0]) for r in split_with(documents(texts, "doc_id", "text"), counted).collect())


def test_text_chunks_are_held_for_a_portion_only(spark):
    def split(docs, counted):
        return docs.select(F.explode(splitters._text_chunks(counted(lambda n: [n]))("page_content")))

    assert most_held(spark, split) <= 200


def few_held(limit):
    """A check, for use in a Python worker, that the interpreter holds at most ``limit`` objects more than at first."""
    first = []

    def check():
        first.append(sys.getallocatedblocks()) if not first else None
        return sys.getallocatedblocks() - first[0] <= limit

    return check


@pytest.mark.parametrize(("size", "overlap", "windows"), [(1000, 200, 13), (100, 30, 143)])
def test_windows_are_held_for_a_portion_only(spark, monkeypatch, size, overlap, windows):
    few = few_held(1000 * windows)
    monkeypatch.setattr(splitters, "token_windows", lambda *of: token_windows(*of) if few() else 0)
    texts = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("0123456789"), 1000).alias("text"))
    assert splitters.split_windows(documents(texts, "doc_id", "text"), size, overlap).count() == 2000 * windows


@pytest.mark.parametrize(("size", "overlap"), [(1000, 200), (100, 30), (5, 0), (1, 0), (7, 6)])
def test_windows_are_cut_without_python(spark, size, overlap):
    rng = random.Random(size)
    stride = size - overlap
    lengths = [0, 1, stride, size - 1, size, size + 1, size + stride - 1, size + stride, size + stride + 1, 5 * size + 3]
    texts = ["".join(rng.choices("aé日😀\n\r\u2028 \0", k=n)) for n in lengths for _ in range(3)] + [None]
    docs = documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    made = splitters.split_windows(docs, size, overlap)
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    want = [(i, k, t[k * stride : k * stride + size]) for i, t in enumerate(texts) if t for k in range(token_windows(len(t), size, overlap))]
    assert sorted(map(tuple, made.select("doc_id", "chunk_index", "page_content").collect())) == want


def test_windows_of_a_very_long_text_take_linear_time(spark):
    docs = documents(spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a日😀\n"), 5_000_000).alias("text")), "doc_id", "text")
    began = time.monotonic()
    assert splitters.split_windows(docs, 100, 30).count() == token_windows(20_000_000, 100, 30)
    assert time.monotonic() - began < 30


def test_chunks_with_headings_are_held_for_a_portion_only(spark):
    few = few_held(50_000)
    chunks = splitters._scoped_chunks(lambda text: [(f"{k} {few()}", {f"Header {k}": "a"}) for k in range(50)])
    texts = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("0123456789"), 1000).alias("text"))
    made = texts.select(F.explode(chunks("text")).alias("c")).select("c.text")
    assert made.count() == 2000 * 50 and made.filter("text like '%False'").isEmpty()


def test_outlined_texts_are_held_for_a_portion_only(spark, monkeypatch):
    """A worker makes the lines of a portion of texts and hands them on; what it holds is told by a mark."""
    few = few_held(2500)
    monkeypatch.setattr(queries, "outline", lambda text: f"# {few()} {text}")
    texts = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("0123456789"), 1000).alias("text"))
    made = queries._outlined(lambda name: texts)
    assert made.count() == 4000 and made.filter("page_content like '# False%'").isEmpty()
