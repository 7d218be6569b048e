"""One large JSON array read in blocks, held against json.loads at every place a block may end."""

import json
import random

import pytest

from scriptorium.sources import blocks, large_json
from scriptorium.sources.readers import binary_files, read_json

ITEMS = [{"a": "x, y", "b": [1, [2, {}], "]"]}, "te\\xt \", [", 7, None, [], {"k\"{": "}\\", "n": {"m": [[", "]]}}, -1.5e3, True, "", "é😀,ü", {"a": "last", "text": "\\\\"}]
TEXTS = [json.dumps(ITEMS), json.dumps(ITEMS, indent=2, ensure_ascii=False) + "\n", "[]", " [ ] ", "[1]", '[[1,2],[3,[4,5]],[]]', '["a,b,c,d,e,f"]', '[{"a":1},\n{"a":2}]\n', "[[[[]]],0]"]


def cut_pieces(text, cuts):
    """(block, piece) of a text whose blocks begin at ``cuts``; a piece belongs to the block that holds its first byte."""
    at, out = 0, []
    for piece in text.split(","):
        out.append((max([0, *(c for c in cuts if c <= at)]), piece))
        at += len(piece.encode()) + 1
    return out


def test_every_cut_gives_the_elements(spark):
    rng = random.Random(4)
    cases = {}
    for n, text in enumerate(TEXTS):
        for k in range(1, len(text.encode())):
            cases[f"{n}at{k}"] = (text, [k])
            cases[f"{n}by{k}"] = (text, list(range(0, len(text.encode()), k)))
    strings = ["", "a,b", '"', "\\", "\\\",", "[", "}", "é"]

    def value(depth):
        kind = rng.randrange(6 if depth else 3)
        if kind < 3:
            return [rng.choice(strings), rng.randrange(99), None][kind]
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind < 5 else {rng.choice(strings): value(depth - 1) for _ in range(rng.randrange(4))}

    for k in range(300):
        text = json.dumps([value(3) for _ in range(rng.randrange(8))], indent=rng.choice([None, 1]))
        cases[f"random{k}"] = (text, rng.sample(range(1, len(text) + 1), min(len(text), rng.randrange(1, 9))))
    rows = [(name, block, piece) for name, (text, cuts) in cases.items() for block, piece in cut_pieces(text, cuts)]
    found = {}
    for r in large_json.items_of(spark.createDataFrame(rows, "path string, block long, piece string").coalesce(1)).collect():
        found.setdefault(r.path, {})[r.number] = json.loads(r.item)
    for name, (text, _) in cases.items():
        assert found.get(name, {}) == dict(enumerate(json.loads(text))), name


@pytest.mark.parametrize("size,broadcast", [(40, True), (40, False), (100_000, True)])
def test_documents_equal_those_of_whole_files(spark, tmp_path, monkeypatch, size, broadcast):
    if not broadcast:
        monkeypatch.setattr(blocks, "BROADCAST_ROWS", -1)
    for n, text in enumerate(TEXTS):
        (tmp_path / f"{n}.json").write_bytes(text.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    own = lambda rows: sorted((r.doc_id.rsplit("/", 1)[1], r.doc_seq, r.page_content, sorted((k, v) for k, v in r.metadata.items() if k != "source")) for r in rows)
    try:
        for options in ({}, {"content_key": "a", "metadata_keys": ("b",), "pretty": False}):
            made = large_json.read_json(spark, str(tmp_path), **options).collect()
            assert own(made) == own(read_json(binary_files(spark, str(tmp_path)), "[]", **options).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_not_an_array(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"a": [1, 2]}')
    with pytest.raises(Exception, match="Not an array"):
        large_json.read_items(spark, str(tmp_path)).collect()
