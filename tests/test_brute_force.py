"""Splitters over whole tables against plain versions written apart from the library."""

import json
import math
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.operators.metrics import exact_percentiles
from scriptorium.operators.splitting import JsonRules
from scriptorium.plans.queries import QUERIES, outline

SF = "/root/testdata/sf0.001"


def merged(pieces, sep, size, overlap):
    out, held, total = [], [], 0
    for p in pieces:
        if held and total + len(p) + len(held) * len(sep) > size:
            out.append(sep.join(held).strip())
            while total > overlap or total > 0 and total + len(p) + len(held) * len(sep) > size:
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    return [x for x in [*out, sep.join(held).strip()] if x]


def recursive(text, separators, size, overlap):
    sep = next((s for s in separators if s in text), separators[-1])
    weaker = separators[separators.index(sep) + 1 :] if sep else []
    pieces = [p for p in (re.split(f"(?={re.escape(sep)})", text) if sep else list(text)) if p]
    out, fitting = [], []
    for p in [*pieces, None]:
        if p is not None and len(p) < size:
            fitting.append(p)
            continue
        out += merged(fitting, "", size, overlap)
        fitting = []
        if p is not None:
            out += recursive(p, weaker, size, overlap) if weaker else [p]
    return out


PLAIN = ["\n\n", "\n", " ", ""]
HEADED = ["\n## ", "\n### ", *PLAIN]
SPLITS = {
    "character_split": lambda t: merged([p for p in t.split("\n") if p], "\n", 1000, 200),
    "recursive_split": lambda t: recursive(t, PLAIN, 1000, 200),
    "chunk_size_control": lambda t: recursive(t, HEADED, 1000, 200),
    "chunk_size_guard": lambda t: [t] if len(t) <= 1000 else recursive(t, HEADED, 1000, 200),
}


@pytest.mark.parametrize("name", sorted(SPLITS))
def test_splits_equal_brute_force(spark, name):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got: dict = {}
    for r in sorted(QUERIES[name](spark, SF).collect(), key=lambda r: (r.doc_id, r.chunk_index)):
        got.setdefault(int(r.doc_id), []).append(r.page_content)
    assert got == {i: chunks for i, t in texts.items() if (chunks := SPLITS[name](t or ""))}


def sections(text):
    """(content, headers) by a walk over lines, one section for each run of lines under the same headings."""
    paragraphs, stack, lines, fenced = [], [], [], False
    for line in [x.strip() for x in text.split("\n")] + [None]:
        if line is not None and line.startswith("```") and (line == "```" or not fenced and line.count("```") == 1):
            fenced = not fenced
            lines.append(line)
            continue
        heading = None if fenced or line is None else re.fullmatch(r"(#{1,3})(?: (.*))?", line)
        if line is None or heading or line == "" and not fenced:
            if lines:
                paragraphs.append(("\n".join(lines), {f"Header {k}": h for k, h in stack}))
            lines = []
        else:
            lines.append(line)
        if heading:
            stack = [x for x in stack if x[0] < len(heading[1])] + [(len(heading[1]), (heading[2] or "").strip())]
    out = []
    for content, headers in paragraphs:
        if out and out[-1][1] == headers:
            out[-1] = (out[-1][0] + "  \n" + content, headers)
        else:
            out.append((content, headers))
    return out


def test_markdown_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got: dict = {}
    for r in sorted(QUERIES["markdown_headers"](spark, SF).collect(), key=lambda r: (r.doc_id, r.chunk_index)):
        got.setdefault(r.doc_id, []).append((r.page_content, json.loads(r.headers)))
    want = {i: found for i, t in texts.items() if (found := sections(outline(t or "")))}
    assert got == want and max(len(h) for found in got.values() for _, h in found) == 3


def json_chunks(value, most):
    """The same objects, measuring the chunk anew for every key."""
    compact = lambda x: len(json.dumps(x, ensure_ascii=False, separators=(",", ":")))
    chunks = [{}]

    def put(path, x):
        at = chunks[-1]
        for key in path[:-1]:
            at = at.setdefault(key, {})
        at[path[-1]] = x

    def walk(x, path):
        if not isinstance(x, dict):
            return put(path, x)
        for key, child in x.items():
            if compact({key: child}) < most - compact(chunks[-1]):
                put([*path, key], child)
            else:
                if compact(chunks[-1]) > max(most - 200, 50):
                    chunks.append({})
                walk(child, [*path, key])

    walk(value, [])
    return chunks


def test_json_equals_brute_force(spark):
    told: dict = {}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn, r.role)):
        told.setdefault(r.conv_id, []).append({"turn": r.turn, "role": r.role, "text": r.text})
    got: dict = {}
    for r in sorted(QUERIES["json_split_nested"](spark, SF).collect(), key=lambda r: (r.conv_id, r.chunk_index)):
        got.setdefault(int(r.conv_id), []).append(json.loads(r.page_content))
    want = {i: json_chunks({"conversation": {"id": i, "turns": {str(k): x for k, x in enumerate(turns)}}}, 300) for i, turns in told.items()}
    assert got == want and max(map(len, got.values())) > 2


def test_json_size_is_kept_right():
    deep = {"a": {"b": [{}, {"é": [1.0, "x" * 90]}, []], "0": {"c": {"d": "y" * 60}}}, "e": {}, "f": [["z" * 70, "z" * 70], 3]}
    plain = {"a": {"0": {"c": {"d": "y" * 60}}, "b": {"0": {}, "1": {"é": {"0": 1, "1": "x" * 90}}, "2": {}}}, "e": {}, "f": {"0": {"0": "z" * 70, "1": "z" * 70}, "1": 3}}
    for most in (20, 60, 120, 200):
        assert JsonRules(most).split_value(deep) == json_chunks(plain, most)


def test_percentiles_equal_brute_force(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("k"),
        F.when(F.col("id") % 11 > 0, F.when(F.col("id") % 5 == 0, F.lit(4.5)).otherwise((F.xxhash64("id") % 100_000) / 7.0)).alias("v"),
    ).unionAll(spark.createDataFrame([(9, 2.0), (8, None), (10, -1.0), (10, float("nan"))], "k long, v double"))
    held: dict = {}
    for r in rows.collect():
        if r.v is not None:
            held.setdefault(r.k, []).append(r.v)
    order = lambda x: (math.isnan(x), x)
    want = {k: [str(sorted(v, key=order)[max(1, -(-len(v) * p // 100)) - 1]) for p in (50, 95, 99)] for k, v in held.items()}
    assert {r.k: [str(r.p50), str(r.p95), str(r.p99)] for r in exact_percentiles(rows, "k", "v").collect()} == want
