import pytest

EDGE = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b "),
    (4, "x"),
    (5, "One line that repeats itself here.\nAnother line\nOne line that repeats itself here."),
    (6, "  ONE line that repeats itself here.  \nzz"),
    (7, "1234 !!! 5678"),
    (8, "Ünïcödé 😀 日本語 テキスト ñandú"),
    (8, "Ünïcödé 😀 日本語 テキスト ñandú"),
    (None, "One line that repeats itself here."),
    (9, "word " * 30000),
    (10, "a" * 100_000),
    (11, "mail me: a.b@c.de, +1 (555) 123-4567 or 10.0.0.1 card 4111 1111 1111 1111."),
]
#: Names of columns that operators add.
CLASHING = "n_lines, score, kept, base_failed, n_tokens, lang_pred, component_id, shard, payload, rep, predicted, hits, n_words, rate, host_rate, token_ids, made, line_doc, line_hashes, host, bad_doc, __hits, __m, __new, __hit_id"


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, empty, blank, long, repeated and odd texts, and columns named like results."""
    names = [c.strip() for c in CLASHING.split(",")]
    rows = [(i, t, None if i == 4 else "en" if k % 2 else "fr", f"host{k % 3}" if k else None, *["own"] * len(names)) for k, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in names))


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def sample(spark):
    return "/root/testdata/sf0.001"
