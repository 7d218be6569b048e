import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import mime
from scriptorium.functions import text as tx
from scriptorium.operators import control, metrics, processors, state, tasks, validation
from scriptorium.schema import documents, merged, metadata


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'string' if isinstance(v, str) else 'bigint'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_clean(spark):
    assert one(spark, tx.clean("t"), t=" a\t\tb \r\n\n\n\n　c﻿") == "a b\n\nc"
    assert one(spark, tx.clean("t"), t="") == ""


def test_trim_takes_what_the_pattern_for_white_space_takes(spark):
    blank = r"[\s\x{FEFF}]"
    points = spark.range(1, 0x10000).filter("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    texts = points.select(F.concat("c", "c", F.lit("x"), "c", F.lit("y"), "c").alias("t"))
    pattern = F.regexp_replace(F.regexp_replace("t", rf"(?U)\A{blank}+", ""), rf"(?U){blank}+\z", "")
    assert texts.filter(~tx.trim_all("t").eqNullSafe(pattern)).isEmpty()


def test_trim_and_scan_of_long_runs_of_blanks_take_linear_time(spark):
    began = time.time()
    runs = spark.range(1).select(F.concat(F.lit("x"), F.repeat(F.lit(" "), 300_000), F.lit("y")).alias("t"))
    assert runs.select(F.length(tx.trim_all("t")), tx.special_ratio(tx.trim_all("t")), tx.looks_scanned("t", F.lit(1))).first() == (300_002, 0.0, True)
    assert time.time() - began < 10


def test_scan_heuristic_of_empty_and_missing_values(spark):
    found = spark.createDataFrame([("", 0), (" ", 0), (None, 1), ("a" * 300, 1), ("#é" * 300, 1)], "t string, p int")
    assert [tuple(r) for r in found.select(tx.looks_scanned("t", "p"), tx.special_ratio("t")).collect()] == [(True, 0.0), (True, 0.0), (None, None), (False, 0.0), (True, 1.0)]


def test_counts(spark):
    assert one(spark, tx.word_count("t"), t=" a b　c\n") == 3
    assert one(spark, tx.word_count("t"), t=" \n") == 0
    assert one(spark, tx.line_count("t"), t="a\n\nb\n") == 4
    assert one(spark, tx.char_count("t"), t="é😀") == 2 and one(spark, tx.utf16_count("t"), t="é😀") == 3


def test_html(spark):
    page = "<script>" + "<" * 20000 + "</script><p>a &amp;#65; &lt;b&gt; &#x41;&copy;</p><style>x</style>"
    assert one(spark, tx.strip_html("t"), t=page) == "a A <b> A&copy;"


@pytest.mark.parametrize(("content", "encoding", "text"), [
    (b"\xef\xbb\xbfab", "utf-8", "﻿ab"),
    (b"\xff\xfea\x00", "utf-16le", "﻿a"),
    (b"\xfe\xff\x00a", "utf-16be", "﻿a"),
    (b"\xff\xfea\x00b", "utf-16le", "\ufeffa"),
    (b"\xfe\xff\x00a\x00", "utf-16be", "\ufeffa"),
    (b"abc", "utf-8", "abc"),
    (b"a\xffb", None, "a�b"),
])
def test_encodings(spark, content, encoding, text):
    assert one(spark, tx.detect_encoding("c"), c=content) == encoding
    assert one(spark, tx.decode_as("c", F.coalesce(tx.detect_encoding("c"), F.lit("utf-8"))), c=content) == text


def test_sizes_and_names(spark):
    assert [one(spark, tx.format_size("n"), n=n) for n in (0, 1023, 1024, 5 * 1024**2, 3 * 1024**4)] == ["0.00 B", "1023.00 B", "1.00 KB", "5.00 MB", "3072.00 GB"]
    assert one(spark, mime.mime_type("n"), n="a.b.PDF") == "application/pdf" and one(spark, mime.mime_type("n"), n="pdf") == mime.UNKNOWN
    assert mime.extension_of_mime()["text/html"] == "html"


@pytest.mark.parametrize(("content", "found"), [(b"%PDF-1.7", "application/pdf"), (b"PK\x03\x04...word/document", mime.MIME_TYPES["docx"]), (b"PK\x03\x04xl/", mime.MIME_TYPES["xlsx"]), (b"PK\x03\x04zz", "application/zip"), (b"\xd0\xcf\x11\xe0", "application/msword"), (b"abc", None), (b"<html>", "text/html"), (b'  {"a": 1}', "application/json")])
def test_sniff(spark, content, found):
    assert one(spark, mime.sniff("c"), c=content) == found


def test_validation(spark):
    files = spark.createDataFrame([("a.txt", b"12345"), ("b.EXE", b"123456"), ("c.pdf", b"text")], "filename string, content binary")
    rows = {r.filename: r for r in validation.validate_files(files, max_size=5, strict_mime=True).collect()}
    assert rows["a.txt"].valid and len(rows["b.EXE"].errors) == 3 and rows["c.pdf"].errors == ["MIME_MISMATCH: text/plain"]
    with pytest.raises(Exception, match="DOCUMENT_VALIDATION_ERROR"):
        validation.require_valid(files, max_size=5).collect()


def test_metadata_merge(spark):
    df = spark.range(1).select(merged(metadata(a="1", b="2"), metadata(b="3")).alias("m"))
    assert df.first().m == {"a": "1", "b": "3"}


@pytest.mark.parametrize("n", [1, 2, 4, 5, 9])
def test_page_windows(spark, n):
    pages = spark.createDataFrame([("d", k, f"p{k}") for k in range(n)], "doc string, page long, text string")
    got = {r.window_index: r.page_content for r in processors.merge_pages(pages, "doc", "page", "text", 4, 1, ",").collect()}
    want, start = {}, 0
    while not want or start + 1 < n and max(want) * 3 + 4 < n:
        want[len(want)] = ",".join(f"p{k}" for k in range(start, min(start + 4, n)))
        start += 3
    assert got == want
    with pytest.raises(ValueError):
        processors.merge_pages(pages, "doc", "page", "text", 2, 2)


def test_embedding_failures(spark):
    docs = documents(spark.createDataFrame([(1, "a"), (2, "b")], "i long, t string"), "i", "t")

    def broken(texts):
        raise RuntimeError("no")

    assert processors.embed(docs, broken, skip_on_error=True).filter("embedding is null").count() == 2
    with pytest.raises(Exception, match="no"):
        processors.embed(docs, broken).collect()


def test_percentiles_and_stale(spark):
    t = datetime(2024, 1, 1)
    rows = [("op", t + timedelta(seconds=k), t + timedelta(seconds=k), float(k), True, None) for k in range(1, 11)] + [("op", t, None, None, None, None)]
    ops = spark.createDataFrame(rows, control.OPERATIONS)
    m = metrics.aggregate_metrics(ops).first()
    assert (m["count"], m.p50, m.p95, m.p99) == (10, 5.0, 10.0, 10.0)
    assert metrics.concurrency(ops).first().running == 1
    closed = metrics.close_stale(ops, F.lit("2024-01-02").cast("timestamp")).filter("error is not null").first()
    assert closed.success is False and closed.duration == 86_400_000


def test_page_tasks(spark):
    own = spark.createDataFrame([(1, 3), (2, 1), (3, 0)], "task_id long, total long")

    def work(task, page):
        if page == 2:
            raise ValueError("bad page")
        return f"{task}/{page}"

    none = spark.createDataFrame([], tasks.RESULT)
    pages = tasks.process_pages(tasks.pages_to_process(own, none), work)
    got = {r.task_id: (r.completed, r.failed, r.percentage, r.status) for r in tasks.progress(own, pages).collect()}
    assert got == {1: (2, 1, 100, "completed"), 2: (1, 0, 100, "completed"), 3: (0, 0, 0, "pending")}
    again = tasks.pages_to_process(own, pages.filter("status = 'success'")).collect()
    assert [(r.task_id, r.page) for r in again] == [(1, 2)]
    assert {r.task_id: r.text for r in tasks.full_text(pages).collect()}[1] == "1/1\n\n1/3"
    only = spark.createDataFrame([(1, 9), (1, 3)], "task_id long, page long")
    assert [(r.task_id, r.page) for r in tasks.pages_to_process(own, none, only=only).collect()] == [(1, 3)]


def test_limiters(spark):
    calls = spark.createDataFrame([("a", t, i) for i, t in enumerate([0, 1, 2, 10, 11, 12])], "k string, at long, id long")
    allowed = lambda **o: [r.allowed for r in state.rate_limit(calls, "k", "at", "id", **o).orderBy("id").collect()]
    assert allowed(algorithm="fixed-window", limit=2, window_ms=10) == [True, True, False, True, True, False]
    assert allowed(algorithm="sliding-window", limit=2, window_ms=10) == [True, True, False, True, True, False]
    assert allowed(algorithm="token-bucket", capacity=2, refill=100) == [True, True, False, True, False, False]
    with pytest.raises(ValueError):
        state.limiter("other")


def test_breaker(spark):
    rows = [("a", t, t, ok, 1.0) for t, ok in enumerate([False, False, True, True, True])] + [("a", 100, 100, True, 1.0), ("a", 101, 101, True, 99.0)]
    calls = spark.createDataFrame(rows, "k string, at long, id long, ok boolean, d double")
    got = [(r.outcome, r.state) for r in state.circuit_breaker(calls, "k", "at", "id", "ok", "d", failures=2, successes=1, reset_ms=50, timeout_ms=50, minimum=100).orderBy("at").collect()]
    assert got == [("failure", "closed"), ("failure", "open"), *[("rejected", "open")] * 3, ("success", "closed"), ("failure", "closed")]


def test_cache(spark):
    rows = [("u", t, t, x) for t, x in enumerate("abacab")] + [("u", 1000, 1000, "b")]
    got = [r.hit for r in state.cache_replay(spark.createDataFrame(rows, "k string, at long, id long, item string"), "k", "at", "id", "item", size=2, ttl_ms=100).orderBy("at").collect()]
    assert got == [False, False, True, False, True, False, False]


def test_replay_is_the_same_however_rows_lie(spark):
    rows = [(f"k{i % 7}", i * 37 % 501, i) for i in range(500)]
    calls = spark.createDataFrame(rows, "k string, at long, id long")
    results = [sorted(map(tuple, state.rate_limit(calls.repartition(n), "k", "at", "id", limit=3, window_ms=60).collect())) for n in (1, 4, 16)]
    assert results[0] == results[1] == results[2]


def test_retry_and_options():
    tries = []

    def run():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("later")
        return "ok"

    waits = []
    assert control.retry(run, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(control.DocumentLoadError) as e:
        control.retry(lambda: 1 / 0, attempts=2, sleep=waits.append)
    assert e.value.code == "DOCUMENT_LOAD_ERROR" and control.or_default(lambda: 1 / 0, 7) == 7
    with pytest.raises(control.ConfigValidationError):
        control.Options(max_file_size=0)


def test_recorder(spark):
    recorder = control.Recorder()
    with recorder.operation("a"):
        pass
    with pytest.raises(ZeroDivisionError), recorder.operation("a"):
        1 / 0
    assert metrics.aggregate_metrics(recorder.table(spark)).first().failure_count == 1


def test_guards():
    now = [0]
    limited = control.limited(lambda x: x, state.sliding_window(2, 10), key=lambda x: x, clock=lambda: now[0])
    assert [limited("a"), limited("a"), limited("b")] == ["a", "a", "b"]
    with pytest.raises(control.RateLimitError):
        limited("a")
    now[0] = 10
    assert limited("a") == "a"
    run = control.guarded(lambda x: 1 / x, state.breaker(failures=2, successes=1, reset_ms=50, minimum=100), clock=lambda: now[0])
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            run(0)
    with pytest.raises(control.CircuitBreakerError):
        run(1)
    now[0] = 60
    assert run(1) == 1.0


def test_cancelled_tasks_and_pdf_info(spark):
    own = spark.createDataFrame([(1, 2, True), (2, 2, None)], "task_id long, total long, cancelled boolean")
    none = spark.createDataFrame([], tasks.RESULT)
    assert {r.task_id: r.status for r in tasks.progress(own, none).collect()} == {1: "cancelled", 2: "pending"}
    info = spark.createDataFrame([("word " * 100, 2)], "t string, n long").select(tx.pdf_info("t", "n").alias("i")).first().i
    assert (info.num_pages, info.text_length, info.avg_chars_per_page, info.is_scanned) == (2, 500, 250.0, False)


def test_fetchable(spark):
    rows = spark.createDataFrame([("https://a.b/c", "x"), ("ftp://a.b", "x"), ("http://a", "x" * 20)], "u string, h string")
    assert [r[0] for r in rows.select(validation.fetchable(F.col("u"), F.col("h"), 10)).collect()] == [True, False, False]
