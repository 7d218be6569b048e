import io
import re
import sys
import time
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.operators.processors import clean_text, enrich
from scriptorium.plans.service import fresh, not_cached, process_buffers
from scriptorium.operators.control import DocumentLoadError, Options
from scriptorium.sources import parsing, readers
from scriptorium.sources.parsing import Providers
from scriptorium.streaming import streams

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_D_", "."), text)
    return out.getvalue()


DOCX = archive(word__document_D_xml=f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Some</w:t><w:tab/><w:t>text</w:t></w:r></w:p></w:body></w:document>')
XLSX = archive(
    xl__workbook_D_xml=f'<workbook {S}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
    xl___rels__workbook_D_xml_D_rels='<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>',
    xl__worksheets__s1_D_xml=f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>age</t></is></c></row><row><c r="A2" t="s"><v>1</v></c></row></sheetData></worksheet>',
    xl__sharedStrings_D_xml=f"<sst {S}><si><t>name</t></si><si><t>Ann</t></si></sst>",
)


def test_csv():
    text = 'a,b\n1,"x,\ny"\n\n2\n3,z\n'
    assert [c for c, _ in parsing.csv_rows(text)] == ["a: 1\nb: x,\ny", "a: 3\nb: z"]
    assert [m["row"] for _, m in parsing.csv_rows(text)] == ["1", "3"]
    assert parsing.csv_rows("a,a\n1,2")[0][0] == "a: 2\na: 2"
    assert parsing.csv_rows("a,b\n1,2", source_column="b", metadata_columns=("a",)) == [("", {"a": "1", "source": "2", "row": "1", "format": "csv"})]
    assert parsing.csv_table("") == [] and parsing.csv_rows("a,b") == []
    assert parsing.csv_table("ab,c\n1,234\n5")[0][0] == "| ab | c   |\n| -- | --- |\n| 1  | 234 |\n| 5  |"


def test_json():
    text = '{"items": [{"t": "x", "n": 1}, [1, 2], "s", null]}'
    got = parsing.json_documents(text, ".items[]", metadata_keys=("n",), pretty=False)
    assert [c for c, _ in got] == ['{"t":"x"}', '{"0":1,"1":2}', "s", "null"]
    assert got[0][1] == {"n": "1", "format": "json", "index": "0"}
    assert parsing.json_documents("[1.0]", pretty=False)[0][0] == "[1]"
    for bad, path in ((text, "missing"), (text, "items.t"), ('{"a": 1}', "a[]")):
        with pytest.raises(ValueError):
            parsing.json_documents(bad, path)


def test_html_markdown():
    page = "<body><nav>no</nav><h2>T</h2><p>a <b>b</b> <a href='u'>l</a><br>x</p><ul><li>1<li>2</ul><table><tr><th>h</th></tr><tr><td>v</td></tr></table><script>no</script></body>"
    got = parsing.html_to_markdown(page)
    assert got.startswith("## T\n\na **b** [l](u)") and "- 1" in got and "| h |\n| --- |\n| v |" in got and "no" not in got


def test_html_elements_positions(spark):
    pages = spark.createDataFrame([("u", "<script>x</script><p>a</p><h1>b</h1><p> </p>"), ("v", None)], "path string, html string")
    got = readers.html_elements(pages, "path", "html").orderBy("doc_seq").collect()
    assert [(r.page_content, r.metadata["element"], r.metadata["position"]) for r in got] == [("b", "h1", "8"), ("a", "p", "0")]


@given(st.lists(st.sampled_from(["<p>", "</p>", "<P a='", "'>", "<h1 x>", "</h1>", "</h1 >", "<pre>", "t", "<", ">", "\n"]), max_size=24))
def test_elements_equal_one_pattern_a_tag(parts):
    page = "".join(parts)
    want = [(t, m.start(), m[1]) for t in parsing.HTML_TAGS for m in re.finditer(rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", page)]
    assert [(e["tag"], e["position"], e["inner"]) for e in parsing.elements(page)] == want


def test_office():
    assert parsing.docx_text(DOCX)[0][0] == "# Title\n\nSome\ttext"
    assert parsing.xlsx_documents(XLSX)[0][0] == "name,age\nAnn"
    assert parsing.xlsx_documents(XLSX, split_rows=True)[0] == ("name: Ann\nage: undefined", {"format": "xlsx", "sheet": "One", "row": "2"})
    assert parsing.xlsx_documents(XLSX, sheet="Two") == []


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "sub").mkdir()
    (root / ".git").mkdir()
    for name, data in {"a.txt": b"plain", "b.md": b"# h", "c.csv": b"x,y\n1,2\n3,4\n", "d.json": b'{"k": [1]}', "sub/e.html": b"<h1>Hi</h1>", "f.docx": DOCX, "g.xlsx": XLSX, "h.weird": b"w\xff", ".git/z.txt": b"no", "i.pdf": b"%PDF-1.4"}.items():
        (root / name).write_bytes(data)
    return root


def test_directory(spark, folder):
    rows = readers.read_directory(spark, str(folder)).collect()
    got = {(r.doc_id.rsplit("/", 1)[1], r.doc_seq): r.page_content for r in rows}
    assert got[("a.txt", 0)] == "plain" and got[("c.csv", 1)] == "x: 3\ny: 4" and got[("e.html", 0)] == "# Hi"
    assert got[("h.weird", 0)] == "w�" and got[("f.docx", 0)].startswith("# Title") and not any("z.txt" in k[0] or "pdf" in k[0] for k in got)
    plan = readers.read_directory(spark, str(folder))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("binaryFile") == 1
    own = readers.read_directory(spark, str(folder), overrides={"markdown": lambda f: readers.read_text(f, kind="own")}).collect()
    assert len(own) == len(rows) and [r.page_content for r in own if r.metadata["format"] == "own"] == ["# h"]
    assert readers.read_directory(spark, str(folder), glob="*.md").count() == 1
    pages = Providers(pdf=lambda c: [("", {})], ocr=lambda c: [(2, "success", "two"), (1, "success", "one"), (3, "failed", None)])
    pdf = readers.read_directory(spark, str(folder), glob="*.pdf", providers=pages).orderBy("doc_seq").collect()
    assert [(r.page_content, r.metadata["totalPages"]) for r in pdf] == [("one", "2"), ("two", "2")]


def test_broken_files_can_be_left_out(spark, tmp_path):
    (tmp_path / "a.json").write_text("{")
    (tmp_path / "b.docx").write_text("no archive")
    (tmp_path / "c.json").write_text("[1]")
    assert readers.read_directory(spark, str(tmp_path), ignore_errors=True).count() == 1
    with pytest.raises(Exception, match="JSON|Expecting"):
        readers.read_directory(spark, str(tmp_path), glob="*.json").collect()


def test_service_and_cache(spark):
    files = spark.createDataFrame([("a.txt", b"a  b"), ("b.exe", b"x")], "filename string, content binary")
    result = process_buffers(files, clean_text, enrich)
    assert [(r.page_content, r.metadata["source"], r.word_count) for r in result.documents.collect()] == [("a b", "a.txt", 2)]
    assert result.refused.first().path == "b.exe"
    with pytest.raises(DocumentLoadError):
        process_buffers(files, options=Options(continue_on_error=False))
    from pyspark.sql import functions as F

    from scriptorium.functions.text import cache_key

    cache = files.limit(1).select(cache_key("filename", "content").alias("key"), F.lit("2024-01-01").cast("timestamp").alias("cached_at"))
    assert [r.filename for r in not_cached(files, cache).collect()] == ["b.exe"]
    assert fresh(cache, F.lit("2024-01-02").cast("timestamp")).count() == 0


def test_file_stream(spark, folder, tmp_path):
    files = streams.file_stream(spark, str(folder), "*.txt")
    query = streams.process_stream(files, readers.read_text, clean_text, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    query.awaitTermination(120)
    assert {r.page_content for r in spark.read.parquet(str(tmp_path / "out")).collect()} >= {"plain"}


def test_limit_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", t) for t in (0, 1, 2, 10)], "key string, at_ms long").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    calls = spark.readStream.schema("key string, at_ms long").parquet(str(tmp_path / "in"))
    query = streams.limit_stream(calls, 2, 10).writeStream.format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        deadline = time.time() + 90
        while time.time() < deadline and spark.table("limits").count() < 4:
            time.sleep(1)
        assert [r.allowed for r in spark.table("limits").orderBy("at_ms").collect()] == [True, True, False, True]
    finally:
        query.stop()


def test_refused_files_and_reader_options(spark, tmp_path):
    from scriptorium.plans.service import load_and_split

    for name, raw in {"a.csv": b"k;v\n1;2\n", "b.json": b"{broken", "c.json": b'{"items": [{"t": "one", "n": 5}]}', "d.txt": b"text", "e.docx": b"no zip", "f.pdf": b"%PDF-"}.items():
        (tmp_path / name).write_bytes(raw)
    options = {"csv": {"separator": ";", "metadata_columns": ("k",)}, "json": {"path": "items[]", "content_key": "t", "metadata_keys": ("n",)}}
    docs, refused = readers.read_or_refuse(readers.binary_files(spark, str(tmp_path)), reader_options=options)
    assert {(r.doc_id.rsplit("/", 1)[1], r.page_content) for r in docs.collect()} == {("a.csv", "v: 2"), ("c.json", "one"), ("d.txt", "text")}
    why = {r.path.rsplit("/", 1)[1]: r.error for r in refused.collect()}
    assert set(why) == {"b.json", "e.docx", "f.pdf"} and why["f.pdf"] == "no reader for pdf" and why["b.json"].startswith("JSONDecodeError")
    listed = readers.read_directory(spark, str(tmp_path), ignore_errors=True, reader_options=options)
    assert listed.count() == 3 and {r.metadata.get("k") or r.metadata.get("n") for r in listed.collect()} == {"1", "5", None}
    long = spark.createDataFrame([("x", "word " * 500, {})], "doc_id string, page_content string, metadata map<string,string>")
    assert [len(r.page_content) <= 1000 for r in load_and_split(long).collect()] == [True] * 3


def test_elements_are_held_for_a_portion_of_pages_only(spark):
    class Tags(tuple):
        """Tags that are looked at for each page, and then tell whether the interpreter holds many more objects than at first."""

        first: list = []

        def __iter__(self):
            Tags.first.append(sys.getallocatedblocks())
            if Tags.first[-1] - Tags.first[0] > 1_000_000:
                raise MemoryError("the elements of too many pages are held")
            return super().__iter__()

    pages = spark.range(0, 2000, 1, 1).select(F.col("id"), F.repeat(F.lit("<p>0123456789</p>"), 500).alias("html"))
    assert readers.html_elements(pages, "id", "html", Tags(("h1", "p"))).count() == 2000 * 500
