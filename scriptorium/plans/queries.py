"""Queries over the sample tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import mime
from scriptorium.functions import text as tx
from scriptorium.functions.portions import per_text
from scriptorium.operators import metrics, processors, splitters, state, tasks, validation
from scriptorium.operators.splitting import CharacterRules, HtmlRules, JsonRules, RecursiveRules
from scriptorium.plans.result_cache import ResultCache
from scriptorium.schema import CONTENT, METADATA, documents
from scriptorium.session import configure, work_folder
from scriptorium.sources import file_source, large_csv, large_json, readers
from scriptorium.streaming import streams
from scriptorium.streaming.page_tasks import PageTasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: configure(spark).read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _docs(t) -> DataFrame:
    return documents(t("documents"), "doc_id", "text")


def _messy(text):
    """A text with tabs, CRLF and blank lines, for the cleaner."""
    return F.concat(F.replace(F.replace(text, F.lit(" the "), F.lit(" \t the  ")), F.lit("\n"), F.lit(" \r\n\n")), F.lit("\n\n\n\nend "))


_MESSY = r"replace(replace(text, ' the ', ' ' || chr(9) || ' the  '), chr(10), ' ' || chr(13) || chr(10) || chr(10)) || chr(10) || chr(10) || chr(10) || chr(10) || 'end '"
_TRIM = r"regexp_replace({x}, '^[\s\x{FEFF}\x{00A0}\p{Z}\x{0085}]+|[\s\x{FEFF}\x{00A0}\p{Z}\x{0085}]+$', '', 'g')"
_CLEAN = rf"""array_to_string(list_transform(string_split(regexp_replace(regexp_replace(replace({_MESSY}, chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda x: {_TRIM.replace("{x}", "x")}), chr(10))"""


@_query(f"select doc_id, {_CLEAN} as page_content from documents")
def text_clean(t):
    return processors.clean_text(documents(t("documents"), "doc_id", _messy(F.col("text")))).select("doc_id", CONTENT)


@_query(rf"""select doc_id, cast(case when trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' then 0 else len(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\s+')) end as bigint) as word_count,
    cast(length(text) as bigint) as char_count, cast(len(string_split(text, chr(10))) as bigint) as line_count from documents""")
def metadata_enrich(t):
    return processors.enrich(_docs(t)).select("doc_id", "word_count", "char_count", "line_count")


def _windows_sql(size: int, overlap: int) -> str:
    s = size - overlap
    return f"""select doc_id, cast(k as bigint) as chunk_index, substr(text, cast(k * {s} + 1 as bigint), {size}) as page_content from documents,
        lateral (select unnest(range(case when length(text) = 0 then 0 when length(text) <= {size} then 1 else 1 + cast(ceil((length(text) - {size}) / {s}.0) as bigint) end)) as k)"""


@_query(_windows_sql(1000, 200))
def token_split(t):
    return splitters.split_windows(_docs(t)).select("doc_id", "chunk_index", CONTENT)


@_query(_windows_sql(100, 30))
def token_split_small(t):
    return splitters.split_windows(_docs(t), 100, 30).select("doc_id", "chunk_index", CONTENT)


def _pages_sql(size: int, overlap: int, sep: str) -> str:
    s = size - overlap
    return f"""with p as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn, text) - 1 as r, count(*) over (partition by conv_id) as n from conversations),
        w as (select distinct conv_id, unnest(range(case when n <= {size} then 1 else 1 + cast(ceil((n - {size}) / {s}.0) as bigint) end)) as k from p)
        select w.conv_id, cast(k as bigint) as window_index, string_agg(text, {sep} order by r) as page_content, cast(min(turn) as bigint) as page_from, cast(max(turn) as bigint) as page_to, count(*) as page_count
        from w join p on p.conv_id = w.conv_id and r >= k * {s} and r < k * {s} + {size} group by w.conv_id, k"""


@_query(_pages_sql(4, 1, "chr(10) || chr(10)"))
def page_merge(t):
    return processors.merge_pages(t("conversations"), "conv_id", "turn", "text", 4, 1)


@_query(_pages_sql(3, 0, "' / '"))
def page_merge_tumbling(t):
    return processors.merge_pages(t("conversations"), "conv_id", "turn", "text", 3, 0, " / ")


_STRIP = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '\s+', ' ', 'g'))"""
_NO_SCRIPTS = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g')"


@_query(f"select page_id, {_STRIP.replace('{x}', _NO_SCRIPTS)} as text from pages")
def html_strip(t):
    return t("pages").select("page_id", tx.strip_html("html").alias("text"))


_TAG_ROWS = " union all ".join(rf"select page_id, '{tag}' as element, unnest(regexp_extract_all(page, '(?is)<{tag}\b[^>]*>(.*?)</{tag}>', 1)) as inner_html from s" for tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "article", "section"))


@_query(f"with s as (select page_id, {_NO_SCRIPTS} as page from pages), e as ({_TAG_ROWS}) select page_id, element, {_STRIP.replace('{x}', 'inner_html')} as page_content from e where {_STRIP.replace('{x}', 'inner_html')} <> ''")
def html_elements(t):
    out = readers.html_elements(t("pages"), "page_id", "html")
    return out.select(F.col("doc_id").alias("page_id"), F.col(METADATA)["element"].alias("element"), CONTENT)


@_query(r"""with f as (select doc_id, source || '.' || ['txt', 'md', 'pdf', 'exe'][1 + doc_id % 4] as filename, octet_length(encode(text)) as size from documents)
    select doc_id, filename, cast(size as bigint) as size, lower(regexp_extract(filename, '[^.]*$')) as extension,
    case when filename like '%.txt' then 'text/plain' when filename like '%.md' then 'text/markdown' when filename like '%.pdf' then 'application/pdf' end as mime_type,
    array_to_string(list_filter([case when size > 4000 then 'FILE_TOO_LARGE: ' || size || ' bytes, at most 4000' end, case when filename like '%.exe' then 'UNSUPPORTED_FORMAT: .exe' end], lambda x: x is not null), '; ') as errors,
    size <= 4000 and filename not like '%.exe' as valid from f""")
def file_validate(t):
    name = F.concat("source", F.lit("."), F.element_at(F.array(*map(F.lit, ("txt", "md", "pdf", "exe"))), (F.col("doc_id") % 4 + 1).cast("int")))
    files = t("documents").select("doc_id", name.alias("filename"), F.col("text").cast("binary").alias("content"))
    return validation.validate_files(files, max_size=4000).drop("content").withColumn("errors", F.array_join("errors", "; "))


@_query(r"""with f as (select doc_id, ['a.TXT', 'b.md', 'c.tar.pdf', 'plain', 'd.xyz', 'e.html'][1 + doc_id % 6] as filename from documents)
    select doc_id, filename, case filename when 'a.TXT' then 'text/plain' when 'b.md' then 'text/markdown' when 'c.tar.pdf' then 'application/pdf' when 'e.html' then 'text/html' else 'application/octet-stream' end as mime,
    case filename when 'b.md' then 'markdown' when 'c.tar.pdf' then 'pdf' when 'e.html' then 'html' else 'text' end as reader from f""")
def mime_dispatch(t):
    names = F.array(*map(F.lit, ("a.TXT", "b.md", "c.tar.pdf", "plain", "d.xyz", "e.html")))
    files = t("documents").select("doc_id", F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int")).alias("filename"))
    return files.select("doc_id", "filename", mime.mime_type("filename").alias("mime"), mime.format_of("filename").alias("reader"))


@_query("""select page_id, case when lower(substr(html, 1, 100)) like '%<!doctype html%' or lower(substr(html, 1, 100)) like '%<html%' then 'text/html' when left(ltrim(substr(html, 1, 10)), 1) in ('{', '[') then 'application/json' else 'text/plain' end as mime from pages""")
def magic_sniff(t):
    return t("pages").select("page_id", mime.sniff(F.col("html").cast("binary")).alias("mime"))


@_query("select doc_id, 'buffer:' || source || ':' || substr(sha256(text), 1, 16) as key from documents")
def cache_key(t):
    return t("documents").select("doc_id", tx.cache_key("source", F.col("text").cast("binary")).alias("key"))


_SCAN = r"""with d as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as s, 1 + doc_id % 20 as pages from documents),
    r as (select doc_id, length(s) as n, length(s) / pages::double as a, length(regexp_replace(s, '[\w\s\x{4E00}-\x{9FA5}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]', '', 'g')) / nullif(length(s), 0)::double as special,
        length(regexp_replace(s, '[^a-zA-Z0-9\x{4E00}-\x{9FA5}]', '', 'g')) / nullif(length(s), 0)::double as readable from d)
    select doc_id, case when n = 0 then true else a < 100 or special > 0.3 or readable < 0.5 or (a < 200 and special > 0.2) end as scanned, round(coalesce(special, 0), 9) as special_ratio from r"""


@_query(_SCAN)
def scan_detect(t):
    docs = t("documents").select("doc_id", "text", (F.col("doc_id") % 20 + 1).alias("pages"))
    return docs.select("doc_id", tx.looks_scanned("text", "pages").alias("scanned"), F.round(tx.special_ratio(tx.trim_all("text")), 9).alias("special_ratio"))


@_query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_extract(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@_query("""select conv_id, cast(i as bigint) as index, text as page_content from (select conv_id, text, row_number() over (partition by conv_id order by turn, text) - 1 as i from conversations)""")
def json_items(t):
    item = F.array_sort(F.collect_list(F.struct(F.col("turn").alias("a"), F.col("text").alias("b"))))
    files = t("conversations").groupBy("conv_id").agg(F.to_json(F.struct(item.alias("items"))).alias("json"))
    out = readers.read_json(files.select(F.col("conv_id").alias("path"), F.col("json").cast("binary").alias("content")), ".items[]", "b", ("a",))
    return out.select(F.col("doc_id").cast("bigint").alias("conv_id"), F.col("doc_seq").alias("index"), CONTENT)


@_query("""select cast(n_nationkey as bigint) as doc_id, 'n_name: ' || n_name || chr(10) || 'n_regionkey: ' || n_regionkey as page_content, cast(n_nationkey as varchar) as n_nationkey from nation""")
def csv_rows(t):
    out = readers.table_rows(t("nation"), "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"], ("n_nationkey",))
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), CONTENT, F.col(METADATA)["n_nationkey"].alias("n_nationkey"))


@_query("""with w as (select greatest(11, max(length(r_regionkey::varchar))) as a, greatest(6, max(length(r_name))) as b, count(*) as n from region)
    select '| ' || rpad('r_regionkey', a::int, ' ') || ' | ' || rpad('r_name', b::int, ' ') || ' |' || chr(10) || '| ' || repeat('-', a) || ' | ' || repeat('-', b) || ' |' || chr(10) ||
    (select string_agg('| ' || rpad(r_regionkey::varchar, w.a::int, ' ') || ' | ' || rpad(r_name, w.b::int, ' ') || ' |', chr(10) order by r_regionkey) from region) as page_content, n as rows, cast(2 as bigint) as columns from w""")
def csv_markdown_table(t):
    return readers.table_markdown(t("region"), ["r_regionkey", "r_name"], "r_regionkey")


def _csv_files(t) -> DataFrame:
    """One CSV file for each conversation: a header, then turn, role and text in quotes, doubled where the text has some."""
    quoted = F.concat(F.lit('"'), F.replace(F.concat(F.col("text"), F.lit(', "so"')), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("turn").cast("string"), "role", quoted)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"])
    text = F.array_join(F.concat(F.array(F.lit("turn,role,text")), lines), "\r\n")
    return t("conversations").groupBy(F.col("conv_id").cast("string").alias("path")).agg(text.cast("binary").alias("content"))


@_query("""select conv_id, 'turn: ' || turn || chr(10) || 'text: ' || text || ', "so"' as page_content, role, cast(row_number() over (partition by conv_id order by turn, text) as varchar) as row from conversations""")
def csv_parse(t):
    out = readers.read_csv(_csv_files(t), metadata_columns=("role",))
    return out.select(F.col("doc_id").cast("bigint").alias("conv_id"), CONTENT, F.col(METADATA)["role"].alias("role"), F.col(METADATA)["row"].alias("row"))


@_query("""with c as (select conv_id, turn, role, text || ', "so"' as text from conversations), w as (select conv_id, greatest(4, max(length(turn::varchar)))::int as a, greatest(4, max(length(role)))::int as b, greatest(4, max(length(text)))::int as c, count(*) as n from c group by 1)
    select w.conv_id, '| ' || rpad('turn', any_value(w.a), ' ') || ' | ' || rpad('role', any_value(w.b), ' ') || ' | ' || rpad('text', any_value(w.c), ' ') || ' |' || chr(10) || '| ' || repeat('-', any_value(w.a)) || ' | ' || repeat('-', any_value(w.b)) || ' | ' || repeat('-', any_value(w.c)) || ' |' || chr(10) ||
        string_agg('| ' || rpad(turn::varchar, w.a, ' ') || ' | ' || rpad(role, w.b, ' ') || ' | ' || rpad(text, w.c, ' ') || ' |', chr(10) order by turn, text) as page_content, cast(any_value(n) as varchar) as rows
    from w join c using (conv_id) group by w.conv_id""")
def csv_table_parse(t):
    out = readers.read_csv(_csv_files(t), split_rows=False)
    return out.select(F.col("doc_id").cast("bigint").alias("conv_id"), CONTENT, F.col(METADATA)["rows"].alias("rows"))


@_query("""select doc_id, ['application/pdf', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet', 'application/zip', 'application/msword'][1 + doc_id % 5] as mime from documents""")
def magic_sniff_binary(t):
    """The first bytes of PDF, ZIP and OLE files, and names of parts inside ZIP files, ahead of each text."""
    heads = ("25504446", "504B0304" + b"\x00word/document.xml".hex(), "504B0304" + b"\x00xl/workbook.xml".hex(), "504B0304" + b"\x00a.txt".hex(), "D0CF11E0")
    head = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 5 + 1).cast("int")))
    return t("documents").select("doc_id", mime.sniff(F.concat(head, F.lit(" ").cast("binary"), F.coalesce("text", F.lit("")).cast("binary"))).alias("mime"))


def _operations(t) -> DataFrame:
    e = t("events")
    return e.select(F.col("event_type").alias("operation"), F.col("ts").cast("timestamp").alias("started"), F.col("ts").cast("timestamp").alias("ended"), F.col("value").alias("duration"), (F.col("event_type") != "error").alias("success"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"), "event_id")


_OPS = "o as (select event_type as operation, ts, value as duration, event_type <> 'error' as success, event_id, props from events)"
_ROLL = """operation, count(*) as count, cast(sum(success::int) as bigint) as success_count, cast(sum((not success)::int) as bigint) as failure_count, avg((not success)::int) as error_rate,
    round(sum(duration), 4) as total_duration, round(avg(duration), 6) as avg_duration, min(duration) as min_duration, max(duration) as max_duration,
    quantile_disc(duration, 0.5) as p50, quantile_disc(duration, 0.95) as p95, quantile_disc(duration, 0.99) as p99"""


def _rounded(rolled: DataFrame) -> DataFrame:
    return rolled.withColumns({"total_duration": F.round("total_duration", 4), "avg_duration": F.round("avg_duration", 6), "throughput": F.round("throughput", 9)})


@_query(f"with {_OPS} select {_ROLL}, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) as throughput from o group by operation")
def op_metrics(t):
    return _rounded(metrics.aggregate_metrics(_operations(t)))


@_query(f"with {_OPS} select {_ROLL}, round(count(*) / 86400.0, 9) as throughput from o where ts > timestamp '2024-01-20 00:00:00' - interval 86400 second group by operation")
def op_metrics_realtime(t):
    return _rounded(metrics.realtime_metrics(_operations(t), F.lit("2024-01-20 00:00:00").cast("timestamp"), 86_400))


@_query(f"""with {_OPS}, h as (select operation, floor(ln(1 + abs(duration)) * 200) * sign(duration) as bucket, count(*) as n, max(duration) as most from o where duration is not null group by all),
    c as (select *, sum(n) over (partition by operation order by bucket) as upto, sum(n) over (partition by operation) as total from h)
    select operation, cast(max(total) as bigint) as count, {", ".join(f"max(most) filter (greatest(1, (total * {p} + 99) // 100) <= upto and greatest(1, (total * {p} + 99) // 100) > upto - n) as p{p}" for p in (50, 95, 99))} from c group by 1""")
def op_histograms(t):
    """Percentiles from a roll-up table of hourly histograms."""
    rolled = metrics.histograms(_operations(t))
    folder = work_folder(rolled.sparkSession, "histograms")
    rolled.write.parquet(folder)
    return metrics.merged_percentiles(rolled.sparkSession.read.parquet(folder))


@_query(f"with {_OPS} select event_id, operation, duration from o where duration > 100")
def slow_operations(t):
    return metrics.slow_operations(_operations(t), 100).select("event_id", "operation", "duration")


@_query(f"with {_OPS} select event_id, operation, props as error from o where not success order by ts desc, operation desc limit 100")
def last_errors(t):
    return metrics.last_errors(_operations(t)).select("event_id", "operation", "error")


@_query("""select event_type as operation, window_start, window_start + interval 1 day as window_end, count(*) as count, round(avg(value), 6) as avg_duration, round(count(*) / 86400.0, 9) as throughput
    from (select *, unnest([time_bucket(interval 12 hour, ts), time_bucket(interval 12 hour, ts) - interval 12 hour]) as window_start from events) group by 1, 2""")
def sliding_metrics(t):
    rolled = streams.sliding_metrics(_operations(t), "1 day", "12 hours")
    return rolled.select("operation", F.col("window_start").cast("timestamp_ntz"), F.col("window_end").cast("timestamp_ntz"), "count", F.round("avg_duration", 6).alias("avg_duration"), F.round("throughput", 9).alias("throughput"))


@_query("""select coalesce(level, 'all') as level, cast(sum(hit::int) as bigint) as hits, cast(sum((not hit)::int) as bigint) as misses, avg(hit::int) as hit_rate from
    (select case when event_id % 3 = 0 then 'l2' else 'l1' end as level, event_id % 5 <> 0 as hit from events) group by rollup (level)""")
def cache_statistics(t):
    return metrics.cache_statistics(t("events").select(F.when(F.col("event_id") % 3 == 0, "l2").otherwise("l1").alias("level"), (F.col("event_id") % 5 != 0).alias("hit")))


def _tasks(t) -> tuple[DataFrame, DataFrame]:
    items = t("lineitem")
    own = items.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.max("l_linenumber").cast("bigint").alias("total"))
    rows = items.select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").cast("bigint").alias("page"), "l_linestatus", "l_returnflag")
    done = rows.filter("l_linestatus = 'F'").select("task_id", "page", F.lit(tasks.SUCCESS).alias("status"))
    return own, done.unionByName(rows.filter("l_returnflag = 'R'").select("task_id", "page", F.lit(tasks.PAGE_FAILED).alias("status")))


_TASKS = """t as (select l_orderkey as task_id, cast(max(l_linenumber) as bigint) as total from lineitem group by 1),
    c as (select l_orderkey as task_id, count(distinct case when l_linestatus = 'F' then l_linenumber end) as completed, count(distinct case when l_returnflag = 'R' then l_linenumber end) as failed from lineitem group by 1)"""


@_query("""select l_orderkey as task_id, cast(p as bigint) as page from (select l_orderkey, unnest(range(1, max(l_linenumber) + 1)) as p from lineitem group by 1)
    except select l_orderkey, cast(l_linenumber as bigint) from lineitem where l_linestatus = 'F' except select l_orderkey, cast(1 as bigint) from lineitem where l_orderkey % 7 = 0""")
def task_resume(t):
    own, pages = _tasks(t)
    skip = own.filter("task_id % 7 = 0").select("task_id", F.lit(1).alias("page"))
    return tasks.pages_to_process(own, pages.filter(F.col("status") == tasks.SUCCESS), skip)


@_query(f"""with {_TASKS} select task_id, total, completed, failed, cast(floor((completed + failed) * 100 / total) as bigint) as percentage,
    case when completed + failed >= total then case when failed > 0 and completed = 0 then 'failed' else 'completed' end when completed + failed > 0 then 'processing' else 'pending' end as status from t join c using (task_id)""")
def task_progress(t):
    return tasks.progress(*_tasks(t))


@_query("""select cast(doc_id as varchar) as doc_id, 'source: ' || coalesce(source, '') || chr(10) || 'text: ' || coalesce(text, '') as page_content from documents""")
def csv_blocks(t):
    """The documents as CSV files, whose texts hold line ends, separators and quotes, read in blocks."""
    docs = t("documents").select("doc_id", "source", "text")
    folder = work_folder(docs.sparkSession, "csv-files")
    docs.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    made = large_csv.read_csv(docs.sparkSession, folder, metadata_columns=("doc_id",))
    return made.select(F.col(METADATA)["doc_id"].alias("doc_id"), CONTENT)


@_query("""select cast(doc_id as varchar) as doc_id, coalesce(text, '') as page_content from documents""")
def json_blocks(t):
    """The documents as files of one JSON array each, read in blocks."""
    docs = t("documents").select(F.to_json(F.struct("doc_id", "source", "text")).alias("value"))
    folder = work_folder(docs.sparkSession, "json-files")

    def array(batches):
        any_yet = False
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([("," if any_yet or k else "[") + r for k, r in enumerate(rows)], pa.string())], names=["value"])
                any_yet = True
        if any_yet:
            yield pa.RecordBatch.from_arrays([pa.array(["]"], pa.string())], names=["value"])

    docs.mapInArrow(array, "value string").write.text(folder)
    made = large_json.read_json(docs.sparkSession, folder, content_key="text", metadata_keys=("doc_id",))
    return made.select(F.col(METADATA)["doc_id"].alias("doc_id"), CONTENT)


@_query("""select cast(doc_id as varchar) || '.txt' as doc_id, cast(length(coalesce(text, '')) as bigint) as characters, doc_id % 3 = 0 as cached from documents""")
def result_cache(t):
    """Texts as files, of which a third is in the cache, a third is there with other content, and a third is new."""
    docs = t("documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), "doc_id")
    cache = ResultCache(docs.sparkSession, work_folder(docs.sparkSession, "result-cache"))
    files = docs.select("path", "content")
    before = docs.filter("doc_id % 3 = 0 or doc_id % 3 = 1").withColumn("content", F.when(F.col("doc_id") % 3 == 1, F.concat("content", F.lit("changed since").cast("binary"))).otherwise(F.col("content")))
    cache.process(before.select("path", "content"), readers.read_files)
    out = cache.process(files, readers.read_files)
    return out.select("doc_id", F.length(CONTENT).cast("long").alias("characters"), "cached")


@_query(r"""select lang, cast(count(*) as bigint) as documents, cast(sum(len(string_split(coalesce(text, ''), chr(10)))) as bigint) as lines, cast(sum(octet_length(encode(coalesce(text, ''))) + 1) as bigint) as bytes from documents group by 1""")
def file_source_lines(t):
    """The texts as files in a folder for each language and parity of doc_id, read by the file source, which opens the files of one parity at a time."""
    docs = t("documents").select("lang", (F.col("doc_id") % 2).alias("odd"), F.coalesce("text", F.lit("")).alias("text"))
    folder = work_folder(docs.sparkSession, "text-files")
    docs.select("lang", "odd", F.concat(F.replace("text", F.lit("\x1e"), F.lit(" ")), F.lit("\x1e")).alias("text")).write.option("lineSep", "\n").partitionBy("lang", "odd").text(folder)
    one = file_source.files(docs.sparkSession, folder, extensions="txt", minLength=1, pathGlob="*/odd=0/*")
    listed = file_source.files(docs.sparkSession, folder, content="false")
    both = one.unionByName(file_source.open_files(listed.filter("extension = 'txt' and length > 0 and path like '%/odd=1/%'")))
    texts = F.split(F.col("content").cast("string"), "\x1e\n")
    each = both.select(F.nullif(F.regexp_extract("path", "/lang=([^/]*)/", 1), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("lang"), F.explode(F.slice(texts, 1, F.size(texts) - 1)).alias("text"))
    return each.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size(F.split("text", "\n")).cast("long")).alias("lines"), F.sum((F.octet_length("text") + 1).cast("long")).alias("bytes"))


@_query("""with p as (select conv_id, row_number() over (partition by conv_id order by turn, role, text) as page, length(coalesce(text, '')) % 3 <> 0 as ok from conversations where conv_id is not null),
    first as (select conv_id, page, ok from p where conv_id % 7 <> 0 and not (conv_id % 5 = 0 and page = 1)),
    t as (select conv_id, count(*) as total, count(*) filter (f.ok) as done, count(*) filter (not f.ok) as bad from p left join first f using (conv_id, page) group by 1),
    second as (select p.conv_id, p.page, f.page is not null or p.ok as ok from p join t using (conv_id) left join first f using (conv_id, page) where not (done + bad >= total and done > 0) and not coalesce(f.ok, false)),
    s as (select conv_id, count(*) filter (ok) as done2, count(*) filter (not ok) as bad2, count(*) as n from second group by 1),
    r as (select conv_id, total, done + coalesce(done2, 0) as completed, bad + coalesce(bad2, 0) as failed, done + bad + coalesce(n, 0) as attempts from t left join s using (conv_id))
    select conv_id as task_id, total, completed, failed, cast(floor((completed + failed) * 100 / total) as bigint) as percentage,
    case when completed + failed >= total then case when completed = 0 then 'failed' else 'completed' end else 'processing' end as status, attempts from r""")
def page_tasks(t):
    """Every turn is a page; some fail at first. Tasks are started (some without their first page), some are cancelled, then all are started again."""
    pages = t("conversations").filter("conv_id is not null").withColumn("page", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    pages = pages.select(F.col("conv_id").alias("task_id"), "page", F.coalesce("text", F.lit("")).alias("text"))
    own = pages.groupBy("task_id").agg(F.count(F.lit(1)).alias("total"))

    def process(todo: DataFrame) -> DataFrame:
        ok = (F.col("attempt") > 1) | (F.length("text") % 3 != 0)
        made = todo.join(pages, ["task_id", "page"])
        return made.select("task_id", "page", F.when(ok, tasks.SUCCESS).otherwise(tasks.PAGE_FAILED).alias("status"), F.when(ok, F.col("text")).alias("text"), F.when(~ok, "unreadable").alias("error"), F.lit(0).cast("long").alias("duration_ms"), F.current_timestamp().alias("at"))

    store = PageTasks(own.sparkSession, work_folder(own.sparkSession, "page-tasks"))
    store.start(own.withColumn("skip", F.when(F.col("task_id") % 5 == 0, F.array(F.lit(1)))))
    store.cancel(own.filter("task_id % 7 = 0"))
    store.run_until_idle(process)
    store.start(own)
    store.run_until_idle(process)
    tried = store.attempts().groupBy("task_id").agg(F.count(F.lit(1)).alias("attempts"))
    return store.progress().drop("at").join(tried, "task_id", "left").na.fill(0, ["attempts"])


@_query("""select o_orderkey as task_id, o_orderdate as end_time from orders where o_orderdate is null or o_orderdate >= timestamp '1998-01-01 00:00:00' - interval 7 day""")
def task_cleanup(t):
    own = t("orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").alias("end_time"))
    return tasks.without_old(own, F.lit("1998-01-01 00:00:00").cast("timestamp")).withColumn("end_time", F.col("end_time").cast("timestamp_ntz"))


@_query("select conv_id as task_id, string_agg(text, chr(10) || chr(10) order by turn) as text from conversations where role <> 'system' and text <> '' group by 1")
def ocr_full_text(t):
    pages = t("conversations").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("page"), F.when(F.col("role") == "system", tasks.SKIPPED).otherwise(tasks.SUCCESS).alias("status"), "text", F.lit(0).alias("at"))
    return tasks.full_text(pages)


@_query("select case when bool_and(up) then 'up' when not bool_or(up) then 'down' else 'degraded' end as status, count(*) as components from (select n_name, n_regionkey <> 2 as up from nation)")
def health_rollup(t):
    return metrics.health(t("nation").select(F.col("n_name").alias("component"), (F.col("n_regionkey") != 2).alias("up")))


# Sequential rules: a figure that SQL can say where there is one, else rows only -------


@_query("select doc_id, string_agg(c, '' order by i) as page_content from (select doc_id, i, text[i] as c from documents, lateral (select unnest(range(1, length(text) + 1)) as i)) group by doc_id, (i - 1) // 100")
def character_split_exact(t):
    """Cut at every character without overlap, chunks are plain windows; trimming is switched off by a mark."""
    rules = CharacterRules(size=100, overlap=0, separator="")
    marked = documents(t("documents"), "doc_id", F.translate("text", " \n", "\u0001\u0002"))
    return splitters.split_characters(marked, rules).select("doc_id", F.translate(CONTENT, "\u0001\u0002", " \n").alias(CONTENT))


@_query()
def character_split(t):
    return splitters.split_characters(_docs(t), CharacterRules(separator="\n")).select("doc_id", "chunk_index", CONTENT)


@_query()
def recursive_split(t):
    return splitters.split_recursively(_docs(t)).select("doc_id", "chunk_index", CONTENT)


@_query()
def language_split(t):
    return splitters.split_recursively(_docs(t), RecursiveRules.from_language("markdown", size=300, overlap=30)).select("doc_id", "chunk_index", CONTENT)


@_query()
def chunk_size_guard(t):
    return splitters.control_chunk_size(_docs(t), force_overlap=False).select("doc_id", "chunk_index", CONTENT)


@_query()
def chunk_size_control(t):
    return splitters.control_chunk_size(_docs(t)).select("doc_id", "chunk_index", CONTENT)


@_query("""with l as (select doc_id, i, regexp_replace(s, '^\\s+|\\s+$', '', 'g') as s from (select doc_id, unnest(range(1, len(p) + 1)) as i, unnest(p) as s from (select doc_id, string_split(text, chr(10)) as p from documents)))
    select doc_id, cast(i - 1 as bigint) as chunk_index, trim('# ' || (i - 1) || ' ' || s) as page_content, trim((i - 1) || ' ' || s) as header from l""")
def markdown_split(t):
    """Each line as a heading with the line under it: one chunk for each heading."""
    marked = F.concat_ws("\n", F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("# "), i, F.lit(" "), x)))
    docs = documents(t("documents"), "doc_id", marked)
    out = splitters.split_markdown_sections(docs)
    return out.select("doc_id", "chunk_index", CONTENT, F.col(METADATA)["Header 1"].alias("header"))


def outline(text: str) -> str:
    """A text with headings of three levels, blank lines and fences put in by line number."""
    marks = {0: "# ", 2: "## ", 3: "\n", 5: "### ", 7: "```\n## ", 9: "```\n"}
    return "\n".join(marks.get(k % 11, "") + x for k, x in enumerate(re.split("[\n.]", text)))


def _outlined(t) -> DataFrame:
    def marked(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([outline(x or "") for x in texts.to_pylist()], pa.string())]

    return documents(t("documents"), "doc_id", per_text("text string", lambda: marked)("text")["text"])


@_query()
def markdown_headers(t):
    return splitters.split_markdown(_outlined(t)).select("doc_id", "chunk_index", CONTENT, F.to_json(METADATA).alias("headers"))


@_query()
def json_split_nested(t):
    """Each conversation as nested objects and arrays, far over the size of a chunk."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    value = F.to_json(F.struct(F.struct(F.first("conv_id").alias("id"), turns.alias("turns")).alias("conversation")))
    docs = documents(t("conversations").groupBy("conv_id").agg(value.alias("json")), "conv_id", "json")
    return splitters.split_json(docs, JsonRules(300)).select(F.col("doc_id").alias("conv_id"), "chunk_index", CONTENT)


@_query()
def html_header_split(t):
    out = splitters.split_html(documents(t("pages"), "page_id", "html"), HtmlRules())
    return out.select(F.col("doc_id").alias("page_id"), "chunk_index", CONTENT, F.to_json(METADATA).alias("headers"))


@_query()
def html_markdown(t):
    files = t("pages").select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))
    return readers.read_html(files).select(F.col("doc_id").alias("url"), CONTENT)


@_query("""select event_id, cast(0 as bigint) as chunk_index, '{' || chr(10) || '  "user_id": ' || user_id || ',' || chr(10) || '  "event_type": "' || event_type || '"' || chr(10) || '}' as page_content from events""")
def json_split(t):
    docs = documents(t("events"), "event_id", F.to_json(F.struct("user_id", "event_type")))
    return splitters.split_json(docs, JsonRules(200)).select(F.col("doc_id").alias("event_id"), "chunk_index", CONTENT)


@_query("""with v as (select vec_id, embedding as a, list_transform(embedding, lambda x: x::double) as d from embeddings)
    select vec_id, round(list_dot_product(d, d), 6) as squared, len(a)::bigint as dimensions, round(list_dot_product(d, list_reverse(d)) / list_dot_product(d, d), 6) as reversed_similarity from v""")
def embedding_norms(t):
    e = t("embeddings").withColumn("other", F.reverse("embedding"))
    squared = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return e.select("vec_id", F.round(squared, 6).alias("squared"), F.size("embedding").cast("bigint").alias("dimensions"), F.round(processors.cosine("embedding", "other"), 6).alias("reversed_similarity"))


LETTERS = "aeiou"


def letter_counts(texts: list[str]) -> list[list[float]]:
    """A provider whose vectors SQL can name: how often each vowel is in a text."""
    return [[float(t.count(x)) for x in LETTERS] for t in texts]


@_query("select doc_id, " + " || ',' || ".join(f"(length(text) - length(replace(text, '{x}', '')))" for x in LETTERS) + " as counts from documents")
def embed_batches(t):
    """Every document keeps the vector of its own text, whatever the batches."""
    made = processors.embed(_docs(t), letter_counts, batch=7)
    return made.select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("counts"))


def _calls(t) -> DataFrame:
    return t("events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "event_id", "value", (F.col("event_type") != "error").alias("success"), "event_type")


@_query("""with recursive c as (select user_id, epoch_us(ts) // 1000 as at_ms, event_id, row_number() over (partition by user_id order by epoch_us(ts) // 1000, event_id) as n from events),
    r as (select user_id, at_ms, event_id, n, at_ms as began, 1 as used, true as allowed from c where n = 1
    union all select c.user_id, c.at_ms, c.event_id, c.n, case when c.at_ms >= r.began + 86400000 then c.at_ms else r.began end,
        case when c.at_ms >= r.began + 86400000 then 1 when r.used < 2 then r.used + 1 else r.used end, c.at_ms >= r.began + 86400000 or r.used < 2 from r join c on c.user_id = r.user_id and c.n = r.n + 1)
    select user_id, at_ms, event_id, allowed, cast(case when allowed then 2 - used else 0 end as bigint) as remaining from r""")
def rate_limit_fixed(t):
    return state.rate_limit(_calls(t), "user_id", "at_ms", "event_id", algorithm="fixed-window", limit=2, window_ms=86_400_000)


@_query()
def rate_limit_sliding(t):
    return state.rate_limit(_calls(t), "user_id", "at_ms", "event_id", limit=2, window_ms=86_400_000)


@_query("""with recursive c as (select user_id, epoch_us(ts) // 1000 as at_ms, event_id, row_number() over (partition by user_id order by epoch_us(ts) // 1000, event_id) as n from events),
    r as (select user_id, at_ms, event_id, n, cast(2.0 as double) as tokens, true as allowed from c where n = 1
    union all select c.user_id, c.at_ms, c.event_id, c.n, least(3.0, case when r.allowed then r.tokens else r.tokens end + (c.at_ms - r.at_ms) / 1000.0 * 0.00001) - case when least(3.0, r.tokens + (c.at_ms - r.at_ms) / 1000.0 * 0.00001) >= 1 then 1 else 0 end,
        least(3.0, r.tokens + (c.at_ms - r.at_ms) / 1000.0 * 0.00001) >= 1 from r join c on c.user_id = r.user_id and c.n = r.n + 1)
    select user_id, at_ms, event_id, allowed, cast(case when allowed then floor(tokens) else 0 end as bigint) as remaining from r""")
def rate_limit_bucket(t):
    return state.rate_limit(_calls(t), "user_id", "at_ms", "event_id", algorithm="token-bucket", capacity=3, refill=0.00001)


@_query()
def circuit_breaker(t):
    return state.circuit_breaker(_calls(t), "user_id", "at_ms", "event_id", "success", "value", failures=2, reset_ms=86_400_000, minimum=5)


@_query()
def cache_lru(t):
    return state.cache_replay(_calls(t), "user_id", "at_ms", "event_id", "event_type", size=2, ttl_ms=10 * 86_400_000)
