"""One query for every corpus operator, over the whole of its table, and SQL where it can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import chat, decontaminate, language_id, lexical_search, line_dedup, near_dup, pii, quality, sentencepiece_codec, token_alignment, token_counts, toxicity, url_filter
from scriptorium.llm.common import fold, table, work_table


def tokenizer_path(name: str) -> str:
    """A public tokenizer file; SCRIPTORIUM_TOKENIZERS names another folder for them."""
    folder = os.environ.get("SCRIPTORIUM_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs.filter(~held_out))
    return language_id.identify_language(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_spans(pii.find_pii(table(spark, sf_dir, "documents")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    scored = toxicity.score_toxicity(docs.select("doc_id", held_out.alias("held_out"), "text"), model, with_hits=False)
    return scored.drop("text")


#: A conversation whose texts hold the template's own marks.
HOSTILE = r"\### Assistant: </turn> ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    hostile = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(HOSTILE).alias("text"))
    return chat.digest_examples(chat.format_conversations(turns.unionByName(hostile)))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"), with_ids=False).drop("text")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json")).drop("text")


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = work_table(quality.measure_documents(docs).drop("text"), "quality-measures")
    return quality.judge(measured).select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = token_alignment.align_documents(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("alignment") == "", "").otherwise(F.sha2(F.col("alignment"), 256))
    rated = token_alignment.rate_links(aligned.select("doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "link_a", "link_b", "link_times"))
    return rated.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES).drop("url")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_pii, op3_decontaminate, op4_line_dedup, op5_toxicity, op6_chat, op7_sentencepiece, op8_token_counts, op9_near_dup, op10_quality, op11_lexical_search, op12_token_alignment, op13_url_filter)}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[\x20\x09-\x0D]+"


def _words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_SPACE}'), lambda x: x <> '')"


def _shingles_sql(table_name: str, key: str, size: int) -> str:
    """Rows (key, s) of the distinct runs of ``size`` words, or of all words if they are fewer."""
    return f"""(select distinct {key}, array_to_string(w[i : i + {size} - 1], ' ') as s from (select {key}, w, unnest(range(1, greatest(2, len(w) - {size} + 2))) as i
        from (select {key}, {_words_sql(f"coalesce({_LOWER}, '')")} as w from {table_name}) where len(w) > 0))"""


def _terms_sql() -> str:
    return rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"


def _url_sql() -> str:
    """The rounds written out one after the other, each of them a materialised table."""
    fits = " union all ".join(f"select page, {len(h + p)} as size, {len(h)} as host_size, '{k}' as verdict, '{h + p}' as rule from u where (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for k, h, p in URL_RULES)
    back, damping, unit = 100 - url_filter.DAMPING, url_filter.DAMPING, url_filter.UNIT
    href = url_filter.LINK.replace("'", "''")
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rounds = "".join(
        f""", m{k} as materialized (select host, kind, cast(sum(mass) as bigint) as mass from (select to_host as host, kind, mass // 100 * {damping} // total * n as mass from moves join m{k - 1} using (kind, host) union all select * from m0) group by all having sum(mass) > 0)"""
        for k in range(1, url_filter.ROUNDS + 1)
    )
    return rf"""with r as materialized (select row_number() over () as page, page_id, html, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
        u as materialized (select page, page_id, coalesce({lower("regexp_extract(rest, '^[^/?#]*', 0)")}, '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from r),
        fits as ({fits}), best as materialized (select page, verdict, rule from fits qualify row_number() over (partition by page order by size desc, host_size desc, verdict desc) = 1),
        seeds as (select host, {unit} * count(*) filter (verdict = 'allow') // count(*) as trust, {unit} * count(*) filter (verdict = 'block') // count(*) as distrust from u left join best using (page) where host <> '' group by 1),
        l as (select distinct page, host as src, {lower("unnest(regexp_extract_all(html, '" + href + "', 1))")} as dst from r join u using (page)),
        e as materialized (select *, cast(sum(n) over (partition by src) as bigint) as total from (select src, dst, count(*) as n from l where src <> '' and dst <> '' and src <> dst group by all)),
        moves as materialized (select 't' as kind, src as host, dst as to_host, n, total from e union all select 'd', dst, src, n, total from e),
        m0 as materialized (select host, kind, mass from (select host, 't' as kind, trust // 100 * {back} as mass from seeds union all select host, 'd', distrust // 100 * {back} from seeds) where mass > 0){rounds},
        bad as (select host from m{url_filter.ROUNDS} group by 1 having coalesce(sum(mass) filter (kind = 'd'), 0) > coalesce(sum(mass) filter (kind = 't'), 0) and coalesce(sum(mass) filter (kind = 'd'), 0) >= {url_filter.LEAST_DISTRUST})
        select page_id, host, path, rule, coalesce(verdict, case when host in (select host from bad) then 'block' else 'allow' end) as verdict from u left join best using (page)"""


ORACLE_SQL: dict[str, str] = {
    # Items of fewer than five words, which the tables don't have, would need runs of other lengths.
    "op3_decontaminate": f"""with i as {_shingles_sql("benchmark", "item_id", 5)}, d as {_shingles_sql("documents", "doc_id", 5)}, n as (select item_id, count(*) as n_shingles from i group by 1)
        select doc_id, item_id, n_held, n_shingles, n_held / n_shingles::double as containment from (select doc_id, item_id, count(*) as n_held from d join i using (s) group by all) join n using (item_id) where 100 * n_held >= 80 * n_shingles""",
    "op4_line_dedup": rf"""with l as (select doc_id, i, line, regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^{_SPACE}|{_SPACE}$', '', 'g') as key
        from (select doc_id, unnest(range(1, len(p) + 1)) as i, unnest(p) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as p from documents))),
        k as (select key, min(doc_id) as keeper from l where length(key) >= 10 group by key having count(distinct doc_id) >= 2)
        select doc_id, count(*) as n_lines, count(*) filter (keeper <> doc_id) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (keeper is null or keeper = doc_id), '')) as kept_sha256 from l left join k using (key) group by doc_id""",
    "op6_chat": r"""with c as (select conv_id, case when conv_id is null then row_number() over () else 0 end as part, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, t, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(t, r)),
        e as (select *, row_number() over w as n, count(*) over (partition by conv_id, part) as total, 15 + length(role) + length(text) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(regexp_replace(text, '[^\\#<]', '', 'g')) as size from c window w as (partition by conv_id, part order by turn, role, text)),
        s as (select *, sum(size) over (partition by conv_id, part order by n) as upto from e)
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256, cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
        sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(upto) filter (role = 'assistant' or n = total) as bigint) as formatted_chars from s group by conv_id, part""",
    "op9_near_dup": f"""with recursive d as {_shingles_sql("documents", "doc_id", 3)}, n as (select doc_id, count(*) as n_shingles from d group by 1),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from d a join d b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
        e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n_shingles + y.n_shingles - shared)),
        r(doc_id, reached) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on r.reached = e.a)
        select doc_id, coalesce(n_shingles, 0) as n_shingles, component_id, doc_id = component_id as kept from (select doc_id, min(reached) as component_id from r group by 1) left join n using (doc_id)""",
    "op10_quality": rf"""with t as (select doc_id, source, coalesce(text, '') as text from documents), w as (select doc_id, source, text, {_words_sql("text")} as w from t),
        tri as (select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
        rep as (select doc_id, count(distinct i + k) as n from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as times from tri), (values (0), (1), (2)) v(k) where times > 1 group by 1),
        dup as (select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from t) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
        m as (select doc_id, source, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dup.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words
            from w left join dup using (doc_id) left join rep using (doc_id)),
        f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, n_words < 50 or 100 * n_repeat_words > 50 * n_words or 100 * n_symbols > 10 * word_chars as failed from m),
        h as (select source, count(*) as n, sum(failed::int) as bad from f where source is not null group by 1),
        q as (select avg(bad / n::double) as mean, avg((bad / n::double) * (bad / n::double)) as square from h),
        z as (select mean, case when square - mean * mean > 1e-12 then least(greatest(mean * (1 - mean) / (square - mean * mean) - 1, 1.0), 1e6) else 1e6 end as weight from q),
        v as (select source, (bad + mean * weight) / (n + weight) <= 0.5 as good from h, z)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(good, true) as kept from f left join v using (source)""",
    "op11_lexical_search": rf"""with d as (select row_number() over () as row, doc_id, {_terms_sql()} as t from documents), i as (select row_number() over () as item, item_id, {_terms_sql()} as t from benchmark),
        z as (select count(*) filter (len(t) > 0) as docs, cast(sum(len(t)) as bigint) as length from d),
        p as (select row, doc_id, n, term, count(*) as tf from (select row, doc_id, len(t) as n, unnest(t) as term from d) group by all),
        w as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)::double)) as bigint) as w from (select term, count(*) as df from p group by 1), z),
        s as (select item, item_id, row, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length)))) as bigint) as score
            from (select distinct item, item_id, unnest(t) as term from i) join w using (term) join p using (term), z group by all)
        select item_id, cast(row_number() over (partition by item order by score desc, doc_id nulls last, row) as integer) as rank, doc_id, score from s where score > 0 qualify rank <= {lexical_search.HITS}""",
    "op13_url_filter": _url_sql(),
}
