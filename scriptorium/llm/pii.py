"""Personal data by patterns and by bootstrapped context, in DataFrame operations only.

Regular expressions find the seeds: addresses, IPs, cards and phones, and what has the form
of a secret. The words around seeds make lexical patterns. Patterns and the identifiers
they surround form a graph, on which confidence flows from the seeds to patterns and from
patterns to identifiers that no expression knows, a few rounds; patterns that end up sure
enough mark such identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import work_table

KINDS = ("email", "ip", "card", "phone")
#: Expressions of the kinds. Possessive repeats and look-behinds keep them linear on long runs;
#: \G lets a match begin right where the one before it has ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What could be an identifier: a run of digit groups with blanks, dots, dashes and brackets between
#: them that no letters go on, or a run of letters, digits and joining signs with a digit, an @ or an (at) in it or behind its
#: letters. The look-ahead begins only where a run does, so that every letter is looked at once.
PATTERNS["candidate"] = (
    r"(?<![A-Za-z0-9_@.+:/-])(?:[+(]?[0-9](?:[0-9().\x20-]*[0-9])?(?![A-Za-z0-9_@]|[.+:/-]++[A-Za-z])"
    r"|(?=[A-Za-z_.+:/-]*+(?:[0-9@]|[(\[]at[)\]]))[A-Za-z0-9](?:[A-Za-z0-9_@.+:/()\[\]-]*[A-Za-z0-9])?)"
)
#: What must be in a text for the expression to be worth a try.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]", "candidate": r"[0-9@]|[(\[]at[)\]]"}
#: A candidate that makes a seed by its form alone: 16 letters and digits or more with three of each at least, or a public key format.
SECRET = r"^(?:(?=(?:[^0-9]*+[0-9]){3})(?=(?:[^A-Za-z]*+[A-Za-z]){3})[A-Za-z0-9]{16,}|AKIA[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36,})$"
#: Code points of context on either side of a span, up to the next match of its kind; a word that goes on beyond them is no context.
LEFT, RIGHT = 80, 40
#: Patterns by type: two words before; one before that a mark ties to the slot; one before and one after.
#: What stands further away than these numbers of signs that are no letters, in a table, say, isn't taken for context.
CONTEXTS = {
    "before": (r"(\p{L}+[^\p{L}]{1,8}\p{L}+[^\p{L}]{0,6})$", None),
    "label": (r"(\p{L}+[^\p{L}]{0,4}[=:#][^\p{L}]{0,4})$", None),
    "around": (r"(\p{L}+[^\p{L}]{0,6})$", r"^([^\p{L}]{0,6}\p{L}+)"),
}
SPAN = "array<struct<kind:string,start:long,end:long,value:string>>"
ROUNDS = 3
#: A pattern counts if so many of its values, and such a share of them, are seeds of one kind or have
#: the confidence, and marks identifiers if its own confidence is so high.
LEAST_SEEDS, LEAST_SHARE, LEAST_CONFIDENCE = 3, 0.05, 0.7


def digits_of(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """SQL that tells whether a digit string passes Luhn's check."""
    doubled = f"""transform(split(reverse({digits}), ''), (d, i) -> if(i % 2 = 0, int(d), if(int(d) > 4, 2 * int(d) - 9, 2 * int(d))))"""
    return f"aggregate({doubled}, 0, (s, d) -> s + d) % 10 = 0"


VALID = {
    "email": "true",
    "ip": r"forall(split(value, '[.]'), p -> length(ltrim('0', p)) < 3 or length(ltrim('0', p)) = 3 and int(ltrim('0', p)) <= 255)",
    "card": f"length({digits_of('value')}) between 12 and 19 and {luhn(digits_of('value'))}",
    "phone": f"length({digits_of('value')}) between 9 and 15",
    "candidate": "true",
}


def matches(kind: str) -> Column:
    """The kind's matches in ``text``, leftmost first and apart: number, code points before it since the last one, value, context."""
    p = f"r'{PATTERNS[kind]}'"
    values, between = f"regexp_extract_all(text, {p}, 0)", f"split(text, {p}, -1)"
    pairs = f"zip_with({values}, {between}, (v, b) -> named_struct('v', v, 'b', b))"
    left = rf"if(length(y.x.b) > {LEFT}, regexp_replace(substring(y.x.b, -{LEFT + 1}, {LEFT + 1}), r'^\p{{L}}+', ''), y.x.b)"
    right = rf"if(length(y.a) > {RIGHT}, regexp_replace(substring(y.a, 1, {RIGHT + 1}), r'\p{{L}}+$', ''), y.a)"
    found = F.expr(f"""filter(transform(zip_with({pairs}, slice({between}, 2, size({between})), (x, a) -> named_struct('x', x, 'a', a)), (y, i) -> named_struct(
        'kind', '{kind}', 'at', i, 'gap', length(y.x.b), 'value', y.x.v, 'left', {left}, 'right', {right})), z -> z.value is not null)""")
    return F.when(F.col("text").rlike(HINTS[kind]), found)


def placed(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, value, left, right): the valid base spans, and the candidates that touch none.

    ``found`` has row and matches. Places are running sums over a text's matches, one row
    each, so that a text of many identifiers takes time and memory in proportion.
    """
    each = found.select("row", F.explode("matches").alias("m")).select("row", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum((F.col("gap") + F.length("value")).cast("long")).over(upto))
    valid = F.expr("case kind " + " ".join(f"when '{k}' then {v}" for k, v in VALID.items()) + " end")
    each = each.withColumn("start", F.col("end") - F.length("value")).filter(valid)
    base = F.col("kind") != "candidate"
    before = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("before", F.max(F.when(base, F.col("end"))).over(before)).withColumn("after", F.min(F.when(base, F.col("start"))).over(after))
    touched = (F.coalesce("before", F.lit(-1)) > F.col("start")) | (F.coalesce("after", F.col("end")) < F.col("end"))
    return each.filter(base | ~touched).select("row", "kind", "start", "end", "value", "left", "right")


def patterns_of(spans: DataFrame) -> DataFrame:
    """One row for every span and each of its patterns: (row, kind, start, end, value, type, pattern).

    Kind is null for a candidate; one that has the form of a secret has the kind ``secret``.
    """

    def plain(side: str) -> Column:
        return F.regexp_replace(F.regexp_replace(F.lower(side), r"[\x20\x09-\x0D]+", " "), "[0-9]", "9")

    def context(name: str) -> Column:
        left, right = CONTEXTS[name]
        before = F.regexp_extract(plain("left"), left, 1)
        after = F.regexp_extract(plain("right"), right, 1) if right else F.lit("")
        whole = (before != "") & (after != "") if right else before != ""
        return F.when(whole, F.struct(F.lit(name).alias("type"), F.concat(before, F.lit("_"), after).alias("pattern")))

    kind = F.when(F.col("kind") != "candidate", F.col("kind")).when(F.col("value").rlike(SECRET), "secret")
    contexts = F.array_compact(F.array(*map(context, CONTEXTS)))
    return spans.select("row", kind.alias("kind"), "start", "end", F.lower("value").alias("value"), F.explode_outer(contexts).alias("c")).select("row", "kind", "start", "end", "value", "c.*")


def trusted_patterns(mentions: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that are sure enough.

    A pattern stands for the kind of most of its seeds. Its confidence is the sum of that
    of its different values of this kind, divided by one more than the number of all of
    them, so values of other kinds and of none count against it. A seed's confidence is 1;
    another value's is one minus the product of what the surest patterns of each type lack
    that surround it. Patterns take part once LEAST_SEEDS of their values, and LEAST_SHARE
    of them, are seeds of the kind or have LEAST_CONFIDENCE, so values found in one round
    make patterns of the next. Sums over values grow with a pattern's use, so they are made
    by grouping with partial sums, never by gathering a pattern's values.
    """
    edges = mentions.filter("pattern is not null").groupBy("pattern", "type", "value").agg(F.min("kind").alias("seed"))
    edges = work_table(edges, "pattern-graph")
    # A pattern of fewer values never gets the support it needs.
    useful = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_SEEDS).select("pattern")
    edges = work_table(edges.join(useful, "pattern", "left_semi"), "useful-patterns")
    known = edges.withColumn("kind", F.col("seed")).withColumn("confidence", F.col("seed").isNotNull().cast("double"))
    for k in range(rounds):
        flow = edges.filter("seed is null").select("pattern", "type", "value").join(_supported(known), "pattern")
        surest = flow.groupBy("value", "type").agg(F.max(F.struct("confidence", "pattern", "kind")).alias("m"))
        lacking = surest.groupBy("value").agg(F.sum(F.log(1 - F.col("m.confidence"))).alias("lack"), F.max("m").alias("m")).select("value", "lack", F.col("m.kind").alias("given"))
        confidence = F.when(F.col("seed").isNotNull(), 1.0).otherwise(1 - F.exp(F.coalesce("lack", F.lit(0.0))))
        known = edges.join(lacking, "value", "left").select("pattern", "type", "value", "seed", F.coalesce("seed", "given").alias("kind"), confidence.alias("confidence"))
        known = work_table(known, f"confidence-{k}")
    return _supported(known).filter(F.col("confidence") >= LEAST_CONFIDENCE)


def _supported(known: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of the patterns with enough seeds and confident values of their kind; kinds go by seeds, then by such values, then by name."""
    sure = (F.col("confidence") >= LEAST_CONFIDENCE).cast("long")
    parts = known.groupBy("pattern", "kind").agg(F.count("seed").alias("seeds"), F.sum(sure).alias("support"), F.sum("confidence").alias("total"), F.count(F.lit(1)).alias("n"))
    best = F.max(F.when(F.col("kind").isNotNull(), F.struct("seeds", "support", "kind", "total")))
    out = parts.groupBy("pattern").agg(best.alias("best"), F.sum("n").alias("n"))
    enough = (F.col("best.support") >= LEAST_SEEDS) & (F.col("best.support") >= LEAST_SHARE * F.col("n"))
    return out.filter(enough).select("pattern", "best.kind", (F.col("best.total") / (F.col("n") + 1)).alias("confidence"))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, base, found) for every row of ``docs``: spans (kind, start, end, value).

    ``docs`` needs doc_id and text; other columns are not read. ``base`` are the valid
    matches of the four expressions. ``found`` are the identifiers that trusted patterns
    mark, whose kind is ``ctx_`` and the surest pattern's kind; values are in lower case. What
    only looks like a secret is a seed and no finding until a trusted pattern surrounds it.
    Places are in code points, end exclusive. A context is what stands up to LEFT code points before and RIGHT
    after a span, without words that go on beyond, in the numbers of signs that CONTEXTS
    names. Defined cases: null text is empty; rows are told apart by their
    place, so doc_id may be null or repeated; an empty table stays empty; equal texts have
    equal spans; what touches a base span is never marked.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = [F.coalesce(matches(k), F.array()) for k in PATTERNS]
    found = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*kinds).alias("matches"))
    found = work_table(found, "pii-matches")
    spans = work_table(placed(found.filter(F.size("matches") > 0)), "pii-spans")
    mentions = work_table(patterns_of(spans), "pii-mentions")
    sure = trusted_patterns(mentions)
    marked = mentions.filter("kind is null or kind = 'secret'").drop("kind").join(sure, "pattern")
    marked = marked.groupBy("row", "start", "end", "value").agg(F.max_by(F.concat(F.lit("ctx_"), "kind"), F.struct("confidence", "pattern")).alias("kind"))
    each = marked.select("row", F.lit(1).alias("part"), "start", "end", "kind", "value").unionByName(spans.filter("kind <> 'candidate'").select("row", F.lit(0).alias("part"), "start", "end", "kind", "value"))
    by_row = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", "start", "end", "kind", "value"))).alias("spans"))
    joined = found.select("row", "doc_id").join(by_row, "row", "left")

    def part(number: int) -> Column:
        chosen = F.expr(f"transform(filter(spans, x -> x.part = {number}), x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'value', x.value))")
        return F.coalesce(chosen, F.array().cast(SPAN))

    return joined.select("doc_id", part(0).alias("base"), part(1).alias("found"))


def digest_spans(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and of what the method adds, and the spans as text, ordered by start, then kind as listed."""
    order = "case x.kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + f" else {len(KINDS)} end"

    def joined(spans: str) -> Column:
        return F.expr(f"array_join(transform(array_sort(transform({spans}, x -> named_struct('s', x.start, 'o', {order}, 'k', x.kind, 'e', x.end))), x -> concat_ws(':', x.k, x.s, x.e)), ',')")

    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    added = [F.size("found").cast("long").alias("n_found"), (F.size("base") + F.size("found")).cast("long").alias("n_spans")]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("concat(base, found)").alias("spans"), *added)
