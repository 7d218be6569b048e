"""URL filters: path rules first, then trust and distrust that spread over the links between hosts.

A host starts with trust by the share of its pages that a rule allows, and with distrust by
the share that one blocks. Trust follows links (personalised PageRank from the trusted
hosts), distrust goes against them, to those who link to blocked hosts. What no rule judges
gets the verdict of its host. All masses are whole numbers, so the order of sums, and with
it the number of partitions, changes nothing.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import add_fields, broadcast_if_small, unused, work_table

#: What a host gets in every round if all its pages are allowed (or blocked), and how much of its mass passes on over links, in percent.
UNIT, DAMPING = 1_000_000_000, 85
ROUNDS = 10
#: A host is blocked if its distrust exceeds its trust and half of what a wholly blocked host starts with.
LEAST_DISTRUST = UNIT * (100 - DAMPING) // 100 // 2
#: The host of a link with a host: any href, of http, https or no scheme.
LINK = r"""[\x20\x09-\x0D"'/][Hh][Rr][Ee][Ff][\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?[\x20\x09-\x0D]*(?:[Hh][Tt][Tt][Pp][Ss]?:)?//([^/?#"'<>\\\x20\x09-\x0D]*)"""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, then up to ``?``, ``#`` or the end; else both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The struct (size, host_size, block, rule) of the longest rule that fits, or null.

    ``rules`` are (allow or block, host, start of the path); of rules of one length the longer host counts, then block.
    """
    by_host: dict[str, list[tuple[str, bool]]] = defaultdict(list)
    for kind, at, start in rules:
        if kind not in ("allow", "block"):
            raise ValueError(f"a rule is allow or block, not {kind}")
        by_host[at].append((start, kind == "block"))
    if not by_host:
        return F.lit(None).cast("struct<size:int,host_size:int,block:boolean,rule:string>")

    def entry(at: str, start: str, block: bool) -> Column:
        text = at + start
        return F.struct(F.lit(len(text)).alias("size"), F.lit(len(at)).alias("host_size"), F.lit(block).alias("block"), F.lit(text).alias("rule"), F.lit(start).alias("start"))

    held = F.create_map(*[x for at, found in by_host.items() for x in (F.lit(at), F.array(*[entry(at, *f) for f in found]))])
    labels = sorted({at.count(".") + 1 for at in by_host})
    # The host itself and its parents, as far as rules name any; a host of fewer labels gives itself again.
    none = F.filter(held[next(iter(by_host))], lambda _: F.lit(False))
    fitting = [F.coalesce(held[F.substring_index(host, ".", -k)], none) for k in labels]
    best = F.array_max(F.filter(F.concat(*fitting), lambda r: F.startswith(path, r["start"])))
    return F.when(best.isNotNull(), F.struct(best["size"].alias("size"), best["host_size"].alias("host_size"), best["block"].alias("block"), best["rule"].alias("rule")))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): pages of a host that link to another host."""
    host, _ = url_parts(F.col("url"))
    targets = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lower_ascii))
    found = pages.select(host.alias("src"), F.explode(targets).alias("dst"))
    return found.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, kind, mass) after ``rounds`` of propagation; ``seeds`` has (host, trust, distrust) as parts of UNIT.

    kind t (trust) goes along the links (src, dst, n), kind d (distrust) against them, both
    weighted by the part that n is of all links of src: a host shares its trust among those it links to,
    and takes on the distrust of the hosts it links to by their parts, however many others
    do so too. Each round is a written table with at most two rows a host.
    """
    share = lambda c: F.expr(f"{c} div 100 * {100 - DAMPING}")
    start = seeds.select("host", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), share(c).alias("mass")) for k, c in (("t", "trust"), ("d", "distrust"))])).alias("x"))
    start = work_table(start.select("host", "x.*").filter("mass > 0"), "restarts")
    totals = links.groupBy("src").agg(F.sum("n").alias("total"))
    way = lambda k, host, to: F.struct(F.lit(k).alias("kind"), F.col(host).alias("host"), F.col(to).alias("to"), "n", "total")
    moves = work_table(links.join(totals, "src").select(F.explode(F.array(way("t", "src", "dst"), way("d", "dst", "src"))).alias("x")).select("x.*"), "moves")
    mass = start
    if moves.isEmpty():  # then every round gives the same
        return mass
    for _ in range(rounds):
        passed = moves.join(mass, ["kind", "host"]).select(F.col("to").alias("host"), "kind", F.expr(f"mass div 100 * {DAMPING} div total * n").alias("mass"))
        mass = work_table(passed.unionByName(start).groupBy("host", "kind").agg(F.sum("mass").alias("mass")).filter("mass > 0"), "masses")
    return mass


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``pages`` without html, with host, path, rule and verdict (columns of those names are replaced).

    ``rules`` are (``allow`` or ``block``, host, start of the path) and go into the plan, so
    they are a list of some thousands at most. A rule fits its host and all its subdomains; the
    longest rule that fits gives rule and verdict. Where none fits, rule is null and the
    verdict is that of the host: block where distrust exceeds both trust and LEAST_DISTRUST,
    else allow. Defined cases: a null url, or one without ``://``, has an empty host and path,
    no links, and is allowed; a null html has no links; links within a host don't count, nor
    does a second link of a page to a host; links to hosts without pages do; repeated rows are
    judged each and count each; of rules of equal length the one with the longer host wins,
    then block; an empty table stays empty.
    """
    host, path = url_parts(F.col("url"))
    known = pages.select(F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    fits = known.select("host", longest_rule(F.col("host"), F.col("path"), rules)["block"].alias("block"))
    share = lambda x: F.expr(f"{UNIT} * sum({x}) div count(*)")
    # A page that no rule judges gives neither: it counts in the number of pages only.
    seeds = fits.filter("host <> ''").groupBy("host").agg(share("if(not block, 1L, 0L)").alias("trust"), share("if(block, 1L, 0L)").alias("distrust"))
    mass = spread(seeds, host_links(pages))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0))
    bad = mass.groupBy("host").agg(of("t").alias("trust"), of("d").alias("distrust")).filter(f"distrust > trust and distrust >= {LEAST_DISTRUST}")
    mark = unused("bad_host", pages)
    bad = broadcast_if_small(work_table(bad.select(F.col("host").alias(mark)), "blocked-hosts"))
    kept = [c for c in pages.columns if c.lower() != "html"]
    best = longest_rule(host, path, rules)
    made = add_fields(pages.select(*[F.col(f"`{c}`") for c in kept]), F.struct(F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), best["rule"].alias("rule"), F.when(best["block"], "block").when(~best["block"], "allow").alias("verdict")), ["host", "path", "rule", "verdict"])
    judged = made.join(bad, F.col("host") == F.col(mark), "left")
    return judged.withColumn("verdict", F.coalesce("verdict", F.when(F.col(mark).isNotNull(), "block").otherwise("allow"))).drop(mark)
