"""URL filters: pattern rules behind an index of their rarest literal tokens.

A rule is a pattern over the lower-cased URL, or a host with a path prefix.  Both
become regular expressions.  A token is a run of ASCII letters and digits and of
other code points; the tokens that every URL met by a rule must hold whole are
known from the rule's text alone.  Each rule is filed under the one of them that
the fewest URLs hold, rules without any under the empty token.  A URL looks up its
own tokens and the empty one, and only the rules found run their expressions.

The index is an array of buckets of the tokens' hashes.  It reaches the scan as the
value of a scalar subquery, so a URL is judged where it is read: nothing is joined,
shuffled or grouped, whatever URL or host a third of the rows share.  Beyond
``INDEX_RULES`` rules the index stays a table and is joined with the URLs' tokens.

Patterns: ``*`` is any run of characters; ``^`` any character that is no part of a
token, or an end of the URL; ``||`` at the beginning a host or the end of a label
of it; ``|`` at either end that end of the URL.  All else stands for itself, A to Z
as a to z.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtflow.llm.tables import keep

#: Rules up to which the index is one value of a few megabytes (rules of up to ``RULE_CHARS`` characters in the mean).
INDEX_RULES, RULE_CHARS = 20_000, 200
#: Shares that a token's rules and URLs are split into where the index is joined.
SALT = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of tokens, for use inside brackets and after a circumflex.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
EDGE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
RULE = "struct<entry:string,kind:string,verdict:string,rule:string,regex:string,rank:struct<level:int,chars:int,host:int,block:int,rule:string>>"


def lower(text: Column) -> Column:
    """A to Z lower-cased, nothing else."""
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"{TOKEN}+"), 0))


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.\[\](){}?+*^$|])", r"\\$1")


def _replacement(text: str) -> str:
    """``text`` as the replacement of a regular expression."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def site_rules(rules: DataFrame) -> DataFrame:
    """Compile rules of columns host, path and verdict (allow or block).

    Rules that no URL can meet are left out: without a host, with a host that holds
    ``/``, ``?`` or ``#``, or with a path that does not begin with ``/``.  A rule fits
    its host and the hosts below it, if the path begins with the rule's.  The longest rule that fits decides, by characters of host and path; of
    equally long ones the longer host, then block, then the greater text.
    """
    fit = F.col("host").rlike(r"\A[^/?#]+\z") & F.coalesce(F.col("path").rlike(r"\A(?:/[^?#]*)?\z"), F.lit(True)) & F.col("verdict").isin("allow", "block")
    known = rules.where(fit).select(
        lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).distinct()
    whole = F.concat("host", "path")
    # What ends the path part of a rule may go on in the URL, so its last token need not be whole.
    literal = F.concat(F.lit(" "), F.col("host"), F.lit(" "), F.regexp_replace(lower(F.col("path")), f"{TOKEN}+\\z", ""))
    regex = F.concat(F.lit(r"\A(?:[^/]*\.)?"), _escaped(F.col("host")), F.when(F.col("path") == "", F.lit(r"(?=/|\z)")).otherwise(_escaped(F.col("path"))))
    rank = F.struct(
        F.lit(1).alias("level"), F.length(whole).alias("chars"), F.length("host").alias("host"), (F.col("verdict") == "block").cast("int").alias("block"), whole.alias("rule")
    )
    return known.select(F.lit("site").alias("kind"), "verdict", whole.alias("rule"), regex.alias("regex"), rank.alias("rank"), tokens(literal).alias("literals"))


def pattern_rules(rules: DataFrame) -> DataFrame:
    """Compile rules of columns pattern and verdict; an allowing pattern overrides all blocking ones that fit."""
    known = rules.where("pattern <> '' AND verdict IN ('allow', 'block')").select(lower(F.col("pattern")).alias("pattern"), "verdict").distinct()
    p = F.col("pattern")
    domain, front, back = p.startswith("||"), p.startswith("|"), p.endswith("|") & (F.length(p) > 1)
    inner = F.regexp_replace(F.regexp_replace(p, r"\A\|\|?", ""), r"\|\z", "")
    body = F.regexp_replace(F.regexp_replace(_escaped(inner), r"\\\*", ".*"), r"\\\^", _replacement(f"(?:{EDGE}|\\A|\\z)"))
    regex = F.concat(
        F.lit("(?s)"), F.when(domain, F.lit(r"\A[^/?#]*?://(?:[^/?#]*\.)?")).when(front, F.lit(r"\A")).otherwise(F.lit("")), body, F.when(back, F.lit(r"\z")).otherwise(F.lit(""))
    )
    # A run of token characters is whole where both neighbours are literal and no part of tokens, or anchors.
    open_front = F.when(domain | front, F.lit(" ")).otherwise(F.lit("*"))
    framed = F.concat(open_front, inner, F.when(back, F.lit(" ")).otherwise(F.lit("*")))
    cut = F.regexp_replace(F.regexp_replace(framed, rf"{TOKEN}*\*+{TOKEN}*", " "), r"\^", " ")
    rank = F.struct(
        F.lit(0).alias("level"), (F.col("verdict") == "allow").cast("int").alias("chars"), F.lit(0).alias("host"), F.lit(0).alias("block"), p.alias("rule")
    )
    return known.select(F.lit("pattern").alias("kind"), "verdict", p.alias("rule"), regex.alias("regex"), rank.alias("rank"), tokens(cut).alias("literals"))


def filed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with ``entry``, the literal token that the fewest URLs hold; ties go to the least token."""
    wanted = rules.select(F.explode("literals").alias("token")).distinct()
    seen = urls.select(F.explode(tokens(lower(F.coalesce("url", F.lit(""))))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    held = wanted.join(seen, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))
    placed = rules.select("*", F.explode_outer("literals").alias("token")).join(held, "token", "left")
    first = placed.groupBy("kind", "verdict", "rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token"))).alias("least"), F.first("regex").alias("regex"), F.first("rank").alias("rank"))
    return first.select(F.col("least.token").alias("entry"), "kind", "verdict", "rule", "regex", "rank")


def _best(found: Column) -> Column:
    return F.array_max(F.transform(found, lambda r: F.struct(r["rank"].alias("rank"), r["verdict"].alias("verdict"), r["rule"].alias("rule"), r["kind"].alias("kind"))))


def _fits(rule: Column, site: Column, url: Column) -> Column:
    return F.rlike(F.when(rule["kind"] == "site", site).otherwise(url), rule["regex"])


def judge(pages: DataFrame, sites: DataFrame, patterns: DataFrame, default: str = "allow", index_rules: int = INDEX_RULES) -> DataFrame:
    """Every row of ``pages`` with host, path, rule, pattern and verdict.

    ``rule`` is the site rule that decided (host and path) or null, ``pattern`` the
    pattern that decided where no site rule fits, or null; without either the
    verdict is ``default``.  Columns of ``pages`` of these five names are replaced,
    others pass.  Null URLs and URLs without ``://`` have an empty host and path and
    meet no site rule; null ones meet no pattern either.  Empty, repeated and very
    long URLs are judged like others, equal ones alike.  Without pages there are no
    rows; without rules all get ``default``.
    """
    whole = [c for c in pages.columns if c not in ("host", "path", "rule", "pattern", "verdict")]
    rules = keep(filed(pages.select("url"), site_rules(sites).unionByName(pattern_rules(patterns))))
    count, size = rules.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("rule")), F.lit(0))).first()
    host, path = host_and_path(F.col("url"))
    row = F.struct(*whole) if whole else F.struct(F.lit(0).alias("none"))
    parts = pages.select(row.alias("row"), host.alias("host"), path.alias("path"), lower(F.coalesce("url", F.lit(""))).alias("url"), F.col("url").isNotNull().alias("known"))
    parts = parts.withColumn("site", F.concat("host", "path"))
    best = _by_value(parts, rules, count) if count <= index_rules and size <= index_rules * RULE_CHARS else _by_table(parts, rules)
    verdict = F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    named = lambda kind: F.when(F.col("best.kind") == kind, F.col("best.rule")).alias("rule" if kind == "site" else "pattern")
    return best.select(*[F.col("row")[c].alias(c) for c in whole], "host", "path", named("site"), named("pattern"), verdict)


def _by_value(parts: DataFrame, rules: DataFrame, count: int) -> DataFrame:
    """``parts`` with ``best``, looked up in an array of buckets; ``rules`` are few and were counted."""
    if not count:
        return parts.withColumn("best", F.lit(None).cast("struct<verdict:string,rule:string,kind:string>"))
    size = 1 << max(4, count.bit_length())
    spark = parts.sparkSession
    place = lambda token: F.pmod(F.xxhash64(token), F.lit(size))
    buckets = (
        spark.range(size).withColumnRenamed("id", "at")
        .join(rules.select(place(F.col("entry")).alias("at"), F.struct("entry", "kind", "verdict", "rule", "regex", "rank").cast(RULE).alias("one")), "at", "left")
        .groupBy("at").agg(F.collect_list("one").alias("of"))
    )
    # A bucket and all buckets together are bounded by the number of rules.
    index = buckets.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "of"))), lambda b: b["of"]).alias("index")).scalar()
    parts = parts.withColumn("index", index)
    look = lambda token: F.filter(F.element_at("index", (place(token) + 1).cast("int")), lambda r: r["entry"] == token)
    fetched = F.flatten(F.transform(F.array_append(tokens(F.col("url")), F.lit("")), look))
    fitting = F.filter(fetched, lambda r: F.when(F.col("known"), _fits(r, F.col("site"), F.col("url"))).otherwise(False))
    return parts.withColumn("best", _best(fitting)).drop("index")


def _by_table(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by joins: distinct URLs, split into shares, meet the rules of their tokens, and each URL keeps its best rule."""
    urls = parts.where("known").groupBy("site", "url").agg(F.count(F.lit(1)).alias("times"))
    asked = urls.select("site", "url", F.pmod(F.xxhash64("site", "url"), F.lit(SALT)).alias("share"), F.explode(F.array_append(tokens(F.col("url")), F.lit(""))).alias("entry"))
    offered = rules.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    rule = F.struct(*[F.col(c) for c in ("rank", "verdict", "rule", "kind")])
    met = asked.join(offered, ["entry", "share"]).where(F.when(F.col("kind") == "site", F.rlike(F.col("site"), F.col("regex"))).otherwise(F.rlike(F.col("url"), F.col("regex"))))
    best = met.groupBy("site", "url").agg(F.max(rule).alias("best"))
    # A URL that many rows share is split too: its rows draw shares, its rule stands in each.
    drawn = parts.withColumn("share", F.pmod(F.xxhash64("row"), F.lit(SALT)))
    spread = best.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    return drawn.join(spread, ["site", "url", "share"], "left")


def rules_table(spark: SparkSession, columns: str, rules: Iterable[tuple]) -> DataFrame:
    """A table of rules from tuples of strings, for lists that stand in code."""
    names = [c.split()[0] for c in columns.split(",")]
    rows = [F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, r, strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))
