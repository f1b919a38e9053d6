"""Registered queries of the operators, one module per operator in ``operators``' order, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtflow.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


SHARDS = 24

OP1_SQL = f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, [1::BIGINT,1,1,1,1,1,1,1]),
    lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS tab
), sized AS (
  SELECT doc_id, text, coalesce(strlen(text), 0) + 8 AS size FROM documents
), placed AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS row
  FROM sized
), cut AS (
  SELECT *, least({SHARDS - 1}, ((2 * start + size) * {SHARDS}) // (2 * total))::INT AS shard FROM placed
)
SELECT doc_id, size::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
  'bytes' AS law, shard, (row - min(row) OVER (PARTITION BY shard))::BIGINT AS slot, CAST(NULL AS INT) AS grown_shard
FROM cut, crc_table
"""


@query("op1_sharding", OP1_SQL)
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from courtflow.llm.sharding import shard_by_bytes

    return shard_by_bytes(read(spark, folder, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


OP9_SQL = r"""
WITH rows_ AS (
  SELECT doc_id, coalesce('0' || source, '1') AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || md5(md5(coalesce(doc_id::VARCHAR, '') || '/' || coalesce('0' || source, '1') || '/' || md5(coalesce(text, ''))) || '/' ||
      (row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1))[1:12])::BIGINT AS hash
  FROM documents
), sources AS (
  SELECT key, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY key
), weighted AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY key) - 1) % 3) + 1] AS weight, source_size * 2.0::DOUBLE AS most,
    sum(source_size) OVER () * 1.5::DOUBLE AS goal FROM sources
), ranked AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY most / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM weighted
), marked AS (SELECT *, (goal - before) * weight >= most * rest AS capped FROM ranked
), targets AS (
  SELECT key, source_size, CASE WHEN capped THEN most ELSE
    (goal - coalesce(sum(CASE WHEN capped THEN most END) OVER (), 0)) * weight / nullif(sum(CASE WHEN NOT capped THEN weight END) OVER (), 0) END AS target
  FROM marked
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size)) ELSE 0 END::INT AS passes FROM targets
), cells AS (
  SELECT key, hash, sum(size) AS cell, sum(sum(size)) OVER (PARTITION BY key ORDER BY hash) AS upto FROM rows_ GROUP BY key, hash
), crossing AS (
  SELECT c.key, min(hash) AS hash, arg_min(cell, hash) AS cell, arg_min(upto, hash) AS upto
  FROM cells c JOIN budgets b ON c.key = b.key WHERE upto > target - passes * source_size GROUP BY c.key
), cuts AS (
  SELECT b.*, CASE WHEN passes >= 2 OR target - passes * source_size <= 0 THEN 0 WHEN c.key IS NULL THEN 281474976710656
    ELSE hash + CASE WHEN upto - (target - passes * source_size) < (target - passes * source_size) - (upto - cell) THEN 1 ELSE 0 END END AS below
  FROM budgets b LEFT JOIN crossing c ON b.key = c.key
)
SELECT doc_id, size, source_size, round(target, 6) AS target, (size * (passes + CASE WHEN hash < below THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rows_ r JOIN cuts c ON r.key = c.key
"""


@query("op9_mixing", OP9_SQL)
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from courtflow.llm.mixing import mix_sources

    return mix_sources(read(spark, folder, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP8_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM split
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), shared AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS common
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT x, y FROM shared WHERE 100 * common >= 80 * (nx + ny - common)
), sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links
), reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT s.y, r.root FROM reach r JOIN sym s ON r.node = s.x)
SELECT s.doc_id, len(s.s)::INT AS n_shingles, c.component_id FROM sets s
JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) c ON c.node = s.doc_id
"""


@query("op8_ngram_join", OP8_SQL)
def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    from courtflow.llm.ngram_join import link_components

    return link_components(read(spark, folder, "documents"))


OP4_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM docs WHERE len(h) >= 200)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1
), marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM again
), runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
), spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run
), pieces AS (
  SELECT d.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY d.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY d.doc_id ORDER BY a), 0))) AS piece
  FROM spans s JOIN docs d ON d.doc_id = s.doc_id
), joined AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(piece, '' ORDER BY a) AS kept FROM pieces GROUP BY doc_id
)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM docs d LEFT JOIN joined j ON j.doc_id = d.doc_id
"""


@query("op4_suffix_dedup", OP4_SQL)
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from courtflow.llm.suffix_dedup import remove_repeats

    out = remove_repeats(read(spark, folder, "documents"), with_kept=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)
), found AS (SELECT p.doc_id, item_id, i, p.n FROM places p JOIN windows v ON p.n = v.n AND p.s = v.s
), words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id
), ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words h ON h.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id
"""


@query("op5_decontamination", OP5_SQL)
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from courtflow.llm.decontamination import contamination, items_digest

    out = contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items_digest().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


@query("op2_language_id")
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from courtflow.llm.language_id import identify, learn, remainder

    docs = read(spark, folder, "documents")
    prototypes = learn(docs.where(remainder(3) != 1))
    held = docs.select("doc_id", "text", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"))
    return identify(held, prototypes, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


@query("op6_fingerprints")
def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from courtflow.llm.fingerprints import compare_with_edits

    return compare_with_edits(read(spark, folder, "documents"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from courtflow.llm.language_id import remainder
    from courtflow.llm.toxicity import learn, score

    docs = read(spark, folder, "documents")
    model = learn(docs.select("doc_id", "text"), read(spark, folder, "labels").where(remainder(4) != 2))
    held = docs.select("doc_id", "text", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"))
    return score(held, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


OP3_SQL = """
WITH payloads AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), heads AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS head FROM payloads)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN head END AS refers_to FROM heads
"""


@query("op3_warc", OP3_SQL)
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    from courtflow.llm.warc import archive_and_read

    return archive_and_read(read(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = r"""
WITH split AS (
  SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS lines FROM documents
), flat AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM split
), placed AS (SELECT *, row_number() OVER (ORDER BY doc_id, k) AS pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM flat
), worded AS (SELECT pos, w, len(w) AS n, array_to_string(w, ' ') AS s, min(pos) OVER (PARTITION BY array_to_string(w, ' ')) AS first FROM placed WHERE len(w) > 0
), long AS (SELECT * FROM worded WHERE pos = first AND n >= 5
), variants AS (
  SELECT pos, n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:n]), ' ') AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM long)
), gone AS (
  SELECT pos FROM worded WHERE pos > first
  UNION SELECT pos FROM (SELECT pos, min(pos) OVER (PARTITION BY n, i, v) AS m FROM variants) WHERE pos > m
  UNION SELECT x.pos FROM variants x JOIN long y ON x.v = y.s AND y.pos < x.pos
  UNION SELECT x.pos FROM long x JOIN variants y ON y.v = x.s AND y.pos < x.pos
), kept AS (
  SELECT doc_id, count(g.pos) AS n_removed, string_agg(line, chr(10) ORDER BY k) FILTER (WHERE g.pos IS NULL) AS text
  FROM placed p LEFT JOIN gone g ON g.pos = p.pos GROUP BY doc_id
)
SELECT s.doc_id, len(lines)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id
"""


@query("op10_line_dedup", OP10_SQL)
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from courtflow.llm.line_dedup import remove_similar_lines

    return remove_similar_lines(read(spark, folder, "documents"), with_kept=False)


#: Rules of the registered query: hosts with paths, and patterns for what they leave open.
SITES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
PATTERNS = [
    ("^casino-", "block"), ("^free-bets.", "block"), ("-pills.", "block"), ("^adult-", "block"), ("^spam-farm.", "block"), ("^ads-track.", "block"),
    ("||org^*utm_source=feed|", "block"), ("||example.org/en/*utm_source", "allow"),
]

OP12_SQL = r"""
WITH urls AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages
), judged AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule,
    regexp_matches(u, '(?s)^[^/?#]*?://([^/?#]*\.)?example\.org/en/.*utm_source') AS cleared,
    regexp_matches(u, '(^|[^a-z0-9\x80-\x{10FFFF}])casino-') OR regexp_matches(u, '(^|[^a-z0-9\x80-\x{10FFFF}])free-bets\.') OR contains(u, '-pills.')
      OR regexp_matches(u, '(^|[^a-z0-9\x80-\x{10FFFF}])adult-') OR regexp_matches(u, '(^|[^a-z0-9\x80-\x{10FFFF}])spam-farm\.')
      OR regexp_matches(u, '(^|[^a-z0-9\x80-\x{10FFFF}])ads-track\.')
      OR regexp_matches(u, '(?s)^[^/?#]*?://([^/?#]*\.)?org([^a-z0-9\x80-\x{10FFFF}]|\z).*utm_source=feed\z') AS spam
  FROM urls
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN cleared THEN 'allow' WHEN spam THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


@query("op12_url_filters", OP12_SQL)
def op12_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    from courtflow.llm.url_filters import judge, rules_table

    sites = rules_table(spark, "host string, path string, verdict string", SITES)
    patterns = rules_table(spark, "pattern string, verdict string", PATTERNS)
    return judge(read(spark, folder, "pages").select("page_id", "url"), sites, patterns).select("page_id", "host", "path", "rule", "verdict")


#: Folder of public vocabularies; every machine of the cluster has it.
VOCABULARIES = "/opt/tokenizers"


@query("op13_alignment")
def op13_alignment(spark: SparkSession, folder: str, vocabularies: str = VOCABULARIES) -> DataFrame:
    from courtflow.llm.alignment import align, link_scores

    aligned = align(read(spark, folder, "documents"), f"{vocabularies}/byte_bpe_50k.json", f"{vocabularies}/piece_bpe_32k.model")
    return link_scores(aligned).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


OP11_SQL = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, [1::BIGINT,1,1,1,1,1,1,1]),
    lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS tab
), own AS (
  SELECT conv_id, turn, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d, strlen(coalesce(text, ''))::BIGINT AS b
  FROM conversations WHERE conv_id IS NOT NULL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos FROM own
), heads AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, n,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id), crc_table
), rebuilt AS (
  SELECT h.conv_id, r.pos, r.d, r.b FROM heads h JOIN ranked r ON r.conv_id = h.base AND r.pos <= h.h
  UNION ALL SELECT r.conv_id, least(h.h, coalesce(s.n, 0)) + r.pos - h.h, r.d, r.b FROM ranked r JOIN heads h ON h.conv_id = r.conv_id LEFT JOIN heads s ON s.conv_id = h.base WHERE r.pos > h.h
), steps AS (
  SELECT conv_id, pos AS depth, md5(string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS key, b FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0 FROM heads
), nodes AS (SELECT key, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b FROM steps GROUP BY key
), parents AS (SELECT DISTINCT s.key, p.key AS up FROM steps s JOIN steps p ON p.conv_id = s.conv_id AND p.depth = s.depth - 1
), children AS (SELECT up AS key, count(*) AS n_children FROM parents GROUP BY up
), below AS (SELECT DISTINCT p.key AS top, s.key FROM steps s JOIN steps p ON p.conv_id = s.conv_id AND p.depth <= s.depth
), sums AS (
  SELECT top AS key, count(*) FILTER (WHERE c.key IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.b) AS saved_tokens
  FROM below w JOIN nodes n ON n.key = w.key LEFT JOIN children c ON c.key = w.key GROUP BY top
), ends AS (
  SELECT s.key, string_agg(s.conv_id::VARCHAR, ',' ORDER BY s.conv_id) AS ids FROM steps s
  JOIN (SELECT conv_id, max(depth) AS depth FROM steps GROUP BY conv_id) m ON m.conv_id = s.conv_id AND m.depth = s.depth GROUP BY s.key
)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.key = n.key LEFT JOIN children c ON c.key = n.key LEFT JOIN ends e ON e.key = n.key LEFT JOIN parents p ON p.key = n.key LEFT JOIN nodes u ON u.key = p.up
"""


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """Conversations as op11 rebuilds them: the first h turns of conversation c - c % 5, then c's own after its first h; h is crc32(c) % 9.

    Every conversation also gets a row without digest at place 0, as it may be left without turns.
    """
    from pyspark.sql import Window

    family, most = F.col("conv_id") - F.col("conv_id") % 5, 8
    head = lambda conv: F.crc32(conv.cast("string").cast("binary")) % 9
    whole = Window.partitionBy("family")  # the at most nine conversations that borrow from one
    rows = (
        turns.withColumn("family", family)
        .withColumn("pos", F.row_number().over(Window.partitionBy("family", "conv_id").orderBy(F.asc_nulls_first("turn"), "digest")).cast("long"))
        .withColumn("lent", F.least(F.count(F.when(F.col("conv_id") == F.col("family"), 1)).over(whole), F.lit(most)))
        .withColumn("members", F.collect_set("conv_id").over(whole))
    )
    one = lambda conv, turn, digest, size: F.struct(conv.alias("conv_id"), turn.alias("turn"), digest.alias("digest"), size.alias("n_bytes"))
    here = (F.col("digest"), F.col("n_bytes"))
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<struct<conv_id:bigint,turn:bigint,digest:binary,n_bytes:bigint>>")
    marked = F.when(F.col("pos") == 1, F.array(one(F.col("conv_id"), zero, F.lit(None).cast("binary"), zero))).otherwise(none)
    h = head(F.col("conv_id"))
    kept = F.when(F.col("pos") > h, F.array(one(F.col("conv_id"), F.least(h, "lent") + F.col("pos") - h, *here))).otherwise(none)
    takers = F.filter("members", lambda c: F.col("pos") <= head(c))
    given = F.when((F.col("conv_id") == F.col("family")) & (F.col("pos") <= most), F.transform(takers, lambda c: one(c, F.col("pos"), *here))).otherwise(none)
    return rows.select(F.inline(F.concat(marked, kept, given)))


@query("op11_prefix_trie", OP11_SQL)
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from courtflow.llm.prefix_trie import narrow, prefix_trie

    return prefix_trie(with_shared_heads(narrow(read(spark, folder, "conversations"))))
