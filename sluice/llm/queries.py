"""The registered queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import ann, decontaminate, lm, packing, quality, secrets, simhash, substrings, templates, url_filter
from sluice.llm._common import fold_of, table

URL_RULES = (
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
)
QUALITY_THRESHOLD = 0.3


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def packed_pieces(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(packing.pack(table(spark, sf_dir, "documents"), vocabulary()))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed")
    return left.select("doc_id", "n_bytes", removed, F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = templates.dedup_lines(docs, count_col="n_dropped")
    return kept.select("doc_id", "n_dropped", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.learn())
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["kind"] != "grammar")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p
), r(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), n AS (SELECT row_number() OVER () AS i, * FROM q
), m AS (
  SELECT i, page_id, host, path, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY i ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS best
  FROM n LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM m WHERE best = 1
"""

#: All strings of 50 bytes, as hexadecimal digits, with the least document of each; what they cover goes.
OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), w AS (SELECT r, doc_id, k, substr(x, 2 * k + 1, 100) AS s FROM (SELECT r, doc_id, x, unnest(range(length(x) // 2 - 49)) AS k FROM d WHERE doc_id IS NOT NULL)
), f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
), h AS (SELECT r, k FROM w JOIN f USING (s) WHERE least < doc_id
), g AS (SELECT r, k, CASE WHEN k <= lag(k) OVER (PARTITION BY r ORDER BY k) + 50 THEN 0 ELSE 1 END AS fresh FROM h
), n AS (SELECT r, k, sum(fresh) OVER (PARTITION BY r ORDER BY k) AS run FROM g
), u AS (SELECT r, run, min(k) AS a, max(k) + 50 AS z FROM n GROUP BY r, run
), v AS (SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM u
), p AS (
  SELECT r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM v JOIN d USING (r) GROUP BY r
)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN p USING (r)
"""
#: Lines as tokens, those with a digit as fields; a position of a leaf's line is a field too if ten lines are equal but for it.
OP5_SQL = r"""
WITH own AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), l AS (SELECT r, doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM own WHERE doc_id IS NOT NULL
), k AS (SELECT r, doc_id, pos, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM l
), e AS (SELECT t, len(t) AS n, min(doc_id) AS low, max(doc_id) AS high FROM k WHERE len(t) >= 3 GROUP BY t
), o AS (SELECT t, n, count(*) OVER (PARTITION BY n, t[1:3]) AS beside FROM e
), h AS (SELECT t, n, unnest(range(4, n + 1)) AS p FROM o WHERE beside >= 10
), w AS (SELECT t, n, p, t[1:p-1] AS a, t[p+1:] AS b FROM h WHERE t[p] <> '<*>'
), v AS (SELECT n, p, a, b FROM w GROUP BY ALL HAVING count(*) >= 10
), f AS (SELECT t, n, list(p) AS ps FROM w JOIN v USING (n, p, a, b) GROUP BY t, n HAVING count(*) <= floor(n * 0.2 + 1e-9)
), g AS (
  SELECT e.t, low, high, CASE WHEN ps IS NULL THEN e.t ELSE ['field'] || list_transform(e.t, lambda x, i: CASE WHEN list_contains(ps, i) THEN '<*>' ELSE x END) END AS template
  FROM e LEFT JOIN f USING (t)
), s AS (SELECT template, min(low) AS first_doc FROM g GROUP BY template HAVING min(low) <> max(high)
), x AS (SELECT r, list(pos) AS lost FROM k JOIN g USING (t) JOIN s USING (template) WHERE doc_id <> first_doc GROUP BY r
), y AS (
  SELECT doc_id, coalesce(len(lost), 0) AS n_dropped,
         CASE WHEN lost IS NULL THEN coalesce(text, '') ELSE coalesce(array_to_string(list_filter(ls, lambda z, i: NOT list_contains(lost, i - 1)), chr(10)), '') END AS kept
  FROM own LEFT JOIN x USING (r)
)
SELECT doc_id, n_dropped, strlen(kept) AS n_bytes, sha256(kept) AS kept_sha256 FROM y
"""
#: Every alignment of every document and item: equal tokens are joined and counted by offset. Windows of 13 tokens need 80 % equal ones, and shorter items as a whole.
OP8_SQL = r"""
WITH dw AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL
), iw AS (
  SELECT min(item_id) AS item_id, w, len(w) AS n, least(13, len(w)) AS size
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0 GROUP BY w
), d AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM dw
), i AS (SELECT item_id, n, size, (size * 8 + 9) // 10 AS need, unnest(w) AS t, unnest(range(n)) AS p FROM iw
), m AS (
  SELECT doc_id, item_id, n, size, need, d.p - i.p AS off, list(i.p) AS eq FROM d JOIN i USING (t) GROUP BY ALL HAVING count(*) >= need
), s AS (SELECT doc_id, item_id, off, size, need, eq, unnest(range(n - size + 1)) AS s FROM m
), g AS (SELECT doc_id, item_id, off, s, need, len(list_filter(eq, lambda x: x >= s AND x < s + size)) AS c FROM s
)
SELECT doc_id, item_id, max(c) AS n_equal, count(DISTINCT off) AS n_alignments, min(greatest(0, off + s)) AS doc_start, min(s) AS item_start
FROM g WHERE c >= need GROUP BY doc_id, item_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_packing": op3_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality": op6_quality,
    "op7_secrets": op7_secrets,
    "op8_decontamination": op8_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_ann": op10_ann,
}
ORACLE_SQL: dict[str, str] = {"op4_substring_dedup": OP4_SQL, "op5_line_dedup": OP5_SQL, "op8_decontamination": OP8_SQL, "op9_url_filter": OP9_SQL}
