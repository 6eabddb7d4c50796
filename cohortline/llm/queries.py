"""The corpus operators as queries over the given tables; SQL where SQL can say the same."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import functions as F

from cohortline.llm.bpe import Vocabulary, encode, read_ranks
from cohortline.llm.common import table
from cohortline.llm.divergence import source_divergence
from cohortline.llm.filter_audit import text_filter_audit
from cohortline.llm.line_dedup import MAX_RATIO, MIN_PAGES, line_dedup
from cohortline.llm.line_quality import MAX_SHARE, MIN_DOCS, MIN_LEFT, line_quality
from cohortline.llm.nbsvm import quality_scores
from cohortline.llm.packing import added_tokens, pack
from cohortline.llm.pii import KINDS, find_pii
from cohortline.llm.secrets import scan_secrets
from cohortline.llm.simhash import simhash_groups
from cohortline.llm.suffix_dedup import suffix_dedup
from cohortline.llm.topk import top_k
from cohortline.llm.url_filter import host_and_path, judge_urls


def op1_byte_bpe(spark, folder):
    vocabulary = Vocabulary(spark, read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    coded = encode(table(spark, folder, "documents"), vocabulary)
    return coded.select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(vocabulary.decoded(F.col("ids")), 256).alias("decoded_sha256"),
    )


def op2_topk(spark, folder):
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: A host with one of these words in its name, cut at dots and hyphens, goes on the list of blocked hosts.
BLOCKED_WORDS = ("casino", "malware", "phishing", "porn", "spam", "xxx")


def op3_url_filter(spark, folder):
    """Pages against the rules and, where none fits, the list of the corpus's hosts with a blocked word in their name."""
    pages = table(spark, folder, "pages")
    hosts = pages.select(host_and_path(pages["url"])[0].alias("host")).distinct()
    listed = hosts.filter(F.col("host").rlike(f"(^|[.-])({'|'.join(BLOCKED_WORDS)})([.-]|$)"))
    return judge_urls(pages, URL_RULES, listed)


OP3_SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN url[strpos(url, '://') + 3:] END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest[length(raw) + 1:], '^[^?#]*'), '') AS path FROM h),
rules(verdict, rh, rp) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
fits AS (SELECT page_id, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN EXISTS (SELECT 1 FROM p q
    WHERE (p.host = q.host OR ends_with(p.host, '.' || q.host)) AND regexp_matches(q.host, '(^|[.-])({'|'.join(BLOCKED_WORDS)})([.-]|$)'))
  THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1"""


def op4_line_quality(spark, folder):
    return line_quality(table(spark, folder, "documents"))


OP4_SQL = f"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
lines AS (
  SELECT doc_id, source, u.line, regexp_extract_all(translate(u.line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS ws FROM w, LATERAL (SELECT unnest(string_split(t, chr(10))) AS line) u),
solid AS (SELECT doc_id, source, line, len(ws) AS n, array_to_string(ws, ' ') AS k FROM lines WHERE len(ws) > 0),
hosts AS (SELECT source, count(DISTINCT doc_id) AS n FROM documents GROUP BY source),
bad AS (SELECT s.source, s.k FROM (SELECT source, k, count(DISTINCT doc_id) AS c FROM solid GROUP BY source, k) s
  JOIN hosts h ON s.source IS NOT DISTINCT FROM h.source WHERE s.c >= {MIN_DOCS} AND s.c > {MAX_SHARE}::DOUBLE * h.n),
per AS (SELECT s.doc_id, count(*) - count(DISTINCT s.line) AS dup, sum(CASE WHEN b.k IS NULL THEN 0 ELSE s.n END) AS gone
  FROM solid s LEFT JOIN bad b ON s.source IS NOT DISTINCT FROM b.source AND s.k = b.k GROUP BY s.doc_id),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 6)) AS i) r),
twice AS (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + o AS p FROM win JOIN twice USING (doc_id, k), range(8) r(o)) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(per.dup, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
    len(ws) - CAST(coalesce(per.gone, 0) AS BIGINT) AS left_words
  FROM w LEFT JOIN per USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND left_words >= {MIN_LEFT}::DOUBLE * n_words AS kept FROM base"""


def op5_nbsvm(spark, folder):
    scored = quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("row.doc_id", "held_out", "score", "predicted")


def packing_ranks() -> bytes:
    """The ranks that byte_bpe_50k.json has as its vocabulary."""
    return Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()


def pack_documents(docs):
    """All documents, as the tokenizer of byte_bpe_50k.json encodes them."""
    added = added_tokens(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())
    return pack(docs, packing_ranks(), public_tokenizers.PATTERN, added=added)


def op6_packing(spark, folder):
    return pack_documents(table(spark, folder, "documents"))


def op7_secrets(spark, folder):
    found = scan_secrets(table(spark, folder, "documents"))
    return found.select("row.doc_id", "n_candidates", F.size("secrets").alias("n_secrets"), "secrets", "row.text")


def op8_simhash(spark, folder):
    return simhash_groups(table(spark, folder, "documents"))


def op9_line_dedup(spark, folder):
    out = line_dedup(table(spark, folder, "documents"))
    return out.select("row.doc_id", "n_lines", "n_dropped", "row.text")


OP9_SQL = f"""
WITH lines AS (
  SELECT d.doc_id, d.source, u.line, u.i, trim(u.line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS bare
  FROM documents d, LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line,
    unnest(range(len(string_split(d.text, chr(10))))) AS i) u),
pages AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
counts AS (SELECT source, bare, count(DISTINCT doc_id) AS c FROM lines WHERE bare <> '' GROUP BY source, bare),
bad AS (SELECT c.source, c.bare FROM counts c JOIN pages p ON c.source IS NOT DISTINCT FROM p.source
  WHERE c.c >= {MIN_PAGES} AND c.c > {MAX_RATIO}::DOUBLE * p.n)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE b.bare IS NOT NULL) AS n_dropped,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE b.bare IS NULL), '') AS text
FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.bare = b.bare GROUP BY l.doc_id"""

def op10_suffix_dedup(spark, folder):
    found = suffix_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_filter_audit(spark, folder):
    return text_filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP11_SQL = """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
told AS (SELECT doc_id AS id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, good, toxic, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws),
    100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails
  FROM w LEFT JOIN told ON doc_id = id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, CAST(s AS INTEGER) AS step, list_transform(string_split(o, ''), lambda x: ascii(x) - 64) AS k FROM orders, range(1, 6) r(s)),
hit AS (SELECT part, o, step, k[step] AS mine, n, good, toxic, fails[k[step]] AS fails_it,
    len(list_filter(k[:step - 1], lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS once FROM c, steps),
per AS (SELECT part, o AS filter_order, step, mine,
    coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails_it), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fails_it), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE gone AND fails_it), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails_it AND once), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT gone AND fails_it), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails_it), 0) AS toxic_lost FROM hit GROUP BY part, o, step, mine)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, mine))::BIGINT AS shapley FROM per"""


def op12_pii(spark, folder):
    found = find_pii(table(spark, folder, "documents"))

    def written(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return found.select(
        "row.doc_id", *[F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op13_source_divergence(spark, folder):
    return source_divergence(table(spark, folder, "documents"))


OP13_SQL = """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
kept AS (SELECT lang, w FROM (SELECT lang, unnest(list_distinct(ws)) AS w FROM d) GROUP BY lang, w HAVING count(*) >= 30),
occ AS (SELECT lang, source, w, count(*) AS c FROM (SELECT lang, source, unnest(ws) AS w FROM d) JOIN kept USING (lang, w) GROUP BY lang, source, w),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
gn AS (SELECT g.lang, g.source, v.v, coalesce(sum(occ.c), 0) AS n FROM g JOIN v USING (lang) LEFT JOIN occ USING (lang, source) GROUP BY g.lang, g.source, v.v),
ln AS (SELECT lang, sum(n) AS n FROM gn GROUP BY lang),
gp AS (SELECT gn.lang, gn.source, kept.w, coalesce(occ.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(occ.c, 0) + 5)) // (gn.n + 5 * gn.v) AS p
  FROM gn JOIN kept USING (lang) LEFT JOIN occ ON occ.lang = gn.lang AND occ.source = gn.source AND occ.w = kept.w),
lp AS (SELECT o.lang, o.w, 1 + (1000000000::HUGEINT * (o.c + 5)) // (ln.n + 5 * v.v) AS q
  FROM (SELECT lang, w, sum(c) AS c FROM occ GROUP BY lang, w) o JOIN ln USING (lang) JOIN v USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM gp a JOIN gp b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
terms AS (SELECT gp.lang, gp.source, 'term' AS part, gp.w AS item, (gp.p - lp.q)::BIGINT AS value FROM gp JOIN lp ON gp.lang = lp.lang AND gp.w = lp.w
  WHERE gp.c > 0 AND gp.p > lp.q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50"""


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_topk": op2_topk,
    "op3_url_filter": op3_url_filter,
    "op4_line_quality": op4_line_quality,
    "op5_nbsvm": op5_nbsvm,
    "op6_packing": op6_packing,
    "op7_secrets": op7_secrets,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_pii": op12_pii,
    "op13_source_divergence": op13_source_divergence,
}

SQL = {"op2_topk": OP2_SQL, "op3_url_filter": OP3_SQL, "op4_line_quality": OP4_SQL, "op9_line_dedup": OP9_SQL,
       "op11_filter_audit": OP11_SQL, "op13_source_divergence": OP13_SQL}
