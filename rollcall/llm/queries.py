"""Queries of this subpackage over a folder of tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.llm.common import table
from rollcall.llm.decontaminate import benchmark_hits, is_contaminated
from rollcall.llm.html_extract import extract_main_text
from rollcall.llm.jaccard_join import jaccard_components
from rollcall.llm.language_id import fit_languages, held_out, identify_languages
from rollcall.llm.licence_scan import scan_licences
from rollcall.llm.line_dedup import drop_repeated_lines
from rollcall.llm.media_sniff import media_digests
from rollcall.llm.mixing import mixing_plan
from rollcall.llm.sharding import assign_shards, map_path
from rollcall.llm.surrogates import replace_entities


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    net = fit_languages(docs.select("doc_id", "text", "lang"))
    found = identify_languages(docs.select("doc_id", "text"), net)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")


def op3_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    return drop_repeated_lines(docs, min_chars=20, min_docs=3).select("doc_id", "n_lines", "n_dropped", kept)


def op4_decontamination(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hits = benchmark_hits(docs, items, window=13, gram=9)
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words"), share=20).alias("contaminated"),
    )


def op5_licence_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fields = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return scan_licences(docs).select("doc_id", *[f"licences.{f}" for f in fields])


def op6_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sharded = assign_shards(docs, shards=8, path=map_path(spark, sf_dir, "documents"))
    return sharded.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_media_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media_digests(docs, unit=64)


def op8_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op9_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan = mixing_plan(docs, weights=(3, 1, 2), percent=150, most=2, seed="mix-1:")
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_surrogates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, key="surrogates-1").select("doc_id", "text", "n_entities")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_html_extraction": op2_html_extraction,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_licence_scan": op5_licence_scan,
    "op6_sharding": op6_sharding,
    "op7_media_columns": op7_media_columns,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_mixing": op9_mixing,
    "op10_surrogates": op10_surrogates,
}

ORACLES = {
    "op3_line_dedup": r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce("text", ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM split
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.i, l.line, c.k IS NOT NULL AND l.doc_id <> c.keeper AS gone FROM keyed l LEFT JOIN common c ON c.k = l.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op4_decontamination": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i+m-1], ' '))) AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS m FROM items WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT m FROM item_windows
), doc_windows AS (
  SELECT doc_id, m, i, array_to_string(w[i:i+m-1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, lengths WHERE len(w) >= m)
), hits AS (
  SELECT d.doc_id, d.i, d.m, x.item_id FROM doc_windows d JOIN item_windows x ON x.m = d.m AND x.g = d.g
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
  sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
""",
    "op9_mixing": r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all("text", '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS r FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, CAST([3, 1, 2][(r - 1) % 3 + 1] AS BIGINT) AS weight, 2 * source_size AS cap FROM sources
), rounds AS (
  SELECT 0 AS step, source, FALSE AS full_ FROM weighed
  UNION ALL
  SELECT step + 1, source, full_ OR (budget - capped) * weight > 100 * cap * heavy
  FROM (
    SELECT r.step, w.*, r.full_, 150 * sum(w.source_size) OVER () AS budget,
      100 * sum(CASE WHEN r.full_ THEN w.cap ELSE 0 END) OVER () AS capped,
      sum(CASE WHEN r.full_ THEN 0 ELSE w.weight END) OVER () AS heavy,
      count(*) OVER () AS n
    FROM rounds r JOIN weighed w ON w.source IS NOT DISTINCT FROM r.source
  )
  WHERE step < n
), last_ AS (
  SELECT * FROM rounds WHERE step = (SELECT max(step) FROM rounds)
), targets AS (
  SELECT w.source, w.source_size, CASE WHEN l.full_ THEN CAST(w.cap AS DOUBLE) ELSE
    CAST((150 * sum(w.source_size) OVER () - 100 * sum(CASE WHEN l.full_ THEN w.cap ELSE 0 END) OVER ()) * w.weight AS DOUBLE)
    / CAST(100 * sum(CASE WHEN l.full_ THEN 0 ELSE w.weight END) OVER () AS DOUBLE) END AS target
  FROM weighed w JOIN last_ l ON w.source IS NOT DISTINCT FROM l.source
), drawn AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('mix-1:' || CAST(s.doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM drawn
""",
    "op8_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS g
  FROM words
), sizes AS (
  SELECT w.doc_id, count(g.g) AS n FROM words w LEFT JOIN grams g ON g.doc_id = w.doc_id GROUP BY ALL
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * o >= 85 * (a.n + b.n - o)
), edges AS (
  SELECT x AS u, y AS v FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT u AS doc_id, u AS r FROM edges
  UNION
  SELECT e.u, reach.r FROM reach JOIN edges e ON e.v = reach.doc_id
)
SELECT s.doc_id, s.n AS n_shingles, coalesce(min(r.r), s.doc_id) AS component_id
FROM sizes s LEFT JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n
""",
}
