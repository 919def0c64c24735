"""Registered queries of this subpackage, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversation_repair, decontamination, exact_dedup, html_text, language_id, lexical_search, near_dedup, packing, quality, suffix_dedup, token_counts, toxicity, warc
from .rows import whole_text
from .store import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept_bytes")


def op3_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op4_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_copies(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.copy_groups(_table(spark, sf_dir, "documents"))


def op6_html_text(spark, sf_dir):
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_decontamination(spark, sf_dir):
    return decontamination.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_warc(spark, sf_dir):
    records = warc.round_trip(spark, _table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality(spark, sf_dir):
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_token_counts(spark, sf_dir):
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op11_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(whole_text("doc_id")) % 5 == 0
    model = language_id.train(docs, ~held_out)
    return language_id.predict(docs, model).withColumn("held_out", held_out)


def op12_conversation_repair(spark, sf_dir):
    rows = conversation_repair.damaged(_table(spark, sf_dir, "conversations"))
    return conversation_repair.repair_reports(rows)


def op13_lexical_search(spark, sf_dir):
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (
        op1_best_fit_packing,
        op2_suffix_dedup,
        op3_toxicity,
        op4_minhash_near_dedup,
        op5_exact_dedup,
        op6_html_text,
        op7_decontamination,
        op8_warc,
        op9_quality,
        op10_token_counts,
        op11_language_id,
        op12_conversation_repair,
        op13_lexical_search,
        pipeline,
    )
    return {query.__name__: query for query in each}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_minhash_near_dedup": OP4,
        "op5_exact_dedup": OP5,
        "op12_conversation_repair": OP12,
        "op13_lexical_search": OP13,
    }


OP5 = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
    ELSE array_to_string(words[i:i + 4], ' ') END AS shingle
  FROM w, unnest(range(1, greatest(2, len(words) - 3))) AS r(i) WHERE len(words) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)
), reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(min(reach.y), w.doc_id)) AS component_id,
  w.doc_id <= coalesce(min(reach.y), w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.x = w.doc_id GROUP BY w.doc_id, n.n
"""

# The damage's crc32 is worked out bit by bit; the edits come from a recursion over the rows that keeps the least (cost, edits)
# for each state 0 to 3 (nothing, system, user, assistant).
OP12 = r"""
WITH RECURSIVE k AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS key FROM conversations
), h AS (
  SELECT *, xor(list_reduce([4294967295::bigint] || list_transform(string_split(key, ''), lambda x: ascii(x)::bigint),
    lambda crc, b: list_reduce([xor(crc, b)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0],
      lambda r, z: xor(r >> 1, 3988292384::bigint * (r & 1)))), 4294967295::bigint) % 20 AS kind FROM k
), d AS (
  SELECT c, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS r(copy)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text)) AS i, left(role, 1) AS r,
    rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS seen FROM d
), f AS (
  SELECT *, lag(r) OVER (PARTITION BY c ORDER BY i) AS before, CASE WHEN seen = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o
), ins(q, p, cost, edits) AS (
  VALUES (0, 0, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 1, 0, ''), (1, 2, 2, 'I'), (1, 3, 4, 'II'),
    (2, 2, 0, ''), (2, 3, 2, 'I'), (3, 3, 0, ''), (3, 2, 2, 'I')
), keeps(q, r, p) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), moves AS (
  SELECT q, NULL AS r, q AS p, 3 AS cost, 'D' AS edit FROM (VALUES (0), (1), (2), (3)) t(q)
  UNION ALL SELECT q, r, p, 0, 'K' FROM keeps
  UNION ALL SELECT q, NULL, p, 2, 'R' FROM (VALUES (0, 2), (1, 2), (2, 3), (3, 2)) t(q, p)
), best(c, i, q, b) AS (
  SELECT DISTINCT c, 0::bigint, 0, '000000000' FROM k
  UNION ALL
  SELECT best.c, f.i, m.p, min(printf('%09d', left(best.b, 9)::int + ins.cost + m.cost + CASE WHEN f.fault = 'truncated' AND m.edit <> 'D' THEN 1 ELSE 0 END)
    || substr(best.b, 10) || ins.edits || m.edit)
  FROM best JOIN f ON f.c = best.c AND f.i = best.i + 1 JOIN ins ON ins.q = best.q
    JOIN moves m ON m.q = ins.p AND (m.r IS NULL OR m.r = f.r) AND (m.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
  GROUP BY best.c, f.i, m.p
), n AS (SELECT c, max(i) AS n FROM best GROUP BY c),
won AS (
  SELECT best.c, min(printf('%09d', left(b, 9)::int + ins.cost) || substr(b, 10) || ins.edits) AS b
  FROM best JOIN n ON n.c = best.c AND n.n = best.i JOIN ins ON ins.q = best.q AND ins.p IN (0, 3) GROUP BY best.c
), edits AS (
  SELECT c, pos, edit, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY pos) AS i
  FROM (SELECT c, unnest(range(1, length(b) - 8)) AS pos, unnest(string_split(substr(b, 10), '')) AS edit FROM won WHERE length(b) > 9)
), kept AS (
  SELECT e.*, f.role, f.text, row_number() OVER (PARTITION BY e.c ORDER BY pos) AS place FROM edits e LEFT JOIN f ON f.c = e.c AND f.i = e.i WHERE edit <> 'D'
), leads AS (SELECT c, max(CASE WHEN place = 1 AND edit = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) AS lead FROM kept GROUP BY c),
texts AS (
  SELECT c, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS whole FROM kept JOIN leads USING (c) GROUP BY c
), counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, left(b, 9)::bigint AS cost, substr(b, 10) AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM k) JOIN won USING (c) LEFT JOIN counts USING (c) LEFT JOIN texts USING (c)
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), q AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM benchmark
), whole AS (SELECT count(*) FILTER (len(words) > 0) AS docs, sum(len(words))::bigint AS terms FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM tf, whole GROUP BY term, docs
), asked AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(words) AS term FROM q) GROUP BY ALL),
m AS (SELECT r, doc_id, 75 + (25 * len(words) * docs) // terms AS m FROM d, whole),
scored AS (
  SELECT i, m.r, m.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m ON m.r = tf.r GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::int AS rank FROM scored WHERE score > 0
) JOIN q USING (i) WHERE rank <= 20
"""
