"""The operators as named queries over the driver's tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.llm import op1_license_scan, op10_line_dedup, op11_lm_score, op12_prefix_trie, op13_phrases, op2_quality, op3_url_filter, op4_decontamination, op5_sharding, op6_mixing, op7_near_dedup, op8_token_counts, op9_ann
from tallymill.llm.batches import bounded_batches
from tallymill.session import materialize, read_table


def op1_license_scan_query(spark, sf_dir):
    return op1_license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def op2_quality_query(spark, sf_dir):
    return op2_quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_url_filter_query(spark, sf_dir):
    return op3_url_filter.filter_urls(read_table(spark, sf_dir, "pages"), op3_url_filter.rules_frame(spark))


def op4_decontamination_query(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = op4_decontamination.contamination(docs, read_table(spark, sf_dir, "benchmark"), from_files=True)
    with bounded_batches(spark):
        return materialize(judged.select("doc_id", "__contamination.*"), "judged")


def op5_sharding_query(spark, sf_dir):
    return op5_sharding.shard_documents(read_table(spark, sf_dir, "documents"), 40)


def op6_mixing_query(spark, sf_dir):
    return op6_mixing.mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_near_dedup_query(spark, sf_dir):
    return op7_near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_token_counts_query(spark, sf_dir):
    return op8_token_counts.count_tokens(read_table(spark, sf_dir, "documents"))


def op9_ann_query(spark, sf_dir):
    return op9_ann.nearest(read_table(spark, sf_dir, "embeddings"))


def op10_line_dedup_query(spark, sf_dir):
    place = {"__file": F.xxhash64("_metadata.file_path"), "__row": F.col("_metadata.row_index")}
    kept = op10_line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").withColumns(place), row=("__file", "__row"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op11_lm_score_query(spark, sf_dir):
    return op11_lm_score.score_texts(read_table(spark, sf_dir, "documents"), from_files=True)


def op12_prefix_trie_query(spark, sf_dir):
    return op12_prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op13_phrases_query(spark, sf_dir):
    return op13_phrases.mine_phrases(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_scan": op1_license_scan_query,
    "op2_quality": op2_quality_query,
    "op3_url_filter": op3_url_filter_query,
    "op4_decontamination": op4_decontamination_query,
    "op5_sharding": op5_sharding_query,
    "op6_mixing": op6_mixing_query,
    "op7_near_dedup": op7_near_dedup_query,
    "op8_token_counts": op8_token_counts_query,
    "op9_ann": op9_ann_query,
    "op10_line_dedup": op10_line_dedup_query,
    "op11_lm_score": op11_lm_score_query,
    "op12_prefix_trie": op12_prefix_trie_query,
    "op13_phrases": op13_phrases_query,
}

ORACLES = {
    "op3_url_filter": r"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS k FROM rest),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (k)""",
    "op4_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
n AS (SELECT item_id, w, least(13, len(w))::BIGINT AS s FROM b WHERE len(w) > 0),
x AS (SELECT DISTINCT item_id, s, array_to_string(w[i:i + s - 1], ' ') AS t FROM (SELECT item_id, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM n)),
y AS (SELECT k, i, s, array_to_string(w[i:i + s - 1], ' ') AS t FROM (SELECT k, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM d, (SELECT DISTINCT s FROM n) WHERE len(w) >= s)),
m AS (SELECT y.k, y.i, y.s, x.item_id FROM y JOIN x ON x.t = y.t AND x.s = y.s),
h AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + s)) AS p FROM m) GROUP BY k),
c AS (SELECT k, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS ids FROM (SELECT DISTINCT k, item_id::VARCHAR AS v FROM m) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (k) LEFT JOIN c USING (k)""",
    "op5_sharding": r"""
WITH RECURSIVE w AS (SELECT list(list_reduce(list_prepend(n::BIGINT, range(8)), lambda u, v: xor(u >> 1, CASE WHEN u & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY n) AS w FROM range(256) AS r(n)),
b AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents),
e AS (SELECT k, doc_id, n + 16 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(n), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda a, z: xor(a >> 8, w[(xor(a, z) & 255) + 1])), 4294967295) AS text_crc32 FROM b, w),
j(k, key, shard, next) AS (SELECT k, CASE WHEN coalesce(doc_id, -1) < 0 THEN coalesce(doc_id, -1)::HUGEINT + 18446744073709551616::HUGEINT ELSE doc_id::HUGEINT END, -1::BIGINT, 0::BIGINT FROM b
  UNION ALL SELECT k, f, next, floor((next + 1) * (2147483648.0::DOUBLE / ((f // 8589934592::HUGEINT) + 1)::DOUBLE))::BIGINT FROM (SELECT k, next, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS f FROM j WHERE next < 40)),
s AS (SELECT e.doc_id, e.size, e.text_crc32, shard, CASE WHEN next = 40 THEN 40 ELSE shard END AS grown FROM j JOIN e USING (k) WHERE next >= 40)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown::INTEGER AS grown_shard FROM s""",
    "op6_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s),
f AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS turn FROM c),
t AS (SELECT source, source_size, least(cap, w * (SELECT arg_min(level, turn) FROM f WHERE level * w <= cap)) AS target FROM f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS k,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('17:' || coalesce('s' || d.source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(floor(start + k * rate) - floor(start + (k - 1) * rate), ceil(rate)) * size)::BIGINT AS taken FROM r""",
    "op12_prefix_trie": r"""
WITH t AS (SELECT conv_id AS c, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS m, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, list(m ORDER BY i) AS m, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 9 AS h FROM t GROUP BY c),
r AS (SELECT v.c, list_concat(CASE WHEN b.c IS NULL THEN [] ELSE b.m[1:v.h] END, v.m[v.h + 1:]) AS m FROM v LEFT JOIN v AS b ON b.c = v.c - v.c % 5),
p AS (SELECT c, d, m[1:d] AS p, d = len(m) AS ends FROM (SELECT c, m, unnest(range(len(m) + 1)) AS d FROM r)),
n AS (SELECT d, p, min(c) AS c, count(*) AS k, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS e FROM p GROUP BY d, p),
s AS (SELECT n.*, CASE WHEN d = 0 THEN 0 ELSE (k - 1) * strlen(p[d].t) END AS own, (SELECT count(*) FROM n AS o WHERE o.d = n.d + 1 AND o.p[1:n.d] = n.p) AS children FROM n),
a AS (SELECT up, q, sum(own)::BIGINT AS saved, count(*) FILTER (children = 0) AS leaves FROM (SELECT own, children, up, p[1:up] AS q FROM (SELECT *, unnest(range(d + 1)) AS up FROM s)) GROUP BY up, q)
SELECT s.c AS conv_id, s.d AS depth, u.c AS parent_conv_id, s.k AS n_convs, s.children AS n_children, a.leaves AS n_leaves, a.saved AS saved_tokens, sha256(s.e) AS ends_sha256
FROM s JOIN a ON a.up = s.d AND a.q = s.p LEFT JOIN s AS u ON u.d = s.d - 1 AND u.p = s.p[1:s.d - 1]""",
    "op13_phrases": r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
s AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, m, w[i:i + m - 1] AS p, count(*) AS f FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM s, range(1, 6) AS r(m)) GROUP BY lang, m, p HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM s GROUP BY lang),
c AS (SELECT lang, m, p, f AS a, unnest(range(1, m)) AS k FROM g WHERE m > 1),
x AS (SELECT c.lang, c.p, c.a, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS score, k
  FROM c JOIN n USING (lang) JOIN g AS l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN g AS r ON r.lang = c.lang AND r.p = c.p[k + 1:c.m]),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
o AS (SELECT lang, q, max(f) AS f FROM (SELECT lang, f, p[i:j] AS q FROM (SELECT *, unnest(range(i + 1, m + 1)) AS j FROM (SELECT *, unnest(range(1, m)) AS i FROM g WHERE m > 2)) WHERE j - i + 1 < m) GROUP BY ALL),
k AS (SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM b LEFT JOIN o ON o.lang = b.lang AND o.q = b.p WHERE o.f IS NULL OR 100 * o.f < 100 * b.a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM k)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM z WHERE rank <= 2000""",
}
