"""The registered queries of this subpackage: thin wrappers of its operators, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import ball_tree, bpe, decontaminate, embed_dedup, exact_dedup, hard_negatives, licenses, ngram_join, quality, secrets, substring_dedup, token_files, warc
from .common import table
from .license_texts import TEMPLATES


def op1_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_decontaminate(spark, sf_dir):
    return decontaminate.digest(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_embed_dedup(spark, sf_dir):
    return embed_dedup.embed_dedup(table(spark, sf_dir, "embeddings"))


def op4_secrets(spark, sf_dir):
    """Owners are sources; what a source has in one language stands in for a repository of it."""
    repository = F.concat_ws("/", "source", "lang")
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents"), repository=repository, owner="source"))


def op5_token_files(spark, sf_dir):
    return token_files.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_ngram_join(spark, sf_dir):
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op8_licenses(spark, sf_dir):
    return licenses.digest(licenses.license_scan(table(spark, sf_dir, "documents"), TEMPLATES))


def op9_warc(spark, sf_dir):
    return warc.digest(table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_sentences", "n_removed", "removed", "text")


def op11_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op12_ball_tree(spark, sf_dir):
    return ball_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_decontaminate, op3_embed_dedup, op4_secrets, op5_token_files, op6_ngram_join, op7_quality, op8_licenses, op9_warc, op10_substring_dedup, op11_exact_dedup, op12_ball_tree, op13_hard_negatives)}
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS l, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda s: array_to_string(w[s:s + least(13, len(w)) - 1], ' '))) AS win FROM i WHERE len(w) > 0),
dw AS (SELECT doc_id, l, unnest(list_transform(range(1, len(w) - l + 2), lambda s: {{'s': s, 'win': array_to_string(w[s:s + l - 1], ' ')}})) AS x FROM w CROSS JOIN (SELECT DISTINCT l FROM iw) WHERE len(w) >= l),
h AS (SELECT doc_id, x.s AS s, dw.l AS l, item_id FROM dw JOIN iw ON dw.l = iw.l AND x.win = iw.win),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""

_OP3 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id <= coalesce(c, vec_id) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""

_OP6 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, hash(x) AS h, x FROM (SELECT doc_id, s, unnest(s) AS x FROM s)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.x = b.x AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id FROM s LEFT JOIN c ON c.a = doc_id"""

_OP9 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages), d AS (SELECT page_id, octet_length(h) AS n, h, array_to_string(list_transform(string_split(sha1(h), ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '') AS bits FROM p),
b AS (SELECT page_id, n, max(page_id) OVER (PARTITION BY h) AS last, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM b"""

_OP11 = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS x FROM documents),
r AS (SELECT doc_id, x, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY x) AS group_size, row_number() OVER g = 1 AS kept FROM t WINDOW g AS (PARTITION BY x ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, sha256(x) AS text_sha256 FROM r"""

_OP12 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, list_distinct(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
c AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
f AS (SELECT doc_id, len(w) AS n, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d) GROUP BY ALL),
p AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(c.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY t),
s AS (SELECT doc_id, f.t, p.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * f.n * c.n) // c.l))) AS s FROM f JOIN p USING (t), c),
q AS (SELECT item_id, unnest(w) AS t FROM i),
a AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM q JOIN s USING (t) GROUP BY ALL HAVING sum(s) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM a
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""

_OP13 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS s FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b, s.b AS n, p.s AS ps, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS rank FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s)
SELECT a AS anchor_id, b AS positive_id, CAST(rank AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 5"""

ORACLES: dict[str, str] = {"op2_decontaminate": _OP2, "op3_embed_dedup": _OP3, "op6_ngram_join": _OP6, "op9_warc": _OP9, "op11_exact_dedup": _OP11, "op12_ball_tree": _OP12, "op13_hard_negatives": _OP13}
