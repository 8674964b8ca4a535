"""One query per operator, over its whole table with production parameters."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import (decontaminate, language, line_dedup, main_text, mtree, packing, passages, pii, prefix_trie,
               simhash, toxicity, url_filter, vector_codes)
from .common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def encoder_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query
def op1_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query
def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


@query
def op3_topk(spark, sf_dir):
    vectors = mtree.integer_vectors(table(spark, sf_dir, "embeddings"))
    return mtree.top_k(vectors.where("vec_id % 100 = 0"), vectors, k=10)


ORACLE["op3_topk"] = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10
"""


@query
def op4_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), encoder_path(), seq_len=1024)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op5_passages(spark, sf_dir):
    return passages.repeated_passages(table(spark, sf_dir, "documents"), min_words=50)


@query
def op6_toxicity(spark, sf_dir):
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_pii(spark, sf_dir):
    return pii.pseudonymize(table(spark, sf_dir, "documents"), key="op7").select("doc_id", "text", "n_replaced")


@query
def op8_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), min_lines=2, long_words=50).select(
        "doc_id", "text", "n_lines", "n_deleted")


ORACLE["op8_line_dedup"] = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents
), w AS (
  SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM l
), c AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, i) > 1 AS later
  FROM w WHERE next IS NOT NULL
), gone AS (
  SELECT doc_id, i FROM c WHERE later UNION SELECT doc_id, i + 1 FROM c WHERE later
  UNION SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AS later FROM l
    WHERE len(list_filter(string_split_regex(line, '[ \t\r\f]+'), lambda w: w <> '')) >= 50) WHERE later
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_deleted,
         string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i
  GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


#: (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]


@query
def op9_url_filter(spark, sf_dir):
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


@query
def op10_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    return decontaminate.judged(found).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


ORACLE["op10_decontaminate"] = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), p AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g))
), h AS (
  SELECT DISTINCT p.doc_id, p.i, p.n, g.item_id FROM p JOIN g ON g.n = p.n AND g.gram = p.gram
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, i + unnest(range(n)) AS pos FROM h) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query
def op11_main_text(spark, sf_dir):
    return main_text.main_text(table(spark, sf_dir, "pages"), main_text.train()).drop("n_kept")


@query
def op12_vector_codes(spark, sf_dir):
    rows, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), n_parts=16, entries=64, rounds=2, scale=256)
    return rows.select("vec_id", "code", "error", "label_error",
                       F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


def _codes_sql(rounds: int = 2) -> str:
    def assigned(n: int) -> str:
        """Least distance, then least index, as one number; ``/`` 64 and ``%`` 64 take it apart."""
        return f"""a{n} AS (
  SELECT x.r, x.p, any_value(x.v) AS v,
         min(64 * list_sum([(x.v[i] - b.v[i]) * (x.v[i] - b.v[i]) FOR i IN range(1, len(x.v) + 1)]) + b.e) AS best
  FROM x JOIN b{n} b USING (p) GROUP BY x.r, x.p)"""

    steps = []
    for n in range(rounds):
        steps += [assigned(n), f"""m{n} AS (
  SELECT p, e, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS v
  FROM (SELECT p, best % 64 AS e, i, CAST(sum(v[i]) AS HUGEINT) AS s, count(*) AS n
        FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM a{n}) GROUP BY p, best % 64, i) GROUP BY p, e)""",
                  f"""b{n + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{n} b LEFT JOIN m{n} m USING (p, e))"""]
    return f"""WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), x AS (
  SELECT r, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS v FROM k, range(16) t(p)
), b0 AS (SELECT p, r - 1 AS e, v FROM x WHERE r <= 64),
{", ".join(steps)}, {assigned(rounds)},
c AS (
  SELECT r, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error
  FROM a{rounds} GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM k JOIN c USING (r)
"""


ORACLE["op12_vector_codes"] = _codes_sql()


@query
def op13_prefix_trie(spark, sf_dir):
    turns, conversations = prefix_trie.with_shared_heads(prefix_trie.turn_digests(table(spark, sf_dir, "conversations")))
    nodes, ends = prefix_trie.prefix_trie(turns, conversations, block=4)
    return nodes.join(prefix_trie.list_digests(ends), prefix_trie.NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


ORACLE["op13_prefix_trie"] = """
WITH o AS (
  SELECT conv_id, md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_md5,
         len(coalesce(text, '')) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, turn_md5) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, max(n) AS len, list_reduce(
    list_concat([4294967295], [ascii(x) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)),
                                  lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)) AS reg
  FROM o GROUP BY conv_id
), k AS (
  SELECT c.conv_id, c.conv_id - c.conv_id % 100 AS base, xor(c.reg, 4294967295) % 6 AS h,
         least(xor(c.reg, 4294967295) % 6, coalesce(b.len, 0)) AS kept
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100
), r AS (
  SELECT k.conv_id, o.n, turn_md5, chars FROM k JOIN o ON o.conv_id = k.base AND o.n <= k.h
  UNION ALL
  SELECT k.conv_id, o.n - k.h + k.kept, turn_md5, chars FROM k JOIN o ON o.conv_id = k.conv_id AND o.n > k.h
), m AS (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS chars FROM k
  UNION ALL
  SELECT conv_id, n, string_agg(turn_md5, '') OVER (PARTITION BY conv_id ORDER BY n), chars FROM r
), nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM m GROUP BY depth, path
), below AS (
  SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), tree AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN below USING (path)
), sums AS (
  SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved_tokens
  FROM tree a JOIN tree b ON starts_with(b.path, a.path) GROUP BY a.path
), lists AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, max_by(path, depth) AS path FROM m GROUP BY conv_id) GROUP BY path
)
SELECT t.conv_id, CAST(t.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, t.n_convs,
       CAST(t.n_children AS BIGINT) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM tree t JOIN sums USING (path) LEFT JOIN lists USING (path)
LEFT JOIN tree p ON t.depth > 0 AND p.path = left(t.path, 32 * (t.depth - 1))
"""
