"""One query per operator over its whole table, and the SQL forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomline.llm.common import raw

def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bits = f"list_prepend(4294967295, flatten(list_transform(string_split({text}, ''), lambda ch: [CAST(ord(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])))"
    return f"xor(list_reduce({bits}, lambda a, y: xor(xor(a, y) >> 1, 3988292384 * (xor(a, y) & 1))), 4294967295)"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return deco


@_query(
    "op10_exact_top_k",
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.topk import exact_top_k

    return exact_top_k(raw(spark, sf_dir, "embeddings"), k=20, every=20)


@_query("op6_substring_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.substrings import remove_repeats

    return remove_repeats(raw(spark, sf_dir, "documents"), window=35)


@_query(
    "op4_minhash_near_dedup",
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
    ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) END AS g FROM w
), n AS (SELECT doc_id, len(g) AS n FROM s), x AS (SELECT doc_id, unnest(g) AS h FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) ON a = doc_id""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.nearcopies import near_copies

    return near_copies(raw(spark, sf_dir, "documents"), shingle=3, percent=85)


@_query("op1_ppm_scores")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.ppm import ppm_scores

    return ppm_scores(raw(spark, sf_dir, "documents"), order=5)


@_query("op2_multiprobe_nearest")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.ann import nearest

    return nearest(raw(spark, sf_dir, "embeddings"), k=20, every=20)


@_query("op7_subword_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.quality import quality_scores

    return quality_scores(raw(spark, sf_dir, "documents"), raw(spark, sf_dir, "labels"), threshold=0.3)


@_query("op3_weak_supervision_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.pii import personal_data

    return personal_data(raw(spark, sf_dir, "documents"))


def _op8_sql() -> str:
    from loomline.llm.mixing import mixed_sql

    return mixed_sql()


@_query("op8_raked_mixture", _op8_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from loomline.llm.mixing import mixed

    out = mixed(raw(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "keep")


@_query("op5_streaming_pieces")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.pieces import encode_documents

    return encode_documents(raw(spark, sf_dir, "documents"))


@_query("op9_language_fusion")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.langid import fused, languages_of, profiles

    docs = raw(spark, sf_dir, "documents")
    languages = languages_of(docs)
    return fused(raw(spark, sf_dir, "pages"), profiles(docs, languages), languages)


@_query(
    "op11_prefix_trie",
    f"""
WITH t AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1
), h AS (SELECT c, l, {_crc32("CAST(c AS VARCHAR)")} % 9 AS h FROM t),
w AS (SELECT a.c, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l FROM h a LEFT JOIN t b ON b.c = a.c - a.c % 5),
m AS (SELECT c, len(l) AS len, d, l[1:d] AS p FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM w)),
n AS (
  SELECT d, p, min(c) AS c, count(*) AS n, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len = d), '') AS ends,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(p[d].x) END AS saved FROM m GROUP BY d, p
), k AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(k.n, 0) AS kids FROM n LEFT JOIN k ON n.d = k.d AND n.p = k.p),
u AS (SELECT p[1:a] AS p, a AS d, sum(saved) AS saved, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM v) GROUP BY ALL)
SELECT v.c AS conv_id, v.d AS depth, o.c AS parent_conv_id, v.n AS n_convs, v.kids AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves,
  CAST(u.saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN u ON v.d = u.d AND v.p = u.p LEFT JOIN v o ON o.d = v.d - 1 AND o.p = v.p[1:v.d - 1]""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.prefixtrie import rebuilt_trie

    return rebuilt_trie(raw(spark, sf_dir, "conversations"))


@_query(
    "op13_splittable_warc",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS smallest FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(flatten(list_transform(range(8), lambda i: list_transform([15, 10, 5, 0],
    lambda b: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(('0x' || substr(h, i * 5 + 1, 5))::BIGINT >> b & 31 AS BIGINT) + 1]))), '') AS payload_digest,
  CASE WHEN smallest IS NULL OR page_id = smallest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM smallest THEN smallest END AS refers_to
FROM g""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.warc import archived_pages

    return archived_pages(raw(spark, sf_dir, "pages"))


def _op12_sql() -> str:
    """The same search as a recursion over rows: a struct of cost, audit and text for each state."""
    new = "{{'c': {0}.c + {1}, 'a': {0}.a || '{2}', 't': {0}.t || {3}}}".format
    row, line = "role || ':' || text || chr(10)", "'{}:' || text || chr(10)".format
    stay = "CASE WHEN gone THEN 1000000 WHEN cut THEN {} ELSE {} END".format

    def keep(x: str, initial: str) -> str:
        return new(x, f"(CASE WHEN left(role, 1) = '{initial}' THEN {stay(3, 0)} ELSE 1000000 END)", "K", row)

    def rerole(x: str, role: str) -> str:
        return new(x, f"({stay(6, 3)})", "R", line(role))

    def gone(x: str) -> str:
        return new(x, "4", "D", "''")

    def put(x: str, role: str) -> str:
        return new(x, "3", "I", f"'{role}:' || chr(10)")

    to_user = ", ".join(f"{keep(x, 'u')}, {rerole(x, 'user')}" for x in ("n", "s", "a"))
    users = ", ".join(put(x, "user") for x in ("n", "s", "a"))
    never = "{'c': 1000000, 'a': '', 't': ''}"
    name = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    space = "\\x20\\x09-\\x0D"
    return f"""
WITH RECURSIVE x AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(name)} % 20 AS what FROM conversations
), y AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN what = 1 THEN '' WHEN what = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(0, CASE WHEN what = 3 THEN 2 ELSE 1 END)) FROM x WHERE what <> 0)
), z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM y),
f AS (
  SELECT *, NOT regexp_matches(text, '[^{space}]') AS blank, k > min(k) OVER (PARTITION BY conv_id, role, text) AS again,
    NOT regexp_matches(text, '[.!?][{space}]*$') AS short, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair FROM z
), d AS (SELECT *, blank OR again AS gone, short AND NOT blank AND NOT again AS cut FROM f),
e AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, CAST(count_if(blank) AS BIGINT) AS blank, CAST(count_if(again AND NOT blank) AS BIGINT) AS duplicate,
    CAST(count_if(cut) AS BIGINT) AS truncated, CAST(count_if(pair NOT IN ('su', 'ua', 'au')) AS BIGINT) AS illegal, max(k) AS n FROM d GROUP BY 1
), r AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, {{'c': 0, 'a': '', 't': ''}} AS n, {never} AS s,
    {{'c': 3, 'a': 'I', 't': 'user:' || chr(10)}} AS u, {{'c': 6, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS a FROM e
  UNION ALL
  SELECT conv_id, k, n, s, u, least(a, {put("u", "assistant")}) AS a FROM (
    SELECT conv_id, k, n, s, a, least(u, {users}) AS u FROM (
      SELECT r.conv_id, d.k, {gone("n")} AS n, least({gone("s")}, {keep("n", "s")}) AS s, least({gone("u")}, {to_user}) AS u,
        least({gone("a")}, {keep("u", "a")}, {rerole("u", "assistant")}) AS a
      FROM r JOIN d ON d.conv_id IS NOT DISTINCT FROM r.conv_id AND d.k = r.k + 1))
), b AS (SELECT e.*, least(r.n, r.a) AS best FROM e JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.k = e.n)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id"""


@_query("op12_audit_repair", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.audit import audited_damage

    return audited_damage(raw(spark, sf_dir, "conversations"))
