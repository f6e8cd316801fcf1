"""One query for each operator of this folder, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, langid, linededup, lm, mixing, pii, quality, secrets, simhash, tokens, trie, whiten
from .common import written


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held = langid.held_out(5, 1)
    counts = written(lm.word_counts(docs.filter(~held)), "counts")
    model = lm.vocabulary(counts)
    texts = lm.encoded(docs, model, {"held_out": held})
    model.net = lm.learned(texts.filter("not held_out"), model)
    return lm.scored(texts, model, counts, ("held_out",))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(_docs(spark, sf_dir))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(_docs(spark, sf_dir))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return pii.personal_data(docs, pii.fit(docs))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held = langid.held_out(4, 2)
    found = langid.predict(docs, langid.fit(docs.filter(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_docs(spark, sf_dir))


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _docs(spark, sf_dir), langid.held_out(4, 2)
    model = quality.fit(docs.filter(~held), spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held))
    return quality.scored(docs.select("doc_id", "text", held.alias("held_out")), model, ("doc_id", "held_out"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_nearest_vectors, op3_lm_score, op4_line_dedup, op5_token_ids, op6_personal_data, op7_simhash, op8_language, op9_secrets, op10_benchmark_leaks, op11_conversation_trie, op12_whitening, op13_quality)}

_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

OP1 = rf"""
WITH own AS (
  SELECT doc_id, source, CAST({_WORDS} AS BIGINT) AS size, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM own GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS INT)] AS w, 2 * source_size AS cap FROM sizes
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM weighed WINDOW b AS (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT max(level) AS final, min(cap / w) AS first_open FROM levels WHERE cap >= w * level
), plan AS (
  SELECT source, source_size, CASE WHEN final IS NULL OR cap / w < first_open THEN CAST(cap AS DOUBLE) ELSE least(w * final, CAST(cap AS DOUBLE)) END AS target FROM weighed, level
), needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM plan
)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN sum(size) OVER (PARTITION BY own.source ORDER BY h, size ROWS UNBOUNDED PRECEDING) - size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM own JOIN needs ON own.source IS NOT DISTINCT FROM needs.source
"""

OP2 = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND isfinite(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AND list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20
"""

OP4 = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents
), lines AS (
  SELECT doc_id, line, regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w, row_number() OVER (ORDER BY doc_id, line) AS pos FROM split
), keyed AS (
  SELECT doc_id, line, pos, len(w) AS n, array_to_string(w, ' ') AS k, w FROM lines
), first AS (
  SELECT k, n, min(pos) AS pos, any_value(w) AS w FROM keyed WHERE n > 0 GROUP BY k, n
), variants AS (
  SELECT k, n, pos, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM first WHERE n >= 5)
), replaced AS (
  SELECT k, pos, min(pos) OVER (PARTITION BY v, n, i) AS other FROM variants
), shortened AS (
  SELECT a.k AS ak, a.pos AS ap, b.k AS bk, b.pos AS bp FROM variants a JOIN first b ON a.v = b.k AND b.n = a.n - 1 AND b.n >= 5
), near AS (
  SELECT k FROM replaced WHERE other < pos UNION SELECT ak FROM shortened WHERE bp < ap UNION SELECT bk FROM shortened WHERE ap < bp
), judged AS (
  SELECT doc_id, line, coalesce(keyed.pos > first.pos, false) AS same, near.k IS NOT NULL AS near FROM keyed LEFT JOIN first ON keyed.k = first.k AND keyed.n = first.n LEFT JOIN near ON near.k = first.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (same) AS n_same, count(*) FILTER (near AND NOT same) AS n_near,
  coalesce(array_to_string(list(line ORDER BY line) FILTER (same OR near), ','), '') AS removed
FROM judged GROUP BY doc_id
"""



# The contract's base formats, as it has them; failing matches are dropped after the search.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS, _HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"


def _op9() -> str:
    quoted = lambda p: "'" + p.replace("*+", "*").replace("}+", "}").replace("'", "''") + "'"
    kinds = {"assign": _ASSIGN, "access": _ACCESS, "hex": _HEX} | secrets.WEAK
    each = " UNION ALL ".join(f"SELECT row, doc_id, '{k}' AS kind, string_split_regex(text, {quoted(p)}) AS g, regexp_extract_all(text, {quoted(p)}) AS v FROM t" for k, p in kinds.items())
    rank = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(secrets.ORDER))
    spans = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) {}, '')"
    key = " AND ".join(f"regexp_matches(value, {quoted(p)})" for p in secrets.KEY)
    return f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents), found AS ({each}
), each AS (
  SELECT row, doc_id, kind, unnest(g[1:len(v)]) AS gap, unnest(v) AS value, unnest(range(1, len(v) + 1)) AS i FROM found
), placed AS (
  SELECT doc_id, kind, value, CAST(sum(length(gap) + length(value)) OVER (PARTITION BY row, kind ORDER BY i ROWS UNBOUNDED PRECEDING) - length(value) AS BIGINT) AS s FROM each
), parts AS (
  SELECT doc_id, kind, s, s + length(value) AS e, CASE kind {rank} END AS k, CASE WHEN kind IN ('access', 'ident') THEN 'identifier' WHEN kind = 'endpoint' THEN 'endpoint' ELSE 'secret' END AS role,
    kind IN ('assign', 'access', 'hex') AS base FROM placed
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(value, {quoted(_ASSIGN)}, 1)) >= 6 WHEN 'access' THEN length(value) >= 20 WHEN 'hex' THEN length(value) >= 24 WHEN 'key' THEN {key} ELSE true END
), near AS (
  SELECT w.doc_id, w.kind, w.s, w.e, w.k, bool_or(p.role = 'identifier') AS i, bool_or(p.role = 'endpoint') AS n, bool_or(p.role = 'secret') AS c FROM parts w JOIN parts p ON w.doc_id = p.doc_id AND NOT w.base
    AND p.s BETWEEN w.s - {secrets.SCOPE} AND w.e + {secrets.SCOPE} AND NOT (p.s >= w.s AND p.s < w.e) GROUP BY ALL
), every AS (
  SELECT doc_id, kind, s, e, k, base FROM parts WHERE base
  UNION ALL SELECT doc_id, kind, s, e, k, false FROM near WHERE CASE kind WHEN 'key' THEN i OR n WHEN 'ident' THEN c ELSE i AND c END
)
SELECT t.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256({spans.format("FILTER (base)")}) AS base_sha256, {spans.format("")} AS spans
FROM t LEFT JOIN every ON t.doc_id = every.doc_id GROUP BY t.doc_id"""


OP11 = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, conv_id - conv_id % 5 AS head, max(i) AS n,
    list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END) AS c
  FROM t GROUP BY conv_id
), plan AS (
  SELECT o.conv_id, o.head, xor(o.c, 4294967295) % 9 AS h, least(xor(o.c, 4294967295) % 9, coalesce(g.n, 0)) AS k FROM own o LEFT JOIN own g ON g.conv_id = o.head
), turns AS (
  SELECT p.conv_id, t.i - p.h + p.k AS d, role, text FROM t JOIN plan p ON p.conv_id = t.conv_id WHERE t.i > p.h
  UNION ALL SELECT p.conv_id, t.i, role, text FROM t JOIN plan p ON p.head = t.conv_id WHERE t.i <= p.k
), members AS (
  SELECT conv_id, d, strlen(text) AS bytes, string_agg(md5(role || chr(1) || text), '/') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM plan
), ended AS (
  SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS last, lag(path) OVER (PARTITION BY conv_id ORDER BY d) AS up FROM members
), nodes AS (
  SELECT path, d, any_value(up) AS up, min(conv_id) AS rep, count(*) AS n_convs, max(bytes) AS bytes, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM ended GROUP BY path, d
), children AS (SELECT up AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY up
), below AS (
  SELECT m.path, count(*) FILTER (c.path IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
  FROM nodes n JOIN members m ON m.conv_id = n.rep AND m.d <= n.d LEFT JOIN children c ON c.path = n.path GROUP BY m.path
)
SELECT n.rep AS conv_id, CAST(n.d AS BIGINT) AS depth, p.rep AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.path = n.path LEFT JOIN children c ON c.path = n.path LEFT JOIN nodes p ON n.d > 0 AND p.path = n.up
"""

ORACLES = {"op1_mix_sources": OP1, "op2_nearest_vectors": OP2, "op4_line_dedup": OP4, "op9_secrets": _op9(), "op11_conversation_trie": OP11}
