"""One query per operator over the given tables, with SQL to compare against where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm import bpe, factorization, lsh_search, merkle, mixing, outliers, pii_bootstrap, sharded_lloyd, simhash, token_counts, url_rules, warc, winnow
from themeloom.llm.common import WORD, table, word_count, written
from themeloom.session import checkpoint_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


#: Vocabulary of op1 and of the pipeline's last stage.
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"


@query("op1_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(docs)


def bpe_digests(docs: DataFrame, pieces: int = bpe.PIECES, kept: bool = True) -> DataFrame:
    """Encode and decode ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path, pattern = public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN
    return bpe.round_trip(docs, path, pattern, pieces=pieces, kept=kept).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


#: Weights of sources in code-point order, the share of all sizes to mix, and the most passes over a source.
MIX_WEIGHTS, MIX_SHARE, MIX_MOST = [3, 1, 2], 1.5, 2

_SQL_WORDS = f"len(regexp_extract_all(coalesce(text, ''), '{WORD}'))"
MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, {{words}}::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) AS place FROM s),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM p),
l AS (SELECT *, source_size * 2.0::DOUBLE / weight AS stop, (sum(source_size) OVER ()) * 1.5::DOUBLE AS budget,
        coalesce(sum(source_size * 2) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
        sum(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w),
v AS (SELECT *, (budget - stopped) / open_weight::DOUBLE AS level FROM l),
t AS (SELECT source, place, source_size, CASE WHEN shared IS NULL THEN source_size * 2.0::DOUBLE ELSE least(source_size * 2.0::DOUBLE, shared * weight) END AS target
      FROM (SELECT *, (SELECT level FROM v WHERE stop > level ORDER BY stop, place LIMIT 1) AS shared FROM v)),
q AS (SELECT d.*, t.place, t.source_size, t.target, md5(coalesce(doc_id::VARCHAR, '')) AS h,
        sum(size) OVER (PARTITION BY t.place ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS sofar
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, (turn * source_size + sofar)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) x(turn) WHERE size > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, place, turn, h, sofar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM e),
k AS (SELECT place, sofar, h, count(*) AS passes FROM r WHERE run <= (SELECT sum(target) FROM t) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.passes, 0)::BIGINT * q.size AS taken, coalesce(k.passes, 0)::BIGINT AS passes
FROM q LEFT JOIN k ON q.place = k.place AND q.sofar = k.sofar AND q.h = k.h AND q.size > 0
""".replace("{words}", _SQL_WORDS)


@query("op4_fair_queueing", MIX_SQL)
def fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    mixed = mixing.mix(sizes, MIX_WEIGHTS, MIX_SHARE, MIX_MOST)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "passes")


@query("op8_simhash_pivots")
def simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op10_winnowed_lines")
def winnowed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines and deleted lines, and the digest of what stays of each text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    clean = winnow.dedup_lines(docs)
    return clean.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op3_mcd_outliers")
def mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    counted = written(outliers.with_counts(docs).drop("text"))
    judged = outliers.judge(counted, counted)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *names, "base_failed", "kept", "distance")


#: Rules of op5: host, path, action.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
_SQL_RULES = ", ".join(f"('{host}', '{path}', '{action}')" for host, path, action in URL_RULES)
URL_SQL = rf"""
WITH RECURSIVE c AS (SELECT url AS a, regexp_extract(unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')), '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM pages
  UNION ALL SELECT url, regexp_extract(unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')), '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM pages),
g AS (SELECT a, replace(t, '&amp;', '&') AS t, regexp_extract(a, '^([^:/?#]+://[^/?#]*)', 1, 's') AS site, regexp_extract(a, '^([^?#]*)', 1, 's') AS page FROM c WHERE a IS NOT NULL),
e AS (SELECT DISTINCT a, CASE WHEN contains(t, '://') THEN t
  WHEN t = '' OR starts_with(t, '#') OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') OR site = '' THEN NULL
  WHEN starts_with(t, '//') THEN split_part(a, '://', 1) || ':' || t WHEN starts_with(t, '/') THEN site || t WHEN starts_with(t, '?') THEN page || t
  ELSE site || CASE WHEN contains(substr(page, length(site) + 1), '/') THEN regexp_extract(substr(page, length(site) + 1), '^(.*/)', 1, 's') ELSE '/' END || t END AS b FROM g),
p AS (SELECT url, lower(ascii_host) AS host, path FROM (
    SELECT *, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1, 's') ELSE '' END AS ascii_host,
      CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
    FROM (SELECT url FROM pages UNION SELECT b FROM e WHERE b IS NOT NULL))),
r AS (SELECT * FROM (VALUES {_SQL_RULES}) v(rhost, rpath, action)),
m AS (SELECT url, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
      FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY url),
b AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e WHERE b IS NOT NULL UNION ALL SELECT b, a FROM e WHERE b IS NOT NULL)),
n AS (SELECT a AS url, a AS other FROM b UNION SELECT n.url, b.b FROM n JOIN b ON n.other = b.a),
s AS (SELECT n.url, bool_or(m.action = 'allow') AS allowed FROM n JOIN m ON n.other = m.url GROUP BY n.url)
SELECT d.page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, m.rule, CASE WHEN m.action IS NOT NULL THEN m.action WHEN s.allowed = false THEN 'block' ELSE 'allow' END AS verdict
FROM pages d LEFT JOIN p ON d.url = p.url LEFT JOIN m ON d.url = m.url LEFT JOIN s ON d.url = s.url
"""


@query("op5_redirect_equivalence", URL_SQL)
def redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rules = spark.sql(f"SELECT * FROM VALUES {_SQL_RULES} AS rules(host, path, action)")
    judged = url_rules.judge(pages.drop("html"), rules, url_rules.alias_edges(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


_BASE32 = " || ".join(f"translate(to_base(('0x' || substr(h, {5 * i + 1}, 5))::BIGINT, 32, 4), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')" for i in range(8))
WARC_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""


@query("op2_warc_chunks", WARC_SQL)
def warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_folder(spark)}/archives-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc.verified(warc.read_records(spark, path))
    return found.select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


PIECE_BPE, TOKEN_LIMIT = "piece_bpe_32k.model", 4096


@query("op7_pretoken_counts")
def pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op6_multiprobe_search")
def multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_search.search(table(spark, sf_dir, "embeddings"), F.col("key") % 100 == 0)


@query("op9_bootstrapped_pii")
def bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.find(table(spark, sf_dir, "documents"))


MANIFEST_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
#: CRC-32 of a decimal number, bit by bit.
_SQL_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""
_SQL_LEAF = "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
MANIFEST_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_SQL_LEAF.replace("{n}", "n_chars")} AS leaf,
    {_SQL_LEAF.replace("{n}", f"(n_chars + CASE WHEN {_SQL_CRC} % 7 = 0 THEN 1 ELSE 0 END)")} AS altered FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (SELECT 0 AS level, g, i, n, leaf AS h FROM o
  UNION ALL SELECT level + 1, g, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY level, g, i // 2, n),
s AS (SELECT g, level AS height, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, i, n, h FROM s
  UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 2, n),
step AS (
  SELECT o.g, o.i, t.level AS level, t.i % 2 AS side, x.h AS sibling FROM o JOIN t ON t.g = o.g AND t.i = o.i >> t.level AND t.n > 1
    LEFT JOIN t x ON x.g = t.g AND x.level = t.level AND x.i = xor(t.i, 1)
  UNION ALL
  SELECT o.g, o.i, s.height + u.level, u.i % 2, x.h FROM o JOIN s ON s.g = o.g JOIN u ON u.i = s.i >> u.level AND u.n > 1
    LEFT JOIN u x ON x.level = u.level AND x.i = xor(u.i, 1)),
proof AS (SELECT g, i, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256 FROM o LEFT JOIN step USING (g, i) GROUP BY g, i),
fold AS (SELECT g, i, 0 AS level, altered AS h FROM o
  UNION ALL SELECT f.g, f.i, f.level + 1, sha256(CASE WHEN side = 1 THEN coalesce(sibling, '') || f.h ELSE f.h || coalesce(sibling, '') END)
    FROM fold f JOIN step s ON s.g = f.g AND s.i = f.i AND s.level = f.level),
folded AS (SELECT g, i, arg_max(h, level) AS folded_root FROM fold GROUP BY g, i)
SELECT o.doc_id, o.leaf, s.h AS subroot, u.h AS root, proof_sha256, folded_root, folded_root = u.h AS verified
FROM o JOIN s ON s.g = o.g JOIN u ON u.n = 1 JOIN proof p ON p.g = o.g AND p.i = o.i JOIN folded f ON f.g = o.g AND f.i = o.i
"""


@query("op11_merkle_manifest", MANIFEST_SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents; where 7 divides the checksum of doc_id, n_chars is found one too high."""
    docs = table(spark, sf_dir, "documents")
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = F.when(altered, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    columns = [F.col(name) for name in MANIFEST_COLUMNS]
    seen = [found if name == "n_chars" else F.col(name) for name in MANIFEST_COLUMNS]
    proven = merkle.manifest(docs, "doc_id", "lang", columns, seen)
    return proven.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


CENTROIDS, ROUNDS = 16, 3
_SQL_NEAREST = """a{r} AS MATERIALIZED (SELECT vec_id, row, v, least.c AS c, least.dist AS dist FROM (SELECT vec_id, row, v,
    min({{'dist': list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c}}) AS least FROM x, c{r} GROUP BY vec_id, row, v))"""
_SQL_MEANS = """c{n} AS MATERIALIZED (SELECT c, coalesce(m, w) AS w FROM c{r} LEFT JOIN (
    SELECT c, list(value ORDER BY place) AS m FROM (SELECT c, place, floor_div AS value FROM (
      SELECT c, place, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
      FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{r}) GROUP BY c, place)) GROUP BY c) USING (c))"""
LLOYD_SQL = f"""
WITH x AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::HUGEINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), v) - 1 AS c, v AS w FROM x QUALIFY c < {CENTROIDS}),
{", ".join(_SQL_NEAREST.format(r=r) + ", " + _SQL_MEANS.format(r=r, n=r + 1) for r in range(ROUNDS))},
{_SQL_NEAREST.format(r=ROUNDS)}
SELECT vec_id, c::INT AS cluster, dist AS distance, sum(dist) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(dist) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} USING (c)
"""


@query("op13_sharded_lloyd", LLOYD_SQL)
def sharded_lloyd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded_lloyd.cluster(table(spark, sf_dir, "embeddings"), k=CENTROIDS, rounds=ROUNDS, dims=64, scale=64, seed=1)


@query("op12_factorization_machine")
def factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from at most 20,000 of the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return factorization.classify(docs, table(spark, sf_dir, "labels"), folds=5, threshold=0.3, most=20_000)
