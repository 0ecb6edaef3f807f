"""Named queries of this package, with SQL twins where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import session
from waymark.llm import balance, contexts, idfiles, linechunks, pieces, prefixes, rules, severity, sketches, spelling, subvectors, suffixes, tiling

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op1_merge_dropout")
def op1_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text under merge-dropout 0.1, and whether decoding gives it back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode(docs, piece_model(), drop=0.1, seed=20)
    return out.select("doc_id", "n_pieces", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"), "piece_ids")


@query("op2_decision_list")
def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *rules.BASE, "base_failed", "kept")


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS x
  FROM d
), e AS (SELECT doc_id, len(x) AS n, unnest(x) AS g FROM s),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM shared WHERE 100 * n >= 75 * (na + nb - n)
), two AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
walk AS (
  SELECT doc_id AS node, doc_id AS root FROM s
  UNION
  SELECT two.b, walk.root FROM walk JOIN two ON two.a = walk.node
), c AS (SELECT node, min(root) AS component_id FROM walk GROUP BY node)
SELECT s.doc_id, CAST(len(s.x) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c ON c.node = s.doc_id
"""


@query("op3_fast_sketch", OP3_SQL)
def op3_fast_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_id_files")
def op4_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = session.fresh_dir(spark, "ids")
    manifest = idfiles.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return idfiles.read(manifest, folder, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op5_string_tiling")
def op5_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they leak."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = tiling.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.coverage", "x.n_tiles")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, list_transform(ls, lambda x: CAST('0x' || substr(md5(x), 1, 7) AS BIGINT)) AS hs FROM d),
e AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: (hs[i] * 31 + coalesce(CASE WHEN i > 1 THEN hs[i - 1] END, 0)) % 1000003 % 4 = 0 OR i = len(ls)) AS ends FROM h),
c AS (
  SELECT doc_id, ls, ends, unnest(range(1, len(ends) + 1)) AS k FROM e
), p AS (
  SELECT doc_id, k, ls[coalesce(CASE WHEN k > 1 THEN ends[k - 1] END, 0) + 1 : ends[k]] AS part FROM c
), r AS (
  SELECT *, len(part) > 1 AND len(list_filter(part, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) > 1 AS multi, array_to_string(part, chr(10)) AS chunk FROM p
), g AS (
  SELECT *, multi AND row_number() OVER (PARTITION BY multi, chunk ORDER BY doc_id, k) > 1 AS gone FROM r
), s AS (
  SELECT doc_id, sum(CASE WHEN gone THEN len(part) ELSE 0 END) AS n_removed_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n_removed_chunks, sum(len(part)) AS n_lines,
    md5(coalesce(string_agg(CASE WHEN NOT gone THEN chunk END, chr(10) ORDER BY k), '')) AS kept_md5
  FROM g GROUP BY doc_id
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed_lines AS BIGINT) AS n_removed_lines, CAST(n_removed_chunks AS BIGINT) AS n_removed_chunks, kept_md5 FROM s
UNION ALL SELECT doc_id, 0, 0, 0, NULL FROM documents WHERE text IS NULL
"""


@query("op6_line_chunks", OP6_SQL)
def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linechunks.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


@query("op7_difference_cover")
def op7_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op8_label_propagation")
def op8_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.shard(table(spark, sf_dir, "documents"))


@query("op9_ordinal_severity")
def op9_ordinal_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, and whether it is toxic at all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = severity.score(docs, severity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "severity", "toxic")


@query("op10_context_bootstrap")
def op10_context_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contexts.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(contexts.digest("base_spans"), 256).alias("base_sha256"), contexts.digest("spans").alias("spans"), "n_found"
    )


OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents
), marked AS (
  SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h
  FROM marked, crc_table
), vocabulary AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS BIGINT) AS i FROM vocabulary)
), pairs AS (
  SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, v.word FROM cuts c JOIN vocabulary v ON c.rest = v.word
  UNION SELECT v.word, c.word FROM cuts c JOIN vocabulary v ON c.rest = v.word
), ranked AS (
  SELECT p.word, a.n, p.near, b.n AS m, count(*) OVER (PARTITION BY p.word) AS n_near,
    row_number() OVER (PARTITION BY p.word ORDER BY b.n DESC, encode(p.near)) AS place
  FROM pairs p JOIN vocabulary a ON a.word = p.word JOIN vocabulary b ON b.word = p.near
), best AS (SELECT * FROM ranked WHERE place = 1),
forms AS (SELECT word, near AS form, m AS form_n FROM best WHERE m >= 2 * n),
walk AS (
  SELECT word, word AS last, 0 AS steps FROM vocabulary
  UNION ALL SELECT walk.word, forms.form, steps + 1 FROM walk JOIN forms ON forms.word = walk.last
), ends AS (SELECT word, max_by(last, steps) AS root FROM walk GROUP BY word)
SELECT v.word, f.form, e.root, v.n, CAST(coalesce(b.n_near, 0) AS BIGINT) AS n_near, f.form_n
FROM vocabulary v LEFT JOIN best b ON b.word = v.word LEFT JOIN forms f ON f.word = v.word JOIN ends e ON e.word = v.word
"""


@query("op11_sorted_variants", OP11_SQL)
def op11_sorted_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _op12_sql() -> str:
    near = "min(struct_pack(d := CAST(list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), c := c))"
    sql = """
WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings WHERE len(embedding) = 64
), kept AS MATERIALIZED (
  SELECT r, vec_id, [CAST(floor(64 * x) AS BIGINT) FOR x IN e] AS v FROM whole WHERE len([x FOR x IN e IF x IS NOT NULL AND isfinite(x)]) = 64
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), v) - 1 AS INTEGER) AS c, v AS w FROM kept
  ORDER BY c LIMIT 16
), """
    for k in range(3):
        sql += f"""a{k} AS MATERIALIZED (
  SELECT r, any_value(v) AS v, {near}.c AS c FROM kept, c{k} GROUP BY r
), s{k} AS (
  SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{k}) GROUP BY c, i
), m{k} AS (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS w FROM s{k} GROUP BY c
), c{k + 1} AS MATERIALIZED (
  SELECT c{k}.c, coalesce(m{k}.w, c{k}.w) AS w FROM c{k} LEFT JOIN m{k} ON m{k}.c = c{k}.c
), """
    return sql + f"""a3 AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, {near} AS near FROM kept, c3 GROUP BY r
)
SELECT vec_id, near.c AS cluster, near.d AS distance, CAST(sum(near.d) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.c = near.c
"""


@query("op12_subvector_centroids", _op12_sql())
def op12_subvector_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = subvectors.cluster(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", subvectors.digest("centroid").alias("centroid_sha256"))


@query("op13_prefix_bpe")
def op13_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = prefixes.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
