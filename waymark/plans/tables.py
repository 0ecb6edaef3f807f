"""Item, path, access and relation shapes derived from the star-schema tables,
each with the same derivation as a SQL fragment for the cross-check."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import fast
from waymark.operators.index import item_features
from waymark.operators.postings import text_index
from waymark.operators.routes import route_index
from waymark.session import fresh_dir

FILE_SEQ = 1_000_000_000_000
ENDPOINT_SEQ = 2_000_000_000_000

PART_TYPES = {
    "ECONOMY": "class",
    "STANDARD": "interface",
    "PROMO": "enum",
    "MEDIUM": "method",
    "SMALL": "function",
    "LARGE": "property",
}


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


URL_PATH = "regexp_extract(url, '^https?://[^/]+([^?#]*)', 1)"
URL_HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"
URL_TEMPLATE = (
    f"concat(if(startswith({URL_PATH}, '/de/'), '[POST] ', '[GET] '), "
    f"regexp_replace({URL_PATH}, '[0-9]+', '{{id}}'))"
)
PART_TYPE = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PART_TYPES.items()) + " END"


def part_items(spark, sf) -> DataFrame:
    rel = "concat('src/', p_brand, '/', p_partkey, '.ts')"
    return load(spark, sf, "part").selectExpr(
        "p_partkey as seq", "concat('part:', p_partkey) as id", "p_name as name", f"{PART_TYPE} as type",
        f"concat('/', {rel}) as file_path", f"{rel} as relative_path", "p_size as line", "0 as col",
        "p_brand as container", "concat(p_brand, '.', p_name) as full_name", "p_type as detail",
        "cast(null as string) as command_id", "cast(null as bigint) as size",
    )


def document_paths(spark, sf) -> DataFrame:
    """`documents` with a relative path and an absolute one."""
    rel = "concat(source, '/', lang, '/', doc_id, '.txt')"
    return load(spark, sf, "documents").selectExpr(
        "*", f"{rel} as relative_path", f"concat('/', {rel}) as file_path"
    )


def document_items(spark, sf) -> DataFrame:
    return document_paths(spark, sf).selectExpr(
        f"{FILE_SEQ} + doc_id as seq", "concat('file:', file_path) as id", "concat(doc_id, '.txt') as name",
        "'file' as type", "file_path", "relative_path", "cast(null as int) as line", "cast(null as int) as col",
        "cast(null as string) as container", "relative_path as full_name", "relative_path as detail",
        "cast(null as string) as command_id", "n_chars as size",
    )


def endpoint_items(spark, sf) -> DataFrame:
    return load(spark, sf, "pages").selectExpr(
        f"{ENDPOINT_SEQ} + page_id as seq", "concat('endpoint:', page_id) as id", f"{URL_TEMPLATE} as name",
        "'endpoint' as type", "concat('/pages/', page_id, '.html') as file_path",
        "concat('pages/', page_id, '.html') as relative_path", "cast(null as int) as line",
        "cast(null as int) as col", f"{URL_HOST} as container", f"concat({URL_HOST}, {URL_PATH}) as full_name",
        "cast(null as string) as detail", "cast(null as string) as command_id", "cast(null as bigint) as size",
    )


def items(spark, sf) -> DataFrame:
    return (
        part_items(spark, sf)
        .unionByName(document_items(spark, sf))
        .unionByName(endpoint_items(spark, sf))
    )


def features(spark, sf) -> DataFrame:
    return item_features(items(spark, sf))


_STORED: dict = {}


def stored(spark, sf, name: str, build, spread: str | None = None, sort: tuple = ()) -> DataFrame:
    """A derived table written once per session and data set to the shared folder.

    An index is built once and searched many times; searches then read only the
    columns they need.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        path = fresh_dir(spark, name)
        df = build(spark, sf)
        if spread:
            # Even files, whatever the sources look like; sorted inside, so that
            # row-group statistics let a scoped search skip the other scopes.
            n = spark.sparkContext.defaultParallelism
            df = df.repartition(n, spread).sortWithinPartitions(*sort)
        df.write.parquet(path)
        _STORED[key] = (path, df.schema)
    path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path)


def index(spark, sf) -> DataFrame:
    """The stored feature table of all items."""
    return stored(spark, sf, "index", features, "id", ("scope", "seq"))


def route_keys(spark, sf) -> DataFrame:
    """The stored route keys of all endpoints."""
    return stored(spark, sf, "routes", lambda s, d: route_index(index(s, d).filter("scope = 'endpoints'")))


_GRAMS: dict = {}


def _grams(spark, sf, name: str, build):
    """A gram index built once per session and data set."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _GRAMS:
        _GRAMS[key] = build()
    return _GRAMS[key]


def name_grams(spark, sf):
    """Posting lists of the names and full names of all items."""
    return _grams(spark, sf, "names", lambda: fast.name_grams(index(spark, sf)))


def text_grams(spark, sf):
    """Posting lists of the lines of all documents."""
    docs = document_paths(spark, sf).selectExpr("doc_id as seq", "file_path", "octet_length(text) as size", "text")
    return _grams(spark, sf, "texts", lambda: text_index(docs))


QUERIES = [
    (1, "ring", "everything", 10),
    (2, "smring", "everything", 10),
    (3, "blue bolt", "everything", 20),
    (4, "Brand#4", "types", 10),
    (5, "zebra", "everything", 10),
    (6, "gear:12", "symbols", 5),
    (7, "   ", "everything", 10),
    (8, "GET /en/676", "endpoints", 10),
    (9, "en/97", "everything", 20),
    (10, "src3", "files", 20),
    (11, "rdwdg", "properties", 10),
    (12, "en/4.ht", "everything", 15),
    (13, "widget", "open", 10),
    (14, "97", "open", 10),
    (15, "txt", "modified", 7),
]
QUERIES_DDL = "qid int, query string, scope string, max_results int"


def queries(spark, sf=None) -> DataFrame:
    return spark.createDataFrame(QUERIES, QUERIES_DDL)


def open_files(spark, sf) -> DataFrame:
    """Documents of good quality count as open."""
    good = load(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return document_paths(spark, sf).join(good, "doc_id", "left_semi").select("file_path")


def modified_files(spark, sf) -> DataFrame:
    bad = load(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return document_paths(spark, sf).join(bad, "doc_id", "left_semi").select("file_path")


def accesses(spark, sf) -> DataFrame:
    """Events as accesses of the item whose number is the user's."""
    return load(spark, sf, "events").select(
        F.concat(F.lit("part:"), F.col("user_id")).alias("item_id"), "ts", "event_id", "event_type"
    )


def as_of(spark, sf):
    """The latest event time, as a scalar."""
    return load(spark, sf, "events").agg(F.max("ts")).scalar()


# ------------------------------------------------------------------ SQL twins

PATH_SQL = "regexp_extract(url, '^https?://[^/]+([^?#]*)', 1)"
TEMPLATE_SQL = (
    f"(CASE WHEN starts_with({PATH_SQL}, '/de/') THEN '[POST] ' ELSE '[GET] ' END) "
    f"|| regexp_replace({PATH_SQL}, '[0-9]+', '{{id}}', 'g')"
)
SCOPE_SQL = """CASE WHEN type IN ('class','interface','enum') THEN 'types'
  WHEN type IN ('function','method') THEN 'symbols'
  WHEN type IN ('property','variable') THEN 'properties'
  WHEN type = 'file' THEN 'files' WHEN type = 'endpoint' THEN 'endpoints'
  WHEN type = 'text' THEN 'text' WHEN type = 'command' THEN 'commands' ELSE 'everything' END"""
BOOST_SQL = """CASE type WHEN 'class' THEN 1.5::DOUBLE WHEN 'interface' THEN 1.35 WHEN 'enum' THEN 1.3
  WHEN 'function' THEN 1.25 WHEN 'method' THEN 1.25 WHEN 'property' THEN 1.1 WHEN 'variable' THEN 1.0
  WHEN 'file' THEN 0.9 WHEN 'text' THEN 0.7 WHEN 'command' THEN 1.2 WHEN 'endpoint' THEN 1.4 ELSE 1.0 END"""

DOC_PATHS_SQL = """doc_paths AS (SELECT *, source||'/'||lang||'/'||doc_id||'.txt' AS relative_path,
  '/'||source||'/'||lang||'/'||doc_id||'.txt' AS file_path FROM documents)"""

ITEMS_SQL = f"""{DOC_PATHS_SQL},
items AS (
  SELECT p_partkey::BIGINT AS seq, 'part:'||p_partkey AS id, p_name AS name, {PART_TYPE} AS type,
    '/src/'||p_brand||'/'||p_partkey||'.ts' AS file_path, 'src/'||p_brand||'/'||p_partkey||'.ts' AS relative_path,
    p_size::INTEGER AS line, 0 AS col, p_brand AS container, p_brand||'.'||p_name AS full_name, p_type AS detail,
    NULL::BIGINT AS size FROM part
  UNION ALL
  SELECT {FILE_SEQ} + doc_id, 'file:'||file_path, doc_id||'.txt', 'file', file_path, relative_path, NULL, NULL, NULL,
    relative_path, relative_path, n_chars FROM doc_paths
  UNION ALL
  SELECT {ENDPOINT_SEQ} + page_id, 'endpoint:'||page_id, {TEMPLATE_SQL}, 'endpoint',
    '/pages/'||page_id||'.html', 'pages/'||page_id||'.html', NULL, NULL,
    regexp_extract(url, '^https?://([^/]+)', 1), regexp_extract(url, '^https?://([^/]+)', 1) || {PATH_SQL}, NULL, NULL
  FROM pages)"""


def mask_sql(expr: str) -> str:
    return f"""coalesce(list_aggregate(list_transform(list_filter(str_split(lower(strip_accents({expr})), ''),
      lambda ch: ch <> '' AND ch <> ' '), lambda ch: CASE
      WHEN ch BETWEEN 'a' AND 'z' AND ascii(ch) < 128 THEN 1::BIGINT << (ascii(ch) - 97)
      WHEN ch BETWEEN '0' AND '9' AND ascii(ch) < 128 THEN 1::BIGINT << 26
      WHEN strlen(ch) = 1 THEN 1::BIGINT << 30 ELSE 1::BIGINT << 31 END), 'bit_or'), 0::BIGINT)"""


def fold_sql(expr: str) -> str:
    return f"lower(strip_accents({expr}))"


FEATURES_SQL = f"""{ITEMS_SQL},
features AS (
  SELECT *, {SCOPE_SQL} AS scope, {fold_sql('name')} AS name_low,
    CASE WHEN full_name <> name AND full_name IS DISTINCT FROM relative_path THEN {fold_sql('full_name')} END AS full_low,
    {fold_sql("replace(relative_path, chr(92), '/')")} AS path_low,
    {mask_sql('name')} AS name_mask,
    {mask_sql('name')} | {mask_sql("coalesce(full_name,'')")} | {mask_sql("coalesce(relative_path,'')")} AS item_mask
  FROM items)"""

QUERIES_SQL = (
    "queries(qid, query, scope, max_results) AS (VALUES "
    + ", ".join(f"({i}, '{q}', '{s}', {k})" for i, q, s, k in QUERIES)
    + ")"
)

VERBS_SQL = "GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD|TRACE"


def potential_url_sql(q: str) -> str:
    return (
        f"(length(trim({q})) >= 2 AND ((NOT contains(trim({q}), ' ') AND contains(trim({q}), '/')) OR "
        f"regexp_matches(trim({q}), '^(?i:{VERBS_SQL}) +[/A-Za-z0-9_]')))"
    )


def clean_path_sql(q: str) -> str:
    return (
        f"regexp_replace(regexp_replace(trim(regexp_replace(trim({q}), '^(?i:{VERBS_SQL}) (.)', '\\1')), '/$', ''), '^/', '')"
    )


CONTEXT_SQL = f"""{QUERIES_SQL},
context0 AS (
  SELECT qid, scope AS q_scope, max_results AS k,
    CASE WHEN regexp_matches(trim(query), '^.*?:[0-9]+$') THEN regexp_extract(trim(query), '^(.*?):([0-9]+)$', 1)
      ELSE trim(query) END AS q_text,
    CASE WHEN regexp_matches(trim(query), '^.*?:[0-9]+$')
      THEN nullif(regexp_extract(trim(query), '^(.*?):([0-9]+)$', 2)::INTEGER, 0) - 1 END AS target_line
  FROM queries),
context AS (
  SELECT *, {fold_sql('q_text')} AS q_low,
    list_filter(str_split({fold_sql('q_text')}, ''), lambda ch: ch <> '' AND ch <> ' ') AS q_chars,
    {mask_sql('q_text')} AS q_mask,
    {potential_url_sql('q_text')} AND q_scope IN ('everything','endpoints') AS is_url,
    nullif(upper(regexp_extract(q_text, '^(?i:({VERBS_SQL})) .', 1)), '') AS q_verb,
    lower({clean_path_sql('q_text')}) AS q_path
  FROM context0 WHERE trim(q_text) <> '')"""


def score_sql(q: str, chars: str, t: str) -> str:
    """The fuzzy score; the scattered arm uses a lazy regular expression."""
    pat = (
        f"('(?s)^.*?' || array_to_string(list_transform({chars}, lambda ch: '\\Q' || ch || '\\E'), '.*?'))"
    )
    last = f"length(regexp_extract({t}, {pat}))"
    n, m, k = f"length({q})", f"length({t})", f"len({chars})"
    return f"""CASE WHEN {t} IS NULL THEN NULL WHEN {t} = {q} THEN 1.0::DOUBLE
      WHEN contains({t}, {q}) THEN 0.70::DOUBLE + 0.25::DOUBLE * {n} / {m} + CASE WHEN starts_with({t}, {q}) THEN 0.04::DOUBLE ELSE 0 END
      WHEN {last} > 0 THEN 0.6::DOUBLE * {k} / ({last} - instr({t}, {chars}[1]) + 1) * (0.5::DOUBLE + 0.5::DOUBLE * {k} / {m}) END"""


# Route score of every path-like query on every endpoint, written as the
# definition reads: full expression first, then alignment from the end.
def route_score_sql(paths: str, path_cols: str, templates: str, seq: str, name: str) -> str:
    """CTEs `tmpl` and `route` for `paths(path_cols.., p_path)`; p_path is lower case."""
    return f"""tmpl AS (
  SELECT {seq} AS t_seq, {name} AS t_name,
    nullif(regexp_extract(trim({name}), '^\\[([A-Z]+)\\]', 1), '') AS t_verb,
    regexp_replace(regexp_replace(trim(regexp_replace(trim({name}), '^\\[[A-Z]+\\] *', '')), '/$', ''), '^/', '') AS t_clean
  FROM {templates}),
tmpl2 AS (SELECT *, str_split(lower(t_clean), '/') AS t_segs,
    '(?i)^' || regexp_replace(regexp_replace(regexp_replace(t_clean, '([.+?^$()|\\[\\]\\\\])', '\\\\\\1', 'g'),
      '\\{{\\*[^}}]*\\}}', '(.*)', 'g'), '\\{{[^}}]*\\}}', '([^/]+)', 'g') || '$' AS t_regex
  FROM tmpl WHERE t_clean <> ''),
pairs AS (SELECT {path_cols}, p_path, str_split(p_path, '/') AS p_segs, t.* FROM {paths} p JOIN tmpl2 t ON p_path <> ''),
aligned AS (SELECT *, len(p_segs) AS np, len(t_segs) AS nt,
    list_transform(range(1, len(p_segs) + 1), lambda i: CASE
      WHEN len(p_segs) > len(t_segs) OR p_segs[i] = '' THEN -100::DOUBLE
      WHEN regexp_matches(t_segs[len(t_segs) - len(p_segs) + i], '^\\{{.*\\}}$') THEN 0.0::DOUBLE
      WHEN t_segs[len(t_segs) - len(p_segs) + i] = p_segs[i] THEN 0.1::DOUBLE
      WHEN i = len(p_segs) AND starts_with(t_segs[len(t_segs) - len(p_segs) + i], p_segs[i]) THEN 0.05::DOUBLE
      ELSE -100::DOUBLE END) AS bits
  FROM pairs),
route AS (SELECT *, CASE
    WHEN (contains(t_clean, '{{*') OR np = nt) AND regexp_matches(p_path, t_regex)
      THEN 2.0 + 0.1 * len(list_filter(t_segs[1:least(np, nt)], lambda s: NOT regexp_matches(s, '^\\{{.*\\}}$')))
    WHEN np <= nt AND list_sum(bits) > -1 THEN (CASE WHEN np = nt THEN 2.0 ELSE 1.0 END) + list_sum(bits)
    ELSE 0.0 END::DOUBLE AS route_score
  FROM aligned)"""
