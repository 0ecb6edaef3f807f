"""Queries on listings, filters and index build."""

from pyspark.sql import functions as F

from waymark.functions.fuzzy import highlights_text
from waymark.functions.text import (
    combine_routes,
    language_of,
    normalize_path,
    resolve_controller_token,
    uri_to_path,
)
from waymark.operators import build as bd
from waymark.operators import indexing as ixg
from waymark.plans import sources as src
from waymark.plans import tables as tb
from waymark.plans.registry import query
from waymark.session import fresh_dir, spread
from waymark.sources import corpus as cp

DOCS = tb.DOC_PATHS_SQL


@query(
    "file_items",
    f"WITH {DOCS} SELECT 'file:'||file_path AS id, doc_id||'.txt' AS name, 'file' AS type, file_path, relative_path, relative_path AS full_name, relative_path AS detail FROM doc_paths",
)
def file_items_query(spark, sf):
    return cp.file_items(tb.document_paths(spark, sf))


@query(
    "read_manifest",
    f"WITH {DOCS} SELECT '/ws/'||source AS root, '/ws/'||source||'/'||relative_path AS file_path FROM doc_paths UNION ALL SELECT '/ws/'||source, '/abs/'||doc_id FROM doc_paths",
)
def manifest_query(spark, sf):
    m = tb.document_paths(spark, sf).selectExpr(
        "concat('/ws/', source) as root", "concat(relative_path, '\\u0000', '/abs/', doc_id, '\\u0000') as text"
    )
    return cp.read_manifest(m)


GLOBS = ["**/en/**", "fr/*.html", "[c-d]e/?[0-4]*", "es/{1,2}*"]


@query(
    "exclude_globs",
    f"""WITH p AS (SELECT page_id, ltrim({tb.PATH_SQL}, '/') AS relative_path FROM pages)
    SELECT page_id, relative_path FROM p WHERE NOT (regexp_matches(relative_path, '^(.*/)?en/') OR regexp_matches(relative_path, '^fr/[^/]*\\.html$')
      OR regexp_matches(relative_path, '^[cd]e/[^/][0-4][^/]*$') OR regexp_matches(relative_path, '^es/[12][^/]*$'))""",
)
def globs_query(spark, sf):
    p = tb.load(spark, sf, "pages").selectExpr("page_id", f"ltrim('/', {tb.URL_PATH}) as relative_path")
    return cp.exclude_globs(p, GLOBS)


GENERATED_FORMS = """CASE lang WHEN 'de' THEN '.Designer.cs' WHEN 'fr' THEN '.g.i.cs' WHEN 'es' THEN '.designer.txt' ELSE '.cs' END"""


@query(
    "drop_generated_paths",
    f"""WITH p AS (SELECT doc_id, CASE WHEN source = 'src1' THEN '/Obj/' ELSE '/' || source || '/' END || doc_id || {GENERATED_FORMS} AS file_path FROM documents)
    SELECT doc_id, file_path FROM p WHERE NOT (ends_with(file_path, '.cs') AND (contains(lower(file_path), '/obj/') OR ends_with(file_path, '.Designer.cs') OR ends_with(file_path, '.g.i.cs')))""",
)
def generated_paths_query(spark, sf):
    p = tb.load(spark, sf, "documents").selectExpr(
        "doc_id", f"concat(if(source = 'src1', '/Obj/', concat('/', source, '/')), doc_id, {GENERATED_FORMS}) as file_path"
    )
    return cp.drop_generated_paths(p)


@query(
    "drop_generated_content",
    "SELECT doc_id FROM documents WHERE NOT (contains(text, 'icense') AND strlen(split_part(text, 'icense', 1)) + 6 <= 1024)",
)
def generated_content_query(spark, sf):
    return cp.drop_generated_content(tb.load(spark, sf, "documents"), "icense").select("doc_id")


@query(
    "drop_ignored",
    f"WITH {DOCS} SELECT file_path FROM doc_paths WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def ignored_query(spark, sf):
    files = tb.document_paths(spark, sf).select("file_path", "doc_id", "relative_path")
    # One verdict record per labelled document: toxic ones name a rule.
    verdicts = tb.load(spark, sf, "labels").join(files, "doc_id").selectExpr(
        "'/' as root",
        "concat(if(toxic = 1, '.gitignore\\u00003\\u0000*.txt', '\\u0000\\u0000'), '\\u0000', relative_path, '\\u0000') as text",
    )
    return cp.drop_ignored(files, verdicts).select("file_path")


@query(
    "modified_set",
    f"""WITH {DOCS} SELECT file_path FROM doc_paths WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)
    OR doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def modified_set_query(spark, sf):
    d = tb.document_paths(spark, sf)
    labels = tb.load(spark, sf, "labels")
    listed = lambda df, form: df.selectExpr("'/' as root", f"{form} as path")
    unstaged = listed(d.join(labels.filter("toxic = 1"), "doc_id", "left_semi"), "concat('./', relative_path)")
    staged = listed(d.join(labels.filter("quality = 0"), "doc_id", "left_semi"), "relative_path")
    untracked = listed(d.join(labels, "doc_id", "left_anti"), "file_path")
    return cp.modified_set(unstaged, staged, untracked)


# Match records of a log, one per conversation turn that holds the word.
@query(
    "read_match_log",
    r"""WITH t0 AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM conversations),
    t AS (SELECT conv_id, turn, role, i, repeat(' ', turn::INTEGER) || raw AS line FROM t0),
    m AS (SELECT *, strlen(split_part(line, 'en', 1)) AS s FROM t WHERE contains(line, 'en') AND role = 'user')
    SELECT '/c/' || conv_id AS path, (turn * 1000 + i)::INTEGER AS line, s::INTEGER AS "column", trim(line) AS text, 'en' AS match,
      greatest(0, s - turn) || '-' || greatest(0, s + 2 - turn) AS submatches FROM m""",
)
def match_log_query(spark, sf):
    t = tb.load(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "role", "posexplode(split(text, '\\n')) as (i, raw)"
    ).selectExpr("conv_id", "turn", "role", "i", "concat(repeat(' ', cast(turn as int)), raw) as line").filter("contains(line, 'en')")
    log = t.withColumn("at", F.expr("octet_length(substring_index(line, 'en', 1))")).selectExpr(
        """to_json(named_struct('type', if(role = 'user', 'match', 'context'), 'data', named_struct(
             'path', named_struct('text', concat('/c/', conv_id)), 'lines', named_struct('text', concat(line, '\\n')),
             'line_number', turn * 1000 + i + 1, 'submatches', array(named_struct('match', named_struct('text', 'en'), 'start', at, 'end', at + 2))))) as value"""
    )
    broken = tb.load(spark, sf, "conversations").selectExpr("text as value")
    out = cp.read_match_log(log.unionByName(broken))
    return out.withColumn("submatches", highlights_text("submatches"))


@query(
    "dump_index",
    f"WITH {tb.ITEMS_SQL} SELECT 'item' AS kind, id AS value FROM items UNION ALL SELECT 'path', file_path FROM (SELECT DISTINCT file_path FROM items WHERE type = 'file')",
)
def dump_query(spark, sf):
    path = fresh_dir(spark, "dump")
    cp.dump_index(tb.items(spark, sf), path)
    got = spark.read.parquet(f"{path}/items").selectExpr("'item' as kind", "id as value")
    return got.unionByName(spark.read.parquet(f"{path}/paths").selectExpr("'path' as kind", "file_path as value"))


# Two snapshots: labels decide what was added, removed, and (license lines) changed.
@query(
    "modified_since",
    f"""WITH {DOCS}, prev AS (SELECT file_path, text FROM doc_paths WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)),
    cur AS (SELECT file_path, CASE WHEN contains(text, 'icense') THEN text || '!' ELSE text END AS text FROM doc_paths
      WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
    SELECT coalesce(c.file_path, p.file_path) AS file_path, CASE WHEN p.text IS NULL THEN 'added' WHEN c.text IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM prev p FULL JOIN cur c USING (file_path) WHERE p.text IS DISTINCT FROM c.text""",
)
def snapshots_query(spark, sf):
    d = tb.document_paths(spark, sf)
    labels = tb.load(spark, sf, "labels")
    previous = d.join(labels.filter("quality = 1"), "doc_id", "left_anti")
    current = d.join(labels.filter("toxic = 1"), "doc_id", "left_anti").withColumn(
        "text", F.expr("if(contains(text, 'icense'), concat(text, '!'), text)")
    )
    return cp.snapshot_changes(previous, current)


# ------------------------------------------------------------------ path forms

@query("normalize_path", f"WITH {DOCS} SELECT doc_id, file_path AS path, lower(relative_path) AS folded, '/' || lang AS up FROM doc_paths")
def normalize_query(spark, sf):
    d = tb.load(spark, sf, "documents")
    return d.select(
        "doc_id",
        normalize_path(F.expr("concat('/', source, '/./x/..//', lang, '/', doc_id, '.txt')")).alias("path"),
        normalize_path(F.expr(r"concat(upper(source), '\\', lang, '\\', doc_id, '.TXT')"), fold_case=True).alias("folded"),
        normalize_path(F.expr("concat('/a/../../', source, '/../', lang, '/')")).alias("up"),
    )


@query(
    "relative_path",
    f"""WITH {DOCS} SELECT file_path, CASE WHEN starts_with(file_path, '/src1/de') THEN substr(file_path, 10) WHEN starts_with(file_path, '/src1/') THEN substr(file_path, 7)
      WHEN starts_with(file_path, '/src1') THEN '../' || substr(file_path, 2) ELSE file_path END AS relative FROM doc_paths""",
)
def relative_query(spark, sf):
    d = tb.document_paths(spark, sf)
    return d.select("file_path", bd.relative_path(F.col("file_path"), ["/src1/de", "/src1"]).alias("relative"))


@query(
    "uri_to_path",
    f"""WITH {DOCS} SELECT doc_id, '/a b+c' || file_path AS posix, 'c:' || file_path AS windows, 'http:/' || file_path AS other FROM doc_paths""",
)
def uri_query(spark, sf):
    d = tb.document_paths(spark, sf)
    return d.select(
        "doc_id",
        uri_to_path(F.concat(F.lit("file:///a%20b+c"), "file_path")).alias("posix"),
        uri_to_path(F.concat(F.lit("file:///c%3A"), "file_path")).alias("windows"),
        uri_to_path(F.concat(F.lit("http:/"), "file_path")).alias("other"),
    )


EXTENSION = "CASE lang WHEN 'en' THEN '.TS' WHEN 'de' THEN '.d.cxx' WHEN 'fr' THEN '.rb' ELSE '.txt' END"


@query(
    "language_of",
    "SELECT doc_id, CASE lang WHEN 'en' THEN 'typescript' WHEN 'de' THEN 'cpp' WHEN 'fr' THEN 'ruby' ELSE '' END AS language FROM documents",
)
def language_query(spark, sf):
    d = tb.load(spark, sf, "documents").selectExpr("doc_id", f"concat('/a.b/', source, '/', doc_id, {EXTENSION}) as p")
    return d.select("doc_id", language_of(F.col("p")).alias("language"))


# ------------------------------------------------------------------ extraction

@query(
    "extract_symbols",
    """WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS raw, unnest(range(0, len(string_split(html, chr(10))))) AS line FROM pages),
    h AS (SELECT page_id, line, 'class' AS type, unnest(regexp_extract_all(raw, '<h[1-6][^>]*>(.*?)</h[1-6]>', 1)) AS name FROM l
      UNION ALL SELECT page_id, line, 'endpoint', unnest(regexp_extract_all(raw, '<a [^>]*href="([^"]*)"', 1)) FROM l)
    SELECT '/p/' || page_id AS file_path, line::INTEGER AS line, type, name FROM h WHERE name <> ''""",
)
def extract_query(spark, sf):
    docs = tb.load(spark, sf, "pages").selectExpr(
        "concat('/p/', page_id) as file_path", "concat('p/', page_id) as relative_path", "'html' as language", "html as text"
    )
    return bd.extract_symbols(docs).select("file_path", "line", "type", "name")


@query(
    "classify_node",
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'class' WHEN 'STANDARD' THEN 'class' WHEN 'PROMO' THEN 'interface' WHEN 'MEDIUM' THEN 'method'
      WHEN 'SMALL' THEN CASE WHEN p_size > 25 THEN 'class' END ELSE 'variable' END AS type FROM part""",
)
def classify_query(spark, sf):
    p = tb.load(spark, sf, "part").selectExpr(
        "p_partkey",
        """CASE p_type WHEN 'ECONOMY' THEN 'abstract_class_declaration' WHEN 'STANDARD' THEN 'struct' WHEN 'PROMO' THEN 'trait_definition'
           WHEN 'MEDIUM' THEN 'singleton_method' WHEN 'SMALL' THEN 'type_declaration' ELSE 'variable_declarator' END as kind""",
        "CASE p_type WHEN 'MEDIUM' THEN 'ruby' WHEN 'SMALL' THEN if(p_size > 25, 'go', 'java') ELSE 'java' END as lang",
    )
    return p.select("p_partkey", bd.classify_node("kind", "lang").alias("type"))


def nested_symbols(spark, sf):
    """Region, nation and customer as nested declarations of one file per region."""
    r = tb.load(spark, sf, "region").selectExpr("r_regionkey as f", "0L as line", "0 as depth", "r_name as name", "'class' as type")
    n = tb.load(spark, sf, "nation").selectExpr(
        "n_regionkey as f", "n_nationkey * 10000000000L + 1 as line", "1 as depth", "n_name as name", "if(n_nationkey < 10, 'enum', 'method') as type"
    )
    c = tb.load(spark, sf, "customer").join(
        tb.load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).selectExpr("n_regionkey as f", "n_nationkey * 10000000000L + 2 + c_custkey as line", "2 as depth", "c_name as name", "'method' as type")
    return r.unionByName(n).unionByName(c).withColumn("file_path", F.concat(F.lit("/r/"), "f")).drop("f")


@query(
    "qualify_names",
    """SELECT r_name AS name, NULL AS container, r_name AS full_name FROM region
    UNION ALL SELECT n_name, r_name, r_name || '.' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT c_name, r_name || CASE WHEN n_nationkey < 10 THEN '.' || n_name ELSE '' END,
      r_name || CASE WHEN n_nationkey < 10 THEN '.' || n_name ELSE '' END || '.' || c_name
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def qualify_query(spark, sf):
    return bd.qualify_names(nested_symbols(spark, sf)).select("name", "container", "full_name")


@query(
    "qualify_names_deep",
    """SELECT s_suppkey AS k, d AS depth, 't' || d || '_' || s_suppkey AS name,
      nullif(array_to_string(list_transform(range(d), lambda i: 't' || i || '_' || s_suppkey), '.'), '') AS container,
      array_to_string(list_transform(range(d + 1), lambda i: 't' || i || '_' || s_suppkey), '.') AS full_name
    FROM supplier, (SELECT unnest(range(13))::INTEGER AS d)""",
)
def qualify_deep_query(spark, sf):
    nested = tb.load(spark, sf, "supplier").selectExpr("s_suppkey as k", "explode(sequence(0, 12)) as depth").selectExpr(
        "k", "depth", "cast(depth as long) as line", "concat('/s/', k) as file_path", "concat('t', depth, '_', k) as name", "'class' as type"
    )
    return bd.qualify_names(nested).select("k", "depth", "name", "container", "full_name")


# Controller sources: one per supplier, its routes from its columns.
@query(
    "controller_endpoints",
    """WITH s AS (SELECT s_suppkey AS k, 'S' || s_suppkey AS c, s_nationkey AS n FROM supplier)
    SELECT '/api/' || k || '.cs' AS file_path, 3 AS line, '[GET] api/' || c || '/list/' || n AS name, c || 'Controller.List' AS full_name FROM s
    UNION ALL SELECT '/api/' || k || '.cs', 5, '[POST] api/' || c || '/{id}', c || 'Controller.Add' FROM s
    UNION ALL SELECT '/api/' || k || '.cs', 9, '[DELETE] api/' || c, c || 'Controller.Drop' FROM s""",
)
def controllers_query(spark, sf):
    src = tb.load(spark, sf, "supplier").selectExpr(
        "concat('/api/', s_suppkey, '.cs') as file_path",
        """concat('[ApiController]\n[Route("api/[controller]")]\npublic class S', s_suppkey, 'Controller : Base {\n  [HttpGet("list/', s_nationkey,
          '")]\n  public IActionResult List() { return Ok(); }\n  [HttpGet, Route("/{id}")]\n  [HttpPost]\n  public async Task<int> Add(int id) {\n  }\n',
          '  [HttpDelete]\n  public void Drop() {}\n  public int Helper() { return 1; }\n}\n') as text""",
    )
    return bd.controller_endpoints(src).select("file_path", "line", "name", "full_name")


@query(
    "minimal_api_endpoints",
    """SELECT '/api/' || s_suppkey || '.cs' AS file_path, 0 AS line, '[GET] /s/' || s_nationkey AS name FROM supplier
    UNION ALL SELECT '/api/' || s_suppkey || '.cs', 1, '[PATCH] /p' FROM supplier
    UNION ALL SELECT '/api/' || s_suppkey || '.cs', 1, '[PUT] route' || s_suppkey FROM supplier""",
)
def minimal_query(spark, sf):
    src = tb.load(spark, sf, "supplier").selectExpr(
        "concat('/api/', s_suppkey, '.cs') as file_path",
        """concat('app.MapGet("/s/', s_nationkey, '", () => 1);\napp.MapPatch ( @"/p", F); app.MapPut(route', s_suppkey, ', F);\napp.MapGet("", F);\napp.MapAll("/x")') as text""",
    )
    return bd.minimal_api_endpoints(src).select("file_path", "line", "name")


@query(
    "combine_routes",
    """SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'x/' || n_name WHEN n_nationkey < 10 THEN 'api/v1/' WHEN n_nationkey < 15 THEN 'api/v1/' || n_name
      ELSE 'api/v1/' || n_name || '/' END AS route FROM nation""",
)
def combine_query(spark, sf):
    n = tb.load(spark, sf, "nation").selectExpr(
        "n_nationkey", "if(n_nationkey < 5, '', if(n_nationkey < 12, 'api/v1/', 'api/v1')) as a",
        "CASE WHEN n_nationkey < 5 THEN concat('x/', n_name) WHEN n_nationkey < 10 THEN null WHEN n_nationkey < 15 THEN n_name ELSE concat('/', n_name, '/') END as b",
    )
    return n.select("n_nationkey", combine_routes(F.col("a"), F.col("b")).alias("route"))


@query(
    "resolve_controller_token",
    "SELECT s_suppkey, 'api/S' || s_suppkey || '/[controller]' AS both, 'plain' AS none, 'v/Supp' || s_suppkey AS other FROM supplier",
)
def token_query(spark, sf):
    s = tb.load(spark, sf, "supplier")
    name = F.concat(F.lit("S"), "s_suppkey", F.lit("Controller"))
    return s.select(
        "s_suppkey",
        resolve_controller_token(F.lit("api/[controller]/[controller]"), name).alias("both"),
        resolve_controller_token(F.lit("plain"), name).alias("none"),
        resolve_controller_token(F.lit("v/[controller]"), F.concat(F.lit("Supp"), "s_suppkey")).alias("other"),
    )


@query(
    "flat_symbols",
    """WITH p AS (SELECT p_partkey, p_name, p_brand, p_size, CASE WHEN p_size <= 13 THEN p_size ELSE 4 END AS kind FROM part)
    SELECT 'symbol:/w s/' || p_partkey || ':' || p_name || ':' || p_size AS id, CASE kind WHEN 4 THEN 'class' WHEN 5 THEN 'method' WHEN 6 THEN 'property'
      WHEN 7 THEN 'property' WHEN 9 THEN 'enum' WHEN 10 THEN 'interface' WHEN 11 THEN 'function' ELSE 'variable' END AS type,
      CASE WHEN p_size > 40 THEN p_name ELSE p_brand || '.' || p_name END AS full_name FROM p WHERE kind IN (4, 5, 6, 7, 9, 10, 11, 12, 13)""",
)
def flat_query(spark, sf):
    rows = tb.load(spark, sf, "part").selectExpr(
        "p_name as name", "if(p_size <= 13, p_size, 4) as kind", "concat('file:///w%20s/', p_partkey) as uri",
        "p_size as line", "0 as col", "if(p_size > 40, '', p_brand) as container",
    )
    return bd.flat_symbols(rows).select("id", "type", "full_name")


@query(
    "flatten_symbol_tree",
    """WITH RECURSIVE nodes AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id, r_name AS name, 3 AS kind FROM region
      UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 4 FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, 5 FROM customer),
    t AS (SELECT id, name, kind, NULL::VARCHAR AS container, name AS full_name, 0 AS depth FROM nodes WHERE parent_id IS NULL
      UNION ALL SELECT n.id, n.name, n.kind, t.full_name, t.full_name || '.' || n.name, t.depth + 1 FROM nodes n JOIN t ON n.parent_id = t.id)
    SELECT id, CASE kind WHEN 4 THEN 'class' ELSE 'method' END AS type, container, full_name, depth FROM t WHERE kind IN (4, 5)""",
)
def tree_query(spark, sf):
    r = tb.load(spark, sf, "region").selectExpr("concat('r', r_regionkey) as id", "cast(null as string) as parent_id", "r_name as name", "3 as kind")
    n = tb.load(spark, sf, "nation").selectExpr("concat('n', n_nationkey) as id", "concat('r', n_regionkey) as parent_id", "n_name as name", "4 as kind")
    c = tb.load(spark, sf, "customer").selectExpr("concat('c', c_custkey) as id", "concat('n', c_nationkey) as parent_id", "c_name as name", "5 as kind")
    return bd.flatten_symbol_tree(r.unionByName(n).unionByName(c)).select("id", "type", "container", "full_name", "depth")


@query(
    "symbol_coverage",
    f"""WITH {DOCS}, s AS (SELECT file_path FROM doc_paths JOIN labels USING (doc_id)), f AS (SELECT count(*) AS n FROM doc_paths)
    SELECT count(*) AS symbols, count(DISTINCT file_path) AS files_with_symbols, any_value(n) AS files, round(count(DISTINCT file_path) / any_value(n), 6)::DOUBLE AS ratio,
      count(DISTINCT file_path) / any_value(n) >= 0.6 AS covered FROM s, f""",
)
def coverage_query(spark, sf):
    files = tb.document_paths(spark, sf)
    symbols = files.join(tb.load(spark, sf, "labels"), "doc_id").select("file_path")
    return bd.symbol_coverage(files, symbols).withColumn("ratio", F.round("ratio", 6))


@query(
    "flatten_settings",
    """WITH b AS (SELECT user_id AS owner, ts, event_id, json_extract_string(props, '$.k') AS k FROM events)
    SELECT owner, 'search.k' AS key, arg_max(k, event_id) AS value FROM b GROUP BY owner
    UNION ALL SELECT owner, 'search.deep.list', '[' || arg_max(k, event_id) || ',1]' FROM b GROUP BY owner
    UNION ALL SELECT owner, 'on', 'true' FROM b GROUP BY owner""",
)
def settings_query(spark, sf):
    e = tb.load(spark, sf, "events").selectExpr(
        "user_id as owner", "event_id as ord",
        """concat('{"search":{"k":', get_json_object(props, '$.k'), ',"deep":{"list":[', get_json_object(props, '$.k'), ',1],"empty":{}}},"on":true}') as json""",
    )
    return bd.flatten_settings(e)


DEEP_KEY = ".".join(f"l{i}" for i in range(10))


@query(
    "flatten_settings_deep",
    f"""SELECT user_id AS owner, '{DEEP_KEY}' AS key, arg_max(json_extract_string(props, '$.k'), event_id) AS value FROM events GROUP BY user_id""",
)
def settings_deep_query(spark, sf):
    opened = "".join(f'{{"l{i}":' for i in range(10))
    e = tb.load(spark, sf, "events").select(
        F.col("user_id").alias("owner"), F.col("event_id").alias("ord"),
        F.concat(F.lit(opened), F.get_json_object("props", "$.k"), F.lit("}" * 10)).alias("json"),
    )
    return bd.flatten_settings(e)


# One source of each language per supplier ({} is the key): text, then line, name, type and full name of its symbols.
CODE_FORMS = [
    ("typescript", "class A{} {\n  private size = 1;\n  run{}(x: number): void {\n    if (x) {\n    }\n  }\n}\nexport const go{} = (a) => a;\nfunction f{}() {\n}\nenum E{} { X }",
     [(0, "A{}", "class", "A{}"), (1, "size", "property", "A{}.size"), (2, "run{}", "method", "A{}.run{}"), (7, "go{}", "variable", "go{}"), (8, "f{}", "function", "f{}"), (10, "E{}", "enum", "E{}")]),
    ("javascript", "class A{} {\n  async run{}(x) {\n    while (x) {\n    }\n  }\n}\nlet v{} = 1;", [(0, "A{}", "class", "A{}"), (1, "run{}", "method", "A{}.run{}"), (6, "v{}", "variable", "v{}")]),
    ("cpp", "class B{} {\n  int get{}() const {\n    return 1;\n  }\n};\nenum class F{} { Y };\nint add{}(int a) {\n}",
     [(0, "B{}", "class", "B{}"), (1, "get{}", "method", "B{}.get{}"), (5, "F{}", "enum", "F{}"), (6, "add{}", "function", "add{}")]),
    ("c", "struct S{} {\n};\nenum G{} { Z };\nstatic int *sum{}(int a)\n{\n  return sum{}(a);\n}", [(0, "S{}", "class", "S{}"), (2, "G{}", "enum", "G{}"), (3, "sum{}", "function", "sum{}")]),
    ("csharp", "public class C{} {\n  public int Load{}(int a) {\n  }\n}", [(0, "C{}", "class", "C{}"), (1, "Load{}", "method", "C{}.Load{}")]),
    ("java", "public interface J{} {\n}\npublic class K{} {\n  public void act{}() {\n  }\n}", [(0, "J{}", "interface", "J{}"), (2, "K{}", "class", "K{}"), (3, "act{}", "method", "K{}.act{}")]),
    ("php", "class H{} {\n  public function w{}() {\n  }\n}", [(0, "H{}", "class", "H{}"), (1, "w{}", "function", "H{}.w{}")]),
    ("python", "class P{}:\n    def m{}(self):\n        pass\ndef g{}():\n    pass", [(0, "P{}", "class", "P{}"), (1, "m{}", "function", "P{}.m{}"), (3, "g{}", "function", "g{}")]),
    ("go", "type T{} struct {\n}\nfunc (t T{}) M{}() {\n}\nfunc N{}() {\n}", [(0, "T{}", "class", "T{}"), (2, "M{}", "method", "M{}"), (4, "N{}", "function", "N{}")]),
    ("ruby", "class R{}\n  def s{}\n  end\nend", [(0, "R{}", "class", "R{}"), (1, "s{}", "method", "R{}.s{}")]),
]
_KEYED = lambda t: "'" + t.replace("{}", "\x01").replace("\n", "\\n") + "'"


@query(
    "extract_code_symbols",
    f"""SELECT 'ts:/x/' || s_suppkey || '.' || lang || ':' || replace(full_name, chr(1), s_suppkey::VARCHAR) || ':' || line AS id, line,
      replace(name, chr(1), s_suppkey::VARCHAR) AS name, type, replace(full_name, chr(1), s_suppkey::VARCHAR) AS full_name
    FROM supplier, (VALUES {", ".join(f"('{lang}', {line}, {_KEYED(name)}, '{kind}', {_KEYED(full)})" for lang, _, rows in CODE_FORMS for line, name, kind, full in rows)})
      AS t(lang, line, name, type, full_name)""",
)
def code_symbols_query(spark, sf):
    forms = ", ".join(f"named_struct('language', '{lang}', 'raw', {_KEYED(text)})" for lang, text, _ in CODE_FORMS)
    docs = tb.load(spark, sf, "supplier").selectExpr("s_suppkey", f"inline(array({forms}))").selectExpr(
        "concat('/x/', s_suppkey, '.', language) as file_path", "concat('x/', s_suppkey) as relative_path", "language",
        "replace(raw, char(1), cast(s_suppkey as string)) as text",
    )
    return bd.code_symbols(docs).select("id", "line", "name", "type", "full_name")


def keyed_sources(spark, sf, forms):
    """One text per supplier and form, with the supplier's key in its names."""
    rows = spark.createDataFrame(list(forms.items()), "language string, form string")
    # A few megabytes of keys, so one task else, make texts of many times their size.
    keys = spread(tb.load(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("k")))
    texts = keys.join(F.broadcast(rows))
    return texts.selectExpr("concat('/', language, '/', k) as file_path", "concat(language, '/', k) as relative_path", "language", "replace(form, '§', k) as text")


DECLARED_SQL = "d(language, line, name, type, full_name) AS (VALUES " + ", ".join(map(str, src.DECLARED)) + ")"


@query(
    "extract_split_declarations",
    f"""WITH {DECLARED_SQL} SELECT 'ts:/' || language || '/' || s_suppkey || ':' || replace(full_name, '§', s_suppkey::VARCHAR) || ':' || line AS id,
      line::INTEGER AS line, replace(name, '§', s_suppkey::VARCHAR) AS name, type, replace(full_name, '§', s_suppkey::VARCHAR) AS full_name FROM supplier, d""",
)
def split_declarations_query(spark, sf):
    """Declarations over several lines, among comments and strings that look like some, in eight languages."""
    return bd.code_symbols(keyed_sources(spark, sf, src.SOURCES)).select("id", "line", "name", "type", "full_name")


@query(
    "controller_endpoints_split",
    """WITH s AS (SELECT s_suppkey::VARCHAR AS k FROM supplier)
    SELECT '/csharp/' || k AS file_path, 7 AS line, '[POST] api/S' || k || '/two' AS name, 'S' || k || 'Controller.One' AS full_name FROM s
    UNION ALL SELECT '/csharp/' || k, 18, '[DELETE] api/S' || k || '/four', 'S' || k || 'Controller.Four' FROM s""",
)
def split_controllers_query(spark, sf):
    docs = keyed_sources(spark, sf, {"csharp": src.CONTROLLER})
    return bd.controller_endpoints(docs).select("file_path", "line", "name", "full_name")


@query(
    "minimal_api_split",
    """SELECT '/csharp/' || s_suppkey AS file_path, 0 AS line, '[GET] /one/' || s_suppkey AS name FROM supplier
    UNION ALL SELECT '/csharp/' || s_suppkey, 6, '[PATCH] /two' FROM supplier UNION ALL SELECT '/csharp/' || s_suppkey, 7, '[DELETE] /three' FROM supplier""",
)
def split_minimal_query(spark, sf):
    docs = keyed_sources(spark, sf, {"csharp": src.MINIMAL})
    return bd.minimal_api_endpoints(docs).select("file_path", "line", "name")


@query(
    "open_braces",
    r"""WITH l AS (SELECT page_id, i, regexp_replace(x, '[^{}]', '', 'g') AS b FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS x,
      unnest(range(0, len(string_split(html, chr(10))))) AS i FROM pages)),
    n AS (SELECT *, len(replace(b, '}', '')) - len(replace(b, '{', '')) AS net FROM l)
    SELECT '/p/' || page_id AS file_path, i::INTEGER AS line, coalesce(sum(net) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS depth FROM n""",
)
def open_braces_query(spark, sf):
    """Braces of pages, where nothing but braces and line breaks is left of the text."""
    docs = tb.load(spark, sf, "pages").selectExpr("concat('/p/', page_id) as file_path", r"regexp_replace(html, '[^{}\n]', '') as text")
    return bd.brace_depth(docs)


DEEP = 40


@query(
    "qualify_names_stack",
    f"""SELECT s_suppkey AS k, d AS depth, nullif(array_to_string(list_transform(range(d), lambda i: 't' || i), '.'), '') AS container
    FROM supplier, (SELECT unnest(range({DEEP} + 1))::INTEGER AS d)
    UNION ALL SELECT s_suppkey, {DEEP} + 1, array_to_string(list_transform(range(d // 2), lambda i: 't' || i), '.') FROM supplier, (SELECT unnest(range(2, {DEEP} + 1, 2)) AS d)""",
)
def qualify_stack_query(spark, sf):
    """A nest of types, then a row below each half of its depth, which takes the deeper ones off again."""
    down = tb.load(spark, sf, "supplier").selectExpr("s_suppkey as k", f"explode(sequence(0, {DEEP})) as depth").selectExpr(
        "k", "depth", "depth as line", "concat('t', depth) as name", "'class' as type", f"depth as shown"
    )
    up = tb.load(spark, sf, "supplier").selectExpr("s_suppkey as k", f"explode(sequence({DEEP}, 2, -2)) as d").selectExpr(
        "k", "cast(d div 2 as int) as depth", f"{2 * DEEP} - d as line", "'leaf' as name", "'method' as type", f"{DEEP} + 1 as shown"
    )
    rows = down.unionByName(up).withColumn("file_path", F.concat(F.lit("/s/"), "k"))
    return bd.qualify_names(rows).select("k", F.col("shown").alias("depth"), "container")


# A workspace per supplier: a source of each language, endpoints, and files that are left out or named only.
EXTENSIONS = {"typescript": "ts", "python": "py", "csharp": "cs", "go": "go", "php": "php", "java": "java", "cpp": "cpp", "ruby": "rb"}
WORKSPACE = {f"src/a.{EXTENSIONS[lang]}": text for lang, text in src.SOURCES.items()} | {
    "api/c.cs": src.CONTROLLER, "api/m.cs": src.MINIMAL, "notes.txt": "class Note { }", "empty.ts": None,
    "node_modules/x.ts": "class X {}", "obj/x.cs": "public class X {}", "api/y.g.cs": "public class Y {}", "skip.ts": "class Skip {}",
    "api/z.cs": "// <auto-generated />\npublic class Z {}",
}
LEFT_OUT = ["node_modules/x.ts", "obj/x.cs", "api/y.g.cs", "skip.ts", "api/z.cs"]
NAMED = [p for p in WORKSPACE if p not in LEFT_OUT]
BUILT = [
    *[("file", p, None, p.rsplit("/", 1)[-1], p) for p in NAMED],
    *[(kind, f"src/a.{EXTENSIONS[lang]}", line, name, full) for lang, line, name, kind, full in src.DECLARED],
    ("class", "api/c.cs", 3, "S§Controller", "S§Controller"), ("method", "api/c.cs", 11, "One", "S§Controller.One"),
    ("endpoint", "api/c.cs", 7, "[POST] api/S§/two", "S§Controller.One"), ("endpoint", "api/c.cs", 18, "[DELETE] api/S§/four", "S§Controller.Four"),
    ("endpoint", "api/m.cs", 0, "[GET] /one/§", "/one/§"), ("endpoint", "api/m.cs", 6, "[PATCH] /two", "/two"), ("endpoint", "api/m.cs", 7, "[DELETE] /three", "/three"),
]
BUILT_SQL = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in BUILT)


def workspaces(spark, sf):
    """Listing, verdicts and commands of one workspace for each supplier; one file is listed twice."""
    rows = [(i, p, t) for i, (p, t) in enumerate(WORKSPACE.items())] + [(len(WORKSPACE), "src/./a.go", WORKSPACE["src/a.go"])]
    forms = spark.createDataFrame(rows, "i int, path string, form string")
    # A few megabytes of keys, so one task else, make texts of many times their size.
    keys = spread(tb.load(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("k")))
    files = keys.join(F.broadcast(forms)).selectExpr(
        "cast(k as bigint) * 1000 + i as seq", "concat('/ws', k, '/', path) as file_path", "path as relative_path",
        "cast(length(form) as bigint) as size", "replace(form, '§', k) as text",
    )
    verdicts = keys.selectExpr("concat('/ws', k) as root", "concat('.gitignore\\u00003\\u0000skip.*\\u0000skip.ts', '') as text")
    commands = tb.load(spark, sf, "nation").selectExpr("concat('tool.open', replace(n_name, ' ', '')) as command_id").union(spark.range(1).selectExpr("'_hidden' as command_id"))
    return files, verdicts, commands


@query(
    "build_index",
    f"""WITH b(type, path, line, name, full_name) AS (VALUES {BUILT_SQL}),
    s AS (SELECT s_suppkey::VARCHAR AS k FROM supplier)
    SELECT type, CASE WHEN path = 'src/a.go' THEN '/ws' || k || '/src/./a.go' ELSE '/ws' || k || '/' || path END AS file_path, line::INTEGER AS line, replace(name, '§', k) AS name,
      replace(CASE WHEN type = 'file' AND path = 'src/a.go' THEN 'src/./a.go' ELSE full_name END, '§', k) AS full_name,
      CASE type WHEN 'file' THEN 'files' WHEN 'class' THEN 'types' WHEN 'method' THEN 'symbols' WHEN 'function' THEN 'symbols'
        WHEN 'property' THEN 'properties' WHEN 'variable' THEN 'properties' ELSE 'endpoints' END AS scope FROM b, s""",
)
def build_index_query(spark, sf):
    """Every item that the job makes of the workspaces, commands aside."""
    files, verdicts, commands = workspaces(spark, sf)
    built = ixg.build_index(files, verdicts, commands)
    return built.features.filter("type <> 'command'").select("type", "file_path", "line", "name", "full_name", "scope")
