"""Queries on code relations."""

from pyspark.sql import functions as F

from waymark.functions.prefix import number_chunk
from waymark.functions.text import count_label
from waymark.operators import grep as gr
from waymark.operators import relations as rl
from waymark.plans import tables as tb
from waymark.plans.registry import query
from waymark.plans.text_plans import document_lines, documents

LABEL_SQL = "CASE WHEN n = 0 THEN 'no {0}s' WHEN n = 1 THEN '1 {0}' ELSE n || ' {0}s' END"


# Line items as references to parts: file by supplier, line by order.
def references(spark, sf):
    return tb.load(spark, sf, "lineitem").selectExpr(
        "l_partkey as symbol", "concat('/s/', l_suppkey) as file_path", "l_orderkey as line", "l_linenumber as col",
        "l_orderkey as end_line", "l_linenumber + 3 as end_col",
    )


def declarations(spark, sf):
    """The smallest position of a part declares it."""
    first = references(spark, sf).groupBy("symbol").agg(F.min(F.struct("line", "col", "file_path")).alias("p"))
    return first.select("symbol", "p.file_path", "p.line", (F.col("p.col") + 1).alias("col"))


REFS_SQL = """refs AS (SELECT l_partkey AS symbol, '/s/' || l_suppkey AS file_path, l_orderkey AS line, l_linenumber AS col, l_returnflag, l_quantity FROM lineitem),
decl AS (SELECT symbol, arg_min(file_path, (line, col, file_path)) AS file_path, min((line, col, file_path))[1] AS line,
  min((line, col, file_path))[2] + 1 AS col FROM refs GROUP BY symbol),
counted AS (SELECT d.symbol, count(r.symbol) FILTER (NOT (r.file_path = d.file_path AND r.line = d.line AND d.col BETWEEN r.col AND r.col + 3)) AS n
  FROM decl d LEFT JOIN refs r ON r.symbol = d.symbol {0} GROUP BY d.symbol)"""


@query(
    "reference_counts",
    f"WITH {REFS_SQL.format('')} SELECT symbol, n, {LABEL_SQL.format('reference')} AS label FROM counted WHERE n >= 20",
)
def reference_query(spark, sf):
    return rl.reference_counts(declarations(spark, sf), references(spark, sf), 20).select("symbol", "n", "label")


KIND = "CASE p_type WHEN 'ECONOMY' THEN 'class' WHEN 'STANDARD' THEN 'interface' WHEN 'PROMO' THEN 'enum' WHEN 'MEDIUM' THEN 'method' WHEN 'SMALL' THEN 'function' ELSE 'property' END"
PARENT = "if(p_size < 20, 'interface', if(p_size < 30, 'class', null))"


@query(
    "implementation_counts",
    f"""WITH {REFS_SQL.format("")}, s AS (SELECT c.symbol, n, {KIND} AS kind, CASE WHEN p_size < 20 THEN 'interface' WHEN p_size < 30 THEN 'class' END AS parent_kind
      FROM counted c JOIN part ON symbol = p_partkey)
    SELECT symbol, kind, n, {LABEL_SQL.format('implementation')} AS label FROM s WHERE kind IN ('class', 'interface', 'method', 'function')
      AND (n > 0 OR kind IN ('class', 'interface') OR parent_kind = 'interface')""",
)
def implementation_query(spark, sf):
    kinds = tb.load(spark, sf, "part").selectExpr("p_partkey as symbol", f"{KIND} as kind", f"{PARENT} as parent_kind")
    symbols = declarations(spark, sf).join(kinds, "symbol")
    return rl.implementation_counts(symbols, references(spark, sf)).select("symbol", "kind", "n", "label")


# Nations declared twice per region file; customers are their members.
@query(
    "parent_kind",
    """SELECT c_custkey AS id, CASE WHEN n_nationkey < 8 THEN 'interface' ELSE 'class' END AS parent_kind FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT -1 - n_nationkey, NULL FROM nation UNION ALL SELECT -1 - n_nationkey, NULL FROM nation""",
)
def parent_kind_query(spark, sf):
    n = tb.load(spark, sf, "nation")
    n1 = n.selectExpr("cast(-1 - n_nationkey as bigint) as id", "concat('/r/', n_regionkey) as file_path", "n_name as name", "'struct' as kind", "'' as container", "0 as ord")
    n2 = n.selectExpr("cast(-1 - n_nationkey as bigint) as id", "concat('/r/', n_regionkey) as file_path", "n_name as name", "if(n_nationkey < 8, 'interface', 'class') as kind", "'' as container", "1 as ord")
    c = tb.load(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "c_custkey as id", "concat('/r/', n_regionkey) as file_path", "c_name as name", "'method' as kind", "n_name as container", "2 as ord"
    )
    return rl.parent_kind(n1.unionByName(n2).unionByName(c)).select("id", "parent_kind")


@query(
    "lens_rows",
    f"""WITH s AS (SELECT p_partkey AS symbol, {KIND} AS kind FROM part)
    SELECT symbol, 'reference' AS lens FROM s WHERE kind <> 'property' UNION ALL SELECT symbol, 'implementation' FROM s WHERE kind IN ('class', 'interface', 'method', 'function')
    UNION ALL SELECT symbol, 'callChain' FROM s WHERE kind IN ('method', 'function')""",
)
def lens_query(spark, sf):
    s = tb.load(spark, sf, "part").selectExpr("p_partkey as symbol", f"{KIND} as kind")
    return rl.lens_rows(s).select("symbol", "lens")


@query(
    "count_label",
    f"WITH s AS (SELECT s_suppkey, s_nationkey AS n FROM supplier) SELECT s_suppkey, {LABEL_SQL.format('reference')} AS refs, {LABEL_SQL.format('implementation')} AS impls FROM s",
)
def label_query(spark, sf):
    s = tb.load(spark, sf, "supplier")
    return s.select("s_suppkey", count_label(F.col("s_nationkey"), "reference").alias("refs"), count_label(F.col("s_nationkey"), "implementation").alias("impls"))


# ------------------------------------------------------------ enclosing owners

OWNER_LINE = r"^(?:The|Der|La|El|Is|And) (\w+)"
EDGE_LINE = r"icense|^[A-Z]\w+ \w+\.$"


@query(
    "enclosing_declaration",
    f"""WITH l AS (SELECT '/'||source||'/'||lang||'/'||doc_id||'.txt' AS file_path, unnest(string_split(text, chr(10))) AS text,
      unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents),
    k AS (SELECT file_path, line, nullif(regexp_extract(trim(text), '{OWNER_LINE}', 1), '') AS name,
      regexp_matches(trim(text), '{EDGE_LINE}') AND NOT regexp_matches(trim(text), '^(//|/\\*|\\*)') AS edge FROM l WHERE trim(text) NOT IN ('', '{{', '}}')),
    marks AS (SELECT file_path, line, name FROM k WHERE name IS NOT NULL OR edge),
    refs AS (SELECT file_path, line FROM l WHERE contains(lower(text), 'ent') AND trim(text) <> '' AND length(text) <= 10000)
    SELECT r.file_path, r.line::INTEGER AS line, coalesce(m.name, 'call at line ' || (r.line + 1)) AS owner,
      CASE WHEN m.name IS NULL THEN r.line ELSE m.line END::INTEGER AS owner_line
    FROM refs r ASOF LEFT JOIN marks m ON r.file_path = m.file_path AND r.line >= m.line""",
)
def enclosing_query(spark, sf):
    asked = spark.createDataFrame([(1, "ent", 1)], "qid int, query string, max_results int")
    hits = gr.grep(documents(spark, sf), asked)
    refs = hits.select(F.concat_ws(":", "file_path", "line").alias("ref_id"), "file_path", "line")
    marks = rl.declaration_marks(document_lines(spark, sf), OWNER_LINE, EDGE_LINE)
    return rl.enclosing_declaration(refs, marks).select("file_path", "line", "owner", "owner_line")


# One C# file per supplier: line, text ({} is the key), owner of a reference there and its line.
CODE_LINES = [
    ("namespace A.B", None, None), ("class S{} : Base", None, None), ("{{", "call at line 3", 2),
    ("public async Task<int> Load{}(int id)", "Load{}", 3), ("{{", "Load{}", 3), ("return Helper(id);", "Load{}", 3),
    ("}}", "Load{}", 3), ("readonly ref int Size{}(int a)", "Size{}", 7), ("use(x);", "Size{}", 7),
    ("extern static void Raw{}<T>(T x);", "Raw{}", 9), ("Map{}<T>(T x) {{", "Map{}", 10), ("// class comment", "Map{}", 10),
    ("x();", "Map{}", 10), ("interface I{}", None, None), ("y();", "call at line 15", 14),
]
CODE_TEXT = ", ".join("'" + t.replace("{}", "\x00").replace("{{", "{").replace("}}", "}") + "'" for t, _, _ in CODE_LINES)
CODE_ROWS = [(i, o.replace("{}", "\x00"), at) for i, (_, o, at) in enumerate(CODE_LINES) if o]


@query(
    "enclosing_declaration_code",
    f"""SELECT '/code/' || s_suppkey || '.cs' AS file_path, line, replace(owner, chr(1), s_suppkey::VARCHAR) AS owner, owner_line
    FROM supplier, (VALUES {', '.join(f"({i}, '{o}', {at})" for i, o, at in CODE_ROWS)}) AS t(line, owner, owner_line)""".replace("\x00", "\x01"),
)
def enclosing_code_query(spark, sf):
    text = f"array({CODE_TEXT})".replace("\x00", "\x01")
    lines = tb.load(spark, sf, "supplier").selectExpr("s_suppkey", f"posexplode({text}) as (line, raw)").selectExpr(
        "concat('/code/', s_suppkey, '.cs') as file_path", "line", "replace(raw, char(1), cast(s_suppkey as string)) as text"
    )
    refs = lines.filter(F.col("line").isin([i for i, _, _ in CODE_ROWS])).select(F.concat_ws(":", "file_path", "line").alias("ref_id"), "file_path", "line")
    return rl.enclosing_declaration(refs, rl.declaration_marks(lines)).select("file_path", "line", "owner", "owner_line")


# Orders of a customer as symbols: one range per order, and one per thousand.
@query(
    "enclosing_symbol",
    """SELECT l_orderkey * 10 + l_linenumber AS pos_id, 'block' || (l_orderkey // 1000) AS symbol FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def enclosing_symbol_query(spark, sf):
    o = tb.load(spark, sf, "orders")
    inner = o.selectExpr("concat('/c/', o_custkey) as file_path", "o_orderkey * 10 as line", "0 as col", "o_orderkey * 10 + 9 as end_line", "0 as end_col", "concat('order', o_orderkey) as name", "o_orderkey as ord")
    outer = o.selectExpr("o_custkey", "o_orderkey div 1000 as b").distinct().selectExpr(
        "concat('/c/', o_custkey) as file_path", "b * 10000 as line", "0 as col", "b * 10000 + 9999 as end_line", "0 as end_col", "concat('block', b) as name", "-b as ord"
    )
    pos = tb.load(spark, sf, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "l_orderkey * 10 + l_linenumber as pos_id", "concat('/c/', o_custkey) as file_path", "l_orderkey * 10 + l_linenumber as line", "0 as col"
    )
    return rl.enclosing_symbol(pos, inner.unionByName(outer), number_chunk(F.col("line"), 10_000_000)).select("pos_id", "symbol")


@query(
    "symbols_by_position",
    """SELECT '/s/' || l_suppkey AS file_path, l_partkey AS line, l_linenumber AS col, arg_max('o' || l_orderkey, l_orderkey) AS name FROM lineitem GROUP BY 1, 2, 3""",
)
def by_position_query(spark, sf):
    s = tb.load(spark, sf, "lineitem").selectExpr(
        "concat('/s/', l_suppkey) as file_path", "l_partkey as line", "l_linenumber as col", "l_orderkey as ord", "concat('o', l_orderkey) as name"
    )
    return rl.symbols_by_position(s)


# ---------------------------------------------------------------- caller paths

# Calls from nation to region, customer to nation, order to customer, line item
# to order; nations also call back from their region, which closes cycles.
EDGES_SQL = """edges AS (SELECT 'r' || n_regionkey AS callee, 'n' || n_nationkey AS caller, n_nationkey::BIGINT AS call_site FROM nation
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, o_orderkey FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'l' || l_orderkey || '.' || l_linenumber, l_orderkey FROM lineitem)"""


def call_edges(spark, sf):
    n, c = tb.load(spark, sf, "nation"), tb.load(spark, sf, "customer")
    o, li = tb.load(spark, sf, "orders"), tb.load(spark, sf, "lineitem")
    e = lambda df, a, b, s: df.selectExpr(f"{a} as callee", f"{b} as caller", f"cast({s} as bigint) as call_site")
    return (
        e(n, "concat('r', n_regionkey)", "concat('n', n_nationkey)", "n_nationkey")
        .unionByName(e(n, "concat('n', n_nationkey)", "concat('r', n_regionkey)", "n_nationkey"))
        .unionByName(e(c, "concat('n', c_nationkey)", "concat('c', c_custkey)", "c_custkey"))
        .unionByName(e(o, "concat('c', o_custkey)", "concat('o', o_orderkey)", "o_orderkey"))
        .unionByName(e(li, "concat('o', l_orderkey)", "concat('l', l_orderkey, '.', l_linenumber)", "l_orderkey"))
    )


@query(
    "caller_paths",
    f"""WITH RECURSIVE {EDGES_SQL}, t AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth, NULL::BIGINT AS call_site,
        ['r' || r_regionkey] AS path, true AS open FROM region
      UNION ALL SELECT t.root, e.caller, t.depth + 1, e.call_site, list_append(t.path, e.caller), NOT list_contains(t.path, e.caller)
        FROM t JOIN edges e ON e.callee = t.node WHERE t.open AND t.depth < 4)
    SELECT root, node, depth, call_site, array_to_string(path, '>') AS path FROM t""",
)
def caller_paths_query(spark, sf):
    roots = tb.load(spark, sf, "region").selectExpr("concat('r', r_regionkey) as node")
    out = rl.caller_paths(call_edges(spark, sf), roots)
    return out.select("root", "node", "depth", "call_site", F.array_join("path", ">").alias("path"))


# One file per region: nation and customer declarations, references inside them.
UNIT = 10_000_000_000


def region_file(spark, sf):
    n = tb.load(spark, sf, "nation").selectExpr("n_nationkey", "n_name", "concat('/r/', n_regionkey) as file_path", f"n_nationkey * {UNIT}L + 1000 as n_line")
    c = tb.load(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "c_custkey", "c_name", "file_path", "n_line", "n_line + 1000 * (c_custkey + 1) as c_line"
    )
    return n, c


def owned_references(spark, sf):
    n, c = region_file(spark, sf)
    marks = n.selectExpr("file_path", "n_line as line", "n_name as name").unionByName(
        c.selectExpr("file_path", "c_line as line", "c_name as name")
    )
    o = tb.load(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    refs = (
        n.selectExpr("concat('n', n_nationkey) as ref_id", "file_path", "n_line as line", "concat(file_path, ':0') as target")
        .unionByName(c.selectExpr("concat('c', c_custkey)", "file_path", "c_line", "concat(file_path, ':', n_line)").toDF("ref_id", "file_path", "line", "target"))
        .unionByName(o.selectExpr("concat('o', o_orderkey)", "file_path", "c_line + dayofyear(o_orderdate)", "concat(file_path, ':', n_line)").toDF("ref_id", "file_path", "line", "target"))
        # A region is also used at the top of its own file, outside any declaration.
        .unionByName(tb.load(spark, sf, "region").selectExpr("concat('r', r_regionkey)", "concat('/r/', r_regionkey)", "7L", "concat('/r/', r_regionkey, ':0')").toDF("ref_id", "file_path", "line", "target"))
    )
    return rl.enclosing_declaration(refs, marks, number_chunk(F.col("line"), 1_000_000))


@query(
    "caller_paths_from_refs",
    f"""WITH n AS (SELECT n_nationkey, n_name, '/r/' || n_regionkey AS f, n_nationkey::BIGINT * {UNIT} + 1000 AS nl FROM nation),
    c AS (SELECT c_custkey, c_name, f, nl, nl + 1000 * (c_custkey + 1) AS cl FROM customer JOIN n ON c_nationkey = n_nationkey)
    SELECT '/r/' || r_regionkey || ':0' AS root, '/r/' || r_regionkey || ':0' AS node, 0 AS depth, NULL::BIGINT AS call_site, NULL AS name FROM region
    UNION ALL SELECT f || ':0', f || ':' || nl, 1, nl, n_name FROM n
    UNION ALL SELECT '/r/' || r_regionkey || ':0', '/r/' || r_regionkey || ':7', 1, 7, 'call at line 8' FROM region
    UNION ALL SELECT f || ':0', f || ':' || cl, 2, cl, c_name FROM c""",
)
def caller_refs_query(spark, sf):
    roots = tb.load(spark, sf, "region").selectExpr("concat('/r/', r_regionkey, ':0') as node")
    out = rl.caller_paths_from_refs(rl.caller_edges(owned_references(spark, sf)), roots)
    return out.select("root", "node", "depth", "call_site", "name")
