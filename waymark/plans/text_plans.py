"""Queries on literal text search."""

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from waymark.functions.fuzzy import highlights_text
from waymark.functions.text import escape_literal
from waymark.operators import grep as gr
from waymark.operators import results as rs
from waymark.plans import tables as tb
from waymark.plans.registry import query
from waymark.schema import MAX_LINE_CHARS
from waymark.session import union_all

NEEDLES = [(1, "license", 50), (2, "The ", 25), (3, "ré", 40), (4, "@example", 1000), (5, "no such text", 10), (6, "  ", 10)]


def needles(spark):
    return spark.createDataFrame(NEEDLES, "qid int, query string, max_results int")


def documents(spark, sf):
    return tb.document_paths(spark, sf).selectExpr("doc_id as seq", "file_path", "octet_length(text) as size", "text")


def turns(spark, sf):
    return tb.load(spark, sf, "conversations").selectExpr(
        "conv_id * 1000000 + turn as seq", "concat('/chat/', conv_id, '/', turn) as file_path",
        "cast(null as bigint) as size", "text",
    )


NEEDLES_SQL = "needles(qid, query, k) AS (VALUES " + ", ".join(f"({i}, '{q}', {k})" for i, q, k in NEEDLES) + ")"
BLANK_CHARS = "' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11) || chr(160) || chr(8232) || chr(8233) || chr(65279)"


def lines_sql(source: str) -> str:
    """CTEs `hits` for `docs(seq, file_path, size, text)`."""
    return f"""{NEEDLES_SQL}, docs AS ({source}),
lines AS (SELECT seq, file_path, unnest(string_split(text, chr(10))) AS raw,
    unnest(range(0, len(string_split(text, chr(10))))) AS line FROM docs),
hits AS (SELECT qid, k, seq, file_path, line::INTEGER AS line, raw, lower(query) AS q, trim(raw, {BLANK_CHARS}) AS name,
    length(raw) - length(ltrim(raw, {BLANK_CHARS})) AS indent, instr(lower(raw), lower(query)) - 1 AS col
  FROM lines JOIN needles ON contains(lower(raw), lower(query))
  WHERE trim(raw, {BLANK_CHARS}) <> '' AND trim(query) <> '')"""


DOCS_SQL = "SELECT doc_id AS seq, '/'||source||'/'||lang||'/'||doc_id||'.txt' AS file_path, n_chars AS size, text FROM documents"
TURNS_SQL = "SELECT conv_id * 1000000 + turn AS seq, '/chat/'||conv_id||'/'||turn AS file_path, NULL::BIGINT AS size, text FROM conversations"

HIT_COLS = """qid, 'text:'||file_path||':'||line||':'||col AS id, name, line, col::INTEGER AS "column",
    greatest(0, col - indent)::INTEGER AS hl_start, (greatest(0, col - indent) + length(q))::INTEGER AS hl_end"""


@query("grep", f"WITH {lines_sql(DOCS_SQL)} SELECT {HIT_COLS} FROM hits")
def grep_documents(spark, sf):
    hits = gr.text_items(gr.grep(documents(spark, sf), needles(spark)))
    return hits.select("qid", "id", "name", "line", "column", "hl_start", "hl_end")


@query("grep_postings", f"WITH {lines_sql(DOCS_SQL)} SELECT {HIT_COLS} FROM hits")
def grep_by_postings(spark, sf):
    """The rows of `grep`, through posting lists of the lines."""
    hits = gr.text_items(gr.grep(tb.text_grams(spark, sf), needles(spark)))
    return hits.select("qid", "id", "name", "line", "column", "hl_start", "hl_end")


# Every name of a part and of a brand as a text to find, thousands on large data.
WORDS_SQL = """words AS (SELECT DISTINCT lower(p_name) AS q FROM part UNION SELECT DISTINCT lower(p_brand) FROM part
    UNION SELECT DISTINCT lower(substr(text, 1 + doc_id % 40, 7)) FROM documents WHERE length(text) > 50)"""


@query(
    "grep_batch",
    f"""WITH {WORDS_SQL}, asked AS (SELECT q FROM words WHERE trim(q) <> '' AND NOT contains(q, chr(10))),
    lines AS (SELECT doc_id AS seq, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents)
    SELECT q AS query, seq, line::INTEGER AS line FROM lines JOIN asked ON contains(lower(raw), q) WHERE trim(raw, {BLANK_CHARS}) <> ''""",
)
def grep_batch(spark, sf):
    """Many texts at once, through posting lists: every line of each."""
    part, docs = tb.load(spark, sf, "part"), tb.load(spark, sf, "documents").filter("length(text) > 50")
    words = union_all([part.selectExpr("lower(p_name) as query"), part.selectExpr("lower(p_brand) as query"), docs.selectExpr("lower(substr(text, cast(1 + doc_id % 40 as int), 7)) as query")])
    asked = words.distinct().selectExpr("query as qid", "query", "cast(null as int) as max_results")
    return gr.grep(tb.text_grams(spark, sf), asked).select(F.col("qid").alias("query"), "seq", "line")


@query("grep_conversations", f"WITH {lines_sql(TURNS_SQL)} SELECT {HIT_COLS} FROM hits")
def grep_conversations(spark, sf):
    hits = gr.text_items(gr.grep(turns(spark, sf), needles(spark)))
    return hits.select("qid", "id", "name", "line", "column", "hl_start", "hl_end")


@query(
    "grep_guards",
    """SELECT count(*) AS files, sum(len(string_split(text, chr(10))))::BIGINT AS lines,
    sum(len(list_filter(string_split(text, chr(10)), lambda l: length(l) > 10000)))::BIGINT AS long_lines
    FROM documents WHERE octet_length(encode(text)) <= 20971520""",
)
def guards_query(spark, sf):
    kept = gr.grep_guards(documents(spark, sf))
    return kept.selectExpr("size(split(text, '\\n')) as n", f"size(filter(split(text, '\\n'), l -> length(l) > {MAX_LINE_CHARS})) as g").agg(
        F.count("*").alias("files"), F.sum("n").alias("lines"), F.sum("g").alias("long_lines")
    )


# All starts of a match: walk the pieces between matches.
SUBMATCH_SQL = """m0 AS (SELECT qid, k, seq, file_path, line, indent, col, q, unnest(string_split(lower(raw), q)) AS piece,
    unnest(range(0, len(string_split(lower(raw), q)))) AS i FROM hits),
m1 AS (SELECT *, sum(length(piece)) OVER (PARTITION BY qid, seq, line ORDER BY i) + i * length(q) AS s,
    max(i) OVER (PARTITION BY qid, seq, line) AS last FROM m0),
m2 AS (SELECT qid, k, seq, file_path, line, col, i, greatest(0, s - indent)::BIGINT AS a, greatest(0, s + length(q) - indent)::BIGINT AS b
  FROM m1 WHERE i < last),
m3 AS (SELECT qid, any_value(k) AS k, seq, any_value(file_path) AS file_path, line, any_value(col)::INTEGER AS "column",
  string_agg(a || '-' || b, ',' ORDER BY i) AS submatches FROM m2 GROUP BY qid, seq, line)"""


@query(
    "grep_submatches",
    f'WITH {lines_sql(DOCS_SQL)}, {SUBMATCH_SQL} SELECT qid, file_path, line, "column", submatches FROM m3',
)
def submatches_query(spark, sf):
    hits = gr.grep_submatches(documents(spark, sf), needles(spark))
    return hits.select("qid", "file_path", "line", "column", highlights_text("submatches").alias("submatches"))


@query(
    "active_first",
    f"""WITH {lines_sql(DOCS_SQL)}, open_files AS (SELECT '/'||source||'/'||lang||'/'||doc_id||'.txt' AS file_path FROM documents
      WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
    r AS (SELECT *, file_path IN (SELECT file_path FROM open_files) AS is_open FROM hits),
    p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY is_open DESC, seq, line) AS pos FROM r)
    SELECT qid, file_path, line, pos::INTEGER AS pos, is_open FROM p WHERE pos <= k""",
)
def active_first_query(spark, sf):
    hits = gr.first_hits(gr.grep(documents(spark, sf), needles(spark)), tb.open_files(spark, sf))
    return hits.select("qid", "file_path", "line", "pos", "is_open")


@query(
    "escape_literal",
    r"""SELECT page_id, regexp_replace(url, '([.*+?^${}()|\[\]\\])', '\\\1', 'g') AS escaped FROM pages""",
)
def escape_query(spark, sf):
    return tb.load(spark, sf, "pages").select("page_id", escape_literal(F.col("url")).alias("escaped"))


# ------------------------------------------------- highlights in source lines

def text_results(spark, sf):
    """Grep hits with the source line they came from."""
    hits = gr.grep(documents(spark, sf), needles(spark))
    return hits.selectExpr(
        "qid", "file_path", "line", "name", "column as col", "raw as text",
        "array(named_struct('start', hl_start, 'end', hl_end)) as highlights",
    )


@query(
    "project_highlights",
    f"""WITH {lines_sql(DOCS_SQL)}, p AS (SELECT qid, file_path, line,
      least(instr(raw, name) - 1 + greatest(0, col - indent), length(raw))::INTEGER AS range_start,
      least(instr(raw, name) - 1 + greatest(0, col - indent) + length(q), length(raw))::INTEGER AS range_end
      FROM hits WHERE instr(raw, name) > 0)
    SELECT * FROM p WHERE range_start < range_end""",
)
def project_query(spark, sf):
    found = text_results(spark, sf)
    results = found.select("qid", "file_path", "line", "name", "highlights")
    out = rs.project_highlights(rs.source_lines(results, documents(spark, sf)))
    return out.selectExpr("qid", "file_path", "line", "range.start as range_start", "range.end as range_end")


def document_lines(spark, sf):
    """All lines of all documents: (file_path, line, text)."""
    d = documents(spark, sf)
    return d.select("file_path", F.posexplode(F.split("text", "\n")).alias("line", "text"))


@query(
    "locate_symbol",
    f"""WITH {lines_sql(DOCS_SQL)}, s AS (SELECT qid, file_path, line, raw, translate(name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS sym, col FROM hits),
    a AS (SELECT *, coalesce(nullif(instr(raw, sym), 0), nullif(instr(raw, trim(sym)), 0),
      nullif(instr(lower(raw), lower(trim(sym))), 0), col + 1) - 1 AS p0 FROM s)
    SELECT qid, file_path, line, least(p0, length(raw))::INTEGER AS start_col,
      least(least(p0, length(raw)) + length(sym), length(raw))::INTEGER AS end_col FROM a""",
)
def locate_query(spark, sf):
    # Upper-case names force the any-case arm for most lines.
    found = text_results(spark, sf).withColumn("name", F.translate("name", ascii_lowercase, ascii_uppercase))
    return rs.locate_symbol(found).select("qid", "file_path", "line", "start_col", "end_col")


# Each document as one line, with a size beyond the guard's limit.
LONG_SQL = DOCS_SQL.replace("n_chars AS size, text", "31457280 AS size, replace(text, chr(10), ' ') AS text")


@query("grep_long_lines", f"WITH {lines_sql(LONG_SQL)} SELECT {HIT_COLS} FROM hits")
def long_lines_query(spark, sf):
    flat = documents(spark, sf).withColumn("size", F.lit(31457280)).withColumn("text", F.expr("replace(text, '\\n', ' ')"))
    hits = gr.text_items(gr.grep(flat, needles(spark)))
    return hits.select("qid", "id", "name", "line", "column", "hl_start", "hl_end")
