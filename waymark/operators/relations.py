"""Code relations: reference counts, enclosing declarations, caller paths."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.prefix import number_chunk, running
from waymark.functions.text import count_label
from waymark.schema import CALL_DEPTH
from waymark.session import cut, fresh_dir, union_all
from waymark.sources.bucketed import write_bucketed

# Symbol kinds that get lenses, that can be implemented, that
# are shown with zero implementations, and that have a call chain.
LENS_KINDS = ["class", "interface", "function", "method", "enum", "struct"]
IMPLEMENTABLE = ["class", "interface", "method", "function"]
SHOWN_AT_ZERO = ["class", "interface"]
CALLABLE = ["method", "function"]


def _outside(symbols: DataFrame, uses: DataFrame) -> DataFrame:
    """Uses per symbol, without those whose range covers the declaration.

    Totals come from one partial aggregation, so a hot symbol sends one row per
    task; only uses in the symbol's own file meet its declaration.
    """
    total = uses.groupBy("symbol").agg(F.count("*").alias("total"))
    own = symbols.select("symbol", "file_path", F.col("line").alias("at_line"), F.col("col").alias("at_col"))
    covers = F.expr(
        """(line < at_line or (line = at_line and col <= at_col))
           and (end_line > at_line or (end_line = at_line and end_col >= at_col))"""
    )
    inside = uses.join(own, ["symbol", "file_path"]).filter(covers).groupBy("symbol").agg(F.count("*").alias("own"))
    return (
        symbols.join(total, "symbol", "left")
        .join(inside, "symbol", "left")
        .withColumn("n", F.coalesce("total", F.lit(0)) - F.coalesce("own", F.lit(0)))
        .drop("total", "own")
    )


def reference_counts(symbols: DataFrame, references: DataFrame, min_refs: int = 0) -> DataFrame:
    """References of each symbol from elsewhere; below the minimum hidden.

    `symbols(symbol, file_path, line, col)`, `references(symbol, file_path,
    line, col, end_line, end_col)`.
    """
    counted = _outside(symbols, references).filter(F.col("n") >= min_refs)
    return counted.withColumn("label", count_label(F.col("n"), "reference"))


def implementation_counts(symbols: DataFrame, implementations: DataFrame) -> DataFrame:
    """Implementations of symbols that can have some (`kind`, `parent_kind`).

    Zero is shown only for classes, interfaces and members of interfaces.
    """
    able = symbols.filter(F.col("kind").isin(IMPLEMENTABLE))
    counted = _outside(able, implementations)
    keep = F.col("kind").isin(SHOWN_AT_ZERO) | F.col("parent_kind").eqNullSafe("interface")
    return counted.filter((F.col("n") > 0) | keep).withColumn("label", count_label(F.col("n"), "implementation"))


def parent_kind(symbols: DataFrame) -> DataFrame:
    """Kind of the same-named container in the file; the last definition wins."""
    kinds = symbols.groupBy("file_path", F.col("name").alias("container")).agg(
        F.max_by("kind", "ord").alias("parent_kind")
    )
    return symbols.join(kinds, ["file_path", "container"], "left")


def lens_rows(symbols: DataFrame) -> DataFrame:
    """One to three lens rows per eligible symbol."""
    lenses = F.array(
        F.lit("reference"),
        F.when(F.col("kind").isin(IMPLEMENTABLE), F.lit("implementation")),
        F.when(F.col("kind").isin(CALLABLE), F.lit("callChain")),
    )
    return symbols.filter(F.col("kind").isin(LENS_KINDS)).withColumn(
        "lens", F.explode(F.filter(lenses, lambda x: x.isNotNull()))
    )


# --------------------------------------------------------------- as-of lookups

# The modifiers that begin a method declaration, and the words of a boundary.
MODIFIERS = "public|private|protected|internal|static|virtual|override|async|abstract|partial|readonly|extern|new|sealed"
BOUNDARY_LINE = r"class |interface |namespace "
# A generic method without a modifier, by the C# grammar: its name, type parameters, parameters
# (themselves with parentheses once), constraints, and a body that begins on the line.
_TYPE = r"[\w.?\[\]]+"
_TYPE_PARAMETERS = rf"<\s*{_TYPE}(?:\s*,\s*{_TYPE})*\s*>"
_PARAMETERS = r"\((?:[^()]*\([^()]*\))*[^()]*\)"
_CONSTRAINTS = rf"(?:\s*where\s+\w+\s*:\s*{_TYPE}(?:\(\))?(?:\s*,\s*{_TYPE}(?:\(\))?)*)*"
# Forms of a method declaration, the first that fits; the name is group 1.
METHOD_LINES = (
    rf"(?:{MODIFIERS})\s+(?:[\w<>\[\],.?]+\s+)*(\w+)\s*(?:<[^>]+>\s*)?\(",
    rf"(\w+)\s*{_TYPE_PARAMETERS}\s*{_PARAMETERS}{_CONSTRAINTS}\s*\{{",
)


def declaration_marks(lines: DataFrame, method=METHOD_LINES, boundary: str = BOUNDARY_LINE) -> DataFrame:
    """Lines that decide the owner of what follows: `(file_path, line, name)`.

    `method` is one pattern or several, tried in order.

    A declaration carries its name, a boundary carries NULL. Blank and brace
    lines decide nothing; a comment can declare but cannot be a boundary.
    """
    text = F.trim("text")
    forms = [method] if isinstance(method, str) else method
    found = F.coalesce(*(F.nullif(F.regexp_extract(text, form, 1), F.lit("")) for form in forms))
    comment = text.rlike(r"^(//|/\*|\*)")
    edge = ~comment & text.rlike(boundary)
    return (
        lines.filter(~text.isin("", "{", "}"))
        .select("file_path", "line", found.alias("name"), edge.alias("_edge"))
        .filter(F.col("name").isNotNull() | F.col("_edge"))
        .select("file_path", "line", "name")
    )


def enclosing_declaration(references: DataFrame, marks: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Nearest declaration at or above each reference `(ref_id, file_path, line)`.

    A backward as-of lookup: marks and references are ordered together per file,
    in chunks, and the last mark is carried forward. A boundary, or nothing
    above, gives `call at line N` at the reference itself.
    """
    part = number_chunk(F.col("line")) if chunk is None else chunk
    extra = [c for c in references.columns if c not in ("file_path", "line", "ref_id")]
    m = marks.select(
        "file_path", "line", F.lit(0).alias("_side"), F.lit(None).cast(references.schema["ref_id"].dataType).alias("ref_id"),
        F.struct(F.col("line").alias("line"), F.col("name").alias("name")).alias("_mark"),
        *[F.lit(None).cast(references.schema[c].dataType).alias(c) for c in extra],
    )
    r = references.select(
        "file_path", "line", F.lit(1).alias("_side"), "ref_id",
        F.lit(None).cast(m.schema["_mark"].dataType).alias("_mark"), *extra,
    )
    seen = running(m.unionByName(r), ["file_path"], ["line", "_side", "ref_id"], part, {"_owner": ("last", F.col("_mark"))})
    inside = F.col("_owner.name").isNotNull()
    return seen.filter("_side = 1").select(
        "ref_id", "file_path", "line", *extra,
        F.when(inside, F.col("_owner.name"))
        .otherwise(F.concat(F.lit("call at line "), (F.col("line") + 1).cast("string"))).alias("owner"),
        F.when(inside, F.col("_owner.line")).otherwise(F.col("line")).alias("owner_line"),
    )


#: Positions and symbols that one task sorts.
TASK_ROWS = 1_000_000


def enclosing_symbol(positions: DataFrame, symbols: DataFrame, chunk: Column | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Outermost symbol whose range contains each `(pos_id, file_path, line, col)`.

    Among ranges that start at or before a position, the one that ends last is
    the outermost, provided it ends at or after the position (ranges nest). So
    a running maximum replaces a range join; equal ranges: the later `ord` wins.
    Above `task_rows` rows the number of tasks follows the rows, so that of a task does not grow.
    """
    part = number_chunk(F.col("line")) if chunk is None else chunk
    best = F.struct(
        F.col("end_line").alias("end_line"), F.col("end_col").alias("end_col"),
        (-F.col("line")).alias("n_line"), (-F.col("col")).alias("n_col"),
        F.col("ord").alias("ord"), F.col("name").alias("name"),
    )
    s = symbols.select("file_path", "line", "col", F.lit(0).alias("_side"), F.col("ord").alias("_tie"), best.alias("_best"))
    p = positions.select(
        "file_path", "line", "col", F.lit(1).alias("_side"), F.col("pos_id").alias("_tie"),
        F.lit(None).cast(s.schema["_best"].dataType).alias("_best"),
    )
    # Written, so that where the positions come from runs once and the rows tell the tasks.
    rows = cut(s.unionByName(p), "positions")
    n = rows.count()
    tasks = max(-(-n // task_rows), rows.sparkSession.sparkContext.defaultParallelism) if n > task_rows else None
    seen = running(rows, ["file_path"], ["line", "col", "_side", "_tie"], part, {"_out": ("max", F.col("_best"))}, tasks)
    holds = F.expr("_out.end_line > line or (_out.end_line = line and _out.end_col >= col)")
    return seen.filter("_side = 1").select(
        F.col("_tie").alias("pos_id"), "file_path", "line", "col", F.when(holds, F.col("_out.name")).alias("symbol")
    )


def symbols_by_position(symbols: DataFrame) -> DataFrame:
    """One symbol per file, line and column; the later one wins."""
    return symbols.groupBy("file_path", "line", "col").agg(F.max_by("name", "ord").alias("name"))


# ----------------------------------------------------------------- caller paths


#: Edges of a callee that lie together; one with more is split into parts of about as many.
HUB_EDGES = 50_000


class Adjacency(NamedTuple):
    """Edges stored by `callee` and `part`, and the number of `parts` of the callees that have several."""

    edges: DataFrame
    hubs: DataFrame


def adjacency(edges: DataFrame, hub_edges: int = HUB_EDGES) -> Adjacency:
    """Store `edges(callee, caller, ...)` once in buckets for walks that join them level by level."""
    spark = edges.sparkSession
    parts = F.ceil(F.col("n") / hub_edges).cast("int")
    hubs = cut(edges.groupBy("callee").agg(F.count("*").alias("n")).filter(F.col("n") > hub_edges).select("callee", parts.alias("parts")), "hubs")
    dealt = F.coalesce(F.pmod(F.xxhash64(*[c for c in edges.columns if c != "callee"]), F.col("parts")).cast("int"), F.lit(0))
    split = edges.join(hubs, "callee", "left").withColumn("part", dealt).drop("parts")
    return Adjacency(write_bucketed(split, fresh_dir(spark, "edges"), ["callee", "part"]), hubs)


def step_up(tips: DataFrame, to: Adjacency) -> DataFrame:
    """`tips(callee, ...)` with the edges of their callees; a tip goes to every part of a hub, no edge is moved."""
    parts = tips.join(to.hubs, "callee", "left")
    parts = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")
    return parts.join(to.edges, ["callee", "part"]).drop("part")


def caller_paths(edges: DataFrame | Adjacency, roots: DataFrame, depth: int = CALL_DEPTH) -> DataFrame:
    """Incoming-call paths of `roots(node)` over `edges(callee, caller, call_site)`.

    One child per call site. A node already on its own path is emitted but not
    expanded. Each level is written once and read by the next; nothing is cut. Edges are
    stored in buckets first (or given so, see `adjacency`), so a level shuffles its tips only.
    """
    to = edges if isinstance(edges, Adjacency) else adjacency(edges.select("callee", "caller", "call_site"))
    level = roots.select(
        F.col("node").alias("root"), "node", F.lit(0).alias("depth"),
        F.lit(None).cast(to.edges.schema["call_site"].dataType).alias("call_site"),
        F.array("node").alias("path"), F.lit(True).alias("open"),
    )
    levels = [level]
    for d in range(1, depth + 1):
        tips = level.filter("open").select("root", "path", F.col("node").alias("callee"))
        step = step_up(tips, to).select(
            "root", F.col("caller").alias("node"), F.lit(d).alias("depth"), "call_site",
            F.concat("path", F.array("caller")).alias("path"),
            (~F.array_contains("path", F.col("caller"))).alias("open"),
        )
        level = cut(step, "callers")
        levels.append(level)
    return union_all(levels)


def caller_edges(owned: DataFrame) -> DataFrame:
    """Distinct callers per target from references with their owner.

    `owned(target, file_path, line, owner, owner_line)`; the first reference of
    an owner gives the call site.
    """
    return owned.groupBy(
        F.col("target").alias("callee"),
        F.concat_ws(":", "file_path", "owner_line").alias("caller"),
    ).agg(F.min(F.struct("line", "owner")).alias("c")).select(
        "callee", "caller", F.col("c.line").alias("call_site"), F.col("c.owner").alias("name")
    )


def caller_paths_from_refs(edges: DataFrame | Adjacency, roots: DataFrame, depth: int = CALL_DEPTH) -> DataFrame:
    """As `caller_paths` over `caller_edges`; a caller already on the path is
    dropped. The root itself does not count as visited."""
    to = edges if isinstance(edges, Adjacency) else adjacency(edges.select("callee", "caller", "call_site", "name"))
    level = roots.select(
        F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("call_site"),
        F.lit(None).cast("string").alias("name"), F.array().cast("array<string>").alias("path"),
    )
    levels = [level]
    for d in range(1, depth + 1):
        tips = level.select("root", "path", F.col("node").alias("callee"))
        step = (
            step_up(tips, to)
            .filter(~F.array_contains("path", F.col("caller")))
            .select(
                "root", F.col("caller").alias("node"), F.lit(d).alias("depth"),
                F.col("call_site").cast("bigint").alias("call_site"), "name",
                F.concat("path", F.array("caller")).alias("path"),
            )
        )
        level = cut(step, "callers")
        levels.append(level)
    return union_all(levels)
