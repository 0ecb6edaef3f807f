"""Literal, case-insensitive text search with exact offsets."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.pairing import pair_by_substring
from waymark.operators.postings import GramIndex, found_lines
from waymark.schema import MAX_FILE_BYTES
from waymark.session import cut

# Characters removed at both ends of a shown line.
BLANKS = r"' \t\r\n\u000b\u000c   ﻿'"


def grep_guards(docs: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Leave out files above the size limit (`size` in bytes, NULL = unknown)."""
    return docs.filter(F.coalesce(F.col("size"), F.lit(0)) <= max_bytes)


def _needles(queries: DataFrame) -> DataFrame:
    """Search texts `(qid, query, max_results)`; empty ones find nothing, without a count all lines."""
    return queries.filter("trim(query) <> ''").selectExpr("qid", "lower(query) as q_low", f"coalesce(max_results, {2**31 - 1}) as k")


def matching_lines(
    docs: DataFrame | GramIndex, queries: DataFrame, small: bool | None = None, max_bytes: int | None = None, max_line: int | None = None
) -> DataFrame:
    """Lines that contain a query, one row per (query, line).

    `docs` are documents or their stored index (`postings.text_index`). Documents are
    matched whole first, their lines parted once, and only lines with a hit leave them; an
    index gives the candidates of all queries in one pass. Blank lines are left out; files
    above `max_bytes` and lines above `max_line` characters only where a caller asks for it.
    """
    asked = _needles(queries)
    if isinstance(docs, GramIndex):
        # Read by several steps; where the texts come from is read once.
        asked = cut(asked, "needles")
        lines = found_lines(docs, asked, blanks=F.expr(BLANKS))
        if max_bytes is not None:
            lines = grep_guards(lines, max_bytes)
    else:
        found = docs if max_bytes is None else grep_guards(docs, max_bytes)
        keep = [c for c in docs.columns if c != "text"]
        parted = found.select(*keep, F.lower("text").alias("text_low"), F.split("text", "\n").alias("lines"))
        pairs = pair_by_substring(parted, asked, ["text_low"], "q_low", F.lit(True), small)
        numbered = F.transform("lines", lambda raw, i: F.struct(i.alias("line"), raw.alias("raw"), F.lower(raw).alias("raw_low")))
        hits = F.filter(numbered, lambda x: F.contains(x["raw_low"], F.col("q_low")))
        lines = pairs.select(*keep, "qid", "q_low", "k", F.inline(hits)).filter(f"btrim(raw, {BLANKS}) <> ''")
    if max_line is not None:
        lines = lines.filter(F.length("raw") <= max_line)
    return (
        lines.withColumn("name", F.expr(f"btrim(raw, {BLANKS})"))
        .withColumn("indent", F.expr(f"length(raw) - length(ltrim({BLANKS}, raw))"))
    )


def grep(docs: DataFrame | GramIndex, queries: DataFrame, small: bool | None = None, **limits) -> DataFrame:
    """First match of each line: 0-based line and column, shown text, highlight."""
    hits = matching_lines(docs, queries, small, **limits).withColumn("column", F.expr("instr(raw_low, q_low) - 1"))
    start = F.expr("greatest(0, column - indent)")
    return hits.withColumn("hl_start", start).withColumn("hl_end", F.expr("hl_start + length(q_low)"))


def grep_submatches(docs: DataFrame | GramIndex, queries: DataFrame, small: bool | None = None, **limits) -> DataFrame:
    """Every match of each line; offsets are relative to the shown text.

    The pieces between matches give the running offsets.
    """
    hits = matching_lines(docs, queries, small, **limits).withColumn("_parts", F.expr("split(raw_low, concat('\\\\Q', replace(q_low, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E'))"))
    starts = F.expr(
        r"""aggregate(
          slice(_parts, 1, size(_parts) - 1),
          named_struct('at', 0, 'all', cast(array() as array<int>)),
          (acc, piece) -> named_struct(
            'at', acc.at + length(piece) + length(q_low),
            'all', concat(acc.all, array(acc.at + length(piece)))),
          acc -> acc.all)"""
    )
    shift = F.expr(
        """transform(starts, s -> named_struct('start', greatest(0, s - indent),
             'end', greatest(0, s + length(q_low) - indent)))"""
    )
    return hits.withColumn("starts", starts).withColumn("column", F.expr("starts[0]")).withColumn("submatches", shift).drop("_parts")


def first_hits(hits: DataFrame, open_files: DataFrame | None = None) -> DataFrame:
    """The first k hits per query in file and line order, open files first.

    A separate per-file cap of at least k rows could never bite after this cut.
    """
    if open_files is None:
        flagged = hits.withColumn("is_open", F.lit(False))
    else:
        opened = open_files.select("file_path", F.lit(True).alias("is_open")).distinct()
        flagged = hits.join(opened, "file_path", "left").withColumn("is_open", F.coalesce("is_open", F.lit(False)))
    w = Window.partitionBy("qid").orderBy(F.desc("is_open"), "seq", "line")
    return flagged.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= F.col("k"))


def text_items(hits: DataFrame, *keep: str) -> DataFrame:
    """Hits as result rows of type text, with the columns `keep` of the hits."""
    return hits.select(
        "qid",
        *keep,
        F.concat_ws(":", F.lit("text"), "file_path", "line", "column").alias("id"),
        "name",
        F.lit("text").alias("type"),
        "file_path",
        "line",
        "column",
        F.lit(1.0).alias("score"),
        "hl_start",
        "hl_end",
    )
