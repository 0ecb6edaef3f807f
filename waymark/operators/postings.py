"""Substring search over posting lists of three-character grams.

Built once and stored: the rows in buckets of their id, for every gram the sorted ids of
the rows that have it, in lists of one range of ids each, and how many rows that are. A
query looks up its rarest grams, intersects their lists range by range in equality joins,
and only the rows left are read and tested exactly. Any number of queries goes through one
plan that reads the rows once, and no text is shuffled. Where a batch asks for so many texts
of one length that their lists are longer than all text, each window of this length in the
lines is looked up among the texts instead, where the lines lie: grams long enough to be the
answer.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.windows import GRAM, find_in_lines, gram_lists
from waymark.operators.pairing import slices
from waymark.session import cut, fits, fresh_dir, union_all
from waymark.sources.bucketed import write_bucketed

#: Ids of a list lie in one range of 2^12, so no list is longer than that.
RANGE_BITS = 12
#: Grams that a query intersects at most; more hardly narrow its candidates.
RAREST = 3
#: A further gram is used only while it occurs in at most so many times the rows of the rarest.
HOT = 32
#: Texts of one length are found by windows once their lists hold so many times the ids of all lists.
DENSE = 4
#: Texts, and bytes of text, that the lines are searched for at once; more take a further pass over the lines.
AT_ONCE, AT_ONCE_BYTES = 1 << 18, 4 << 20


class GramIndex(NamedTuple):
    """`rows` with their `id`, `lists` (gram, part, ids), `counts` (gram, n).

    The ids of a list are counted from the start of its range, so two bytes hold one.
    """

    rows: DataFrame
    lists: DataFrame
    counts: DataFrame


def grams_of(texts: Column) -> Column:
    """Distinct grams of an array of texts; a text of one or two characters is a gram itself.

    So every substring of up to three characters lies in some gram of its text. The
    lookahead gives overlapping matches, one for each code point. `gram_lists` finds the same.
    """
    pieces = F.transform(
        texts,
        lambda t: F.when(F.length(t) < GRAM, F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{GRAM}}}))."), F.lit(1))),
    )
    return F.filter(F.array_distinct(F.flatten(F.filter(pieces, lambda p: p.isNotNull()))), lambda g: g != "")


def gram_index(rows: DataFrame, row_id: str, texts: Column, written: bool = False) -> GramIndex:
    """Build and store the index of `rows` with a unique whole number `row_id`.

    `texts` is the array of folded texts to search; nulls in it are skipped. A gram that
    every row has is spread over as many lists as there are id ranges. Where `rows` are
    `written`, so that they can be read twice, best in the order of `row_id`, their lists
    are taken from them and come out in fewer pieces.
    """
    spark = rows.sparkSession
    stored = write_bucketed(rows, fresh_dir(spark, "gram-rows"), [row_id], compression="zstd")
    pieces = gram_lists(rows if written else stored, row_id, texts, RANGE_BITS)
    ids = F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids"))))
    lists = write_bucketed(pieces, fresh_dir(spark, "gram-lists"), ["gram"], within=lambda dealt: dealt.groupBy("gram", "part").agg(ids.alias("ids")), compression="zstd")
    counts = cut(lists.groupBy("gram").agg(F.sum(F.size("ids")).alias("n")), "gram-counts")
    return GramIndex(stored, lists, counts)


def rarest_grams(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """(q_low, gram, need) for texts of three characters and more: the grams to intersect.

    A text with a gram that no row has finds nothing and gives no rows.
    """
    asked = texts.filter(F.length("q_low") >= GRAM).select("q_low", F.explode(grams_of(F.array("q_low"))).alias("gram"))
    known = asked.join(counts, "gram", "left").groupBy("q_low").agg(
        F.bool_or(F.col("n").isNull()).alias("lacks"), F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("all")
    )
    chosen = F.filter(F.slice("all", 1, RAREST), lambda g: g["n"] <= HOT * F.col("all")[0]["n"])
    picked = known.filter("not lacks").select("q_low", chosen.alias("chosen"))
    return picked.select("q_low", F.size("chosen").alias("need"), F.explode("chosen.gram").alias("gram"))


def candidates(texts: DataFrame, index: GramIndex) -> DataFrame:
    """Distinct (q_low, id) of the rows that may hold each text of `texts(q_low)`; a superset of those that do."""
    texts = texts.select("q_low").distinct()
    lists = rarest_grams(texts, index.counts).join(index.lists, "gram")
    met = lists.groupBy("q_low", "part").agg(F.collect_list("ids").alias("sets"), F.first("need").alias("need")).filter("size(sets) = need")
    both = F.aggregate(F.slice("sets", 2, RAREST), F.col("sets")[0], lambda a, b: F.array_intersect(a, b))
    row = F.shiftleft("part", RANGE_BITS) + F.col("place")
    long = met.select("q_low", "part", F.explode(both).alias("place")).select("q_low", row.alias("id"))
    # Shorter texts: all grams that hold them, found by the pieces of each gram.
    inside = F.array_distinct(F.filter(F.expr(
        "flatten(transform(sequence(1, 3), i -> transform(sequence(1, 2), n -> substr(gram, i, n))))"
    ), lambda p: p != ""))
    pieces = index.counts.select("gram", F.explode(inside).alias("q_low"))
    short = texts.filter((F.length("q_low") < GRAM) & (F.col("q_low") != "")).join(pieces, "q_low")
    short = short.join(index.lists, "gram").select("q_low", "part", F.explode("ids").alias("place")).select("q_low", row.alias("id")).distinct()
    return long.unionByName(short)


# ------------------------------------------------------------------------ texts

#: Lines of a stored segment.
SEGMENT_LINES = 16


def text_segments(docs: DataFrame, lines: int = SEGMENT_LINES) -> DataFrame:
    """`docs` without `text`, as numbered segments of consecutive lines: (..., first_line, lines, segment)."""
    keep = [c for c in docs.columns if c != "text"]
    whole = docs.select(*keep, F.split("text", "\n").alias("_all"))
    starts = F.sequence(F.lit(0), F.size("_all") - 1, F.lit(lines))
    each = whole.select("*", F.explode(starts).alias("first_line"))
    cut_out = each.select(*keep, "first_line", F.slice("_all", F.col("first_line") + 1, F.lit(lines)).alias("lines"))
    return cut_out.withColumn("segment", F.monotonically_increasing_id())


def text_index(docs: DataFrame, lines: int = SEGMENT_LINES) -> GramIndex:
    """The stored index over the lines of `docs`; a null text has none."""
    # Written first: the numbers of the segments must not change between two readings.
    segments = cut(text_segments(docs.filter("text is not null"), lines), "segments", compression="zstd")
    return gram_index(segments, "segment", F.transform("lines", F.lower), written=True)


def dense_lengths(texts: DataFrame, counts: DataFrame, dense: float = DENSE) -> list[int]:
    """Lengths of which `texts(q_low)` are so many that their lists hold more than `dense` times the ids of all lists."""
    asked = rarest_grams(texts, counts).join(counts, "gram").groupBy(F.length("q_low").alias("n_chars")).agg(F.sum("n").alias("ids"))
    everything = counts.agg(F.sum("n")).scalar()
    return sorted(r["n_chars"] for r in asked.filter(F.col("ids") > dense * everything).select("n_chars").collect())


def not_blank(raw: Column, blanks: Column | None) -> Column:
    """Whether a line has characters other than `blanks`; without them, true of all."""
    return F.lit(True) if blanks is None else F.btrim(raw, blanks) != ""


def window_hits(rows: DataFrame, texts: DataFrame, blanks: Column | None = None) -> DataFrame:
    """The columns of segments `rows`, with `at`, a line that holds a text, for each row of `texts(q_low, ...)`.

    A line holds a text if one of its windows of this length is the text. The distinct texts
    go to the lines, `AT_ONCE` of them in a pass; lines do not travel.
    """
    # Written first: their numbers must not change between two readings.
    words = texts.filter(~F.contains("q_low", F.lit("\n"))).select("q_low").distinct()
    numbered = cut(words.withColumn("n", F.monotonically_increasing_id()), "wanted")
    low = F.transform("lines", lambda raw: F.when(not_blank(raw, blanks), F.lower(raw)).otherwise(F.lit("")))

    def held(part: DataFrame) -> DataFrame:
        found = find_in_lines(rows, "lines", low, part.select("n", "q_low").toArrow())
        each = found.select(*rows.columns, "found_at", F.posexplode("found").alias("_place", "n"))
        each = each.select(*rows.columns, "n", F.get("found_at", F.col("_place")).alias("at"))
        asked = part.join(texts, "q_low")
        return each.join(F.broadcast(asked) if fits(asked, 2 * AT_ONCE) else asked, "n").drop("n")

    return union_all(held(part) for part in slices(numbered, key="q_low", most=AT_ONCE, most_bytes=AT_ONCE_BYTES))


def found_lines(index: GramIndex, texts: DataFrame, dense: float = DENSE, blanks: Column | None = None) -> DataFrame:
    """Lines that hold a text, for each row of `texts(q_low, ...)`: the columns of the documents and of `texts`, line, raw, raw_low.

    Lines of nothing but `blanks`, a text of such characters, are left out where it is given.
    """
    keep = [c for c in index.rows.columns if c not in ("segment", "first_line", "lines")]
    lengths = dense_lengths(texts.select("q_low").distinct(), index.counts, dense)
    crowded = F.coalesce(F.length("q_low").isin(lengths), F.lit(False))
    rest = texts.filter(~crowded) if lengths else texts
    # Folded once for each segment, before its candidates meet it.
    rows = index.rows.withColumn("low", F.lower(F.array_join("lines", "\n")))
    met = rows.join(candidates(rest, index), F.col("segment") == F.col("id")).filter(F.contains("low", F.col("q_low")))
    numbered = F.transform("lines", lambda raw, i: F.struct((F.col("first_line") + i).alias("line"), raw.alias("raw"), F.lower(raw).alias("raw_low")))
    tested = F.filter(numbered, lambda x: F.contains(x["raw_low"], F.col("q_low")) & not_blank(x["raw"], blanks))
    hits = met.select(*keep, "q_low", F.inline(tested)).join(rest, "q_low")
    if lengths:
        held = window_hits(index.rows, texts.filter(crowded), blanks)
        raw = F.get("lines", F.col("at"))
        hits = hits.unionByName(held.select(*keep, *texts.columns, (F.col("first_line") + F.col("at")).alias("line"), raw.alias("raw"), F.lower(raw).alias("raw_low")))
    return hits
