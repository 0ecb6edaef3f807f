"""The fuzzy score, matched positions and highlight ranges.

Score of a query `q` against a text `t` (both folded, see `fold`):

* equal: 1.0
* contained: 0.70 + 0.25 * |q|/|t|, plus 0.04 at the start
* characters of `q` (spaces dropped, n of them) found in order, leftmost first:
  0.60 * n / span * (0.5 + 0.5 * n/|t|)
* otherwise: no match (NULL)

All functions take column names and return one SQL expression. Lambda variables end
in `_` so that they cannot hide a caller's column.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def query_chars(q: str) -> Column:
    """Characters of a query without spaces; computed once per query."""
    return F.expr(f"filter(split({q}, ''), c_ -> c_ != '' and c_ != ' ')")


def _last_position(chars: str, text: str) -> str:
    """1-based position of the last character of the leftmost match, 0 if none.

    The carried value is the last position, -1 before the first character and 0
    for good once a character is missing (nothing is found from position 0).
    """
    return (
        f"aggregate({chars}, -1, (at_, ch_) -> "
        f"locate(ch_, {text}, if(at_ = -1, 1, if(at_ = 0, 0, at_ + 1))))"
    )


def fuzzy_score(q: str, chars: str, text: str) -> Column:
    """Score in (0, 1] or NULL. The cheap arms come first; the scan for scattered
    characters is bound to a variable, so it runs once per text."""
    n, m, k = f"length({q})", f"length({text})", f"size({chars})"
    span = f"(last_ - instr({text}, {chars}[0]) + 1)"
    return F.expr(
        f"""CASE WHEN {text} = {q} THEN 1.0D
        WHEN contains({text}, {q}) THEN
          0.70D + 0.25D * {n} / {m} + if(startswith({text}, {q}), 0.04D, 0.0D)
        WHEN {text} IS NOT NULL THEN
          transform(array({_last_position(chars, text)}), last_ ->
            if(last_ > 0, 0.6D * {k} / {span} * (0.5D + 0.5D * {k} / {m}), cast(null as double)))[0]
        END"""
    )


def match_positions(q: str, chars: str, text: str) -> Column:
    """0-based matched positions; contiguous when the query is contained."""
    return F.expr(
        f"""CASE WHEN instr({text}, {q}) > 0
        THEN sequence(instr({text}, {q}) - 1, instr({text}, {q}) + length({q}) - 2)
        ELSE aggregate({chars}, cast(array() as array<int>), (acc_, ch_) ->
          if(acc_ is null or locate(ch_, {text}, coalesce(try_element_at(acc_, -1), -1) + 2) = 0,
             cast(null as array<int>),
             concat(acc_, array(locate(ch_, {text}, coalesce(try_element_at(acc_, -1), -1) + 2) - 1))))
        END"""
    )


def to_highlights(positions: str) -> Column:
    """Merge consecutive positions into half-open [start, end) ranges.

    A range starts where the previous position is not the neighbour, and ends
    where the next one is not.
    """
    return F.expr(
        f"""arrays_zip(
          filter({positions}, p_ -> not array_contains({positions}, p_ - 1)),
          transform(filter({positions}, p_ -> not array_contains({positions}, p_ + 1)), p_ -> p_ + 1))
        """
    ).cast("array<struct<start:int,end:int>>")


def highlights_text(ranges: str) -> Column:
    """Ranges as `0-3,5-6` for flat outputs."""
    return F.expr(f"array_join(transform({ranges}, r_ -> concat(r_.start, '-', r_.end)), ',')")
