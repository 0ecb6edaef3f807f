"""Personal data by bootstrapped contextual extraction, with SQL functions and joins only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. They seed the
bootstrapping: the words around each seed are lexical patterns. Patterns and values form a
graph; in each round a pattern is scored by the confidence of the distinct values that it
surrounds, and a value that no base pattern took by the good patterns around it, until no
value is added. What a value looks like is a coarse form apart from the patterns: a value
counts for the kinds whose seeds have its form. Values of high confidence are spans of the
seeds' kind.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import Scratch, text_or_empty
from waymark.llm.rules import bound

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns. A match begins where the last one ended or where no longer run begins,
#: and runs never give back: the same matches as without these marks, in time proportional to the text.
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without these have no match.
GATE = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: What may be an identifier that the base patterns missed: a token with a digit or @, up to its last letter or digit.
TOKEN, TOKEN_GATE = r"(?<![A-Za-z0-9@._%+()-])(?=[A-Za-z._%+()-]*[0-9@])[A-Za-z0-9@._%+()-]*[A-Za-z0-9]", r"[0-9@]"
#: Or a run of groups of digits with single spaces, or a dash in spaces, between them.
RUN = r"(?<![A-Za-z0-9@._%+()-])[+(]*+[0-9](?:[0-9().+-]*[0-9])?+(?:\)?\x20(?:-\x20)?[+(]*+[0-9](?:[0-9().+-]*[0-9])?+)++(?![A-Za-z@])"
RUN_GATE = r"[0-9]\)?\x20(?:-\x20)?[+(]*[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IP_VALID = rf"^{PART}\.{PART}\.{PART}\.{PART}$"
CONTEXT = 64
MIN_SCORE, MIN_CONFIDENCE = 0.8, 0.9
SPAN = "array<struct<kind:string,begin:int,stop:int,value:string,before:string,after:string>>"


def found(text: Column, pattern: str, kind: str | None) -> Column:
    """Leftmost matches that do not overlap, with places in code points and what stands around them."""

    def placed(p: Column) -> Column:
        pairs = F.arrays_zip(p["parts"].alias("part"), p["values"].alias("value"), F.slice(p["parts"], F.lit(2), F.size(p["values"])).alias("rest"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def add(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["part"])
            stop = begin + F.length(x["value"])
            span = F.struct(
                F.lit(kind).cast("string").alias("kind"), begin.alias("begin"), stop.alias("stop"), x["value"].alias("value"),
                F.right(x["part"], F.lit(CONTEXT)).alias("before"), F.left(x["rest"], F.lit(CONTEXT)).alias("after"),
            )
            return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(F.slice(pairs, F.lit(1), F.size(p["values"])), start, add, lambda acc: acc["out"])

    both = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))
    return bound(both, placed)


def luhn(digits: Column) -> Column:
    def value(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).otherwise(F.when(n > 4, 2 * n - 9).otherwise(2 * n))

    each = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return {
        "email": F.lit(True),
        "ip": value.rlike(IP_VALID),
        "card": F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False)),
        "phone": F.length(digits).between(8, 15),
    }[kind]


def base_spans(text: Column, kind: str) -> Column:
    none = F.array().cast(SPAN)
    return F.when(text.rlike(GATE[kind]), F.filter(found(text, PATTERN[kind], kind), lambda s: valid(kind, s["value"]))).otherwise(none)


def _named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["stop"].cast("string"))), ",")


def _form(value: Column) -> Column:
    """With @, seven or more digits, four or more in three or more groups; else null. Every seed has one."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    dotted = value.rlike(r"[0-9]\.[0-9]+\.[0-9]")
    return F.when(value.contains("@"), "at").when(digits >= 7, "many").when((digits >= 4) & dotted, "dotted")


def _patterns(span: Column) -> Column:
    """The lexical patterns around a span: two words before, one on each side, two after; `_` is the value, `^` no word."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: w != "")

    def of(x: Column) -> Column:
        left, right = x["left"], x["right"]
        n = F.size(left)
        word = lambda c, i: F.coalesce(F.get(c, i), F.lit("^"))
        each = F.array(
            F.concat_ws(" ", word(left, n - 2), word(left, n - 1), F.lit("_")),
            F.concat_ws(" ", word(left, n - 1), F.lit("_"), word(right, F.lit(0))),
            F.concat_ws(" ", F.lit("_"), word(right, F.lit(0)), word(right, F.lit(1))),
        )
        return F.filter(each, lambda p: p.rlike(r"\p{L}"))

    return bound(F.struct(words(span["before"]).alias("left"), words(span["after"]).alias("right")), of)


def discover(spans: DataFrame, scratch: Scratch, rounds: int | None = None, min_score: float = MIN_SCORE, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(value, kind) of the values that the patterns around the seeds vouch for.

    `spans` has value, kind (null: not a seed) and patterns. A pattern's score for a kind is
    the confidence of its distinct values over the number of those with a form of this
    kind's seeds plus one, so few values never score high. A value's doubt is the product of
    the doubts of its patterns that score `min_score` or more. Ends when no value is added,
    or after `rounds` if given.
    """
    edges = spans.select("value", "kind", _form(F.col("value")).alias("form"), F.explode("patterns").alias("pattern")).distinct()
    edges = scratch.write(edges)
    seeds, others = edges.where("kind is not null"), edges.where("kind is null")
    # At most one row for each kind and form.
    forms = F.broadcast(scratch.write(seeds.select("kind", "form").distinct().withColumnRenamed("kind", "of")))
    known = seeds.groupBy("pattern", "kind").agg(F.countDistinct("value").alias("sure"))
    size = edges.join(forms, "form").groupBy("pattern", F.col("of").alias("kind")).agg(F.countDistinct("value").alias("n"))
    size = scratch.write(size.join(known, ["pattern", "kind"], "left").withColumn("sure", F.coalesce("sure", F.lit(0))))
    open_edges = scratch.write(others.join(forms, "form").select("value", F.col("of").alias("kind"), "pattern"))
    sure, n_sure, done = None, 0, 0
    while rounds is None or done < rounds or sure is None:
        score = size
        if sure is not None:
            more = open_edges.join(sure, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum("trust").alias("more"))
            score = size.join(more, ["pattern", "kind"], "left").withColumn("sure", F.col("sure") + F.coalesce("more", F.lit(0.0)))
        good = score.withColumn("score", F.col("sure") / (F.col("n") + 1)).where(F.col("score") >= min_score).select("pattern", "kind", "score")
        doubt = F.sum(F.log(1 - F.least("score", F.lit(0.999))))
        sure = scratch.write(open_edges.join(good, ["pattern", "kind"]).groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("trust")).where(F.col("trust") >= min_confidence))
        before, n_sure, done = n_sure, sure.count(), done + 1
        if n_sure == before:  # trust only grows from round to round, so nothing was exchanged
            break
    best = sure.groupBy("value").agg(F.max(F.struct("trust", F.expr(f"-array_position(array({', '.join(map(repr, KINDS))}), kind)").alias("low"), "kind")).alias("x"))
    return best.select("value", F.col("x.kind").alias("kind"))


def find(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans, n_found) for each row of `docs`.

    `base_spans` and `spans` are arrays of (kind, begin, stop, value), by kind as in KINDS,
    then begin; places are code points, stop exclusive. `spans` has the base ones and those
    found by their context, `n_found` counts the latter. Of found ones inside one another
    the longest stays. A null text has no spans. Repeated rows get equal answers, also
    without a doc_id.
    """
    scratch = Scratch(docs.sparkSession, "contexts")
    text = text_or_empty()
    base = docs.select("doc_id", F.xxhash64("text").alias("mark"), text.alias("text"))
    rows = base.select("doc_id", "mark", "text", *(base_spans(F.col("text"), k).alias(k) for k in KINDS))
    rows = rows.withColumn("base", F.concat(*KINDS))
    # Without a form, nothing can vouch for a value.
    none = F.array().cast(SPAN)
    may = F.concat(
        F.when(F.col("text").rlike(TOKEN_GATE), found(F.col("text"), TOKEN, None)).otherwise(none),
        F.when(F.col("text").rlike(RUN_GATE), found(F.col("text"), RUN, None)).otherwise(none),
    )
    others = F.filter(may, lambda c: _form(c["value"]).isNotNull() & ~F.exists("base", lambda b: (b["begin"] < c["stop"]) & (b["stop"] > c["begin"])))
    rows = scratch.write(rows.select("doc_id", "mark", "base", others.alias("others")))
    spans = rows.select("doc_id", "mark", F.explode(F.concat("base", "others")).alias("s"))
    spans = spans.select("doc_id", "mark", "s.kind", "s.value", F.col("s.begin").alias("begin"), F.col("s.stop").alias("stop"), _patterns(F.col("s")).alias("patterns"))
    known = discover(spans, scratch, **options)
    added = spans.where("kind is null").select("doc_id", "mark", "value", "begin", "stop").distinct().join(known, "value")
    ahead = Window.partitionBy("doc_id", "mark").orderBy("begin", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    added = added.withColumn("upto", F.max("stop").over(ahead)).where("upto is null or upto < stop")
    added = added.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("kind", "begin", "stop", "value")).alias("added"))
    out = rows.join(
        added.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "added"),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")),
        "left",
    )
    slim = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["begin"].alias("begin"), s["stop"].alias("stop"), s["value"].alias("value")))
    more = F.coalesce("added", F.array().cast("array<struct<kind:string,begin:int,stop:int,value:string>>"))
    out = out.withColumn("base_spans", slim).withColumn("added", more)
    by_kind = lambda c, k: F.filter(c, lambda s: s["kind"] == k)
    whole = F.concat(*(F.sort_array(F.transform(F.concat(by_kind("base_spans", k), by_kind("added", k)), lambda s: F.struct(s["begin"].alias("begin"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["value"].alias("value")))) for k in KINDS))
    return out.select(
        "doc_id",
        *(F.size(by_kind("base_spans", k)).cast("long").alias(f"n_{k}") for k in KINDS),
        "base_spans",
        whole.alias("spans"),
        F.size("added").alias("n_found"),
    )


def digest(spans: str) -> Column:
    """kind:start:end of an array of spans, joined by commas."""
    return _named(F.col(spans))
