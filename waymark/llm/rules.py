"""Quality rules: a decision list learned by sequential covering.

`features` computes the statistics of each text with SQL functions only. `learn` grows
one rule after the other on the labelled rows: it adds the threshold that gains most
(FOIL gain over the grow part), prunes trailing conditions on the prune part, keeps the
rule while its precision there holds, and takes the covered rows out. Every count is one
Spark aggregation over all labelled rows; only counts reach the driver. `verdict` turns
the list into one ordered CASE expression.
"""

from math import log2
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import SPACE, Scratch, text_or_empty, without

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Ratios the rules may test.
RATIOS = ["symbol_ratio", "repeat_ratio", "dup_line_ratio", "mean_word", "upper_ratio"]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def bound(value: Column, fn) -> Column:
    """`fn(value)` with `value` computed once per row."""
    return F.transform(F.array(value), fn)[0]


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words inside a run of `size` words that occurs at least twice in `words`, first occurrence included.

    Runs are compared by a 64-bit hash of their words.
    """

    def of_runs(runs: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            hit = F.filter(s, lambda x, i: ((i > 0) & (x["h"] == F.get(s, i - 1)["h"])) | (x["h"] == F.get(s, i + 1)["h"]))
            starts = F.sort_array(F.transform(hit, lambda x: x["i"]))

            def covered(p: Column) -> Column:
                return F.aggregate(
                    F.transform(p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - x, F.lit(size)))),
                    F.lit(0).cast("long"),
                    lambda a, x: a + x,
                )

            return bound(starts, covered)

        entries = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0).cast("long")).otherwise(bound(entries, of_sorted))

    def of_words(w: Column) -> Column:
        every = F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, size))))
        runs = F.slice(every, F.lit(1), F.size(w) - (size - 1))
        return F.when(F.size(w) < size, F.lit(0).cast("long")).otherwise(bound(runs, of_runs))

    return bound(words, of_words)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the statistics of each whole text: BASE (long) and RATIOS (double).

    A null or empty text has zeros. Columns of these names in the input are replaced.
    No shuffle.
    """
    base = without(docs, *BASE, *RATIOS, "_words", "_lines", "_body")
    body = text_or_empty(text)
    rows = base.withColumn("_words", F.filter(F.split(body, SPACE), lambda w: w != "")).withColumn(
        "_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )

    def count(pattern: str) -> Column:
        return F.length(body) - F.length(F.regexp_replace(body, pattern, ""))

    rows = rows.select(
        *base.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
        count("[A-Z]").alias("_upper"),
    )

    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return rows.select(
        *base.columns,
        *BASE,
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
        ratio("n_dup_lines", "_n_lines").alias("dup_line_ratio"),
        ratio("word_chars", "n_words").alias("mean_word"),
        ratio("_upper", "word_chars").alias("upper_ratio"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


class Condition(NamedTuple):
    name: str
    above: bool
    value: float

    def column(self) -> Column:
        c = F.col(self.name)
        return c > F.lit(self.value) if self.above else c <= F.lit(self.value)


def holds(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def verdict(rules: list[tuple[Condition, ...]]) -> Column:
    """True (keep) unless a rule, tried in order, rejects: one CASE expression."""
    if not rules:
        return F.lit(True)
    out = None
    for r in rules:
        out = F.when(holds(r), F.lit(False)) if out is None else out.when(holds(r), F.lit(False))
    return out.otherwise(F.lit(True))


def learn(
    labelled: DataFrame,
    label: str = "quality",
    names: list[str] = RATIOS,
    cuts: int = 24,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.9,
    min_rows: int = 5,
) -> list[tuple[Condition, ...]]:
    """Rules that reject rows of label 0, in the order found; [] without rows of both labels.

    `labelled` holds the features and `label` (rows where it is null are left out). A third
    of the rows, by a hash of their statistics, prunes; the others grow. Candidate
    thresholds are quantiles of the rejected and of the kept rows. Ties go to the earlier
    feature and lower threshold, so equal inputs give equal lists.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(
        *(F.coalesce(F.col(n), F.lit(0.0)).cast("double").alias(n) for n in names),
        (F.col(label) == 0).alias("bad"),
        (F.pmod(F.xxhash64(*names), F.lit(3)) == 0).alias("prune"),
    )
    scratch = Scratch(labelled.sparkSession, "rules")
    rows = scratch.write(rows)
    share = [k / (cuts + 1) for k in range(1, cuts + 1)]
    found = rows.groupBy("bad").agg(*(F.percentile_approx(n, share, 10_000).alias(n) for n in names)).collect()
    if len(found) < 2:
        scratch.drop(rows)
        return []
    values = [sorted({v for row in found for v in row[n]}) for n in names]

    # A row's bin is the number of thresholds below its value: value > threshold k when bin > k.
    def bin_of(name: str, thresholds: list[float]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda v: v < F.col(name)))

    bins = F.array(*(bin_of(n, vs) for n, vs in zip(names, values)))
    binned = scratch.write(rows.withColumn("bins", bins))

    def counts(frame: DataFrame) -> tuple[tuple[int, int], list[tuple[Condition, int, int]]]:
        """Rejected-label and kept-label rows in all and under every single condition: one aggregation."""
        got = frame.select("bad", F.posexplode("bins")).groupBy("pos", "col", "bad").count().collect()
        cell = {(r["pos"], r["col"], r["bad"]): r["count"] for r in got}
        of = lambda i, over, bad: sum(cell.get((i, b, bad), 0) for b in over)
        out = []
        for i, (n, vs) in enumerate(zip(names, values)):
            for k, v in enumerate(vs):
                for above, over in ((True, range(k + 1, len(vs) + 1)), (False, range(k + 1))):
                    out.append((Condition(n, above, v), of(i, over, True), of(i, over, False)))
        return tuple(of(0, range(len(values[0]) + 1), bad) for bad in (True, False)), out

    rules: list[tuple[Condition, ...]] = []
    while len(rules) < max_rules:
        rest = binned.where(verdict(rules))
        grow, prune = rest.where(~F.col("prune")), rest.where(F.col("prune"))
        rule: tuple[Condition, ...] = ()
        (p0, n0), tests = counts(grow)
        while p0 >= min_rows and n0 and len(rule) < max_conditions:
            best, at = 0.0, None
            for c, p, n in tests:
                gain = p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p >= min_rows else 0.0
                if gain > best + 1e-9:
                    best, at = gain, (c, p, n)
            if at is None:
                break
            rule, p0, n0 = (*rule, at[0]), at[1], at[2]
            if n0 and len(rule) < max_conditions:
                _, tests = counts(grow.where(holds(rule)))
        if not rule:
            break
        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        seen = prune.agg(*(F.sum((holds(r) & b).cast("int")).alias(f"n{k}{i}") for k, r in enumerate(shorter) for i, b in enumerate((F.col("bad"), ~F.col("bad"))))).first()
        worth = []
        for k, r in enumerate(shorter):
            p, n = seen[f"n{k}0"] or 0, seen[f"n{k}1"] or 0
            worth.append(((p - n) / max(p + n, 1), p, r))
        score, p, rule = max(worth, key=lambda x: (x[0], x[1], -len(x[2])))
        if p < min_rows or (1 + score) / 2 < min_precision:
            break
        rules.append(rule)
    scratch.drop(rows, binned)
    return rules


def apply(docs: DataFrame, labels: DataFrame, text: str = "text", max_labelled: int = 20_000, **options) -> DataFrame:
    """Adds the features, `base_failed` and `kept` to `docs`.

    `labels(doc_id, quality)` may be empty (then only the base rules decide), repeat rows
    (each counts) and name unknown documents (ignored). The list is learned on a sample of
    at most `max_labelled` labels, those with the smallest hash of the id; their statistics
    are computed once more. Every document is judged.
    """
    marks = labels.select("doc_id", "quality").where(F.col("quality").isNotNull())
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    known = docs.select("doc_id", F.col(text).alias("text")).join(marks, "doc_id")
    rules = learn(features(known), **options)
    out = features(without(docs, "base_failed", "kept"), text)
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
