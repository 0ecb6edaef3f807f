"""Spelling variants: words at one edit from each other, found by scanning sorted lists.

Two words one edit apart agree outside any window that holds the edit. So words meet in
groups with equal ends around a window; what lies inside, their cores, is sorted, and each
word scans the list with an edit matrix of three cells a row (the band of one edit). Rows
are kept for the prefix a core shares with the one before it, and once every cell of a row
passes one, all cores with that prefix are skipped. Windows start as halves of a word.
Groups above a bound are dealt again with windows half as wide, down to one code point,
where the alphabet bounds them; so no task holds a large group, and none is cut.
"""

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Scratch, text_or_empty

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups above this many words are dealt again with narrower windows.
MOST = 64
#: After every code point.
LAST = "\U0010ffff"


def words(docs: DataFrame, drop_every: int = 97, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n) of all whole texts.

    Runs of letters, A-Z lower-cased. Where `drop_every` divides h = crc32 of
    `<doc_id>:<run>`, the code point h % length is deleted (0: none is). A null text has no
    runs; a null doc_id is written as the empty string.
    """
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    run = F.explode(F.regexp_extract_all(F.translate(text_or_empty(), UPPER, LOWER), F.lit(RUN), F.lit(0)))
    runs = docs.select(doc.alias("doc"), run.alias("run"))
    word = F.col("run")
    if drop_every:
        runs = runs.withColumn("h", F.crc32(F.encode(F.concat("doc", F.lit(":"), "run"), "UTF-8")))
        at = (F.col("h") % F.length("run")).cast("int")
        without = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        word = F.when(F.col("h") % drop_every == 0, without).otherwise(word)
    counted = runs.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _ends(lo: Column, hi: Column) -> Column:
    """Key of a word's class, window, and what it has outside of it."""
    head = F.substring(F.col("word"), F.lit(1), lo)
    tail = F.substring(F.col("word"), F.length("word") - (F.col("size") - hi) + 1, F.col("size") - hi)
    return F.concat_ws(":", F.col("size"), lo, hi, head, tail)


def _windows(rows: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Both halves of each window."""
    middle = F.floor((lo + hi) / 2).cast("int")
    halves = F.explode(F.array(F.struct(lo.alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), hi.alias("hi"))))
    out = rows.select("word", "n", "size", halves.alias("w")).select("word", "n", "size", "w.lo", "w.hi")
    return out.withColumn("ends", _ends(F.col("lo"), F.col("hi")))


def scan(query: str, cores: list[str]) -> list[int]:
    """Places in a sorted list of the cores exactly one edit from `query`.

    Row d of the matrix holds the distances of a core's first d code points to the first
    d-1, d and d+1 of the query; 2 stands for anything above one. A row is used again by
    every core that shares those d code points.
    """
    n, out = len(query), []
    rows: list[tuple[int, int, int]] = [(2, 0, 1 if n else 2)]
    i, before = 0, ""
    while i < len(cores):
        core = cores[i]
        shared = 0
        for x, y in zip(core, before):
            if x != y:
                break
            shared += 1
        del rows[shared + 1 :]
        a, b, c = rows[shared]
        dead = False
        for d in range(shared, len(core)):
            x = core[d]  # cells d, d+1, d+2 of the next row, from d-1, d, d+1 of this one
            p = min(a + (0 < d <= n and query[d - 1] != x), b + 1) if d <= n else 2
            q = min(b + (query[d] != x), c + 1, p + 1) if d < n else 2
            r = min(c + (query[d + 1] != x), q + 1) if d + 1 < n else 2
            a, b, c = p, q, r
            if a > 1 and b > 1 and c > 1:
                dead = True
                break
            rows.append((a, b, c))
        before = core[: len(rows) - 1]
        if dead:
            i = bisect_left(cores, core[: d + 1] + LAST, i + 1)
            continue
        gap = n - len(core)
        if -1 <= gap <= 1 and (a, b, c)[gap + 1] == 1:
            out.append(i)
        i += 1
    return out


def _pairs(group: list[tuple[str, int, str]], size: int) -> list[tuple]:
    """(word, n, near, n of near), both ways, of a group's words of `size` with all of it; rows (core, n, word) sorted by core."""
    cores, out = [g[0] for g in group], []
    for core, n, word in group:
        if len(word) == size:
            for k in scan(core, cores):
                _, m, other = group[k]
                out.append((word, n, other, m))
                if len(other) != size:
                    out.append((other, m, word, n))
    return out


def near_words(vocabulary: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """(word, n, near, near_n): each word with each word one edit away, both ways, once.

    A word stands in the classes of its length and of one less, so that every pair meets in
    the class of its shorter word; there its edit lies in one of the windows.
    """
    sizes = F.explode(F.array(F.length("word"), F.length("word") - 1))
    level = _windows(vocabulary.select("word", "n", sizes.alias("size")), F.lit(0), F.col("size"))
    found = []
    while True:
        level = scratch.write(level)
        held = level.groupBy("ends").agg(F.count("*").alias("members"), F.count_if(F.length("word") == F.col("size")).alias("shorter"))
        # Groups of one word, or of longer words only, have no pairs here.
        held = held.where("members > 1 and shorter > 0")
        level = level.join(held, "ends").drop("shorter")
        wide = (F.col("members") > most) & (F.col("hi") - F.col("lo") > 1)
        level = scratch.write(level)
        found.append(level.where(~wide).drop("members"))
        hot = level.where(wide)
        if hot.isEmpty():
            break
        level = _windows(hot, F.col("lo"), F.col("hi"))
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    core = F.substring(F.col("word"), F.col("lo") + 1, F.length("word") - F.col("size") + F.col("hi") - F.col("lo"))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // 20_000))
    rows = rows.select("ends", core.alias("core"), "n", "word", "size").repartition(tasks, "ends").sortWithinPartitions("ends", "core")
    names = ["word", "n", "near", "near_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, size, out = None, [], 0, []
        for batch in batches:
            for ends, core, n, word, of in zip(*(c.to_pylist() for c in batch.columns)):
                if ends != now:
                    out += _pairs(group, size)
                    now, group, size = ends, [], of
                group.append((core, n, word))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
                out = []
        out += _pairs(group, size)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)

    # An edit between equal letters lies in more than one window.
    return rows.mapInArrow(run, "word string, n long, near string, near_n long").distinct()


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by doubling the steps."""
    now = scratch.write(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.alias("a").join(now.alias("b"), F.col("a.root") == F.col("b.word"), "left")
        new = scratch.write(step.select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")


def group_variants(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of all whole texts.

    `form` is the near word of largest n (ties: first in code-point order) if that n is at
    least twice the word's, else null; `root` the end of the chain of forms, the word itself
    without one. Null and empty texts have no words, an empty table gives no rows; rows that
    repeat a doc_id or everything count as often as they stand there. Other columns are
    ignored.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    vocabulary = scratch.write(words(docs))
    near = near_words(vocabulary, scratch, most)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    seen = scratch.write(near.groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), best.alias("best")))
    form_n = -F.col("best.less")
    forms = seen.where(form_n >= 2 * F.col("n")).select("word", F.col("best.form").alias("form"), form_n.alias("form_n"))
    ends = roots(forms, scratch)
    out = vocabulary.join(seen.select("word", "n_near"), "word", "left").join(forms, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")

