"""Matching concrete paths against route templates.

Templates and paths meet in equality joins on a key built from the literal
segments, never in a cross join. A template is expanded into one key per
suffix length (and per prefix of its last literal, since the last segment may
be typed incompletely); a path is expanded into one key per literal pattern
that occurs among templates of its length. A key looks like `=api/*/=users`.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.routes import (
    clean_path,
    clean_template,
    has_catch_all,
    is_parameter,
    path_verb,
    regex_score,
    segments,
    template_regex,
    template_verb,
    verb_bonus,
)
from waymark.session import union_all


def prepare_path(df: DataFrame, col: str) -> DataFrame:
    """Add the verb, cleaned form and segments of a concrete path."""
    clean = clean_path(F.col(col))
    return df.select(
        "*",
        path_verb(F.col(col)).alias("p_verb"),
        clean.alias("p_clean"),
        segments(F.lower(clean)).alias("p_segments"),
    )


def compile_template(df: DataFrame, col: str) -> DataFrame:
    """Add the compiled parts of a route template; empty templates are dropped."""
    clean = clean_template(F.col(col))
    parts = segments(clean)
    odd = F.exists(parts, lambda s: (s == "") | (F.contains(s, F.lit("{")) & ~is_parameter(s)))
    return df.select(
        "*",
        clean.alias("t_clean"),
        template_verb(F.col(col)).alias("t_verb"),
        segments(F.lower(clean)).alias("t_segments"),
        F.transform(parts, is_parameter).alias("t_params"),
        template_regex(clean).alias("t_regex"),
        has_catch_all(clean).alias("t_catch_all"),
        (odd | has_catch_all(clean)).alias("t_irregular"),
    ).filter(F.col("t_clean") != "")


def _marks() -> Column:
    """Segments as `=literal` or `*`; oddly shaped segments count as literals."""
    return F.zip_with(
        F.col("t_segments"), F.col("t_params"),
        lambda s, p: F.when(p, F.lit("*")).otherwise(F.concat(F.lit("="), s)),
    )


def _pattern(marks: Column) -> Column:
    return F.array_join(F.transform(marks, lambda m: F.substr(m, F.lit(1), F.lit(1))), "")


def _literals(marks: Column) -> Column:
    return F.size(F.filter(marks, lambda m: F.startswith(m, F.lit("="))))


def suffix_keys(templates: DataFrame) -> DataFrame:
    """One row per (template, suffix length, prefix of the last literal)."""
    t = templates.withColumn("_marks", _marks())
    t = t.withColumn("m", F.explode(F.sequence(F.lit(1), F.size("_marks"))))
    t = t.withColumn("_suffix", F.slice(F.col("_marks"), F.size("_marks") - F.col("m") + 1, F.col("m")))
    last = F.element_at("_suffix", -1)
    head = F.slice(F.col("_suffix"), F.lit(1), F.col("m") - 1)
    prefixes = F.when(last == "*", F.array(F.lit("*"))).when(
        F.length(last) > 1,
        F.transform(F.sequence(F.lit(2), F.length(last)), lambda n: F.substr(last, F.lit(1), n)),
    )
    t = t.withColumn("_last", F.explode(prefixes))
    last_score = (
        F.when(F.col("_last") == "*", F.lit(0.0))
        .when(F.col("_last") == last, F.lit(0.1))
        .otherwise(F.lit(0.05))
    )
    base = F.when(F.col("m") == F.size("_marks"), F.lit(2.0)).otherwise(F.lit(1.0))
    return t.select(
        *templates.columns,
        F.lit("S").alias("kind"),
        "m",
        _pattern(F.col("_suffix")).alias("pattern"),
        F.array_join(F.concat(head, F.array("_last")), "/").alias("key"),
        (base + F.lit(0.1) * _literals(head) + last_score).alias("key_score"),
    )


def regex_keys(templates: DataFrame) -> DataFrame:
    """Keys of templates that need their regular expression: mixed segments or
    a catch-all. The key covers the plain segments, the expression the rest."""
    t = templates.filter("t_irregular")
    mixed = F.zip_with(
        F.col("t_segments"), F.col("t_params"),
        lambda s, p: F.when(p | F.contains(s, F.lit("{")), F.lit("*")).otherwise(F.concat(F.lit("="), s)),
    )
    lead = F.array_position(
        F.transform(F.col("t_segments"), lambda s: F.contains(s, F.lit("{*"))), True
    ).cast("int") - 1
    t = t.withColumn("_marks", mixed)
    t = t.withColumn(
        "_marks",
        F.when(F.col("t_catch_all") & (lead >= 0), F.slice(F.col("_marks"), F.lit(1), F.greatest(lead, F.lit(0))))
        .when(F.col("t_catch_all"), F.array().cast("array<string>"))
        .otherwise(F.col("_marks")),
    )
    return t.select(
        *templates.columns,
        F.when(F.col("t_catch_all"), F.lit("P")).otherwise(F.lit("F")).alias("kind"),
        F.size("_marks").alias("m"),
        _pattern(F.col("_marks")).alias("pattern"),
        F.array_join("_marks", "/").alias("key"),
        F.lit(None).cast("double").alias("key_score"),
    )


def path_keys(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """Expand each path by the literal patterns that exist for its length."""
    shapes = F.expr(
        """concat(
          array(named_struct('kind', 'S', 'm', size(p_segments)), named_struct('kind', 'F', 'm', size(p_segments))),
          transform(sequence(0, size(p_segments)), i -> named_struct('kind', 'P', 'm', i)))"""
    )
    usable = (
        paths.filter("size(p_segments) > 0")
        .withColumn("_shape", F.explode(shapes))
        .filter("_shape.kind <> 'S' or not array_contains(p_segments, '')")
        .selectExpr(*paths.columns, "_shape.kind as kind", "_shape.m as m")
    )
    key = """array_join(zip_with(slice(p_segments, 1, m), filter(split(pattern, ''), c -> c <> ''),
               (s, p) -> if(p = '*', '*', concat('=', s))), '/') as key"""
    return usable.join(patterns, ["kind", "m"]).selectExpr(*paths.columns, "kind", key)


def template_keys(templates: DataFrame) -> DataFrame:
    """All keys of compiled templates. Templates change rarely: store this table
    with the index and read it back for every search."""
    return union_all([suffix_keys(templates), regex_keys(templates)])


def key_patterns(keys: DataFrame) -> DataFrame:
    """The literal patterns that occur among keys; few, whatever the templates."""
    return keys.select("kind", "m", "pattern").distinct()


def _match(paths: DataFrame, keys: DataFrame, score: str, patterns: DataFrame | None = None) -> DataFrame:
    known = key_patterns(keys) if patterns is None else patterns
    pairs = path_keys(paths, known).join(keys.drop("m", "pattern"), ["kind", "key"])
    # A regex hit outranks the suffix form, so a template scores one way only.
    kept = pairs.filter(
        """CASE WHEN kind <> 'S' THEN regexp_like(p_clean, t_regex)
           WHEN t_irregular THEN not regexp_like(p_clean, t_regex) ELSE true END"""
    )
    value = F.when(F.col("kind") == "S", F.col("key_score")).otherwise(
        regex_score(F.col("p_segments"), F.col("t_params"))
    )
    return kept.withColumn(score, value).drop("kind", "key", "key_score")


def route_scores(paths: DataFrame, templates: DataFrame, score: str = "route_score") -> DataFrame:
    """All (path, template) pairs with a positive score.

    `paths` come from `prepare_path`, `templates` from `compile_template`; the
    two must not share column names.
    """
    return _match(paths, template_keys(templates), score)


def best_routes(
    paths: DataFrame, templates: DataFrame, path_id: str, template_order: str, k: int = 1
) -> DataFrame:
    """The `k` best templates per path, without emitting the weaker pairs.

    Regular templates that share a key and a score are interchangeable up to
    their order, so only `k` of them per key take part in the join.
    """
    keys = template_keys(templates)
    w = Window.partitionBy("kind", "key").orderBy(F.desc("key_score"), F.asc(template_order))
    regular = keys.filter(~F.col("t_irregular"))
    slim = regular.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")
    found = _match(paths, slim.unionByName(keys.filter("t_irregular")), "route_score")
    best = Window.partitionBy(path_id).orderBy(F.desc("route_score"), F.asc(template_order))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def method_gate(matches: DataFrame, query_verb: str = "p_verb", score: str = "route_score") -> DataFrame:
    """Add 0.5 for compatible verbs, drop pairs whose verbs clash."""
    bonus = verb_bonus(F.col(query_verb), F.col("t_verb"))
    return matches.withColumn(score, F.col(score) + bonus).filter(F.col(score).isNotNull())


def route_index(endpoints: DataFrame) -> DataFrame:
    """Key table of endpoint items, for `endpoint_hits`: no item columns but `seq`.

    The expression and parameters of a template are kept only where they are read.
    """
    keys = template_keys(compile_template(endpoints.select("seq", "name"), "name"))
    read = F.col("t_irregular") | (F.col("kind") != "S")
    return keys.select(
        "seq", "kind", "m", "pattern", "key", "key_score", "t_verb", "t_irregular",
        F.when(read, F.col("t_regex")).alias("t_regex"), F.when(read, F.col("t_params")).alias("t_params"),
    )


def cut_keys(keys: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first `k` regular templates of each key and verb.

    They score alike on every path, so the others cannot be among a path's `k` first. Each
    task cuts its own rows before the shuffle, so keys that most templates share (`*`) stay small.
    """
    w = Window.partitionBy("kind", "key", "t_verb").orderBy(*order)
    regular = keys.filter("not t_irregular").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")
    return regular.unionByName(keys.filter("t_irregular"))


def endpoint_hits(
    context: DataFrame, keys: DataFrame, gate: bool = True, patterns: DataFrame | None = None
) -> DataFrame:
    """Path-like queries with the `seq` and route score (`score`) of endpoint items.

    `keys` is a `route_index`, `patterns` its `key_patterns` if stored as well.
    """
    paths = context.select(
        "*",
        F.col("q_verb").alias("p_verb"),
        clean_path(F.col("q_text")).alias("p_clean"),
        F.col("q_segments").alias("p_segments"),
    )
    hits = _match(paths, keys, "score", patterns)
    if gate:
        hits = method_gate(hits, "p_verb", "score")
    return hits.drop("t_verb", "t_irregular", "t_regex", "t_params")
