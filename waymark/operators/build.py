"""Index build: symbols, endpoints and settings from texts and symbol rows."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.lexer import code_lines
from waymark.functions.prefix import number_chunk, running
from waymark.functions.scan import scan
from waymark.functions.text import combine_routes, resolve_controller_token, uri_to_path
from waymark.schema import SYMBOL_KIND_TYPES, lookup
from waymark.session import cut, union_all


def relative_path(path: Column, roots: list[str]) -> Column:
    """Path below the first root, in list order, that prefixes it; else unchanged."""
    out = None
    for root in roots:
        base = root.rstrip("/")
        rest = F.substr(path, F.lit(len(base) + 1))
        below = F.when(F.startswith(rest, F.lit("/")), F.substr(rest, F.lit(2))).otherwise(
            F.concat(F.lit("../" + base.rsplit("/", 1)[-1]), rest)
        )
        hit = F.startswith(path, F.lit(root))
        out = F.when(hit, below) if out is None else out.when(hit, below)
    return path if out is None else out.otherwise(path)


# ------------------------------------------------------------------ extraction


class Rule(NamedTuple):
    """Declarations of a language: group 1 of the pattern is the name."""

    language: str
    pattern: str
    type: str


# Rules of our own, for lines without comments and strings (see `lexer.code_lines`).
_C_METHOD = (
    r"^\s*(?:(?:public|private|protected|internal|static|virtual|override|async|abstract|final|sealed)\s+)+"
    r"(?:[\w<>\[\],.?]+\s+)+(\w+)\s*\("
)
_TS_WORDS = r"(?!(?:if|for|while|switch|catch|function|return|constructor|new|super|await|typeof|else|do|with)\b)"
# Parentheses in arguments go one level deep.
_TS_ARGUMENTS = r"\([^();]*(?:\([^();]*\)[^();]*)*\)"
_TS_METHOD = (
    r"^\s+(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*" + _TS_WORDS
    + r"([A-Za-z_$#][\w$]*)\s*(?:<[^>]*>)?" + _TS_ARGUMENTS + r"\s*(?::[^={;]+)?\{"
)
_TS_ARROW = (
    r"^\s+(?:(?:public|private|protected|static|readonly|override|declare)\s+)*([A-Za-z_$#][\w$]*)\s*(?::[^=;]+)?=\s*(?:async\s*)?"
    r"(?:(?:<[^>]*>)?" + _TS_ARGUMENTS + r"|[A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=>"
)
_TS_PROPERTY = r"^\s+(?:(?:public|private|protected|static|readonly|declare)\s+)+([A-Za-z_$][\w$]*)\s*[?!]?\s*[:=;]"
_TS_VARIABLE = r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*[:=;]"
_C_WORDS = r"(?!(?:return|else|if|for|while|switch|typedef|using|namespace|new|delete|throw|case)\b)"
_C_FUNCTION = _C_WORDS + r"(?:[A-Za-z_][\w:<>,]*[\s*&]+)+([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:const\s*)?\{?\s*$"
RULES = [
    *[
        Rule(lang, pattern, kind)
        for lang in ("typescript", "typescriptreact", "javascript", "javascriptreact")
        for pattern, kind in ((_TS_METHOD, "method"), (_TS_PROPERTY, "property"), (_TS_ARROW, "property"), (_TS_VARIABLE, "variable"))
    ],
    *[Rule(lang, r"^\s*(?:typedef\s+)?enum\s+(?:class\s+|struct\s+)?(\w+)", "enum") for lang in ("c", "cpp")],
    *[Rule(lang, "^" + _C_FUNCTION, "function") for lang in ("c", "cpp")],
    Rule("cpp", r"^\s+" + _C_FUNCTION, "method"),
    *[
        Rule(lang, rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?{word}\s+(\w+)", kind)
        for lang in ("typescript", "typescriptreact", "javascript", "javascriptreact")
        for word, kind in (("class", "class"), ("interface", "interface"), ("enum", "enum"), (r"(?:async\s+)?function\*?", "function"))
    ],
    *[
        Rule(lang, rf"^\s*(?:(?:public|private|protected|internal|static|abstract|sealed|partial|final)\s+)*{word}\s+(\w+)", kind)
        for lang in ("csharp", "java", "php")
        for word, kind in (("class", "class"), ("interface", "interface"), ("enum", "enum"), ("struct", "class"), ("trait", "interface"))
    ],
    *[Rule(lang, _C_METHOD, "method") for lang in ("csharp", "java")],
    Rule("php", r"^\s*(?:(?:public|private|protected|static)\s+)*function\s+(\w+)", "function"),
    Rule("python", r"^\s*class\s+(\w+)", "class"),
    Rule("python", r"^\s*(?:async\s+)?def\s+(\w+)", "function"),
    Rule("go", r"^func\s+\([^)]*\)\s+(\w+)", "method"),
    Rule("go", r"^func\s+(\w+)", "function"),
    Rule("go", r"^type\s+(\w+)", "class"),
    Rule("ruby", r"^\s*class\s+(\w+)", "class"),
    Rule("ruby", r"^\s*def\s+(?:self\.)?(\w+)", "method"),
    Rule("cpp", r"^\s*(?:class|struct)\s+(\w+)", "class"),
    Rule("c", r"^\s*struct\s+(\w+)", "class"),
    Rule("html", r"<h[1-6][^>]*>(.*?)</h[1-6]>", "class"),
    Rule("html", r"<a [^>]*href=\"([^\"]*)\"", "endpoint"),
]


def extract_symbols(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Declarations of `docs(file_path, relative_path, language, text)`.

    Rules become expressions at plan time; a line is tested by the rules of its
    language only, without its comments and strings, together with the lines that a
    parenthesis carries on. Rows carry the 0-based line and column, the indent and the
    open braces before the line. A name that two rules find counts once.
    """
    by_language: dict[str, list[Rule]] = {}
    for r in rules:
        by_language.setdefault(r.language, []).append(r)
    lines = code_lines(docs, "file_path", "relative_path")
    found = None
    for language, own in by_language.items():
        # Attributes of HTML are strings.
        text = "kept" if language == "html" else "code"
        per_rule = [
            F.expr(
                f"transform(regexp_extract_all({text}, r'{r.pattern}', 1), "
                f"n -> named_struct('name', n, 'type', '{r.type}'))"
            )
            for r in own
        ]
        names = F.filter(F.concat(*per_rule), lambda x: x["name"] != "")
        if language.startswith(("typescript", "javascript")):
            named = F.transform(names, lambda x: x["name"])
            names = F.filter(names, lambda x, i: F.array_position(named, x["name"]) == i + 1)
        test = F.col("language") == language
        found = F.when(test, names) if found is None else found.when(test, names)
    hits = lines.select("file_path", "relative_path", "language", "line", "raw", "depth", F.posexplode(found).alias("nth", "s"))
    return hits.select(
        "file_path", "relative_path", "language", "line", "nth",
        F.expr("greatest(instr(raw, s.name) - 1, 0)").alias("col"),
        F.col("s.name").alias("name"),
        F.col("s.type").alias("type"),
        F.expr("length(raw) - length(ltrim(raw))").alias("indent"),
        "depth",
    )


#: Columns of one level, in languages that nest by indentation.
INDENTS = {"python": 4, "ruby": 2}


def code_symbols(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Extracted declarations with depth, container, full name and id (`ts:path:fullName:row`)."""
    # Two steps of the scan read the declarations; the texts are lexed once.
    found = cut(extract_symbols(docs, rules), "symbols")
    width = F.coalesce(lookup(F.col("language"), INDENTS), F.lit(0))
    level = F.when(width > 0, F.floor(F.try_divide("indent", width))).otherwise(F.col("depth"))
    named = qualify_names(found.withColumn("depth", level.cast("int")))
    return named.withColumn("id", F.concat_ws(":", F.lit("ts"), "file_path", "full_name", "line"))


def brace_depth(docs: DataFrame) -> DataFrame:
    """Open braces before each logical line of `docs(file_path, text)`: `(file_path, line, depth)`.

    Braces in comments and strings do not count, by the rules of `language` where there is one.
    """
    known = docs if "language" in docs.columns else docs.withColumn("language", F.lit("typescript"))
    return code_lines(known, "file_path").select("file_path", "line", "depth")


# Ends of syntax node kinds, tested in this order; the bare word
# counts as well.
NODE_ENDINGS = [
    ("class", "class"),
    ("interface", "interface"),
    ("enum", "enum"),
    ("struct", "class"),
    ("trait", "interface"),
    ("method", "method"),
    ("function", "function"),
]


def classify_node(kind: str, language: str) -> Column:
    """Item type of a syntax node kind column; NULL when it is none."""
    tests = " ".join(
        f"WHEN endswith({kind}, '{w}_declaration') OR endswith({kind}, '{w}_definition') OR {kind} = '{w}' THEN '{t}'"
        for w, t in NODE_ENDINGS
    )
    return F.expr(
        f"""CASE {tests}
        WHEN {language} = 'go' THEN if({kind} = 'type_declaration', 'class', null)
        WHEN {language} = 'ruby' AND {kind} = 'singleton_method' THEN 'method'
        WHEN endswith({kind}, 'property_declaration') OR endswith({kind}, 'property_definition') THEN 'property'
        WHEN endswith({kind}, 'variable_declaration') OR endswith({kind}, 'variable_declarator') THEN 'variable' END"""
    )


def qualify_names(symbols: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Container and full name of `symbols(file_path, line, depth, name, type)`.

    The container is the chain of enclosing types: a row takes everything as deep as
    itself or deeper off the stack, then lies on it. Stretches of rows compose, as what the
    shallowest of them takes off and the types they leave, so the stack before each row comes
    from a scan, at any depth. Rows of one line are told apart by `nth`, where there is one.
    """
    is_type = F.col("type").isin("class", "interface", "enum")
    own = F.struct(F.col("depth").alias("depth"), F.col("name").alias("name"))
    left = F.when(is_type, F.array(own)).otherwise(F.array().cast("array<struct<depth:int,name:string>>"))
    effect = F.struct(F.col("depth").cast("int").alias("least"), left.cast("array<struct<depth:int,name:string>>").alias("stack"))

    def then(a: Column, b: Column) -> Column:
        stays = F.filter(a["stack"], lambda e: e["depth"] < b["least"])
        return F.struct(F.least(a["least"], b["least"]).alias("least"), F.concat(stays, b["stack"]).alias("stack"))

    order = ["line", "nth"] if "nth" in symbols.columns else ["line"]
    seen = scan(symbols, ["file_path"], order, effect, then, "_stack", chunk)
    around = F.filter("_stack.stack", lambda e: e["depth"] < F.col("depth"))
    container = F.nullif(F.array_join(F.transform(around, lambda e: e["name"]), "."), F.lit(""))
    return seen.withColumn("container", container).withColumn("full_name", F.concat_ws(".", "container", "name")).drop("_stack")


# ---------------------------------------------------------------- C# endpoints

ATTRIBUTE = r"(?i)\b(Http(?:Get|Post|Put|Delete|Patch|Head|Options)|Route)\w*\s*(?:\(\s*[@$]*\"([^\"]*)\")?"
CLASS_LINE = r"^\s*(?:(?:public|private|protected|internal|static|abstract|sealed|partial)\s+)*(?:class|record)\s+(\w+)"


def controller_endpoints(docs: DataFrame) -> DataFrame:
    """Endpoint items of controller sources `docs(file_path, text)`.

    Attribute lines belong to the next declaration below them, also where an attribute
    takes several lines; comments are none. The last verb and the last route of a method
    win; the class route is the prefix.
    """
    lines = code_lines(docs.select("file_path", "text", F.lit("csharp").alias("language")), "file_path")
    is_attr = F.col("code").rlike(r"^\s*\[")
    declared = F.regexp_replace("code", r"^(\s*\[[^\]]*\])+", "")
    marked = lines.filter("trim(kept) <> ''").select(
        "file_path", "line",
        F.regexp_extract("code", CLASS_LINE, 1).alias("class_name"),
        F.when(~is_attr | F.col("code").rlike(r"\]\s*\w"), F.regexp_extract(declared, _C_METHOD, 1)).otherwise(F.lit("")).alias("method_name"),
        F.when(is_attr, F.expr(f"regexp_extract_all(kept, r'{ATTRIBUTE}', 1)")).alias("kinds"),
        F.when(is_attr, F.expr(f"regexp_extract_all(kept, r'{ATTRIBUTE}', 2)")).alias("routes"),
    )
    ends = F.col("kinds").isNull() | (F.col("method_name") != "") | (F.col("class_name") != "")
    # Read twice by each running value; the texts are lexed once.
    marked = cut(marked.withColumn("_end", ends.cast("bigint")), "marked")
    chunk = number_chunk(F.col("line"))
    blocks = running(marked, ["file_path"], ["line"], chunk, {"_b": ("sum", F.col("_end"))}).withColumn(
        "_b", F.col("_b") - F.col("_end")
    )
    decl = (F.col("class_name") != "") | (F.col("method_name") != "")
    per_block = blocks.withColumn("_verb", F.expr("try_element_at(filter(kinds, k -> lower(k) <> 'route'), -1)")).withColumn(
        "_route", F.expr("try_element_at(filter(routes, r -> r <> ''), -1)")
    ).groupBy("file_path", "_b").agg(
        F.max_by(F.upper(F.substr("_verb", F.lit(5))), F.when(F.col("_verb").isNotNull(), F.col("line"))).alias("verb"),
        F.max_by("_route", F.when(F.col("_route").isNotNull(), F.col("line"))).alias("route"),
        F.max_by(F.struct("line", "class_name", "method_name"), F.when(decl, F.col("line"))).alias("d"),
        F.min("line").alias("first_line"),
    )
    owned = per_block.filter("d is not null").select(
        "file_path", F.col("d.line").alias("line"), "first_line", "verb", "route",
        F.col("d.class_name").alias("class_name"), F.col("d.method_name").alias("method_name"),
    )
    klass = F.when(F.col("class_name") != "", F.struct("class_name", "route"))
    placed = running(owned, ["file_path"], ["line"], chunk, {"k": ("last", klass)})
    hit = placed.filter("class_name = '' and method_name <> '' and (verb is not null or route is not null)")
    container = F.col("k.class_name")
    prefix = resolve_controller_token(F.col("k.route"), container)
    full = F.when(F.col("k.route").isNotNull(), combine_routes(prefix, F.coalesce("route", F.lit("")))).otherwise(
        F.coalesce("route", F.lit(""))
    )
    rows = hit.select(
        "file_path", F.col("first_line").alias("line"), "method_name",
        F.coalesce("verb", F.lit("GET")).alias("verb"), full.alias("path"), container.alias("container"),
    )
    return rows.select(
        F.concat_ws(":", F.lit("endpoint"), "file_path", F.concat_ws(".", "container", "method_name"), "line").alias("id"),
        F.concat(F.lit("["), "verb", F.lit("] "), F.when(F.col("path") != "", F.col("path")).otherwise(F.col("method_name"))).alias("name"),
        F.lit("endpoint").alias("type"),
        "file_path", "line", "container",
        F.concat_ws(".", "container", "method_name").alias("full_name"),
        F.when(F.col("path") != "", F.concat(F.lit("ASP.NET Endpoint: "), "verb", F.lit(" "), "path"))
        .otherwise(F.concat(F.lit("ASP.NET Controller Action: "), "method_name")).alias("detail"),
    )


MAP_CALL = r"\.Map(Get|Post|Put|Delete|Patch)\s*\("
MAP_ROUTE = r"^\s*([@$]*\"[^\"]*\"|[^,)\s\"]+)"


def minimal_api_endpoints(docs: DataFrame) -> DataFrame:
    """Endpoint items of `app.MapGet("/route", ...)` calls, on one line or several; not those in comments or strings.

    Calls are found in the code, their routes read at the same places of the text with strings.
    """
    # Texts without a call need no lexing.
    lines = code_lines(docs.filter("contains(text, '.Map')").select("file_path", "text", F.lit("csharp").alias("language")), "file_path")
    with_calls = lines.filter("contains(code, '.Map')").select(
        "file_path", "line", "kept",
        F.expr(f"regexp_extract_all(code, r'{MAP_CALL}', 1)").alias("verbs"),
        F.expr(f"transform(regexp_extract_all(code, r'{MAP_CALL}', 0), h -> length(h))").alias("heads"),
        F.expr(f"transform(split(code, r'{MAP_CALL}'), p -> length(p))").alias("gaps"),
    )
    place = "aggregate(slice(gaps, 1, i + 1), 1, (a, x) -> a + x) + aggregate(slice(heads, 1, i + 1), 0, (a, x) -> a + x)"
    calls = with_calls.select("file_path", "line", F.expr(
        f"inline(transform(verbs, (v, i) -> named_struct('verb', v, 'arg', regexp_extract(substr(kept, {place}), r'{MAP_ROUTE}', 1))))"
    ))
    rows = calls.select(
        "file_path", "line", F.upper("verb").alias("verb"),
        F.regexp_replace("arg", r"^[\"@$]+|\"+$", "").alias("route"),
    ).filter("route <> ''")
    return rows.select(
        F.concat_ws(":", F.lit("endpoint"), "file_path", "route", "line").alias("id"),
        F.concat(F.lit("["), "verb", F.lit("] "), "route").alias("name"),
        F.lit("endpoint").alias("type"),
        "file_path", "line",
        F.col("route").alias("full_name"),
        F.concat(F.lit("ASP.NET Minimal API: "), "verb", F.lit(" "), "route").alias("detail"),
    )


# ----------------------------------------------------------- kind-coded symbols


def flat_symbols(rows: DataFrame) -> DataFrame:
    """Symbols `(name, kind, uri, line, col, container)` -> items; other kinds drop."""
    path = uri_to_path(F.col("uri"))
    container = F.when(F.col("container") != "", F.col("container"))
    return rows.withColumn("type", lookup(F.col("kind"), SYMBOL_KIND_TYPES)).filter("type is not null").select(
        F.concat_ws(":", F.lit("symbol"), path, "name", "line").alias("id"),
        "name", "type", path.alias("file_path"), "line", "col", "container",
        F.concat_ws(".", container, "name").alias("full_name"),
    )


def flatten_symbol_tree(nodes: DataFrame) -> DataFrame:
    """Nested symbols `(id, parent_id, name, kind)` -> rows with dotted names.

    One join per level, until a level is empty. A node of an unmapped kind is
    left out but its name stays in the names of its children. Ids that repeat can
    form a cycle; more levels than nodes prove one.
    """
    count = nodes.count()
    typed = nodes.withColumn("type", lookup(F.col("kind"), SYMBOL_KIND_TYPES))
    level = typed.filter("parent_id is null").select(
        "id", "name", "type", F.lit(None).cast("string").alias("container"), F.col("name").alias("full_name"),
        F.lit(0).alias("depth"),
    )
    levels = []
    while True:
        level = cut(level, "tree")
        if level.isEmpty():
            break
        if len(levels) >= count:
            raise ValueError("symbols form a cycle")
        levels.append(level)
        parents = level.select(F.col("id").alias("_pid"), F.col("full_name").alias("_pname"), "depth")
        level = typed.join(parents, F.col("parent_id") == F.col("_pid")).select(
            "id", "name", "type", F.col("_pname").alias("container"),
            F.concat_ws(".", "_pname", "name").alias("full_name"), (F.col("depth") + 1).alias("depth"),
        )
    return union_all(levels or [level]).filter("type is not null")


def symbol_coverage(files: DataFrame, symbols: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Symbols, files with symbols, all files, their ratio, and whether it is enough."""
    total = files.agg(F.count("*")).scalar()
    s = symbols.groupBy("file_path").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"), F.count("*").alias("files_with_symbols")
    )
    ratio = F.when(total > 0, F.col("files_with_symbols") / total).otherwise(F.lit(0.0))
    return s.select("*", total.alias("files"), ratio.alias("ratio"), (ratio >= threshold).alias("covered"))


# -------------------------------------------------------------------- settings


def flatten_settings(settings: DataFrame) -> DataFrame:
    """JSON settings `(owner, ord, json)` -> dotted keys; later settings override.

    Arrays stay whole. One pass per level, until no object is left; each level is written
    and read by the next, so no level is parsed again.
    """
    spark = settings.sparkSession
    level = settings.select("owner", "ord", F.lit(None).cast("string").alias("prefix"), F.try_parse_json("json").alias("v"))
    level = level.filter("schema_of_variant(v) like 'OBJECT%'")
    nested = F.coalesce(F.expr("schema_of_variant(v) like 'OBJECT%'"), F.lit(False))
    leaves = []
    while True:
        pairs = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(
            "owner", "ord", F.concat_ws(".", "prefix", "key").alias("prefix"), F.col("value").alias("v")
        )
        pairs = cut(pairs.select("*", nested.alias("nested")), "settings")
        leaves.append(pairs.filter(~F.col("nested")))
        level = pairs.filter("nested").drop("nested")
        if level.isEmpty():
            break
    flat = union_all(leaves).select("owner", "ord", F.col("prefix").alias("key"), F.expr("cast(v as string)").alias("value"))
    return flat.groupBy("owner", "key").agg(F.max_by("value", "ord").alias("value"))
