"""File listings and the filters applied before indexing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions.text import any_glob_regex, basename, normalize_path, slashes
from waymark.session import union_all

# Paths left out unless configured otherwise.
DEFAULT_EXCLUDES = [
    "**/node_modules/**",
    "**/dist/**",
    "**/out/**",
    "**/.git/**",
    "**/build/**",
    "**/bin/**",
    "**/obj/**",
    "**/vendor/**",
]

# Folders and file name endings of generated C# sources.
GENERATED_FOLDERS = ["obj", "generated"]
GENERATED_ENDINGS = [".g.cs", ".g.i.cs", ".designer.cs", ".generated.cs", ".assemblyattributes.cs"]
GENERATED_MARKER = "<auto-generated"
MARKER_WINDOW = 1024


def file_items(files: DataFrame) -> DataFrame:
    """One FILE item per listed path; the relative path is full name and detail."""
    return files.select(
        F.concat(F.lit("file:"), F.col("file_path")).alias("id"),
        basename(F.col("file_path")).alias("name"),
        F.lit("file").alias("type"),
        "file_path",
        "relative_path",
        F.col("relative_path").alias("full_name"),
        F.col("relative_path").alias("detail"),
    )


def rooted(root: Column, path: Column) -> Column:
    """Absolute paths stay; others are joined to the root."""
    base = F.regexp_replace(root, r"[/\\]$", "")
    return F.when(path.rlike(r"^([/\\]|[A-Za-z]:[/\\])"), path).otherwise(F.concat(base, F.lit("/"), path))


def read_manifest(manifests: DataFrame) -> DataFrame:
    """NUL-separated listings `(root, text)` -> one row per path."""
    parts = manifests.select("root", F.explode(F.split("text", "\\x00")).alias("path"))
    return parts.filter("path <> ''").select("root", rooted(F.col("root"), F.col("path")).alias("file_path"))


def parse_exclude_list(text: str | None) -> list[str]:
    """`{a,b,c}` -> patterns; anything else gives none."""
    if not text or not (text.startswith("{") and text.endswith("}")):
        return []
    return [p for p in (part.strip() for part in text[1:-1].split(",")) if p]


def exclude_globs(files: DataFrame, patterns=DEFAULT_EXCLUDES, path: str = "relative_path") -> DataFrame:
    """Drop paths that any glob matches; dot files are matched like others."""
    if not patterns:
        return files
    return files.filter(~slashes(F.col(path)).rlike(any_glob_regex(patterns)))


def is_generated_path(path: Column) -> Column:
    """Generated C# sources by folder or ending, in any case."""
    folders = "|".join(GENERATED_FOLDERS)
    endings = "|".join(e.replace(".", r"\.") for e in GENERATED_ENDINGS)
    return F.lower(path).rlike(rf"[/\\]({folders})[/\\]|({endings})$")


def drop_generated_paths(files: DataFrame, path: str = "file_path") -> DataFrame:
    source = F.endswith(F.col(path), F.lit(".cs"))
    return files.filter(~(source & is_generated_path(F.col(path))))


def drop_generated_content(
    files: DataFrame, marker: str = GENERATED_MARKER, text: str = "text", window: int = MARKER_WINDOW
) -> DataFrame:
    """Drop files whose first `window` bytes hold the marker."""
    head = F.substr(F.encode(F.col(text), "utf-8"), F.lit(1), F.lit(window))
    return files.filter(~F.contains(head, F.encode(F.lit(marker), "utf-8")))


def ignored_paths(verdicts: DataFrame) -> DataFrame:
    """Paths ruled out by verdict records `(root, text)`: NUL-separated runs of
    source, line, pattern, path; an empty source means not ignored."""
    fields = F.split("text", "\\x00")
    records = verdicts.select("root", fields.alias("f")).select(
        "root",
        F.explode(
            F.expr(
                """transform(sequence(0, greatest(cast(ceil(size(f) / 4) as int) - 1, 0)), i ->
                   named_struct('source', coalesce(try_element_at(f, 4 * i + 1), ''), 'path', try_element_at(f, 4 * i + 4)))"""
            )
        ).alias("r"),
    )
    hits = records.filter("r.source <> '' and r.path is not null")
    return hits.select(rooted(F.col("root"), F.col("r.path")).alias("file_path")).distinct()


def drop_ignored(files: DataFrame, verdicts: DataFrame) -> DataFrame:
    return files.join(ignored_paths(verdicts), "file_path", "left_anti")


def modified_set(*listings: DataFrame) -> DataFrame:
    """Distinct union of listings `(root, path)`, rooted and normalized."""
    return union_all(
        d.select(normalize_path(rooted(F.col("root"), F.col("path"))).alias("file_path")) for d in listings
    ).distinct()


MATCH_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("path", T.StructType([T.StructField("text", T.StringType())])),
        T.StructField("lines", T.StructType([T.StructField("text", T.StringType())])),
        T.StructField("line_number", T.IntegerType()),
        T.StructField("submatches", T.ArrayType(T.StructType([
            T.StructField("match", T.StructType([T.StructField("text", T.StringType())])),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]))),
    ])),
])


def read_match_log(lines: DataFrame) -> DataFrame:
    """JSON match lines `(value)` -> path, 0-based line, column, trimmed text.

    Byte offsets of submatches are shifted by the leading blank bytes; lines
    that are no JSON or no match are dropped.
    """
    msg = lines.select(F.from_json("value", MATCH_SCHEMA).alias("m")).filter("m.type = 'match'")
    d = msg.select("m.data.*").withColumn(
        "lead", F.octet_length(F.regexp_extract("lines.text", r"^(\s*)", 1))
    )
    return d.select(
        F.col("path.text").alias("path"),
        (F.col("line_number") - 1).alias("line"),
        F.coalesce(F.expr("try_element_at(submatches, 1).start"), F.lit(0)).alias("column"),
        F.regexp_replace("lines.text", r"^\s+|\s+$", "").alias("text"),
        F.coalesce(F.expr("try_element_at(submatches, 1).match.text"), F.lit("")).alias("match"),
        F.expr(
            """transform(submatches, s -> named_struct(
                 'start', greatest(0, s.start - lead), 'end', greatest(0, s.end - lead)))"""
        ).alias("submatches"),
    )


def snapshot_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Paths added, changed or removed between two listings `(file_path, text)`.

    Only paths and content hashes are shuffled.
    """
    p = previous.select("file_path", F.md5("text").alias("old"))
    c = current.select("file_path", F.md5("text").alias("new"))
    change = (
        F.when(F.col("old").isNull(), F.lit("added"))
        .when(F.col("new").isNull(), F.lit("removed"))
        .when(F.col("old") != F.col("new"), F.lit("changed"))
    )
    return p.join(c, "file_path", "full_outer").select("file_path", change.alias("change")).filter("change is not null")


def dump_index(items: DataFrame, path: str) -> None:
    """Write all items and the distinct file paths below `path`."""
    items.write.mode("overwrite").parquet(f"{path}/items")
    items.filter("type = 'file'").select("file_path").distinct().write.mode("overwrite").parquet(f"{path}/paths")
