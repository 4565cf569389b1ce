"""Sources: whole files, size routing, byte slices, walks with ignore patterns, key files, logs, scanner reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never of interest.
IGNORED = (".git/", ".veil/", "node_modules/", "dist/", "build/", "bin/", "target/", "__pycache__/", ".venv/", "vendor/", "Pods/", "obj/", "packages/", ".terraform/")
SNIFF_BYTES = 8192


def is_binary(content: Column) -> Column:
    """A zero byte among the first bytes."""
    return F.contains(F.substring(content, 1, SNIFF_BYTES), F.unhex(F.lit("00")))


def read_files(spark: SparkSession, path: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """path, bytes, content of the regular files below path that no pattern ignores."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return prune(files.select("path", F.col("length").alias("bytes"), "content"), "path", (*IGNORED, *ignore))


def ignore_pattern(glob: str) -> tuple[str, bool]:
    """A gitignore line as a pattern over a relative path, and whether it takes back."""
    back, glob = glob.startswith("!"), glob.removeprefix("!")
    folder, glob = glob.endswith("/"), glob.rstrip("/")
    rooted = "/" in glob
    body = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*/|\*\*|.", glob.lstrip("/")))
    return ("^" if rooted else "(?:^|/)") + body + ("/" if folder else "(?:/|$)"), back


def prune(files: DataFrame, col: str, patterns: tuple[str, ...]) -> DataFrame:
    """Without the files that the last pattern to match ignores; blank lines and comments don't count."""
    ignored = F.lit(False)
    for glob in patterns:
        if glob.strip() and not glob.startswith("#"):
            pattern, back = ignore_pattern(glob.strip())
            ignored = F.when(F.col(col).rlike(pattern), F.lit(not back)).otherwise(ignored)
    return files.filter(~ignored)


def route_by_size(docs: DataFrame, most: int, text_col: str = "text") -> DataFrame:
    """Adds kind: content, or summary for texts over `most` bytes."""
    return docs.withColumn("kind", F.when(F.octet_length(text_col) > most, "summary").otherwise("content"))


def slice_text(docs: DataFrame, start: int, end: int, most: int, text_col: str = "text") -> DataFrame:
    """Adds slice: the bytes [start, end) as text; cut characters become U+FFFD. A slice past the end is shorter."""
    if not 0 <= start < end or end - start > most:
        raise ValueError("a slice is 0 <= start < end, of at most the size limit")
    part = F.substring(F.encode(F.col(text_col), "UTF-8"), start + 1, end - start)
    return docs.withColumn("slice", F.make_valid_utf8(part.cast("string")))


def env_keys(files: DataFrame, text_col: str = "text") -> DataFrame:
    """key: distinct names that are assigned in dotenv files."""
    rows = files.select(F.explode(F.split(text_col, "\r?\n")).alias("l")).select(F.trim("l").alias("line")).filter("line <> '' and not startswith(line, '#')")
    return rows.select(F.regexp_extract("line", r"^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=", 1).alias("key")).filter("key <> ''").distinct()


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Malformed lines are skipped."""
    from spanveil.operators.audit import SCHEMA

    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)


def parse_requests(requests: DataFrame, col: str = "payload") -> DataFrame:
    """Adds tool and command from a JSON payload, and decision `deny` where it is malformed."""
    got = requests.withColumn("_j", F.try_parse_json(col))
    tool, command = F.try_variant_get("_j", "$.tool_name", "string"), F.try_variant_get("_j", "$.tool_input.command", "string")
    return got.withColumn("tool", tool).withColumn("command", command).withColumn("decision", F.when(F.col("_j").isNull(), "deny").otherwise("allow")).drop("_j")


def locate_findings(reports: DataFrame, texts: DataFrame) -> DataFrame:
    """reports: runner, file, value, class of an outside scanner; texts: file, text. Offsets of the first occurrence; findings that don't occur are left out."""
    at = F.instr(F.col("text"), F.col("value"))
    return reports.join(texts, "file").filter(at > 0).select("runner", "file", (at - 1).alias("start"), (at - 1 + F.length("value")).alias("end"), "class")
