"""Notes from a folder of Markdown files."""

from __future__ import annotations

import json
import posixpath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..shipping import ship_package


def normal_dirs(dirs: list[str], root: str = "") -> list[str]:
    """Directories relative to the vault, `.` and `..` resolved by name (links are not followed); absolute ones must
    lie in it. Those outside are dropped; an empty string stands for the vault itself."""
    base = posixpath.normpath("/" + root.split("://")[-1].strip("/")) if root else "/vault"
    out = []
    for d in filter(None, dirs):
        d = d.split("://")[-1]
        full = posixpath.normpath(posixpath.expanduser(d) if d.startswith(("/", "~")) else posixpath.join(base, d))
        if full == base:
            out.append("")
        elif full.startswith(base.rstrip("/") + "/"):
            out.append(full[len(base.rstrip("/")) + 1 :])
    return out


def excluded(path: Column, globs: list[str] = (), dirs: list[str] = (), root: str = "") -> Column:
    """A path (under root) in one of dirs, or one that a glob matches or begins (`**/` and `/**` taken off)."""
    no = F.lit(False)
    for d in normal_dirs(list(dirs), root):
        no = no | path.startswith(f"{d}/") | (path == d) if d else F.lit(True)
    for g in globs:
        plain = g.replace("**/", "").replace("/**", "")
        regex = "".join(".*" if c == "**" else "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in r"\.^$+{}()|[]" else c for c in _parts(g))
        no = no | path.rlike(rf"(^|/){regex}$") | path.startswith(plain)
    return no


def _parts(glob: str):
    i = 0
    while i < len(glob):
        if glob[i : i + 2] == "**":
            yield "*"
            i += 2
        else:
            yield glob[i]
            i += 1


def scan(spark: SparkSession, root: str, globs: list[str] = (), dirs: list[str] = (), only: str | None = None) -> DataFrame:
    """path (under root), content, mtime of every Markdown file that is not excluded, or of one file only."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(base if only is None else f"{base}/{only}")
    rel = F.element_at(F.split(F.col("path"), base.split("://")[-1] + "/", 2), -1)
    return files.select(rel.alias("path"), F.col("content"), F.col("modificationTime").cast("double").alias("mtime")).filter(~excluded(F.col("path"), globs, dirs, base)).dropDuplicates(["path"])


def copy_subset(spark: SparkSession, root: str, folder: str, target: str) -> DataFrame:
    """The notes under a folder of the vault, written as a table (path, content, mtime) under target and read back; it
    can be parsed like the files themselves."""
    scan(spark, root).filter(F.col("path").startswith(folder.strip("/") + "/")).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


@F.pandas_udf(StructType([StructField("json", StringType()), StructField("error", StringType())]))
def yaml_to_json(headers: pd.Series) -> pd.DataFrame:
    """The header as JSON; what is not a mapping is {}, what is not YAML an error."""
    import yaml

    def one(h):
        try:
            found = yaml.safe_load(h or "")
        except yaml.YAMLError as e:
            return None, str(e)[:300]
        return json.dumps(found if isinstance(found, dict) else {}, default=str, ensure_ascii=False), None

    return pd.DataFrame([one(h) for h in headers], columns=["json", "error"])


def parse_files(files: DataFrame) -> DataFrame:
    """files(path, content, mtime) with what was read of each, and error, null where a note could be read."""
    ship_package(files.sparkSession)
    raw = files.withColumn("raw", F.try_validate_utf8(F.col("content").cast("string")))
    head = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(\r?\n|$)"
    split = raw.withColumns({"header": F.regexp_extract("raw", head, 1), "body": T.squeeze_ends(F.regexp_replace("raw", head, ""))}).withColumn("yaml", yaml_to_json("header"))
    error = F.when(F.col("raw").isNull(), "not UTF-8").otherwise(F.col("yaml.error"))
    return split.select("path", "mtime", "raw", "body", F.col("yaml.json").alias("frontmatter"), error.alias("error"))


def read_notes(files: DataFrame) -> DataFrame:
    """path, title, aliases, tags, frontmatter (JSON), body, content_hash, mtime of the files that can be read."""
    return notes_of(parse_files(files))


def notes_of(parsed: DataFrame) -> DataFrame:
    split = parsed.filter("error is null")

    def strings(field):
        value = F.get_json_object("frontmatter", f"$.{field}")
        many = F.from_json(value, "array<string>")
        return F.when(value.isNull(), F.array().cast("array<string>")).when(value.startswith("["), F.coalesce(many, F.array().cast("array<string>"))).otherwise(F.array(value))

    title = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    return split.select("path", title.alias("title"), strings("aliases").alias("aliases"), F.array_sort(F.array_union(strings("tags"), T.inline_tags(F.col("body")))).alias("tags"), "frontmatter", "body", F.sha1("raw").alias("content_hash"), "mtime")
