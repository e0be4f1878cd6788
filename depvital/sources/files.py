"""File corpora as tables: one row per file, routed by format."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: source files that are read -------------------------------------
LANGUAGES = {"go": "go", "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
             "ts": "typescript", "tsx": "typescript", "java": "java"}
SKIPPED_FOLDERS = ("vendor", "node_modules", ".git", "testdata", "__pycache__", "build", "dist", "target")


def read_texts(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """Whole text files: path, text.

    Spark passes over names that start with a dot or underscore while it lists folders; name such folders
    in the path, as ``read_workflows`` does.
    """
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def read_workflows(spark: SparkSession, root: str) -> DataFrame:
    """Workflow and composite-action files of the repositories below a folder: scope (first folder), path inside it, text.

    Action files may lie in any folder of a repository; ``.github`` is named because listings pass over it.
    """
    base = root.rstrip("/")
    folders = [f"{base}/*/.github/workflows", f"{base}/*/.github/actions", base]
    found = reduce(DataFrame.unionByName, [texts for texts in (_texts_below(spark, folder) for folder in folders) if texts])
    relative = F.regexp_replace(F.split_part(F.col("path"), F.lit(base + "/"), F.lit(-1)), r"^[a-z]+:/+", "")
    inside = F.regexp_extract(relative, r"^[^/]+/(.*)$", 1)
    wanted = F.col("path").rlike(r"^\.github/workflows/[^/]+$") | F.col("path").rlike(r"(?:^|/)action\.ya?ml$")
    return found.select(F.split_part(relative, F.lit("/"), F.lit(1)).alias("scope"), inside.alias("path"), "text").where(wanted)


def _texts_below(spark: SparkSession, folder: str) -> DataFrame | None:
    """YAML files below the folders of a pattern; None where the pattern matches nothing."""
    try:
        return read_texts(spark, folder, "*.{yml,yaml}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def source_language(path: Column) -> Column:
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, extension)


def is_skipped(path: Column) -> Column:
    """Below a folder of third-party, generated or test data."""
    names = "|".join(name.replace(".", r"\.") for name in SKIPPED_FOLDERS)
    return path.rlike(rf"(?:^|/)(?:{names})/")


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """Source files of many projects: project_id (first folder below the root), path, lang, text.

    Name and folder are checked on the file listing, so skipped files are never opened.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{go,py,js,jsx,mjs,ts,tsx,java}")
        .load(root)
    )
    base = root.rstrip("/") + "/"
    relative = F.regexp_replace(F.split_part(F.col("path"), F.lit(base), F.lit(-1)), r"^[a-z]+:/+", "")
    listed = files.withColumn("_relative", relative)
    return listed.where(~is_skipped(F.col("_relative"))).select(
        F.split_part("_relative", F.lit("/"), F.lit(1)).alias("project_id"),
        F.col("_relative").alias("path"),
        source_language(F.col("_relative")).alias("lang"),
        F.decode("content", "UTF-8").alias("text"),
    )


def select_sources(files: DataFrame) -> DataFrame:
    """The same choice over a table of files (project_id, path, text)."""
    return (
        files.where(~is_skipped(F.col("path")))
        .withColumn("lang", source_language(F.col("path")))
        .where("lang IS NOT NULL")
    )


def file_format(path: Column, text: Column) -> Column:
    """gomod, sbom, workflow or list, from the name and the whole text."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    statements = F.btrim(F.regexp_replace(text, r"(?m)^[ \t]*/[^\n]*$", ""), F.lit(" \t\r\n"))
    gomod = (name == "go.mod") | statements.rlike(r"^module(?:\s|$)")
    sbom = path.endswith(".json") & text.rlike(r'"bomFormat"\s*:\s*"(?i:CycloneDX)"')
    yaml = F.lower(path).rlike(r"\.ya?ml$")
    in_folder = path.contains("/.github/workflows/") | path.startswith(".github/workflows/")
    marked = text.rlike(r'(?m)^"?on"?:') & text.rlike(r"(?m)^jobs:")
    return F.when(gomod, "gomod").when(sbom, "sbom").when(yaml & (in_folder | marked), "workflow").otherwise("list")


def route_files(files: DataFrame) -> DataFrame:
    """Files with the format each is to be read as."""
    return files.withColumn("format", file_format(F.col("path"), F.col("text")))
