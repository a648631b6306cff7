"""Source files, feedback records and row sinks."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as tx


def normal_extensions(extensions: list[str]) -> list[str]:
    """Lower case, with a leading dot, without empty ones."""
    clean = [e.strip().lower() for e in extensions]
    return [e if e.startswith(".") else f".{e}" for e in clean if e]


def normal_fragments(fragments: list[str]) -> list[str]:
    return [f for f in (x.replace("\\", "/").strip() for x in fragments) if f]


def is_candidate(path: Column, extensions: list[str], ignored: list[str] = (), root: str = "") -> Column:
    """Whether a path counts as a source file: its suffix is listed, nothing below root starts with a dot, no ignored piece is in it."""
    below = F.regexp_replace(tx.slashes(path), "^(file:)?/*", "/")
    if root:
        below = F.regexp_replace(below, "^" + r"\Q" + "/" + root.replace("file:", "").strip("/") + r"\E", "")
    out = tx.extension(path).isin(*normal_extensions(extensions)) & ~below.rlike(r"(^|/)\.[^/]")
    for piece in normal_fragments(list(ignored)):
        out = out & ~F.contains(below, F.lit(piece))
    return out


def read_files(spark: SparkSession, root: str, extensions: list[str], ignored: list[str] = ()) -> DataFrame:
    """(path, file_name, content, sha256) of the source files below root; content is decoded as UTF-8 with replacements."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kept = found.where(is_candidate(F.col("path"), extensions, ignored, root))
    return kept.select("path", tx.basename(F.col("path")).alias("file_name"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("sha256"))


def contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content) of files by name, decoded as in read_files; paths as read_files gives them."""
    if not paths:
        return spark.createDataFrame([], "path string, content string")
    found = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(paths)
    return found.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def paths_below(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files below root; none is opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")


def write_feedback(records: DataFrame, path: str) -> None:
    """Appends records(at, trying_to_do, tried, stuck, sources) as JSON lines; fields that are missing are null, and a record without a time gets the present one."""
    has = lambda c, kind: F.col(c) if c in records.columns else F.lit(None).cast(kind)
    at = F.coalesce(has("at", "string"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    json_lines(records.select(at.alias("at"), *[has(c, "string").alias(c) for c in ("trying_to_do", "tried", "stuck")], has("sources", "array<string>").alias("sources"))).write.mode("append").text(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback records from JSON lines; lines that aren't such records are left out."""
    schema = "at string, trying_to_do string, tried string, stuck string, sources array<string>"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("at is not null")


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object a row, in the column value."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_rows(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    json_lines(rows).write.mode("overwrite").text(path)


def healthy(spark: SparkSession, path: str) -> str:
    """ok, empty or corrupt: whether a stored table can be read."""
    try:
        return "ok" if spark.read.parquet(path).limit(1).count() else "empty"
    except PySparkException:
        return "corrupt"


def overview(files: DataFrame) -> DataFrame:
    """(topic, value, n): languages, manifests and entry points among files(path)."""
    name = tx.basename(F.col("path"))
    manifest = F.when(name.isin("pyproject.toml", "setup.py", "requirements.txt", "package.json", "pom.xml", "build.gradle", "go.mod", "Cargo.toml", "Gemfile", "composer.json", "CMakeLists.txt", "Makefile"), name)
    entry = F.when(name.rlike(r"^(main|app|server|index|manage|__main__)\.[a-z]+$"), F.col("path"))
    each = files.select(F.explode(F.array(*[F.struct(F.lit(t).alias("topic"), v.alias("value")) for t, v in (("language", tx.language(F.col("path"))), ("manifest", manifest), ("entry_point", entry))])).alias("x")).select("x.*")
    return each.where("value is not null").groupBy("topic", "value").agg(F.count("*").alias("n"))


# Frameworks by a dependency of package.json, and by a word in Python's manifests.
NODE_FRAMEWORKS = {
    "react": "React", "next": "Next.js", "vue": "Vue", "nuxt": "Nuxt", "@angular/core": "Angular", "svelte": "Svelte",
    "express": "Express", "@nestjs/core": "NestJS", "electron": "Electron", "vite": "Vite",
}
PYTHON_FRAMEWORKS = {
    "django": "Django", "flask": "Flask", "fastapi": "FastAPI", "pyramid": "Pyramid", "tornado": "Tornado", "scrapy": "Scrapy",
    "streamlit": "Streamlit", "torch": "PyTorch", "tensorflow": "TensorFlow",
}


def frameworks(files: DataFrame, root: str) -> DataFrame:
    """(framework), distinct: what the manifests of files(path, content) right below root, and any web project file, tell. Manifests that can't be read tell nothing."""
    path = F.regexp_replace(tx.slashes(F.col("path")), "^(file:)?/*", "/")
    below = F.regexp_replace(path, "^" + r"\Q" + "/" + root.replace("file:", "").strip("/") + r"/\E", "")
    text = F.coalesce("content", F.lit(""))
    needs = F.from_json(text, "dependencies map<string,string>, devDependencies map<string,string>")
    keys = F.concat(*[F.coalesce(F.map_keys(needs[c]), F.array().cast("array<string>")) for c in ("dependencies", "devDependencies")])
    node = [F.when((below == "package.json") & F.array_contains(keys, k), F.lit(v)) for k, v in NODE_FRAMEWORKS.items()]
    python = [F.when(below.isin("pyproject.toml", "requirements.txt", "setup.py", "setup.cfg", "Pipfile") & F.contains(F.lower(text), F.lit(k)), F.lit(v)) for k, v in PYTHON_FRAMEWORKS.items()]
    other = [F.when(below == "manage.py", "Django"), F.when(below.endswith(".csproj") & F.contains(text, F.lit("Microsoft.NET.Sdk.Web")), "ASP.NET Core")]
    return files.select(F.explode(F.array(*node, *python, *other)).alias("framework")).where("framework is not null").distinct()
