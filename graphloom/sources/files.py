"""Source files: fingerprints, cheap states, lines and slices; small JSON state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that are no source.
SKIPPED = (".git", ".hg", ".svn", "node_modules", "target", "dist", "build", ".venv", "venv", "__pycache__", ".idea", ".vscode")
SLICE_LINES = 2000


def _files(spark: SparkSession, root: str, folder: str | None = None, name: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", "".join(c if c.isalnum() else f"[{c}]" if c not in "^]\\" else "\\" + c for c in name)) if name else reader).load(folder or root)
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + "".join(c if c.isalnum() else "\\" + c for c in base), "")
    rows = found.withColumn("rel", path)
    return rows.where(~F.arrays_overlap(F.split("rel", "/"), F.array(*map(F.lit, SKIPPED))))


def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """(path, hash, size) of all files but those in version control and build folders."""
    return _files(spark, root).select(F.col("rel").alias("path"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size"))


def quick_state(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime), without reading contents."""
    return _files(spark, root).select(F.col("rel").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def source_lines(spark: SparkSession, root: str, folder: str | None = None, name: str | None = None) -> DataFrame:
    """(file_path, line, text) of the files that are text: no zero byte, valid UTF-8."""
    rows = _files(spark, root, folder, name).withColumn("text", F.col("content").cast("string"))
    rows = rows.where((F.instr(F.hex("content"), "00") == 0) | (F.locate("\0", F.col("text")) == 0)).where(F.is_valid_utf8("text"))
    parts = F.split(F.regexp_replace("text", r"\r?\n$", ""), r"\r?\n", -1)
    return rows.select(F.col("rel").alias("file_path"), F.posexplode(parts).alias("line", "text")).withColumn("line", F.col("line") + 1)


def _inside(path: str) -> None:
    if path.startswith(("/", "\\")) or ".." in path.replace("\\", "/").split("/"):
        raise ValueError("a path inside the repository is asked for")


def read_slice(spark: SparkSession, root: str, path: str, start: int, end: int) -> DataFrame:
    """:func:`source_slice` of one file, which alone is read."""
    _inside(path)
    folder, _, name = path.replace("\\", "/").rpartition("/")
    return source_slice(source_lines(spark, root, f"{root.rstrip('/')}/{folder}", name), path, start, end)


def source_slice(lines: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """Lines ``start`` to ``end`` (from 1, both included) of a file inside the root, at most SLICE_LINES."""
    _inside(path)
    low = max(1, start)
    high = min(max(low, end), low + SLICE_LINES - 1)
    return lines.where((F.col("file_path") == path) & F.col("line").between(low, high)).orderBy("line")


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small JSON table; an empty one where there is none."""
    for place in (path, path + ".old"):
        where = spark._jvm.org.apache.hadoop.fs.Path(place)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return spark.read.schema(schema).json(place)
    return spark.createDataFrame([], schema)


def write_state(table: DataFrame, path: str) -> None:
    """Writes beside the old table, then puts the new one in its place; the old one is there until then, and
    :func:`read_state` finds it if the change breaks off."""
    spark = table.sparkSession
    table.write.mode("overwrite").json(path + ".new")
    p = spark._jvm.org.apache.hadoop.fs.Path
    system = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(p(path + ".old"), True)
    if system.exists(p(path)) and not system.rename(p(path), p(path + ".old")) or not system.rename(p(path + ".new"), p(path)):
        raise OSError(f"could not put {path} in place")
    system.delete(p(path + ".old"), True)


def diff_lines(spark: SparkSession, diff: str) -> DataFrame:
    """(line, text) of a diff text."""
    schema = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("text", T.StringType())])
    return spark.createDataFrame(list(enumerate(diff.splitlines(), 1)), schema)


def git_diff(repository: str, scope: str = "unstaged", base: str | None = None, seconds: int = 60) -> str:
    """A working tree's diff without context, for ``unstaged``, ``staged`` or ``cached``, ``all``, or ``compare`` with a base."""
    import subprocess

    extra = {"unstaged": [], "staged": ["--cached"], "cached": ["--cached"], "all": ["HEAD"], "compare": [base or "HEAD"]}[scope]
    if base and base.startswith("-"):
        raise ValueError("a revision is asked for")
    return subprocess.run(["git", "-C", repository, "diff", "--unified=0", "--no-color", *extra], capture_output=True, text=True, check=True, timeout=seconds).stdout
