"""Files, symbols, occurrences and relations lowered to nodes and edges; index protobufs; symbol trees; resolutions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import ship, written

NODE = "id string, label string, properties string"
EDGE = "id string, sourceId string, targetId string, type string, confidence double, reason string"
#: Occurrence roles by bit, the first that is set counts.
ROLE_BITS = ((1, "Definition"), (64, "ForwardDefinition"), (2, "Import"), (4, "WriteAccess"), (8, "ReadAccess"))
#: Labels of editor symbol kinds.
SYMBOL_KINDS = {1: "File", 2: "Module", 3: "Namespace", 4: "Package", 5: "Class", 6: "Method", 7: "Property", 8: "Field", 9: "Constructor", 10: "Enum", 11: "Interface", 12: "Function", 13: "Variable", 14: "Constant", 15: "String", 16: "Number", 17: "Boolean", 18: "Array", 19: "Object", 20: "Key", 21: "Null", 22: "EnumMember", 23: "Struct", 24: "Event", 25: "Operator", 26: "TypeParameter"}


def role(bits):
    """The role of an occurrence's bit set, as a column."""
    out = F.lit("Reference")
    for bit, name in reversed(ROLE_BITS):
        out = F.when(bits.bitwiseAND(F.lit(bit)) != 0, name).otherwise(out)
    return out


def decoded_range(r):
    """(start line, start column, end line, end column) of three or four numbers; others, and negative ones, are null."""
    at = lambda i: F.get(r, F.lit(i))
    fields = lambda a, b, c, d: F.struct(a.alias("start_line"), b.alias("start_column"), c.alias("end_line"), d.alias("end_column"))
    good = ~F.exists(r, lambda x: x < 0)
    return F.when(good & (F.size(r) == 3), fields(at(0), at(1), at(0), at(2))).when(good & (F.size(r) == 4), fields(at(0), at(1), at(2), at(3)))


def symbol_label(kind):
    table = F.create_map(*[F.lit(x) for pair in SYMBOL_KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind.cast("int")), F.lit("Symbol"))


def lowered(files: DataFrame, symbols: DataFrame, occurrences: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a node per file and symbol, whose range falls back to its first definition; an edge per relation.

    files (path, language, digest), symbols (symbol, display_name, kind, file_path, start_line, end_line), occurrences
    (symbol, role, file_path, start_line, end_line, ordinal), relations (source, target, kind). Of first definitions with
    one ordinal the least by path and lines counts, the same on every run.
    """
    own = files.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("File").alias("label"), F.to_json(F.struct(F.col("path").alias("name"), "path", F.col("path").alias("filePath"), "language", "digest")).alias("properties"))
    first = occurrences.where("role IN ('Definition', 'ForwardDefinition', 'Declaration')").groupBy("symbol").agg(F.min(F.struct("ordinal", "file_path", "start_line", "end_line")).alias("at"))
    named = symbols.join(first, "symbol", "left")
    props = F.to_json(F.struct(F.coalesce("display_name", "symbol").alias("name"), F.col("symbol").alias("qualifiedName"), F.coalesce("file_path", "at.file_path").alias("filePath"), F.coalesce("start_line", "at.start_line").alias("startLine"), F.coalesce("end_line", "at.end_line").alias("endLine")))
    nodes = own.unionByName(named.select(F.col("symbol").alias("id"), F.coalesce("kind", F.lit("Symbol")).alias("label"), props.alias("properties")))
    edges = relations.select(F.concat_ws(":", F.lit("rel"), "kind", "source", "target").alias("id"), F.col("source").alias("sourceId"), F.col("target").alias("targetId"), F.upper("kind").alias("type"), F.lit(1.0).alias("confidence"), F.lit("").alias("reason"))
    return first_of_equal(nodes), first_of_equal(edges)


def first_of_equal(rows: DataFrame) -> DataFrame:
    """One row per id: files before symbols and then the least by its other columns, the same on every run."""
    rest = [c for c in rows.columns if c != "id"]
    order = F.struct(*([F.col("label") != "File"] if "label" in rest else []), *rest)
    return rows.groupBy("id").agg(F.min_by(F.struct(*rest), order).alias("f")).select("id", "f.*")


# --- index protobufs -----------------------------------------------------------------------------------------


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _signed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                break
        out.append(value - (1 << 64) if value >> 63 else value)
    return out


#: What a relationship's flags (by field) say of its two symbols.
RELATIONS = {3: "implements", 4: "depends_on", 5: "defines", 2: "depends_on"}
ROW = "kind string, path string, language string, symbol string, bits int, span array<int>, name string, target string, ordinal int"


def _strings(message: bytes, *numbers: int) -> list[str]:
    """The last string of each of these fields, empty if there is none."""
    found = {n: v for n, v in _fields(message) if isinstance(v, bytes)}
    return [found.get(n, b"").decode() for n in numbers]


def _occurrence(message: bytes) -> tuple[str, int, list[int]]:
    span: list[int] = []
    bits = 0
    for n, value in _fields(message):
        if n == 1:
            span += _signed(value) if isinstance(value, bytes) else [value]
        elif n == 3:
            bits = value
    return _strings(message, 2)[0], bits, span


def index_rows(data: bytes) -> Iterator[tuple]:
    """Rows of an index (ROW without the ordinal): its tool, and each document's file, occurrences, symbols and relations."""
    for number, value in _fields(data):
        if number == 1:
            root = _strings(value, 3)[0]
            for tool in [v for n, v in _fields(value) if n == 2]:
                name, version = _strings(tool, 1, 2)
                yield "tool", root, None, version, 0, [], name, None
        elif number == 2:
            path, language = _strings(value, 1, 4)
            yield "file", path, language, None, 0, [], None, None
            for n, inner in _fields(value):
                if n == 2:
                    yield "occurrence", path, language, *_occurrence(inner), None, None
                elif n == 3:
                    symbol, shown = _strings(inner, 1, 6)
                    yield "symbol", path, language, symbol, next((v for m, v in _fields(inner) if m == 5), 0), [], shown or None, None
                    for related in [v for m, v in _fields(inner) if m == 4]:
                        target = _strings(related, 1)[0]
                        for flag in [m for m, v in _fields(related) if m in RELATIONS and v == 1 and target]:
                            yield "relation", path, language, symbol, 0, [], RELATIONS[flag], target


def index_tables(contents: DataFrame) -> dict[str, DataFrame]:
    """``files``, ``occurrences``, ``symbols``, ``relations`` and ``tools`` of index protobufs (content); each index is parsed once."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            for content in frame["content"]:
                rows = [(*row, i) for i, row in enumerate(index_rows(bytes(content)))]
                yield pd.DataFrame(rows, columns=["kind", "path", "language", "symbol", "bits", "span", "name", "target", "ordinal"])

    ship(contents.sparkSession)
    rows = written(contents.select("content").mapInPandas(run, ROW), "index")
    of = lambda kind: rows.where(F.col("kind") == kind)
    at = decoded_range(F.col("span"))
    return {
        "files": of("file").select("path", "language", F.lit(None).cast("string").alias("digest")).distinct(),
        "occurrences": of("occurrence").select("symbol", role(F.col("bits")).alias("role"), F.col("path").alias("file_path"), at.alias("at"), "ordinal").select("symbol", "role", "file_path", "at.start_line", "at.end_line", "ordinal"),
        "symbols": of("symbol").groupBy("symbol").agg(F.min_by(F.struct(F.coalesce("name", "symbol").alias("display_name"), F.col("bits").alias("kind"), F.col("path").alias("file_path")), F.struct("path", "ordinal")).alias("f")).select("symbol", "f.*"),
        "relations": of("relation").select(F.col("symbol").alias("source"), "target", F.col("name").alias("kind")).distinct(),
        "tools": of("tool").select("name", F.col("symbol").alias("version"), F.col("path").alias("project_root")),
    }


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(files, occurrences) of index protobufs, read where they lie."""
    tables = index_tables(spark.read.format("binaryFile").load(path))
    return tables["files"], tables["occurrences"].drop("ordinal")


# --- symbol trees and resolutions ----------------------------------------------------------------------------


def stable_id(*parts: str) -> str:
    return hashlib.sha1("\0".join(parts).encode()).hexdigest()[:20]


def flattened_symbols(file_path: str, symbols: list[dict], separator: str = ".") -> tuple[list[tuple], list[tuple]]:
    """(nodes, edges) of an editor's nested document symbols: parents contain children, the file defines the top ones."""
    file_id = f"file:{file_path}"
    nodes, edges = [], []
    stack = [(s, file_id, "") for s in reversed(symbols)]
    while stack:
        symbol, parent, prefix = stack.pop()
        qualified = prefix + separator + symbol["name"] if prefix else symbol["name"]
        span = symbol.get("range") or symbol["location"]["range"]
        label = SYMBOL_KINDS.get(symbol.get("kind"), "Symbol")
        own = "symbol:" + stable_id(file_path, label, qualified, str(span["start"]["line"]))
        nodes.append((own, label, symbol["name"], qualified, file_path, span["start"]["line"] + 1, span["end"]["line"] + 1))
        edges.append((parent, own, "DEFINES" if parent == file_id else "CONTAINS"))
        stack += [(c, own, qualified) for c in reversed(symbol.get("children") or [])]
    return nodes, edges


def symbol_tables(files: DataFrame, separator: str = ".") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of (file_path, symbols as JSON), one file at a time on executors."""
    import json

    import pandas as pd

    def run(frames):
        for frame in frames:
            out = []
            for path, text in zip(frame["file_path"], frame["symbols"], strict=True):
                found, links = flattened_symbols(path, json.loads(text), separator)
                out += [("node", *n, None, None, None) for n in found] + [("edge", *[None] * 7, *e) for e in links]
            yield pd.DataFrame(out, columns=columns).astype({"start_line": "Int32", "end_line": "Int32"})

    columns = ["kind", "id", "label", "name", "qualified_name", "file_path", "start_line", "end_line", "source_id", "target_id", "type"]
    schema = ", ".join(f"{c} {'int' if c.endswith('_line') else 'string'}" for c in columns)
    ship(files.sparkSession)
    rows = written(files.select("file_path", "symbols").mapInPandas(run, schema), "symbols")
    return rows.where("kind = 'node'").select(columns[1:8]), rows.where("kind = 'edge'").select(columns[8:])


def resolutions(lines: DataFrame) -> DataFrame:
    """(source, definition) positions of resolvers' outputs (line, text): a query's heading, then indented definitions.

    With a column ``output`` each output is read on its own; without one the rows are one output.
    """
    place = r"^\s*(\S+?):(\d+):(\d+)"
    heading = F.col("text").rlike(r"^\S+:\d+:\d+") & (F.col("text").contains("queried") | F.col("text").rlike(r":\s*found"))
    own = Window.partitionBy("output") if "output" in lines.columns else Window.partitionBy(F.lit(0))
    upto = own.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.struct(F.regexp_extract("text", place, 1).alias("file_path"), F.regexp_extract("text", place, 2).cast("int").alias("line"), F.regexp_extract("text", place, 3).cast("int").alias("column"))
    rows = lines.withColumn("source", F.last(F.when(heading, at), True).over(upto)).where(~heading & F.col("text").rlike(place) & F.col("source").isNotNull())
    return rows.select("source", at.alias("definition"))


def lowered_resolutions(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): files contain references and define symbols; a reference refers to its symbols."""
    key = lambda kind, p: F.concat_ws(":", F.lit(kind), F.col(f"{p}.file_path"), F.col(f"{p}.line").cast("string"), F.col(f"{p}.column").cast("string"))
    file = lambda p: F.concat(F.lit("file:"), F.col(f"{p}.file_path"))
    node = lambda i, label, p: found.select(i.alias("id"), F.lit(label).alias("label"), F.col(f"{p}.file_path").alias("file_path"), F.col(f"{p}.line").alias("start_line"))
    reference, symbol = key("ref", "source"), key("def", "definition")
    files = found.select(F.explode(F.array("source.file_path", "definition.file_path")).alias("p")).select(F.concat(F.lit("file:"), "p").alias("id"), F.lit("File").alias("label"), F.col("p").alias("file_path"), F.lit(None).cast("int").alias("start_line"))
    nodes = files.unionByName(node(reference, "Reference", "source")).unionByName(node(symbol, "Symbol", "definition"))
    edge = lambda a, b, t: found.select(a.alias("source_id"), b.alias("target_id"), F.lit(t).alias("type"))
    edges = edge(file("source"), reference, "CONTAINS").unionByName(edge(file("definition"), symbol, "DEFINES")).unionByName(edge(reference, symbol, "REFERS_TO")).distinct()
    return first_of_equal(nodes), edges
