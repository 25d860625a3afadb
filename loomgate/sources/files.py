"""Readers and writers for JSON lines, JSON documents, ledgers, archives and digests."""

from __future__ import annotations

import ast
import csv
import io
import json
import os
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, a bad line fails with its file."""
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    rows = lines.select(F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.input_file_name().alias("file"))
    checked = F.when(F.col("r._bad").isNotNull(), F.raise_error(F.concat(F.col("file"), F.lit(": bad line: "), F.substring("r._bad", 1, 200)))).otherwise(F.lit(True))
    return rows.filter(checked).select(*[F.col(f"r.`{f.name}`") for f in schema.fields])


def read_jsonl_by_key(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """``read_jsonl`` that fails on missing or repeated keys."""
    rows = read_jsonl(spark, path, schema)
    bad = rows.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1)).orderBy(key).limit(3).collect()
    if bad:
        raise ValueError(f"missing or repeated {key}: {[r[0] for r in bad]}")
    return rows


def read_json_document(spark: SparkSession, path: str, schema: T.StructType, rows: str | None = None) -> DataFrame:
    """One JSON object a file; with ``rows``, one row an element of that array."""
    doc = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc if rows is None else doc.select(F.explode(rows).alias("r")).select("r.*")


def read_ledger(spark: SparkSession, path: str, key: str) -> DataFrame:
    """CSV with a header, all text, trimmed, empty for null; keys must be there and unique."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = raw.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in raw.columns])
    bad = rows.groupBy(key).count().filter((F.col(key) == "") | (F.col("count") > 1)).limit(3).collect()
    if bad:
        raise ValueError(f"empty or repeated {key}: {[r[0] for r in bad]}")
    return rows


def read_archive(spark: SparkSession, path: str, member: str = ".*") -> DataFrame:
    """``archive, member, text`` of the members of zip files whose name matches ``member``."""
    wanted = re.compile(member)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if wanted.search(n)]
                    for n in names:  # one member in memory at a time
                        yield pd.DataFrame({"archive": [archive], "member": [n], "text": [z.read(n).decode("utf-8")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, text string")


def read_strata(spark: SparkSession, path: str, member: str, element: T.DataType, expected: int) -> DataFrame:
    """``read_archive_rows`` of members named by ``member``, with ``stratum`` from its first group; fails unless there are ``expected`` of them."""
    docs = read_archive(spark, path, member).withColumn("stratum", F.regexp_extract("member", member, 1))
    found = sorted(r[0] for r in docs.select("stratum").distinct().collect())  # one a member
    if len(found) != expected:
        raise ValueError(f"{expected} strata expected, found {found}")
    rows = docs.select("member", "stratum", F.posexplode(F.from_json("text", T.ArrayType(element))).alias("row_index", "row"))
    return rows.select("member", "stratum", "row_index", "row.*")


def read_text(spark: SparkSession, path: str) -> tuple[str, str]:
    """(text, SHA-256) of one policy or template file; it is small and goes into plans as a literal."""
    rows = spark.read.format("binaryFile").load(path).select(F.decode("content", "utf-8").alias("text"), F.sha2("content", 256).alias("sha")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one file")
    return rows[0]["text"], rows[0]["sha"]


def read_archive_rows(spark: SparkSession, path: str, member: str, element: T.DataType) -> DataFrame:
    """Elements of JSON arrays in archive members, with ``member`` and ``row_index`` from 0."""
    docs = read_archive(spark, path, member)
    return docs.select("member", F.posexplode(F.from_json("text", T.ArrayType(element))).alias("row_index", "row")).select("member", "row_index", "row.*")


def python_classes(sources: DataFrame) -> DataFrame:
    """``member, class_name, docstring, attributes, calls`` of the classes in Python source texts.

    ``attributes`` are string constants assigned in the class body, ``calls``
    the literal first names given to ``FunctionCall(function=...)``, in order and
    distinct.  Sources that can't be parsed give no rows.
    """

    def described(node: ast.ClassDef) -> tuple:
        attributes, calls = {}, []
        for part in node.body:
            if isinstance(part, ast.Assign) and isinstance(part.value, ast.Constant) and isinstance(part.value.value, str):
                attributes.update({t.id: part.value.value for t in part.targets if isinstance(t, ast.Name)})
        for part in ast.walk(node):
            if isinstance(part, ast.Call) and getattr(part.func, "id", getattr(part.func, "attr", "")) == "FunctionCall":
                given = [k.value for k in part.keywords if k.arg == "function"]
                calls += [v.value for v in given if isinstance(v, ast.Constant) and isinstance(v.value, str)]
        return node.name, ast.get_docstring(node), attributes, list(dict.fromkeys(calls))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for member, text in zip(pdf["member"], pdf["text"]):
                try:
                    tree = ast.parse(text)
                except (SyntaxError, ValueError, TypeError):
                    continue
                rows += [(member, *described(n)) for n in tree.body if isinstance(n, ast.ClassDef)]
            yield pd.DataFrame(rows, columns=["member", "class_name", "docstring", "attributes", "calls"])

    schema = "member string, class_name string, docstring string, attributes map<string,string>, calls array<string>"
    return sources.select("member", "text").mapInPandas(run, schema)


def version_key(member: Column) -> Column:
    """Numbers of the first ``vN_N_N`` in a path as an array, empty where there is none; arrays compare number by number."""
    found = F.regexp_extract(member, r"(?:^|/)v(\d+(?:_\d+)*)(?:/|$)", 1)
    return F.when(found == "", F.array().cast("array<int>")).otherwise(F.split(found, "_").cast("array<int>"))


def latest_versions(classes: DataFrame) -> DataFrame:
    """For each class the description of its newest version."""
    others = [c for c in classes.columns if c != "class_name"]
    order = F.struct(version_key(F.col("member")).alias("v"), F.col("member").alias("m"))
    return classes.groupBy("class_name").agg(F.max_by(F.struct(*others), order).alias("r")).select("class_name", "r.*")


def file_digests(spark: SparkSession, path: str, upper: bool = False) -> DataFrame:
    """``path, sha256`` of whole files."""
    digest = F.sha2("content", 256)
    return spark.read.format("binaryFile").load(path).select("path", (F.upper(digest) if upper else digest).alias("sha256"))


def write_json_document(value: object, path: str) -> None:
    """A small summary: two blanks of indent, UTF-8, a new line at the end; folders are made."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(value, indent=2, ensure_ascii=False) + "\n")


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines, sorted over all files where ``order`` is given."""
    (df.orderBy(*order) if order else df).write.mode("errorifexists").json(path)


def write_ledger(rows: DataFrame, path: str, progress: dict[str, str], overwrite: bool = False) -> None:
    """A review ledger as CSV; one with progress is only replaced on demand.

    ``progress`` names the columns and their untouched values; any other value
    is progress.  Ledgers are made for people, so they are small.
    """
    if os.path.exists(path) and not overwrite:
        with open(path, newline="", encoding="utf-8") as f:
            if any((r.get(c) or "").strip() != v for r in csv.DictReader(f) for c, v in progress.items()):
                raise FileExistsError(f"{path} has review progress")
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(rows.columns)
        out.writerows([["" if v is None else v for v in r] for r in rows.toLocalIterator()])
