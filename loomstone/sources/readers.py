"""Sources: JSON lines and CSV with defaults, Markdown sections, tables as text, configuration, saved answers."""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTORY = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
ROWS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("instruction", "response", "context")] + [T.StructField("history", HISTORY)] + [T.StructField(n, T.StringType()) for n in ("category", "intent")]
)
DOCUMENT = "page_content string, metadata map<string,string>"
FORMATS = {".jsonl": "json", ".json": "json", ".csv": "csv"}


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))


def with_defaults(rows: DataFrame) -> DataFrame:
    """The training columns: missing or null context is "", history empty."""
    out = rows
    for f in ROWS:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    history = F.col("history") if dict(out.dtypes)["history"] != "string" else F.from_json("history", HISTORY)
    return out.withColumn("context", F.coalesce("context", F.lit(""))).withColumn("history", F.coalesce(history, F.array().cast(HISTORY)))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Training rows from .jsonl, .json or .csv (by the extension, any case) or from a Parquet snapshot."""
    kind = FORMATS.get(os.path.splitext(path)[1].lower())
    if not exists(spark, path):
        raise FileNotFoundError(f"Dataset file not found: {path}. Build it first (loomstone.plans.build.write_dataset).")
    if kind is None:
        return with_defaults(spark.read.parquet(path))
    if kind == "csv":
        return with_defaults(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))
    return with_defaults(spark.read.schema(ROWS).option("mode", "PERMISSIVE").json(path))


def sections(files: DataFrame, text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(title, content, source) of each second-level Markdown section; what is before the first is dropped.

    content starts with the heading; source is that of the first "Source:" line, else null.
    """
    blocks = files.select(*keep, F.posexplode(F.slice(F.split(text, "(?m)^## "), 2, 2**31 - 1)).alias("no", "block"))
    parts = F.split("block", "\n", 2)
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    title, body = trimmed(F.get(parts, 0)), F.coalesce(F.get(parts, 1), F.lit(""))
    source = F.regexp_extract(body, r"(?m)^Source:\s*(\S+)\s*$", 1)
    return blocks.select(*keep, "no", title.alias("title"), F.concat(F.lit("## "), title, F.lit("\n"), trimmed(body)).alias("content"), F.when(source != "", source).alias("source"))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    return sections(spark.read.text(path, wholetext=True))


def sections_by_title(found: DataFrame) -> DataFrame:
    """(title, content), of equal titles the last."""
    return found.groupBy("title").agg(F.max_by("content", "no").alias("content"))


def row_text(df: DataFrame, columns: list[str] | None = None, null: str = "nan") -> Column:
    """"column: value" pairs in column order, joined by commas; nulls read ``null``."""
    return F.concat_ws(", ", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null))) for c in columns or df.columns))


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCUMENT)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(page_content, metadata) from Markdown, PDF, Excel or a table; unknown kinds and missing files give none, with a warning."""
    kind = os.path.splitext(path)[1].lower()
    if kind not in (".md", ".pdf", ".xlsx", ".csv", ".parquet"):
        warnings.warn(f"Unsupported file type: {kind}", stacklevel=2)
        return _empty(spark)
    if not exists(spark, path):
        warnings.warn(f"File not found at {path}. Returning no documents.", stacklevel=2)
        return _empty(spark)
    if kind == ".md":
        meta = F.create_map(F.lit("title"), F.col("title"), F.lit("source"), F.coalesce("source", F.lit(path)))
        return read_sections(spark, path).select(F.col("content").alias("page_content"), meta.alias("metadata"))
    if kind == ".pdf":
        return _pdf(spark, path)
    if kind == ".xlsx":
        import pandas as pd  # needs openpyxl, which pandas asks for by name

        table = spark.createDataFrame(pd.read_excel(path))
    else:
        table = spark.read.option("header", True).csv(path) if kind == ".csv" else spark.read.parquet(path)
    return table.select(row_text(table).alias("page_content"), F.create_map().cast("map<string,string>").alias("metadata"))


def _pdf(spark: SparkSession, path: str) -> DataFrame:
    def pages(batches):
        import io

        import pandas as pd
        from pypdf import PdfReader  # optional: only where PDFs are read

        for b in batches:
            rows = [(p.extract_text(), {"source": src, "page": str(i)}) for src, raw in zip(b["path"], b["content"], strict=True) for i, p in enumerate(PdfReader(io.BytesIO(raw)).pages)]
            yield pd.DataFrame(rows, columns=["page_content", "metadata"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(pages, DOCUMENT)


def union_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    out = _empty(spark)
    for p in paths:
        out = out.unionByName(read_documents(spark, p))
    return out


def config(paths: list[str], env: Mapping[str, str] | None = None) -> dict:
    """YAML files merged at the top level, later ones first; missing ones warn, none at all is an error; OUTPUT_DIR wins."""
    import yaml

    env = os.environ if env is None else env
    out: dict = {}
    for path in paths:
        try:
            with open(path) as f:
                out |= yaml.safe_load(f) or {}
        except FileNotFoundError:
            warnings.warn(f"Configuration file not found at {path}", stacklevel=2)
        except yaml.YAMLError as e:
            warnings.warn(f"Error parsing {path}: {e}", stacklevel=2)
    if not out:
        raise FileNotFoundError("No configuration files found.")
    if env.get("OUTPUT_DIR"):
        out.setdefault("training", {})["output_dir"] = env["OUTPUT_DIR"]
    return out


def flatten(nested: Mapping, parent: str = "", sep: str = ".") -> dict:
    """Nested mappings as dotted keys; an empty mapping gives none."""
    out = {}
    for k, v in nested.items():
        key = f"{parent}{sep}{k}" if parent else str(k)
        out |= flatten(v, key, sep) if isinstance(v, Mapping) else {key: v}
    return out


def flatten_columns(df: DataFrame, sep: str = ".") -> DataFrame:
    """Struct columns as one column per leaf, by dotted name."""

    def leaves(kind: T.StructType, path: list[str]) -> list[Column]:
        out = []
        for f in kind:
            here = [*path, f.name]
            out += leaves(f.dataType, here) if isinstance(f.dataType, T.StructType) else [F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here))]
        return out

    return df.select(*leaves(df.schema, []))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(id, answer) from a JSON object {id: answer} or from the list of a former report."""
    text = spark.read.text(path, wholetext=True).first()[0]
    data = json.loads(text)
    rows = [(str(k), v) for k, v in data.items()] if isinstance(data, dict) else [(str(r["id"]), r["answer"]) for r in data]
    return spark.createDataFrame(rows, "id string, answer string")
