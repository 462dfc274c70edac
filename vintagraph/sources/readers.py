"""Readers and writers of the file forms that corpora, specifications and logs come in."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "doc_id string, filename string, page int, start_offset int, length int, text string, extra map<string,string>"
ENTITIES = "id string, props struct<name string, type string, description string>"
RELATIONS = "head_id string, tail_id string, type string, props struct<sign string, domain_conf double, evidence_count bigint, description string>"
#: Fixed value: form of a step log line: time, session in brackets, step, seconds, details.
STEP = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \| \[(session_[^\]]+)\] ([^:|]+?) ?: ?(\d+(?:\.\d+)?)초(?: \| (.*))?$"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one chunk each; missing fields are null, broken lines are left out."""
    return spark.read.schema(CHUNKS + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad is null or doc_id is not null").drop("_bad")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines, UTF-8, nulls kept."""
    chunks.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_graph(spark: SparkSession, path: str, what: str) -> DataFrame:
    """``entities`` or ``relations`` from JSON documents."""
    return spark.read.schema({"entities": ENTITIES, "relations": RELATIONS}[what]).option("multiLine", True).json(path)


def parse_steps(lines: DataFrame, col: str = "value") -> DataFrame:
    """ts, session, step, seconds, details of step log lines; others are left out. Works on streams too."""
    g = lambda i: F.regexp_extract(col, STEP, i)
    return lines.where(F.col(col).rlike(STEP)).select(F.to_timestamp(g(1), "yyyy-MM-dd HH:mm:ss").alias("ts"), g(2).alias("session"), F.trim(g(3)).alias("step"), g(4).cast("double").alias("seconds"), F.nullif(g(5), F.lit("")).alias("details"))


def introspect(tables: dict[str, DataFrame]) -> list[dict]:
    """name, columns (name, type, meaning by name) and row count of each table."""
    out = []
    for name, df in tables.items():
        out.append({"table": name, "rows": df.count(), "columns": [(f.name, f.dataType.simpleString(), meaning(f.name, f.dataType.simpleString())) for f in df.schema]})
    return out


#: What a part of a column's name means.
MEANINGS = (("key", "identifier"), ("id", "identifier"), ("name", "name"), ("date", "date"), ("time", "date"), ("price", "amount"), ("total", "amount"), ("bal", "amount"), ("qty", "quantity"), ("quantity", "quantity"), ("status", "status"), ("type", "category"), ("segment", "category"))


def meaning(column: str, kind: str) -> str:
    """A column's meaning by its name, then by its type."""
    for part, m in MEANINGS:
        if part in column.lower():
            return m
    return {"string": "text", "double": "measure", "bigint": "number", "int": "number"}.get(kind, "other")


def run_select(spark: SparkSession, statement: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The result of one SELECT over ``tables``, times as ISO text and intervals as text. Other statements are refused."""
    if not re.match(r"\s*(?:select|with)\b", statement, re.I) or ";" in statement.rstrip().rstrip(";"):
        raise ValueError("one SELECT is expected")
    out = spark.sql(re.sub(r"\b(" + "|".join(map(re.escape, tables)) + r")\b(?=\s*(?:$|[,)\s]))", lambda m: "{" + m[1] + "}", statement) if tables else statement, **tables)
    iso = {"timestamp": "yyyy-MM-dd'T'HH:mm:ss", "timestamp_ntz": "yyyy-MM-dd'T'HH:mm:ss", "date": "yyyy-MM-dd"}
    as_text = lambda f: F.date_format(f.name, iso[f.dataType.typeName()]) if f.dataType.typeName() in iso else F.col(f.name).cast("string") if "interval" in f.dataType.typeName() else F.col(f.name)
    return out.select(*[as_text(f).alias(f.name) for f in out.schema])


def read_registry(path: str, required: list[str]) -> list[dict]:
    """The entries of a JSON or YAML list of specifications; entries that lack a required field are dropped."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            data = yaml.safe_load(f)
        else:
            data = json.load(f)
    rows = data if isinstance(data, list) else next((v for v in (data or {}).values() if isinstance(v, list)), [])
    return [r for r in rows if isinstance(r, dict) and all(r.get(k) not in (None, "") for k in required)]


class VersionedTable:
    """A table as numbered folders of Parquet files; what is staged becomes the next version at ``commit``, or nothing does.

    A version is complete or not there: it is written beside the others and then takes its name.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.staged = spark, path.rstrip("/"), None
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """The newest version, 0 if there is none."""
        n = 0
        while self._fs.exists(self._at(f"v{n + 1}")):
            n += 1
        return n

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{version or self.version()}")

    def stage(self, rows: DataFrame) -> None:
        self.staged = rows

    def commit(self) -> int:
        """Write what is staged as the next version; without anything staged, or if another commit was first, it raises."""
        if self.staged is None:
            raise ValueError("nothing is staged")
        n = self.version() + 1
        new = f"_new_v{n}"
        self.staged.write.mode("overwrite").parquet(f"{self.path}/{new}")
        if self._fs.exists(self._at(f"v{n}")) or not self._fs.rename(self._at(new), self._at(f"v{n}")):
            raise ValueError(f"version {n} was committed by another")
        self.staged = None
        return n

    def rollback(self) -> None:
        self.staged = None
