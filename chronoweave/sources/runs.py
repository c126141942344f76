"""A run on disk: a folder kg/ of JSON lines (nodes, edges, events, provenance, mentions, aliases), read strictly or tolerantly, written canonically."""

from __future__ import annotations

import email
import email.policy
import io
import json
import re
import zipfile
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.times import iso

TABLES = {
    "nodes": "id string, type string, created_at string, props string, aliases array<string>",
    "edges": "id string, type string, src string, dst string, created_at string, props string",
    "events": "id string, type string, timestamp string, actors map<string,array<string>>, subjects array<string>, initiative string, project string, "
    "deliverable struct<kind:string,medium:string>, parent_event string, payload string",
    "provenance": "target_id string, artifacts array<struct<path:string>>",
    "mentions": "artifact_path string, entity_id string, surface_form string, locator struct<medium:string,offset:int,length:int,line:int>",
    "aliases": "entity_id string, canonical string, aliases array<string>",
}
KEYS = {"nodes": ["id"], "edges": ["id"], "events": ["timestamp", "id"], "provenance": ["target_id"], "mentions": ["artifact_path", "entity_id"], "aliases": ["entity_id"]}
REQUIRED = {"nodes": ["id", "type", "created_at"], "edges": ["id", "type", "src", "dst", "created_at"], "events": ["id", "type", "timestamp"], "provenance": ["target_id"], "mentions": ["artifact_path", "entity_id"], "aliases": ["entity_id"]}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def read_table(spark: SparkSession, run: str, table: str, tolerant: bool = False) -> DataFrame:
    """One table of a run. Strictly, a malformed line fails the read; tolerantly, it is skipped and a missing file is an empty table."""
    path = f"{run}/kg/{table}.jsonl"
    if tolerant and not exists(spark, path):
        return spark.createDataFrame([], TABLES[table])
    return spark.read.schema(TABLES[table]).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def duplicates(df: DataFrame, key: str = "id") -> DataFrame:
    """Keys that occur more than once: what a strict reader refuses."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def time_range(events: DataFrame, window: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """(first, last): the manifest's window if it has both ends, else the least and greatest event time that is not blank."""
    both = all(window)
    stamps = events.where("trim(timestamp) <> ''").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    return stamps.select(F.lit(window[0]).alias("first"), F.lit(window[1]).alias("last")) if both else stamps


def write_table(df: DataFrame, run: str, table: str) -> None:
    """Canonical lines: sorted by key, columns in alphabetical order, null fields kept out."""
    sorted_ = df.orderBy(*[c for c in KEYS[table] if c in df.columns])
    sorted_.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(f"{run}/kg/{table}.jsonl")


def schema_issues(df: DataFrame, table: str) -> DataFrame:
    """(table, id, field) of required fields that are missing."""
    key = KEYS[table][-1]
    bad = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED[table]]), lambda x: x.isNotNull())
    return df.select(F.lit(table).alias("table"), F.col(key).alias("id"), F.explode(bad).alias("field"))


def _leaves(value: object) -> Iterator[str]:
    if isinstance(value, str):
        if value.strip():
            yield value.strip()
    elif isinstance(value, dict):
        for v in value.values():
            yield from _leaves(v)
    elif isinstance(value, list):
        for v in value:
            yield from _leaves(v)


def extract(path: str, content: bytes) -> str:
    """The text of a document: Word runs, JSON string leaves, mail subject and text parts, else the file itself."""
    if path.endswith(".docx"):
        parts = []
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in ("word/document.xml", "word/comments.xml"):
                if name in z.namelist():
                    xml = re.sub(r"<w:br\s*/>|</w:p>", "\n", z.read(name).decode("utf-8"))
                    parts.append("".join(unescape(m) if m != "\n" else m for m in re.findall(r"(?<=>)[^<>]+(?=</w:t>)|\n", xml)))
        return "\n".join(parts).strip()
    if path.endswith(".json"):
        try:
            return "\n".join(_leaves(json.loads(content)))
        except ValueError:
            return ""
    if path.endswith(".eml"):
        mail = email.message_from_bytes(content, policy=email.policy.default)
        texts = [p.get_content() for p in mail.walk() if p.get_content_type() == "text/plain"]
        return "\n".join([str(mail["subject"] or ""), *texts]).strip()
    return content.decode("utf-8", "replace")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of every document below ``folder``, its kg/ folder apart; one file is one row, read by the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "text": [extract(p, bytes(c)) for p, c in zip(f["path"], f["content"], strict=True)]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    inside = F.regexp_replace("path", "^.*?" + re.escape(folder.removeprefix("file://").rstrip("/")) + "/", "")
    return files.select(inside.alias("path"), "content").where("path not like 'kg/%' and path rlike '[.](md|json|docx|eml|txt)$'").mapInPandas(run, "path string, text string")


def discover(spark: SparkSession, root: str) -> list[str]:
    """Folders at most three levels below ``root`` that hold kg/nodes.jsonl; what lies inside a run is not searched."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    base = fs_path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    found, level = [], [base]
    for _ in range(4):
        deeper = []
        for p in level:
            if fs.exists(fs_path(p, "kg/nodes.jsonl")):
                found.append(str(p.toString()))
            elif fs.exists(p) and fs.getFileStatus(p).isDirectory():
                deeper += [s.getPath() for s in fs.listStatus(p) if s.isDirectory()]
        level = deeper
    return sorted(found)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(qa_id, predicted_ids): of several rows for a question the last in the file counts."""
    rows = spark.read.schema("qa_id string, predicted_ids array<string>").json(path).withColumn("_at", F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")))
    return rows.where("qa_id is not null").groupBy("qa_id").agg(F.max_by("predicted_ids", "_at").alias("predicted_ids"))


def timed(df: DataFrame, column: str = "created_at") -> DataFrame:
    return df.withColumn("created", iso(column))
