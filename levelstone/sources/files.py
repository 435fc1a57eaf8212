"""Raw files in and results out: text CSV scans, digests, manifests, CSV/JSON/Markdown sinks."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bars import RAW_COLUMNS


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names. A cluster without one is an error; a session in one process
    gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def resolve_source(spark: SparkSession, path: str | None, candidates: Iterable[str]) -> tuple[str, list[str]]:
    """(path, notes): the given path, or the first candidate that exists; a note says which stood in for the first."""
    names = list(candidates)
    for i, p in enumerate([path] if path else names):
        if exists(spark, p):
            return p, [f"used {p} in place of {names[0]}"] if i else []
    raise FileNotFoundError(f"no source among {[path] if path else names}")


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"required columns are missing: {missing}")
    return df


def column_report(df: DataFrame, expected: Iterable[str] = RAW_COLUMNS) -> dict[str, list[str]]:
    want = list(expected)
    return {"missing": [c for c in want if c not in df.columns], "extra": [c for c in df.columns if c not in want]}


def read_text_csv(spark: SparkSession, path: str, columns: Iterable[str] = RAW_COLUMNS) -> DataFrame:
    """Every column as text, blanks as the empty string, with the line of each row (the header is line 1).

    A raw file is one file read in order: its rows get their line from their place in the file, by the blocks in which a
    large one is read. Parts of a folder follow each other by name. Quotes in quoted values are doubled.
    """
    df = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    df = require(df, columns).select([F.coalesce(c, F.lit("")).alias(c) for c in df.columns] + [place.alias("_at")])
    w = Window.partitionBy("series_id").orderBy("_at")
    df = df if "series_id" in df.columns else df.withColumn("series_id", F.lit("raw"))
    return df.withColumn("source_row_number", (F.row_number().over(w) + 1).cast("long")).drop("_at")


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Typed scan; values that don't fit are NULL."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"').schema(schema).csv(path)


def read_json(spark: SparkSession, path: str) -> dict:
    """One JSON object, such as a manifest."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def point_lookup(df: DataFrame, key: str, value) -> dict | None:
    """The first row whose ``key`` is ``value``."""
    row = df.where(F.col(key) == F.lit(value)).first()
    return row.asDict() if row else None


def digest(spark: SparkSession, path: str) -> dict:
    """SHA-256 and size of a file of any size, streamed in chunks of 1 MiB."""
    fs, p = _fs(spark, path)
    jvm = spark._jvm
    sha = jvm.java.security.MessageDigest.getInstance("SHA-256")
    source = jvm.java.security.DigestInputStream(fs.open(p), sha)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, jvm.java.io.OutputStream.nullOutputStream(), 1 << 20, True)
    return {"sha256": bytes(sha.digest()).hex(), "bytes": fs.getFileStatus(p).getLen()}


def relative_path(path: str, root: str) -> str:
    """``path`` below ``root``, with slashes; the path itself where it lies elsewhere."""
    a, b = (x.replace("\\", "/").rstrip("/") for x in (path, root))
    return a[len(b) + 1 :] if b and a.startswith(b + "/") else a


def print_summary(value: dict) -> None:
    """A result as JSON on standard output, for callers that read it there."""
    print(json.dumps(value, ensure_ascii=False, indent=2, default=str))


def manifest(spark: SparkSession, path: str, rows: int, root: str | None = None) -> dict:
    return {"path": relative_path(path, root) if root else path.rsplit("/", 1)[-1], **digest(spark, path), "n_rows": rows, "audit_run_utc": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")}


def check_manifest(spark: SparkSession, path: str, manifest_path: str) -> list[str]:
    """Notes; ValueError if the file isn't the one that was audited. A missing manifest is only noted."""
    if not exists(spark, manifest_path):
        return [f"no manifest at {manifest_path}; the source's digest was not compared"]
    if read_json(spark, manifest_path)["sha256"] != digest(spark, path)["sha256"]:
        raise ValueError(f"{path} differs from the audited file")
    return []


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    write_bytes(spark, path, json.dumps(value, ensure_ascii=False, indent=2, default=str).encode())


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, in parts, for results of any size. Blanks at the ends of values stay; quotes are doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """One file with a byte order mark, for result tables of report size."""
    import csv
    import io

    text = io.StringIO()
    w = csv.writer(text, lineterminator="\n")
    w.writerow(df.columns)
    w.writerows(["" if v is None else v for v in r] for r in df.toLocalIterator())
    write_bytes(df.sparkSession, path, b"\xef\xbb\xbf" + text.getvalue().encode())


def markdown(df: DataFrame) -> str:
    """A table for a report; bars and line breaks in cells are escaped, NULL is empty."""

    def cell(v) -> str:
        text = "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
        return text.replace("|", "\\|").replace("\n", " ")

    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in df.toLocalIterator()])


def report(title: str, sections: dict[str, DataFrame | str]) -> str:
    """A Markdown report of result tables and texts."""
    parts = [f"# {title}"]
    for name, body in sections.items():
        parts += [f"## {name}", body if isinstance(body, str) else markdown(body)]
    return "\n\n".join(parts) + "\n"
