"""A data source that writes documents: each row a file, replaced whole or not at all, and only if its content changed.

Tasks write changed documents beside the others, under a name of the job's own; only when all tasks are done does the driver
move them into their places, one atomic replacement each. A task that is killed, or that loses a race against another
attempt, leaves nothing but such a file, which goes with the job.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGED = ".staged-"


def digest_of(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@dataclass
class Staged(WriterCommitMessage):
    """What a task has to hand in: (document, file beside it) of those that changed, and how many did not."""

    changed: list[tuple[str, str]] = field(default_factory=list)
    seen: list[str] = field(default_factory=list)


class DocumentWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder
        self.staging = os.path.join(folder, STAGED + uuid.uuid4().hex)

    def write(self, iterator: Iterator[Row]) -> Staged:
        os.makedirs(self.staging, exist_ok=True)
        out = Staged()
        for row in iterator:
            name, data = row["name"], (row["content"] or "").encode()
            if not name or name.startswith(("/", ".", "_")) or posixpath.normpath(name) != name or ".." in name.split("/"):
                raise ValueError(f"a document's name is a relative path, not {name!r}")
            out.seen.append(name)
            target = os.path.join(self.folder, name)
            if os.path.isfile(target) and os.path.getsize(target) == len(data):
                with open(target, "rb") as f:
                    if digest_of(f.read()) == digest_of(data):
                        continue
            beside = os.path.join(self.staging, uuid.uuid4().hex)
            with open(beside, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            out.changed.append((name, beside))
        return out

    def commit(self, messages: list[Staged | None]) -> None:
        names = [n for m in messages if m for n in m.seen]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a document was written twice; nothing was replaced")
        for name, beside in (c for m in messages if m for c in m.changed):
            target = os.path.join(self.folder, name)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            os.replace(beside, target)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class DocumentSink(DataSource):
    """``df.write.format("documents").mode("append")`` of (name, content) to a folder that driver and executors mount alike."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.StringType())])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("documents are replaced by their names: append them")
        parsed = urlparse(self.options["path"])
        if parsed.scheme not in ("", "file"):
            raise ValueError(f"{parsed.scheme}: documents need a folder that is mounted")
        folder = unquote(parsed.path) if parsed.scheme else self.options["path"]
        os.makedirs(folder, exist_ok=True)
        return DocumentWriter(folder)


def write_documents(df: DataFrame, path: str, name_col: str = "name", content_col: str = "content") -> None:
    """Writes each row as a document. Names must differ; null contents are empty documents; other columns aren't read."""
    df.sparkSession.dataSource.register(DocumentSink)
    rows = df.select(F.col(name_col).cast("string").alias("name"), F.col(content_col).cast("string").alias("content"))
    rows.write.format("documents").mode("append").save(path)


def result_documents(results: DataFrame) -> DataFrame:
    """(name, content): a JSON document per task and subject, as it is stored."""
    body = F.to_json(F.struct(*(c for c in results.columns if c not in ("task", "subject"))))
    return results.select(F.concat_ws("/", "task", F.concat(F.col("subject"), F.lit(".json"))).alias("name"), body.alias("content"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, content, digest) of the documents below a folder; what is staged isn't among
    them, nor are empty documents, which Spark's reader passes over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = F.lit("file:" + unquote(urlparse(path).path) if path.startswith("file:") else "file:" + path)
    name = F.regexp_replace(F.replace(F.col("path"), root, F.lit("")), "^/+", "")
    return files.select(name.alias("name"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("digest"))
