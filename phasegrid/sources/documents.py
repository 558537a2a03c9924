"""Sinks with a commit: trigger documents as named files, and the log as one file with one header.

Both are data sources of Spark's for tables and streams.  Tasks write into a staging
folder of their job's, under a name of their own; only the driver's commit, once all
tasks are through, moves documents to their places or adds lines to the log.  A task
that dies, or runs twice, leaves nothing that a reader sees, and a batch that is tried
again writes the same names, or finds that the log has it already.

    register(spark)
    write_documents(triggers, "/shared/triggers")
    write_log(log, "/shared/discrepancies.csv")
"""

import csv
import fcntl
import io
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from phasegrid.sources.triggers import trigger_file_name

DOCUMENTS, LOG = "phasegrid_documents", "phasegrid_log"
STAGING = "_staging"


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: its folder below that of its job, and the names in it, in order.

    A stream's commits run in a process of their own, so the message says all they need.
    """

    job: str
    folder: str
    names: list[str]


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; plain paths are those of a shared mount."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


class _DocumentWriter(DataSourceWriter, DataSourceStreamWriter):
    """Rows (file_name, document) as files."""

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def _folder(self, *parts: str) -> tuple[pafs.FileSystem, str]:
        store, top = store_of(self.path)
        return store, "/".join((top, STAGING, *parts))

    def write(self, rows: Iterator[Row]) -> Staged:
        attempt, names = uuid.uuid4().hex, {}
        store, folder = self._folder(self.job, attempt)
        store.create_dir(folder)
        for row in rows:
            if "/" in row["file_name"]:
                raise ValueError(f"no name of a document: {row['file_name']}")
            with store.open_output_stream(f"{folder}/{row['file_name']}") as out:
                out.write(row["document"].encode())
            names[row["file_name"]] = None
        return Staged(self.job, attempt, list(names))

    def commit(self, messages: list[Staged | None], batchId: int | None = None) -> None:  # noqa: N803
        store, top = store_of(self.path)
        for message in messages:
            for name in message.names if message else ():
                store.move(self._folder(message.job, message.folder, name)[1], f"{top}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Staged | None], batchId: int | None = None) -> None:  # noqa: N803
        for job in {self.job, *(m.job for m in messages if m)}:
            store, folder = self._folder(job)
            if store.get_file_info(folder).type != pafs.FileType.NotFound:
                store.delete_dir(folder)


class _LogWriter(DataSourceWriter, DataSourceStreamWriter):
    """Rows as lines of one CSV file on a shared mount.

    Beside the log a small file says how long it is as of the last commit, and which
    batch of a stream that was.  Bytes beyond it are of a commit that died, and go
    before the next one; the new length is put there in one step, by a rename.
    """

    def __init__(self, path: str, header: list[str], query: str):
        self.path, self.header, self.query, self.job = store_of(path)[1], header, query, uuid.uuid4().hex

    def _staging(self, job: str) -> str:
        return f"{self.path}.{STAGING}/{job}"

    def write(self, rows: Iterator[Row]) -> Staged:
        os.makedirs(self._staging(self.job), exist_ok=True)
        name = uuid.uuid4().hex
        with open(f"{self._staging(self.job)}/{name}", "w", encoding="utf-8", newline="") as out:
            lines = csv.writer(out)
            for row in rows:
                lines.writerow(["" if v is None else v for v in row])
        return Staged(self.job, "", [name])

    def commit(self, messages: list[Staged | None], batchId: int | None = None) -> None:  # noqa: N803
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        with open(f"{self.path}.lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            self._append(messages, batchId)
        self.abort(messages)

    def _append(self, messages: list[Staged | None], batch: int | None) -> None:
        said = f"{self.path}.committed"
        size = os.path.getsize(self.path) if os.path.exists(self.path) else 0
        done = {"size": size, "batches": {}}
        if os.path.exists(said):
            with open(said) as f:
                done = json.load(f)
        if batch is not None and done["batches"].get(self.query, -1) >= batch:
            return
        with open(self.path, "ab") as log:
            log.truncate(min(done["size"], size))
            if not done["size"]:
                text = io.StringIO(newline="")
                csv.writer(text).writerow(self.header)
                log.write(text.getvalue().encode())
            for message in messages:
                for name in message.names if message else ():
                    with open(f"{self._staging(message.job)}/{name}", "rb") as part:
                        shutil.copyfileobj(part, log)
            log.flush()
            os.fsync(log.fileno())
            done["size"] = log.tell()
        if batch is not None:
            done["batches"][self.query] = batch
        with open(f"{said}.{self.job}", "w") as f:
            json.dump(done, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{said}.{self.job}", said)

    def abort(self, messages: list[Staged | None], batchId: int | None = None) -> None:  # noqa: N803
        for job in {self.job, *(m.job for m in messages if m)}:
            shutil.rmtree(self._staging(job), ignore_errors=True)


class Documents(DataSource):
    """The sink of ``write_documents``."""

    @classmethod
    def name(cls) -> str:
        return DOCUMENTS

    def writer(self, schema, overwrite: bool) -> _DocumentWriter:
        return _DocumentWriter(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> _DocumentWriter:  # noqa: N802
        return _DocumentWriter(self.options["path"])


class Log(DataSource):
    """The sink of ``write_log``."""

    @classmethod
    def name(cls) -> str:
        return LOG

    def writer(self, schema, overwrite: bool) -> _LogWriter:
        return _LogWriter(self.options["path"], schema.names, "")

    def streamWriter(self, schema, overwrite: bool) -> _LogWriter:  # noqa: N802
        return _LogWriter(self.options["path"], schema.names, self.options.get("query", ""))


def register(spark: SparkSession) -> None:
    """Makes both sinks known to a session."""
    for source in (Documents, Log):
        spark.dataSource.register(source)


def documents(triggers: DataFrame) -> DataFrame:
    """(file_name, document): each trigger as JSON, under the name that its instant, zone and id give."""
    us = F.round(F.col("event_timestamp") * 1e6).cast("bigint")
    name = trigger_file_name(us, F.col("timezone"), F.col("trigger_id"))
    return triggers.select(name.alias("file_name"), F.to_json(F.struct(*triggers.columns), {"pretty": "true"}).alias("document"))


def write_documents(triggers: DataFrame, path: str, checkpoint: str | None = None, **trigger) -> StreamingQuery | None:
    """Writes each trigger as a document of its own; a stream's query is returned, which ``trigger`` paces.

    Documents of equal names, which are those of one trigger, replace each other.
    """
    register(triggers.sparkSession)
    rows = documents(triggers)
    if not triggers.isStreaming:
        rows.write.format(DOCUMENTS).mode("append").option("path", path).save()
        return None
    return rows.writeStream.format(DOCUMENTS).outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "0 seconds"}).start()


def write_log(log: DataFrame, path: str, checkpoint: str | None = None, **trigger) -> StreamingQuery | None:
    """Appends lines to the log, which gets its header once; lines of a batch come in the order of its partitions.

    A stream is known by its checkpoint: a batch that the log has isn't added again.
    """
    register(log.sparkSession)
    if not log.isStreaming:
        log.write.format(LOG).mode("append").option("path", path).save()
        return None
    return log.writeStream.format(LOG).outputMode("append").option("path", path).option("query", checkpoint).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "0 seconds"}).start()
