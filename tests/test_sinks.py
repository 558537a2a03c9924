"""Sinks with a commit, the source that handles documents oldest first, and the stored configurations."""

import csv
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from phasegrid.sources import config, documents, store
from phasegrid.sources import triggers as trig

S = 1_000_000


def triggers(spark, n, start=0):
    rows = [(f"{k:08x}ffff", "start", 1_700_000_000.25 + k, "r", "I", "UTC", ["C1"], 1.0, 2.0, 3.0) for k in range(start, start + n)]
    columns = [c for c in trig.TRIGGER.split(", metadata")[0].split(", ")]
    return spark.createDataFrame(rows, ", ".join(columns)).withColumn("metadata", F.lit(None).cast(trig.METADATA))


def names(folder):
    return sorted(f for f in os.listdir(folder) if not f.startswith((".", "_")))


def test_each_trigger_is_a_document(spark, tmp_path):
    folder = str(tmp_path / "out")
    documents.write_documents(triggers(spark, 30).repartition(4), folder)
    assert len(names(folder)) == 30 and names(folder)[0] == "trigger_20231114T221320250000_00000000.json"
    documents.write_documents(triggers(spark, 31).repartition(3), f"file:{folder}")  # a retry makes no second one
    assert len(names(folder)) == 31 and os.listdir(f"{folder}/_staging") == []
    valid, broken = trig.read_triggers(spark, folder)
    assert broken.count() == 0
    assert sorted(valid.select("trigger_id", "event_timestamp", "cameras").collect()) == sorted(triggers(spark, 31).select("trigger_id", "event_timestamp", "cameras").collect())
    with open(f"{folder}/{names(folder)[0]}") as f:
        assert f.read().count("\n") > 3  # readable


def test_a_dying_task_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    bad = triggers(spark, 20).repartition(2).withColumn("reason", F.when(F.col("trigger_id") == f"{17:08x}ffff", F.raise_error(F.lit("died"))).otherwise(F.col("reason")))
    with pytest.raises(Exception, match="died"):
        documents.write_documents(bad, folder)
    assert names(folder) == [] and os.listdir(f"{folder}/_staging") == []


def test_staged_documents_aren_t_seen(tmp_path):
    writer = documents._DocumentWriter(str(tmp_path))
    first = writer.write(iter([{"file_name": "a.json", "document": "{}"}, {"file_name": "b.json", "document": "{}"}]))
    writer.write(iter([{"file_name": "a.json", "document": "half"}]))  # an attempt that was given up
    assert names(tmp_path) == []
    writer.commit([first, None])
    assert names(tmp_path) == ["a.json", "b.json"] and (tmp_path / "a.json").read_text() == "{}"
    with pytest.raises(ValueError, match="no name"):
        writer.write(iter([{"file_name": "../a.json", "document": "{}"}]))


def lines(path):
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.reader(f))


def log_rows(spark, *texts):
    return spark.createDataFrame([(t, "x,\"y\"\nz", None) for t in texts], "Local_Timestamp string, Description string, Det_A string")


def test_the_log_has_one_header(spark, tmp_path):
    path = str(tmp_path / "logs" / "log.csv")
    documents.write_log(log_rows(spark, *"abcdefgh").repartition(3), path)
    documents.write_log(log_rows(spark, "é").coalesce(1), path)
    documents.write_log(log_rows(spark), path)
    found = lines(path)
    assert found[0] == ["Local_Timestamp", "Description", "Det_A"] and found.count(found[0]) == 1
    assert sorted(r[0] for r in found[1:]) == sorted("abcdefghé") and found[-1] == ["é", "x,\"y\"\nz", ""]
    ordered = log_rows(spark, *"zyxwvut").orderBy("Local_Timestamp")
    documents.write_log(ordered, path)
    assert [r[0] for r in lines(path)[-7:]] == list("tuvwxyz")
    with pytest.raises(Exception, match="died"):
        documents.write_log(log_rows(spark, "no").withColumn("Det_A", F.raise_error(F.lit("died"))), path)
    assert len(lines(path)) == 17


def test_a_commit_that_died_is_undone(tmp_path):
    path = str(tmp_path / "log.csv")

    def append(text, batch):
        writer = documents._LogWriter(path, ["h"], "q")
        writer.commit([writer.write(iter([(text,)]))], batch)

    append("one", 0)
    with open(path, "a") as f:
        f.write("half a li")  # the driver died here
    append("two", 1)
    append("two", 1)  # committed, but its stream didn't know
    assert lines(path) == [["h"], ["one"], ["two"]]
    assert not os.listdir(f"{path}._staging")


def test_documents_and_log_of_a_stream(spark, tmp_path):
    for k in range(2):
        triggers(spark, 5, 5 * k).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    source = spark.readStream.schema(triggers(spark, 1).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("part")
    documents.write_documents(source, str(tmp_path / "out"), str(tmp_path / "c1"), availableNow=True).awaitTermination(120)
    assert len(names(tmp_path / "out")) == 10
    documents.write_log(source.select("trigger_id"), str(tmp_path / "log.csv"), str(tmp_path / "c2"), availableNow=True).awaitTermination(120)
    documents.write_log(source.select("trigger_id"), str(tmp_path / "log.csv"), str(tmp_path / "c2"), availableNow=True).awaitTermination(120)
    assert sorted(r[0] for r in lines(tmp_path / "log.csv")) == sorted([*(f"{k:08x}ffff" for k in range(10)), "trigger_id"])


def test_documents_are_handled_oldest_first_and_go(spark, tmp_path):
    folder, order = tmp_path / "hot", [3, 1, 4, 0, 2]
    folder.mkdir()

    def put(k, text=None, age=None):
        path = folder / f"trigger_{9 - k}.json"
        path.write_text(text or json.dumps({"trigger_id": f"T{k}", "action": "start", "event_timestamp": 1.0}, indent=2))
        os.utime(path, (1_600_000_000 + (k if age is None else age),) * 2)

    for k in order:
        put(k)
    put(7, "{ no json", 1)
    (folder / "other.json").write_text("{}")
    seen, batches = [], []

    def handler(valid, quarantine, number):
        batches.append(number)
        seen.extend(r["trigger_id"] for r in valid.collect())
        seen.extend(r["errors"][-1] for r in quarantine.collect())

    def go():
        assert trig.handle_triggers(spark, str(folder), str(tmp_path / "c"), handler, files=2, availableNow=True).awaitTermination(120)

    spark.conf.set("spark.sql.streaming.fileSource.cleaner.numThreads", "0")  # in the query's own thread
    go()
    assert [s for s in seen if s.startswith("T")] == ["T0", "T1", "T2", "T3", "T4"] and sorted(seen)[-1] == "no JSON"
    put(5, age=50)
    go()
    put(6, age=60)
    go()
    assert [s for s in seen if s.startswith("T")][5:] == ["T5", "T6"] and batches == sorted(set(batches))
    assert set(names(folder)) <= {"other.json", "trigger_3.json"}  # the last batch's file stays until the next one


def test_stored_configurations(spark, tmp_path):
    held = store.ConfigStore(spark, str(tmp_path / "configs"))
    assert held.version() == 0 and held.read().count() == 0

    def blobs(*rows):
        return spark.createDataFrame([(i, json.dumps({"v": v}), float(at)) for i, v, at in rows], store.BLOBS)

    def now(version=None):
        return {r["intersection_id"]: (json.loads(r["config_json"])["v"], r["updated_at"]) for r in held.read(version).collect()}

    assert held.upsert(blobs(("A", 1, 10), ("B", 1, 10))) == 1
    assert held.upsert(blobs(("B", 2, 20), ("A", 0, 5), ("C", 1, 1), ("C", 2, 2))) == 2
    assert now() == {"A": (1, 10.0), "B": (2, 20.0), "C": (2, 2.0)} and now(1) == {"A": (1, 10.0), "B": (1, 10.0)}
    assert config.listed_ids(held.read()).count() == 3


def test_readers_see_old_or_new_while_writers_race(spark, tmp_path):
    held = store.ConfigStore(spark, str(tmp_path / "configs"))

    def rows(v, ids="ABCDEFGH"):
        return spark.createDataFrame([(i, str(v), float(v)) for i in ids], store.BLOBS).repartition(4)

    held.upsert(rows(1))
    stop, seen, errors = threading.Event(), [], []

    def reader():
        while not stop.is_set():
            try:
                seen.append({r["config_json"] for r in store.ConfigStore(spark, held.path).read().collect()})
            except Exception as e:  # counted below
                errors.append(repr(e))

    threads = [threading.Thread(target=reader)]
    threads[0].start()
    writers = [threading.Thread(target=lambda v=v: store.ConfigStore(spark, held.path).upsert(rows(v) if v < 4 else rows(v, "Z"))) for v in (2, 3, 4)]
    for t in writers:
        t.start()
    for t in writers:
        t.join(120)
    stop.set()
    threads[0].join(60)
    assert errors == [] and held.version() == 4
    final = {r["intersection_id"]: r["config_json"] for r in held.read().collect()}
    assert final == dict.fromkeys("ABCDEFGH", "3") | {"Z": "4"}  # no update was lost
    assert all(len(s - {"4"}) == 1 for s in seen)  # never a mixture
