"""Zip sinks after task retries, and progress rows that add up."""

import os
import time
import zipfile
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from sitelens.sources import archives
from sitelens.streaming import progress


def test_archives_hold_each_entry_once(spark, tmp_path):
    rows = [(f"p{k % 7}", f"src/f{k}.js", f"text é {k} " * 50) for k in range(300)] + [("p0", "../../etc/x", "up"), ("p1", "same", "b"), ("p1", "same", "a"), ("a/b", "null", None), (None, "lost", "x")]
    files = spark.createDataFrame(rows, "archive string, path string, content string").withColumn("extra", F.lit(1))
    archives.write_zips(files.repartition(9), f"file://{tmp_path}/z")
    assert sorted(p.name for p in Path(f"{tmp_path}/z").iterdir()) == sorted([*(f"p{k}.zip" for k in range(7)), "a_b.zip"])
    got = [(r.archive, r.path, r.content.decode(), r.size) for r in archives.read_zips(spark, f"{tmp_path}/z").collect()]
    want = [(a, p, t, len(t.encode())) for a, p, t in rows[:300]] + [("p0", "etc/x", "up", 2), ("p1", "same", "a", 1), ("a_b", "null", "", 0)]
    assert sorted(got) == sorted(want)
    assert zipfile.ZipFile(f"{tmp_path}/z/p0.zip").testzip() is None
    archives.write_zips(files.filter("false"), f"{tmp_path}/none")
    assert not list(Path(f"{tmp_path}/none").glob("*.zip"))


class Attempts(archives.ZipWriter):
    """Every task's first attempt is run twice over, as if it had been lost after its work."""

    def write(self, iterator):
        rows = list(iterator)
        super().write(iter(rows))
        return super().write(iter(rows))


class AttemptsSource(DataSource):
    @classmethod
    def name(cls):
        return "attempts_zip"

    def writer(self, schema, overwrite):
        os.makedirs(self.options["path"], exist_ok=True)
        return Attempts(self.options["path"], overwrite)


def test_a_repeated_task_leaves_no_second_copy(spark, tmp_path):
    spark.dataSource.register(AttemptsSource)
    files = spark.createDataFrame([(f"p{k % 3}", f"f{k}", str(k)) for k in range(30)], "archive string, path string, content string")
    files.repartition("archive").sortWithinPartitions("archive").write.format("attempts_zip").mode("append").save(f"{tmp_path}/z")
    assert sorted(os.listdir(f"{tmp_path}/z")) == ["p0.zip", "p1.zip", "p2.zip"]
    assert archives.read_zips(spark, f"{tmp_path}/z").count() == 30 == archives.read_zips(spark, f"{tmp_path}/z").select("archive", "path").distinct().count()


def test_barrels(spark):
    parts = spark.createDataFrame([("c", "b.js"), ("c", "a.js"), ("c", "a.js"), ("d", "x.js"), ("d", None)], "chunk string, file string")
    assert {(r.chunk, r.content) for r in archives.barrels(parts).collect()} == {("c", "export * from './a.js';\nexport * from './b.js';\n"), ("d", "export * from './x.js';\n")}


def test_progress_of_a_job_adds_up(spark, tiny, tmp_path):
    job = progress.JobProgress(3)
    docs = job.watch(spark.read.parquet(f"{tiny}/documents.parquet"), "read", F.octet_length("text"))
    kept = job.watch(docs.filter("lang = 'en'"), "filtered")
    job.watch(kept.select(F.explode(F.split("text", " ")).alias("w")), "words").write.format("noop").mode("overwrite").save()
    rows = {r.step: r for r in job.rows(spark).collect()}
    whole = spark.read.parquet(f"{tiny}/documents.parquet")
    assert rows["read"].rows == whole.count() and rows["read"].bytes == whole.agg(F.sum(F.octet_length("text"))).first()[0]
    assert rows["filtered"].rows == whole.filter("lang = 'en'").count() and rows["words"].rows > rows["filtered"].rows
    assert [r.share for r in sorted(rows.values(), key=lambda r: r["at"])] == [1 / 3, 2 / 3, 1.0]


def test_progress_of_a_stream_adds_up(spark, tiny, tmp_path):
    table = spark.read.parquet(f"{tiny}/events.parquet")
    table.repartition(5).write.parquet(f"{tmp_path}/in")
    listener = progress.StreamProgress()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in").observe("progress", F.count(F.lit(1)).alias("rows"))
        query = stream.writeStream.queryName("watched").format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
        until = time.time() + 30
        while not listener.ended and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    rows = [r for r in listener.rows(spark).collect() if r.query == "watched"]
    assert len(rows) >= 3 and sum(r.rows for r in rows) == table.count() == sum(r.observed or 0 for r in rows)
