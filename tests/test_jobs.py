"""Stages that resume, the job queue, and chunked jobs with their progress."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from loomspark.plans import jobs, resume
from loomspark.sinks import writers


class Stop(Exception):
    pass


def test_stopped_run_resumes(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 211).alias("k"), "id").unionByName(spark.sql("select cast(null as bigint) as k, 5L as id")).repartition(3)
    whole = lambda df: df.groupBy("k").agg(F.sum("id").alias("s"))
    made, told = [], []

    def make(df):
        made.append(1)
        if len(made) == 5:
            raise Stop
        return whole(df)

    at = str(tmp_path / "job")
    with pytest.raises(Stop):
        resume.by_ranges(rows, "k", at, make, 8)
    # what a task left of an unfinished range does not count
    spark.createDataFrame([(1, 10**9)], "k long, s long").write.mode("overwrite").parquet(f"{at}/table/{resume.RANGE}=6")
    assert resume.finished_table(spark, at).where("s = 1000000000").count() == 0
    got = resume.by_ranges(rows, "k", at, make, 8, lambda n, of: told.append((n, of)))
    assert len(made) == 9 and told == [(5, 8), (6, 8), (7, 8), (8, 8)]
    want = whole(rows)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == got.select("k").distinct().count() == 212
    assert resume.by_ranges(rows, "k", at, make, 8).count() == 212 and len(made) == 9  # nothing is made again
    with pytest.raises(ValueError, match="holds a run"):
        resume.by_ranges(rows, "k", at, make, 9)
    assert resume.by_ranges(rows.limit(0), "k", str(tmp_path / "none"), whole, 3).count() == 0


def test_one_job_at_a_time_in_order(spark, tmp_path):
    queue = jobs.Queue(spark, str(tmp_path / "q"), expires=20, poll=0.05)
    log, running, order, most = str(tmp_path / "log"), [0], [], [0]

    def work(name):
        def run():
            running[0] += 1
            most[0] = max(most[0], running[0])
            time.sleep(0.3)
            order.append(name)
            running[0] -= 1
            return name

        return run

    first = queue.take(queue.enter())
    threads = []
    for name in ("a", "b", "c"):
        threads.append(threading.Thread(target=queue.run, args=(name, work(name), log)))
        threads[-1].start()
        while len(queue.waiting()) < len(threads):
            time.sleep(0.05)
    with pytest.raises(TimeoutError):
        queue.take(queue.enter(), timeout=0.3)
    queue.leave(first)
    for t in threads:
        t.join(120)
    assert order == ["a", "b", "c"] and most == [1] and not queue.waiting()
    assert writers.job(spark, log, "b").first().fields["status"] == "completed"
    with pytest.raises(ZeroDivisionError):
        queue.run("bad", lambda: 1 / 0, log)
    fields = writers.job(spark, log, "bad").first().fields
    assert fields["status"] == "failed" and "division" in fields["error_message"]
    assert queue.run("after", work("after"), log) == "after"


def test_expired_lease_is_taken_over(spark, tmp_path):
    queue = jobs.Queue(spark, str(tmp_path / "q"), expires=1.0, poll=0.05)
    dead = queue.enter()  # a caller that died while it waited
    old = queue.take(dead)
    queue.enter()
    began = time.time()
    new = queue.take(queue.enter())
    assert new == old + 1 and time.time() - began > 0.5
    with pytest.raises(jobs.Lost):
        queue.renew(old)
    queue.leave(old)  # changes nothing
    queue.renew(new)
    assert sum(queue.files.create("lease-77") for _ in range(3)) == 1


def test_cancel(spark, tmp_path):
    queue, log = jobs.Queue(spark, str(tmp_path / "q"), poll=0.05), str(tmp_path / "log")
    slow = lambda: spark.range(10**12).selectExpr("sum(id * 7 % 5)").collect()
    seen = []

    def run():
        try:
            queue.run("slow", slow, log)
        except Exception as e:
            seen.append(e)

    t = threading.Thread(target=run)
    t.start()
    while not spark.sparkContext.statusTracker().getActiveJobsIds():
        time.sleep(0.1)
    time.sleep(1)
    queue.cancel("slow", log)
    t.join(60)
    assert not t.is_alive() and seen and writers.job(spark, log, "slow").first().fields["status"] == "cancelled"


def test_chunks_report_progress(spark, tmp_path, monkeypatch):
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    log, out, seen = str(tmp_path / "log"), str(tmp_path / "out"), []
    real = jobs.report
    monkeypatch.setattr(jobs, "report", lambda *a: (seen.append(a[3]), real(*a)))

    def write(df, number):
        if number == 2 and not seen.count("go"):
            raise Stop("stopped")
        time.sleep(0.3)
        df.write.mode("overwrite").parquet(f"{out}/chunk={number}")

    with pytest.raises(RuntimeError, match="stopped"):
        jobs.chunked(spark, source(), write, str(tmp_path / "cp"), log, "j", 40)
    assert writers.job(spark, log, "j").first().fields["processed"] == "20"
    at = jobs.progress(spark, log, "j") | {}
    assert at["progress"] == "20 de 40 comentarios procesados (50%)"
    seen.append("go")
    assert jobs.chunked(spark, source(), write, str(tmp_path / "cp"), log, "j", 40) == 20
    numbers = [s for s in seen if s != "go"]
    assert numbers == sorted(numbers) and numbers[-1] == 40
    assert writers.job(spark, log, "j").first().fields["progress"] == "40 de 40 comentarios procesados (100%)"
    assert spark.read.parquet(out).select("id").distinct().count() == spark.read.parquet(out).count() == 40


def test_time_left_in_words(spark, tmp_path):
    log = str(tmp_path / "log")
    writers.update_job(spark, log, "run", status="processing", total=1000, processed=400, seconds_each="0.5")
    writers.update_job(spark, log, "wait", status="pending")
    assert jobs.progress(spark, log, "run")["estimated_remaining_time_formatted"] == "~5.0 minutos"
    assert jobs.progress(spark, log, "wait", "run")["progress"] == "En cola de espera... (Tiempo estimado para iniciar: ~5.0 minutos)"
    writers.update_job(spark, log, "new", status="processing", total=10, processed=0)
    assert jobs.progress(spark, log, "new")["estimated_remaining_seconds"] == "3.00"
    with pytest.raises(KeyError):
        jobs.progress(spark, log, "no")
