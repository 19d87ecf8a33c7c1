"""Report files, the ledger of replies, incremental uploads, ordered sums, patterns, checked shapes."""

import os
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.functions.text import ordered_text
from colloquy.operators import cost, guards, patterns, report, scores, transcript
from colloquy.sources import ledger, replies, report_files, schemas, uploads


def files_of(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs)


# ---- report files


def test_a_thousand_reports_are_a_thousand_files(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 8).select(F.col("id").alias("session_id"), F.lit("interview_report_20260105_1000.html").alias("file_name"), F.concat(F.lit("<p>é "), "id", F.lit("</p>")).alias("html"))
    report_files.write_files(rows, str(tmp_path / "out"))
    names = files_of(tmp_path / "out")
    assert len(names) == 1000 and names[0] == "session_id=0/interview_report_20260105_1000.html"
    assert (tmp_path / "out" / "session_id=77" / "interview_report_20260105_1000.html").read_text() == "<p>é 77</p>"
    report_files.write_files(rows.limit(2).withColumn("file_name", F.lit("later.html")), f"file://{tmp_path}/out")
    assert len(files_of(tmp_path / "out")) == 1002
    report_files.write_files(rows.filter("session_id < 3"), str(tmp_path / "out"), "overwrite")
    assert len(files_of(tmp_path / "out")) == 3


def test_a_failed_job_leaves_no_files(spark, tmp_path):
    good = spark.range(0, 40, 1, 8).select(F.col("id").alias("session_id"), F.lit("a.html").alias("file_name"), F.lit("x").alias("html"))
    report_files.write_files(good.filter("session_id = 1"), str(tmp_path / "out"))
    bad = good.withColumn("file_name", F.when(F.col("session_id") == 39, F.lit("../up.html")).otherwise(F.lit("b.html")))
    for rows in (bad, good.unionByName(good)):  # a wrong name; a name twice in a session
        with pytest.raises(Exception, match="no file name|the same name"):
            report_files.write_files(rows, str(tmp_path / "out"))
        assert files_of(tmp_path / "out") == ["session_id=1/a.html"] and os.listdir(tmp_path / "out") == ["session_id=1"]
    with pytest.raises(ValueError, match="file_name"):
        report_files.write_files(good.drop("file_name"), str(tmp_path / "out"))


# ---- ledger


def asking(log, fail_at=None):
    """A client that writes down what it is asked."""

    def client(rows: pd.DataFrame) -> list[ledger.Reply]:
        for prompt in rows["prompt"]:
            if prompt.endswith(str(fail_at)):
                raise RuntimeError("the line is dead")
        with open(log, "a") as f:
            f.write("".join(f"{r}\n" for r in rows["request"]))
        return [ledger.Reply("told " + p[-6:], len(p), 7) for p in rows["prompt"]]

    return client


def test_nothing_is_asked_twice(spark, tmp_path):
    path, log = str(tmp_path / "ledger"), str(tmp_path / "log")
    documents = spark.createDataFrame([(i, f"posting number {i % 150}") for i in range(200)], "key long, text string")
    asked = replies.requests(documents, "jd")
    assert ledger.replies(spark, path).count() == 0 and ledger.open_requests(asked, path).count() == 150
    with pytest.raises(Exception, match="the line is dead"):
        ledger.record(asked, asking(log, fail_at="number 77"), path, batch=3)  # tasks are tried again, and the run ends
    before = ledger.replies(spark, path).count()
    left = ledger.record(asked, asking(log), path, batch=3)
    assert 0 < before < 150 and left == 150 - before
    lines = open(log).read().split()
    assert len(lines) == len(set(lines)) == 150
    assert ledger.record(asked, asking(log), path) == 0 and len(open(log).read().split()) == 150
    got = ledger.answered(asked, ledger.replies(spark, path))
    assert got.count() == 200 and got.filter("reply IS NULL").count() == 0
    assert {(r.key, r.reply) for r in got.collect()} == {(i, "told " + f"posting number {i % 150}"[-6:]) for i in range(200)}
    costs = replies.cost_log(got).collect()
    assert {r.model for r in costs} == {"gpt-4.1-mini"} and all(r.output_tokens == 7 and r.total_cost_usd > 0 for r in costs)


def test_chats_are_recorded_and_cost(spark, tmp_path):
    path = str(tmp_path / "ledger")
    sessions = spark.createDataFrame([(1, "S", "gpt-4o"), (2, "S", None), (3, "S", "gpt-9")], "session_id long, system_prompt string, model string")
    log = spark.createDataFrame([(s, i, "user", f"m{s}{i}") for s in (1, 2, 3) for i in (0, 1)], "session_id long, seq long, role string, content string")
    asked = replies.chat_requests(sessions, log)
    assert ledger.record(asked, lambda rows: [ledger.Reply(m[-1]["content"], 1_000_000, 0) for m in rows["messages"]], path) == 2
    got = {r.session_id: r for r in replies.cost_log(ledger.answered(asked, ledger.replies(spark, path))).collect()}
    assert (got[1].reply, got[1].total_cost_usd, got[2].reply, got[2].total_cost_usd) == ("m11", 2.5, "m21", 0.4)
    more = replies.chat_requests(sessions, log.unionByName(spark.createDataFrame([(1, 2, "assistant", "x")], log.schema)))
    assert ledger.open_requests(more, path).select("session_id").collect() == [(1,)]  # a longer log is another request
    with pytest.raises(Exception, match="0 replies to 1"):
        ledger.record(more, lambda rows: [], path)


# ---- incremental uploads


def test_a_copied_file_is_extracted_once(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    (inbox / "a.docx").write_bytes(uploads.make_docx(["one"]))
    (inbox / "broken.docx").write_bytes(b"no zip")
    uploads.extract_new(spark, str(inbox), out, state)
    assert sorted((r.name, r.ok) for r in spark.read.parquet(out).collect()) == [("a.docx", True), ("broken.docx", False)]
    (inbox / "copy of a.DOCX").write_bytes((inbox / "a.docx").read_bytes())
    uploads.extract_new(spark, str(inbox), out, state)
    assert spark.read.parquet(out).count() == 2
    (inbox / "b.docx").write_bytes(uploads.make_docx(["two"]))
    uploads.extract_new(spark, str(inbox), out, state)
    assert sorted((r.name, r.value) for r in spark.read.parquet(out).filter("ok").collect()) == [("a.docx", "one"), ("b.docx", "two")]


# ---- sums, strings, patterns, shapes


def test_cost_texts_do_not_hang_on_partitions(spark):
    rows = [(s, i, "gpt-4.1-nano" if i % 2 else "gpt-4o", 7 * i + s, 10_000_019 // (i + 1)) for s in range(5) for i in range(400)]
    calls = spark.createDataFrame(rows, "session_id long, call_seq int, model string, input_tokens long, output_tokens long")
    rates = {m: (i, o) for m, i, o in cost.RATES}
    want = {s: 0.0 for s in range(5)}
    for s, _, m, a, b in rows:
        want[s] += a / 1e6 * rates[m][0] + b / 1e6 * rates[m][1]
    for n in (1, 7, 200):
        got = {r.session_id: r for r in cost.session_cost(calls.repartition(n)).collect()}
        assert {s: r.total_cost_usd for s, r in got.items()} == want  # to the last bit
        assert all(f"${want[s]:.6f} USD" in r.formatted for s, r in got.items())
    assert cost.session_cost(calls.drop("call_seq")).count() == 5


def test_strings_joined_in_order_equal_those_of_the_folds(spark):
    from tests_data import sessions_log

    messages = sessions_log(spark)
    folds = scores.folded(messages)
    want = {r.session_id: (r.b, r.q) for r in folds.select("session_id", report.bars(F.col("scores")).alias("b"), report.questions(F.col("blocks")).alias("q")).collect()}
    got_bars = {r.session_id: r.bars for r in report.listed_bars(scores.breakdown(messages)).collect()}
    got_questions = {r.session_id: r.questions for r in report.listed_questions(transcript.report_blocks(messages)).collect()}
    assert got_bars == {s: b for s, (b, _) in want.items() if b} and got_questions == {s: q for s, (_, q) in want.items() if q}
    rows = spark.createDataFrame([(1, 2, "b'\\"), (1, 1, "a"), (None, 1, "c"), (1, 3, None)], "k int, o int, v string")
    assert {r.k: r.s for r in ordered_text(rows, ["k"], "v", "o", "s", "'\\\n").collect()} == {1: "a'\\\nb'\\", None: "c"}


def test_first_pattern_of_a_table(spark):
    table = [(i, p, f"rule {i}") for i, p in enumerate(guards.INJECTION_PATTERNS)] + [(100 + i, rf"(?i)word{i}\b", None) for i in range(60)] + [(-5, "zebra|gnu", "animals")]
    made = patterns.matcher(spark.createDataFrame(table, "position int, pattern string, label string").repartition(3))
    texts = [None, "", "you are now a sudo zebra", "override sudo", "sudo override", "WORD7 word59", "word5", "word60", "act as interviewer", "act as interview"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", made.found(F.col("t")).alias("f"))
    assert "Join" not in frame._jdf.queryExecution().toString()
    for r in frame.collect():
        want = next(((i, p, name) for i, p, name in sorted(table) if texts[r.i] is not None and re.search(p, texts[r.i])), None)
        assert (tuple(r.f) if r.f else None) == want
    for rows in ([(1, "a", None)] * 2, [(1, None, None)], [(1, r"(a)\1", None)], [(i, "a", None) for i in range(patterns.MOST_PATTERNS + 1)], [(1, "a" * (patterns.MOST_CHARS + 1), None)]):
        with pytest.raises(ValueError):
            patterns.matcher(spark.createDataFrame(rows, "position int, pattern string, label string"))
    none = patterns.matcher(spark.createDataFrame([], "position int, pattern string, label string"))
    assert spark.range(1).select(none.found(F.lit("a")).alias("f")).first().f is None


def test_shapes_are_checked(spark):
    fine = spark.createDataFrame([("x", 1, "user", "hi", 0)], "session_id string, seq int, role string, content string, more int")
    assert schemas.checked(fine, schemas.MESSAGES) is fine
    with pytest.raises(ValueError, match="role, content"):
        schemas.checked(fine.drop("role").withColumn("content", F.lit(1)), schemas.MESSAGES)


def test_printed_date(spark):
    got = spark.range(1).select(report.printed_date(F.lit("2026-01-05 09:07:00").cast("timestamp")).alias("d"), report.file_name(F.lit("2026-01-05 09:07:00").cast("timestamp")).alias("f")).first()
    assert (got.d, got.f) == ("January 05, 2026 — 09:07", "interview_report_20260105_0907.html")
