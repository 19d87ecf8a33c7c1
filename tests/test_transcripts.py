"""Scores, chat and report against literal cases and folds over random transcripts."""

import random

import pytest

from colloquy.operators import parsing, report, scores, transcript

MESSAGES = "session_id long, seq long, role string, content string"
R, N, SK = parsing.READY, parsing.SATISFIED, parsing.SKIPPED


def Q(x):
    return f"---NEXT QUESTION---\n{x}\n---END QUESTION---"


def S(n):
    return f"---FEEDBACK---\n**Score:** {n}/10\n---END FEEDBACK---"


def inner(n):
    return f"**Score:** {n}/10"


def log(spark, sessions):
    """Sessions of alternating user and assistant texts, or (role, text) pairs; rows are shuffled."""
    rows = []
    for s, texts in sessions.items():
        for i, t in enumerate(texts):
            role, text = t if isinstance(t, tuple) else (("user", "assistant")[i % 2], t)
            rows.append((s, i, role, text))
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, MESSAGES)


def lists(spark, sessions):
    got = {s: {} for s in sessions}
    for r in scores.score_list(log(spark, sessions)).collect():
        got[r.session_id][r.ordinal] = r.score
    return {s: [d[i] for i in sorted(d)] for s, d in got.items()}


def test_score_fold(spark):
    cases = {
        1: ([R, Q("a"), "x", S(5), "y", S(8), N, Q("b"), "z", S(9)], [8, 9]),
        2: ([R, Q("a"), "x", S(6), "y", S(4)], [6]),
        3: ([R, Q("a"), "x", "none", "y", S(7)], []),
        4: ([R, Q("a"), "x", S(6), N, Q("b"), "y", "none", "z", S(9)], [9]),
        5: ([R, Q("a"), "x", S(6), SK, Q("b"), SK, Q("c"), "y", S(8)], [6, 8]),
    }
    assert lists(spark, {k: v[0] for k, v in cases.items()}) == {k: v[1] for k, v in cases.items()}


def naive_fold(messages):
    """An attempt is a submission; its reply is the next row if an assistant wrote it."""
    out, attempt, pending = [], 0, False
    for role, text in messages:
        if role == "user":
            pending = text not in (R, N, SK)
            attempt = 0 if text in (N, SK) else attempt + pending
        elif role == "assistant":
            if pending and "**Score:** " in text:
                mark = int(text.split("**Score:** ")[1].split("/10")[0])
                if attempt == 1:
                    out.append(mark)
                elif out:
                    out[-1] = max(out[-1], mark)
            pending = False
    return out


def naive_report(messages):
    """One pass with a question and its attempts in hand."""
    def feedback(t):
        if "---FEEDBACK---" in t and "---END FEEDBACK---" in t.split("---FEEDBACK---", 1)[1]:
            return t.split("---FEEDBACK---", 1)[1].split("---END FEEDBACK---", 1)[0].strip()
        while "---NEXT QUESTION---" in t and "---END QUESTION---" in t.split("---NEXT QUESTION---", 1)[1]:
            head, tail = t.split("---NEXT QUESTION---", 1)
            t = head + tail.split("---END QUESTION---", 1)[1]
        return t.strip()

    def asked(t):
        return t.split("---NEXT QUESTION---", 1)[1].split("---END QUESTION---", 1)[0].strip() if "---NEXT QUESTION---" in t and "---END QUESTION---" in t.split("---NEXT QUESTION---", 1)[1] else ""

    done, question, tries = [], "", []
    for role, text in messages:
        if role == "user" and text not in parsing.REPORT_INTERNAL:
            tries.append([text, ""])
        elif role == "assistant":
            told, following = feedback(text), asked(text)
            if told == "":
                if question == "":
                    question, tries = following or text, []
            else:
                if tries:
                    tries[-1][1] = told
                if following:
                    done.append((question, tries))
                    question, tries = following, []
    return done + ([(question, tries)] if question else [])


def flat(blocks, marks):
    out = []
    for i, (question, tries) in enumerate(blocks, 1):
        mark = marks[i - 1] if i <= len(marks) else None
        out += [(i, question, mark, j, a, f) for j, (a, f) in enumerate(tries, 1)] or [(i, question, mark, None, None, None)]
    return out


def rows_of(frame):
    got = {}
    for r in frame.collect():
        got.setdefault(r.session_id, []).append((r.number, r.question, r.score, r.attempt, r.answer, r.feedback))
    return {s: sorted(v, key=lambda r: (r[0], r[3] or 0)) for s, v in got.items()}


LITERAL = {
    1: ([R, Q("q1"), "A1", S(5), "A1b", S(8), N, Q("q2"), "A2", S(9)], [("q1", 8, [("A1", inner(5)), ("A1b", inner(8)), ("A2", inner(9))])], [("q1", 8, ["A1", "A1b"]), ("q2", 9, ["A2"])]),
    2: ([R, "Welcome!\n" + Q("q1"), "A1", S(5)], [("", 5, []), ("q1", None, [("A1", inner(5))])], [("q1", 5, ["A1"])]),
    3: ([R, Q("q1"), "A1", S(6), N, "Sure.\n" + Q("q2"), "A2", S(7)], [("q1", 6, [("A1", "Sure.")]), ("q2", 7, [("A2", inner(7))])], [("q1", 6, ["A1"]), ("q2", 7, ["A2"])]),
    4: ([R, Q("q1"), SK, Q("q2"), "A2", S(9)], [("q1", 9, [(SK, ""), ("A2", inner(9))])], [("q1", None, []), ("q2", 9, ["A2"])]),
    5: ([R, "plain q", "A1", S(5), N, Q("q2"), "A2", S(6)], [("q2", 5, [("A2", inner(6))])], [("plain q", 5, ["A1"]), ("q2", 6, ["A2"])]),
}


def test_report_blocks_of_literal_sessions(spark):
    messages = log(spark, {k: v[0] for k, v in LITERAL.items()} | {6: []})
    got, repaired = rows_of(transcript.report_blocks(messages)), rows_of(transcript.repaired_blocks(messages))
    for k, (_, blocks, better) in LITERAL.items():
        want = [(i, q, s, j if a else None, *(a or (None, None))) for i, (q, s, tries) in enumerate(blocks, 1) for j, a in enumerate(tries or [None], 1)]
        assert got[k] == want
        assert [(r[0], r[1], r[2], r[4]) for r in repaired[k]] == [(i, q, s, a) for i, (q, s, tries) in enumerate(better, 1) for a in tries or [None]]
    assert 6 not in got
    assert [r[5] for r in repaired[3]] == [inner(6), inner(7)]


@pytest.mark.parametrize("seed", range(3))
def test_folds_over_random_transcripts(spark, seed):
    rng = random.Random(seed)
    parts = [R, N, SK, "answer", "other answer", ""]
    said = [Q("q"), Q(""), S(3), S(9), "plain", "", "Hi " + Q("r"), S(7) + Q("s"), "---FEEDBACK------END FEEDBACK---", "---FEEDBACK---\nopen"]
    sessions = {s: [(role, rng.choice(said if role == "assistant" else parts)) for role in rng.choices(["user", "assistant", "system"], [5, 5, 1], k=rng.randrange(1, 14))] for s in range(120)}
    messages = log(spark, sessions)
    fold = {s: naive_fold(m) for s, m in sessions.items()}
    assert lists(spark, sessions) == fold
    want = {s: flat(naive_report(m), fold[s]) for s, m in sessions.items()}
    assert rows_of(transcript.report_blocks(messages)) == {s: w for s, w in want.items() if w}


def test_chat(spark):
    messages = log(spark, {1: LITERAL[1][0], 2: LITERAL[2][0], 5: LITERAL[5][0], 7: [R, Q("q1"), "A", S(5) + Q("q2")]})
    shown = lambda frame, s: [(r.kind, r.number, r.text) for r in sorted(frame.collect(), key=lambda r: (r.seq, r.part)) if r.session_id == s]
    got = transcript.chat(messages)
    assert [x[:2] for x in shown(got, 1) if x[0] == "question"] == [("question", 1), ("question", 2)]
    assert shown(got, 2) == [("question", 1, "q1"), ("user", None, "A1"), ("feedback", None, inner(5))]
    assert [x for x in shown(got, 5) if x[0] == "question"] == [("question", 1, "plain q"), ("question", 2, "q2")]
    held = transcript.chat(messages, spark.createDataFrame([(7,)], "session_id long"))
    assert shown(got, 7)[-1] == ("question", 2, "q2") and shown(held, 7)[-1] == ("feedback", None, inner(5))


def test_summary(spark):
    sessions = {1: [R, Q("a"), "x", S(8), N, Q("b"), "y", S(9)], 2: [R, Q("a")], 3: [R, Q("a"), *[t for n in (6, 6, 6, 7) for t in ("x", S(n), N, Q("b"))]]}
    got = {r.session_id: (r.avg_shown, r.best, r.worst, r.n_scores, r.tier) for r in scores.summary(log(spark, sessions)).collect()}
    assert got == {1: ("8.5", 9, 8, 2, 1), 2: ("0.0", 0, 0, 0, 4), 3: ("6.2", 7, 6, 4, 2)}
    last = {r.session_id: r.score for r in scores.latest(log(spark, {**sessions, 4: [R, S(3), "x", "none"]})).collect()}
    assert last == {1: 9, 2: None, 3: None, 4: None}


def test_report_escapes_and_orders(spark):
    from pyspark.sql import functions as F

    messages = log(spark, {1: LITERAL[1][0], 2: [R]})
    sessions = spark.createDataFrame([(s, "<b>", "T", "Easy", "Zero-Shot", "jd & more", "") for s in (1, 2)], "session_id long, role string, interview_type string, difficulty string, technique string, jd_summary string, gap_analysis string")
    got = {r.session_id: r for r in report.build(messages, sessions, F.lit("2026-01-05 10:00:00").cast("timestamp")).collect()}
    assert got[1].file_name == "interview_report_20260105_1000.html" and "<b>" not in got[1].html and "&lt;b&gt;" in got[1].html
    assert got[1].html.index("A1b") < got[1].html.index("A2<") and "Attempt 3" in got[1].html and "jd &amp; more" in got[1].html
    assert "No question data available." in got[2].html
    nested = {r.session_id: r.questions for r in transcript.nested(messages).collect()}
    assert [len(q.attempts) for q in nested[1]] == [3]
