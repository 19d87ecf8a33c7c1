"""Queries over event logs, prompts, replies, uploads and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ordered_text
from ..operators import cost, events, guards, patterns, prompts, report, scores, transcript
from ..sources import ledger, replies, sessions, transcripts, uploads
from .registry import _ATTEMPTS, _BAR, _BLOCKS, _INJECTED, _LENGTH, _NQ, _POOR, _SCORE, _S, _SESSIONS, _TECHNIQUES, _ANSWERS, _answers, _marked, _pick, _q, _query, _strip, _table, _without

#: Literal logs, a letter an event: T start, digits and x submissions by their score (x: none, a: 10), n next, s skip, i improve, r reset, b an answer that is refused.
_LOGS = ["T5n", "T3i8n7i9n", "Tx4nni2", "TaiTn", "b5", "T5s6s7s8s", "sss", "Tsssss", "T5n6n7n8n", "T5n6n7n8in", "T5rT6", "T2n3rrn", "Tb5bni", "T8i3i9ix", "T4s", "TsiT7n"]
_LETTERS = {"T": "start", "n": "next", "s": "skip", "i": "improve", "r": "reset"}
_LOG_ROWS = [
    (-1 - i, j, _LETTERS.get(e, "submit"), "Cook" if e == "T" else "x" if e == "b" else "a fine answer to it", "no score" if e in "Txb" else f"**Score:** {10 if e == 'a' else e}/10" if e in "0123456789a" else "---FEEDBACK---\n**Score:** 1/10\n---END FEEDBACK---", 3 if e == "T" else None)
    for i, log in enumerate(_LOGS)
    for j, e in enumerate(log)
]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.createDataFrame(_LOG_ROWS, "session_id long, seq long, event string, text string, reply string, total_questions int")
    return transcripts.ui_events_of(_table(spark, sf_dir, "conversations")).unionByName(edges)


def _lit(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else _q(x)


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in rows)


def _states_sql() -> str:
    """The state machine as a recursion over the events of each session in order."""
    answers = ["submit"] * 8 + ["skip", "skip", "improve", "next"]
    moves = ["next"] * 5 + ["improve", "improve", "submit", "submit", "skip", "start", "reset"]
    names = lambda x: "[" + ", ".join(map(_q, x)) + "]"
    begin = "false AS started, false AS done, 1 AS question_count, 4 AS total_questions, 0 AS attempt, false AS awaiting, false AS final, NULL::INTEGER AS last_score, []::INTEGER[] AS scores, 0 AS n_messages"
    gone = "e.event = 'reset'"
    keeps = lambda new, first: f"CASE WHEN {gone} THEN {first} ELSE {new} END"
    return f"""WITH RECURSIVE c0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, (conv_id * 5 + turn * 3) % 12 + 1 AS pick FROM conversations WHERE role <> 'system'),
c1 AS (SELECT *, CASE WHEN k = 1 THEN 'start' WHEN role = 'user' THEN {names(answers)}[pick] ELSE {names(moves)}[pick] END AS event FROM c0),
log AS (SELECT conv_id AS session_id, turn AS seq, event, CASE WHEN event = 'start' THEN CASE WHEN conv_id % 9 = 0 THEN ' ' ELSE 'Engineer' END WHEN (conv_id + turn) % 8 = 0 THEN 'a' ELSE text END AS text,
  CASE WHEN event <> 'start' THEN '---FEEDBACK---' || chr(10) || CASE WHEN (conv_id + turn) % 6 <> 0 THEN '**Score:** ' || ((conv_id * 7 + turn * 3) % 11) || '/10' ELSE 'no score' END || chr(10) || '---END FEEDBACK---' || chr(10) ELSE '' END || '---NEXT QUESTION---' || chr(10) || text || chr(10) || '---END QUESTION---' AS content,
  CASE WHEN event = 'start' THEN 1 + conv_id % 4 END AS total FROM c1 UNION ALL SELECT * FROM (VALUES {_rows(_LOG_ROWS)}) v(session_id, seq, event, text, content, total)),
cut AS (SELECT session_id, seq, event, text, total, CASE WHEN event = 'submit' THEN {_without('content', *_NQ)} WHEN event IN ('next', 'skip') THEN {_without('content', 'FEEDBACK', 'END FEEDBACK')} ELSE content END AS content FROM log),
ev AS MATERIALIZED (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS i, event, total, {_SCORE.format('content')} AS score,
  CASE WHEN event = 'start' THEN {_S} = '' WHEN event = 'submit' THEN coalesce({_LENGTH}, {_INJECTED}, {_POOR}) IS NOT NULL ELSE false END AS refused FROM cut),
f AS (SELECT DISTINCT session_id, 0::BIGINT AS i, {begin} FROM ev UNION ALL
SELECT session_id, i, {keeps("started OR starts", "false")}, {keeps("done OR ends", "false")},
  {keeps("CASE WHEN starts THEN 1 WHEN moves AND event = 'next' THEN least(question_count + 1, total_questions) WHEN moves THEN question_count + 1 ELSE question_count END", "1")}::INTEGER,
  {keeps("CASE WHEN starts THEN total ELSE total_questions END", "4")}::INTEGER, {keeps("CASE WHEN starts OR moves THEN 0 WHEN submits THEN attempt + 1 ELSE attempt END", "0")}::INTEGER,
  {keeps("CASE WHEN submits THEN true WHEN ends OR moves OR improves THEN false ELSE awaiting END", "false")}, {keeps("CASE WHEN submits THEN question_count = total_questions WHEN moves OR improves THEN false ELSE final END", "false")},
  {keeps("CASE WHEN starts OR submits OR moves THEN score ELSE last_score END", "NULL")}::INTEGER,
  {keeps("CASE WHEN NOT submits OR score IS NULL THEN scores WHEN attempt = 0 THEN list_append(scores, score) WHEN len(scores) > 0 THEN list_append(scores[1:len(scores) - 1], greatest(scores[len(scores)], score)) ELSE scores END", "[]::INTEGER[]")},
  {keeps("n_messages + CASE WHEN starts OR submits OR moves THEN 2 ELSE 0 END", "0")}::INTEGER
FROM (SELECT *, wants AND NOT ends AS moves FROM (SELECT *, wants AND (CASE WHEN event = 'next' THEN final ELSE question_count >= total_questions END) AS ends FROM (
  SELECT f.*  EXCLUDE (i), e.i, e.event, e.total, e.score, e.event = 'start' AND NOT started AND NOT refused AS starts, started AND NOT done AND e.event = 'submit' AND NOT awaiting AND NOT refused AS submits,
    started AND NOT done AND e.event = 'improve' AND awaiting AND coalesce(last_score < 10, true) AS improves,
    started AND NOT done AND CASE e.event WHEN 'next' THEN awaiting WHEN 'skip' THEN NOT (awaiting AND final) ELSE false END AS wants
  FROM f JOIN ev e ON e.session_id = f.session_id AND e.i = f.i + 1))) e)
SELECT session_id, started, done, question_count, total_questions, attempt, awaiting AS awaiting_decision, final AS is_final_answer, last_score, array_to_string(scores, ',') AS scores, n_messages FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY i DESC) AS r FROM f) WHERE r = 1"""


@_query(_states_sql())
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.final_states(_events(spark, sf_dir)).withColumn("scores", F.array_join(F.col("scores").cast("array<string>"), ","))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations")


# ---- lookups, settings, sections


@_query(f"WITH {_SESSIONS}, {_TECHNIQUES} SELECT session_id, technique, technique_key, explanation FROM sessions JOIN techniques USING (technique)")
def technique_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.techniques_of(transcripts.sessions_of(_conversations(spark, sf_dir))).select("session_id", "technique", "technique_key", "explanation")


_KNOWN = {name: ", ".join(map(_q, labels)) for name, labels in sessions.LABELS.items()}
_PERSONAS = ("technique = 'Persona-Based'", "coalesce(p, 'Neutral 😐')", "'Neutral 😐'")


@_query(f"""WITH g AS (SELECT DISTINCT conv_id AS c FROM conversations),
given AS (SELECT c AS session_id, coalesce({_pick((None, "Zero-Shot", "Persona-Based", "Ten-Shot"), "c")}, 'Zero-Shot') AS technique, {_pick((None, "Strict 😤", "nobody"), "c")} AS p, coalesce({_pick((*transcripts.MODELS, None), "c")}, 'gpt-4.1-mini') AS model,
  CASE WHEN c % 4 <> 0 THEN (c % 25) / 10.0::DOUBLE ELSE 0.4::DOUBLE END AS temperature, CASE WHEN c % 3 <> 0 THEN (c % 12) / 10.0::DOUBLE ELSE 0.9::DOUBLE END AS top_p, CASE WHEN c % 5 <> 0 THEN 100 + c % 16 * 100 ELSE 700 END AS max_tokens, CASE WHEN c % 6 <> 0 THEN c % 13 ELSE 4 END AS total_questions FROM g),
filled AS (SELECT *, CASE WHEN {_PERSONAS[0]} THEN {_PERSONAS[1]} ELSE {_PERSONAS[2]} END AS persona_key FROM given)
SELECT session_id, technique, persona_key, model, temperature, top_p, max_tokens, total_questions, 'Behavioral' AS interview_type, 0.3::DOUBLE AS frequency_penalty, concat_ws(',', CASE WHEN technique NOT IN ({_KNOWN["technique"]}) THEN 'technique' END, CASE WHEN persona_key NOT IN ({_KNOWN["persona_key"]}) THEN 'persona_key' END,
  CASE WHEN model NOT IN ({_KNOWN["model"]}) THEN 'model' END, CASE WHEN total_questions NOT BETWEEN 1 AND 10 THEN 'total_questions' END, CASE WHEN temperature > 2 THEN 'temperature' END, CASE WHEN top_p NOT BETWEEN 0.1 AND 1 THEN 'top_p' END, CASE WHEN max_tokens NOT BETWEEN 200 AND 1500 THEN 'max_tokens' END) AS wrong FROM filled""")
def session_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.with_settings(transcripts.settings_of(_conversations(spark, sf_dir)))
    shown = ("session_id", "technique", "persona_key", "model", "temperature", "top_p", "max_tokens", "total_questions", "interview_type", "frequency_penalty")
    return rows.select(*shown, F.array_join(sessions.wrong_settings(), ",").alias("wrong"))


@_query(f"""WITH {_SESSIONS} SELECT session_id, false AS interview_started, false AS interview_done, 1 AS question_count, CASE WHEN session_id % 6 <> 0 THEN session_id % 13 ELSE 4 END AS total_questions, 0 AS attempt, 0 AS n_messages, 0 AS n_scores, NULL::VARCHAR AS last_cost,
jd_summary, coalesce(cv_summary, '') AS cv_summary, coalesce(gap_analysis, '') AS gap_analysis, '' AS jd_text FROM sessions""")
def session_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _conversations(spark, sf_dir)
    given = transcripts.sessions_of(conversations).join(transcripts.settings_of(conversations).select("session_id", "total_questions"), "session_id")
    kept = ("session_id", "interview_started", "interview_done", "question_count", "total_questions", "attempt", "last_cost", "jd_summary", "cv_summary", "gap_analysis", "jd_text")
    return sessions.with_defaults(given).select(*kept, F.size("messages").alias("n_messages"), F.size("scores").alias("n_scores"))


@_query(f"""WITH {_SESSIONS} SELECT session_id, CASE WHEN coalesce(gap_analysis, '') <> '' THEN {_q(report.GAP_TITLE)} WHEN jd_summary <> '' THEN {_q(report.JD_TITLE)} END AS title,
CASE WHEN coalesce(gap_analysis, '') <> '' THEN gap_analysis WHEN jd_summary <> '' THEN jd_summary END AS text, coalesce(jd_summary, '') <> '' AND coalesce(cv_summary, '') <> '' AS asks_for_gap FROM sessions""")
def gap_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section that a report shows of the analyses, and whether a gap analysis can be asked for."""
    found = report.gap_section(F.col("gap_analysis"), F.col("jd_summary"))
    return transcripts.sessions_of(_conversations(spark, sf_dir)).select("session_id", found["title"].alias("title"), found["text"].alias("text"), prompts.gap_stage(F.col("jd_summary"), F.col("cv_summary")).alias("asks_for_gap"))


@_query(f"""WITH s AS (SELECT doc_id // 2 AS key, doc_id % 2 = 0 AS cv, CASE WHEN doc_id % 10 = 0 THEN '' ELSE substring(text, 1, 200) END AS reply FROM documents)
SELECT c.key, 'gap' AS stage, 0.3::DOUBLE AS temperature, 500 AS max_tokens, md5({_q(replies._PAIR[0])} || c.reply || {_q(replies._PAIR[1])} || j.reply) AS prompt_md5 FROM s c JOIN s j ON c.key = j.key AND c.cv AND NOT j.cv WHERE c.reply <> '' AND j.reply <> ''""")
def gap_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of documents taken in pairs: of even ids as CVs, of the next ones as postings."""
    doc_id = F.col("doc_id")
    told = _table(spark, sf_dir, "documents").select(F.floor(doc_id / 2).cast("long").alias("key"), (doc_id % 2 == 0).alias("cv"), F.when(doc_id % 10 == 0, F.lit("")).otherwise(F.substring("text", 1, 200)).alias("reply"))
    asked = replies.gap_requests(told.filter("cv").select("key", "reply"), told.filter("NOT cv").select("key", "reply"))
    return asked.select("key", "stage", "temperature", "max_tokens", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


# ---- replies


@_query(f"""WITH ends AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'assistant') AS said FROM conversations GROUP BY 1),
log AS (SELECT conv_id, string_agg(role || chr(1) || text, chr(2) ORDER BY turn) AS sent, sum(length(text))::BIGINT AS chars FROM conversations JOIN ends USING (conv_id) WHERE said IS NULL OR turn < said GROUP BY 1),
asked AS (SELECT conv_id, {_pick(transcripts.MODELS, "conv_id")} AS model, 'S' || conv_id % 3 AS system, coalesce(sent, '') AS sent, coalesce(chars, 0) AS chars, text AS reply FROM ends LEFT JOIN log USING (conv_id) LEFT JOIN conversations c USING (conv_id) WHERE (said IS NULL AND c.turn = (SELECT min(turn) FROM conversations x WHERE x.conv_id = ends.conv_id) OR c.turn = said)),
a2 AS (SELECT a.conv_id, model, system, sent, chars, CASE WHEN said IS NOT NULL THEN reply END AS reply FROM asked a JOIN ends USING (conv_id) WHERE model <> 'unknown'),
told AS (SELECT model, system, sent, min(reply) AS reply, any_value(chars) AS chars FROM a2 WHERE reply IS NOT NULL GROUP BY ALL),
rates AS (SELECT * FROM (VALUES {', '.join(f"({_q(m)}, {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in cost.RATES)}) v(model, i, o)),
r AS (SELECT conv_id, model, t.reply, coalesce(t.chars, 0) AS p, coalesce(length(t.reply), 0) AS c FROM a2 LEFT JOIN told t USING (model, system, sent))
SELECT conv_id AS session_id, model, md5(reply) AS reply_md5, p AS input_tokens, c AS output_tokens, round((p / 1e6) * i + (c / 1e6) * o, 12) AS total_cost_usd FROM r JOIN rates USING (model)""")
def reply_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats up to their last reply as requests, that reply as what a ledger holds of them, and what it cost; open requests have none."""
    conversations = _conversations(spark, sf_dir)
    ends = conversations.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("said"))
    log = conversations.join(ends, "conv_id").filter(F.col("said").isNull() | (F.col("turn") < F.col("said")))
    c = F.col("conv_id")
    prompted = ends.select(c.alias("session_id"), F.concat(F.lit("S"), (c % 3).cast("string")).alias("system_prompt"), transcripts._one_of(transcripts.MODELS, c).alias("model"))
    asked = ledger.keyed(replies.chat_requests(prompted, transcripts.messages_of(log)))
    chars = F.aggregate("messages", F.lit(0).cast("long"), lambda n, m: n + F.when(m["seq"] >= 0, F.length(m["content"])).otherwise(0))
    last = conversations.join(ends, "conv_id").filter(F.col("turn") == F.col("said")).select(c.alias("session_id"), F.col("text").alias("reply"))
    told = asked.join(last, "session_id").groupBy("request").agg(F.min(F.struct("reply", chars.alias("prompt_tokens"), F.length("reply").cast("long").alias("completion_tokens"))).alias("r")).select("request", "r.*")
    costs = replies.cost_log(ledger.answered(asked, told))
    return costs.select("session_id", "model", F.md5(F.col("reply").cast("binary")).alias("reply_md5"), "input_tokens", "output_tokens", F.round("total_cost_usd", 12).alias("total_cost_usd"))


# ---- patterns, strings in order


def _pattern_hit(p: str) -> str:
    return "contains(replace(lower(text), 'act as interview', chr(1)), 'act as ')" if "(?!" in p else f"regexp_matches(lower(text), {_q(p)})"


@_query(f"""WITH {_ANSWERS}, f AS (SELECT id, n, CASE {' '.join(f"WHEN {_pattern_hit(p)} THEN {i}" for i, p in enumerate(guards.INJECTION_PATTERNS))} END AS position FROM r)
SELECT id, n, position, [{', '.join(map(_q, guards.INJECTION_PATTERNS))}][position + 1] AS pattern FROM f""")
def first_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame([(i, p, None) for i, p in enumerate(guards.INJECTION_PATTERNS)], "position int, pattern string, label string")
    found = patterns.matcher(table).found(F.lower("text"))
    return _answers(spark, sf_dir).select("id", "n", found.alias("f")).select("id", "n", "f.position", "f.pattern")


@_query(f"""WITH {_BLOCKS}, b AS (SELECT session_id, string_agg({_BAR}, chr(10) ORDER BY ordinal) AS bars FROM scores GROUP BY 1),
q AS (SELECT session_id, string_agg(number || '. ' || question, chr(10) ORDER BY number) AS questions FROM (SELECT DISTINCT session_id, number, question FROM blocks) GROUP BY 1)
SELECT session_id, bars, questions FROM b FULL JOIN q USING (session_id)""")
def listed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars and questions of a session as one text each, by ordered string aggregates."""
    messages = _marked(spark, sf_dir)
    asked = transcript.report_blocks(messages).select("session_id", "number", F.concat(F.col("number").cast("string"), F.lit(". "), F.col("question")).alias("line")).distinct()
    return report.listed_bars(scores.breakdown(messages)).join(ordered_text(asked, ["session_id"], "line", "number", "questions", "\n"), "session_id", "full")


# ---- uploads, requests, dates


_BARE = _strip("coalesce(text, '')")


@_query(f"""SELECT doc_id, doc_id % 3 <> 2 AND {_BARE} <> '' AS ok, md5(CASE WHEN doc_id % 3 = 2 THEN {_q(uploads.UNSUPPORTED)} WHEN {_BARE} = '' THEN {_q(uploads.NO_TEXT['.docx'])} ELSE {_BARE} END) AS value_md5 FROM documents""")
def upload_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of several names: the ending, in any case of letters, says how one is read, whatever is in it."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")

    @F.pandas_udf("binary")
    def made(column):
        return column.map(lambda t: uploads.make_docx((t or "").split("\n")))

    name = F.concat(F.lit("cv.v1"), F.get(F.array(*map(F.lit, (".docx", ".DocX", ".docx.txt"))), (F.col("doc_id") % 3).cast("int")))
    got = docs.withColumn("got", uploads.extract_text(name, made("text")))
    return got.select("doc_id", "got.ok", F.md5(F.col("got.value").cast("binary")).alias("value_md5"))


@_query(
    " UNION ALL ".join(
        f"SELECT doc_id AS key, '{stage}' AS stage, '{replies.ANALYSIS_MODEL}' AS model, {replies.STAGES[stage][0]}::DOUBLE AS temperature, {replies.STAGES[stage][1]} AS max_tokens, md5({_q(replies._TEXTS[stage])} || substring(text, 1, {replies.CLIPS[stage]})) AS prompt_md5 FROM documents WHERE {_BARE} <> ''"
        for stage in ("cv", "jd")
    )
)
def analysis_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the analyses of each document as a CV and as a posting ask."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    asked = replies.requests(docs, "cv").unionByName(replies.requests(docs, "jd"))
    return asked.select("key", "stage", "model", "temperature", "max_tokens", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@_query("SELECT event_id, strftime(ts, '%B %d, %Y — %H:%M') AS printed, 'interview_report_' || strftime(ts, '%Y%m%d_%H%M') || '.html' AS file_name FROM events")
def report_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return _table(spark, sf_dir, "events").select("event_id", report.printed_date(ts).alias("printed"), report.file_name(ts).alias("file_name"))


@_query(f"""WITH {_ATTEMPTS} SELECT session_id, seq, role, visit, attempt, score, CASE WHEN submits THEN CASE WHEN attempt > 0 THEN {_q(report.IMPROVED_ANSWER[0])} || (attempt + 1) || {_q(report.IMPROVED_ANSWER[1])} ELSE {_q(report.FIRST_ANSWER)} END END AS label FROM tries""")
def attempt_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions counted within each visit to a question, the score of their replies, and what an attempt is called."""
    label = F.when(F.col("submits"), report.attempt_label(F.col("attempt") + 1))
    return scores.attempts(_marked(spark, sf_dir)).select("session_id", "seq", "role", "visit", "attempt", "score", label.alias("label"))
