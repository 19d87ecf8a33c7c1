"""The streamed score fold against the batch one."""

from pyspark.sql import functions as F

from colloquy.operators import scores
from colloquy.sources import transcripts
from colloquy.streaming.session_scores import stream_scores

CONVERSATION = ["system", *["user", "assistant"] * 6]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(c, t, role, f"text {c} {t}") for c in range(30) for t, role in enumerate(CONVERSATION)]
    marked = transcripts.marked_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    for i, (a, b) in enumerate([(0, 4), (5, 8), (9, 99)]):
        marked.filter(F.col("seq").between(a, b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(marked.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream_scores(stream).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = spark.table("changes").groupBy("session_id", "ordinal").agg(F.max_by("score", "seq").alias("score"))
    got = sorted(map(tuple, last.collect()))
    assert got and got == sorted(map(tuple, scores.score_list(marked).collect()))
