"""Random transcripts for several tests."""

import random

from colloquy.operators import parsing

PARTS = [parsing.READY, parsing.SATISFIED, parsing.SKIPPED, "an <answer>", "- other\n- answer", ""]
SAID = [
    "---NEXT QUESTION---\nq **1**\n---END QUESTION---", "---FEEDBACK---\n**Score:** 3/10\n---END FEEDBACK---", "---FEEDBACK---\n**Score:** 9/10\nfine\n---END FEEDBACK---", "plain", "",
    "---FEEDBACK---\n**Score:** 7/10\n---END FEEDBACK---\n---NEXT QUESTION---\ns\n---END QUESTION---",
]


def sessions_log(spark, n=40, seed=3):
    rng, rows = random.Random(seed), []
    for s in range(n):
        rows += [(s, i, role, rng.choice(SAID if role == "assistant" else PARTS)) for i, role in enumerate(rng.choices(["user", "assistant", "system"], [5, 5, 1], k=rng.randrange(1, 16)))]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "session_id long, seq long, role string, content string")
