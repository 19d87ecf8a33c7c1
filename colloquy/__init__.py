"""Analytics over question-and-answer session transcripts, on Spark DataFrames."""
