"""Questions about a document: the context a question is asked in, and the history, appended by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RECENT = 3


def recent(history: DataFrame, by: str, seq: str, n: int = RECENT) -> DataFrame:
    """The last n entries of each job, oldest first by seq."""
    last = Window.partitionBy(by).orderBy(F.col(seq).desc())
    return history.withColumn("__back", F.row_number().over(last)).where(F.col("__back") <= n).drop("__back")


def contexts(questions: DataFrame, pages: DataFrame, history: DataFrame) -> DataFrame:
    """questions: job_id, question, page_no, full and perhaps question_id and picked (a paragraph's text); pages: job_id, page_no, original,
    output; history: job_id, seq, question, answer. Returns job_id, question_id, question, context: the page (or all pages, if full), the
    picked paragraph, the last entries, and the question, parted by blank lines. Without ids, questions that differ in nothing are
    one. A question about a page that isn't there has no row."""
    if "picked" not in questions.columns:
        questions = questions.withColumn("picked", F.lit(None).cast("string"))
    if "question_id" not in questions.columns:
        questions = questions.withColumn("question_id", F.xxhash64("job_id", "question", "page_no", "full", "picked"))
    asked = questions.alias("q").join(pages.alias("p"), (F.col("q.job_id") == F.col("p.job_id")) & (F.col("q.full") | (F.col("q.page_no") == F.col("p.page_no"))))
    shown = asked.groupBy("q.job_id", "q.question_id", "q.question", "q.picked").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("p.page_no"), F.concat_ws("\n\n", "original", "output").alias("t")))), lambda s: s["t"]), "\n\n").alias("pages"))
    said = recent(history, "job_id", "seq").groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws("\n", "question", "answer").alias("t")))), lambda s: s["t"]), "\n\n").alias("said"))
    context = F.concat_ws("\n\n", "pages", "picked", "said", "question")
    return shown.join(said, "job_id", "left").select("job_id", "question_id", "question", context.alias("context"))


def append_history(stream: DataFrame, path: str, checkpoint: str):
    """A running query that appends each batch of answered questions to the history table, once: a batch that is run again replaces
    its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
