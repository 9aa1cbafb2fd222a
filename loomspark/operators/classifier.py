"""A remote model as a classifier: batches of comments, a budget of tokens a minute, and failures that stay with their rows.

client() is called once for each task and gives a function (system prompt, comment) -> answer. Each task has its share of the budget, so all
tasks that run at once keep within it; a call that fails after its retries gives no answer and an error, and nothing else of the batch is lost.
A null or blank comment isn't sent.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import for_model
from loomspark.operators import causes

TOKENS_A_MINUTE = 180_000
#: Tokens kept for an answer.
ANSWER_TOKENS = 50
Client = Callable[[], Callable[[str, str], str]]


def estimated_tokens(prompt: str | None, text: str | None) -> int:
    """A token for each three bytes of UTF-8, and the answer's."""
    return -(-len(((prompt or "") + (text or "")).encode()) // 3) + ANSWER_TOKENS


class Bucket:
    """A token bucket: filled evenly, never over a minute's budget; a call larger than that takes the whole of it."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.capacity = self.tokens = float(per_minute)
        self.clock, self.sleep = clock, sleep
        self.last = clock()

    def acquire(self, tokens: int) -> None:
        need = min(float(tokens), self.capacity)
        while True:
            now = self.clock()
            self.tokens = min(self.capacity, self.tokens + (now - self.last) * self.capacity / 60)
            self.last = now
            if self.tokens >= need:
                self.tokens -= need
                return
            self.sleep((need - self.tokens) * 60 / self.capacity)


def asked(comments: DataFrame, text: str, client: Client, prompt: str, per_minute: int = TOKENS_A_MINUTE, retries: int = 2, tasks: int | None = None) -> DataFrame:
    """Adds answer (the model's raw words, null without one) and error (null, or what failed). tasks: how many run at once, by default the cluster's parallelism."""
    share = per_minute / max(1, tasks or comments.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, call = Bucket(share), None
        for batch in batches:
            answers, errors = [], []
            for said in batch["__said"]:
                answer = error = None
                for left in range(retries, -1, -1) if said else ():
                    try:
                        call = call or client()
                        bucket.acquire(estimated_tokens(prompt, said))
                        answer, error = call(prompt, said), None
                        break
                    except Exception as e:  # noqa: BLE001  whatever a client raises stays with its row
                        error = f"{type(e).__name__}: {e}"
                answers.append(answer), errors.append(error)
            yield batch.drop(columns="__said").assign(answer=pd.Series(answers, dtype=object, index=batch.index), error=pd.Series(errors, dtype=object, index=batch.index))

    sent = comments.withColumn("__said", for_model(F.col(text)))
    return sent.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in comments.schema) + ", answer string, error string")


def classified(answered: DataFrame, text: str) -> DataFrame:
    """Adds model_code, model_confidence, code, confidence, rule, status and needs_review. A call that failed is H at 0 with API_ERROR, an empty text H at 0 with EMPTY_TEXT."""
    own = answered.columns
    failed, empty = F.col("error").isNotNull(), F.length(for_model(F.col(text))) == 0
    lost = failed | empty
    out = answered.withColumn("__asked_code", F.when(lost, "H").otherwise(causes.answer_code(F.col("answer")))).withColumn("__asked_conf", F.when(lost, 0.0).otherwise(causes.answer_confidence(F.col("answer"))))
    out = causes.with_rules(out, text, F.col("__asked_code"), F.col("__asked_conf"), "__r")
    pick = lambda f, other: F.when(lost, other).otherwise(F.col(f"__r.{f}"))
    rule = F.when(empty, "empty").when(failed, "api_error").otherwise(F.col("__r.rule"))
    out = out.select(*own, F.col("__asked_code").alias("model_code"), F.col("__asked_conf").alias("model_confidence"), pick("code", F.lit("H")).alias("code"), pick("confidence", F.lit(0.0)).alias("confidence"), rule.alias("rule"))
    status = F.when(F.col("rule") == "empty", "EMPTY_TEXT").when(F.col("rule") == "api_error", "API_ERROR").otherwise(causes.status(F.col(text), F.col("confidence"), F.col("rule")))
    return out.withColumn("status", status).withColumn("needs_review", F.col("confidence") < causes.LOW_CONFIDENCE)
