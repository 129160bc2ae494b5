"""Running and finished queries: profiles, a history, slow ones, and cancelling."""

from __future__ import annotations

import dataclasses
import time
import uuid
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelake.plans.safety import masked


def profile(df: DataFrame) -> str:
    """The plan as it is to run, with what is pushed into the scans."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@dataclasses.dataclass
class Run:
    id: str
    text: str
    began: float
    state: str = "running"
    seconds: float = 0.0
    error: str = ""


class QueryRegistry:
    """Runs actions under a tag of their own, so that one can be cancelled; keeps the last `history` of them.

    Literals are hidden in what is kept.
    """

    def __init__(self, spark: SparkSession, history: int = 1000, slow_seconds: float = 10.0) -> None:
        self.spark, self.slow_seconds = spark, slow_seconds
        self.active: dict[str, Run] = {}
        self.done: deque[Run] = deque(maxlen=history)

    def run(self, text: str, action: Callable[[], object], id: str | None = None):
        run = Run(id or uuid.uuid4().hex, masked(text), time.time())
        self.active[run.id] = run
        self.spark.addTag(run.id)
        try:
            out = action()
            run.state = "done"
            return out
        except Exception as e:
            run.state = "cancelled" if run.state == "cancelling" else "failed"
            run.error = " ".join(str(e).split())[:200]
            raise
        finally:
            self.spark.removeTag(run.id)
            run.seconds = time.time() - run.began
            self.done.append(self.active.pop(run.id))

    def cancel(self, id: str) -> bool:
        if id not in self.active:
            return False
        self.active[id].state = "cancelling"
        self.spark.interruptTag(id)
        return True

    def slow(self) -> list[Run]:
        return [r for r in self.done if r.seconds >= self.slow_seconds]
