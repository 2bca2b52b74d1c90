from __future__ import annotations

from pyspark.sql import DataFrame

from depguard.operators.pod import pod_incremental
from depguard.rules import POD


def check_stream(stream: DataFrame, base: DataFrame, rule: POD, key: str, target: str, checkpoint: str):
    """Each micro-batch is checked against the base; violations are written to `target`/batch=N, which a repeated batch
    overwrites, so the result is exact after a restart. Returns the started query."""

    def one(batch: DataFrame, number: int) -> None:
        pod_incremental(base, batch, rule, key).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
