"""Structured Streaming: a stream of signed facts keeps a query's result up to date, batch by batch."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import ast
from ..storage import files, read_text, write_text
from .live import LiveView, attributes
from .zset import ZSet


def maintain(stream: DataFrame, query: object, values: Mapping[str, Column | str], sink: Callable[[ZSet, int], None], checkpoint: str, names: list[str] | None = None, **trigger: object) -> tuple[StreamingQuery, LiveView]:
    """Run ``query`` over a stream of ``e, a, ..., mult`` and hand each batch's change of the result to ``sink``.

    ``values``: for each attribute the column that holds its value. After a batch was handed on, its number and the folders of
    the state are written beside the stream's checkpoint; a stream that starts again goes on from there. A batch after which
    that was not done is handed on again, with the same number and the same change.
    """
    q, spark = ast.parse(query), stream.sparkSession
    view = LiveView(q, names)
    wanted = attributes(q.where)
    missing = wanted - set(values)
    if missing:
        raise ast.QueryError(f"no value column for {', '.join(sorted(missing))}")
    folder = f"{checkpoint.rstrip('/')}-live"
    fs, top = files(spark, folder)
    numbers = sorted(int(x.getPath().getName()) for x in fs.listStatus(top) if x.getPath().getName().isdigit()) if fs.exists(top) else []
    done = {"batch": -1}
    if numbers:
        done["batch"] = numbers[-1]
        view.load(spark, json.loads(read_text(spark, f"{folder}/{numbers[-1]}")))

    def each(batch: DataFrame, number: int) -> None:
        if number <= done["batch"]:
            return
        changes = {}
        for a in wanted:
            value = F.col(values[a]) if isinstance(values[a], str) else values[a]
            changes[a] = batch.where(F.col("a") == a).select("e", value.alias("v"), "mult")
        sink(view.apply(changes), number)
        write_text(spark, f"{folder}/{number}", json.dumps(view.save()))
        done["batch"] = number

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(), view
