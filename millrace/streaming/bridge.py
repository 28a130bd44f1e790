"""Each micro-batch becomes one input session.

A batch is folded into the value of an input key (``fold(old, batch)``), and
the batch number is stored beside it in the same commit, so a batch that is
delivered again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from millrace.operators.definition import query
from millrace.operators.engine import Engine


@query(name="millrace.Delivered")
class Delivered:
    """The last batch that was folded into an input, by the stream's name."""

    stream: str


def into_sessions(engine: Engine, key: object, fold: Callable[[DataFrame | None, DataFrame], DataFrame], name: str, after: Callable[[], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``."""

    def handle(batch: DataFrame, number: int) -> None:
        with engine.session() as s:
            last: list[int] = []
            s.update(Delivered(name), lambda old: last.append(-1 if old is None else old) or max(number, last[0]))
            if number <= last[0]:
                return
            s.update(key, lambda old: fold(old, batch))
        if after:
            after()

    return handle


def run(stream: DataFrame, engine: Engine, key: object, fold: Callable[[DataFrame | None, DataFrame], DataFrame], name: str, checkpoint: str, after: Callable[[], None] | None = None) -> StreamingQuery:
    """Start folding all that is available; ``awaitTermination`` ends when it is done."""
    writer: DataStreamWriter = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(into_sessions(engine, key, fold, name, after)).start()
