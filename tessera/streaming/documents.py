"""Documents over a stream of operations: a state for each name, an output row for each operation or for each changed document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators import documents as batch
from tessera.schema import VERSION

STATE = "content string, version long"
DOCUMENT = "name string, content string, version long"


def _apply(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ops = pd.concat(list(parts)).sort_values(batch.ORDER, na_position="first")
    now = tuple(state.get) if state.exists else None
    out = []
    for seq, op, position, text, by in ops[["seq", "op", "position", "text", "edited_by"]].itertuples(index=False):
        now, status = batch.step(now, op, key[0], None if pd.isna(position) else int(position), None if pd.isna(text) else text)
        out.append((seq, key[0], op, status, now[1] if now else None, now[0] if status in batch.ACCEPTED else None, by))
    if now is not None:
        state.update(now)
    yield pd.DataFrame(out, columns=VERSION.names)


def outcomes(ops: DataFrame) -> DataFrame:
    """The stream of outcomes (schema.VERSION).  Within a micro-batch operations apply in the batch's full order, across batches as they arrive."""
    keyed = batch.named(ops).groupBy("name")
    return keyed.applyInPandasWithState(_apply, VERSION, STATE, "append", GroupStateTimeout.NoTimeout)


def feed(ops: DataFrame) -> DataFrame:
    """The stream of accepted versions."""
    return outcomes(ops).where(F.col("status").isin(*batch.ACCEPTED))


class _Folding(StatefulProcessor):
    """Keeps (content, version) of a name and gives it once for each batch that changed it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("document", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        name = key[0]
        order = lambda r: tuple((r[c] is not None, r[c]) for c in batch.ORDER)
        document = batch.Document(*self.kept.get()) if self.kept.exists() else batch.Document()
        before = document.version
        for r in sorted(rows, key=order):
            document.apply(r["op"], name, r["position"], r["text"])
        if document.version != before:
            content = str(document.text)
            self.kept.update((content, document.version))
            yield Row(name=name, content=content, version=document.version)

    def close(self) -> None:
        return


def states(ops: DataFrame) -> DataFrame:
    """The stream of changed documents (name, content, version), for update mode on the RocksDB store (tables.ChangeTable).

    Within a micro-batch operations apply in the batch's full order through a rope, across batches as they arrive.
    """
    keyed = batch.named(ops).where((F.col("op") != "create") | (F.col("name") != "")).groupBy("name")
    return keyed.transformWithState(_Folding(), DOCUMENT, "Update", "None")
