"""Commit release: rows of a transaction are withheld until its COMMIT arrives and dropped at its ABORT.

State is kept by transaction, so rows may come in any number of micro-batches and have any
columns.  A transaction that never ends keeps its rows; no time limit would be right for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _releaser(columns: list[str]) -> Callable:
    """The function of one group; ``columns`` are those of a row, in the state's order."""

    def release(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new, end = [], None
        for batch in batches:
            ends = batch["op"].isin(["COMMIT", "ABORT"])
            if ends.any():
                last = batch[ends].iloc[-1]
                end = (last["op"], int(last["lsn"]), int(last["end_lsn"]))
            new.append(batch.loc[~ends, columns])
        rows = pd.concat(new, ignore_index=True).astype(object)
        rows = rows.where(rows.notna(), None)
        if state.exists:
            held = pd.DataFrame(dict(zip(columns, (list(x) for x in state.get), strict=True)), dtype=object)
            rows = pd.concat([held, rows], ignore_index=True)
        if end is None:
            state.update(tuple(rows[c].tolist() for c in columns))
            return
        if state.exists:
            state.remove()
        if end[0] == "COMMIT" and len(rows):
            out = rows.sort_values("lsn").infer_objects()
            out.insert(0, "txn", key[0])
            yield out.assign(commit_lsn=end[1], commit_end_lsn=end[2])

    return release


def commit_release(log: DataFrame) -> DataFrame:
    """Released row events of a streaming log; it has ``txn``, ``lsn``, ``op``, ``end_lsn`` and any columns of rows, COMMIT and ABORT are rows too.

    The result has the log's columns without ``end_lsn``, and commit_lsn and commit_end_lsn.
    """
    columns = [c for c in log.columns if c not in ("txn", "end_lsn")]
    kind = {c: log.schema[c].dataType.simpleString() for c in log.columns}
    state = ", ".join(f"`{c}` array<{kind[c]}>" for c in columns)
    out = ", ".join([f"txn {kind['txn']}", *(f"`{c}` {kind[c]}" for c in columns), "commit_lsn bigint", "commit_end_lsn bigint"])
    return log.groupBy("txn").applyInPandasWithState(_releaser(columns), out, state, "append", GroupStateTimeout.NoTimeout)
