"""Incremental use: each finished run as one micro-batch of the ordered finalize."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from listingloom.operators.resolve import finalize


def finalize_batches(read_store: Callable[[], tuple[DataFrame, DataFrame]], write_store: Callable[[DataFrame, DataFrame, DataFrame, int], None], seen: Callable[[int], str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: staged rows of a micro-batch are merged into the store that read_store gives.

    write_store(events, aliases, outcomes, epoch) must swap in the new tables under the epoch, so that a batch that is run
    again replaces what it wrote before.
    """

    def run(staged: DataFrame, epoch: int) -> None:
        events, aliases = read_store()
        write_store(*finalize(staged, events, aliases, seen(epoch)), epoch)

    return run
