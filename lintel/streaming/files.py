"""Rules that a single file decides, over a stream of files."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from lintel.plans.engine import evaluate
from lintel.plans.rules import ConfigError, Rule


def watch(files: DataFrame, rules: Iterable[Rule], sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Starts a query that hands the findings of each micro-batch of files to sink(findings, batch). Rules that need the
    whole scope are refused: a batch can't decide them."""
    rules = [*rules]
    if whole := [r.id for r in rules if r.whole]:
        raise ConfigError(f"these need the whole scope: {', '.join(whole)}")
    return files.writeStream.foreachBatch(lambda batch, n: sink(evaluate(batch, rules), n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
