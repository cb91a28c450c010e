"""Counters of a run: what each step lets through, observed in the pass that runs anyway."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Counters:
    """Observes segments between steps; after an action on the result ``summary`` tells what the steps did.

    >>> counters = Counters()
    >>> out = Pipeline(config, counters=counters).transform(segments)
    >>> out.write.parquet(path)
    >>> counters.summary()
    [{"step": "input", "rows": 10, ...}, {"step": "timing", "rows": 8, "removed": 2, "characters_changed": -31, ...}]
    """

    def __init__(self) -> None:
        self.steps: list[tuple[str, Observation]] = []

    def watch(self, step: str, df: DataFrame) -> DataFrame:
        """``df``, counted as what comes out of ``step``."""
        seen = Observation(f"{len(self.steps)} {step}")
        self.steps.append((step, seen))
        zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
        return df.observe(
            seen,
            F.count(F.lit(1)).alias("rows"),
            zero(F.length("text")).alias("characters"),
            zero(F.col("end") - F.col("start")).alias("seconds"),
            zero(F.greatest(F.size("words"), F.lit(0))).alias("words"),
        )

    def summary(self) -> list[dict]:
        """A row for each step: its metrics, the rows that it removed (below zero: added), and by how much the others changed.

        Waits for the first action on the watched frame.
        """
        out: list[dict] = []
        for step, seen in self.steps:
            own = {"step": step, **seen.get}
            if out:
                before = out[-1]
                own["removed"] = before["rows"] - own["rows"]
                own |= {f"{m}_changed": own[m] - before[m] for m in ("characters", "seconds", "words")}
            out.append(own)
        return out


def unwatched(step: str, df: DataFrame) -> DataFrame:
    return df
