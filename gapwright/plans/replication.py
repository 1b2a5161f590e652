"""Resumable multi-seed replication into a partitioned prediction store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SCENARIOS
from ..operators.imputers import NATIVE
from ..sinks.store import finished, write_pool
from .evaluation import evaluate


def replicate(samples: DataFrame, path: str, methods: Sequence[str], seeds: Sequence[int], mask_seeds: Sequence[int] | None = None,
              scenarios: Sequence[str] = SCENARIOS, **kw) -> int:
    """Score every missing (init seed, mask seed, scenario, method) cell and store its points.

    ``mask_seeds`` decouples the evaluation masks from the init seed.  Cells found in the
    store are skipped; a partition appears only when its write has committed, so rerunning
    after an interruption finishes the rest.  Returns the number of cells written.
    """
    unknown = set(methods) - set(NATIVE)
    if unknown:
        raise ValueError(f"no native imputer: {sorted(unknown)}")
    done = finished(samples.sparkSession, path)
    written = 0
    for s in seeds:
        for m in (mask_seeds if mask_seeds is not None else [s]):
            missing = {c: [x for x in methods if (s, m, c, x) not in done] for c in scenarios}
            for todo in sorted({tuple(v) for v in missing.values() if v}):       # scenarios that lack the same methods run together
                cells = [c for c in scenarios if tuple(missing[c]) == todo]
                pts = evaluate(samples, list(todo), cells, (m,), **kw).withColumn("init_seed", F.lit(int(s)))
                write_pool(pts, path)
                written += len(todo) * len(cells)
    return written
