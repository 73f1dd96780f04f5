"""Choose the toxicity settings by cross-validation inside the training part.

    python -m agentlake.llm.tune_toxicity SF_DIR

Reads the operator's own training sample (never a held-out row), deals it by a hash of the
text to FOLDS folds, and prints for each setting the precision, recall and F1 of the
threshold on the folds left out.  The best F1 wins; of equal ones the first, and the grid
goes from few passes and weights to many.
"""

from __future__ import annotations

import itertools
import sys
import zlib
from concurrent.futures import ProcessPoolExecutor

import numpy as np
from pyspark.sql import SparkSession

from . import common, toxicity

FOLDS = 3
GRID = [toxicity.Settings(epochs=e, alpha=a, l1=l1, positive=p) for e, a, (l1, p) in itertools.product((6, 12), (4.0, 16.0), ((8.0, 1.0), (16.0, 4.0), (32.0, 8.0), (48.0, 16.0)))]


def measure(data: list[tuple[int, np.ndarray, int]], settings: toxicity.Settings) -> tuple[float, float, float, int]:
    """(precision, recall, F1, mean number of weights) over the folds."""
    hit = said = there = size = 0
    for fold in range(FOLDS):
        model = toxicity.fit([(f, y) for k, f, y in data if k != fold], settings)
        size += len(model.index)
        for k, f, y in data:
            if k == fold:
                yes = toxicity.probability(model, f) >= toxicity.THRESHOLD
                hit, said, there = hit + (yes and y), said + yes, there + y
    precision, recall = hit / max(said, 1), hit / max(there, 1)
    return precision, recall, 2 * precision * recall / max(precision + recall, 1e-9), size // FOLDS


def choose(rows: list[tuple[str, int]], grid: list[toxicity.Settings] = GRID) -> toxicity.Settings:
    data = [(zlib.crc32(t.encode("utf-8", "surrogatepass")) % FOLDS, np.unique(toxicity.features(t)), y) for t, y in rows]
    best = None
    with ProcessPoolExecutor() as pool:
        found = list(pool.map(measure, [data] * len(grid), grid))
    for settings, (precision, recall, f1, size) in zip(grid, found, strict=True):
        print(f"{settings}: precision {precision:.4f}, recall {recall:.4f}, F1 {f1:.4f}, {size} weights", flush=True)
        if best is None or f1 > best[0] + 1e-9:
            best = (f1, settings)
    return best[1]


def main() -> None:
    spark = SparkSession.builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    rows = toxicity.sample(common.documents(spark, sys.argv[1]), common.documents(spark, sys.argv[1], "labels"), "doc_id", "text", "toxic")
    print(f"{len(rows)} rows, {sum(y for _, y in rows)} toxic")
    print("chosen:", choose(rows))


if __name__ == "__main__":
    main()
