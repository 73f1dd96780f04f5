"""A prompt: ``python -m agentlake ROOT`` runs ``;``-terminated statements against the store at ROOT."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from agentlake.errors import EngineError
from agentlake.session import Engine

#: Rows that the prompt shows of a result.
SCREEN = 1000


def main() -> None:
    spark = SparkSession.builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    session, text = Engine(spark, sys.argv[1]).connect(), ""
    for line in sys.stdin:
        text += line
        if not line.rstrip().endswith(";"):
            continue
        try:
            out = session.execute(text)
            print(out.message)
            if out.df is not None:
                found = out.df.take(SCREEN)  # a prompt's screen; query() gives the whole DataFrame
                print("\n".join(" | ".join("NULL" if v is None else str(v) for v in r) for r in found))
                print(f"({len(found)} rows)" if len(found) < SCREEN else f"(the first {SCREEN} of {out.df.count()} rows)")
        except EngineError as e:
            print(f"{type(e).__name__}: {e}")
        text = ""


if __name__ == "__main__":
    main()
