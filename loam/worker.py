"""Index a tree as a job of its own: ``python -m loam.worker FOLDER ROOT [NAME]``.

Writes what happens to the log of ``NAME`` below ``FOLDER/logs``; exit code 1 on failure."""

from __future__ import annotations

import sys
import time


def run(spark, folder: str, root: str, name: str) -> int:
    from loam.plans.engine import Engine
    from loam.sources.files import Log

    began, log = time.time(), Log(spark, f"{folder}/logs", name)
    log.write(f"Starting indexing for: {root}")
    try:
        n = Engine(spark, folder).index_codebase(root)
    except Exception as e:
        log.write(f"Failed indexing attempt registered: {e}")
        log.write("Process completed with code: 1")
        return 1
    log.write(f"Uploaded {n} chunks to namespace of {root}" if n else "No chunks generated")
    log.write(f"Took {time.time() - began:.1f} s")
    log.write("Process completed with code: 0")
    return 0


def main(arguments: list[str]) -> int:
    from pyspark.sql import SparkSession

    folder, root, *name = arguments
    spark = SparkSession.builder.appName(f"index {root}").getOrCreate()
    try:
        return run(spark, folder, root, name[0] if name else root.rstrip("/").rsplit("/", 1)[-1])
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
