"""Command line: transcripts or media in, one WebVTT file a media item out.

    python -m cuewise PATHS... [--config FILE] [--local FILE] [--output-dir DIR] [--format json|parquet]
    python -m cuewise --recogniser package.module:factory [FILES OR FOLDERS...] [--recursive] ...

PATHS are tables of transcripts (media_id, segments). With a recogniser they are media files and folders (the current folder if
none is given), which it hears; the factory is called on the executors. A path that can't be read does not keep the others
from being written, and what is done already is not done again (see ``cuewise.plans.runs``); the exit status is 1 if anything failed.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from cuewise.config import load_config, validate_llm_requirements
from cuewise.operators.models import RecogniserFactory, recognition_params
from cuewise.plans.pipeline import Pipeline
from cuewise.plans.runs import run
from cuewise.sources import media


def arguments(given: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="cuewise", description="Makes and cleans transcripts and writes WebVTT files.")
    parser.add_argument("paths", nargs="*")
    parser.add_argument("--config", help="JSON file, merged over the defaults")
    parser.add_argument("--local", help="JSON file, merged over that of --config if it exists")
    parser.add_argument("--output-dir", help="folder of the WebVTT files; else output_directory of the configuration")
    parser.add_argument("--format", default="json", choices=("json", "parquet"))
    parser.add_argument("--recogniser", help="package.module:factory of what hears the media")
    parser.add_argument("--recursive", action="store_true", help="look for media in the folders below, too")
    parser.add_argument("--details", help="folder for the answers of the text model that were no good")
    parser.add_argument("--portions", type=int, default=8, help="in how many portions media items are done")
    return parser.parse_args(given)


def factory(name: str) -> RecogniserFactory:
    module, _, own = name.partition(":")
    return getattr(importlib.import_module(module), own)


def heard(spark: SparkSession, path: str, config: dict, recogniser: RecogniserFactory, recursive: bool) -> DataFrame:
    """What is recognised in a media file, or in those of a folder."""
    found = media.discover_media(spark, path, recursive) if os.path.isdir(path) else media.media_files(spark, [path])
    if not found.take(1):
        raise FileNotFoundError(f"no media at {path}")
    # Recognition is slow: every item may be a task.
    return media.transcribe(found.repartition("path"), recogniser, recognition_params(config["recogniser"]))


def main(given: list[str] | None = None) -> int:
    own = arguments(given)
    try:
        config = load_config(own.config, own.local)
        recogniser = factory(own.recogniser) if own.recogniser else None
    except (OSError, ValueError, ImportError, AttributeError) as error:
        print(error, file=sys.stderr)
        return 1
    if not validate_llm_requirements(config):
        print("the configured text model is not available", file=sys.stderr)
        return 1
    if not own.paths and not recogniser:
        print("name transcripts, or a recogniser", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("cuewise").getOrCreate()
    out, failed = own.output_dir or config["output_directory"], 0
    for name, on in Pipeline(config, recogniser).describe():
        print(f"{'on ' if on else 'off'} {name}")
    for path in own.paths or [os.getcwd()]:
        try:
            segments = heard(spark, path, config, recogniser, own.recursive) if recogniser else media.read_transcripts(spark, path, own.format)
            status = run(Pipeline(config, recogniser, details=own.details), segments, out, own.portions)
            rows = status.groupBy("status").count().collect()
            print(f"done {path}: " + ", ".join(f"{r['count']} {r['status']}" for r in sorted(rows, key=lambda r: r["status"])))
            failed += sum(r["count"] for r in rows if r["status"] == "failed")
        except (PySparkException, OSError) as error:
            failed += 1
            print(f"failed {path}: {error}", file=sys.stderr)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
