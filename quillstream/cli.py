"""python -m quillstream.cli: run over a folder of page images or stored observations, check a list of identifiers, show settings."""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import sys
import time

from pyspark.sql import functions as F

from quillstream import logs
from quillstream.config import ConfigError, Settings, load_settings
from quillstream.operators.vocabulary import VocabularyError


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quillstream", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="observations and pages (Parquet) to markers, flags and documents")
    run.add_argument("observations")
    run.add_argument("pages")
    run.add_argument("questions")
    run.add_argument("--out", required=True)
    scan = commands.add_parser("scan", help="page images, named <script>-P<number>, to all that run writes")
    scan.add_argument("images")
    scan.add_argument("questions")
    scan.add_argument("--out", required=True)
    scan.add_argument("--engine", default="scripted")
    scan.add_argument("--detector", default="scripted")
    scan.add_argument("--overlays", action="store_true", help="write a picture of each page as well")
    for command in (run, scan):
        command.add_argument("--report", action="store_true", help="print pages, markers and flags of every script")
    check = commands.add_parser("validate-questions")
    check.add_argument("questions")
    show = commands.add_parser("show-config")
    for command in (run, scan, check, show):
        command.add_argument("--config")
        command.add_argument("--set", action="append", default=[], metavar="section.name=value")
    return parser


def _settings(args: argparse.Namespace) -> Settings:
    overrides: dict = {}
    for item in args.set:
        path, _, value = item.partition("=")
        at = overrides
        *parts, last = path.split(".")
        for part in parts:
            at = at.setdefault(part, {})
        try:
            at[last] = json.loads(value)
        except ValueError:
            at[last] = value
    return load_settings(args.config, overrides)


def finish(spark, seen, sheets, words, rules, out: str, settings: Settings, engine, shown: bool) -> int:
    """Writes markers, flags, documents and a manifest below out; 0, or 1 if a page has failed or none is there.

    Only the scripts of this run are replaced in what out holds already. shown: prints their report.
    """
    from quillstream.operators import consolidate
    from quillstream.plans import markers, report
    from quillstream.sources import sinks

    began, log = time.time(), logs.configure(settings.app.log_level, settings.app.log_format)
    version = settings.processing_version()
    done = markers.assembled(markers.classified(seen, sheets, words, settings), sheets, settings, engine)
    sinks.write_markers(done, f"{out}/automatic")  # the checks across pages read a finished table
    mine = sheets.select("script_id").distinct()
    done = spark.read.parquet(f"{out}/automatic").where(f"processing_version = '{version}'").drop("script_bucket").join(mine, "script_id", "left_semi")
    final = consolidate.flagged(done, words, rules)
    sinks.write_markers(final, f"{out}/markers")
    flags = consolidate.script_flags(sheets, done, words, rules)
    sinks.replace_scripts(flags.withColumn("processing_version", F.lit(version)), f"{out}/flags")
    flags = spark.read.parquet(f"{out}/flags").where(f"processing_version = '{version}'").select("script_id", "flags", "flag_details").join(mine, "script_id", "left_semi")
    counted = consolidate.page_counts(sheets.drop("work_to_canonical", "band_ink", "layout"), final)
    sinks.write_documents(sinks.script_documents(counted, final, flags), f"{out}/documents", version)
    sinks.run_manifest(spark, settings, engine, False, time.time() - began).write.mode("append").json(f"{out}/manifest")
    for row in report.status_counts(final).collect():  # one row for each status
        log.info("%s: %d", row["status"], row["n"])
    if shown:
        last = None
        for row in report.script_report(counted, final, flags).toLocalIterator():  # line by line, not all at once
            if row["script_id"] != last:
                last = row["script_id"]
                print(f"SCRIPT {last}")
            print(("  " if row["line"] != row["part"] else "") + row["line"])
    return report.exit_code(sheets)


def run(spark, observations: str, pages: str, questions: str, out: str, settings: Settings, shown: bool = False) -> int:
    """From stored observations and pages."""
    from quillstream.operators import vocabulary
    from quillstream.plans import markers
    from quillstream.sources import files

    entries, rules = files.vocabulary_file(spark, questions)
    words = vocabulary.validated(entries, rules)
    return finish(spark, spark.read.parquet(observations), spark.read.parquet(pages), words, rules, out, settings, markers.Engine(), shown)


def scan(
    spark, images: str, questions: str, out: str, settings: Settings, engine: str = "scripted", detector: str = "scripted",
    shown: bool = False, overlays: bool = False, engine_options: dict | None = None, detector_options: dict | None = None,
) -> int:
    """From a folder of page images. Pages whose role excludes them are never decoded; facts are held below out."""
    from quillstream.image import overlay
    from quillstream.operators import vocabulary
    from quillstream.plans import markers
    from quillstream.plans import scan as plan
    from quillstream.sources import files, sinks

    entries, rules = files.vocabulary_file(spark, questions)
    words = vocabulary.validated(entries, rules)
    exam = entries.select("exam_id").first()["exam_id"]
    read, skipped = markers.pruned(markers.with_roles(files.page_images(spark, images), settings))
    files.decoded(read, "image", settings.render_dpi, settings.app.max_attempts).write.mode("overwrite").parquet(f"{out}/work/decoded")
    decoded = spark.read.parquet(f"{out}/work/decoded")
    plan.page_facts(decoded, settings).write.mode("overwrite").parquet(f"{out}/work/facts")
    facts = spark.read.parquet(f"{out}/work/facts")
    seen = plan.observations(facts, settings, engine, exam, detector, engine_options, detector_options)
    page = ["script_id", "page_index"]
    known = facts.select(*page, "is_colour", "layout", "band_ink", "work_to_canonical", "content_class")
    sheets = decoded.drop("image").join(known, page, "left").join(read.select(*page, "page_role"), page)
    sheets = sheets.unionByName(skipped.drop("content"), allowMissingColumns=True).withColumn("exam_id", F.lit(exam))
    code = finish(spark, seen, sheets, words, rules, out, settings, markers.Engine(engine), shown)
    if overlays:
        final = spark.read.parquet(f"{out}/markers").where(f"processing_version = '{settings.processing_version()}'")
        sinks.write_images(overlay.pictures(decoded, facts, final), out if "://" in out else f"file://{os.path.abspath(out)}")
    return code


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        settings = _settings(args)
        if args.command == "show-config":
            print(json.dumps(dataclasses.asdict(settings), indent=2, default=str))
            return 0
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if args.command == "run":
            return run(spark, args.observations, args.pages, args.questions, args.out, settings, args.report)
        if args.command == "scan":
            return scan(spark, args.images, args.questions, args.out, settings, args.engine, args.detector, args.report, args.overlays)
        from quillstream.operators import vocabulary
        from quillstream.sources import files

        for r in vocabulary.validated(*files.vocabulary_file(spark, args.questions)).orderBy("ord").collect():  # a list of some hundred
            print(r["canonical"], "target" if r["is_target"] else "parent", ",".join(r["segment_types"]), ",".join(r["confusable_with"]))
        return 0
    except (ConfigError, VocabularyError) as error:
        print(error, file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
