"""``python -m siltstone run|search|quality|copy|maintenance``: exit code 2 for structural findings, 3 for copy failures."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from siltstone.archive import Archive, hashed_words
from siltstone.operators import reports
from siltstone.operators.store import load_ref
from siltstone.sources.providers import http_provider
from siltstone.sources.requests import Request

#: Failures that a report lists; it counts all of them.
LISTED = 1_000


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siltstone")
    parser.add_argument("--archive", required=True, help="folder of the archive's tables")
    parser.add_argument("--refs", required=True, help="local folder of reference documents")
    parser.add_argument("--ref-name", default="main")
    parser.add_argument("--dims", type=int, default=384)
    parser.add_argument("--embed-url", help="embedding service; without one, words are hashed")
    parser.add_argument("--embed-model", default="")
    parser.add_argument("--embed-key-env", help="environment variable that holds the service's key")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.add_argument("--documents")
    run.add_argument("--mailboxes")
    run.add_argument("--method", default="kmeans")
    run.add_argument("--validate-only", action="store_true")
    find = commands.add_parser("search")
    find.add_argument("query")
    find.add_argument("--k", type=int, default=5)
    find.add_argument("--width", type=int, default=3)
    judge = commands.add_parser("quality")
    copy = commands.add_parser("copy")
    copy.add_argument("destination")
    copy.add_argument("--blind-write", action="store_true")
    for command in (find, judge, copy):
        command.add_argument("--report", nargs="?", const="", help="also write a JSON report there, or under its default name")
    commands.add_parser("maintenance").add_argument("action", choices=["compact", "vacuum"])
    args = parser.parse_args(argv)
    request = Request(args.ref_name, getattr(args, "documents", None), getattr(args, "mailboxes", None), args.dims, method=getattr(args, "method", "kmeans"), stages=("ingest", "cluster") if args.command == "run" else ("cluster",)).check()
    if getattr(args, "validate_only", False):
        return 0
    archive = Archive(SparkSession.builder.getOrCreate(), args.archive, args.refs)
    key = os.environ[args.embed_key_env] if args.embed_key_env else None
    provider = http_provider(args.embed_url, args.embed_model, args.dims, key) if args.embed_url else hashed_words(args.dims)
    root = load_ref(args.refs, request.ref_name)["current_root_block_id"]
    if args.command == "run":
        new = archive.ingest(request, provider)
        print(json.dumps({"new_items": new, "root_id": archive.build(request)}))
    elif args.command == "maintenance":
        print(json.dumps(archive.compact() if args.action == "compact" else archive.vacuum()))
    elif args.command == "search":
        found = archive.search_chunks(args.query, provider, root, args.k, args.width)
        report = {"root_id": root, "query": args.query, "top_k": args.k, "traversal_width": args.width, **found}
        _tell(args.report, reports.search_report_name(root, args.query), report, reports.search_summary)
        print(json.dumps(found))
    elif args.command == "quality":
        parts = archive.quality(root)
        report = {name: [r.asDict(recursive=True) for r in parts[name].collect()] for name in ("findings", "layers", "access", "recall_report")}
        whole = report | {"root_id": root, "blocks": archive.tree(root).blocks.count(), "recall": report["recall_report"]}
        _tell(args.report, reports.quality_report_name(root), whole, reports.quality_summary)
        print(json.dumps(report))
        return 2 if report["findings"] else 0
    else:
        counts = archive.copy([root], args.destination, not args.blind_write).first().asDict()
        failures = [r.asDict() for r in archive.copy_failures([root]).orderBy("block_id").limit(LISTED).collect()] if counts["failed"] else []
        report = counts | {"roots": [root], "read_before_write": not args.blind_write, "failures": failures}
        _tell(args.report, reports.copy_report_name([root]), report, reports.copy_summary)
        print(json.dumps(counts))
        return 3 if counts["failed"] else 0
    return 0


def _tell(path: str | None, name: str, report: dict, summary) -> None:
    """With ``--report``: write the report and print its summary to the error stream."""
    if path is not None:
        print(summary(report), reports.write_report(path or name, report), sep="\n", file=sys.stderr)


if __name__ == "__main__":
    sys.exit(main())
