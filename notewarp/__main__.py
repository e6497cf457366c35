"""Command line: `python -m notewarp --store PATH COMMAND ...`; results are JSON lines, errors end with status 2."""

from __future__ import annotations

import argparse
import json
import sys


def _positive(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("must be positive")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="notewarp")
    p.add_argument("--store", help="folder of the versioned tables; by default NOTEWARP_STORE or a folder of the user's")
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    sync = sub.add_parser("sync")
    sync.add_argument("feed", help="Parquet of the feed")
    sync.add_argument("--reconcile", action="store_true")
    sync.add_argument("--folder-id")
    work = sub.add_parser("process")
    work.add_argument("details", help="Parquet of the notes' details")
    work.add_argument("--extractor", help="module:function(title, evidence_json, ontology_json); by default the configured model")
    work.add_argument("--limit", type=_positive)
    work.add_argument("--max-attempts", type=_positive, default=5)
    explore = sub.add_parser("explore")
    explore.add_argument("--port", type=int, default=8765)
    explore.add_argument("--no-open", action="store_true")
    setup = sub.add_parser("install")
    setup.add_argument("--skills-dir", required=True)
    setup.add_argument("--force", action="store_true")
    sub.add_parser("reindex")
    again = sub.add_parser("reprocess")
    which = again.add_mutually_exclusive_group(required=True)
    which.add_argument("note_id", nargs="?")
    which.add_argument("--all", action="store_true")
    sub.add_parser("status")
    sub.add_parser("types")
    search = sub.add_parser("search")
    search.add_argument("query")
    search.add_argument("--type", action="append", default=[])
    search.add_argument("--limit", type=_positive, default=20)
    entity = sub.add_parser("entity")
    entity.add_argument("entity_id")
    evidence = sub.add_parser("evidence")
    evidence.add_argument("evidence_id")
    walk = sub.add_parser("traverse")
    walk.add_argument("entity_id")
    walk.add_argument("--depth", type=_positive, default=2)
    walk.add_argument("--limit", type=_positive, default=100)
    return p


def _extractor(named: str | None, settings):
    """The function that is named, or a client of the configured model."""
    if named:
        import importlib

        module, _, name = named.partition(":")
        return getattr(importlib.import_module(module), name)
    from notewarp.sources.completion import Completion

    if not settings.model:
        raise ValueError("set NOTEWARP_MODEL or name an extractor")
    return Completion(settings.model, settings.base_url, settings.model_key, settings.max_input_tokens)


def _explore(engine, args: argparse.Namespace) -> None:
    from notewarp.serve import explorer

    server = explorer(engine, args.port)
    address = f"http://{server.server_address[0]}:{server.server_address[1]}/"
    print(address, file=sys.stderr)
    if not args.no_open:
        import webbrowser

        webbrowser.open(address)
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        server.server_close()


def run(args: argparse.Namespace, engine, settings) -> list:
    """The results of a command as JSON values."""
    rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]  # noqa: E731 - limited results
    if args.command == "init":
        return [{"version": engine.init()}]
    if args.command == "sync":
        return [engine.sync(engine.spark.read.parquet(args.feed), reconcile=args.reconcile, folder_id=args.folder_id)]
    if args.command == "process":
        return [engine.process(engine.spark.read.parquet(args.details), _extractor(args.extractor, settings), limit=args.limit, max_attempts=args.max_attempts, prompt_version=settings.prompt_version, model_name=settings.model or "", max_input_tokens=settings.max_input_tokens)]
    if args.command == "reindex":
        engine.reindex()
        return [engine.status()]
    if args.command == "explore":
        _explore(engine, args)
        return []
    if args.command == "reprocess":
        engine.reprocess(None if args.all else [args.note_id])
        return [engine.status()]
    if args.command == "status":
        return [engine.status()]
    if args.command == "types":
        return rows(engine.entity_types())
    if args.command == "search":
        return rows(engine.search(args.query, type_keys=tuple(args.type), limit=args.limit))
    if args.command == "entity":
        return rows(engine.entity(args.entity_id))
    if args.command == "evidence":
        return rows(engine.evidence(args.evidence_id))
    return rows(engine.traverse(args.entity_id, depth=args.depth, limit=args.limit))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from notewarp.settings import load

    try:
        settings = load(args.store)
        if args.command == "install":
            from notewarp.install import install

            print(install(args.skills_dir, force=args.force))
            return 0
        from notewarp.plans.engine import Engine
        from notewarp.session import build_session

        engine = Engine(build_session(args.master), settings.store)
        for value in run(args, engine, settings):
            print(json.dumps(value, sort_keys=True, indent=2, default=str, ensure_ascii=False))
        engine.close()
    except Exception as error:  # noqa: BLE001
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
