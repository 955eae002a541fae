"""Command line: serve, search, fetch, opml and version.

``python -m millrace <command> --help`` lists the options; options may stand before or after arguments.
"""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
import threading
from types import SimpleNamespace

from millrace import VERSION
from millrace.sources import config, opml


class CommandError(Exception):
    pass


def _session():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _refresher(c: config.Config, path: str | None):
    from millrace.streaming.refresh import Refresher

    return Refresher(_session(), c, path or f"file://{tempfile.mkdtemp(prefix='millrace-')}")


def serve(args) -> None:
    from millrace.streaming.service import Service
    from millrace.streaming.service import serve as bound

    c = config.read(args.config)
    c.addr, c.refresh = args.addr or c.addr, config.duration(args.refresh) or c.refresh
    refresher = _refresher(c, args.path)
    threading.Thread(target=refresher.run, daemon=True).start()
    host, _, port = c.addr.rpartition(":")
    server = bound(Service.of(refresher), host, int(port))
    if not args.quiet:
        print(f"listening on {c.addr}, merging {len(c.feeds)} feeds every {c.refresh:g} s", file=sys.stderr)
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        server.shutdown()


def search(args) -> str:
    from millrace.operators.search import hits, parse_query
    from millrace.streaming.service import Service, hit_json, printed_hits

    query = " ".join(args.query).strip()
    if not query:
        raise CommandError("search requires a query")
    if not parse_query(query):
        raise CommandError(f"query {query!r} has no searchable terms")
    refresher = _refresher(config.read(args.config), args.path)
    if not refresher.refresh():
        raise CommandError(refresher.error)
    frame = Service.of(refresher)._frame()
    found, indexed = hits(frame, query, args.limit).collect(), len(refresher.snapshots.current)
    if args.format == "json":
        return json.dumps({"query": query, "indexed": indexed, "total": len(found), "results": [hit_json(e) for e in found]}, indent=2, ensure_ascii=False) + "\n"
    return printed_hits(query, indexed, found)


def fetch(args) -> str:
    from millrace.functions.dates import parsed_date
    from millrace.sources import feeds, render
    from millrace.sources.fetch import fetch as get
    from millrace.streaming.service import printed_entries

    if not args.url.startswith(("http://", "https://")):
        raise CommandError(f"url must start with http:// or https://: {args.url!r}")
    got = get(args.url, config.duration(args.timeout))
    if got["error"]:
        raise CommandError(got["error"])
    try:
        kind, head, _ = feeds.parsed_document(got["body"], got["final_url"])
    except ValueError as e:
        raise CommandError(str(e)) from e
    spark = _session()
    row = spark.createDataFrame([(0, args.url, got["final_url"], got["status"], bytearray(got["body"]))], "source_pos long, url string, final_url string, status int, body binary")
    found = feeds.entries(row).orderBy("seq").collect()
    shown = found[: args.limit] if args.limit > 0 else found
    if args.format == "summary":
        return printed_entries({"format": kind, "status": got["status"], "title": head["source_title"]}, shown)
    return {"rss": render.rss, "atom": render.atom, "json": render.json_feed}[args.format](render.Meta(head["source_title"], args.url, "", args.url), shown)


def opml_import(args) -> str:
    body = sys.stdin.buffer.read() if args.file == "-" else open(args.file, "rb").read()
    rows = opml.parse(body)
    if args.folder:
        rows = [r for r in rows if r["folder"] == args.folder or r["folder"].startswith(args.folder + "/")]
        if not rows:
            raise CommandError(f"no feeds under folder {args.folder!r}")
    return opml.as_config(rows, args.title)


def opml_export(args) -> str:
    c = config.read(args.config)
    rows = [{"name": f["name"], "url": f["url"], "site_url": "", "folder": ""} for f in c.feeds]
    return opml.rendered([SimpleNamespace(folder="", feeds=rows)], c.title)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, within=commands, **options):
        p = within.add_parser(name)
        p.set_defaults(run=run)
        for flag, kind in options.items():
            p.add_argument(f"--{flag}", **kind)
        return p

    configured = {"config": {"default": "feeds.yaml"}, "path": {"default": None, "help": "folder for documents and the fetch log"}}
    command("serve", serve, **configured, addr={"default": ""}, refresh={"default": ""}, quiet={"action": "store_true"})
    command("search", search, **configured, limit={"type": int, "default": 10}, format={"choices": ("text", "json"), "default": "text"}).add_argument("query", nargs="*")
    command("fetch", fetch, timeout={"default": "20s"}, limit={"type": int, "default": 0}, format={"choices": ("summary", "rss", "atom", "json"), "default": "summary"}).add_argument("url")
    lists = commands.add_parser("opml").add_subparsers(dest="direction", required=True)
    command("import", opml_import, lists, title={"default": ""}, folder={"default": ""}).add_argument("file")
    command("export", opml_export, lists, config={"default": "feeds.yaml"})
    command("version", lambda _: f"millrace {VERSION}\n")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        sys.stdout.write(args.run(args) or "")
    except (CommandError, config.ConfigError, OSError, ValueError) as e:
        print(f"millrace: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
