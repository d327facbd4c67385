"""Command line: ``python -m halyard serve | import | calibrate | help``."""

from __future__ import annotations

import argparse
import sys

from halyard.session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("halyard")
    sub = p.add_subparsers(dest="command")
    for name in ("serve", "import", "calibrate", "help"):
        c = sub.add_parser(name)
        c.add_argument("--data", default="./data")
        c.add_argument("--port", type=int, default=8787)
        c.add_argument("--file")
        # given only where stated: an open store keeps its own
        for flag, kind in (("dim", int), ("metric", str), ("m", int), ("ef-construction", int), ("quantization", str), ("pq-subspaces", int)):
            c.add_argument(f"--{flag}", type=kind)
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.command in (None, "help"):
        p.print_help()
        return 0
    from halyard.sources import jsonl
    from halyard.streaming.store import VectorStore

    spark = local_session("*", "halyard")
    given = {k: v for k in ("dim", "metric", "m", "ef_construction", "quantization", "pq_subspaces") if (v := getattr(a, k)) is not None}
    store = VectorStore(spark, a.data, **given)
    try:
        if a.command == "import":
            print(f"imported {store.upsert(jsonl.read(spark, a.file))}")
            store.checkpoint()
        elif a.command == "calibrate":
            store.calibrate()
            print(f"coded {store.sizes()['live']} vectors as {store.options.quantization}")
        else:
            from halyard.server import Server

            server = Server(store, port=a.port)
            print(server.url, flush=True)
            server.thread.join()
    finally:
        store.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
