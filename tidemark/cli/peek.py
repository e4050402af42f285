"""Shows the next changes of a replication slot without taking them."""

from __future__ import annotations

import argparse
import sys

from tidemark.admin import psycopg2_connection
from tidemark.admin.cdc import peek_messages, slot_info
from tidemark.cli import add_connection_options, add_output_options, connection_of, run_main, write_json, write_lines
from tidemark.sources.pgoutput import decode_all

connect = psycopg2_connection


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark-peek", description=__doc__)
    add_connection_options(p)
    p.add_argument("--slot", required=True)
    p.add_argument("--publication", required=True)
    p.add_argument("--table", "--source-table")
    p.add_argument("--messages", action="store_true", help="also messages that applications wrote to the log")
    p.add_argument("--limit", type=int, default=100, help="messages to look at")
    p.add_argument("--info", action="store_true", help="only the slot's state")
    add_output_options(p)
    return p


def run(args: argparse.Namespace) -> None:
    conn = connection_of(args, connect)
    if args.info:
        write_json(slot_info(conn, args.slot), args.pretty)
        return
    messages = peek_messages(conn, args.slot, args.publication, args.limit, args.messages)
    events = list(decode_all(messages, args.table))
    write_lines(events, args.pretty)
    if messages and not events:
        print("no whole transaction within the limit", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    return run_main(parser, run, argv)


if __name__ == "__main__":
    sys.exit(main())
