"""Sets up logical replication for a table."""

from __future__ import annotations

import argparse
import sys

from tidemark.admin import psycopg2_connection
from tidemark.admin.cdc import IDENTITIES, ensure_cdc_capture
from tidemark.cli import add_connection_options, add_output_options, connection_of, run_main, write_json

connect = psycopg2_connection


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark-ensure-cdc", description=__doc__)
    add_connection_options(p)
    p.add_argument("--source-table", required=True)
    p.add_argument("--publication", required=True)
    p.add_argument("--slot", required=True)
    p.add_argument("--replica-identity", choices=IDENTITIES, default="default")
    p.add_argument("--replace-publication", action="store_true")
    p.add_argument("--no-create-slot", action="store_true")
    p.add_argument("--write-settings", action="store_true")
    p.add_argument("--max-replication-slots", type=int, default=10)
    p.add_argument("--max-wal-senders", type=int, default=10)
    add_output_options(p)
    return p


def run(args: argparse.Namespace) -> None:
    done = ensure_cdc_capture(
        connection_of(args, connect), args.source_table, args.publication, args.slot, replace_publication=args.replace_publication, create_slot=not args.no_create_slot,
        replica_identity=args.replica_identity, write_settings=args.write_settings, slots=args.max_replication_slots, senders=args.max_wal_senders,
    )
    write_json(done.to_dict(), args.pretty)


def main(argv: list[str] | None = None) -> int:
    return run_main(parser, run, argv)


if __name__ == "__main__":
    sys.exit(main())
