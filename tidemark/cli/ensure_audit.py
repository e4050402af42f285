"""Sets up audit capture for a contract's table."""

from __future__ import annotations

import argparse
import sys

from tidemark.admin import psycopg2_connection
from tidemark.admin.audit import MODES, ensure_audit_capture
from tidemark.cli import add_connection_options, add_contract_options, add_output_options, connection_of, contract_from, run_main, write_json

connect = psycopg2_connection


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark-ensure-audit", description=__doc__)
    add_connection_options(p)
    p.add_argument("--source-table", required=True)
    p.add_argument("--audit-table", required=True)
    p.add_argument("--watermark-mode", choices=MODES, default="auto")
    p.add_argument("--replace-trigger", action="store_true")
    add_contract_options(p)
    add_output_options(p)
    return p


def run(args: argparse.Namespace) -> None:
    contract = contract_from(args)
    write_json(ensure_audit_capture(connection_of(args, connect), args.source_table, args.audit_table, contract, args.watermark_mode, args.replace_trigger).to_dict(), args.pretty)


def main(argv: list[str] | None = None) -> int:
    return run_main(parser, run, argv)


if __name__ == "__main__":
    sys.exit(main())
