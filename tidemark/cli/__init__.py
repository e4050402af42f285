"""Command lines: ``python -m tidemark.cli.peek``, ``.ensure_audit``, ``.ensure_cdc``.

They write one JSON object (or lines of them) and exit with 0; failures are told on stderr
with exit code 1, wrong usage with 2.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable, Iterable
from typing import Any

from tidemark.contract.model import Contract, load_contract_file
from tidemark.contract.registry import ContractRegistry
from tidemark.sources.credentials import ClientCredentials, access_token


class CliError(ValueError):
    """Something the caller has to put right."""


def add_output_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--pretty", action="store_true", help="indent the JSON")


def add_contract_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--contract-file")
    p.add_argument("--registry-url", "--contracts-service-url")
    for name in ("namespace", "name", "contract-version"):
        p.add_argument(f"--{name}")
    for name in ("token", "oidc-token-url", "oidc-client-id", "oidc-client-secret", "oidc-scope"):
        p.add_argument(f"--{name}", "--contracts-" + name.replace("token", "access-token", 1) if name == "token" else f"--contracts-{name}")
    p.add_argument("--oidc-no-verify-tls", "--contracts-oidc-no-verify-ssl", action="store_true", help="accept any certificate of the token service")


def add_connection_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--dsn", "--source-admin-dsn", help="or SOURCE_DSN in the environment")
    p.add_argument("--connect-timeout", type=int, default=5, help="seconds")
    p.add_argument("--statement-timeout-ms", type=int, default=10_000)


def connection_of(args: argparse.Namespace, connect: Callable[..., Any]) -> Any:
    """A connection within the limits given."""
    if args.connect_timeout <= 0 or args.statement_timeout_ms <= 0:
        raise CliError("timeouts must be greater than zero")
    return connect(dsn_of(args), args.connect_timeout, args.statement_timeout_ms)


def contract_from(args: argparse.Namespace) -> Contract:
    """From a file or from the registry, never both; a token or OIDC, never both."""
    if args.contract_file:
        if args.registry_url:
            raise CliError("give a contract file or a registry, not both")
        return load_contract_file(args.contract_file)
    if not (args.registry_url and args.namespace and args.name):
        raise CliError("give --contract-file, or --registry-url with --namespace and --name")
    oidc = [args.oidc_token_url, args.oidc_client_id, args.oidc_client_secret]
    if args.token and any(oidc):
        raise CliError("give a token or OIDC options, not both")
    if any(oidc) and not all(oidc):
        raise CliError("OIDC needs a token URL, a client id and a client secret")
    provider = (lambda: access_token(ClientCredentials(*oidc, scope=args.oidc_scope, verify_tls=not args.oidc_no_verify_tls))) if all(oidc) else None
    return ContractRegistry(args.registry_url, token=args.token, token_provider=provider).fetch(args.namespace, args.name, args.contract_version).check()


def dsn_of(args: argparse.Namespace) -> str:
    dsn = args.dsn or os.environ.get("SOURCE_DSN")
    if not dsn:
        raise CliError("give --dsn or set SOURCE_DSN")
    return dsn


def write_json(payload: Any, pretty: bool, out=None) -> None:
    print(json.dumps(payload, sort_keys=True, indent=2 if pretty else None, default=str), file=out or sys.stdout)


def write_lines(rows: Iterable[Any], pretty: bool, out=None) -> None:
    for r in rows:
        write_json(r, pretty, out)


def run_main(build: Callable[[], argparse.ArgumentParser], run: Callable[[argparse.Namespace], None], argv: list[str] | None = None) -> int:
    args = build().parse_args(argv)
    try:
        run(args)
    except Exception as e:  # noqa: BLE001
        print(f"ERROR: {e}", file=sys.stderr)
        return 1
    return 0
