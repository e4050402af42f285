"""Fetching contracts over HTTP, with retries; sessions and sleeping can be replaced."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from tidemark.contract.model import Contract, ContractPayloadError, parse_registry_payload

#: HTTP statuses after which a request is tried again (fixed values).
RETRY_STATUS = (408, 425, 429, 500, 502, 503, 504)


class RegistryError(RuntimeError):
    """A registry couldn't be asked."""


class RegistryRequestError(RegistryError):
    """No answer came: timeout, refused or broken connection."""


class RegistryHTTPError(RegistryError):
    def __init__(self, message: str, status: int, endpoint: str):
        super().__init__(message)
        self.status, self.endpoint = status, endpoint


@dataclass
class Response:
    status: int
    body: bytes


def http_get(url: str, headers: dict[str, str], timeout: float) -> Response:
    """One GET; OSError (or its kin) when there is no answer."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return Response(r.status, r.read())
    except urllib.error.HTTPError as e:
        return Response(e.code, e.read())


class ContractRegistry:
    def __init__(
        self,
        base_url: str,
        timeout: float = 30,
        max_retries: int = 3,
        backoff: float = 0.5,
        max_backoff: float = 8,
        token: str | None = None,
        token_provider: Callable[[], str] | None = None,
        get: Callable[[str, dict[str, str], float], Response] = http_get,
        sleep: Callable[[float], None] = time.sleep,
    ):
        self.base_url, self.timeout, self.max_retries = base_url.rstrip("/"), timeout, max_retries
        self.backoff, self.max_backoff = backoff, max_backoff
        self.token, self.token_provider, self.get, self.sleep = token, token_provider, get, sleep

    def fetch(self, namespace: str, name: str, version: str | None = None) -> Contract:
        """The active version, or the one named."""
        return parse_registry_payload(self._json(f"/contracts/{namespace}/{name}/" + (f"version/{version}" if version else "active")))

    def _headers(self) -> dict[str, str]:
        token = self.token if self.token is not None else self.token_provider() if self.token_provider else None
        return {"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})

    def _json(self, endpoint: str) -> Any:
        failure: RegistryError | None = None
        for attempt in range(self.max_retries + 1):
            if attempt:
                self.sleep(min(self.backoff * 2 ** (attempt - 1), self.max_backoff))
            try:
                r = self.get(self.base_url + endpoint, self._headers(), self.timeout)
            except OSError as e:
                failure = RegistryRequestError(f"no answer from {endpoint}: {e}")
                continue
            if r.status < 400:
                try:
                    return json.loads(r.body)
                except ValueError as e:
                    raise ContractPayloadError(f"{endpoint} didn't answer in JSON") from e
            failure = RegistryHTTPError(f"{endpoint} answered {r.status}: {r.body[:500].decode(errors='replace')}", r.status, endpoint)
            if r.status not in RETRY_STATUS:
                break
        assert failure is not None
        raise failure


class FileRegistry:
    """Contracts from a folder: ``{namespace}/{name}/{version or active}.json``."""

    def __init__(self, root: str):
        self.root = root

    def fetch(self, namespace: str, name: str, version: str | None = None) -> Contract:
        with open(f"{self.root}/{namespace}/{name}/{version or 'active'}.json", encoding="utf-8") as f:
            return parse_registry_payload(json.load(f))
