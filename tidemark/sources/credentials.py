"""Temporary object-store credentials: client credentials to a web identity to a session."""

from __future__ import annotations

import datetime as dt
import json
import ssl
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import SparkSession

Post = Callable[[str, dict[str, str], float], tuple[int, bytes]]


class ExchangeError(RuntimeError):
    """The token or the session wasn't given."""


@dataclass(frozen=True)
class ClientCredentials:
    token_url: str
    client_id: str
    client_secret: str
    scope: str | None = None
    audience: str | None = None
    timeout: float = 30
    verify_tls: bool = True


@dataclass(frozen=True)
class WebIdentity:
    sts_url: str
    role_arn: str | None = None
    session_name: str = "ingestion"
    seconds: int = 3600
    timeout: float = 30
    verify_tls: bool = True


@dataclass(frozen=True)
class TemporaryCredentials:
    access_key: str
    secret_key: str
    session_token: str
    expires_at: dt.datetime | None


def http_post(url: str, form: dict[str, str], timeout: float, verify_tls: bool = True) -> tuple[int, bytes]:
    """One POST of a form; without ``verify_tls`` any certificate is accepted (test set-ups)."""
    context = None if verify_tls else ssl._create_unverified_context()
    req = urllib.request.Request(url, data=urllib.parse.urlencode(form).encode(), headers={"Content-Type": "application/x-www-form-urlencoded"})
    try:
        with urllib.request.urlopen(req, timeout=timeout, context=context) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


def _answer(post: Post, url: str, form: dict[str, str], timeout: float, what: str) -> bytes:
    try:
        status, body = post(url, form, timeout)
    except OSError as e:
        raise ExchangeError(f"{what}: no answer: {e}") from e
    if status >= 400:
        raise ExchangeError(f"{what}: HTTP {status}: {body[:300].decode(errors='replace')}")
    return body


def access_token(c: ClientCredentials, post: Post | None = None) -> str:
    post = post or partial(http_post, verify_tls=c.verify_tls)
    form = {"grant_type": "client_credentials", "client_id": c.client_id, "client_secret": c.client_secret}
    form |= {k: v for k, v in (("scope", c.scope), ("audience", c.audience)) if v}
    try:
        token = json.loads(_answer(post, c.token_url, form, c.timeout, "token")).get("access_token")
    except ValueError as e:
        raise ExchangeError("token: the answer isn't JSON") from e
    if not token:
        raise ExchangeError("token: the answer holds no access_token")
    return str(token)


def assume_role(w: WebIdentity, token: str, post: Post | None = None) -> TemporaryCredentials:
    post = post or partial(http_post, verify_tls=w.verify_tls)
    form = {"Action": "AssumeRoleWithWebIdentity", "Version": "2011-06-15", "WebIdentityToken": token, "DurationSeconds": str(w.seconds), "RoleSessionName": w.session_name}
    form |= {"RoleArn": w.role_arn} if w.role_arn else {}
    try:
        root = ET.fromstring(_answer(post, w.sts_url, form, w.timeout, "session"))
    except ET.ParseError as e:
        raise ExchangeError("session: the answer isn't XML") from e
    found = {e.tag.rpartition("}")[2]: (e.text or "").strip() for e in root.iter()}
    if missing := [k for k in ("AccessKeyId", "SecretAccessKey", "SessionToken") if not found.get(k)]:
        raise ExchangeError(f"session: the answer lacks {', '.join(missing)}")
    until = found.get("Expiration")
    return TemporaryCredentials(found["AccessKeyId"], found["SecretAccessKey"], found["SessionToken"], dt.datetime.fromisoformat(until.replace("Z", "+00:00")) if until else None)


def exchange(c: ClientCredentials, w: WebIdentity, post: Post | None = None) -> TemporaryCredentials:
    return assume_role(w, access_token(c, post), post)


def use_for_s3a(spark: SparkSession, t: TemporaryCredentials, endpoint: str | None = None) -> None:
    """Hands the credentials to the session's s3a file system."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k, v in {"access.key": t.access_key, "secret.key": t.secret_key, "session.token": t.session_token, "aws.credentials.provider": "org.apache.hadoop.fs.s3a.TemporaryAWSCredentialsProvider", "endpoint": endpoint}.items():
        if v:
            conf.set(f"fs.s3a.{k}", v)
