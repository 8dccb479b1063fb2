"""Where policies come from: a file that is read again when it changes, and a server; where reports go."""

from __future__ import annotations

import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass

from ..config import POLICY_BYTES, ScanConfig, from_env, parse_policy

REMOTE_BYTES, REDIRECTS, SECONDS = 256 << 10, 5, 10


class PolicyFile:
    """The configuration in force: the environment over the policy file over `base`. The file is read again
    when its time or size changes; one that can't be read or is refused leaves the last good one in force.

    Call it at each micro-batch: `redact_stream(lines, PolicyFile(path, base), sink)`."""

    def __init__(self, path: str, base: ScanConfig, env: Mapping[str, str] | None = None):
        self.path, self.env = path, os.environ if env is None else env
        self.base, self.warnings = from_env(self.env, base)
        self.config, self.revision, self.seen = self.base, "", None
        self.loads = self.refusals = 0

    def check(self) -> bool:
        """Whether a new policy came into force."""
        try:
            now = os.stat(self.path)
            if self.seen == (now.st_mtime_ns, now.st_size):
                return False
            self.seen = now.st_mtime_ns, now.st_size
            with open(self.path, "rb") as f:
                text = f.read(POLICY_BYTES + 1).decode()
        except OSError:
            return False
        except UnicodeDecodeError:
            self.refusals += 1
            return False
        try:
            config, revision = parse_policy(text, self.base)
        except ValueError:
            self.refusals += 1
            return False
        self.config, self.warnings = from_env(self.env, config)
        self.revision, self.loads = revision, self.loads + 1
        return True

    def __call__(self) -> ScanConfig:
        self.check()
        return self.config


@dataclass(frozen=True)
class Fetched:
    """body: the policy, or None where it is unchanged."""

    body: str | None
    etag: str


class _Redirects(urllib.request.HTTPRedirectHandler):
    """Follows few redirects, never to plain HTTP from HTTPS, and none that would take the token to another host."""

    max_redirections = REDIRECTS

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        old, new = urllib.parse.urlsplit(req.full_url), urllib.parse.urlsplit(newurl)
        if (old.scheme == "https" and new.scheme != "https") or old.netloc != new.netloc:
            raise urllib.error.HTTPError(newurl, code, "redirect refused", headers, fp)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


class _NoRedirects(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def fetch_policy(url: str, token: str = "", etag: str = "", plain: bool = False) -> Fetched:
    """A policy from a server, on the driver. `etag` of the last one spares an unchanged body. OSError or
    ValueError for anything but a good answer. plain: whether HTTP without TLS is allowed."""
    if not plain and not url.startswith("https://"):
        raise ValueError("a policy comes over https")
    request = urllib.request.Request(url, headers={**({"Authorization": f"Bearer {token}"} if token else {}), **({"If-None-Match": etag} if etag else {})})
    try:
        with urllib.request.build_opener(_Redirects).open(request, timeout=SECONDS) as answer:
            raw = answer.read(REMOTE_BYTES + 1)
            if len(raw) > REMOTE_BYTES:
                raise ValueError("the policy is too large")
            return Fetched(raw.decode(), answer.headers.get("ETag", ""))
    except urllib.error.HTTPError as e:
        if e.code == 304:
            return Fetched(None, etag)
        raise


def send_report(url: str, body: str, token: str = "", plain: bool = False) -> int:
    """A report to its receiver: the status, which is 200 to 299, or an OSError. Redirects aren't followed."""
    if not plain and not url.startswith("https://"):
        raise ValueError("a report goes over https")
    request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json", **({"Authorization": f"Bearer {token}"} if token else {})})
    with urllib.request.build_opener(_NoRedirects).open(request, timeout=SECONDS) as answer:
        return answer.status
