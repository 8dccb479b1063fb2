"""Settings of the scanner: a frozen value, built on the driver and shipped with the UDF."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import secrets
from collections.abc import Mapping
from dataclasses import dataclass

from .functions import vocab

#: Largest policy document, in bytes.
POLICY_BYTES = 4 << 20
NOT_POLICY = {"salt", "fail_policy", "revision"}


@dataclass(frozen=True)
class Rule:
    pattern: str
    name: str = ""


@dataclass(frozen=True)
class ScanConfig:
    salt: str
    entropy_threshold: float = 3.6
    confidence_score: float = 1.0
    min_secret_length: int = 6
    sensitive_keys: tuple[str, ...] = tuple(vocab.SENSITIVE_KEYS)
    sensitive_key_patterns: tuple[str, ...] = ()
    custom_regexes: tuple[Rule, ...] = ()
    safe_regexes: tuple[Rule, ...] = ()
    entity_type_labels: bool = False
    disable_bigram_check: bool = False
    bigram_default_score: float = vocab.BIGRAM_DEFAULT


def _value(name: str, value: object) -> object:
    if name in ("custom_regexes", "safe_regexes"):
        return tuple(Rule(x["pattern"], x.get("name", "")) for x in value)
    return tuple(value) if isinstance(value, list) else value


def from_json(text: str, base: ScanConfig) -> ScanConfig:
    """base with the fields that a JSON object sets; unknown fields are ignored, and text that
    isn't an object leaves base as it is."""
    try:
        data = json.loads(text)
    except ValueError:
        return base
    known = {f.name for f in dataclasses.fields(ScanConfig)}
    return dataclasses.replace(base, **{k: _value(k, v) for k, v in data.items() if k in known and v is not None}) if isinstance(data, dict) else base


_TYPES = {"entropy_threshold": (int, float), "confidence_score": (int, float), "min_secret_length": int, "entity_type_labels": bool, "disable_bigram_check": bool, "bigram_default_score": (int, float)}


def parse_policy(text: str, base: ScanConfig) -> tuple[ScanConfig, str]:
    """A policy document, all or nothing: the settings over base, and its revision. The salt never
    comes from a policy. Raises ValueError for a document that is too large or has a bad field."""
    if len(text.encode()) > POLICY_BYTES:
        raise ValueError("the policy is too large")
    data = json.loads(text)
    if not isinstance(data, dict):
        raise ValueError("a policy is a JSON object")
    fields = {k: v for k, v in data.items() if k.lower() not in NOT_POLICY}
    for k, v in fields.items():
        if k in _TYPES and (not isinstance(v, _TYPES[k]) or isinstance(v, bool) != (_TYPES[k] is bool)):
            raise ValueError(f"bad value of {k}")
        if k in ("sensitive_keys", "sensitive_key_patterns") and not (isinstance(v, list) and all(isinstance(x, str) for x in v)):
            raise ValueError(f"{k} is a list of strings")
        if k in ("custom_regexes", "safe_regexes") and not (isinstance(v, list) and all(isinstance(x, dict) and isinstance(x.get("pattern"), str) for x in v)):
            raise ValueError(f"{k} is a list of patterns")
    known = {f.name for f in dataclasses.fields(ScanConfig)}
    return dataclasses.replace(base, **{k: _value(k, v) for k, v in fields.items() if k in known}), str(data.get("revision", ""))


def canonical(text: str) -> bytes:
    """A policy's fields sorted, without salt, fail policy and revision, numbers as written."""

    def written(x: object) -> str:
        if isinstance(x, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{written(v)}" for k, v in sorted(x.items())) + "}"
        if isinstance(x, list):
            return "[" + ",".join(map(written, x)) + "]"
        return x[1] if isinstance(x, tuple) else json.dumps(x, ensure_ascii=False)

    data = json.loads(text, parse_float=lambda s: ("n", s), parse_int=lambda s: ("n", s))
    return written({k: v for k, v in data.items() if k.lower() not in NOT_POLICY}).encode()


def etag(content: bytes) -> str:
    return f'"{hashlib.sha256(content).hexdigest()[:32]}"'


def merge(remote: dict, local: dict) -> dict:
    """Local fields over remote ones; a list replaces a list."""
    return {**remote, **{k: v for k, v in local.items() if v is not None}}


def revision(remote: str, generation: int) -> str:
    return f"{remote}+{generation}" if remote else str(generation)


#: Prefix of the settings in the environment, and bytes below which a salt is weak.
PREFIX, SALT_BYTES = "PII_", 16
_LISTS = {"SENSITIVE_KEYS": "sensitive_keys", "SENSITIVE_KEY_PATTERNS": "sensitive_key_patterns"}
_RULES = {"CUSTOM_REGEX_LIST": "custom_regexes", "SAFE_REGEX_LIST": "safe_regexes"}
_NUMBERS = {"ENTROPY_THRESHOLD": "entropy_threshold", "CONFIDENCE_THRESHOLD": "confidence_score", "BIGRAM_DEFAULT_SCORE": "bigram_default_score"}
_SWITCHES = {"DISABLE_BIGRAM_CHECK": "disable_bigram_check", "ENTITY_TYPE_LABELS": "entity_type_labels"}


def random_salt() -> str:
    """A salt of 32 random bytes, in hex. Made on the driver and shipped with the configuration: a task
    that made its own would give the same value other marks."""
    return secrets.token_hex(32)


def on(text: str | None) -> bool:
    return (text or "").strip().lower() in ("1", "true", "yes", "on")


def from_env(env: Mapping[str, str], base: ScanConfig, prefix: str = PREFIX) -> tuple[ScanConfig, list[str]]:
    """base under the environment's settings, and warnings: a setting that can't be read is left out, the
    others hold. A weak salt is a warning, or a ValueError where the environment requires a strong one."""
    values: dict[str, object] = {}
    warnings: list[str] = []
    get = {k.removeprefix(prefix): v for k, v in env.items() if k.startswith(prefix) and v != ""}
    if salt := get.get("SALT"):
        if len(salt.encode()) < SALT_BYTES:
            if on(get.get("REQUIRE_STRONG_SALT")):
                raise ValueError(f"{prefix}SALT has fewer than {SALT_BYTES} bytes")
            warnings.append(f"{prefix}SALT has fewer than {SALT_BYTES} bytes: weak")
        values["salt"] = salt
    for name, field in _NUMBERS.items():
        if name in get:
            try:
                values[field] = float(get[name])
            except ValueError:
                warnings.append(f"{prefix}{name} is no number")
    if "MIN_SECRET_LENGTH" in get:
        text = get["MIN_SECRET_LENGTH"].strip()
        if text.isdecimal() and int(text) > 0:
            values["min_secret_length"] = int(text)
        else:
            warnings.append(f"{prefix}MIN_SECRET_LENGTH is no positive whole number")
    values |= {field: True for name, field in _SWITCHES.items() if on(get.get(name))}
    values |= {field: tuple(x.strip() for x in get[name].split(",") if x.strip()) for name, field in _LISTS.items() if name in get}
    for name, field in _RULES.items():
        if name in get:
            try:
                values[field] = _value(field, json.loads(get[name]))
            except (ValueError, TypeError, KeyError):
                warnings.append(f"{prefix}{name} is no JSON list of rules")
    return dataclasses.replace(base, **values), warnings
