"""Detectors and scores as Catalyst expressions: no Python runs for them on executors.

Lengths that the redaction rules name are lengths in bytes; Shannon entropy counts characters.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def hmac_pads(salt: str) -> tuple[str, str]:
    """Inner and outer pads of HMAC-SHA256, in hex."""
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_tag(value: Column, salt: str) -> Column:
    """The first three bytes of HMAC-SHA256(salt, value), in hex. The pads appear in the plan: use
    the scan UDF where the salt must not."""
    inner, outer = hmac_pads(salt)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(value, "UTF-8")), 256)
    return F.substring(F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256), 1, 6)


def marker(value: Column, salt: str, label: str | None = None) -> Column:
    return F.concat(F.lit(f"[HIDDEN:{label}:" if label else "[HIDDEN:"), hmac_tag(value, salt), F.lit("]"))


def chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def shannon(value: Column) -> Column:
    """Bits a character."""
    total = F.length(value).cast("double")
    def step(acc: Column, c: Column) -> Column:
        share = (total - F.length(F.replace(value, c, F.lit("")))) / total
        return acc - share * F.log2(share)
    return F.when(F.length(value) == 0, F.lit(0.0)).otherwise(F.aggregate(F.array_distinct(chars(value)), F.lit(0.0), step))


def class_bonus(value: Column) -> Column:
    """Half a point for each character class beyond the first."""
    classes = sum(F.when(value.rlike(p), 1).otherwise(0) for p in (r"\p{Lu}", r"\p{Ll}", r"\p{Nd}", r"[\p{P}\p{S}]"))
    return F.when(classes > 1, (classes - 1) * 0.5).otherwise(F.lit(0.0))


def bigram_adjustment(value: Column) -> Column:
    """-1.5 for pairs that look English, +0.5 for very rare ones, by the mean over adjacent ASCII pairs."""
    low = F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    table = F.create_map(*[F.lit(x) for k, v in vocab.BIGRAMS.items() for x in (k, v)])
    at = F.sequence(F.lit(1), F.greatest(F.length(low) - 1, F.lit(1)))
    pairs = F.filter(F.transform(at, lambda i: low.substr(i, F.lit(2))), lambda p: p.rlike(r"^[\x00-\x7F]{2}$"))
    scores = F.transform(pairs, lambda p: F.coalesce(F.element_at(table, p), F.lit(vocab.BIGRAM_DEFAULT)))
    # scores have one decimal: whole tenths sum exactly, whatever the order
    mean = F.aggregate(scores, F.lit(0).cast("long"), lambda a, s: a + F.round(s * 10).cast("long")) / (F.size(scores) * 10.0)
    return F.when((F.octet_length(value) <= 3) | (F.size(scores) == 0), 0.0).when(mean > vocab.BIGRAM_ENGLISH, -1.5).when(mean < vocab.BIGRAM_RANDOM, 0.5).otherwise(0.0)


def complexity(value: Column) -> Column:
    return shannon(value) + class_bonus(value) + bigram_adjustment(value)


def issuer_sql(x: str) -> str:
    """SQL (any dialect) that says whether the digits x have an issuer's prefix and length."""
    return "(" + " OR ".join(f"(length({x}) IN ({', '.join(map(str, lens))}) AND CAST(substr({x}, 1, {d}) AS INT) BETWEEN {lo} AND {hi})" for lo, hi, d, lens in vocab.CARD_ISSUERS) + ")"


def is_card(digits: Column) -> Column:
    """13 to 19 digits of an issuer, not all alike, with a right check digit."""
    issuer = F.lit(False)
    for lo, hi, d, lens in vocab.CARD_ISSUERS:
        issuer = issuer | (F.length(digits).isin(*lens) & F.substring(digits, 1, d).try_cast("int").between(lo, hi))
    return digits.rlike(r"^[0-9]{13,19}$") & issuer & (F.size(F.array_distinct(chars(digits))) > 1) & F.call_function("luhn_check", digits)


def card_runs(text: Column) -> Column:
    """Card numbers that are whole runs of letters and digits. Most texts have no 13 digits in a row."""
    runs = F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), is_card)
    return F.when(text.rlike("[0-9]{13}"), runs).otherwise(F.array().cast("array<string>"))


def signature(token: Column) -> Column:
    """The label of the first issuer format that the token has, or null."""
    out = None
    for label, pattern in vocab.SIGNATURES:
        out = F.when(token.rlike(pattern), label) if out is None else out.when(token.rlike(pattern), label)
    return F.when(F.octet_length(token) >= vocab.SIGNATURE_LENGTH, out)


def is_email(token: Column) -> Column:
    return token.rlike(vocab.EMAIL)


def key_words(key: Column) -> Column:
    """Lower-case words of a key, cut at `_`, `-`, `.` and before an upper-case letter after a
    lower-case one; empty for keys of over 64 bytes or 8 words."""
    words = F.filter(F.split(F.lower(F.regexp_replace(key, "([a-z])(?=[A-Z])", "$1_")), r"[_.\-]"), lambda w: w != "")
    return F.when((F.octet_length(key) > 64) | (F.size(words) > 8), F.array().cast("array<string>")).otherwise(words)


def key_kind(words: Column) -> Column:
    """phone, id, otp, session or dob, by what a key's words end with; else null."""
    joined, kind = F.array_join(words, "_"), F.lit(None).cast("string")
    for name, shape in reversed(vocab.KEY_SHAPES):
        kind = F.when(joined.rlike(shape), name).otherwise(kind)
    return kind


#: What a whole value under a key of each kind looks like; digit counts are checked apart.
VALUE_SHAPES = {
    "phone": (r"^\+?[0-9]+([-. ][0-9]+)*$", 7, 15), "id": r"^[0-9]+([-.][0-9]+)*$", "otp": r"^[0-9]+([-.][0-9]+)*$", "session": r"^[0-9]{10,}$",
    "dob": r"^((19|20)[0-9]{2}([-/.])(0?[1-9]|1[0-2])[-/.](0?[1-9]|[12][0-9]|3[01])|(0?[1-9]|[12][0-9]|3[01])[-/.](0?[1-9]|[12][0-9]|3[01])[-/.](19|20)[0-9]{2})$",
}


def keyed_value(kind: Column, value: Column) -> Column:
    """Whether the whole value is one that a key of this kind hides."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return F.coalesce(
        F.when(kind == "phone", value.rlike(VALUE_SHAPES["phone"][0]) & digits.between(7, 15)).when(kind == "id", value.rlike(VALUE_SHAPES["id"]) & digits.between(6, 15))
        .when(kind == "otp", value.rlike(VALUE_SHAPES["otp"]) & digits.between(4, 8)).when(kind == "session", value.rlike(VALUE_SHAPES["session"])).when(kind == "dob", value.rlike(VALUE_SHAPES["dob"])),
        F.lit(False),
    )


#: Static shapes that are never secrets, as patterns that Java, RE2 and Python read alike.
SAFE_SHAPES = {
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "git_hash": r"^[0-9a-fA-F]{40}$",
    "object_id": r"^[0-9a-fA-F]{24}$",
    "unix_time": r"^(17|18|19|20)[0-9]{8}$",
    "iso_prefix": r"^[0-9]{4}-[0-9]{2}-",
    "iso_time": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]{1,9})?([Zz]|[+-]([0-9]{2}|[0-9]{4}|[0-9]{2}:[0-9]{2}))?$",
    "decimal": r"^[+-]?[0-9]+\.[0-9]+([eE][+-]?[0-9]+)?$",
    "snake_words": r"^[a-z]+(_[a-z]+)+$",
    "url": r"://",
    "ipv6": r"^[0-9a-fA-F]{0,4}:[0-9a-fA-F]{0,4}:[0-9a-fA-F:]{0,32}(%\w+)?(/[0-9]{1,3})?$",
    "hash_range": r"^[0-9a-f]{7,40}\.{2,3}[0-9a-f]{7,40}$",
    "file_name": r"^[A-Za-z0-9_.-]{1,64}\.[a-z][a-z0-9]{1,4}(:[0-9]+)?$",
    "user_hex": r"^user_[0-9a-f]+$",
    "ssh_key": r"^ssh-",
    "product": r"^[A-Z][a-z]+[A-Za-z]*/[0-9]+(\.[0-9]+)*$",
    "log_date": r"^[0-9]{1,2}/[A-Z][a-z]{2}/[0-9]{4}(:[0-9]{2}){0,3}$",
    "path": r"^([A-Za-z]:)?[\\/]([^\\/]{0,31}[\\/])*[^\\/]{0,31}$|^(\.{1,2}|~)/([^/]{0,31}/)*[^/]{0,31}$",
}


def pem_line(line: Column) -> Column:
    return line.rlike(r"^\s*-----(BEGIN|END) [A-Z0-9 ]*PRIVATE KEY-----\s*$")


def diff_header(line: Column) -> Column:
    out = F.lit(False)
    for p in vocab.DIFF_HEADERS:
        out = out | line.startswith(p)
    return out


#: Written numbers, as patterns for Java: cards with at most one blank or dash between digits, numbers of
#: the North American plan, and international ones.
WRITTEN_CARD = r"(?<![0-9A-Za-z])(?<![0-9][ -])(?<!\p{L}-)(?<!\.)[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])(?![ -][0-9])(?!\.[0-9])(?![-.]\p{L})"
NANP = r"(?<![0-9A-Za-z(/.=+-])(?:\([2-9][0-9]{2}\) ?[2-9][0-9]{2}[-. ]|[2-9][0-9]{2}-[2-9][0-9]{2}-|[2-9][0-9]{2}\.[2-9][0-9]{2}\.)[0-9]{4}(?![0-9A-Za-z-])"
INTERNATIONAL = r"(?<![0-9A-Za-z=/+])\+[1-9][0-9]{0,2}(?:[ -](?=[0-9(]))?(?:\([0-9]{1,4}\)[ -]?)?[0-9]{1,8}(?:[ -][0-9]{1,8}){0,5}(?![0-9A-Za-z])"


def written_cards(text: Column) -> Column:
    """The digits of cards as people write them; texts without 13 digits so spaced are not searched."""
    found = F.transform(F.regexp_extract_all(text, F.lit(WRITTEN_CARD), F.lit(0)), lambda x: F.regexp_replace(x, "[ -]", ""))
    return F.when(text.rlike("[0-9](?:[ -]?[0-9]){12}"), F.filter(found, is_card)).otherwise(F.array().cast("array<string>"))


def written_phones(text: Column) -> Column:
    """International numbers of 8 to 15 digits, then those of the North American plan."""
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))
    abroad = F.filter(F.regexp_extract_all(text, F.lit(INTERNATIONAL), F.lit(0)), lambda x: digits(x).between(8, 15))
    return F.concat(abroad, F.regexp_extract_all(text, F.lit(NANP), F.lit(0)))


#: International numbers in their most exact form, as Java and RE2 read it.
BRACKETED = r"\+[1-9][0-9]{0,2} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"


def bracketed_phones(text: Column) -> Column:
    """International numbers with the area in brackets, each without what follows it."""
    return F.regexp_extract_all(text, F.lit(BRACKETED), F.lit(0))


def adaptive_threshold(scores, order: list[str], score: str, least: float, samples: int = 100):
    """One row: the mean of the first `samples` scores in a stated order, plus two standard deviations of
    the population; `least` while there are fewer. A batch's deterministic form of a running baseline."""
    first = scores.orderBy(*order).limit(samples).agg(F.count(F.lit(1)).alias("n"), (F.avg(score) + 2 * F.stddev_pop(score)).alias("t"))
    return first.select(F.when(F.col("n") >= samples, F.col("t")).otherwise(F.lit(float(least))).alias("threshold"), (F.col("n") >= samples).alias("ready"))
