"""The context-sensitive scanner: a line in, the same line with secrets as keyed-hash markers out.

A line is rewritten by pure functions that return text and note findings on the side:
whole-line rules; numbers with a shape of their own (cards, phones, keyed numbers), found by one
pass of patterns; then words, each read under what the words before it announced (`Expect`).

Lengths are bytes where the rules name lengths; entropy counts characters.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hmac
import itertools
import json
import math
import operator
import re
import unicodedata
from dataclasses import dataclass, field

from ..config import ScanConfig
from ..functions import vocab
from ..functions.native import SAFE_SHAPES

DEPTH = 32
SPACES = " \t,;[]{}()<>【】「」『』〔〕〈〉《》〖〗（）［］｛｝"
#: Runs in which no character means anything to the cutting of words.
#: What makes a part of a line more than words between separators: quotes that open, escapes, chains, marks.
ODD = re.compile("[\"\\\\&\n]|'(?=$|[" + re.escape(SPACES) + ".:])|\\[HIDDEN")
#: What needs the careful cutting of words, and words and gaps where nothing does: whole double-quoted runs belong to a word.
HARD = re.compile("\\\\|'(?=$|[" + re.escape(SPACES) + ".:])|\\[HIDDEN")
RUNS = re.compile("(?:[^" + re.escape(SPACES) + "\"&\n]+|\"[^\"]*\")+|[" + re.escape(SPACES) + "]+")
GAPS = re.compile("([" + re.escape(SPACES) + "]+)")
DIGIT, SIGN, SIGNED_DIGIT = re.compile("[0-9]"), re.compile(r"[!-/:-@\[-`{-~]"), re.compile(r"[:=]\s*[\"']?\+?[0-9]")
#: A closing apostrophe: before a gap, a point, a colon or the end, after no or an even number of backslashes.
CLOSING = re.compile("(?<!\\\\)(?:\\\\\\\\)*'(?=$|[" + re.escape(SPACES) + ".:])")
PLAIN, IN_QUOTE = re.compile("[^" + re.escape(SPACES) + "\"'\\\\&\\n]+"), re.compile("[^\"'\\\\]+")
EMAIL = re.compile(vocab.EMAIL, re.A)
SAFE = {k: re.compile(p, re.A) for k, p in SAFE_SHAPES.items()}
PEM = re.compile(r"\s*-----(BEGIN|END) [A-Z0-9 ]*PRIVATE KEY-----\s*")
MARK = re.compile(r"\[HIDDEN[^\]]*\]")
FIELD = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*")
#: A dash or point between a letter and the digits makes them a part of something longer, such as a UUID.
CARD = re.compile(r"(?<![0-9A-Za-z])(?<![0-9][ -])(?<![^\W\d_]-)(?<!\.)[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])(?![ -][0-9])(?!\.[0-9])(?![-.][^\W\d_])")
PHONE = re.compile(r"(?<![0-9A-Za-z=/+])\+[1-9][0-9]{0,2}(?:[ -](?=[0-9(]))?(?:\([0-9]{1,4}\)[ -]?)?[0-9]{1,8}(?:[ -][0-9]{1,8}){0,5}(?![0-9A-Za-z])|(?<![0-9A-Za-z(/.=+-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}([-.]))[2-9][0-9]{2}(?(1)\1|-)[0-9]{4}(?![0-9A-Za-z-])")
KEYED = re.compile(r"""(?<![A-Za-z0-9_.\-])([A-Za-z][A-Za-z0-9_.\-]*)(["']?\s*[:=]\s*["']?)(\+?[0-9](?:[0-9./T:-]|(?<=[0-9]) (?=[0-9]))*)(?![A-Za-z0-9_])""")
DOB = re.compile(r"(?:(?:19|20)[0-9]{2}([-/.])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])(?:T[0-9:.]+)?|(?:0?[1-9]|[12][0-9]|3[01])([-/.])(?:0?[1-9]|[12][0-9]|3[01])\2(?:19|20)[0-9]{2})")
GROUPED = re.compile(r"[0-9]+(?:[-. ][0-9]+)*")
PATH = re.compile(r"(?:[A-Za-z]:)?[\\/]|\.{1,2}/|~/")
FILE = re.compile(r"[\w\-.]{1,64}\.(?:[a-z][a-z0-9]{1,4})(?::[0-9]+)?", re.A)
IPV6 = re.compile(r"(?=.*:.*:)[0-9a-fA-F:]{2,39}(?:%\w+)?(?:/[0-9]{1,3})?")
PRODUCT = re.compile(r"[A-Z][a-z]+[A-Za-z]*/[0-9]+(?:\.[0-9]+)*")  # of a User-Agent
AGENT, BRACKETS, CONTACT = re.compile(r"[A-Za-z0-9._\-]+/v?[0-9]"), re.compile(r"(\([^()]*\))"), re.compile(r"([^\s();,+]+@[^\s();,+]+)")
LOG_DATE = re.compile(r"[0-9]{1,2}/[A-Z][a-z]{2}/[0-9]{4}(?::[0-9]{2}){0,3}$")
USERINFO = re.compile(r"([A-Za-z][\w+.\-]*://[^/?#=&:@]*:)([^\s\"'@]+(?:@[^\s\"'/?#@]+)*)(@)")
HASH_RANGE = re.compile(r"[0-9a-f]{7,40}\.{2,3}[0-9a-f]{7,40}")
LOG_PREFIX = re.compile(r"(?:" + "|".join(vocab.LOG_LEVELS) + r"):[A-Za-z_][\w.\-]*:", re.A)
ASSIGNED = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*=")
PARTS = re.compile(r"[_.\-/]|(?<=[a-z])(?=[A-Z])")
PART = re.compile(r"[A-Za-z]?[a-z]{1,19}|[A-Z]{2,12}|[A-Za-z]?[0-9]{1,4}")
JSON_MARKS = re.compile(r'"(?:\\.|[^"\\])*(?:"|$)|[{}\[\]]', re.S)
BASE64 = re.compile("[A-Za-z0-9+/=]+")
#: Mean score of letter pairs above which letters follow each other as in words.
WORDY = -6.5
CLOSED = re.compile(r"([^\W\d_]+)[.!?]{1,3}")
IDENTIFIER = re.compile(r"[A-Za-z]{2,}[0-9]*(?:[._][A-Za-z]{2,}[0-9]*)+")
HUMP = re.compile(r"([a-z])(?=[A-Z])")
JOINTS = re.compile(r"[_.\-]")
HEX = re.compile(r"[0-9a-fA-F]{7,40}")
#: The forms of a token that `Scanner.token` and `Scanner.pair` look for.
WRAPPED, BYTES = re.compile(r"(\\[\"'`]|`)(.+?)(\1)", re.S), re.compile(r"(b)(['\"])(.*)\2", re.S)
QUERY, PADDED = re.compile(r"[^=&?]*\?[^=?]*="), re.compile(r"[A-Za-z0-9+/_-]+={1,2}")
QUOTED_KEY, PLACED_TOOL = re.compile(r"(\"(?:\\.|[^\"\\])*\"|'[^']*')\s*:"), re.compile(r"[\w.\-/]+\.[a-z]+(?:/[\w.\-]+)+:[\w.\-]+")
NAMED_VALUE, REVISION = re.compile(r"[A-Za-z_]\w*="), re.compile(r"commit|(?:^|_)(?:sha1?|hash|rev|revision)$")
#: The characters with which a rule of RE2 begins and that each text it matches holds, as written.
BEGINS = re.compile("\\^?([A-Za-z0-9_ :/@=#%&,;<>!~\"'-]+)(?![*?{])")
STRONG = {"pass", "password", "passwd", "passphrase", "secret", "token"}
COPULAS = {"is", "was", "are", "were"}
GENERIC_NAMES, GENERIC_VALUES = {"key", "name", "setting"}, {"value", "val", "values", "data"}
#: Words that announce something about the next one, and letter pairs rarer than unknown ones.
ANNOUNCE = {*vocab.CONTEXT_WORDS, "bearer", "basic"}
RARE = re.compile("|".join(re.escape(k) for k, v in vocab.BIGRAMS.items() if v < vocab.BIGRAM_RANDOM))
LITERALS = {"true", "false", "null", "none"}
DESCRIBES = {"count", "counts", "type", "limit", "usage", "total", "max", "min", "used", "budget", "length", "size", "num", "rate", "cost", "price", "index", "id_type", "expires", "ttl", "prompt", "completion", "input", "output", "cached", "reasoning"}


@dataclass(eq=False)
class Expect:
    """What the words so far say about the next one. A scanner keeps one object for each state."""

    secret: bool = False  # a sensitive key waits for its value
    value: bool = False  # a key with its sign stands right before
    quoted_key: bool = False
    scheme: str = ""  # an authorisation scheme stands before
    context: bool = False
    strong: bool = False  # the last word names a secret ("password"), so "is" may follow
    copula: bool = False
    naming: bool = False  # a generic name key waits for the name
    bare_key: bool = False  # the last word is "key", in prose
    named: bool = False  # a name/value pair named a secret; its value key comes
    hash: bool = False
    session: bool = False


NOTHING = Expect()
#: Characters without which a word is no quoted text, pair, address, path, escape or marker.
SIGNS = frozenset("\"'`=:?\\[/：")
#: Words whose verdict a scanner keeps before it forgets those not met since as many others, and their longest.
MEMO, MEMO_WORD = 100_000, 120
#: Longest line that is scanned, in bytes; a longer one becomes a marker line.
LINE_BYTES = 10 << 20
TOO_LONG, DROPPED = "[WARN: LINE_TOO_LONG]", "[DROP: FATAL_ERROR]"


@dataclass
class Finding:
    strategy: str
    label: str
    value: str = field(repr=False)
    mark: str = ""  # what stands for it
    line: int = 1  # from 1
    start: int | None = None  # in characters of the line, from 0; None where the value was decoded or rewritten before


def key_words(key: str) -> list[str]:
    if len(key.encode()) > 64:
        return []
    words = [w for w in JOINTS.split(HUMP.sub(r"\1_", key).lower()) if w]
    return words if len(words) <= 8 else []


KEY_SHAPES = [(kind, re.compile(shape)) for kind, shape in vocab.KEY_SHAPES]


@functools.lru_cache(65_536)
def key_kind(key: str) -> str:
    """phone, id, otp, session or dob, by what a key's words end with."""
    joined = "_".join(key_words(key))
    return next((kind for kind, shape in KEY_SHAPES if shape.search(joined)), "")


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def issuer(digits: str) -> bool:
    return any(len(digits) in lens and lo <= int(digits[:n]) <= hi for lo, hi, n, lens in vocab.CARD_ISSUERS)


#: Static shapes that need no more than a match, and issuers' formats in their order, each as one pattern.
STATIC = re.compile("|".join(f"(?:{SAFE_SHAPES[k]})" for k in ("git_hash", "object_id", "unix_time", "iso_prefix", "decimal")), re.A)
ISSUED = re.compile("|".join(f"({p})" for _, p in vocab.SIGNATURES), re.A)


def needed(rule: str) -> str:
    """Characters that each text holds in which the rule, read with its case, matches; empty where that isn't plain."""
    m = None if "|" in rule or "(?" in rule else BEGINS.match(rule)
    return m[1] if m else ""


def safe_shape(token: str) -> bool:
    """Shapes that are never secrets by themselves."""
    if token.isalpha() and len(token) not in (24, 40):
        return False
    if "://" in token or STATIC.match(token):
        return True
    if PRODUCT.fullmatch(token) or LOG_DATE.match(token) or HASH_RANGE.fullmatch(token) or IPV6.fullmatch(token) or FILE.fullmatch(token):
        return True
    if PATH.match(token) and len(token) < 256 and not any(len(p) > 31 for p in re.split(r"[\\/]", token)) and not re.fullmatch(r"/(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[^/]*", token):
        return True
    if (token.startswith("user_") and re.fullmatch(r"user_[0-9a-f]+", token)) or token.startswith("ssh-") or ssh_key_body(token):
        return True
    return bool(SAFE["snake_words"].match(token)) and not signature(token)


def json_end(s: str, at: int) -> int:
    """Where the JSON object or array that opens at `at` has ended, or 0 if it doesn't end."""
    depth = 0
    for m in JSON_MARKS.finditer(s, at):
        if m[0] in "{[":
            depth += 1
        elif m[0] in "}]":
            depth -= 1
            if not depth:
                return m.end()
    return 0


def escaped_binary(s: str) -> bool:
    r"""Whether a literal's text holds four or more \xNN escapes and is no UTF-8."""
    if s.count("\\x") < 4:
        return False
    escapes = 0

    def byte(m: re.Match) -> bytes:
        nonlocal escapes
        escapes += m[1] is not None
        return bytes([int(m[1], 16)]) if m[1] else m[2]

    raw = re.sub(rb"\\(?:x([0-9a-fA-F]{2})|(.))", byte, s.encode("utf-8", "surrogatepass"), flags=re.S)
    if escapes < 4:
        return False
    try:
        raw.decode()
    except UnicodeDecodeError:
        return True
    return False


def class_bonus(token: str) -> float:
    """Half a point for each class beyond the first: upper and lower case, digits, signs."""
    if token.isascii():
        classes = (token.lower() != token) + (token.upper() != token) + (DIGIT.search(token) is not None) + (SIGN.search(token) is not None)
    else:
        kinds = {unicodedata.category(ch) for ch in token}
        classes = ("Lu" in kinds) + ("Ll" in kinds) + ("Nd" in kinds) + any(k[0] in "PS" for k in kinds)
    return max(0, classes - 1) * 0.5


def ssh_key_body(token: str) -> bool:
    """The base64 body of a public key: it begins with its type's length and name."""
    if not token.startswith("AAAA") or len(token) <= 20 or not BASE64.fullmatch(token):
        return False
    try:
        raw = base64.b64decode(token[: min(64, len(token)) // 4 * 4], validate=True)
    except ValueError:
        return False
    return raw[4 : 4 + int.from_bytes(raw[:4], "big")].decode("latin-1") in vocab.SSH_KEY_TYPES


def signature(token: str) -> str:
    m = ISSUED.match(token) if len(token.encode()) >= vocab.SIGNATURE_LENGTH else None
    return vocab.SIGNATURES[m.lastindex - 1][0] if m else ""


def unquoted(token: str) -> str:
    return token[1:-1] if len(token) > 1 and token[0] in "\"'" and token[-1] == token[0] else token


def word_like_secret(token: str) -> bool:
    """Not a plain word: something besides letters in it."""
    return any(not c.isalpha() and c not in "'’" for c in token)


def field_name(key: str) -> bool:
    """A name of words, or with a joining sign in it, not a random run of letters and digits."""
    if set("_-.:&;%") & set(key) or re.fullmatch(r"[^\W\d_]+\d*", key):
        return True
    return bool(re.fullmatch(r"(?:[A-Z]?[a-z]+(?:[0-9]{1,3}(?=[A-Z]|$))?)+", key)) and len(re.findall("[0-9]+(?=[A-Z])", key)) <= 2


HEADERS = tuple(vocab.DIFF_HEADERS)


class Words:
    """Whether the word (up to the last blank) before a place holds a text; places must ascend."""

    def __init__(self, line: str):
        self.line, self.at, self.blank, self.last = line, 0, -1, -1

    def holds(self, text: str, place: int) -> bool:
        if (blank := self.line.rfind(" ", self.at, place)) >= 0:
            self.blank = blank
        if (last := self.line.rfind(text, max(0, self.at - len(text)), place)) >= 0:
            self.last = last
        self.at = place
        return self.last > self.blank


def keyed_label(kind: str, value: str) -> str:
    """The label of a number under a key of this kind, if it has the kind's shape."""
    if kind == "dob":
        return "dob" if DOB.fullmatch(value) else ""
    if kind == "session":
        return "key" if len(value) >= 10 and value.isdigit() else ""
    digits = sum(c.isdigit() for c in value)
    low, high, label = KEYED_DIGITS[kind]
    return label if low <= digits <= high and GROUPED.fullmatch(value.lstrip("+") if kind == "phone" else value) else ""


#: Fewest and most digits of a number under a key, and its label.
KEYED_DIGITS = {"phone": (7, 15, "phone"), "id": (6, 15, "id-number"), "otp": (4, 8, "key")}


class Scanner:
    """One configuration's scanner. Not shared between threads: it keeps the line's findings."""

    def __init__(self, config: ScanConfig):
        self.c = config
        self.mac = hmac.new(config.salt.encode(), digestmod="sha256")
        self.keys = re.compile("|".join(map(re.escape, sorted(map(str.lower, config.sensitive_keys), key=len, reverse=True))) or r"(?!)")
        self.key_patterns = self._rules(config.sensitive_key_patterns)
        self.custom = [(p, r.name) for r in config.custom_regexes if (p := self._rules([r.pattern]))]
        self.safe = self._rules([r.pattern for r in config.safe_regexes])
        self.found: list[Finding] = []
        self.skipped = [r for r in (*config.sensitive_key_patterns, *(r.pattern for r in (*config.custom_regexes, *config.safe_regexes))) if not self._rules([r])]
        #: By list of rules: characters one of which a text must hold for any of them to match, if all rules tell.
        self.needed = {id(rules): needs for rules in (self.safe, *(p for p, _ in self.custom)) if all(needs := [needed(r) for r in rules])}
        self.threshold = config.entropy_threshold * config.confidence_score
        self.judged: dict[tuple[int, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Empty the memos: words' verdicts, and words that stay as they are and announce nothing."""
        self.memo: dict[str | tuple[str, Expect], tuple[str, Expect, list[Finding]]] = {}
        self.older: dict[str | tuple[str, Expect], tuple[str, Expect, list[Finding]]] = {}
        self.states: dict[tuple, Expect] = {tuple(vars(NOTHING).values()): NOTHING}
        self.clean: set[str] = {""}

    @staticmethod
    def _rules(patterns) -> list[str]:
        """The patterns that RE2 accepts; others are dropped one by one."""
        import pyarrow as pa
        import pyarrow.compute as pc

        out = []
        for p in patterns:
            try:
                pc.match_substring_regex(pa.array([""]), p)
                out.append(p)
            except (pa.ArrowInvalid, ValueError):
                pass
        return out

    def _matches(self, patterns: list[str], text: str, fold: bool = False) -> bool:
        """Whether any of a list of rules (a list that lives as long as the scanner) matches; each text is asked once."""
        if not patterns:
            return False
        needs = None if fold else self.needed.get(id(patterns))
        if needs and not any(map(text.__contains__, needs)):
            return False
        key = id(patterns), text
        if (known := self.judged.get(key)) is None:
            import pyarrow as pa
            import pyarrow.compute as pc

            if len(self.judged) >= MEMO:
                self.judged.clear()
            known = pc.match_substring_regex(pa.array([text]), "|".join(f"(?:{p})" for p in patterns), ignore_case=fold)[0].as_py()
            if len(text) <= MEMO_WORD:
                self.judged[key] = known
        return known

    def hide(self, value: str, label: str, strategy: str) -> str:
        mac = self.mac.copy()
        mac.update(value.encode("utf-8", "surrogatepass"))
        named = label if self.c.entity_type_labels or strategy == "regex" else ""
        if strategy == "regex" and label == "regex" and not self.c.entity_type_labels:
            named = ""
        mark = f"[HIDDEN{':' + named if named else ''}:{mac.hexdigest()[:6]}]"
        self.found.append(Finding(strategy, label, value, mark))
        return mark

    # -- scores ------------------------------------------------------------------------------

    def complexity(self, token: str) -> float:
        n = len(token)
        shares = [token.count(ch) / n for ch in dict.fromkeys(token)]
        return -sum(map(operator.mul, shares, map(math.log2, shares))) + class_bonus(token) + self.bigrams(token)

    def surely_below(self, token: str, threshold: float) -> bool:
        """Whether no part of the token can score above the threshold: no distribution of its distinct
        characters has more bits than the even one, and the pairs add half a bit at most."""
        if not token.isascii():
            return False
        pairs = 0.5 if self.c.bigram_default_score < vocab.BIGRAM_RANDOM or RARE.search(token.lower()) else 0.0
        return math.log2(len(set(token))) + class_bonus(token) + pairs <= threshold

    def ordinary(self, word: str) -> bool:
        """Whether a word that stands under no expectation stays as it is and announces nothing, as most
        words of letters do: no key in it, too short for an issuer's secret, surely below the threshold."""
        letters = word.rstrip(".")
        if not letters.isalpha() or not letters.isascii() or len(word) >= vocab.SIGNATURE_LENGTH or self.key_patterns or self.custom:
            return False
        low = letters.lower()
        return low not in ANNOUNCE and "pw" not in low and not self.keys.search(low) and self.surely_below(word, self.threshold)

    def bigrams(self, token: str) -> float:
        if token.isascii():
            if self.c.disable_bigram_check or len(token) <= 3:
                return 0.0
            low = token.lower()
            mean = round(sum(map(vocab.BIGRAMS.get, map(operator.add, low, low[1:]), itertools.repeat(self.c.bigram_default_score))) / (len(low) - 1), 12)
            return -1.5 if mean > vocab.BIGRAM_ENGLISH else 0.5 if mean < vocab.BIGRAM_RANDOM else 0.0
        if self.c.disable_bigram_check or len(token.encode()) <= 3:
            return 0.0
        low = "".join(c.lower() if c.isascii() else c for c in token)
        got = [vocab.BIGRAMS.get(a + b, self.c.bigram_default_score) for a, b in zip(low, low[1:]) if a.isascii() and b.isascii()]
        mean = round(sum(got) / len(got), 12) if got else vocab.BIGRAM_RANDOM
        return -1.5 if mean > vocab.BIGRAM_ENGLISH else 0.5 if mean < vocab.BIGRAM_RANDOM else 0.0

    def english(self, word: str) -> bool:
        return self.bigrams(word) < 0

    def part_score(self, token: str) -> float:
        """A name of several word-like parts, a word of three letters among them, whose letters follow
        each other as in words, scores as its most random part."""
        parts = [p for p in PARTS.split(token) if p]
        if len(parts) > 1 and len(token.encode()) <= 128 and all(map(PART.fullmatch, parts)) and any(len(p) > 2 and p.isalpha() for p in parts):
            pairs = [self.letter_pair(a + b) for p in parts for a, b in zip(p.lower(), p[1:].lower()) if a.isalpha() and b.isalpha()]
            if len(pairs) < 3 or sum(pairs) / len(pairs) > WORDY:
                return max(self.complexity(p) for p in parts)
        return self.complexity(token)

    def letter_pair(self, letters: str) -> float:
        return vocab.BIGRAMS.get(letters, self.c.bigram_default_score)

    # -- keys --------------------------------------------------------------------------------

    def sensitive(self, key: str) -> bool:
        low = key.lower()
        if self.keys.search(low) and not ("pub" in low and "key" in low):
            random = len(key.encode()) > 15 and low not in self.c.sensitive_keys and not re.fullmatch(r"[A-Za-z]+([_.\-][A-Za-z]+)*", key) and self.complexity(key) > self.c.entropy_threshold
            words = key_words(key)
            describes = "token" in low and any(w in DESCRIBES for w in words if w not in ("token", "tokens"))
            if not random and not describes and "tokens" not in words:
                return True
        if "pw" in low and FIELD.fullmatch(key) and low != "pwd" and set(key_words(key)) & {"pw", "pwd"}:
            return True
        return self._matches(self.key_patterns, key, True)

    # -- lines -------------------------------------------------------------------------------

    def text(self, text: str) -> str:
        """Every line of a text; a carriage return at a line's end stays outside any marker."""
        return "\n".join(self.line(x[:-1]) + "\r" if x.endswith("\r") else self.line(x) for x in text.split("\n"))

    def scan(self, text: str, closed: bool = False) -> tuple[str, list[Finding], str | None]:
        """Every line of a text under the fail policy, with placed findings and the first error.

        A line that fails or is over `LINE_BYTES` costs nothing of the others: a failed line stays as it
        was, a long one becomes a marker; if `closed`, either is dropped. Neither leaves findings."""
        out, findings, error = [], [], None
        for n, whole in enumerate(text.split("\n"), 1):
            line, end = (whole[:-1], "\r") if whole.endswith("\r") else (whole, "")
            self.found = []
            if len(line) > LINE_BYTES // 4 and len(line.encode("utf-8", "surrogatepass")) > LINE_BYTES:
                out.append((DROPPED if closed else TOO_LONG) + end)
                error = error or f"line {n}: line too long"
                continue
            try:
                done = self.line(line)
            except Exception as e:  # one line's failure must not cost the others
                out.append(DROPPED + end if closed else whole)
                error = error or f"line {n}: {type(e).__name__}: {e}"
                self.forget()
                continue
            out.append(done + end)
            if self.found:
                findings += self.placed(n, line, done)
        return "\n".join(out), findings, error

    def placed(self, n: int, line: str, done: str) -> list[Finding]:
        """The line's findings with their places, by walking both texts from marker to marker."""
        out, at, read = [], 0, 0
        for f in self.found:
            start = None
            mark = done.find(f.mark, at)
            if mark >= 0:
                place = read + mark - at
                if line.startswith(f.value, place):
                    start, read, at = place, place + len(f.value), mark + len(f.mark)
                elif (place := line.find(f.value, read)) >= 0:  # quotes were added, or escapes taken back, before it
                    start, read, at = place, place + len(f.value), mark + len(f.mark)
            out.append(Finding(f.strategy, f.label, f.value, f.mark, n, start))
        return out

    def line(self, line: str, depth: int = 0) -> str:
        if not line:
            return line
        lead = ""
        if depth == 0:
            if line.startswith(HEADERS):
                return line
            if "PRIVATE KEY-----" in line and PEM.fullmatch(line):
                return self.hide(line, "private-key", "signature")
            if line[0] in "+-":
                lead = re.match(r"[+-]{0,2}", line)[0]
                lead = lead if len(lead) < len(line) else ""
                line = line[len(lead) :]
        carved = self.numbers(line) if DIGIT.search(line) else []
        if not carved:
            return lead + self.words(line, depth)[0]
        out, at, state = [lead], 0, ""
        for start, end, label in carved:
            quote = line[start - 1] if start and end < len(line) and line[start - 1] in "\"'" and line[end] == line[start - 1] else ""
            before, state = self.words(line[at : start - len(quote)], depth, state)
            value = line[start:end]
            out += [before, quote, self.verdict_of_number(value, label), quote]
            at = end + len(quote)
        return "".join(out) + self.words(line[at:], depth, state)[0]

    def verdict_of_number(self, value: str, label: str) -> str:
        if self._matches(self.safe, value):
            return value
        for patterns, name in self.custom:
            if self._matches(patterns, value):
                return self.hide(value, name or "regex", "regex")
        return self.hide(value, label, "luhn" if label == "card" else "signature")

    def numbers(self, line: str) -> list[tuple[int, int, str]]:
        """Numbers hidden by their own shape or their key's, left to right, none overlapping."""
        found: list[tuple[int, int, str]] = []
        before = Words(line)
        for m in KEYED.finditer(line) if SIGNED_DIGIT.search(line) else ():
            kind = key_kind(m[1])
            if not kind or before.holds("?", m.start()):
                continue
            value = m[3].rstrip(".-/:")
            if m[2][-1:] not in "\"'" and " " in value and kind != "phone":
                value = value.split(" ")[0]
            if label := keyed_label(kind, value):
                found.append((m.start(3), m.start(3) + len(value), label))
        before = Words(line)
        for m in PHONE.finditer(line):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15 and not before.holds("://", m.start()):
                found.append((m.start(), m.end(), "phone"))
        cards = []
        if self.c.confidence_score <= 1.2 or any(w in line.lower() for w in ("card", "cc", "pan", "visa")):
            for m in CARD.finditer(line):
                digits = re.sub("[ -]", "", m[0])
                if len(set(digits)) > 1 and issuer(digits) and luhn(digits):
                    cards.append((m.start(), m.end(), "card"))
        out: list[tuple[int, int, str]] = []
        for f in sorted(found):
            if not out or f[0] >= out[-1][1]:
                out.append(f)
        if cards:  # a card gives way to any other number
            starts = [f[0] for f in out]
            for f in cards:
                i = bisect.bisect_left(starts, f[1])
                if not i or out[i - 1][1] <= f[0]:
                    out.insert(i, f)
                    starts.insert(i, f[0])
        return out

    # -- words -------------------------------------------------------------------------------

    def pieces(self, s: str, quote: str):
        """('mark' | 'space' | 'word', text) in order; the last item is ('quote', open quote)."""
        i = start = 0
        n = len(s)

        def closes(j: int) -> bool:
            return j >= n or s[j] in SPACES or s[j] in ".:"

        last_closing = -2  # found when first asked for
        last_bracket, looked = s.rfind("]"), 0  # looked: characters read ahead for literals, a few times the line's at most

        def opens(j: int) -> bool:
            nonlocal last_closing
            if last_closing == -2:
                last_closing = max((m.end() - 1 for m in CLOSING.finditer(s)), default=-1)
            return last_closing >= j

        while i < n:
            if m := (IN_QUOTE if quote else PLAIN).match(s, i):
                i = m.end()
                continue
            c = s[i]
            if quote:
                if c == "\\":
                    i += 2
                    continue
                if c == quote and (c != "'" or closes(i + 1)):
                    quote = ""
                i += 1
                continue
            if c == "'" and s[i + 1 : i + 2] in ("{", "[") and looked <= 4 * n:  # a JSON document as a literal of SQL
                end = json_end(s, i + 1)
                looked += (end or n) - i
                if end and s[end : end + 1] == "'":
                    i = end + 1
                    continue
            if c == '"' or (c == "'" and opens(i + 1)):
                quote = c
                i += 1
                continue
            if c == "[" and i < last_bracket and (m := MARK.match(s, i)):
                if i > start and s[i - 1] == ":" and s[m.end() : m.end() + 1] == "@" and s.find("://", start, i) >= 0:
                    i = m.end()
                    continue
                if i > start:
                    yield "word", s[start:i]
                yield "mark", m[0]
                i = start = m.end()
                continue
            width = 4 if s.startswith("\\r\\n", i) else 0
            if not width and c in "&\\\n":
                step = 2 if s.startswith("\\n", i) else 1 if c != "\\" else 0
                if step and ASSIGNED.match(s, i + step) and (c != "&" or (s.find("?", start, i) < 0 and s.find("=", start, i) >= 0 and s.find("://", start, i) < 0)):
                    width = step
            if width or c in SPACES:
                width = width or 1
                if i > start:
                    yield "word", s[start:i]
                yield "space", s[i : i + width]
                i += width
                start = i
                continue
            i += 1
        if start < n:
            yield "word", s[start:]
        yield "quote", quote

    def words(self, s: str, depth: int, quote: str = "") -> tuple[str, str]:
        if not s:
            return s, quote
        if not quote and not ODD.search(s):
            return self.plain_words(s, depth), ""
        if not quote and not HARD.search(s):
            runs = RUNS.findall(s)
            if sum(map(len, runs)) == len(s):  # else a quote is left open, or a chain's sign stands outside
                e = NOTHING
                for i, run in enumerate(runs):
                    if run[0] not in SPACES:
                        runs[i], e = self.word(run, e, depth)
                return "".join(runs), ""
        out: list[str] = []
        e = NOTHING
        after_mark = False
        for kind, piece in self.pieces(s, quote):
            if kind == "quote":
                return "".join(out), piece
            if kind == "mark":
                out.append(piece)
                e, after_mark = NOTHING, True
            elif kind == "space":
                out.append(piece)
                after_mark = False
            elif after_mark and piece[0] in "&":
                out.append(piece)
            else:
                after_mark = False
                done, e = self.word(piece, e, depth)
                out.append(done)
        return "".join(out), quote

    def plain_words(self, s: str, depth: int) -> str:
        """Words between separators alone. Words that are known to stay and to announce nothing, and stand
        under no expectation, need no look: most of ordinary lines."""
        parts = GAPS.split(s)
        if self.clean.issuperset(parts[::2]):
            return s
        e, clean, changed = NOTHING, self.clean, False
        for i in range(0, len(parts), 2):
            if e is NOTHING and parts[i] in clean:
                continue
            if e is NOTHING and self.ordinary(parts[i]):
                if len(clean) >= MEMO:
                    clean.clear()
                    clean.add("")
                clean.add(parts[i])
            elif parts[i]:
                done, e = self.word(parts[i], e, depth)
                clean = self.clean
                if done != parts[i]:
                    parts[i], changed = done, True
        return "".join(parts) if changed else s

    def forced(self, token: str, e: Expect) -> bool:
        """Whether what stands before makes this word a secret whatever it looks like."""
        core = unquoted(token).rstrip(".,:;")
        size, letters = len(core.encode()), core.isalpha()
        if e.secret and not (e.bare_key and not e.value and self.identifier(core.strip("`\\'\""))):
            scheme = core.lower() in ("basic", "bearer", "digest", "negotiate", "token", "apikey") and e.value
            if not (scheme or (not e.value and (len(core) < 3 or (letters and (self.english(core) or len(core) < 12 or not core.isascii())) or "=" in token or ":" in token[:-1]))) and not (e.value and core.lower() in LITERALS and not token[:1] in "\"'"):
                return True
        if e.scheme == "basic":
            return size >= 6 and re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}", core) is not None and not (letters and self.english(core))
        if e.scheme:
            return size >= 16
        if e.session and size >= self.c.min_secret_length and word_like_secret(core) and any(c.isalpha() for c in core) and "=" not in core.rstrip("=") and " " not in core:
            return True
        return e.copula and size >= self.c.min_secret_length and word_like_secret(core)

    def word(self, token: str, e: Expect, depth: int) -> tuple[str, Expect]:
        """The word rewritten, and what it says about the next. That depends on the word and on what is
        expected alone, so it is kept, in a bounded memo."""
        if depth > 2 or len(token) > MEMO_WORD:
            return self.fresh_word(token, e, depth)
        key = token if e is NOTHING else (token, e)
        if (known := self.memo.get(key)) is None:
            if (known := self.older.get(key)) is None:
                noted = len(self.found)
                out, nxt = self.fresh_word(token, e, depth)
                known = out, nxt, self.found[noted:]
            else:
                self.found += known[2]
            if len(self.memo) >= MEMO:
                self.older, self.memo, self.clean = self.memo, {}, {""}
            self.memo[key] = known
            if e is NOTHING and known[1] is NOTHING and known[0] == token and not known[2] and not ODD.search(token):
                self.clean.add(token)
        else:
            self.found += known[2]
        return known[0], known[1]

    def fresh_word(self, token: str, e: Expect, depth: int) -> tuple[str, Expect]:
        core = unquoted(token)
        low = core.lower().rstrip(":=")
        forced = self.forced(token, e)
        if e.hash and HEX.fullmatch(core):
            return token, NOTHING
        done, key = self.token(token, forced, e.context and not forced, e.value, e.quoted_key, depth)
        nxt = Expect()
        if key is not None:
            raw, nxt.value = key
            name = unquoted(raw)
            low = name.lower()
            words = key_words(name)
            nxt.secret = self.sensitive(name)
            nxt.quoted_key = raw[:1] == '"'
            nxt.session = nxt.value and key_kind(name) == "session"
            nxt.hash = "commit" in low or (words[-1:] or [""])[0] in ("sha", "sha1", "hash", "rev", "revision")
            nxt.naming = nxt.quoted_key and low in GENERIC_NAMES
            if nxt.naming:
                nxt.secret = False
            elif e.named and nxt.value and (low in GENERIC_VALUES or words[-1:] == ["value"]):
                nxt.secret = True
            nxt.strong = low in STRONG
            nxt.bare_key = low == "key" and not nxt.value
        else:
            nxt.named = (e.naming and token[:1] == '"' and self.sensitive(core)) or (e.named and not e.value)
            nxt.copula = low in COPULAS and e.strong
            if low in ("bearer", "basic") and token[:1] not in "\"'":
                nxt.scheme = low
            elif e.secret and e.value and low in ("digest", "negotiate", "token", "apikey"):
                nxt.scheme = low
        nxt.context = low.rstrip(".,!") in vocab.CONTEXT_WORDS and not forced
        return done, self.states.setdefault(tuple(vars(nxt).values()), nxt)

    # -- tokens ------------------------------------------------------------------------------

    def token(self, token: str, forced: bool, context: bool, value: bool, quoted_key: bool, depth: int) -> tuple[str, tuple[str, bool] | None]:
        """The token rewritten; its key and whether a sign follows, if it waits for a value."""
        if depth > DEPTH:
            return self.verdict(unquoted(token), token, forced, context, quoted_key), None
        if SIGNS.isdisjoint(token):  # a word with no sign that any form below needs
            if not value and not forced and self.sensitive(token) and (FIELD.fullmatch(token) or len(token) < 16):
                return token, (token, False)
            return self.verdict(token, token, forced, context, quoted_key), None
        if token[0] in "\\`" and (m := WRAPPED.fullmatch(token)):
            inner, key = self.token(m[2], forced, context, value, False, depth + 1)
            return m[1] + inner + m[3], key
        if "[HIDDEN" in token:
            if MARK.fullmatch(unquoted(token)):
                return token, None
            if "://" not in token and '"' not in token and "'" not in token:
                return self.line(token, depth + 1), None
        quoted = len(token) > 1 and token[0] in "\"'" and token[-1] == token[0]
        if quoted and token[0] == '"' and '\\"' in token and ":" not in token.split('\\"')[0]:
            try:
                inner = json.loads(token)
            except ValueError:
                inner = None
            if isinstance(inner, str):
                if forced:
                    return '"' + self.verdict(inner, inner, True, context, False) + '"', None
                scanned = self.line(inner, depth + 1)
                return (token if scanned == inner else json.dumps(scanned, ensure_ascii=False)), None
        if token[0] == "b" and (m := BYTES.fullmatch(token)):
            if forced:
                inner = self.verdict(m[3], m[3], True, context, False)
            else:
                inner = self.blob(m[3], context) if escaped_binary(m[3]) else self.words(m[3], depth + 1)[0]
            return m[1] + m[2] + inner + m[2], None
        if quoted and not forced and token[:2] in ("'{", "'[") and json_end(token, 1) == len(token) - 1:
            return "'" + self.words(token[1:-1], depth + 1)[0] + "'", None
        if quoted and token.count(token[0]) == 2:
            if forced:
                return self.verdict(token[1:-1], token, True, context, quoted_key), None
            if not value and FIELD.fullmatch(token[1:-1]) and self.sensitive(token[1:-1]):
                return token, (token, False)
            if "://" in token and " " not in token:
                return token[0] + self.url(token[1:-1], depth) + token[0], None
            if SAFE["iso_time"].match(token[1:-1]):
                return token, None
            inner = self.agent(token[1:-1], depth + 1) if AGENT.match(token, 1) else self.words(token[1:-1], depth + 1)[0]
            return token[0] + inner + token[0], None
        query = "?" in token and QUERY.match(token)
        if ("://" in token and not re.match(r"[^\"']*[\"']:", token)) or query:
            if m := re.match(r"([^\"' :/?&=]+)=(['\"].*)", token, re.S):
                inner, _ = self.token(m[2], self.sensitive(m[1]), False, True, False, depth + 1)
                return m[1] + "=" + inner, None
            return self.url(token, depth), None
        if not forced and SAFE["iso_time"].match(unquoted(token)):
            return token, None
        bare = unquoted(token)
        if ":A" in token and (m := re.search(r"[0-9]{5,16}:A[0-9A-Za-z_-]{34}(?![0-9A-Za-z_-])", token)):
            return token[: m.start()] + self.hide(m[0], "telegram-bot-token", "signature") + token[m.end() :], None
        if not forced and (m := LOG_PREFIX.match(token)):
            rest, key = self.token(token[m.end() :], False, context, False, False, depth + 1) if m.end() < len(token) else ("", None)
            return m[0] + rest, key
        if token[0] in "\"'" and (m := QUOTED_KEY.match(token)):  # "key":value
            return self.pair(token, m[1], m.end(), ":", depth)
        if forced and token[:1] not in "\"'" and 0 < token.find(":") < len(token) - 1:
            return self.verdict(token, token, True, context, quoted_key), None
        padded = token[-1] == "=" and PADDED.fullmatch(token)
        eq = token.find("=")
        if eq > 0 and not (padded and (forced or (eq >= 16 and not FIELD.fullmatch(token[:eq])))) and token[0] not in "\"'":
            return self.pair(token, token[:eq], eq + 1, "=", depth)
        colon = token.find("：")
        if colon > 0 and not set(token) & set(":=\"'"):
            return self.pair(token, token[:colon], colon + 1, "：", depth)
        colon = token.find(":")
        if colon > 0 and token[0] not in "\"'" and not IPV6.fullmatch(token) and not ("/" in token and PLACED_TOOL.fullmatch(token)):
            return self.pair(token, token[:colon], colon + 1, ":", depth)
        if not value and not forced and FIELD.fullmatch(bare) and self.sensitive(bare):
            return token, (token, False)
        return self.verdict(bare, token, forced, context, quoted_key), None

    def agent(self, text: str, depth: int) -> str:
        """A User-Agent: an address of contact within brackets is published and stays."""
        out = []
        for i, part in enumerate(BRACKETS.split(text)):
            for j, piece in enumerate(CONTACT.split(part) if i % 2 else [part]):
                out.append(piece if j % 2 and EMAIL.match(piece) else self.words(piece, depth)[0])
        return "".join(out)

    def identifier(self, name: str) -> bool:
        """A database identifier of words, such as users.email or idx_user_email, that names no secret."""
        if self.c.disable_bigram_check or not 3 <= len(name) <= 64 or not IDENTIFIER.fullmatch(name):
            return False
        words = re.findall("[A-Za-z]+", name)
        pairs = [self.letter_pair(a + b) for w in words for a, b in zip(w.lower(), w[1:].lower())]
        return max(map(len, words)) > 2 and (len(pairs) < 3 or sum(pairs) / len(pairs) > WORDY) and not self.sensitive(name)

    def blob(self, content: str, context: bool) -> str:
        """Escaped binary data as a whole: its escapes are no words."""
        if self._matches(self.safe, content) or self.complexity(content) <= (self.c.entropy_threshold - (1.3 if context else 0)) * self.c.confidence_score:
            return content
        return self.hide(content, "context" if context else "entropy", "entropy")

    def pair(self, token: str, key: str, at: int, sign: str, depth: int) -> tuple[str, tuple[str, bool] | None]:
        """key, sign and value in one token; a key alone waits for what comes."""
        name, value = unquoted(key), token[at:]
        head = token[len(key) : at]
        if sign == ":" and not value and EMAIL.match(name):
            return self.hide(name, "email", "signature") + head, None
        if sign == ":" and value and EMAIL.match(name) and not value.startswith(("/", "~", ".")):
            return self.hide(name, "email", "signature") + head + self.hide(value, "key", "key"), None
        sensitive = self.sensitive(name) or (sign == "=" and ":" in name and self.sensitive(name.rsplit(":", 1)[1]))
        written = key if key[:1] in "\"'" else self.key_half(key)
        if not value:
            return written + head, (key, True) if written == key else None
        session = key_kind(name) == "session" and word_like_secret(value.rstrip(";,")) and any(c.isalpha() for c in value) and len(value.encode()) >= self.c.min_secret_length and "=" not in value.rstrip("=") and " " not in value
        forced = sensitive or session
        if forced and value[0] not in "\"'" and not ("=" in value and NAMED_VALUE.match(value)):
            if value.lower() in ("bearer", "basic"):
                return written + head + value, None
            return written + head + self.verdict(value, value, True, False, key[:1] == '"'), None
        if HEX.fullmatch(value) and REVISION.search(name.lower()):
            return written + head + value, None
        inner, waits = self.token(value, forced, False, True, key[:1] == '"', depth + 1)
        return written + head + inner, waits

    def key_half(self, key: str) -> str:
        """A key as it stands, unless it is itself an issuer's secret or no name at all and random."""
        if label := signature(key):
            return self.hide(key, label, "signature")
        if EMAIL.match(key):
            return self.hide(key, "email", "signature")
        if field_name(key):
            return key
        return self.verdict(key, key, False, False, False)

    def url(self, token: str, depth: int) -> str:
        """Passwords, random path parts and secret parameters of an address."""
        if m := USERINFO.match(token):
            before, at = [], 0
            while m:
                hidden = m[2] if MARK.fullmatch(m[2]) else self.hide(m[2], "key", "key")
                before += [m[1], hidden, "@"]
                at, m = m.end(), USERINFO.match(token, m.end())
            return "".join(before) + self.url(token[at:], depth)
        path, mark, query = token.partition("?")
        parts = path.split("/")
        for i, p in enumerate(parts):
            bot = p[:3] if p.startswith("bot") else ""
            if label := signature(p[len(bot) :]) or signature(p):
                bot = bot if signature(p[len(bot) :]) else ""
                parts[i] = bot + self.hide(p[len(bot) :], label, "signature")
            elif i > 2 and re.fullmatch(r"(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9_-]{20,128}", p) and not SAFE["uuid"].match(p) and not re.fullmatch(r"[0-9a-f]{24}|[0-9a-f]{40}|[0-9a-f]{64,128}", p) and self.complexity(p) > self.c.entropy_threshold:
                parts[i] = self.hide(p, "url", "entropy")
        if not mark:
            return "/".join(parts)
        out = []
        for p in re.split(r"([&?])", query):
            key, eq, value = p.partition("=")
            tail = re.search(r"[\"',;.)]*$", value)[0]
            value = value[: len(value) - len(tail)]
            if not eq or not value or MARK.fullmatch(value):
                out.append(p)
                continue
            kind = key_kind(key)
            if EMAIL.match(value.replace("%40", "@")):
                new = self.hide(value, "email", "signature")
            elif kind and (label := keyed_label(kind, value)):
                new = self.hide(value, label, "signature")
            elif self.sensitive(key):
                new = self.hide(value, "key", "key")
            elif len(value.encode()) >= self.c.min_secret_length and not safe_shape(value) and not SAFE["uuid"].match(value) and self.part_score(value) > self.c.entropy_threshold:
                new = self.hide(value, signature(value) or "url", "signature" if signature(value) else "entropy")
            else:
                new = value
            out.append(key + eq + new + tail)
        return "/".join(parts) + mark + "".join(out)

    def verdict(self, content: str, original: str, forced: bool, context: bool, auto_quote: bool) -> str:
        """One value kept or hidden: static shapes, the user's rules, issuer formats, then the score."""
        if not content or MARK.fullmatch(content) or (not forced and safe_shape(content)) or self._matches(self.safe, content):
            return original
        quote = original[0] if original[:1] in ("'", '"') and original != content else ""
        bare = '"' if not quote and auto_quote and (content.isdigit() or content.lower() in LITERALS - {"none"}) else quote
        for patterns, name in self.custom:
            if self._matches(patterns, content):
                return bare + self.hide(content, name or "regex", "regex") + bare
        label, tail = signature(content), ""
        if not label and content.find("@") > 0:
            tail = content[-1] if content[-1] in ".," else ""
            body = content[: len(content) - len(tail)]
            label, content, tail = ("email", body, tail) if EMAIL.match(body) else ("", content, "")
        if label:
            return quote + self.hide(content, label, "signature") + tail + quote
        strategy = "key" if forced else "entropy"
        if not forced:
            if len(content.encode()) < self.c.min_secret_length or " " in content or (SAFE["uuid"].match(content) and not context):
                return original
            if SAFE["uuid"].match(content):
                forced = True
            elif len(content.encode()) > 64 and content.endswith("=") and not set("-_ \t\n") & set(content):
                if not context and self.c.confidence_score > 1.2:
                    return original
                forced = True
        if not forced:
            threshold = (self.c.entropy_threshold - (1.3 if context else 0)) * self.c.confidence_score
            if self.surely_below(content, threshold):
                return original
            word = CLOSED.fullmatch(content)
            if self.part_score(word[1] if word and not context else content) <= threshold:
                return original
        return bare + self.hide(content, "key" if forced else "context" if context else "entropy", strategy) + bare
