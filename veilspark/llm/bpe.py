"""Operator 1: byte-level BPE encoding and decoding, by speculation and verification.

1. Texts are cut at bytes that are sure to begin a token; each distinct piece is encoded once per
   worker and kept, under a hash of its bytes, in a bounded memo of numpy arrays.
2. New pieces are split by the tokenizer's pattern. Over all of them, one pass of an
   Aho-Corasick automaton proposes the leftmost-longest vocabulary entries.
3. A vectorised check walks every adjacent pair of proposed tokens down its merge history. A
   sequence of self-encoding tokens is the BPE encoding exactly if each adjacent pair is.
4. Only words with a failing pair are merged exactly, rank by rank.

Nulls encode as the empty text: no tokens. The only special string is matched in texts, as the
tokenizers library does. Rows, repeated or not, are independent: one row out for each row in, none
for an empty table. Very long texts are encoded whole, a text at a time; the memo is bounded by the
number and length of its pieces. Columns that clash with an output column are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import portions, ship, slices, strings, whole_text

#: Fixed value: the byte-level pre-tokenizer's published pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces in a worker's memo beyond which it forgets rare ones (memory only, never results), and
#: the bytes of the longest piece that is kept.
MEMO, LONG = 500_000, 64
#: Bytes of a word up to which all such words are merged side by side.
SHORT = 64
NEVER = np.int64(1) << 40


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeModel:
    """Vocabulary, merges and the automaton of one tokenizer file (its JSON text)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        alphabet = byte_alphabet()
        vocab = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.size = size
        self.merge_of = {(a, b): (r, c) for r, (a, b, c) in enumerate(zip(left.tolist(), right.tolist(), made.tolist()))}
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank[made[::-1]] = np.arange(len(made))[::-1]  # the first merge that makes a token counts
        first = self.rank[made] == np.arange(len(made))
        self.left[made[first]], self.right[made[first]] = left[first], right[first]
        self.made = made
        self._index(left * size + right)
        self.sound = self._sound(made[first])
        self.automaton = ahocorasick.Automaton()
        for i in [*self.byte_id, *made[first].tolist()]:
            if self.sound[i] and self.token_bytes[i] != b"\xff":
                self.automaton.add_word(self.token_bytes[i].decode("latin-1"), i)
        self.automaton.make_automaton()

    def _sound(self, made: np.ndarray) -> np.ndarray:
        """Which tokens encode to themselves: both halves do, and nothing joins across sooner."""
        sound = np.zeros(self.size, bool)
        sound[self.byte_id] = True
        own = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t, good in zip(made.tolist(), own.tolist()):  # in rank order, so halves come first
            sound[t] = good and sound[self.left[t]] and sound[self.right[t]]
        return sound

    def _index(self, keys: np.ndarray) -> None:
        """An open-addressing table of pairs: a lookup is one or two gathers."""
        bits = max(4, int(len(keys) * 12).bit_length())
        self.shift, self.slots = np.uint64(64 - bits), 1 << bits
        self.table = np.full(self.slots, -1, np.int64)
        self.ranks = np.full(self.slots, NEVER)
        left, self.probes = np.arange(len(keys)), 0
        at = self._slot(keys)
        while len(left):
            free = self.table[at] < 0
            self.table[at[free][::-1]], self.ranks[at[free][::-1]] = keys[left[free]][::-1], left[free][::-1]  # the first of a slot's keys takes it
            stays = self.table[at] != keys[left]
            left, at = left[stays], (at[stays] + 1) % self.slots
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair of tokens, or NEVER."""
        key = a * self.size + b
        at = self._slot(key)
        held = self.table[at]
        out = np.where(held == key, self.ranks[at], NEVER)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at = (self._slot(key[open_]) + _) % self.slots
            held = self.table[at]
            hit = held == key[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens, whether encoding both byte strings joined gives just the pair.

        The latest merge on either side of the border is undone, one at a time; a merge across the
        border that would have come before it (at equal rank, the one further left) refutes the pair.
        """
        good, where = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), NEVER) if limit is None else limit
        while len(where):
            bad = self.pair_rank(a, b) < limit
            good[where[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            a, b, ra, rb, where = a[go], b[go], ra[go], rb[go], where[go]
            undo_left = ra > rb
            limit = np.where(undo_left, ra, rb + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return good

    def merge_short(self, words: list[bytes]) -> list[np.ndarray]:
        """All merges of many short words, by rank, leftmost first: one merge of every word at a time."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        ids = np.array(self.byte_id, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        rank = np.full(len(ids), NEVER)  # of each token with the next one of its word
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.pair_rank(ids[inside], ids[inside + 1])
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(starts, append=len(ids))
            best = np.minimum.reduceat(rank, starts)
            done = best >= NEVER
            if done.any():
                for w, i, n in zip(word[starts[done]].tolist(), starts[done].tolist(), sizes[done].tolist()):
                    out[w] = ids[i : i + n]
                go = np.repeat(~done, sizes)
                ids, word, rank, best, sizes = ids[go], word[go], rank[go], best[~done], sizes[~done]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            at = hits[np.concatenate([[True], word[hits[1:]] != word[hits[:-1]]])]
            ids[at] = self.made[rank[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            at -= np.arange(len(at))  # a merge before removed one token each
            ids, word, rank = ids[stay], word[stay], rank[stay]
            rank[at] = NEVER
            right = at[(at + 1 < len(ids))]
            right = right[word[right + 1] == word[right]]
            left = at[at > 0] - 1
            left = left[word[left] == word[left + 1]]
            changed = np.concatenate([right, left])
            rank[changed] = self.pair_rank(ids[changed], ids[changed + 1])
        return out

    def merge_exactly(self, word: bytes) -> list[int]:
        """All merges of a long word by rank, leftmost first, by a heap over a linked list, in n log n."""
        ids = [self.byte_id[b] for b in word]
        n, get = len(ids), self.merge_of.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := get((made, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, made, ids[after[i]], m[1]))
            if before[i] >= 0 and (m := get((ids[before[i]], made))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], made, m[1]))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words and the number of ids of each."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 2  # last byte of each word
        found = list(self.automaton.iter_long(b"\xff".join(words).decode("latin-1")))
        at = np.array([x[0] for x in found], np.int64)
        ids = np.array([x[1] for x in found], np.int64)
        word = np.searchsorted(ends, at)
        counts = np.bincount(word, minlength=len(words))
        inside = word[1:] == word[:-1]
        a, b = ids[:-1][inside], ids[1:][inside]
        pairs, back = np.unique(a * self.size + b, return_inverse=True)
        wrong = ~self.compatible(pairs // self.size, pairs % self.size)[back]
        failed = np.unique(word[1:][inside][wrong])
        if len(failed):
            short = [w for w in failed.tolist() if len(words[w]) <= SHORT]
            merged = dict(zip(short, self.merge_short([words[w] for w in short])))
            parts = [merged[w] if w in merged else np.array(self.merge_exactly(words[w])) for w in failed.tolist()]
            kept = ~np.isin(word, failed, assume_unique=False, kind="table")
            nth = np.arange(len(ids)) - (np.cumsum(counts) - counts)[word]
            counts[failed] = list(map(len, parts))
            starts = np.cumsum(counts) - counts
            out = np.empty(counts.sum(), np.int64)
            out[(starts[word] + nth)[kept]] = ids[kept]
            of = np.repeat(failed, counts[failed])
            own = np.cumsum(counts[failed]) - counts[failed]
            out[starts[of] + np.arange(len(of)) - np.repeat(own, counts[failed])] = np.concatenate(parts)
            ids = out
        return ids, counts

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def newer_characters(spec: str) -> str:
    """A character class of letters and digits that the pattern's library knows and the tokenizer's
    own, older Unicode tables don't. Only code points unknown to Python's tables need asking."""
    from tokenizers import Tokenizer

    cut = Tokenizer.from_str(spec).pre_tokenizer.pre_tokenize_str
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    young = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    ranges: list[list[int]] = []
    for cp in sorted(ord(c) for c in young if len(cut("a" + c)) > 1 and len(cut("1" + c)) > 1):
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@functools.lru_cache(4)
def splitter(spec: str) -> Callable[[str], list[str]]:
    """The pre-tokenizer: PATTERN, without the newer characters where a text has some."""
    plain, newer = regex.compile(PATTERN), newer_characters(spec)
    if not newer:
        return plain.findall
    odd = re.compile(f"[{newer}]")
    careful = regex.compile("(?V1)" + re.sub(r"\[\^\\s\\p\{L\}\\p\{N\}\]", lambda _: rf"[^\s[\p{{L}}--[{newer}]][\p{{N}}--[{newer}]]]", PATTERN).replace(r" ?\p{L}+", f" ?[\\p{{L}}--[{newer}]]+").replace(r" ?\p{N}+", f" ?[\\p{{N}}--[{newer}]]+"))
    return lambda text: (careful if odd.search(text) else plain).findall(text)


def _marks() -> np.ndarray:
    """For each byte, bits: 1 cuts before it (space, line end), 2 is or may begin white space, 4 ASCII
    letter or digit, 8 cuts after a letter or digit (comma, full stop)."""
    out = np.zeros(256, np.uint8)
    out[[0x20, 0x0A]] |= 1
    out[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] |= 2
    out[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] |= 4
    out[[0x2C, 0x2E]] |= 8
    return out


class PieceMemo:
    """Encodings of pieces by 64-bit hashes of their bytes: arrays alone, no strings are kept.

    A hash is a sum of random numbers, one for each byte value, times powers of an odd base. Two pieces
    of one length are taken as equal by mistake with a chance of 2^-64: among as many pieces as a corpus
    of 10^14 bytes shows to a memo of `MEMO`, 10^-4 in all."""

    _DRAW = np.random.default_rng(20)
    BYTES = _DRAW.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    BASE = int(_DRAW.integers(0, 1 << 61, dtype=np.uint64)) * 8 + 5

    def __init__(self):
        self.powers = self.back = np.ones(1, np.uint64)
        self.reset()

    def reset(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self._room(2 * MEMO)
        self.starts, self.counts, self.hits = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat, self.used = np.empty(0, np.int32), 0

    def _room(self, most: int) -> None:
        """A table of at least as many slots, with all keys in it."""
        bits = max(8, most.bit_length())
        self.shift, self.slots = np.uint64(64 - bits), 1 << bits
        self.table, self.place = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self._place(self.keys, np.arange(len(self.keys), dtype=np.int32))

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) > len(self.powers):
            n = len(data) * 2
            self.powers, self.back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (self.BASE, pow(self.BASE, -1, 1 << 64)))
        upto = np.empty(len(data) + 1, np.uint64)
        upto[0] = 0
        np.cumsum(self.BYTES[data] * self.powers[: len(data)], out=upto[1:])
        out = (upto[ends] - upto[starts]) * self.back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xD6E8FEB86659FD93)
        return out | np.uint64(1)  # zero is a free slot

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's piece, -1 for new ones."""
        at = (keys >> self.shift).astype(np.int64)
        held = self.table[at]
        out = np.where(held == keys, self.place[at], -1)
        left = np.flatnonzero((held != keys) & (held != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & (self.slots - 1)
            held = self.table[at]
            hit = held == keys[left]
            out[left[hit]] = self.place[at[hit]]
            go = ~hit & (held != 0)
            left, at = left[go], at[go]
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """New pieces, distinct, with their ids one after the other."""
        if 3 * (len(self.keys) + len(keys)) > 2 * self.slots:  # one very long text may bring more than the memo keeps
            self._room(3 * (len(self.keys) + len(keys)))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(1 << 20, len(self.flat)), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self._place(keys, np.arange(len(self.keys), len(self.keys) + len(keys), dtype=np.int32))
        self.keys = np.concatenate([self.keys, keys])
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.hits = np.concatenate([self.hits, np.zeros(len(keys), np.int64)])
        self.used += len(ids)

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        at = (keys >> self.shift).astype(np.int64)
        while len(keys):
            free = self.table[at] == 0
            self.table[at[free]], self.place[at[free]] = keys[free], numbers[free]  # the last of a slot's keys takes it
            stays = self.table[at] != keys
            keys, numbers, at = keys[stays], numbers[stays], (at[stays] + 1) & (self.slots - 1)

    def shrink(self) -> None:
        """Forget the pieces met once, and more of the rarest if half the memo would stay."""
        least = max(2, int(np.partition(self.hits, len(self.hits) // 2)[len(self.hits) // 2]) + 1)
        keep = np.flatnonzero(self.hits >= least)
        keys, counts, hits, starts = self.keys[keep], self.counts[keep], self.hits[keep] // 2, self.starts[keep]
        ids = self.flat[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        self.reset()
        self.add(keys, ids, counts)
        self.hits = hits


class TextEncoder:
    """Encodes whole texts through a bounded memo of pieces; `encode_pieces` does the new ones."""

    MARKS = _marks()

    def __init__(self, encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special: dict[str, int], split: Callable[[str], list[str]]):
        self.encode_pieces, self.special, self.split = encode_pieces, special, split
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.memo = PieceMemo()

    def reset(self) -> None:
        self.memo.reset()

    def borders(self, data: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Where pieces start: at the parts' starts, and where a token surely begins: at a space or line end
        after a character that is no white space, at a comma or full stop after a letter or digit."""
        marks = self.MARKS[data]
        starts = np.zeros(len(data), bool)
        if len(data) > 3:
            blank = marks & 2 != 0
            starts[1:] = (marks[1:] & 1 != 0) & ~blank[:-1]
            # a character of several bytes may be white space by its first byte, two or three before
            wide = np.zeros(len(data), bool)
            wide[2:] = blank[:-2]
            wide[3:] |= blank[:-3]
            starts[1:] &= ~(wide[1:] & (data[:-1] >= 0x80))
            starts[1:] |= (marks[1:] & 8 != 0) & (marks[:-1] & 4 != 0)
        starts[parts] = True
        return np.flatnonzero(starts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts (int32) and the number of ids of each."""
        parts: list[bytes] = []
        first = [0]  # parts before each text
        for text in texts:
            if self.cut is not None and any(x in text for x in self.special):
                parts += [p.encode() for p in self.cut.split(text) if p]
            elif text:
                parts.append(text.encode())
            first.append(len(parts))
        raw = b"".join(parts)
        if not raw:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(raw, np.uint8)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        starts = self.borders(data, at[:-1])
        ends = np.append(starts[1:], len(data))
        if len(self.memo.keys) > MEMO:
            self.memo.shrink()
        keys = self.memo.hashes(data, starts, ends)
        where = self.memo.find(keys)
        long = np.flatnonzero(ends - starts > LONG)  # blobs and scripts without spaces: encoded, not kept
        where[long] = -1
        if len(new := np.flatnonzero(where < 0)):
            short = new[ends[new] - starts[new] <= LONG]
            own, one, back = np.unique(keys[short], return_index=True, return_inverse=True)
            chosen = short[one]
            self.memo.add(own, *self._learn([raw[i:j] for i, j in zip(starts[chosen].tolist(), ends[chosen].tolist())]))
            where[short] = len(self.memo.keys) - len(own) + back
        where[long] = 0
        self.memo.hits += np.bincount(np.delete(where, long), minlength=len(self.memo.hits))
        counts = self.memo.counts[where] if len(self.memo.counts) else np.zeros(len(where), np.int64)
        begin = self.memo.starts[where] if len(self.memo.counts) else np.zeros(len(where), np.int64)
        flat = self.memo.flat
        if len(long):
            ids, each = self._learn([raw[i:j] for i, j in zip(starts[long].tolist(), ends[long].tolist())])
            counts[long], begin[long] = each, self.memo.used + np.cumsum(each) - each
            flat = np.concatenate([flat[: self.memo.used], ids.astype(np.int32)])
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(begin - upto[:-1], counts) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.searchsorted(starts, at[first])])

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [p.decode() for p in pieces]
        if self.cut is None or not any(t in self.special for t in texts):
            return self.encode_pieces(texts)
        out = [(np.array([self.special[t]]), np.ones(1, np.int64)) if t in self.special else self.encode_pieces([t]) for t in texts]
        return np.concatenate([i for i, _ in out]), np.concatenate([c for _, c in out])


_READY: dict[tuple[str, int], TextEncoder] = {}
_MODELS: dict[int, BpeModel] = {}


def model_of(spec: str) -> BpeModel:
    """One model per Python worker and tokenizer."""
    if (k := hash(spec)) not in _MODELS:
        _MODELS[k] = BpeModel(spec)
    return _MODELS[k]


def speculative_encoder(spec: str) -> TextEncoder:
    key = ("speculate", hash(spec))
    if key not in _READY:
        model, cut = model_of(spec), splitter(spec)

        def encode_pieces(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            split = [[p] if p[1:].isalpha() and p[0] == " " else cut(p) for p in pieces]  # a space and letters: one word
            ids, counts = model.encode_words([w.encode() for words in split for w in words])
            each = np.fromiter(map(len, split), np.int64, len(split))
            upto = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(each)])]
            return ids, np.diff(upto)

        _READY[key] = TextEncoder(encode_pieces, model.special, cut)
    return _READY[key]


def library_encoder(spec: str) -> TextEncoder:
    """The same memo over the tokenizers library itself, which encodes each distinct piece."""
    key = ("library", hash(spec))
    if key not in _READY:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(spec)
        tok.no_truncation()
        tok.no_padding()

        def encode_pieces(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            parts: list[list[int]] = []
            for i in range(0, len(pieces), 20_000):
                parts += [e.ids for e in tok.encode_batch_fast(pieces[i : i + 20_000], add_special_tokens=False)]
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            return np.fromiter((x for p in parts for x in p), np.int64, counts.sum()), counts

        _READY[key] = TextEncoder(encode_pieces, {t.content: i for i, t in tok.get_added_tokens_decoder().items()}, splitter(spec))
    return _READY[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_texts(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df's columns (but for a clashing `ids`) and `ids` array<int>: the encoding of each whole text."""
    spark: SparkSession = df.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(read_spec(tokenizer))
    kept = [c for c in df.columns if c != ids]
    schema = df.select(*kept).withColumn(ids, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = speculative_encoder(spec.value)
        for batch in portions(batches):
            texts = [t or "" for t in strings(batch, text)]
            for a, b in slices(texts):
                flat, counts = encoder.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in kept), lists], names=[*kept, ids])

    return df.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, encoded and decoded again
    within one pass (neither ids nor texts leave the worker)."""
    ship(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, model = speculative_encoder(spec.value), model_of(spec.value)
        for batch in portions(batches):
            texts = strings(batch, "text")
            n, ids_hex, text_hex = [], [], []
            for a, b in slices(texts):
                flat, counts = encoder.encode(texts[a:b])
                for own in np.split(flat, np.cumsum(counts)[:-1]):
                    n.append(len(own))
                    ids_hex.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    text_hex.append(hashlib.sha256(model.decode(own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
