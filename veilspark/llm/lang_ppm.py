"""Operator 2: language identification by prediction by partial matching over bytes.

Each language has a context tree of variable order: for each context of up to `ORDER` bytes, how
often each byte followed. A byte's probability comes from the longest context known; one that was
never seen there pays the escape (method C: distinct / (total + distinct)) and is looked up one
order lower, down to equal shares of all 256 bytes. Statistics are frozen, so a text's exact code
length is a sum of fixed costs. They are kept in units of 2^-16 bits as integers: sums don't depend
on batches, order or machine.

To score whole texts in numpy, the languages' trees are merged: a table of contexts, and a row of costs,
one for each language, for each byte that was seen after a context. A byte that no language has seen
there pays each language's escape and is looked up after the next shorter context.

Fitting uses a bounded sample of whole labelled texts: at most `SAMPLE` bytes for each language,
distinct ones, of smallest hash first, until the bound is filled. Null text or no letter: `und`, score 0. Null ids hash as the empty
text. Nothing to learn from: every text is `und`. Ties go to the language first by name. Repeated
rows are predicted alike; an empty table gives an empty result.

The score is the share of the predicted language, if all were as likely beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import IntTable, materialize, ship

ORDER = 3
SAMPLE = 600_000
UNIT = 65_536
#: Bits of a text's hash by which its place in the sample is narrowed down at a time.
CUT = 12
UNKNOWN = "und"
#: Texts that are Python objects at a time.
PORTION = 1000


def held_out(doc_id: Column | None = None) -> Column:
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass
class Model:
    """The merged trees, with a row for each context that some language knows and each byte after it that
    some language has seen: nothing grows with contexts times bytes."""

    languages: list[str]
    classes: np.ndarray  # 256: each byte's class; 0 for bytes never seen in training
    size: int  # classes, 0 included
    contexts: list[IntTable]  # for each order from 1: the classes of its contexts, the latest lowest
    starts: np.ndarray  # number of the first context of each order
    parent: np.ndarray  # each context without its oldest byte
    escape: np.ndarray  # (contexts, languages): bits to go one order lower
    grams: IntTable  # context * size + class of the byte
    cost: np.ndarray  # (grams, languages): bits


def fit(samples: dict[str, list[bytes]], order: int = ORDER) -> Model:
    """The frozen trees of each language, merged. Keys hold up to `order` + 1 classes, the latest lowest."""
    languages = sorted(samples)
    seen = np.zeros(256, bool)
    data = {}
    for name in languages:
        data[name] = np.frombuffer(b"".join(b"\xff" * order + t for t in samples[name]), np.uint8)  # 0xFF: in no UTF-8 text
        seen[np.unique(data[name])] = True
    seen[255] = False
    classes = np.zeros(256, np.int64)
    classes[seen] = np.arange(1, seen.sum() + 1)
    size = int(seen.sum()) + 1
    known, parents, escapes, keys, costs, starts = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [], [], [], [0]
    below_keys, below = np.empty(0, np.int64), np.empty((0, len(languages)))
    for d in range(order + 1):
        # counts of (d bytes of context, byte) for each language, as sorted keys
        grams = []
        for name in languages:
            c = classes[data[name]]
            key, fine = c[d:].copy(), c[d:] > 0
            for back in range(1, d + 1):
                key += c[d - back : len(c) - back] * size**back
                fine &= c[d - back : len(c) - back] > 0
            grams.append(np.unique(key[fine], return_counts=True))
        every = np.unique(np.concatenate([np.empty(0, np.int64), *(k for k, _ in grams)]))
        if d:
            known.append(np.unique(every // size))
            parents.append(starts[d - 1] + np.searchsorted(known[d - 1], known[d] % size ** (d - 1)))
        context = np.searchsorted(known[d], every // size)
        # a gram of this order occurs in the next lower one too
        lower = below[np.searchsorted(below_keys, every % size**d)] if d else np.full((len(every), len(languages)), 8.0)
        bits, escape = np.empty((len(every), len(languages))), np.zeros((len(known[d]), len(languages)))
        for j, (own, counts) in enumerate(grams):
            at = np.searchsorted(every, own)
            total = np.bincount(context[at], counts, len(known[d]))
            distinct = np.bincount(context[at], minlength=len(known[d]))
            has = total > 0
            escape[has, j] = np.log2((total[has] + distinct[has]) / distinct[has])
            bits[:, j] = escape[context, j] + lower[:, j]
            bits[at, j] = np.log2((total + distinct)[context[at]] / counts)
        escapes.append(escape)
        keys.append((starts[d] + context) * size + every % size)
        costs.append(bits)
        below_keys, below = every, bits
        starts.append(starts[d] + len(known[d]))
    whole = lambda x: np.rint(np.concatenate(x) * UNIT).astype(np.int32)
    return Model(languages, classes, size, [IntTable(k) for k in known[1:]], np.array(starts), np.concatenate(parents), whole(escapes), IntTable(np.concatenate(keys)), whole(costs))


def code_lengths(model: Model, texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """(texts, languages): exact code lengths in 2^-16 bits, as int64."""
    pad = b"\xff" * order
    joined = model.classes[np.frombuffer(pad + pad.join(texts) + b"\xff", np.uint8)]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    n = len(joined) - order - 1  # of the byte at `order` and each after it, but the last pad
    # the longest context known before each byte
    context, key, go = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    for back in range(1, order + 1):
        before = joined[order - back : order - back + n]
        key += before * model.size ** (back - 1)
        go = go[before[go] > 0]
        place = model.contexts[back - 1].find(key[go])
        go, place = go[place >= 0], place[place >= 0]
        context[go] = model.starts[back] + place
    bits, symbol, go = np.zeros((n, len(model.languages)), np.int32), joined[order : order + n], np.arange(n)
    while len(go):
        row = model.grams.find(context[go] * model.size + symbol[go])
        hit = row >= 0
        bits[go[hit]] += model.cost[row[hit]]
        go = go[~hit]
        bits[go] += model.escape[context[go]]
        last = context[go] == 0
        bits[go[last]] += 8 * UNIT
        go = go[~last]
        context[go] = model.parent[context[go]]
    starts = np.cumsum(lengths + order) - (lengths + order)
    bounds = np.ravel(np.stack([starts, starts + lengths], 1))
    upto = np.concatenate([np.zeros((1, bits.shape[1]), np.int64), np.cumsum(bits, 0, dtype=np.int64)])
    return upto[bounds[1::2]] - upto[bounds[::2]]


def _limits(sizes: DataFrame, bound: int) -> dict[str, int]:
    """For each language the end of a range of `key` from 0 whose texts fill the bound, or all.

    Sums of equal ranges of keys show in which one the bound is reached; while that one holds more
    than the bound, it is cut again. So the driver holds at most 2^CUT sums a language."""
    low, before, shift, limits = {r["lang"]: 0 for r in sizes.select("lang").distinct().collect()}, {}, 63, {}
    while low and shift:
        step = min(CUT, shift)
        shift -= step
        inside = F.lit(False)
        for name, at in low.items():
            inside = F.when(F.col("lang") == name, F.shiftright("key", shift + step) == at >> (shift + step)).otherwise(inside)
        found: dict[str, dict[int, int]] = {name: {} for name in low}
        for r in sizes.filter(inside).groupBy("lang", F.shiftright("key", shift).alias("at")).agg(F.sum("size").alias("n")).collect():
            found[r["lang"]][r["at"]] = r["n"]
        for name, sums in found.items():
            held = before.get(name, 0)
            for at in sorted(sums):
                if held + sums[at] >= bound:
                    if sums[at] <= bound or not shift:
                        limits[name] = (at + 1) << shift
                    else:
                        low[name], before[name] = at << shift, held
                    break
                held += sums[at]
            else:
                limits[name] = 1 << 63
        low = {name: at for name, at in low.items() if name not in limits}
    return limits


def sample(docs: DataFrame, bound: int = SAMPLE) -> dict[str, list[bytes]]:
    """Distinct whole texts for each language, of smallest hash first, at most `bound` bytes together.
    Texts longer than that come last; where there are no others, the start of one is taken."""
    usable = docs.filter(F.col("lang").isNotNull() & (F.col("text") != "") & ~held_out()).select("lang", "text")
    size, quarter = F.octet_length("text").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 2)
    keyed = usable.withColumns({"key": quarter + F.when(size > bound, 1 << 62).otherwise(0), "size": F.least(size, F.lit(bound))})
    # copies count once: a few bytes for each distinct text are written
    limits = _limits(materialize(keyed.groupBy("lang", "key").agg(F.max("size").alias("size")), "sizes"), bound)
    near = F.lit(False)
    for name, end in limits.items():
        near = F.when(F.col("lang") == name, F.lit(True) if end >= 1 << 63 else F.col("key") < end).otherwise(near)
    out: dict[str, list[bytes]] = {name: [] for name in limits}
    held = dict.fromkeys(limits, 0)
    for r in sorted(keyed.filter(near).select("lang", "key", F.left("text", F.lit(bound)).alias("text")).distinct().toLocalIterator(), key=lambda r: (r["key"], r["text"])):
        raw = r["text"].encode()
        if not out[r["lang"]]:
            raw = raw[:bound]
        if held[r["lang"]] + len(raw) <= bound:
            out[r["lang"]].append(raw)
            held[r["lang"]] += len(raw)
    return out


def predictor(docs: DataFrame, bound: int = SAMPLE, order: int = ORDER):
    """A column function of texts, learned from docs: the struct of lang_pred and score. Texts alone go to
    the workers; the rows around them stay where they are."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit(sample(docs, bound), order))
    letter = regex.compile(r"\p{L}")

    @F.arrow_udf("lang_pred string, score double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            for start in range(0, len(batch), PORTION):
                texts = batch.slice(start, PORTION).to_pylist()
                own_names, own_scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                ask = [i for i, t in enumerate(texts) if model.languages and t and letter.search(t)]
                at = 0
                while at < len(ask):
                    end, held = at, 0
                    while end < len(ask) and (held == 0 or held + len(texts[ask[end]]) < 500_000):
                        held += len(texts[ask[end]])
                        end += 1
                    lengths = code_lengths(model, [texts[i].encode() for i in ask[at:end]], order)
                    best = lengths.argmin(1)
                    odds = np.exp2((lengths.min(1)[:, None] - lengths) / UNIT).sum(1)
                    for i, b, o in zip(ask[at:end], best.tolist(), odds.tolist()):
                        own_names[i], own_scores[i] = model.languages[b], 1 / o
                    at = end
                names += own_names
                scores += own_scores
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return run.asNondeterministic()  # so that no predicate on it moves below it and asks the model again


def predict(docs: DataFrame, *keep: str, bound: int = SAMPLE, order: int = ORDER) -> DataFrame:
    """keep, held_out, lang_pred and score of each document; keep may name struct columns too."""
    found = predictor(docs, bound, order)(F.col("text"))
    return docs.select(*keep, held_out().alias("held_out"), found.alias("__found")).select(*keep, "held_out", "__found.lang_pred", "__found.score")


def admit(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs in a language that the model tells with at least this score; all columns stay."""
    rows = docs.select("text", F.struct(*docs.columns).alias("__row"))
    found = rows.select("__row", predictor(docs)(F.col("text")).alias("__found"))
    return found.filter((F.col("__found.lang_pred") != UNKNOWN) & (F.col("__found.score") >= least)).select("__row.*")
