"""Kernel writes put together as lines, per process and file descriptor, and redacted streams.

Writes are rows (tgid, fd, seq, data, flags). Bytes are joined before they are read as UTF-8, so a
character may be split between writes. A stream's state is the bytes after its last line feed. It is
bounded: when a write leaves `LINE` bytes or more pending, all of them are passed on as a line that is
marked as an overflow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..operators.redact import redact

LINE = 1 << 20
OUT = "tgid int, fd int, seq long, line string, overflow boolean"
#: Flags of a record (its write was cut; its list of buffers was cut) and its header's bytes.
TRUNCATED, BUFFERS_CUT, HEADER = 1, 2, 16
#: Numbers of writes (by seq) of one stream that are put in order by one task.
SPAN = 100_000


def decode_records(df: DataFrame, record: str = "record") -> DataFrame:
    """tgid, fd, flags and data of binary records, beside df's other columns: four little-endian
    numbers (process, descriptor, length, flags), then as many bytes. Records that are too short for
    their header or their length give nulls in all four."""
    h = F.hex(F.col(record))

    def number(at: int) -> Column:
        return F.conv(F.concat(*[F.substring(h, 2 * (at + i) + 1, 2) for i in (3, 2, 1, 0)]), 16, 10).cast("long")

    size = number(8)
    whole = (F.octet_length(record) >= HEADER) & (size <= F.octet_length(record) - HEADER)
    data = F.expr(f"substring(`{record}`, {HEADER + 1}, cast(__size as int))")
    out = df.withColumn("__size", size).withColumn("__whole", F.coalesce(whole, F.lit(False)))
    return out.withColumns({"tgid": F.when(F.col("__whole"), number(0)), "fd": F.when(F.col("__whole"), number(4)), "flags": F.when(F.col("__whole"), number(12)), "data": F.when(F.col("__whole"), data)}).drop("__size", "__whole")


def outcome(flags: Column) -> Column:
    return F.when(flags.bitwiseAND(F.lit(TRUNCATED | BUFFERS_CUT)) != 0, "truncated").otherwise("ok")


def outcomes(writes: DataFrame, lines: DataFrame) -> DataFrame:
    """outcome and n: writes that came whole or cut, and lines that were passed on before their end."""
    kinds = writes.groupBy(outcome(F.coalesce("flags", F.lit(0))).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(lines.filter("overflow").groupBy(F.lit("overflow").alias("outcome")).agg(F.count(F.lit(1)).alias("n")))


def cut(held: bytes, data: bytes, most: int = LINE) -> tuple[list[tuple[bytes, bool]], bytes]:
    """Complete lines (and whether each is an overflow) of held + data, and what stays."""
    *whole, rest = (held + data).split(b"\n")
    out = [(x, False) for x in whole]
    return (out + [(rest, True)], b"") if len(rest) >= most else (out, rest)


def assemble_stream(writes: DataFrame, idle_ms: int = 2000, most: int = LINE) -> DataFrame:
    """Lines of a streaming frame; a stream idle for `idle_ms` gives what it holds."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = bytes(state.get[0]) if state.exists else b""
        rows: list[tuple] = []
        if state.hasTimedOut:
            state.remove()
            rows = [(*key, None, held.decode("utf-8", "replace"), False)] if held else []
        else:
            frames = [b for b in batches]
            for r in pd.concat(frames).sort_values("seq").itertuples():
                done, held = cut(held, bytes(r.data), most)
                rows += [(*key, r.seq, x.decode("utf-8", "replace"), over) for x, over in done]
            state.update((held,))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["tgid", "fd", "seq", "line", "overflow"])

    return writes.groupBy("tgid", "fd").applyInPandasWithState(step, OUT, "held binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def assemble(writes: DataFrame, most: int = LINE, span: int = SPAN) -> DataFrame:
    """tgid, fd, line_no, part, line and overflow, by the same rule over a table. What never ended is a
    line too. part counts, from 0, what overflows cut one line into.

    Each piece between line feeds knows its line by the line feeds before it: those of earlier spans of
    its stream, as sums of one row a span, and those within its span. So a busy stream is no single task."""
    key = ("tgid", "fd")
    # one character for each byte: splitting and joining keep every byte, whatever it means
    pieces = writes.withColumn("__parts", F.split(F.decode("data", "ISO-8859-1"), "\n")).withColumn("__span", F.floor(F.col("seq") / span)).select(*key, "seq", "__span", "__parts")
    ends = F.size("__parts") - 1
    earlier = Window.partitionBy(*key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    spans = pieces.groupBy(*key, "__span").agg(F.sum(ends).alias("n")).select(*[F.col(k).alias(f"__{k}") for k in key], F.col("__span").alias("__of"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    met = pieces.join(spans, (F.col("tgid") == F.col("__tgid")) & (F.col("fd") == F.col("__fd")) & (F.col("__span") == F.col("__of")))
    within = Window.partitionBy(*key, "__span").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    first = met.withColumn("first", F.col("__before") + F.coalesce(F.sum(ends).over(within), F.lit(0)))
    rows = first.select(*key, "seq", "first", (F.size("__parts") - 1).alias("ends"), F.posexplode("__parts").alias("i", "text")).filter("text <> '' or i < ends").withColumn("line_no", F.col("first") + F.col("i"))
    lines = rows.groupBy(*key, "line_no").agg(F.array_sort(F.collect_list(F.struct("seq", "i", "text", (F.col("i") < F.col("ends")).alias("ended")))).alias("p"), F.sum(F.length("text")).alias("bytes"))
    start = F.struct(F.lit("").alias("held"), F.array().cast("array<struct<text string, overflow boolean>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        text = F.concat(a["held"], x["text"])
        full = ~x["ended"] & (F.length(text) >= most)
        line = F.array(F.struct(text.alias("text"), full.alias("overflow")))
        return F.struct(F.when(full | x["ended"], F.lit("")).otherwise(text).alias("held"), F.when(full | x["ended"], F.concat(a["out"], line)).otherwise(a["out"]).alias("out"))

    joined = F.struct(F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), F.lit(False).alias("overflow"))
    folded = F.aggregate("p", start, step)
    rest = F.when(folded["held"] != "", F.concat(folded["out"], F.array(F.struct(folded["held"].alias("text"), F.lit(False).alias("overflow"))))).otherwise(folded["out"])
    cuts = lines.select(*key, "line_no", F.posexplode(F.when(F.col("bytes") >= most, rest).otherwise(F.array(joined))).alias("part", "x"))
    return cuts.select(*key, "line_no", "part", F.make_valid_utf8(F.encode("x.text", "ISO-8859-1").cast("string")).alias("line"), F.col("x.overflow").alias("overflow"))


def redact_stream(lines: DataFrame, config: Callable[[], ScanConfig], sink: Callable[[DataFrame, int], None], audit: bool = False, closed: bool = False):
    """A writer that reads the configuration anew for each micro-batch, so new rules hold from a
    batch's first line on and never change within one."""
    return lines.writeStream.foreachBatch(lambda batch, n: sink(redact(batch, "value", config(), audit, closed), n))


def report_stream(samples: DataFrame, at: str, by: list[str], sums: list[str], every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Windowed reports of growth samples in event time: from, to, by and the sums; rows that come later
    than the watermark are left out. Works on a table and on a stream (append mode)."""
    window = F.window(at, every)
    return samples.withWatermark(at, late).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("samples"), *[F.sum(c).alias(c) for c in sums]).select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), *by, "samples", *sums)


def summary(scanned: DataFrame, at: str, column: str, every: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """The periodic summary of redacted lines with `findings`: lines, bytes, how many were changed, and
    findings, by window. Works on a table and on a stream (append mode)."""
    hit = F.size("findings") > 0
    window = F.window(at, every)
    return scanned.withWatermark(at, late).groupBy(window.alias("w")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length(column)).alias("bytes"), F.count_if(hit).alias("redacted"), F.sum(F.size("findings")).alias("findings")
    ).select(F.col("w.start").alias("from"), "lines", "bytes", "redacted", "findings", F.round(100.0 * F.col("redacted") / F.col("lines"), 4).alias("percent"))
