"""Oversized texts and files cut into pieces at natural boundaries.

A text is covered by ranges of fixed length.  The worker of a range reads it
with a halo behind its end, finds the first boundary after each end (its
anchors), and cuts the stretch between its two anchors, so that ranges need no
word from each other; only the numbers and lengths of their pieces are summed
up afterwards to give each piece its place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*\s+")


def _last(pattern: re.Pattern, text: str, start: int, end: int) -> int:
    """End of the last match that ends in (start, end], or -1."""
    for low in range(max(start, end - 600), start - 600, -600):
        at = -1
        for m in pattern.finditer(text, max(low - 4, start, 0), end):
            at = m.end()
        if at > start:
            return at
        if low <= start:
            break
    return -1


def _blank(text: str, start: int, end: int) -> int:
    for at in range(end, start, -1):
        if text[at - 1].isspace():
            return at
    return -1


def boundary(text: str, start: int, end: int) -> int:
    """Best place to cut in (start, end]: a paragraph's end, else a sentence's, a line's or a word's.

    The second half of the window is looked through first, so that pieces
    aren't cut short for a stronger boundary far ahead; without any boundary
    the cut is at ``end``.
    """
    for low in ((start + end) // 2, start):
        at = _last(_PARAGRAPH, text, low, end)
        if at < 0:
            at = _last(_SENTENCE, text, low, end)
        if at < 0:
            at = text.rfind("\n", low, end) + 1
        if at <= low:
            at = _blank(text, low, end)
        if at > low:
            return at
    return end


def cut(text: str, start: int, end: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces (start, end) that cover text[start:end], at most ``limit`` long, each repeating up to ``overlap`` of the one before."""
    out = []
    while end - start > limit:
        # what is left is longer than the overlap, so that no piece lies within the next
        at = boundary(text, start + overlap + 1, min(start + limit, end - 2 * overlap - 2))
        out.append((start, at))
        back = max(at - overlap, start + 1)
        word = next((i for i in range(back, at) if text[i - 1].isspace() and not text[i].isspace()), None)
        start = back if word is None else word
    out.append((start, end))
    return out


def _range_pieces(text: str, offset: int, first: int, second: int, limit: int, overlap: int, opening: bool, closing: bool) -> list[tuple[int, int]]:
    """Pieces of the stretch between the anchors after ``first`` and ``second``, positions in ``text``."""
    a = 0 if opening else boundary(text, first, min(first + limit, len(text)))
    b = len(text) if closing else boundary(text, second, min(second + limit, len(text)))
    if not opening:
        back = max(a - overlap, 0)
        word = next((i for i in range(max(back, 1), a) if text[i - 1].isspace() and not text[i].isspace()), None)
        a = back if word is None else word
    return cut(text, a, b, limit, overlap)


def split_texts(texts: DataFrame, keys: list[str], text: str, limit: int = 4_000, overlap: int = 200, span: int = 1_000_000) -> DataFrame:
    """Pieces of every text longer than ``limit`` characters (code points).

    Returns the keys with ``range_no, range_piece, start, end, piece``: the
    piece is the text's characters from start to end.  Pieces cover the text,
    none is over the limit, and each repeats at most ``overlap`` characters of
    the one before, from a word's start where there is one.  Null, empty and
    short texts give no piece; repeated rows are cut again; a text without any
    boundary is cut at the limit.  Long texts are spread over tasks by ranges
    of ``span`` characters.
    """
    if not 0 <= overlap < limit // 4 or span < 4 * limit:
        raise ValueError("overlap must be under a quarter of the limit, and a range at least four limits")
    long = texts.select(*keys, F.col(text).alias("__text")).where(F.char_length("__text") > limit)
    n = F.char_length("__text")
    # the last range takes up to half a span more, so that no short rest is left
    ranges = long.select(
        *keys, "__text", n.alias("__n"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - span // 2) / F.lit(span))).cast("int"))).alias("range_no")
    )
    last = F.greatest(F.lit(0), F.floor((F.col("__n") - span // 2) / F.lit(span)))
    before = F.when(F.col("range_no") > 0, overlap + 1).otherwise(0)
    at = F.col("range_no").cast("bigint") * span - before
    length = F.when(F.col("range_no") == last, F.col("__n")).otherwise(F.lit(span + limit + overlap + 2))
    part = ranges.select(
        *keys, "range_no", at.alias("__at"), (F.col("range_no") == last).alias("__closing"), F.substring("__text", (at + 1).cast("int"), length.cast("int")).alias("__part")
    )
    schema = ", ".join(f"`{k}` {t}" for k, t in part.select(*keys).dtypes) + ", range_no int, range_piece int, start bigint, end bigint, piece string"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            columns = [batch[k] for k in (*keys, "range_no", "__at", "__closing", "__part")]
            for *key, no, offset, closing, t in zip(*columns):
                lead = overlap + 1 if no else 0
                cuts = _range_pieces(t, offset, lead, lead + span, limit, overlap, not no, closing)
                out += [(*key, no, i, offset + a, offset + b, t[a:b]) for i, (a, b) in enumerate(cuts)]
            yield pd.DataFrame(out, columns=[*keys, "range_no", "range_piece", "start", "end", "piece"])

    return part.mapInPandas(work, schema)


def number_pieces(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``piece_no``, counted through each text, by a prefix sum of the ranges' numbers of pieces."""
    counts = pieces.groupBy(*keys, "range_no").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*keys).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, "range_no", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"))
    return pieces.join(base, [*keys, "range_no"]).withColumn("piece_no", F.col("__base") + F.col("range_piece")).drop("__base")


def split_files(spark: SparkSession, paths: list[str], limit: int = 4_000, overlap: int = 200, span: int = 8_000_000) -> DataFrame:
    """Pieces of giant UTF-8 files, given by path or URI of a file system or object store, read by byte ranges only.

    Returns ``path, range_no, range_piece, byte_start, byte_end, char_start,
    piece``.  Each worker opens its range with halos; the characters before a
    range come from a prefix sum over the ranges' lengths.  An empty file
    gives no piece; bytes that aren't UTF-8 are kept as replacement marks.
    """
    sizes = []
    for p in paths:
        store, name = FileSystem.from_uri(p)
        sizes.append((p, store.get_file_info(name).size or 0))
    ranges = [(p, i, i * span, min((i + 1) * span, size), i == (size - 1) // span) for p, size in sizes if size for i in range((size - 1) // span + 1)]
    table = spark.createDataFrame(ranges, "path string, range_no int, lo bigint, hi bigint, closing boolean").repartition(max(1, len(ranges)), "path", "range_no")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                lead = 4 * (overlap + 2) if r.lo else 0
                store, name = FileSystem.from_uri(r.path)
                with store.open_input_file(name) as f:
                    f.seek(r.lo - lead)
                    raw = f.read(r.hi - r.lo + lead + (0 if r.closing else 4 * (limit + overlap)))
                skip = next((i for i in range(min(4, len(raw))) if raw[i] & 0xC0 != 0x80), 0) if lead else 0
                head = lead
                while head < len(raw) and raw[head] & 0xC0 == 0x80:
                    head += 1
                first = len(raw[skip:head].decode("utf-8", "replace"))
                tail = min(lead + r.hi - r.lo, len(raw))
                while tail < len(raw) and raw[tail] & 0xC0 == 0x80:
                    tail += 1
                text = raw[skip:head].decode("utf-8", "replace") + raw[head:tail].decode("utf-8", "replace")
                second = len(text)
                text += raw[tail:].decode("utf-8", "ignore" if not r.closing else "replace")
                out, at, byte = [], 0, r.lo - lead + skip
                for i, (a, b) in enumerate(_range_pieces(text, 0, first, second, limit, overlap, not r.lo, r.closing)):
                    byte += len(text[at:a].encode())
                    at = a
                    out.append((r.path, r.range_no, i, byte, byte + len(text[a:b].encode()), a - first, second - first, text[a:b]))
                yield pd.DataFrame(out, columns=["path", "range_no", "range_piece", "byte_start", "byte_end", "rel", "chars", "piece"])

    pieces = table.mapInPandas(work, "path string, range_no int, range_piece int, byte_start bigint, byte_end bigint, rel bigint, chars bigint, piece string")
    before = Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    lengths = pieces.groupBy("path", "range_no").agg(F.max("chars").alias("c"))
    base = lengths.select("path", "range_no", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    return pieces.join(base, ["path", "range_no"]).select("path", "range_no", "range_piece", "byte_start", "byte_end", (F.col("base") + F.col("rel")).alias("char_start"), "piece")


def coverage(pieces: DataFrame, keys: list[str], limit: int = 4_000, overlap: int = 200) -> DataFrame:
    """Per text: its length by the last piece, the characters that its pieces cover, and whether every piece keeps the limit and the overlap."""
    own = Window.partitionBy(*keys).orderBy("start", "end")
    rows = pieces.select(*keys, "start", "end", F.char_length("piece").alias("__n")).distinct().withColumn("__before", F.lag("end").over(own))
    back = F.coalesce(F.col("__before") - F.col("start"), F.lit(0))
    new = F.col("end") - F.greatest(F.col("start"), F.coalesce("__before", F.lit(0)))
    fits = (F.col("__n") <= limit) & (F.col("__n") == F.col("end") - F.col("start"))
    return rows.groupBy(*keys).agg(F.max("end").alias("chars"), F.sum(new).alias("covered"), F.min(fits).alias("within_limit"), F.min(back.between(0, overlap)).alias("within_overlap"))
