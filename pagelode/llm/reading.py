"""Reading level of documents from the grades at which their words are acquired."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Upper ends of the grade bands; the last band is open.
BANDS = (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 12.0, 14.0, 17.0, 21.0, 26.0)

#: Frequent function words of the languages told apart.
FUNCTION_WORDS = {
    "en": "the of and to in is for was we by on at with from that it you our this are be as have not so but all".split(),
    "fr": "le la les des du de et en par une un est dans pour au aux sur que qui ce cette ont été sont avec".split(),
    "de": "der die das und den von im für mit ein eine des dem zu ist auf nicht sich wurde werden aus bei nach".split(),
    "es": "el los las del y por con una un que se en es al como para su más fue han lo".split(),
}

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CELL = re.compile(r"(?:\s{2,}|\t|\|)\s*[-–(]?\s*[$€£]?\s*\d")
_MARK = re.compile(r"^\s*<-{2,}.*-{2,}>\s*$|^[\s\d.,|/#*=_-]+$")
_BULLET = re.compile(r"^(?:[-*•–]|\d+[.)])\s+")
_STOP = re.compile(r"[.!?][\"'”’)\]]*(?=\s|$)")
_LEGAL = re.compile(
    r"(?i)does not constitute|not (?:an? )?(?:offer|invitation|solicitation)|forward-looking statement|no (?:liability|warranty|representation)|all rights reserved|"
    r"subscribe for securities|investment advice|legal advice|should consult|past performance|registered office|without prejudice"
)
_VOWELS = re.compile(r"[aeiouyäöüàâéèêëïîôûùáíóú]+")


def syllables(word: str) -> int:
    n = len(_VOWELS.findall(word))
    if n > 1 and word.endswith("e") and not word.endswith(("le", "ee")):
        n -= 1
    return max(n, 1)


class _Syllables(dict):
    def __missing__(self, word: str) -> int:
        n = syllables(word)
        if len(self) < 500_000:
            self[word] = n
        return n


def language(words: list[str]) -> str | None:
    """Language by function words: the one with the largest share, if any occurs."""
    if not words:
        return None
    counts = Counter(words)
    share = {k: sum(counts[w] for w in set(v)) for k, v in FUNCTION_WORDS.items()}
    best = max(share, key=lambda k: share[k])
    return best if share[best] else None


def prose(text: str) -> list[list[str]]:
    """Paragraphs of prose as lists of sentences: no tables, title lines, page marks or legal closing.

    Lines broken within a sentence are joined; a line that is followed by a
    capital letter ends a sentence of its own, with or without a full stop.
    """
    shouted = text.isupper()
    blocks: list[list[str]] = [[]]
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            blocks.append([])
            continue
        if _MARK.match(line):
            continue
        if len(line) <= 160:  # longer lines are no table rows or titles
            words = _WORD.findall(line)
            if not words or (len(words) <= 9 and _CELL.search(line)):
                blocks.append([])
                continue
            line = _BULLET.sub("", line)
            if not shouted and len(words) <= 12 and not line.endswith((".", "!", "?", ",", ";", ":")):
                capital = sum(w[0].isupper() for w in words)
                if capital >= 2 and capital >= 0.6 * len(words):
                    blocks.append([])
                    continue
        last = blocks[-1]
        if last and not line[:1].isupper() and not last[-1].endswith((".", "!", "?")):
            last[-1] = last[-1][:-1] + line if last[-1].endswith(("-", "­", "‐")) else f"{last[-1]} {line}"
        else:
            last.append(line)
    blocks = [b for b in blocks if b]
    out = []
    for i, block in enumerate(blocks):
        if i >= len(blocks) - 2 and i and _LEGAL.search(" ".join(block)):
            continue
        sentences = [s for line in block for s in _STOP.split(line) if len(s) > 1 and _WORD.search(s)]
        if i == len(blocks) - 1 and len(blocks) == 1 and len(sentences) > 1:
            while len(sentences) > 1 and _LEGAL.search(sentences[-1]):
                sentences.pop()
        if sentences:
            out.append(sentences)
    return out


def formula_grade(words: int, sentences: int, syllable_count: int) -> float:
    """The Flesch-Kincaid grade, with which the graded texts are graded."""
    return 0.39 * words / sentences + 11.8 * syllable_count / words - 15.59


def _paragraphs(text: str | None, cache: _Syllables) -> tuple[str | None, list[tuple[list[str], float]]]:
    """Language of a text, and the words and the grade of each paragraph of prose."""
    out: list[tuple[list[str], float]] = []
    every: list[str] = []
    for sentences in prose(text) if text else []:
        words = _WORD.findall(" ".join(sentences).lower().replace("’", "'"))
        every += words
        out.append((words, formula_grade(len(words), len(sentences), sum(map(cache.__getitem__, words)))))
    return language(every), out


def prose_table(documents: DataFrame, doc_id: str, text: str, lang: str, folds: int = 1) -> DataFrame:
    """``doc_id, fold, lang, size, grades, words`` of every row with an id; the words, packed, only of texts in ``lang``.

    The fold comes from the text, so that copies fall into one.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Syllables()
        for batch in batches:
            out = []
            for key, t in zip(batch["__id"], batch["__t"]):
                found, paragraphs = _paragraphs(t, cache)
                packed = zlib.compress("\n".join(" ".join(w) for w, _ in paragraphs).encode(), 1) if found == lang else None
                out.append((key, zlib.crc32((t or "").encode("utf-8", "replace")) % folds, found, sum(len(w) for w, _ in paragraphs), [g for _, g in paragraphs], packed))
            yield pd.DataFrame(out, columns=["doc_id", "fold", "lang", "size", "grades", "words"])

    docs = documents.select(F.col(doc_id).alias("__id"), F.col(text).alias("__t")).where("__id IS NOT NULL")
    return durable(docs.mapInPandas(pack, f"doc_id {dict(docs.dtypes)['__id']}, fold int, lang string, size int, grades array<double>, words binary"))


def _unpack(packed: bytes) -> list[list[str]]:
    return [p.split(" ") for p in zlib.decompress(packed).decode().split("\n")]


def word_grades(table: DataFrame, folds: int = 1, share: float = 1e-5, least: int = 5, quantile: float = 0.15, most: int = 1_000_000) -> list[dict[str, float]]:
    """Acquisition grade of every known word of a prose table, for each fold.

    Each paragraph of prose is a graded text.  A word's rate in each band of
    grades is its number of paragraphs there over the band's words, so that
    bands count alike however much text they have; its acquisition grade is
    the ``quantile`` of that distribution.  Known words occur in at least
    ``least`` paragraphs and a ``share`` of all; with paragraphs of d different
    words there are at most d / share of them, and ``most`` is checked.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: list[Counter] = [Counter() for _ in range(folds)]
        rows = lambda: pd.DataFrame([(f, w, b, n) for f in range(folds) for (w, b), n in counts[f].items()], columns=["fold", "word", "band", "n"])
        for batch in batches:
            for fold, packed, grades in zip(batch["fold"], batch["words"], batch["grades"]):
                own = counts[fold]
                for words, grade in zip(_unpack(packed), grades):
                    band = bisect_right(BANDS, grade)
                    own.update(zip(set(words), repeat(band)))
                    own[None, band] += len(words)
                    own["", -1] += 1
            if sum(map(len, counts)) > 1_000_000:
                yield rows()
                for c in counts:
                    c.clear()
        yield rows()

    bands = range(len(BANDS) + 1)
    table = table.where("words IS NOT NULL AND size > 0").select("fold", "words", "grades").mapInPandas(count, "fold int, word string, band int, n bigint")
    table = durable(table.groupBy("fold", "word", "band").agg(F.sum("n").alias("n")))
    low = [0.0, *BANDS]
    high = [*BANDS, BANDS[-1] + 6]
    out = []
    for fold in range(folds):
        own = table.where(F.col("fold") == fold)
        size = {r.band: float(r.n) for r in own.where("word IS NULL").collect()}
        paragraphs = own.where("word = ''").agg(F.sum("n")).first()[0] or 0
        total = sum(size.values()) or 1.0
        # a band with little text is no graded text: its rates are damped
        rate = [F.sum(F.when(F.col("band") == b, F.col("n") / (size.get(b, 0.0) + 1e-4 * total)).otherwise(0.0)).alias(f"r{b}") for b in bands]
        known = own.where("word <> ''").groupBy("word").agg(F.sum("n").alias("seen"), *rate).where(F.col("seen") >= max(least, share * paragraphs))
        whole = sum((F.col(f"r{b}") for b in bands), F.lit(0.0)) * quantile
        grade, before = F.lit(high[-1]), F.lit(0.0)
        steps = []
        for b in bands:
            steps.append((before + F.col(f"r{b}") >= whole, low[b] + (high[b] - low[b]) * (whole - before) / F.greatest(F.col(f"r{b}"), F.lit(1e-300))))
            before = before + F.col(f"r{b}")
        for reached, value in reversed(steps):
            grade = F.when(reached, value).otherwise(grade)
        rows = known.select("word", grade.alias("grade")).limit(most + 1).toArrow()
        if rows.num_rows > most:
            raise ValueError(f"more than {most} known words")
        out.append(dict(zip(rows["word"].to_pylist(), rows["grade"].to_pylist())))
    return out


def _isotonic(points: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """Non-decreasing step fit of (x, mean y, weight), by pooling adjacent violators."""
    pools: list[list[float]] = []
    for x, y, w in sorted(points):
        pools.append([x, x, y, w])
        while len(pools) > 1 and pools[-2][2] > pools[-1][2]:
            b = pools.pop()
            a = pools.pop()
            pools.append([a[0], b[1], (a[2] * a[3] + b[2] * b[3]) / (a[3] + b[3]), a[3] + b[3]])
    return [(p, pool[2]) for pool in pools for p in dict.fromkeys((pool[0], pool[1]))]


def _median(weighted: list[tuple[float, int]]) -> float:
    """Weighted median of sorted (value, weight)."""
    half, run = sum(w for _, w in weighted) / 2, 0
    for value, weight in weighted:
        run += weight
        if run >= half:
            return value
    return weighted[-1][0]


def reading_level(documents: DataFrame, doc_id: str, text: str, lang: str = "en", quantile: float = 0.9, least_words: int = 8, folds: int = 1) -> DataFrame:
    """Reading grade of every document.

    Returns ``doc_id, lang, words, known_share, formula_grade, level`` for
    each row with an id.  ``lang`` is read from the text; ``level`` is the
    ``quantile`` of the grades of the prose's known words, calibrated to the
    formula's scale by an isotonic fit over all documents.  With two ``folds``
    the words' grades and the fit that a document is measured with come from
    the other half of the documents, so that its error is that of texts held
    apart.  The level is null for texts in other languages, null or empty
    texts, and texts with fewer than ``least_words`` known words of prose.
    """
    if folds not in (1, 2):
        raise ValueError("one fold or two")
    table = prose_table(documents, doc_id, text, lang, folds)
    shared = documents.sparkSession.sparkContext.broadcast(word_grades(table, folds))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known_by = [words.get for words in shared.value]
        for batch in batches:
            out = []
            for key, fold, found, size, grades, packed in zip(*(batch[c] for c in ("doc_id", "fold", "lang", "size", "grades", "words"))):
                raw = share = grade = None
                known = known_by[(fold + 1) % folds]
                if size and packed is not None:
                    paragraphs = _unpack(packed)
                    values = sorted(g for p in paragraphs for w in p if (g := known(w)) is not None)
                    share = len(values) / size
                    raw = values[min(int(quantile * len(values)), len(values) - 1)] if len(values) >= least_words else None
                    grade = _median(sorted(zip(grades, map(len, paragraphs))))
                out.append((key, fold, found, size, share, grade, raw))
            yield pd.DataFrame(out, columns=["doc_id", "fold", "lang", "words", "known_share", "formula_grade", "raw"])

    kind = dict(table.dtypes)["doc_id"]
    measured = durable(table.mapInPandas(measure, f"doc_id {kind}, fold int, lang string, words int, known_share double, formula_grade double, raw double"))
    bins = measured.where("raw IS NOT NULL").groupBy("fold", (F.round(F.col("raw") * 10) / 10).alias("x")).agg(F.percentile_approx("formula_grade", 0.5).alias("y"), F.count(F.lit(1)).alias("w")).collect()
    level = F.lit(None).cast("double")
    for fold in range(folds):
        steps = _isotonic([(r.x, r.y, float(r.w)) for r in bins if r.fold == (fold + 1) % folds])
        if steps:
            xs, ys = F.array(*[F.lit(float(x)) for x, _ in steps]), F.array(*[F.lit(float(y)) for _, y in steps])
            at = F.size(F.filter(xs, lambda x: x <= F.round(F.col("raw") * 10) / 10 + 1e-9))
            level = F.when((F.col("fold") == fold) & F.col("raw").isNotNull(), F.get(ys, F.greatest(at - 1, F.lit(0)))).otherwise(level)
    return measured.select("doc_id", "lang", "words", "known_share", "formula_grade", level.alias("level"))


def held_out_error(levels: DataFrame) -> DataFrame:
    """``documents, mean_error, within_one``: how far levels with two folds are from the documents' own formula grades."""
    off = F.abs(F.col("level") - F.col("formula_grade"))
    return levels.where("level IS NOT NULL AND formula_grade IS NOT NULL").agg(F.count(F.lit(1)).alias("documents"), F.avg(off).alias("mean_error"), F.avg((off <= 1).cast("double")).alias("within_one"))
