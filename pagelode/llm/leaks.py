"""Held-out passages that appear in a corpus: latent semantic candidates, then word-by-word checks.

Passages are windows of words over the vocabulary of the held-out items.  A
distributed randomised SVD of their TF-IDF matrix over the whole corpus gives
a latent space; corpus windows whose cosine with a window of an item reaches a
threshold make (document, item) candidates, and these are checked for copied
stretches, the longest common subsequence and the item's numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

_DIVIDED = re.compile(r"[-‐­¬]\s*\n\s*")
_PAGE_MARK = re.compile(r"([-‐­¬]?)\s*<-{2,}\s*Page Split\s*-{2,}>\s*", re.IGNORECASE)
#: Marks that aren't part of words.
_MARKS = "‘’“”‚„–—―…·•«»‐‑­¬€£¥₹§°©®™′″‹›"
_DROP = bytes(c for c in range(33, 127) if not (chr(c).isalnum() or c == ord("|")))
#: Characters that scanners confuse, each folded into one of its class.
_READ = {"†": "t", "�": "a", "ﬁ": "fi", "ﬂ": "fl"}
_FOLD = bytes.maketrans(b"01i|59e", b"olllsgc")


def fold(text: str) -> list[bytes]:
    """Words of a text in a form in which case, punctuation, divisions and misread characters don't show."""
    if "<--" in text:
        text = _PAGE_MARK.sub(lambda m: "" if m[1] else " ", text)
    text = _DIVIDED.sub("", text).lower()
    if not text.isascii():
        for c in _MARKS:
            if c in text:
                text = text.replace(c, "")
        for c, letters in _READ.items():
            if c in text:
                text = text.replace(c, letters)
    raw = text.encode("utf-8", "replace").translate(_FOLD, _DROP)
    return raw.replace(b"rn", b"m").replace(b"vv", b"w").replace(b"cl", b"d").replace(b"ll", b"h").split()


@dataclass
class Items:
    """Held-out items as folded words; the first ``terms`` ids are words, later ones numbers."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[bytes, int]
    terms: int
    kind: type = np.int16

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        numbers, plain = {}, {}
        for _, text in rows:
            for raw in _DIVIDED.sub("", text).split():
                for w in fold(raw):
                    (numbers if re.search(r"\d", raw) else plain).setdefault(w)
        plain = [w for w in plain if w not in numbers]
        vocabulary = {w: i for i, w in enumerate([*plain, *numbers])}
        kind = np.int16 if len(vocabulary) < 32_000 else np.int32
        words = [np.array([vocabulary.get(w, -1) for w in fold(t)], kind) for _, t in rows]
        return cls([int(i) for i, _ in rows], words, vocabulary, len(plain), kind)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text's words; -1 for words of no item."""
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in fold(text)], self.kind)


def _windows(ids: np.ndarray, size: int, stride: int) -> list[np.ndarray]:
    last = max(len(ids) - size, 0)
    return [ids[s : s + size] for s in [*range(0, last, stride), last]]


@dataclass
class Sparse:
    """TF-IDF of windows as (row, word, weight) sorted by row, scaled by the whole norm, words of no item included."""

    row: np.ndarray
    word: np.ndarray
    weight: np.ndarray
    n: int
    table: np.ndarray | None = None

    @classmethod
    def of(cls, flat: np.ndarray, row: np.ndarray, n: int, idf: np.ndarray, outside: float) -> Sparse:
        if not len(flat):
            return cls(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), n)
        size = np.bincount(row, minlength=n)
        # every window's words in order, so that equal words stand together; -2 fills up and stands for words that don't count
        table = np.full((n, size.max()), -2, np.int16 if len(idf) < 32_000 else np.int32)
        table[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.where(flat < len(idf), flat, -2)
        table.sort(axis=1)
        new = np.ones(table.shape, bool)
        new[:, 1:] = table[:, 1:] != table[:, :-1]
        start = np.flatnonzero(new.ravel())
        count = np.diff(start, append=table.size)
        word, at = table.ravel()[start].astype(np.int64), start // table.shape[1]
        norm = np.zeros(n)
        norm += np.bincount(at[word == -1], count[word == -1] * outside**2, n)
        keep = word >= 0
        at, word = at[keep], word[keep]
        weight = count[keep] * idf[word]
        norm += np.bincount(at, weight**2, n)
        return cls(at, word, weight / np.maximum(np.sqrt(norm), 1e-9)[at], n)

    def part(self, rows: np.ndarray) -> Sparse:
        """Some rows only, in order."""
        to = np.full(self.n, -1)
        to[rows] = np.arange(len(rows))
        keep = to[self.row] >= 0
        return Sparse(to[self.row[keep]], self.word[keep], self.weight[keep], len(rows))

    def dense(self, terms: int) -> np.ndarray | None:
        """The rows written out, if there are few enough words for that to be the faster way."""
        if terms > 8192:
            return None
        if self.table is None:
            self.table = np.zeros((self.n, terms), np.float32)
            self.table[self.row, self.word] = self.weight
        return self.table

    def times(self, basis: np.ndarray) -> np.ndarray:
        """The windows' images under a basis with one row a word."""
        if (table := self.dense(len(basis))) is not None:
            return table @ basis
        out = np.zeros((self.n, basis.shape[1]), basis.dtype)
        if len(self.row):
            first = np.flatnonzero(np.diff(self.row, prepend=-1))
            out[self.row[first]] = np.add.reduceat(basis[self.word] * self.weight.astype(basis.dtype)[:, None], first, axis=0)
        return out

    def gather(self, image: np.ndarray, into: np.ndarray) -> None:
        """Add the transpose times ``image`` into ``into``, word by word."""
        if (table := self.dense(len(into))) is not None:
            into += table.T @ image
        elif len(self.row):
            order = np.argsort(self.word, kind="stable")
            word = self.word[order]
            first = np.flatnonzero(np.diff(word, prepend=-1))
            into[word[first]] += np.add.reduceat(image[self.row[order]] * self.weight.astype(image.dtype)[order][:, None], first, axis=0)


def _stacked(windows: list[np.ndarray], idf: np.ndarray, outside: float) -> Sparse:
    size = np.fromiter(map(len, windows), np.int64, len(windows))
    return Sparse.of(np.concatenate(windows).astype(np.int64), np.repeat(np.arange(len(windows)), size), len(windows), idf, outside)


def _grid(batch: pd.Series, size: int, kind: type) -> tuple[np.ndarray, np.ndarray, int]:
    """Word ids of a batch of documents with the numbers of their windows, laid end to end within each document."""
    texts = [np.frombuffer(raw, kind) for raw in batch]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    windows = -(-lengths // size)
    if not lengths.sum():
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    flat = np.concatenate(texts).astype(np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return flat, place // size + np.repeat(np.cumsum(windows) - windows, lengths), int(windows.sum())


def _power(corpus: DataFrame, basis: np.ndarray, idf: np.ndarray, outside: float, size: int, kind: type) -> np.ndarray:
    """A'A times a basis, where A holds the TF-IDF rows of all windows of the corpus."""
    shared = corpus.sparkSession.sparkContext.broadcast((basis.astype(np.float32), idf, outside))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, weights, out = shared.value
        total = np.zeros(q.shape, np.float64)
        for batch in batches:
            flat, row, n = _grid(batch["ids"], size, kind)
            for lo in range(0, n, 4096):
                i, j = np.searchsorted(row, (lo, lo + 4096))
                x = Sparse.of(flat[i:j], row[i:j] - lo, min(4096, n - lo), weights, out)
                x.gather(x.times(q), total)
        yield pd.DataFrame({"term": np.arange(len(total)), "row": list(total)})

    n, k = basis.shape
    sums = corpus.select("ids").mapInPandas(work, "term int, row array<double>").groupBy("term").agg(F.array(*[F.sum(F.col("row")[i]) for i in range(k)]).alias("row"))
    out = np.zeros((n, k))
    for r in sums.collect():
        out[r.term] = r.row
    return out


def latent_space(corpus: DataFrame, idf: np.ndarray, outside: float, size: int, rank: int, kind: type = np.int16, seed: int = 1) -> np.ndarray:
    """Leading right singular vectors by a randomised range finder, one power round and a Rayleigh-Ritz step."""
    n = len(idf)
    k = min(rank + 8, n)
    start, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, k)))
    q, _ = np.linalg.qr(_power(corpus, start, idf, outside, size, kind))
    small = q.T @ _power(corpus, q, idf, outside, size, kind)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (q @ vectors[:, np.argsort(values)[::-1][:rank]]).astype(np.float32)


def copied(document: np.ndarray, places: dict[int, np.ndarray], least: int) -> int:
    """Words of an item, given by the places of each word, that lie in stretches of at least ``least`` words that the document shares."""
    at = [(i, places[w]) for i, w in enumerate(document.tolist()) if w in places]
    if not at:
        return 0
    size = np.fromiter((len(p) for _, p in at), np.int64, len(at))
    i, j = np.repeat(np.fromiter((x for x, _ in at), np.int64, len(at)), size), np.concatenate([p for _, p in at])
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(i) != 1) | (np.diff(j) != 1)
    run = np.cumsum(new) - 1
    long = np.bincount(run)[run] >= least
    return len(np.unique(j[long]))


def places_of(item: np.ndarray) -> dict[int, np.ndarray]:
    """Where each word of an item stands in it."""
    return {int(w): np.flatnonzero(item == w) for w in np.unique(item) if w >= 0}


def subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of words, by bits of one number."""
    places: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        if x >= 0:
            places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a.tolist():
        if m := places.get(x):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def leaked_passages(
    documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, passage: str, rank: int = 96, window: int = 32, stride: int = 16, cosine: float = 0.5, least: int = 8, copied_least: float = 1 / 3, order_least: float = 0.6, answer_least: float = 0.75, max_items: int = 20_000
) -> DataFrame:
    """Candidate pairs of documents and items with the evidence of a leak.

    Returns ``doc_id, item_id, cosine, copied_share, lcs_share, answer_share,
    verdict`` for every document with a window near an item's window: the share
    of the item's words copied in stretches of at least ``least`` words, the
    longest common subsequence around the near windows as a share of the item,
    and the share of the item's numbers found there (null for items without
    numbers).  ``verdict`` is ``copy`` when at least ``copied_least`` of the
    item is copied; else ``paraphrase`` when ``order_least`` of its words come
    in its order and ``answer_least`` of its numbers are there; else
    ``similar``, a text on the same subject with other facts.  Every document
    is read whole and in every window, and every window meets every item.  Null and empty texts or
    passages and rows without id give nothing; repeated rows are reported
    again.  The items' number is checked against ``max_items``; all of them
    are sent to every task.
    """
    rows = items.where(F.col(item_id).isNotNull() & (F.trim(passage) != "")).select(item_id, passage).orderBy(item_id).limit(max_items + 1).collect()
    if len(rows) > max_items:
        raise ValueError(f"more than {max_items} items")
    held = Items.of([(r[0], r[1]) for r in rows])
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("__id"), F.col(text).alias("__t")).where("__id IS NOT NULL AND __t <> ''")
    kind = dict(docs.dtypes)["__id"]
    schema = f"doc_id {kind}, item_id bigint, cosine double, copied_share double, lcs_share double, answer_share double, verdict string"
    if not held.ids or not held.terms:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(held)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["__id"], "ids": [shared.value.encode(t).tobytes() for t in batch["__t"]]})

    # two bytes a word, of which most are alike
    corpus = durable(docs.mapInPandas(encode, f"doc_id {kind}, ids binary"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = shared.value.terms
        n = np.zeros(v + 1, np.int64)
        for batch in batches:
            flat, row, windows = _grid(batch["ids"], window, shared.value.kind)
            inside = (flat >= 0) & (flat < v)
            n[:-1] += np.bincount(np.unique(row[inside] * v + flat[inside]) % v, minlength=v)
            n[-1] += windows
        yield pd.DataFrame({"term": np.arange(len(n)), "n": n})

    df = np.zeros(held.terms + 1)
    for r in corpus.select("ids").mapInPandas(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r.term] = r.n
    idf = np.log1p(df[-1] / np.maximum(df[:-1], 1)).astype(np.float32)
    outside = float(np.median(idf)) / 2
    space = latent_space(corpus, idf, outside, window, rank, held.kind)
    targets, owner = [], []
    for i, w in enumerate(held.words):
        for part in _windows(w, window, stride // 4):
            targets.append(part)
            owner.append(i)
    image = _stacked(targets, idf, outside).times(space)
    image /= np.maximum(np.linalg.norm(image, axis=1), 1e-9)[:, None]
    owner = np.array(owner)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    plan = spark.sparkContext.broadcast((idf, outside, space, image.astype(np.float32), first))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        weights, out, space, image, first = plan.value
        stands = [places_of(w) for w in held.words]
        for batch in batches:
            texts = [np.frombuffer(raw, held.kind) for raw in batch["ids"]]
            place, owner_, ends, base = [], [], [], 0
            for n, w in enumerate(texts):
                if len(w) >= least:
                    last = max(len(w) - window, 0)
                    at = np.append(np.arange(0, last, stride), last)
                    place.append(at + base)
                    owner_.append(np.full(len(at), n))
                    ends.append(np.minimum(at + window, len(w)) + base)
                base += len(w)
            if not place:
                continue
            flat = np.concatenate(texts).astype(np.int64)
            at, who, to = np.concatenate(place), np.concatenate(owner_), np.concatenate(ends)
            offset = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) - np.fromiter(map(len, texts), np.int64, len(texts))
            best: dict[tuple[int, int], list] = {}
            for lo in range(0, len(at), 2048):
                a, e = at[lo : lo + 2048], to[lo : lo + 2048]
                size = e - a
                row = np.repeat(np.arange(len(a)), size)
                index = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
                x = Sparse.of(flat[index], row, len(a), weights, out)
                # an image is no longer than its window's part in the items' words, so a shorter one is near nothing
                able = np.flatnonzero(np.bincount(x.row, x.weight**2, len(a)) >= cosine**2 * (1 - 1e-6))
                if not len(able):
                    continue
                image_ = x.part(able).times(space)
                near = np.maximum.reduceat(image_ @ image.T, first, axis=1)
                a, whose = a[able], who[lo : lo + 2048][able]
                for r, c in zip(*np.nonzero(near >= cosine)):
                    n = int(whose[r])
                    s = int(a[r] - offset[n])
                    b = best.setdefault((n, c), [0.0, s, s])
                    b[0], b[1], b[2] = max(b[0], float(near[r, c])), min(b[1], s), max(b[2], s)
            found: list[tuple] = []
            for (n, c), (near_, lo, hi) in best.items():
                w, item = texts[n], held.words[c]
                around = w[max(lo - window, 0) : hi + 2 * window]
                figures = np.unique(item[item >= held.terms])
                answer = float(np.isin(figures, around).mean()) if len(figures) else None
                share, order = copied(w, stands[c], least) / len(item), subsequence(around, item) / len(item)
                verdict = "copy" if share >= copied_least - 1e-9 else "paraphrase" if order >= order_least and (answer is None or answer >= answer_least) else "similar"
                found.append((batch["doc_id"].iloc[n], held.ids[c], near_, share, order, answer, verdict))
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "cosine", "copied_share", "lcs_share", "answer_share", "verdict"])

    return corpus.mapInPandas(search, schema)
