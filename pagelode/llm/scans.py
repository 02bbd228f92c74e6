"""Text of scanned pages repaired by a noisy channel.

A line of a page is either furniture (running header, footer, page number) or
body.  Body words are decoded by Viterbi: candidates are the word as it stands
and the known words that a few character confusions turn into it; a
candidate's score is its confusion probabilities times its n-gram likelihood.
Words divided by a line's or page's end are joined unless the pieces are known
as a compound.  All counts are taken over all pages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, with_small

#: Fixed values: (as read, as printed) shapes that scanners confuse in words.
CONFUSIONS = (
    ("1", "i"), ("1", "l"), ("|", "l"), ("|", "i"), ("!", "l"), ("0", "o"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("c", "e"), ("e", "c"),
    ("†", "t"), ("cl", "d"), ("rn", "m"), ("li", "h"), ("vv", "w"), ("ii", "u"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("�", "a"),
)
_ODD = re.compile(r"[0-9|!†�ﬁﬂﬀ]")
_NUMBER = re.compile(r"^(?:us\$|[a-z]\$|[$£€₹¥])?[0-9oil|sb][0-9oil|sb,.]*%?$")
_MASK = str.maketrans("0123456789", "#" * 10)
_DIGITS = str.maketrans({"o": "0", "l": "1", "i": "1", "|": "1", "s": "5", "b": "8"})
_HYPHENS = "-‐­¬"
_DIGIT = re.compile(r"\d")
_FIGURE = re.compile(r"[0-9](?:[0-9.,]*[0-9])?\Z")
_END = re.compile(r"(\S+?)([" + _HYPHENS + r"])(\s*)$")
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
_PIECE = re.compile(r"[^\s\-‐­¬–—/]+")
_EDGE = ".,;:!?\"'()[]{}“”‘’«»*"
_LEGAL = {"plc", "inc", "ltd", "limited", "corporation", "corp", "company", "holdings", "group"}
_N = r"([0-9OolI|S]{1,5})"
_PAGE_NUMBERS = tuple(
    re.compile("^" + p + "$") for p in (_N, r"([ivxl]{1,6}|[IVXL]{1,6})", r"[Pp][Aa][Gg9][EeCc]\s" + _N + r"(?:\s[o0][f]\s[0-9OolI|]{1,5})?", _N + r"\s[o0O][fF]\s[0-9OolI|]{1,5}", r"[A-Z]-" + _N, r"[-–—]\s?" + _N + r"\s?[-–—]", r"\|\s?" + _N, _N + r"/[0-9OolI|]{1,5}", r"\[" + _N + r"\]")
)
_SHAPES = str.maketrans({"0": "o", "1": "l", "i": "l", "|": "l", "5": "s", "9": "g", "e": "c", "†": "t", "�": "a", "ﬁ": "fl", "ﬂ": "fl"})


@lru_cache(maxsize=200_000)
def shape(word: str) -> str:
    """A word's letters with confused shapes made equal."""
    return word.lower().translate(_SHAPES).replace("rn", "m").replace("vv", "w").replace("cl", "d").replace("ll", "h")


_LEGAL_SHAPES = {shape(w) for w in _LEGAL}


def key_of(core: str) -> str:
    word = core.lower()
    return word if word.isalpha() else word.translate(_MASK)


#: What stands for a front matter number, which no page's own number is compared with.
ROMAN = -1


def number_on(text: str) -> int | None:
    """The number of a text that is a page number, else None; 0 if it can't be read."""
    if len(text) > 24:  # no form is longer
        return None
    if not _DIGIT.search(text):
        return ROMAN if _PAGE_NUMBERS[1].match(text) else None
    for p in _PAGE_NUMBERS:
        if m := p.match(text):
            digits = m[1].lower().translate(_DIGITS)
            return int(digits) if digits.isdigit() else 0
    return None


def split_number(line: str) -> tuple[str, str | None]:
    """The line without a page number set off by wide space at one end, and the number's text."""
    line = line.strip()
    if "  " not in line and "\t" not in line:
        return line, None
    for m in (re.match(r"^(.*\S)\s{2,}(\S+(?:\s\S+){0,3})$", line), re.match(r"^(\S+(?:\s\S+){0,3}?)\s{2,}(\S.*)$", line)):
        if m:
            a, b = (m[1], m[2]) if m.re.pattern.startswith("^(.*") else (m[2], m[1])
            if number_on(b) is not None:
                return a, b
    return line, None


def element(word: str) -> str:
    """What a word contributes to a header's form."""
    core = word.strip(_EDGE)
    if not core.isalpha() and (digits := len(_DIGIT.findall(word))) and len(re.sub(r"[0-9OolI|S.,\-]", "", core)) < min(digits, 2):
        return "#"
    return "|" if word == "|" else shape(core or word)


def skeleton(line: str) -> str:
    """A header's form: numbers, and a company's name, masked; confused shapes made equal."""
    out: list[str] = []
    small, ended = 0, False
    for word in line.split():
        out.append(element(word))
        if out[-1] in "#|":
            continue
        core = word.strip(_EDGE)
        small += word[:1].islower() and core not in _LEGAL
        ended |= word[-1] in ".,;:" and core.lower() not in _LEGAL  # a sentence's end, so no name
        if out[-1] in _LEGAL_SHAPES and len(out) <= 8 and not ended and "|" not in out and "#" not in out and small <= (len(out) > 2 or out[0] == "@"):
            out = ["@"]
    return " ".join(out)


def pieces(line: str) -> list[tuple[int, str]]:
    """Words of a line with their places, without punctuation at their edges."""
    if line.isalnum():
        return [(0, line)]
    out = []
    for m in _PIECE.finditer(line):
        raw = m[0]
        if raw[0].isalnum() and raw[-1].isalnum():
            out.append((m.start(), raw))
        elif core := raw.strip(_EDGE):
            out.append((m.start() + raw.index(core), core))
    return out


class Traits(dict):
    """Of a word between blanks: 1 if noise explains none of its parts, plus 2 if it ends a company's name, plus 4 if a known header begins so."""

    CLEAN, NAME, FIRST, HEADER = {1, 3, 5, 7}, {2, 3, 6, 7}, {4, 5, 6, 7}, {2, 3, 4, 5, 6, 7}

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, word: str) -> int:
        m = self.model
        if _FIGURE.match(word):
            return 1 + 4 * ("#" in m.firsts)
        e = element(word)
        n = all(len(m.candidates(core)) == 1 for _, core in pieces(word)) + 2 * (e in _LEGAL_SHAPES) + 4 * (e in m.firsts)
        if len(self) < 400_000:
            self[word] = n
        return n

    def __reduce__(self) -> tuple:
        return Traits, (self.model,)


@dataclass
class Model:
    """What the pages taught: word and word-pair counts, compounds, header forms and confusion probabilities."""

    total: float = 1.0
    words: dict[str, float] = field(default_factory=dict)
    pairs: dict[tuple[str, str], float] = field(default_factory=dict)
    compounds: dict[str, float] = field(default_factory=dict)
    first_parts: set[str] = field(default_factory=set)
    headers: set[str] = field(default_factory=set)
    confusion: dict[tuple[str, str], float] = field(default_factory=dict)
    cache: dict = field(default_factory=dict)
    logs: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.settle()

    def settle(self) -> None:
        """Bounds that follow from what is known: first elements and words of a header, letters of a word."""
        self.firsts = {h.partition(" ")[0] for h in self.headers}
        self.header_words = max((h.count(" ") + 1 for h in self.headers), default=0) + 7  # a name's mask stands for up to eight words
        self.letters = max(map(len, self.words), default=0) + 2  # two confusions take two letters at most
        self.traits = Traits(self)
        self.logs = {}

    def variants(self, word: str, edits: int = 2) -> dict[str, tuple[float, tuple[int, ...]]]:
        """Words that confusions turn into ``word``: log probability and the places of the misread characters."""
        found: dict[str, tuple[float, tuple[int, ...]]] = {}
        front = {(): (word, 0.0)}
        for _ in range(edits):
            after = {}
            for places, (text, log) in front.items():
                done = places[-1][0] if places else 0
                shift = len(text) - len(word)
                for (read, printed), p in self.confusion.items():
                    at = word.find(read, done)
                    while at >= 0:
                        new = text[: at + shift] + printed + text[at + shift + len(read) :]
                        score = log + math.log(p)
                        marks = (*places, (at + len(read), at))
                        if new not in found or found[new][0] < score:
                            found[new] = (score, tuple(m[1] for m in marks))
                        after[marks] = (new, score)
                        at = word.find(read, at + 1)
            front = after
        found.pop(word, None)
        return found

    def plausible(self, word: str) -> float:
        """Log probability of a word by itself."""
        log = self.logs.get(word)
        if log is None:
            log = self._plausible(word)
            if len(self.logs) < 400_000:
                self.logs[word] = log
        return log

    def _plausible(self, word: str) -> float:
        n = self.words.get(key_of(word), 0.0)
        if n > 0:
            return math.log(n / self.total)
        if re.search(r"\d", word) and _NUMBER.match(word):
            bare = re.sub(r"^(?:us\$|[a-z]\$)", "", word)
            return math.log((1e-7 if re.search(r"[oil|sb]", bare) else 1.0) / self.total)
        odd = _ODD.search(word) and sum(map(str.isalpha, word)) >= 3
        return math.log((1e-7 if odd else 0.02) / self.total)

    def candidates(self, core: str) -> list[tuple[str, float, tuple[int, ...]]]:
        """The word as it stands and the likelier ones it may be misread from."""
        word = core.lower()
        if word not in self.cache:
            if len(self.cache) > 300_000:
                self.cache.clear()
            self.cache[word] = self._candidates(word)
        return self.cache[word]

    def _candidates(self, word: str) -> list[tuple[str, float, tuple[int, ...]]]:
        out = [(word, 0.0, ())]
        if re.search(r"\d", word):
            if not _NUMBER.match(word) and sum(map(str.isalpha, word)) < 3:
                return out
            if _NUMBER.match(word):
                bare = re.sub(r"^(?:us\$|[a-z]\$|[$£€₹¥])", "", word)
                marks = tuple(i + len(word) - len(bare) for i, c in enumerate(bare) if c in "oil|sb")
                if marks and self.words.get(key_of(word), 0) < 1e-4 * self.total and key_of(word) not in self.words:
                    out.append((word[: len(word) - len(bare)] + bare.translate(_DIGITS), 0.0, marks))
                return out
            if m := re.match(r"^(fy)([0-9ol|s]{4})$", word):
                marks = tuple(i + 2 for i, c in enumerate(m[2]) if not c.isdigit())
                return [*out, (m[1] + m[2].translate(_DIGITS), 0.0, marks)] if marks else out
        elif self.words.get(word, 0.0) > 0:
            return out  # words that noise explains aren't known
        if len(word) > self.letters or not any(c.isalpha() or c in "†�|ﬁﬂ" for c in word):
            return out  # no known word is so long
        for v, (log, marks) in self.variants(word).items():
            n = self.words.get(key_of(v), 0.0)
            if n > 0 and not _ODD.search(v):
                out.append((v, log, marks))
        if len(out) == 1 and _ODD.search(word) and sum(map(str.isalpha, word)) >= 3 and key_of(word) not in self.words:
            clean = [(v, log, marks) for v, (log, marks) in self.variants(word).items() if v.isalpha()]
            if clean:
                out.append(max(clean, key=lambda x: (x[1], x[0])))
        return out

    def follow(self, before: str, word: str) -> float:
        """Log likelihood of a word after another."""
        alone = math.exp(self.plausible(word))
        before, word = key_of(before), key_of(word)
        n = self.words.get(before, 0.0) if word in self.words else 0.0
        both = self.pairs.get((before, word), 0.0) / n if n else 0.0
        return math.log(0.6 * min(both, 1.0) + 0.4 * alone)

    def decode(self, words: list[str]) -> list[tuple[str, tuple[int, ...]]]:
        """Viterbi: the best reading of each word of a line, with the places of misread characters."""
        states = [self.candidates(w) for w in words]
        if all(len(s) == 1 for s in states):
            return [(s[0][0], ()) for s in states]
        score = [self.plausible(w) + log for w, log, _ in states[0]]
        back: list[list[int]] = []
        for i in range(1, len(states)):
            if len(states[i]) == len(states[i - 1]) == 1:  # nothing to choose
                back.append([0])
                continue
            row, links = [], []
            for w, log, _ in states[i]:
                options = [score[k] + self.follow(states[i - 1][k][0], w) for k in range(len(states[i - 1]))]
                k = max(range(len(options)), key=options.__getitem__)
                row.append(options[k] + log)
                links.append(k)
            score = row
            back.append(links)
        k = max(range(len(score)), key=score.__getitem__)
        path = [k]
        for links in reversed(back):
            k = links[k]
            path.append(k)
        return [(states[i][k][0], states[i][k][2]) for i, k in enumerate(reversed(path))]

    def is_furniture(self, line: str, traits: set[int], page: int | None, own: frozenset[str] = frozenset()) -> bool:
        """Whether a line, whose words have these traits, belongs to the printed page; ``own`` are header forms of the page's report."""
        line = line.strip()
        if not line:
            return False
        n = number_on(line)
        if n is not None:
            return n in (page, ROMAN) or not _PAGE_NUMBERS[0].match(line)
        rest, number = split_number(line)
        words = rest.split()
        if len(words) > self.header_words and not own:
            return False
        if own or self.traits[words[0]] in Traits.FIRST or not traits.isdisjoint(Traits.NAME):
            form = skeleton(rest)
            if form in self.headers or form in own:
                # a name alone may be the end of a sentence
                return form != "@" or not rest[:1].islower() or bool(_ODD.search(words[0]))
        # a page number beside a form that is too rare to be known
        return number is not None and page is not None and len(words) <= 9 and number_on(number) in (page, ROMAN) and not re.search(r"\d\s*$", rest)

    def divided(self, tail: str, mark: str, blank: str, head: str | None) -> bool:
        """Whether a line's last word goes on in the next body line."""
        if not tail or not tail[-1].isalpha() and not _ODD.search(tail[-1]):
            return False
        if mark != "-" or blank:
            return head is None or bool(head)
        a = tail.lower().strip(_EDGE)
        if head is None:
            return a.split("-")[-1] not in self.first_parts and a not in self.first_parts
        if not head or head[0].isdigit() and not any(map(str.isalpha, head)):
            return False
        b = head.lower().strip(_EDGE)
        joined, compound = self.words.get(a + b, 0.0), self.compounds.get(a + "-" + b, 0.0)
        if joined != compound:
            return joined > compound
        for v in (self.variants(a + b, 1), ):
            if any(self.words.get(x, 0.0) > 0 for x in v):
                return True
        return a not in self.first_parts


def _bare_first(line: str) -> str:
    """First word of a line up to a hyphen or slash."""
    words = line.split(None, 1)
    return re.split(r"[" + _HYPHENS + r"/]", words[0])[0] if words else ""


@dataclass
class Repaired:
    """A page's noisy lines by kind, its first body word, whether its last body line ends with a hyphen, and its text in paragraphs."""

    noise: list[tuple[int, str]]
    head: str | None
    open: bool
    text: str | None


def repair(text: str, page: int | None, head: str | None, model: Model, own: frozenset[str] = frozenset(), whole: bool = True) -> Repaired:
    """Find and mend a page's noise.  ``head`` is the next page's first body word, null when that page is missing; ``whole`` asks for the text too."""
    lines = text.split("\n")
    trait = model.traits.__getitem__
    words = [x.split() for x in lines]
    traits = [set(map(trait, w)) for w in words]
    # most lines are too long for a number alone, set off nothing and begin as no header does
    furniture = [
        (len(x) <= 24 or own or not t.isdisjoint(Traits.HEADER) or "  " in x or "\t" in x) and model.is_furniture(x, t, page, own)
        for x, t in zip(lines, traits)
    ]
    noise = [(i, "furniture") for i, f in enumerate(furniture) if f]
    body = [i for i, w in enumerate(words) if w and not furniture[i]]
    follower = dict(zip(body, body[1:]))
    glyph: set[int] = set()
    fixed: dict[int, str] = {}
    joins: set[int] = set()
    open_end = False
    for i in body:
        if words[i][-1][-1] not in _HYPHENS or not (m := _END.search(lines[i])):
            continue
        if i in follower:
            after: str | None = _bare_first(lines[follower[i]])
        else:
            after, open_end = head, True
        if model.divided(re.split(r"[(/]", m[1])[-1], m[2], m[3], after):
            joins.add(i)
    noise += [(i, "hyphen") for i in joins]
    led = {follower[i] for i in joins if i in follower}
    for i in body:
        clean = traits[i] <= Traits.CLEAN
        if clean and i not in joins:
            continue
        edits = []
        if not clean:
            found = pieces(lines[i])
            decoded = model.decode([w for _, w in found])
            first, last = int(i in led), len(found) - (i in joins)
            for (at, core), (best, marks) in zip(found[first:last], decoded[first:last]):
                if marks:
                    glyph.add(i)
                    edits.append((at, core, _cased(core, best)))
        if i in joins and (tail := pieces(words[i][-1])):
            core = tail[-1][1]
            if i in follower:
                rest = pieces(words[follower[i]][0])
                _, marks = model.decode([core + (rest[0][1] if rest else "")])[0]
                if any(k < len(core) for k in marks):
                    glyph.add(i)
                if any(k >= len(core) for k in marks):
                    glyph.add(follower[i])
            elif _ODD.search(core) and sum(map(str.isalpha, core)) >= 2:
                glyph.add(i)
        if whole:
            line = lines[i]
            for at, core, new in reversed(edits):
                line = line[:at] + new + line[at + len(core) :]
            fixed[i] = re.sub(r"[" + _HYPHENS + r"]\s*$", "", line) if i in joins else line
    noise += [(i, "glyph") for i in glyph]
    return Repaired(sorted(noise), _bare_first(lines[body[0]]) if body else None, open_end, _paragraphs(lines, furniture, fixed, joins) if whole else None)


def _cased(old: str, new: str) -> str:
    if old.isupper():
        return new.upper()
    return new[:1].upper() + new[1:] if old[:1].isupper() else new


def _paragraphs(lines: list[str], furniture: list[bool], fixed: dict[int, str], joins: set[int]) -> str:
    """Body lines joined to paragraphs; headings and table rows keep their lines."""
    out, glue = [], "\n"
    for i, line in enumerate(lines):
        if furniture[i]:
            continue
        if not line.strip():
            if out and glue != "":
                glue = "\n\n"
            continue
        row = bool(re.search(r"\s{2,}[(\-]?[$£€]?\d", line)) or len(line) < 40 and not re.search(r"[.,;]\s*$", line) and i not in joins
        if out:
            out.append(glue if glue in ("", "\n\n") else "\n" if row else glue)
        out.append(fixed.get(i, line).strip())
        glue = "" if i in joins else "\n" if row else " "
    return "".join(out)


class _Keys(dict):
    """Keys of the words of a token between blanks."""

    def __missing__(self, token: str) -> tuple[str, ...]:
        keys = (token.translate(_MASK),) if _FIGURE.match(token) else tuple(key_of(w) for _, w in pieces(token))
        if len(self) < 400_000:
            self[token] = keys
        return keys


class Tally:
    """Counts over pages: words, word pairs, compounds, and header forms by report."""

    def __init__(self) -> None:
        self.keys, self.words, self.pairs, self.compounds, self.headers, self.pages = _Keys(), Counter(), Counter(), Counter(), Counter(), 0

    def add(self, text: str, page: int | None, report: str | None) -> None:
        self.pages += 1
        keys, key = self.keys, self.keys.__getitem__
        flat: list[str] = []  # "" parts words that don't follow each other
        broken = False
        for line in text.split("\n"):
            end = line.rstrip()
            if not end:
                continue
            if "  " in end or "\t" in end:
                rest, number = split_number(line)
                if number is not None and page is not None and number_on(number) == page:
                    self.headers[skeleton(rest), report] += 1
                    continue
            if len(end) <= 24 or line[0].isspace():
                if number_on(line.strip()) is not None:
                    continue
            ends = end[-1] in _HYPHENS
            if "-" in line:
                for m in _COMPOUND.finditer(line[:-1] if ends else line):
                    if m.end() < len(end) - 1:
                        self.compounds[m[0].lower()] += 1
            if ends or broken:
                words = [k for t in end.split() for k in keys[t]]
                if broken:
                    words[:1] = [""]
                if ends:
                    words[-1:] = [""]
                flat += words
                broken = ends
            else:
                flat.extend(chain.from_iterable(map(key, end.split())))
        self.words.update(flat)
        self.pairs.update(pairwise(flat))

    def rows(self) -> pd.DataFrame:
        """``kind, a, b, n``; the counts begin anew."""
        out = [("word", w, "", n) for w, n in self.words.items() if w] + [("pair", a, b, n) for (a, b), n in self.pairs.items() if a and b]
        out += [("compound", c, "", n) for c, n in self.compounds.items()] + [("header", f, r, n) for (f, r), n in self.headers.items()] + [("pages", "", "", self.pages)]
        self.__init__()
        return pd.DataFrame(out, columns=["kind", "a", "b", "n"])


def learn(pages: DataFrame, share: float = 5e-7, least: int = 3, pair_share: float = 2e-6, header_share: float = 5e-4, report_pages: int = 3) -> tuple[Model, DataFrame]:
    """The model of ``text, page, report``, counted over all pages, and the header forms of single reports.

    A word or compound is known with at least ``least`` occurrences and a
    ``share`` of all words, a word pair with ``pair_share``, so that there are
    at most 1/share of each.  A header form stands beside the page's own
    number; on ``header_share`` of all pages it is known everywhere, on
    ``report_pages`` pages of one report in that report, however many others
    there are.  The second result has ``report, forms``.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = Tally()
        for batch in batches:
            for t, p, r in zip(batch["text"], batch["page"], batch["report"]):
                tally.add(t, _whole(p), r if isinstance(r, str) else None)
            if len(tally.words) + len(tally.pairs) > 1_000_000:
                yield tally.rows()
        yield tally.rows()

    raw = pages.select("text", "page", "report").mapInPandas(count, "kind string, a string, b string, n bigint")
    table = durable(raw.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")))
    sums = {r.kind: r.n for r in table.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    total = float(sums.get("word", 0) or 1)
    bar = F.greatest(F.lit(float(least)), F.when(F.col("kind") == "pair", pair_share * total).otherwise(share * total))
    model = Model(total=total)
    for r in table.where(F.col("kind").isin("word", "pair", "compound") & (F.col("n") >= bar)).toArrow().to_pylist():
        if r["kind"] == "word":
            model.words[r["a"]] = float(r["n"])
        elif r["kind"] == "pair":
            model.pairs[r["a"], r["b"]] = float(r["n"])
        else:
            model.compounds[r["a"]] = float(r["n"])
    headers = table.where("kind = 'header' AND a <> ''")
    common = headers.groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= max(least, header_share * (sums.get("pages", 0) or 0)))
    model.headers = {r.a for r in common.collect()}
    own = headers.where((F.col("n") >= report_pages) & F.col("b").isNotNull()).join(common.select("a"), "a", "left_anti")
    model.first_parts = {c.rpartition("-")[0] for c in model.compounds} | {c.partition("-")[0] for c in model.compounds}
    return _confused(model, table.where("kind = 'word'").select(F.col("a").alias("word"), "n")), own.groupBy(F.col("b").alias("report")).agg(F.collect_set("a").alias("forms"))


def _whole(page: float | None) -> int | None:
    return None if page is None or page != page else int(page)


def _confused(model: Model, types: DataFrame) -> Model:
    """Confusion probabilities from the words that one confusion separates from a far commoner one."""
    model.confusion = {c: 1e-3 for c in CONFUSIONS}
    shared = types.sparkSession.sparkContext.broadcast(model)

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, counts = shared.value, Counter()
        for batch in batches:
            for w, n in zip(batch["word"], batch["n"]):
                for c in CONFUSIONS:
                    read = "#" if c[0].isdigit() else c[0]
                    at = w.find(read)
                    if c[0].isdigit() and not any(map(str.isalpha, w)):
                        continue
                    while at >= 0:
                        v = w[:at] + c[1] + w[at + len(read) :]
                        if m.words.get(v, 0.0) > 20 * n and "#" not in v:
                            counts[c[0], c[1]] += int(n)
                            break
                        at = w.find(read, at + 1)
        yield pd.DataFrame([(*k, v) for k, v in counts.items()], columns=["read", "printed", "n"])

    seen = {(r.read, r.printed): float(r.n) for r in types.mapInPandas(attribute, "read string, printed string, n bigint").groupBy("read", "printed").agg(F.sum("n").alias("n")).collect()}
    printed: Counter = Counter()
    for w, n in model.words.items():
        for p in {c[1] for c in CONFUSIONS}:
            printed[p] += w.count(p) * n
    model.confusion = {c: min(max(seen.get(c, 0.0) + 0.01, 0.01) / (printed[c[1]] + 10.0), 0.05) for c in CONFUSIONS if seen.get(c, 0.0) > 0 or not c[0].isalpha()}
    # counts that noise explains aren't words
    noise = {}
    for w, n in model.words.items():
        if "#" in w:
            bare = re.sub(r"^(?:us\$|[a-z]\$|[$£€₹¥])", "", w)
            if re.match(r"^[oil|sb#,.]+%?$", bare) and re.search(r"[oil|sb]", bare) or re.match(r"^fy[ol|s#]{4}$", w) and not w.endswith("####"):
                noise[w] = True
            elif sum(map(str.isalpha, w)) >= 3 and n < 1e-4 * model.total and not re.match(r"^[a-z]{1,3}#+$", w):
                noise[w] = True
            continue
        expected = sum(model.words.get(v, 0.0) * math.exp(log) for v, (log, _) in model.variants(w, 1).items())
        if n <= 4 * expected + 2 and expected > 0.05 or _ODD.search(w):
            noise[w] = True
    model.words = {w: n for w, n in model.words.items() if w not in noise}
    model.settle()
    return model


def scanned_noise(pages: DataFrame, whole: bool = True) -> DataFrame:
    """Noise and repaired text of every page.

    ``pages`` has ``src, item_key, report, page, text``.  Returns ``src,
    item_key, noise, repaired``: ``noise`` lists the noisy lines (line_no from
    0, kind), ``repaired`` is the page in continuous paragraphs (null unless
    ``whole``).  A page given twice counts once, by the smallest hash of its
    text; in the corpus counts each copy counts.  Null and blank texts give no
    row; rows without key are left out; a page whose successor is missing
    judges a divided last word by itself.

    Texts are read where they lie.  Only the pages whose last body line ends
    with a hyphen travel, to meet the first body word of the next page by
    report and page number, and no report is gathered in a task.
    """
    given = pages.where("item_key IS NOT NULL AND trim(text) <> ''").withColumn("page", F.col("page").cast("int"))
    learnt, own = learn(given)
    model = given.sparkSession.sparkContext.broadcast(learnt)
    given = with_small(given, durable(own), "report", ("src", "item_key"))
    noise_type = "array<struct<line_no: bigint, kind: string>>"
    noted = lambda r: [{"line_no": i, "kind": kind} for i, kind in r.noise]

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for batch in batches:
            out = []
            for src, k, r, p, t, forms in zip(*(batch[c] for c in ("src", "item_key", "report", "page", "text", "forms"))):
                done = repair(t, _whole(p), None, m, frozenset() if forms is None else frozenset(forms), whole)
                out.append((src, k, r, p, done.head, noted(done), done.text, t if done.open else None, forms if done.open else None))
            yield pd.DataFrame(out, columns=["src", "item_key", "report", "page", "head", "noise", "repaired", "text", "forms"])

    parts = f"report string, page double, head string, noise {noise_type}, repaired string, text string, forms array<string>"
    seen = given.select("src", "item_key", "report", F.col("page").cast("double").alias("page"), "text", "forms")
    seen = seen.mapInPandas(first, f"src string, item_key string, {parts}")
    columns = [c for c in seen.columns if c not in ("src", "item_key")]
    digest = F.xxhash64("noise", "head", "text", "repaired")
    once = durable(seen.groupBy("src", "item_key").agg(F.min(F.struct(digest.alias("digest"), *columns)).alias("p")).select("src", "item_key", *[f"p.{c}" for c in columns]))
    heads = once.where("report IS NOT NULL AND page IS NOT NULL AND head IS NOT NULL").groupBy("src", "report", (F.col("page") - 1).alias("page")).agg(F.min("head").alias("next"))
    opened = once.where("text IS NOT NULL").drop("head").join(heads, ["src", "report", "page"])

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for batch in batches:
            out = []
            for src, k, p, t, forms, head in zip(*(batch[c] for c in ("src", "item_key", "page", "text", "forms", "next"))):
                done = repair(t, _whole(p), head, m, frozenset() if forms is None else frozenset(forms), whole)
                out.append((src, k, noted(done), done.text))
            yield pd.DataFrame(out, columns=["src", "item_key", "noise", "repaired"])

    mended = opened.select("src", "item_key", "page", "text", "forms", "next").mapInPandas(again, f"src string, item_key string, noise {noise_type}, repaired string")
    alone = once.where("text IS NOT NULL").join(heads.select("src", "report", "page"), ["src", "report", "page"], "left_anti")
    return once.where("text IS NULL").select(mended.columns).unionByName(alone.select(mended.columns)).unionByName(mended)
