"""Secrets in texts: fixed patterns, and spans a tagger adds to them.

The tagger is a linear-chain conditional random field over the tokens of a
line, runs of letters and digits and single marks, with labels begin, inside and
outside; a secret of letters, digits and marks spans several. Its features are
the token's shape, how far its letters go together as those of words do, the
unbroken run it stands in, the words and marks beside it, and the file.

It learns from a bounded sample of the documents: their lines that hold an odd
token, one with a digit, with a capital after a small letter or of 20 letters,
and some that hold none, labelled with what the patterns find, and made lines (``secret_forms``)
in which secrets of many forms, and numbers, names and addresses that are none,
stand among the sample's words. How well it does on forms that it was not
fitted on is tested, one form left out at a time.

Every token of every line is scored. Most lines have no token whose score could
pay for leaving the label outside, so they are outside as a whole; ``Screen``
finds them by an upper bound, all tokens of a text at once, and the others are
decoded.

Defined results: a null or empty text holds no secrets; repeated rows are
scanned each; an empty table gives an empty one; other columns are carried, but
one of a result's name gives way to it.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, islice
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.crf import Crf
from shelfmark.llm.secret_forms import HARMLESS, SECRETS, Form, line

# fixed values of the contract
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

OUTSIDE, BEGIN, INSIDE = range(3)
TOKEN = re.compile(r"[A-Za-z0-9]+|[^\W_]+|[^\s]")
ODD = re.compile(r"[0-9]|[a-z][A-Z]|[A-Za-z]{20}")
_RUN = re.compile(r"\S+")
_SEGMENT = re.compile(r"[A-Za-z0-9+/_.~-]+=*")  # of a run, as keys are written

# letters and digits of a kind are the same to all features but those of ``LETTERS_OF``
_KIND_CHARACTERS = {
    "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0": "0123456789",
    "\xe9": [c for c in map(chr, range(0xDF, 0x100)) if c.isalpha()],
    "\xc9": [c for c in map(chr, range(0xC0, 0xDF)) if c.isalpha()],
}
KINDS_OF = str.maketrans({c: kind for kind, own in _KIND_CHARACTERS.items() for c in own})
LETTERS_OF = {
    **dict.fromkeys(("like", "like,size", "run.like", "seg.like"), range(6)),
    **dict.fromkeys(("hex,size", "seg.hex"), (True, False)), "seg.dashes": ("uuid", 3),
}
PLAIN_DASHES = ("seg.dashes=0", "seg.dashes=1", "seg.dashes=2")
# features of what stands beside a run, or before a token in it
BESIDE = ("-1:", "-2,-1:", "+1:", "-1,glue:", "+1,glue:", "word-1:", "word-2:", "word-2,-1:", "named")

# the sample that the tagger is fitted on
SAMPLE_DOCS = 4000
SAMPLE_LINES = 3  # of a document, with an odd token
SAMPLE_PLAIN = 1  # of a document, without one
SAMPLE_TOKENS = 48  # of a line, around an odd one
SAMPLE_WORDS = 40  # of a document
MADE_LINES = 120  # of each form
ROWS = 500  # documents whose texts are held at once
KEPT_SHAPES = 3000  # tokens whose shape is kept by a worker, about a KB each
KEPT_RUNS = 20_000  # kinds of runs of characters whose scores are kept by a worker
KEPT_TOKENS = 40_000  # tokens whose names are
SCREENED = 1 << 16  # characters of a text that are screened at once, if a line has no more
LEAST_SEEN = 3  # times a feature is in the sample, to be learnt

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """What the patterns match, and the secret values inside."""
    spans, values = [], []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                spans.append((m.start(), 0, m.end()))
                values.append(m.span(2))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                spans.append((m.start(), 1, m.end()))
                values.append(m.span())
    for m in HEX.finditer(text):
        spans.append((m.start(), 2, m.end()))
        values.append(m.span())
    return sorted(spans), sorted(values)


class Tagger:
    """The field, and how often letters follow each other in the sample's words."""

    def __init__(self, words: list[str] = ()):
        pairs = Counter(p for w in set(words) for p in zip(w.lower(), w.lower()[1:]))
        total = sum(pairs.values())
        self.rare = math.log(1 / (total + 700)) if total else 0.0
        self.pairs = {a + b: math.log((n + 1) / (total + 700)) for (a, b), n in pairs.items()}
        self.field = Crf(3)
        self._shapes: dict[str, list[str]] = {}
        self._screen: Screen | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_shapes": {}, "_screen": None}

    def screen(self) -> Screen:
        """The screen of the field as it is fitted, made once by a worker."""
        if self._screen is None:
            self._screen = Screen(self)
        return self._screen

    def wordlike(self, token: str) -> int:
        """From 0, for letters that do not go together, to 5."""
        low = token.lower()
        pairs = list(map(str.__add__, low, low[1:]))
        if not low.isalpha():
            pairs = [p for p in pairs if p.isalpha()]
        if not pairs or not self.pairs:
            return 2
        known, rare = self.pairs.get, self.rare
        mean = sum([known(p, rare) for p in pairs]) / len(pairs)
        return max(0, min(5, int(mean + 9)))

    def shape(self, token: str) -> list[str]:
        """What a token looks like."""
        found = self._shapes.get(token)
        if found is None:
            found = self._shape(token)
            if len(token) < 16 and len(self._shapes) < KEPT_SHAPES:
                self._shapes[token] = found
        return found

    def _shape(self, token: str) -> list[str]:
        n = len(token)
        if not token[0].isalnum():
            return [f"mark={token}", "shape=mark", "bias"]
        digits = sum("0" <= c <= "9" for c in token)
        upper = sum("A" <= c <= "Z" for c in token)
        kinds = "d" * (digits > 0) + "u" * (upper > 0) + "l" * (digits + upper < n)
        first = token[0].isupper() and upper == 1
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
        capitals = sum(a.islower() and b.isupper() for a, b in zip(token, token[1:]))
        hexadecimal = all(c in "0123456789abcdefABCDEF" for c in token)
        size = min(n, 40).bit_length() if n < 8 else 3 + min(n, 47) // 8
        like = self.wordlike(token)
        return [
            f"kinds={kinds}", f"size={size}", f"kinds,size={kinds},{size}", f"title={first}",
            f"digits={8 * digits // n}", f"turns={min(turns, 8)}", f"capitals={min(capitals, 4)}",
            f"hex,size={hexadecimal},{size}", f"like={like}", f"like,size={like},{size}", "bias",
        ]


def file_features(text: str) -> list[str]:
    low = text.lower()
    code = sum(map(text.count, "={};")) * 50 > len(text)
    return [f"file.keyword={any(k in low for k in KEYWORDS)}", f"file.code={code}"]


def _bucket(n: int) -> int:
    return min(n, 200).bit_length()


def run_features(tagger: Tagger, run: str) -> list[str]:
    """Of an unbroken run of characters: what all its tokens share."""
    n = len(run)
    digits = sum("0" <= c <= "9" for c in run)
    upper = sum("A" <= c <= "Z" for c in run)
    lower = sum("a" <= c <= "z" for c in run)
    marks = n - digits - upper - lower
    kinds = "d" * (digits > 0) + "u" * (upper > 0) + "l" * (lower > 0)
    longest = max(map(len, re.findall("[A-Za-z0-9+/_-]+", run)), default=0)
    address = "@" in run[1:] and "://" not in run
    return [
        f"run={kinds},{_bucket(n)}", f"run.digits={8 * digits // n}", f"run.marks={8 * marks // n}",
        f"run.longest={longest // 8 if longest < 80 else 10}", f"run.mail={address}", f"run.url={'://' in run}",
        f"run.login={'://' in run and '@' in run}", f"run.like={tagger.wordlike(run)},{_bucket(n)}",
    ]


def segment_features(tagger: Tagger, segment: str) -> list[str]:
    """Of the characters around a token that keys are made of."""
    n = len(segment)
    digits = sum("0" <= c <= "9" for c in segment)
    upper = sum("A" <= c <= "Z" for c in segment)
    lower = sum("a" <= c <= "z" for c in segment)
    marks = n - digits - upper - lower
    kinds = "d" * (digits > 0) + "u" * (upper > 0) + "l" * (lower > 0) + "m" * (marks > 0)
    size = n // 4 if n < 24 else 6 + min(n, 96) // 12
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(segment, segment[1:]))
    hexadecimal = all(c in "0123456789abcdefABCDEF-" for c in segment)
    dashes = "uuid" if hexadecimal and segment.count("-") == 4 and n == 36 else min(segment.count("-"), 3)
    return [
        f"seg={kinds}", f"seg,size={kinds},{size}", f"seg.size={size}", f"seg.turns={min(turns, 12)},{size}",
        f"seg.digits={8 * digits // n}", f"seg.marks={8 * marks // n}", f"seg.hex={hexadecimal},{size}",
        f"seg.dashes={dashes}", f"seg.dots={min(segment.count('.'), 4)},{size}", f"seg.slashes={min(segment.count('/'), 4)},{size}",
        f"seg.like={tagger.wordlike(segment)},{size}",
    ]


def line_features(
    text: str, start: int, stop: int, tagger: Tagger, whole: list[str]
) -> Iterator[tuple[int, int, list[str]]]:
    """The tokens of a line with their features, one after another."""
    before = ["<", "<", "<"]
    words = ("<", "<")
    run, run_stop, run_start = [], -1, -1
    segment, seg_stop, seg_start = [], -1, -1
    tokens = TOKEN.finditer(text, start, stop)
    ahead = [m for _, m in zip(range(3), tokens)]
    end = start
    while ahead:
        m = ahead.pop(0)
        ahead += [x for _, x in zip(range(1), tokens)]
        own = m.group()
        low = own.lower() if len(own) < 24 else "long"
        if m.start() >= run_stop:
            r = _RUN.match(text, m.start(), stop)
            run_start, run_stop = r.span()
            run = run_features(tagger, r.group())
        if m.start() >= seg_stop:
            r = _SEGMENT.match(text, m.start(), stop)
            seg_start, seg_stop = r.span() if r else m.span()
            segment = segment_features(tagger, r.group()) if r else ["seg=none"]
        after = [x.group().lower() if x.end() - x.start() < 24 else "long" for x in ahead[:2]] + [">", ">"]
        glued = m.start() == end and end > start
        joined_on = bool(ahead) and ahead[0].start() == m.end()
        near = before[-1] if not before[-1][0].isdigit() else "number"
        features = [
            *tagger.shape(own), *run, *segment, *whole,
            f"-1:{near}", f"-2,-1:{before[-2]},{near}", f"+1:{after[0]}", f"glue={glued},{joined_on}",
            f"-1,glue:{near},{glued}", f"+1,glue:{after[0]},{joined_on}",
            f"word-1:{words[-1]}", f"word-2:{words[-2]}", f"word-2,-1:{words[-2]},{words[-1]}",
            f"named={any(k in words[-1] or k in words[-2] for k in NAMES)}",
            f"named,run={any(k in words[-1] or k in words[-2] for k in NAMES)},{run[0]}",
            f"opens={m.start() == run_start},{run_stop - m.start() > 12}",
            f"seg.opens={m.start() == seg_start},{segment[0]}", f"seg.ends={m.end() == seg_stop}",
            f"seg.before={text[seg_start - 1] if seg_start > start else ''}",
            f"seg.after={text[seg_stop] if seg_stop < stop else ''}",
        ]
        yield m.start(), m.end(), features
        before = [*before[-2:], low]
        if own[0].isalpha():
            words = (words[-1], low)
        end = m.end()


# fixed values: what the names of secrets hold
NAMES = ("key", "token", "secret", "pass", "pwd", "auth", "bearer", "credential", "aws", "login")
NAMED = re.compile("|".join(NAMES))


def odd_lines(text: str) -> Iterator[tuple[int, int]]:
    """The lines that hold an odd token."""
    reached = 0
    for m in ODD.finditer(text):
        if m.start() < reached:
            continue
        start = text.rfind("\n", 0, m.start()) + 1
        stop = text.find("\n", m.start())
        stop = len(text) if stop < 0 else stop
        yield start, stop
        reached = stop + 1


def all_lines(text: str) -> Iterator[tuple[int, int]]:
    """The lines that are not blank."""
    start = 0
    for own in text.split("\n"):
        if own and not own.isspace():
            yield start, start + len(own)
        start += len(own) + 1


def labels_of(tokens: list[tuple[int, int]], values: list[tuple[int, int]]) -> list[int]:
    """Begin and inside for the tokens that overlap a known value."""
    result, k, before = [], 0, None
    values = sorted(values)
    for start, end in tokens:
        while k < len(values) and values[k][1] <= start:
            k += 1
        own = k if k < len(values) and values[k][0] < end else None
        result.append(OUTSIDE if own is None else INSIDE if own == before else BEGIN)
        before = own
    return result


Sample = list[tuple[str, list[tuple[int, int]]]]  # texts with the places of their secrets


def sampled(docs: DataFrame, id: str, text: str, sample_docs: int) -> tuple[Sample, list[str]]:
    """Parts of lines, odd and plain, with the values that the patterns find in them, and
    words, of ``sample_docs`` documents: those of the least hash of id and text.
    What comes to the driver of a document is bounded, whatever its length."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, words = [], []
            for value in batch.column(1):
                own = value.as_py() or ""
                cut = []
                for _, (start, stop) in zip(range(SAMPLE_LINES), odd_lines(own)):
                    odd = ODD.search(own, start, stop).start()
                    low, high = max(start, odd - 6 * SAMPLE_TOKENS), min(stop, odd + 6 * SAMPLE_TOKENS)
                    cut.append(own[low:high])
                plain = (p for p in all_lines(own) if not ODD.search(own, *p))
                for _, (start, stop) in zip(range(SAMPLE_PLAIN), plain):
                    cut.append(own[start : min(stop, start + 2 * SAMPLE_TOKENS)])
                lines.append(cut)
                found = (m.group() for m in re.finditer(r"(?<!\S)[^\W\d_]{1,24}(?!\S)", own))
                words.append([w for _, w in zip(range(SAMPLE_WORDS), found)])
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lines, strings), pa.array(words, strings)],
                names=["place", "lines", "words"],
            )

    n = docs.count()
    place = F.xxhash64(id, text)
    share = min(1.0, 2 * sample_docs / max(n, 1))
    rows = (
        docs.select(place.alias("place"), F.col(text).alias("text"))
        .where(F.pmod("place", F.lit(1 << 30)) <= int(share * (1 << 30)))
        .mapInArrow(parts, "place bigint, lines array<string>, words array<string>")
        .orderBy("place", "lines", "words")
        .limit(sample_docs)
        .collect()
    )
    lines = [(own, base_spans(own)[1]) for r in rows for own in r.lines]
    return lines, [w for r in rows for w in r.words]


def made(words: list[str], forms: dict[str, Form], each: int, seed: int = 1) -> Sample:
    """``each`` lines of every form among ``words``."""
    rng = random.Random(seed)
    words = sorted(set(words))[:20_000] or ["a"]
    return [line(form, words, rng) for _, form in sorted(forms.items()) for _ in range(each)]


def fitted(sample: Sample, words: list[str]) -> Tagger:
    tagger = Tagger(words)
    sequences, labels = [], []
    for text, values in sample:
        whole = file_features(text)
        for start, stop in all_lines(text):
            tokens = list(islice(line_features(text, start, stop, tagger, whole), SAMPLE_TOKENS))
            sequences.append([list(map(intern, fs)) for _, _, fs in tokens])
            labels.append(labels_of([(a, b) for a, b, _ in tokens], values))
    seen = Counter(f for s in sequences for fs in s for f in fs)
    sequences = [[[f for f in fs if seen[f] >= LEAST_SEEN] for fs in s] for s in sequences]
    tagger.field.fit(sequences, labels, rounds=60)
    tagger._shapes.clear()
    tagger._screen = None
    return tagger


def fit_tagger(
    docs: DataFrame, id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS
) -> Tagger:
    """The tagger fitted on a sample of ``sample_docs`` documents, the same for the
    same documents, and on ``MADE_LINES`` made lines of each form."""
    lines, words = sampled(docs, id, text, sample_docs)
    return fitted(lines + made(words, SECRETS | HARMLESS, MADE_LINES), words)


class Screen:
    """Finds the lines that the field may label other than outside as a whole.

    Leaving the label outside must gain something: over the tokens that leave it,
    the scores of their labels less those of outside, with those of the steps.
    A token's bound is the most it may add to such a gain: its features' scores,
    those that hang on blanks taken at their highest, the best step to it, and
    the step back if that gains. A line whose bounds are all negative is outside.

    What a run of characters says of its own tokens hangs on the kinds of its
    characters, but for features of how its letters go together, which are taken
    at their highest. The tokens and pairs beside it are looked up for a whole
    text at once.
    """

    SLACK = 1e-6  # for sums in another order

    def __init__(self, tagger: Tagger):
        self.tagger, field = tagger, tagger.field
        self.gains = {
            f: (own[BEGIN] - own[OUTSIDE], own[INSIDE] - own[OUTSIDE])
            for f, own in field.scores.items()
        }
        stay = field.step[OUTSIDE, OUTSIDE]
        into = np.maximum((field.step - stay).max(axis=0), field.first - field.first[OUTSIDE])
        back = np.maximum(field.step[:, OUTSIDE] - stay, field.last - field.last[OUTSIDE])
        self.steps = (into + np.maximum(back, 0))[[BEGIN, INSIDE]].tolist()
        self.at_blank = {}  # what a segment gains by a blank or the line's end beside it
        for name in ("seg.before=", "seg.after="):
            known = [g for f, g in self.gains.items() if f.startswith(name) and f[len(name) :].strip() == ""]
            self.at_blank[name] = [max(x) for x in zip((0.0, 0.0), *known)]
        self.names: dict[str, int] = {"": 0}  # of tokens that features of others hold
        one, two = [], {"-2,-1": {}, "word-2,-1": {}}
        for f, gain in self.gains.items():
            name, _, value = f.partition(":")
            if name in two:
                cut = value.index(",", 1)
                two[name][self._name(value[:cut]), self._name(value[cut + 1 :])] = gain
            elif name in ("-1", "+1", "word-1", "word-2"):
                one += [(name, self._name(value), glued, gain) for glued in (0, 1)]
            elif name in ("-1,glue", "+1,glue"):
                value, _, glued = value.rpartition(",")
                one.append((name[:2], self._name(value), int(glued == "True"), gain))
        self.start, self.end = self._name("<"), self._name(">")
        n = len(self.names)
        # what stands beside a token, at twice its number, one more if glued to it
        self.beside = {name: np.zeros((2 * n, 2)) for name in ("-1", "+1", "word-1", "word-2")}
        for name, at, glued, gain in one:
            self.beside[name][2 * at + glued] += gain
        self.pairs = {}
        for name, own in two.items():
            own = sorted((a * n + b, gain) for (a, b), gain in own.items())
            keys = np.array([k for k, _ in own], np.int64)
            self.pairs[name] = keys, np.array([g for _, g in own]).reshape(-1, 2)
        # what a bound must be over before each of the lookups of ``_some``
        order = ["word-1", "-1", "+1", "word-2"]
        most = [self.beside[name].max(axis=0) for name in order]
        most += [np.max([(0.0, 0.0), *self.pairs[name][1]], axis=0) for name in two]
        ahead = [np.sum(most[k:], axis=0) for k in range(len(most))]
        self.rest = [tuple(-x - self.SLACK) for x in [*ahead, np.zeros(2)]]
        self.codes: dict[str, int] = {}
        self._clear()

    def _name(self, token: str) -> int:
        return self.names.setdefault(token, len(self.names))

    def _own(self, features: list[str]) -> tuple[float, float]:
        known = [self.gains[f] for f in features if f in self.gains]
        return sum(b for b, _ in known), sum(i for _, i in known)

    def _clear(self) -> None:
        self.runs: dict[str, int] = {}  # by the kinds of their characters
        self.n_runs = self.n_tokens = 0
        self.first = np.zeros(1024, np.int64)  # token of a run; one more ends the last
        self.scores, self.by_name = np.zeros((2, 1024, 2))
        self.marks = np.zeros((3, 1024), bool)  # a word; glued to the token before, or after

    def _most(self, feature: str) -> tuple[float, float]:
        """What a feature gains at most, whatever letters it is of."""
        name, _, value = feature.partition("=")
        value, _, size = value.partition(",")
        known = [self.gains.get(f"{name}={v},{size}" if size else f"{name}={v}", (0.0, 0.0)) for v in LETTERS_OF[name]]
        return max(b for b, _ in known), max(i for _, i in known)

    def _scores(self, run: str) -> list[tuple]:
        """Per token of a run what it gains at most, whatever its letters and what
        stands beside the run, and how much more by a secret's name before it."""
        found = []
        shared = run_features(self.tagger, run)[0]
        named, none = (self._own([f"named={n}", f"named,run={n},{shared}"]) for n in (True, False))
        for _, _, features in line_features(run, 0, len(run), self.tagger, []):
            b, i = self.steps[0] + none[0], self.steps[1] + none[1]
            for f in features:
                if f.startswith(BESIDE):
                    continue
                if f in self.at_blank:  # the run's border
                    x, y = self.at_blank[f]
                elif f.partition("=")[0] in LETTERS_OF and f not in PLAIN_DASHES:
                    x, y = self._most(f)
                else:
                    x, y = self.gains.get(f, (0.0, 0.0))
                b, i = b + x, i + y
            found.append((b, i, named[0] - none[0], named[1] - none[1]))
        return found

    def _add(self, run: str) -> int:
        own = np.array(self._scores(run))
        n, low, high = len(own), self.n_tokens, self.n_tokens + len(own)
        while high > len(self.scores):
            self.scores, self.by_name = (np.concatenate([t, t]) for t in (self.scores, self.by_name))
            self.marks = np.concatenate([self.marks, self.marks], axis=1)
        while self.n_runs + 2 > len(self.first):
            self.first = np.concatenate([self.first, self.first])
        self.scores[low:high], self.by_name[low:high] = own[:, :2], own[:, 2:]
        letter = [m.group()[0].isalpha() for m in TOKEN.finditer(run)]
        self.marks[:, low:high] = letter, np.arange(n) > 0, np.arange(n) < n - 1
        at = self.n_runs
        self.n_runs, self.n_tokens = at + 1, high
        self.first[at + 1] = high
        if len(run) < 200:
            self.runs[run] = at
        return at

    def _code(self, token: str) -> int:
        """A token's name, as a feature of the next ones, and whether it names a secret."""
        low = token.lower() if len(token) < 24 else "long"
        raw = self.names.get(low, 0)
        near = self.names.get("number", 0) if low[0].isdigit() else raw
        code = raw << 32 | near << 1 | (NAMED.search(low) is not None)
        if len(self.codes) < KEPT_TOKENS and len(token) < 24:
            self.codes[token] = code
        return code

    def doubtful(self, text: str) -> Iterator[tuple[int, int]]:
        """The lines of a text that are to be decoded."""
        lines, many, file = [], 0, None
        for start, stop in all_lines(text):
            file = file or self._own(file_features(text))
            lines.append((start, stop))
            many += stop - start
            if many >= SCREENED:
                yield from self._some(text, lines, file)
                lines, many = [], 0
        if lines:
            yield from self._some(text, lines, file)

    def _some(
        self, text: str, lines: list[tuple[int, int]], file: tuple[float, float]
    ) -> list[tuple[int, int]]:
        if self.n_runs > KEPT_RUNS or self.n_tokens > 8 * KEPT_RUNS:
            self._clear()
        low, high = lines[0][0], lines[-1][1]
        kinds = text[low:high].translate(KINDS_OF)
        runs, counts = [], []
        for start, stop in lines:
            own = kinds[start - low : stop - low].split()
            known = map(self.runs.get, own)
            runs += [self._add(run) if at is None else at for run, at in zip(own, known)]
            counts.append(len(own))
        runs = np.array(runs)
        sizes = self.first[runs + 1] - self.first[runs]
        total = int(sizes.sum())
        at = np.repeat(self.first[runs] - np.cumsum(sizes) + sizes, sizes) + np.arange(total)
        letter, glued, joined_on = (m.take(at) for m in self.marks)
        tokens = TOKEN.findall(text, low, high)
        known = map(self.codes.get, tokens)
        codes = np.array([self._code(t) if code is None else code for t, code in zip(tokens, known)])
        raw, near, secret = codes >> 32, (codes & 0xFFFFFFFF) >> 1, codes & 1
        line = np.repeat(np.repeat(np.arange(len(lines)), counts), sizes)
        opens = np.searchsorted(line, np.arange(len(lines)))[line]  # the line's first token
        place = np.arange(total) - opens

        def before(of: np.ndarray, k: int) -> np.ndarray:
            return np.where(place >= k, np.roll(of, k), self.start)

        one, two = before(near, 1), before(raw, 2)
        after = np.where(np.append(line[1:] == line[:-1], False), np.roll(raw, -1), self.end)
        # the two words before, wherever they stand in the line
        words = np.flatnonzero(letter)
        seen = np.cumsum(letter) - letter
        since = seen - seen[opens]
        word, named = np.full((3, total), self.start), np.zeros(total, bool)
        for k in (1, 2):
            there = since >= k
            which = words[seen[there] - k]
            word[k, there] = raw[which]
            named[there] |= secret[which] == 1
        bound = self.scores.take(at, axis=0)
        bound += file
        bound[named] += self.by_name.take(at[named], axis=0)
        steps = [
            (self.beside["word-1"], 2 * word[1]),
            (self.beside["-1"], 2 * one + glued),
            (self.beside["+1"], 2 * after + joined_on),
            (self.beside["word-2"], 2 * word[2]),
            (self.pairs["-2,-1"], (two, one)),
            (self.pairs["word-2,-1"], (word[2], word[1])),
        ]
        # what is beside a token is looked up for as long as it may still suffice
        rest = self.rest
        live = np.arange(total)
        for k, (table, where) in enumerate([*steps, (None, None)]):
            some = ((bound[:, 0] > rest[k][0]) | (bound[:, 1] > rest[k][1])).nonzero()[0]
            if len(some) < len(live):
                live, bound = live[some], bound[some]
            if not len(live) or table is None:
                break
            if isinstance(table, np.ndarray):
                bound += table.take(where[live], axis=0)
            elif len(table[0]):
                keys, gains = table
                pair = where[0][live].astype(np.int64) * len(self.names) + where[1][live]
                found = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                hit = keys[found] == pair
                bound[hit] += gains[found[hit]]
        return [lines[k] for k in np.unique(line[live])]


def widened(text: str, start: int, stop: int, a: int, b: int) -> tuple[int, int]:
    """A span with the rest of the key characters that it begins and ends among."""
    while a > start and _SEGMENT.match(text[a - 1]):
        a -= 1
    last = _SEGMENT.match(text, b - 1, stop)
    return a, last.end() if last else b


def tagged(text: str, tagger: Tagger) -> list[tuple[int, int]]:
    """The spans that the tagger finds. Keys are not cut: a span takes in the rest
    of the letters, digits and marks of keys around it."""
    spans: list[list[int]] = []
    whole = None
    for start, stop in tagger.screen().doubtful(text):
        whole = whole or file_features(text)
        places: list[tuple[int, int]] = []

        def kept(tokens):
            for a, b, features in tokens:
                places.append((a, b))
                yield features

        first = len(spans)
        open_span = False
        labels = tagger.field.decode(kept(line_features(text, start, stop, tagger, whole)))
        for (a, b), label in zip(places, labels):
            if label == OUTSIDE:
                open_span = False
            elif label == INSIDE and open_span:
                spans[-1][1] = b
            else:
                spans.append([a, b])
                open_span = True
        whole_keys: list[list[int]] = []
        for a, b in spans[first:]:
            if not (whole_keys and b <= whole_keys[-1][1]):
                a, b = widened(text, start, stop, a, b)
                whole_keys.append([a, b])
        spans[first:] = whole_keys
    return [(a, b) for a, b in spans]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SCAN = (
    T.StructType()
    .add("n_assign", "long")
    .add("n_access", "long")
    .add("n_hex", "long")
    .add("base_sha256", "string")
    .add("spans", "string")
)


def scan_text(text: str, tagger: Tagger) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text. Of the tagger's spans those that a
    base span covers already are left out."""
    base = base_spans(text)[0]
    starts = [s for s, _, _ in base]
    reached = list(accumulate((e for _, _, e in base), max))
    more = []
    for a, b in tagged(text, tagger):
        before = bisect_right(starts, a)
        if not before or reached[before - 1] < b:
            more.append((a, 3, b))
    return base, sorted(base + more)


def redacted(text: str, spans: list[Span], mark: str) -> str:
    """``text`` with every span, or run of overlapping spans, replaced."""
    out, reached = [], 0
    for start, _, end in spans:
        if start >= reached:
            out += [text[reached:start], mark]
        reached = max(reached, end)
    return "".join([*out, text[reached:]])


def secret_scan(docs: DataFrame, tagger: Tagger, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with the columns of ``SCAN``, the text having its secrets replaced
    by ``mark``."""
    docs = docs.select([c for c in docs.columns if c.lower() not in SCAN.names])
    kept = docs.columns
    where = kept.index(text)
    # a worker has one tagger for all its tasks, with what it keeps of tokens and
    # runs, and lets go of it with the scan
    held = docs.sparkSession.sparkContext.broadcast(tagger)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = held.value
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            rows, texts = [], []
            for value in batch.column(where):
                own = value.as_py()
                base, spans = scan_text(own, tagger) if own else ([], [])
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*counts, digest, joined(spans)))
                texts.append(redacted(own, spans, mark) if spans else own)
            columns = [batch.column(k) for k in range(len(kept))]
            columns[where] = pa.array(texts, batch.schema.field(where).type)
            more = zip(*rows) if rows else [()] * len(SCAN)
            columns += [
                pa.array(c, pa.int64() if k < 3 else pa.string()) for k, c in enumerate(more)
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *SCAN.names])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, *SCAN.fields]))
