"""Personal data: spans certain by pattern, and further ones by a semi-Markov conditional random field.

Text is read in regions, runs of words with a digit or an @. The field scores whole segments of a region's tokens, each as one
kind or as plain, and a dynamic program over segments of bounded length chooses boundaries and kinds of a region jointly. It
is taught by the certain spans of the corpus.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import pack_row, ship

KINDS = ("email", "ip", "card", "phone")
#: Tokens of one entity at most.
LONGEST = 24
#: Different regions that the field is taught on, from some so many documents; regions of more tokens or characters are left out
#: of the fit, never of the scan.
TAUGHT_REGIONS, TAUGHT_DOCS, TAUGHT_TOKENS, TAUGHT_CHARS = 1500, 8000, 60, 400
EPOCHS, RATE, DECAY = 4, 0.5, 1e-3
#: A segment that is as likely plain as not has score 0; to be reported it has to be ahead of plain by so much.
MARGIN = 2.0
#: Scores of segments that a Python worker keeps at once.
KNOWN_SEGMENTS = 200_000

Span = tuple[int, int, int]  # kind, start, end

_EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can't begin within a run of digits, as then it would have begun with the run
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[\s\S]")
_DIGIT = re.compile(r"[0-9]")


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def certain_spans(text: str) -> list[Span]:
    """Spans by pattern, by kind and start; each kind leftmost and without overlap, matches that fail the kind's check dropped."""
    found: list[Span] = []
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _EMAIL_NAME:
            start -= 1
        host = _EMAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            free = host.end()
            found.append((0, start, free))
        else:
            free = at + 1  # no name holds an @
        at = text.find("@", free)
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            found.append((3, *m.span()))
    return found


def _kind_of_char(c: str) -> str:
    return "9" if c in "0123456789" else "a" if c.isalpha() else " " if c.isspace() else c if c.isascii() else "?"


@dataclass(frozen=True)
class Region:
    """Tokens as (start, end, kind) in a text; kinds are 9 for digits, a for letters, else the character."""

    text: str
    tokens: list[tuple[int, int, str]]

    def starts(self, j: int) -> list[int]:
        """First tokens of segments that end before token j and may be an entity."""
        return [i for i in range(max(0, j - LONGEST), j) if self._may_start(i)] if self._may_end(j) else []

    def segments(self) -> list[list[tuple[int, tuple[str, ...]]]]:
        """By end token, the start tokens of segments that may be an entity and their features."""
        found = [[(i, self.features(i, j)) for i in self.starts(j)] for j in range(1, len(self.tokens) + 1)]
        return [[], *[[(i, f) for i, f in at if f] for at in found]]

    def signs(self) -> list[str]:
        """Of every token all that the features of a segment read of it."""
        return [k if k != "9" else f"{min(e - s, 21)}{'o' if self._octet(s, e) else ''}" for s, e, k in self.tokens]

    def _octet(self, s: int, e: int) -> bool:
        return e - s <= 3 and int(self.text[s:e]) <= 255

    def _may_start(self, i: int) -> bool:
        kind = self.tokens[i][2]
        before = self.tokens[i - 1][2] if i else ""
        return kind in "9a+(" and not (kind in "9a" and before in ("9", "a", "_"))

    def _may_end(self, j: int) -> bool:
        kind = self.tokens[j - 1][2]
        after = self.tokens[j][2] if j < len(self.tokens) else ""
        return kind in "9a" and after not in ("9", "a", "_")

    def features(self, i: int, j: int) -> tuple[str, ...]:
        """Of the whole segment: its shape, digits, groups, separators and both neighbours; none without a digit or an @."""
        inside = self.tokens[i:j]
        runs = [e - s for s, e, k in inside if k == "9"]
        digits = sum(runs)
        marks = [k for _, _, k in inside if k not in "9a"]
        at = marks.count("@")
        if not digits and not at:
            return ()
        letters = any(k == "a" for _, _, k in inside)
        shape = "".join("9" * min(e - s, 5) if k == "9" else k for s, e, k in inside)
        form = "".join(k for _, _, k in inside)
        before = self.tokens[i - 1][2] if i else ""
        after = self.tokens[j][2] if j < len(self.tokens) else ""
        octets = digits and not letters and all(self._octet(s, e) for s, e, k in inside if k == "9")
        seps = "".join(sorted(set(marks)))
        return (
            "bias", f"form {form}" if len(form) <= 12 else "form long", f"shape {shape}" if len(shape) <= 24 else "shape long",
            f"digits {min(digits, 20)}", f"groups {min(len(runs), 8)}", f"longest {min(max(runs, default=0), 20)}", f"marks {seps}",
            f"at {min(at, 2)}", f"letters {letters}", f"first {inside[0][2]}", f"last {inside[-1][2]}",
            f"before {before}", f"after {after}", f"octets {bool(octets)} {min(len(runs), 5)} {seps}", f"both {digits if digits < 20 else 20} {seps} {letters}",
        )


def _tokens(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    return [(*t.span(), _kind_of_char(t.group()[0])) for t in _TOKEN.finditer(text, start, end)]


def regions(text: str) -> Iterator[Region]:
    """Regions of a text in order: words with a digit or an @, one white-space character between them."""
    done, trigger = 0, _TRIGGER.search(text)
    while trigger:
        start = trigger.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        last = trigger
        while True:
            space = _SPACE.search(text, last.end())
            done = space.start() if space else len(text)
            after = _SPACE.search(text, done + 1)
            last = _TRIGGER.search(text, done + 1, after.start() if after else len(text)) if space else None
            if not last:
                break
        yield Region(text, _tokens(text, start, done))
        trigger = _TRIGGER.search(text, done)


@dataclass
class Field:
    """Weights of (feature, kind) and of a kind following a kind; plain tokens have score 0. -1 stands for plain."""

    weights: dict[str, np.ndarray]
    steps: np.ndarray  # from plain or a kind (last row: plain) to a kind
    known: dict = field(default_factory=dict, repr=False, compare=False)

    def scores(self, features: tuple[str, ...]) -> np.ndarray:
        total = np.zeros(len(KINDS))
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                total += w
        return total

    def _scored(self, region: Region, signs: list[str], j: int) -> tuple[list[int], list[np.ndarray]]:
        """Starts of the possible segments before token j, and their scores; segments that read alike are scored once."""
        found, scores = [], []
        after = signs[j] if j < len(signs) else ""
        for i in region.starts(j):
            key = (signs[i - 1] if i else "", after, *signs[i:j])
            score = self.known.get(key)
            if score is None:
                if len(self.known) >= KNOWN_SEGMENTS:
                    self.known.clear()
                features = region.features(i, j)
                score = self.known[key] = self.scores(features) - MARGIN if features else np.full(len(KINDS), -np.inf)
            found.append(i)
            scores.append(score)
        return found, scores

    def best(self, region: Region) -> list[Span]:
        """The best segmentation's entities, by the bounded-length program; a kind costs MARGIN, ties go to plain."""
        n, k = len(region.tokens), len(KINDS)
        signs = region.signs()
        # best score of a prefix by the kind of its last segment, plain last; of that and the step to the next kind
        top = np.full((n + 1, k + 1), -np.inf)
        reach = np.full((n + 1, k), -np.inf)
        back = np.zeros((n + 1, k + 1), np.int64)
        top[0, k] = 0.0
        reach[0] = self.steps[k]
        for j in range(1, n + 1):
            top[j, k] = top[j - 1].max()
            starts, scores = self._scored(region, signs, j)
            if starts:
                got = reach[starts] + scores
                choice = got.argmax(axis=0)
                top[j, :k] = got[choice, np.arange(k)]
                back[j, :k] = np.array(starts)[choice]
            reach[j] = (top[j][:, None] + self.steps).max(axis=0)
        found, j = [], n
        y = k if top[n, k] >= top[n].max() else int(top[n].argmax())
        while j:
            if y < k:
                i = int(back[j, y])
                found.append((y, region.tokens[i][0], region.tokens[j - 1][1]))
                j, y = i, int((top[i] + self.steps[:, y]).argmax())
            else:
                j -= 1
                y = k if top[j, k] >= top[j].max() else int(top[j].argmax())
        return found[::-1]


def log_sum(a: np.ndarray, axis=None) -> np.ndarray:
    m = np.max(a, axis=axis, keepdims=True)
    safe = np.where(np.isfinite(m), m, 0.0)
    return np.log(np.exp(a - safe).sum(axis=axis)) + np.squeeze(safe, axis=axis)


def gradient(field: Field, ends: list, truth: set[tuple[int, int, int]]) -> tuple[float, dict, np.ndarray]:
    """Log-likelihood of a region's true segmentation (kind, first token, end) and its gradient, by forward and backward sums."""
    n, k = len(ends) - 1, len(KINDS)
    scored = [[(i, f, field.scores(f)) for i, f in at] for at in ends]
    ahead = np.full((n + 1, k + 1), -np.inf)
    ahead[0, k] = 0.0
    with np.errstate(divide="ignore"):
        for j in range(1, n + 1):
            ahead[j, k] = log_sum(ahead[j - 1])
            for i, _, s in scored[j]:
                ahead[j, :k] = np.logaddexp(ahead[j, :k], log_sum(ahead[i][:, None] + field.steps, axis=0) + s)
        behind = np.full((n + 1, k + 1), -np.inf)
        behind[n] = 0.0
        for j in range(n, 0, -1):
            behind[j - 1] = np.logaddexp(behind[j - 1], behind[j, k])
            for i, _, s in scored[j]:
                behind[i] = np.logaddexp(behind[i], log_sum(field.steps + (s + behind[j, :k])[None, :], axis=1))
    whole = float(log_sum(ahead[n]))
    slopes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
    steps = np.zeros_like(field.steps)
    value = -whole
    starts = {(i, j): y for y, i, j in truth}
    label_at = {j: y for y, _, j in truth}  # kind of the segment that ends there
    for j in range(1, n + 1):
        for i, features, s in scored[j]:
            joint = np.exp(ahead[i][:, None] + field.steps + (s + behind[j, :k])[None, :] - whole)
            expected = -joint.sum(axis=0)
            steps -= joint
            y = starts.get((i, j))
            if y is not None:
                before = label_at.get(i, k)
                value += s[y] + field.steps[before, y]
                expected[y] += 1
                steps[before, y] += 1
            for f in features:
                slopes[f] += expected
    return value, slopes, steps


def examples(text: str) -> list[tuple[Region, set[tuple[int, int, int]]]]:
    """Regions with the certain spans in them as (kind, first token, end).

    Matches that fail their kind's check are neither one nor the other, so that their regions teach nothing; so do regions
    with overlapping certain spans, or ones that are no possible segment.
    """
    certain = certain_spans(text)
    doubtful = [m.span() for p in (_IP, _CARD, _PHONE) for m in p.finditer(text)
                if len(_digits(m.group())) >= 7 and not any(s <= m.start() and m.end() <= e for _, s, e in certain)]
    out = []
    for region in regions(text):
        low, high = region.tokens[0][0], region.tokens[-1][1]
        if len(region.tokens) > TAUGHT_TOKENS or high - low > TAUGHT_CHARS:
            continue
        mine = sorted((s, e, y) for y, s, e in certain if s < high and e > low)
        if any(s < high and e > low for s, e in doubtful) or any(a[1] > b[0] for a, b in zip(mine, mine[1:])):
            continue
        first = {s: i for i, (s, _, _) in enumerate(region.tokens)}
        end = {e: j for j, (_, e, _) in enumerate(region.tokens, 1)}
        truth = {(y, first[s], end[e]) for s, e, y in mine if s in first and e in end}
        possible = {(i, j) for j, at in enumerate(region.segments()) for i, _ in at}
        if len(truth) == len(mine) and all((i, j) in possible for _, i, j in truth):
            out.append((region, truth))
    return out


def teach(taught: list[tuple[Region, set]], seed: int = 5) -> Field:
    """Weights of largest penalized likelihood, approached by AdaGrad steps over the regions in random order."""
    field = Field({}, np.zeros((len(KINDS) + 1, len(KINDS))))
    squares: dict[str, np.ndarray] = {}
    step_squares = np.full_like(field.steps, 1e-6)
    cut = [(region.segments(), truth) for region, truth in taught]
    draw = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for at in draw.permutation(len(cut)):
            _, slopes, steps = gradient(field, *cut[at])
            for f, g in slopes.items():
                w = field.weights.setdefault(f, np.zeros(len(KINDS)))
                g = g - DECAY * w
                q = squares.setdefault(f, np.full(len(KINDS), 1e-6))
                q += g * g
                w += RATE * g / np.sqrt(q)
            step_squares += steps * steps
            field.steps += RATE * steps / np.sqrt(step_squares)
    return field


def all_spans(text: str, taught: Field) -> tuple[list[Span], list[Span]]:
    """The certain spans, and all spans by kind and start: certain ones stay, the field's are added where they overlap none."""
    certain = certain_spans(text)
    taken = sorted((s, e) for _, s, e in certain)
    starts, reach = [s for s, _ in taken], np.maximum.accumulate([e for _, e in taken]) if taken else []
    added = []
    for region in regions(text):
        for y, s, e in taught.best(region):
            k = int(np.searchsorted(starts, e))  # certain spans that begin before the end
            if k == 0 or reach[k - 1] <= s:
                added.append((y, s, e))
    return certain, sorted(certain + added)


def _example_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [(r.text[r.tokens[0][0]:r.tokens[-1][1]], " ".join(f"{y}:{i}:{j}" for y, i, j in sorted(truth)))
                 for t in frame["t"] for r, truth in examples(t)]
        yield pd.DataFrame(found, columns=["region", "truth"], dtype=object)


def fit(docs: DataFrame, text: str = "text") -> Field:
    """The field taught by different regions of the corpus, a bounded number in the order of their hashes.

    A share of the hash range that holds some TAUGHT_DOCS documents is cut out first, so that no task sends more.
    """
    some = docs.select(docs[text].alias("t")).filter(F.col("t").rlike("[0-9@]"))
    share = TAUGHT_DOCS / max(1, some.count())
    low = some.filter(F.xxhash64("t") <= int(-2**63 + share * 2**64)) if share < 1 else some
    found = low.mapInPandas(_example_rows, "region string, truth string").distinct()
    taught = []
    for r in found.orderBy(F.xxhash64("region", "truth"), "region", "truth").limit(TAUGHT_REGIONS).collect():
        truth = {tuple(map(int, x.split(":"))) for x in r.truth.split()}
        taught.append((Region(r.region, _tokens(r.region, 0, len(r.region))), truth))
    return teach(taught)


def find_pii(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """Of every row: ``row``, all its columns, ``base`` and ``spans``, both arrays of (kind, start, end), in order of kind as in
    KINDS, then start; places are code points, ends exclusive.

    Base spans match a pattern and its check; ``spans`` has them and those that the field adds. Without ``field`` one is fitted
    to certain spans of the corpus. Null and empty texts have no spans; equal texts the same ones, whatever their row. Whole
    texts are read, in time that grows with their length. Without certain spans nothing is added.
    """
    ship(docs.sparkSession)
    field = fit(docs, text) if field is None else field
    known = docs.sparkSession.sparkContext.broadcast(field)
    spans = "array<struct<kind string, start int, `end` int>>"

    @F.pandas_udf(f"base {spans}, spans {spans}")
    def scan(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            both = all_spans(t, known.value) if t and _TRIGGER.search(t) else ([], [])
            out.append([[{"kind": KINDS[y], "start": s, "end": e} for y, s, e in found] for found in both])
        return pd.DataFrame(out, columns=["base", "spans"])

    packed = pack_row(docs, found=scan(docs[text]))
    return packed.select(F.col("_row").alias("row"), F.col("_found.base").alias("base"), F.col("_found.spans").alias("spans"))
