"""Personal data: four kinds found by rule, and spans added by a character-level bidirectional LSTM with a CRF.

Rules (leftmost, not overlapping within a kind): email, ip, card and phone as ``rule_spans`` states them. The model
tags every character of every text with a kind or none. It is trained in numpy, by Adam on the gradient of the CRF's
log-likelihood, from labelled spans: excerpts around rule spans and around other digits, at most ``fit_rows`` a kind
by a hash of the excerpt, and re-spelled forms of them that the rules miss (``respelled``). Only these excerpts reach
the driver; the model (some 4,000 numbers) goes out with the tasks.

A text is read in windows of ``WINDOW`` characters that overlap by ``OVERLAP``. Each window gets its best tag
sequence (Viterbi; a window where no stretch of tags can gain, by a bound on the scores, has none). Spans of
one kind that overlap are one span cut by window edges and are joined; of joined spans that overlap across kinds the
set of greatest total score stays. What stays must be plausible for its kind (``plausible``: a card passes Luhn, an
ip has four parts up to 255, ...) and must not overlap a rule span. Rule spans always stay.

Offsets are code points, ends exclusive. NULL and empty texts have no spans; repeated rows each get their row; an
empty table gives no row. Without any rule span in the corpus nothing is learned and the rules stand alone. Windows
bound the memory of a long text to a few times its size. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import Scratch, lists, pieces, text_buffers, text_key

KINDS = ["email", "ip", "card", "phone"]
TAGS = len(KINDS) + 1
HIDDEN = 8
WINDOW, OVERLAP = 160, 40
#: Windows taken through the network at a time, and characters of a training example.
GROUP, FIT_WINDOW, MARGIN = 2048, 112, 40
FIT_ROWS = 300
SPANS = "array<struct<kind: string, start: int, end: int, by: string>>"
Span = tuple[str, int, int]

HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGIT_CHAIN = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, read from the @ to both sides."""
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        past = host.end() if host else at + 1
        if host:
            yield "email", start, past
        at = text.find("@", past)


def rule_spans(text: str) -> list[Span]:
    """All rule spans, by kind and start. ip: four numbers up to 255 parted by dots; card: 16 to 19 digits, single
    spaces or hyphens between them, passing Luhn; phone: a plus, 8 to 15 digits, spaces, dots, hyphens, brackets.
    A match that fails its condition is dropped and not tried again."""
    found = list(emails(text))
    for chain in NUMBERS.finditer(text):
        if "." in chain.group():
            parts, place = chain.group().split("."), chain.start()
            for i in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[i : i + 4])) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts[i : i + 4]):
                    found.append(("ip", place, place + size))
                place += size + 1
    for chain in DIGIT_CHAIN.finditer(text):
        if chain.end() - chain.start() >= 16:
            digits = digits_of(chain.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *chain.span()))
    for match in PHONE.finditer(text):
        if 8 <= len(digits_of(match.group())) <= 15:
            found.append(("phone", *match.span()))
    return found


AT_SIGN = re.compile(r"@|\s?[\[({]\s?at\s?[\])}]\s?|\sat\s", re.I)
DOT_SIGN = re.compile(r"\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s", re.I)


def plausible(kind: str, text: str) -> bool:
    """Whether a span that the model proposes can be of its kind."""
    digits = digits_of(text)
    if kind == "email":
        sides = AT_SIGN.split(text)
        return len(sides) == 2 and bool(sides[0]) and len(DOT_SIGN.split(sides[1])) > 1 and all(p and not re.search(r"\s", p) for p in DOT_SIGN.split(sides[1]))
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search("[A-Za-z]", text)
    if kind == "card":
        return 15 <= len(digits) <= 19 and luhn(digits) and not re.search("[A-Za-z]", text)
    return 9 <= len(digits) <= 15 and len(digits) < len(text) and not re.search("[A-Za-z]", text)


def classes() -> np.ndarray:
    """Classes of the ASCII characters; 0 is beyond the text, 6 beyond ASCII, punctuation has a class each."""
    table = np.full(128, 5, np.uint8)
    for low, high, own in (("0", "9", 1), ("a", "z", 2), ("A", "Z", 3), (" ", " ", 4)):
        table[ord(low) : ord(high) + 1] = own
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    table[marks] = np.arange(7, 7 + len(marks))
    return table


CLASSES = int(classes().max()) + 1


def coded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, classes()[np.minimum(points, 127)], 6).astype(np.uint8)


@dataclass
class Tagger:
    """``given`` (2, 4 H, classes) and ``own`` (2, 4 H, H) are the weights of both directions on the character and
    on the state, gates in the order input, forget, output, cell; ``emit`` and ``bias`` score tags, ``moves`` pairs."""

    given: np.ndarray
    own: np.ndarray
    emit: np.ndarray
    bias: np.ndarray
    moves: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator, hidden: int = HIDDEN) -> Tagger:
        given = rng.normal(0, 0.3, (2, 4 * hidden, CLASSES))
        given[:, hidden : 2 * hidden] += 0.5
        given[:, : 3 * hidden, 0] = -20  # beyond a text all gates are closed and the state is 0
        parts = given, rng.normal(0, 0.3, (2, 4 * hidden, hidden)), rng.normal(0, 0.3, (TAGS, 2 * hidden)), np.zeros((TAGS, 1)), np.zeros((TAGS, TAGS))
        return cls(*[p.astype(np.float32) for p in parts])

    def arrays(self) -> list[np.ndarray]:
        return [self.given, self.own, self.emit, self.bias, self.moves]

    def states(self, codes: np.ndarray, trace: list | None = None) -> np.ndarray:
        """(steps, 2, H, texts) of codes (steps, texts); the second direction runs from the end. ``trace`` gets what
        the gradient needs. A gate is (1 + tanh) / 2, so one tanh serves all rows."""
        steps, n = codes.shape
        hidden = self.own.shape[2]
        x = codes.astype(np.intp)
        z, g = np.empty((2, 4 * hidden, n), np.float32), np.empty((4 * hidden, n), np.float32)
        h, c, t = np.zeros((2, hidden, n), np.float32), np.zeros((2, hidden, n), np.float32), np.empty((2, hidden, n), np.float32)
        out = np.empty((steps, 2, hidden, n), np.float32)
        gates, cell = z[:, : 3 * hidden], z[:, 3 * hidden :]
        for step in range(steps):
            np.matmul(self.own, h, out=z)
            for way, at in ((0, step), (1, steps - 1 - step)):
                np.take(self.given[way], x[at], axis=1, out=g, mode="clip")
                z[way] += g
            np.tanh(z, out=z)
            raw = z.copy() if trace is not None else None
            before = c.copy() if trace is not None else None
            gates *= 0.5
            gates += 0.5
            c *= z[:, hidden : 2 * hidden]
            np.multiply(z[:, :hidden], cell, out=t)
            c += t
            np.tanh(c, out=t)
            if trace is not None:
                trace.append((raw, z.copy(), before, t.copy()))
            h = out[step]
            np.multiply(z[:, 2 * hidden : 3 * hidden], t, out=h)
        return out

    def scores(self, states: np.ndarray) -> np.ndarray:
        """(steps, tags, texts)."""
        hidden = self.own.shape[2]
        return self.emit[:, :hidden] @ states[:, 0] + self.emit[:, hidden:] @ states[::-1, 1] + self.bias

    def read(self, codes: np.ndarray) -> np.ndarray:
        """``scores`` of the ``states``, made for reading many texts. A gate is 1 / (1 + exp(-2 z)) and tanh z twice that
        less 1: one exp serves all rows, in half the time of tanh. One product gives the gates and the tags of the step
        before, and what two neighbouring texts add to a gate is looked up at once."""
        steps, n = codes.shape
        hidden, rows = self.own.shape[2], self.own.shape[1]
        even = np.pad(codes, ((0, 0), (0, n % 2))).astype(np.intp)
        x = even[:, ::2] * CLASSES + even[:, 1::2]
        n = even.shape[1]
        given = np.stack(np.broadcast_arrays(self.given[..., None], self.given[:, :, None]), -1) * np.float32(-2)
        given = given.reshape(2, rows, -1).view(np.float64)  # (2, 4 H, classes ** 2), each a pair of float32
        weights = np.concatenate([self.own * np.float32(-2), np.stack([self.emit[:, :hidden], self.emit[:, hidden:]])], axis=1)
        product, g = np.empty((2, rows + TAGS, n), np.float32), np.empty((rows, n), np.float32)
        z, shown, pair = product[:, :rows], product[:, rows:], g.view(np.float64)
        into, keep, show, cell = (z[:, k * hidden : (k + 1) * hidden] for k in range(4))
        h, c, t = np.zeros((2, hidden, n), np.float32), np.zeros((2, hidden, n), np.float32), np.empty((2, hidden, n), np.float32)
        out = np.zeros((steps, TAGS, n), np.float32)
        with np.errstate(over="ignore"):  # exp of a closed gate is infinite, and the gate 0
            for step in range(steps + 1):
                np.matmul(weights, h, out=product)
                if step:
                    out[step - 1] += shown[0]
                    out[steps - step] += shown[1]
                if step == steps:
                    break
                for way, at in ((0, step), (1, steps - 1 - step)):
                    np.take(given[way], x[at], axis=1, out=pair, mode="clip")
                    z[way] += g
                np.exp(z, out=z)
                z += 1
                np.divide(1, z, out=z)
                cell *= 2
                cell -= 1
                c *= keep
                np.multiply(into, cell, out=t)
                c += t
                np.multiply(c, -2, out=t)
                np.exp(t, out=t)
                t += 1
                np.divide(2, t, out=t)
                t -= 1
                np.multiply(show, t, out=h)
        out += self.bias
        return out[:, :, : codes.shape[1]]

    def gradient(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log-likelihood of the tags and its gradient by each of ``arrays``."""
        steps, n = codes.shape
        hidden = self.own.shape[2]
        trace: list = []
        states = self.states(codes, trace)
        loss, d_scores, d_moves = crf_gradient(self.scores(states), self.moves, tags)
        d_states = np.empty_like(states)
        d_states[:, 0] = self.emit[:, :hidden].T @ d_scores
        d_states[::-1, 1] = self.emit[:, hidden:].T @ d_scores
        seen = np.concatenate([states[:, 0], states[::-1, 1]], axis=1)
        d_emit = np.tensordot(d_scores, seen, ([0, 2], [0, 2]))
        d_z = np.empty((steps, 2, 4 * hidden, n), np.float32)
        d_h, d_c = np.zeros((2, hidden, n), np.float32), np.zeros((2, hidden, n), np.float32)
        turned = self.own.transpose(0, 2, 1)
        for step in range(steps - 1, -1, -1):
            raw, z, before, t = trace[step]
            into, keep, show, cell = (z[:, k * hidden : (k + 1) * hidden] for k in range(4))
            d_h += d_states[step]
            d_c += d_h * show * (1 - t * t)
            d_gate = np.concatenate([d_c * cell * 0.5, d_c * before * 0.5, d_h * t * 0.5, d_c * into], axis=1)
            d_z[step] = d_gate * (1 - raw * raw)
            d_h = turned @ d_z[step]
            d_c = d_c * keep
        previous = np.concatenate([np.zeros_like(states[:1]), states[:-1]])
        d_own = np.stack([np.tensordot(d_z[:, w], previous[:, w], ([0, 2], [0, 2])) for w in range(2)])
        held = np.eye(CLASSES, dtype=np.float32)[np.stack([codes, codes[::-1]], 1)]
        d_given = np.stack([np.tensordot(d_z[:, w], held[:, w], ([0, 2], [0, 1])) for w in range(2)])
        return loss, [d_given, d_own, d_emit, d_scores.sum(axis=(0, 2))[:, None], d_moves]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def crf_gradient(scores: np.ndarray, moves: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood, its gradient by the scores (steps, tags, texts) and by the moves, from the
    forward and backward sums of all tag sequences."""
    steps, kinds, n = scores.shape
    e, m = scores.astype(np.float64), moves.astype(np.float64)
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        alpha[t] = log_sum(alpha[t - 1][:, None] + m[:, :, None], 0) + e[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = log_sum(m[:, :, None] + (e[t + 1] + beta[t + 1])[None], 1)
    whole = log_sum(alpha[-1], 0)
    single = np.exp(alpha + beta - whole)
    pairs = np.zeros((kinds, kinds))
    for t in range(1, steps):
        pairs += np.exp(alpha[t - 1][:, None] + m[:, :, None] + (e[t] + beta[t])[None] - whole).sum(axis=2)
    truth = np.eye(kinds)[tags].transpose(0, 2, 1)
    np.add.at(pairs, (tags[:-1].ravel(), tags[1:].ravel()), -1.0)
    path = (e * truth).sum() + m[tags[:-1], tags[1:]].sum()
    return float((whole.sum() - path) / n), ((single - truth) / n).astype(np.float32), (pairs / n).astype(np.float32)


def best_tags(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """(steps, texts): the tag sequence of greatest score."""
    steps, kinds, n = scores.shape
    came = np.empty((steps, kinds, n), np.int8)
    best = scores[0]
    for t in range(1, steps):
        through = best[:, None] + moves[:, :, None]
        came[t] = through.argmax(axis=0)
        best = through.max(axis=0) + scores[t]
    tags = np.empty((steps, n), np.int64)
    tags[-1] = best.argmax(axis=0)
    for t in range(steps - 1, 0, -1):
        tags[t - 1] = came[t, tags[t], np.arange(n)]
    return tags


def may_hold_spans(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """False for texts whose best sequence is surely all none: no stretch of tags gains, with the best tag of every
    character and the cheapest moves into, inside and out of the stretch."""
    over = moves - moves[0, 0]
    enter, stay, leave = float(over[0, 1:].max()), float(over[1:, 1:].max()), float(over[1:, 0].max())
    gain = scores[:, 1:].max(axis=1) - scores[:, 0]
    now = gain[0].copy()
    out = now + leave > 0
    for step in gain[1:]:
        now += stay
        np.maximum(now, enter, out=now)
        now += step
        out |= now + leave > 0
    return out | (now > 0)


def window_starts(length: int, window: int, overlap: int) -> np.ndarray:
    """Windows begin a step apart until one reaches the end of the text."""
    if length == 0:
        return np.zeros(0, np.int64)
    return np.arange(0, max(1, length - overlap), window - overlap)


Found = tuple[int, int, int, float]


def tagged(model: Tagger, codes: np.ndarray, bounds: np.ndarray, window: int, overlap: int, group: int = GROUP) -> Iterator[tuple[int, list[Found]]]:
    """(index of the text, its proposed (tag, start, end, score)) from the windows of texts that lie end to end."""
    starts = [window_starts(int(n), window, overlap) for n in np.diff(bounds)]
    owner = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
    offset = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    padded = np.append(codes, np.uint8(0))
    proposed: dict[int, list[Found]] = {}
    for low in range(0, len(owner), group):
        text, begin = owner[low : low + group], offset[low : low + group]
        at = (bounds[text] + begin)[None, :] + np.arange(window)[:, None]
        shown = padded[np.where(at < bounds[text + 1][None, :], at, len(codes))]
        scores = model.read(shown)
        open_ = np.flatnonzero(may_hold_spans(scores, model.moves))
        if not len(open_):
            continue
        scores = scores[:, :, open_]
        tags = best_tags(scores, model.moves)
        tags[shown[:, open_] == 0] = 0
        # What each tag, and each move, gains over none.
        gain = np.take_along_axis(scores, tags[:, None], 1)[:, 0] - scores[:, 0]
        moved = np.zeros((window + 1, len(open_)), np.float32)
        moved[1:window] = model.moves[tags[:-1], tags[1:]] - model.moves[0, 0]
        for k in np.flatnonzero(tags.any(axis=0)):
            own = tags[:, k]
            edges = np.flatnonzero(np.diff(own, prepend=0, append=0))
            for a, b in zip(edges, edges[1:]):
                if own[a]:
                    t, base = int(text[open_[k]]), int(begin[open_[k]])
                    proposed.setdefault(t, []).append((int(own[a]), base + int(a), base + int(b), float(gain[a:b, k].sum() + moved[a : b + 1, k].sum())))
    yield from proposed.items()


def reconciled(proposed: list[Found]) -> list[Found]:
    """Joins spans of one tag that overlap, then keeps the spans without overlap that have the greatest total score."""
    joined: list[list] = []
    for tag, start, end, score in sorted(proposed):
        if joined and joined[-1][0] == tag and start < joined[-1][2]:
            joined[-1][2] = max(end, joined[-1][2])
            joined[-1][3] = max(score, joined[-1][3])
        else:
            joined.append([tag, start, end, score])
    spans = sorted((tuple(s) for s in joined if s[3] > 0), key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    best: list[tuple[float, int]] = [(0.0, -1)]  # total score, and the last span it takes (-1: the one before stays)
    before = [bisect_right(ends, s[1], 0, i) for i, s in enumerate(spans)]
    for i, s in enumerate(spans):
        take = best[before[i]][0] + s[3]
        best.append((take, i) if take > best[i][0] else (best[i][0], -1))
    out, i = [], len(spans)
    while i:
        if best[i][1] < 0:
            i -= 1
        else:
            out.append(spans[i - 1])
            i = before[i - 1]
    return out[::-1]


def added_spans(text: str, proposed: list[Found], known: list[Span]) -> list[Span]:
    """What the model adds to the known spans of a text."""
    out = []
    for tag, start, end, _ in reconciled(proposed):
        kind = KINDS[tag - 1]
        while start < end and not (text[start].isalnum() or text[start] in "+(" and kind == "phone"):
            start += 1
        while start < end and not text[end - 1].isalnum():
            end -= 1
        if start < end and plausible(kind, text[start:end]) and not any(a < end and start < b for _, a, b in known):
            out.append((kind, start, end))
    return out


def respelled(kind: str, value: str, rng: np.random.Generator) -> str:
    """Another usual spelling of a value."""
    if kind == "email":
        at, dot = [("@", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" at ", " dot "), ("[at]", ".")][rng.integers(6)]
        name, host = value.split("@", 1)
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return value.replace(".", [".", "[.]", " . ", "(.)"][rng.integers(4)])
    digits = list(digits_of(value))
    if kind == "card":
        between = [".", "/", "_", "  ", " - ", "-", " "][rng.integers(7)]
        return between.join("".join(digits[i : i + 4]) for i in range(0, len(digits), 4))
    digits = [*digits[:1], *[str(d) for d in rng.integers(0, 10, max(8, len(digits) - 1))]]
    country, area, first, rest = digits[0], "".join(digits[1:4]), "".join(digits[4:7]), "".join(digits[7:])
    return [f"({area}) {first}-{rest}", f"{area}-{first}-{rest}", f"00{country} {area} {first}{rest}", f"+{country}/{area}/{first}{rest}", f"{area}.{first}.{rest}", f"+{country} ({area}) {first}-{rest}"][rng.integers(6)]


def other_number(rng: np.random.Generator) -> str:
    """Digits that are no personal data: dates, times, amounts, versions, counts, hexadecimal marks."""
    a, b, c, d = (int(x) for x in rng.integers(0, 60, 4))
    long = "".join(str(x) for x in rng.integers(0, 10, int(rng.integers(4, 26))))
    marks = "".join("0123456789abcdef"[x] for x in rng.integers(0, 16, int(rng.integers(8, 41))))
    return [f"20{a:02d}-{b % 12 + 1:02d}-{c % 28 + 1:02d}", f"{a % 24:02d}:{b:02d}:{c:02d}", f"${a},{b:03d}.{c:02d}", f"v{a}.{b}.{c}", f"{a}.{long[:6]}", long, marks, f"{a}-{b}", f"({a})", f"{a}/{b}/20{c:02d}"][d % 10]


def examples(excerpts: list[tuple[str, str, int, int]], rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, tags) of labelled excerpts (kind or "none", text, start, end), as they are and re-spelled."""
    out = []
    for kind, text, start, end in excerpts:
        for again in range(3):
            value = text[start:end]
            if kind == "none":
                value = value if again == 0 else other_number(rng)
            elif again:
                value = respelled(kind, value, rng)
            shown = text[:start] + value + text[end:]
            tags = np.zeros(len(shown), np.int64)
            if kind != "none":
                tags[start : start + len(value)] = KINDS.index(kind) + 1
                # Other rule spans of the excerpt stay labelled.
            for other, a, b in rule_spans(shown):
                if kind == "none" or b <= start or a >= start + len(value):
                    tags[a:b] = KINDS.index(other) + 1
            out.append((coded(shown), tags))
    return out


def put(into: np.ndarray, values: np.ndarray, at: int) -> None:
    """Writes the part of ``values``, laid at ``at``, that falls inside."""
    low, high = max(0, at), min(len(into), at + len(values))
    if low < high:
        into[low:high] = values[low - at : high - at]


def fit(excerpts: list[tuple[str, str, int, int]], steps: int = 300, batch: int = 48, rate: float = 0.05, seed: int = 7, hidden: int = HIDDEN) -> Tagger:
    """Adam steps on windows cut at random from the examples, each kind as often; the rate falls to a tenth."""
    rng = np.random.default_rng(seed)
    of_kind: dict[str, list] = {}
    for excerpt in excerpts:
        of_kind.setdefault(excerpt[0], []).extend(examples([excerpt], rng))
    kinds = sorted(of_kind)
    model = Tagger.fresh(rng, hidden)
    first, second = [np.zeros_like(a) for a in model.arrays()], [np.zeros_like(a) for a in model.arrays()]
    for step in range(1, steps + 1):
        codes, tags = np.full((FIT_WINDOW, batch), coded(" ")[0]), np.zeros((FIT_WINDOW, batch), np.int64)
        for k in range(batch):
            drawn = of_kind[kinds[rng.integers(len(kinds))]]
            own, labels = drawn[rng.integers(len(drawn))]
            # An example begins anywhere in its window, or the window anywhere in it; others fill the window up.
            at = int(rng.integers(min(0, FIT_WINDOW - len(own)), max(1, FIT_WINDOW - len(own) // 2)))
            put(codes[:, k], own, at)
            put(tags[:, k], labels, at)
            for way in (-1, 1):
                edge = at if way < 0 else at + len(own) + 1
                while (edge > 0) if way < 0 else (edge < FIT_WINDOW):
                    drawn = of_kind[kinds[rng.integers(len(kinds))]]
                    own, labels = drawn[rng.integers(len(drawn))]
                    edge = edge - len(own) - 1 if way < 0 else edge
                    put(codes[:, k], own, edge)
                    put(tags[:, k], labels, edge)
                    edge = edge if way < 0 else edge + len(own) + 1
        _, gradient = model.gradient(codes, tags)
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradient))
        pace = rate * (1 - 0.9 * step / steps)
        for a, g, m, v in zip(model.arrays(), gradient, first, second):
            g = g / max(1.0, norm / 5)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def batches_of_texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int, list[str]]]:
    for batch in batches:
        _, offsets = text_buffers(batch.column(column))
        for low, high in pieces(offsets, 1 << 19):
            yield batch, low, high, [t or "" for t in batch.column(column).slice(low, high - low).to_pylist()]


def labelled_excerpts(docs: DataFrame, per_kind: int = FIT_ROWS) -> list[tuple[str, str, int, int]]:
    """At most ``per_kind`` excerpts around rule spans of each kind, and as many around other digits or plain words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, texts in batches_of_texts(batches, 0):
            rows = []
            for text in texts:
                spans = rule_spans(text)
                other = next((m for m in re.finditer("[0-9]+", text) if not any(a <= m.start() < b for _, a, b in spans)), None)
                middle = len(text) // 2
                spans.append(("none", *(other.span() if other and other.end() - other.start() <= MARGIN else (middle, middle))))
                for kind, a, b in spans:
                    low = max(0, a - MARGIN)
                    rows.append((kind, text[low : b + MARGIN], a - low, b - low))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            types = [pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["kind", "excerpt", "start", "end"])

    found = docs.select("text").mapInArrow(run, "kind string, excerpt string, start int, end int").dropDuplicates(["kind", "excerpt", "start"])
    spot = F.pmod(F.xxhash64("excerpt", "start"), F.lit(1 << 30))
    scratch = Scratch(docs.sparkSession)
    stored = scratch.put("personal-excerpts", found.withColumn("spot", spot))
    # A few times the rows that are wanted by their hash, then the first of them: no task ranks a whole kind.
    counts = stored.groupBy("kind").agg(F.count("*").alias("n")).collect()  # five kinds
    share = F.create_map(*[x for r in counts for x in (F.lit(r.kind), F.lit(min(1.0, 4 * per_kind / r.n)))]) if counts else F.lit(None)
    order = Window.partitionBy("kind").orderBy("spot", "excerpt", "start")
    drawn = stored.where(F.col("spot") < share[F.col("kind")] * float(1 << 30)) if counts else stored
    first = drawn.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_kind)
    rows = first.select("kind", "excerpt", "start", "end", "n").collect()
    scratch.drop("personal-excerpts")
    return [(r.kind, r.excerpt, r.start, r.end) for r in sorted(rows, key=lambda r: (r.kind, r.n))]


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS, steps: int = 300) -> Tagger | None:
    excerpts = labelled_excerpts(docs, fit_rows)
    return fit(excerpts, steps) if any(kind != "none" for kind, *_ in excerpts) else None


def personal_data(docs: DataFrame, model: Tagger | None, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, text_key and spans (kind, start, end, by: "rule" or "model") of each row, by kind, then start."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, low, high, texts in batches_of_texts(batches, 2):
            spans = [[(*s, "rule") for s in rule_spans(t)] for t in texts]
            if model is not None:
                bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                for i, proposed in tagged(model, coded("".join(texts)), bounds, window, overlap):
                    known = [s[:3] for s in spans[i]]
                    spans[i] += [(*s, "model") for s in added_spans(texts[i], proposed, known)]
            for of in spans:
                of.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
            flat = [s for of in spans for s in of]
            columns = list(zip(*flat)) if flat else [[], [], [], []]
            types = [pa.string(), pa.int32(), pa.int32(), pa.string()]
            struct = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["kind", "start", "end", "by"])
            found = lists(np.concatenate([[0], np.cumsum([len(of) for of in spans])]), struct)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(low, high - low) for i in range(2)], found], ["doc_id", "text_key", "spans"])

    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    return rows.mapInArrow(run, f"doc_id {id_type}, text_key bigint, spans {SPANS}")
