"""Personal data by patterns and a character-level bidirectional LSTM with a CRF on top.

Patterns give the base spans: e-mail and IP addresses, card and phone numbers. The network learns what such spans look
like, in which surroundings, from windows of text labelled with base spans, and from the same windows with spans
rewritten to forms that the patterns miss, and adds spans that the patterns are too strict for. It is trained in
numpy on a bounded number of windows and travels with the query.

Only text near a digit or ``@`` can hold personal data of these kinds, so a text is cut into stretches around
them and stretches into overlapping windows. Each window is decoded to tag probabilities by forward-backward; where windows
overlap, probabilities are blended by the distance to the window's edge, and one Viterbi pass over the whole stretch
reconciles them to spans.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from celltide.llm.text import whole
from celltide.runtime import checkpoint

KINDS = ("email", "ip", "card", "phone")
EMAIL_END = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# a match can only begin where a run of digits does, and never gives digits back
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[@0-9]")
# what may be personal data in a form that the patterns miss, so no example of other text; dates are
UNCLEAR = re.compile(r"@|(?<!\w)\(?[0-9][0-9 ()./-]{5,}[0-9](?!\w)")
DATE = re.compile(r"(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?: [0-9]{1,2})?")

#: Characters of a window, between two windows, and on both sides of a trigger.
WINDOW, STRIDE, AROUND = 64, 32, 24
#: Documents to look for training windows in, most windows to train on, both picked by hash order.
TRAIN_DOCS, TRAIN_WINDOWS = 8_000, 1_000
HIDDEN, STEPS, BATCH, RATE = 16, 160, 128, 0.02
#: Least mean probability of an added span and least digits of an added phone number.
SURE, DIGITS = 0.9, 7
#: Symbols: padding, lower case, upper case, digit, other, then these marks one by one.
MARKS = "@.-+() _%/:,;\n\"'#*|"
OUTSIDE = 0

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, end, kind, good) of every pattern match: leftmost non-overlapping per kind; ``good`` tells what passes its check."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in EMAIL_NAME:
            begin -= 1
        if begin < at and (m := EMAIL_END.match(text, at)):
            found.append((begin, m.end(), 0, True))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        found.append((m.start(), m.end(), 1, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        found.append((m.start(), m.end(), 2, 14 <= len(digits) <= 19 and luhn(digits)))
    for m in PHONE.finditer(text):
        found.append((m.start(), m.end(), 3, 10 <= sum(c in "0123456789" for c in m[0]) <= 15))
    return found


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text around its digits and ``@``, with what lies between near ones."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        if out and m.start() - AROUND <= out[-1][1]:
            out[-1][1] = min(len(text), m.end() + AROUND)
        else:
            out.append([max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)])
    return [(a, b) for a, b in out]


def windows(begin: int, end: int) -> list[int]:
    """Starts of the overlapping windows that cover a stretch."""
    return [begin] if end - begin <= WINDOW else [*range(begin, end - WINDOW, STRIDE), end - WINDOW]


def symbols(text: str) -> np.ndarray:
    """Symbol numbers of the first WINDOW characters, padded with 0."""
    mark = {c: 5 + i for i, c in enumerate(MARKS)}
    out = np.zeros(WINDOW, dtype=np.int64)
    for i, c in enumerate(text[:WINDOW]):
        out[i] = mark.get(c) or (3 if c in "0123456789" else 1 if c.islower() else 2 if c.isupper() else 4)
    return out


def tags(spans: Sequence[Span], begin: int, end: int) -> list[int]:
    """Tags of the characters: 0 outside, 1 + 2 * kind at a span's first character, 2 + 2 * kind further inside."""
    out = [OUTSIDE] * (end - begin)
    for a, b, kind in spans:
        for i in range(max(a, begin), min(b, end)):
            out[i - begin] = 1 + 2 * kind + (i > a)
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Tagger:
    """Bidirectional LSTM with a linear-chain CRF; windows of symbols in, tag probabilities out."""

    n_symbols, n_tags = 5 + len(MARKS), 1 + 2 * len(KINDS)

    def __init__(self, seed: int = 1):
        draw, h = np.random.default_rng(seed), HIDDEN
        self.p = {"out": draw.normal(0, 0.2, (2 * h, self.n_tags)), "bias": np.zeros(self.n_tags), "move": np.zeros((self.n_tags, self.n_tags))}
        for way in ("f", "b"):
            self.p[f"{way}x"] = draw.normal(0, 0.3, (self.n_symbols, 4 * h))
            self.p[f"{way}h"] = draw.normal(0, 0.2, (h, 4 * h))
            self.p[f"{way}c"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])  # open forget gates

    def _lstm(self, way: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        h = c = np.zeros((len(x), HIDDEN))
        out, tape = np.zeros((len(x), WINDOW, HIDDEN)), []
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            z = self.p[f"{way}x"][x[:, t]] + h @ self.p[f"{way}h"] + self.p[f"{way}c"]
            gates = 1 / (1 + np.exp(-z[:, :3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            g, live = np.tanh(z[:, 3 * HIDDEN:]), (x[:, t] > 0)[:, None]
            new = (f * c + i * g) * live
            squashed = np.tanh(new)
            tape.append((t, h, c, i, f, o, g, squashed, live))
            h, c = o * squashed * live, new
            out[:, t] = h
        return out, tape

    def _lstm_back(self, way: str, x: np.ndarray, tape: list, d_out: np.ndarray, grad: dict) -> None:
        dh = dc = np.zeros((len(x), HIDDEN))
        for t, h, c, i, f, o, g, squashed, live in reversed(tape):
            dh = (dh + d_out[:, t]) * live
            dc = (dc + dh * o * (1 - squashed ** 2)) * live
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g ** 2)], axis=1)
            np.add.at(grad[f"{way}x"], x[:, t], dz)
            grad[f"{way}h"] += h.T @ dz
            grad[f"{way}c"] += dz.sum(axis=0)
            dh, dc = dz @ self.p[f"{way}h"].T, dc * f

    def _chain(self, scores: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log scores of the CRF, and the log of the sum over all taggings."""
        move, n = self.p["move"], len(x)
        ahead, back = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0]
        for t in range(1, WINDOW):
            step = _log_sum(ahead[:, t - 1, :, None] + move, 1) + scores[:, t]
            ahead[:, t] = np.where((x[:, t] > 0)[:, None], step, ahead[:, t - 1])
        for t in range(WINDOW - 2, -1, -1):
            step = _log_sum(move + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where((x[:, t + 1] > 0)[:, None], step, 0.0)
        return ahead, back, _log_sum(ahead[:, -1], 1).reshape(n, 1, 1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Tag probabilities (window, character, tag); padding has no meaning."""
        f, b = self._lstm("f", x)[0], self._lstm("b", x)[0]
        scores = np.concatenate([f, b], axis=2) @ self.p["out"] + self.p["bias"]
        ahead, back, total = self._chain(scores, x)
        return np.exp(ahead + back - total)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log likelihood of the tags ``y``."""
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        (f, f_tape), (b, b_tape) = self._lstm("f", x), self._lstm("b", x)
        both = np.concatenate([f, b], axis=2)
        scores = both @ self.p["out"] + self.p["bias"]
        ahead, back, total = self._chain(scores, x)
        live = (x > 0)[:, :, None]
        d = (np.exp(ahead + back - total) - np.eye(self.n_tags)[y]) * live / len(x)
        pairs = live[:, 1:]
        expected = np.exp(ahead[:, :-1, :, None] + self.p["move"] + (scores + back)[:, 1:, None, :] - total[..., None]) * pairs[..., None]
        seen = np.zeros_like(self.p["move"])
        np.add.at(seen, (y[:, :-1][pairs[:, :, 0]], y[:, 1:][pairs[:, :, 0]]), 1.0)
        grad["move"] = (expected.sum(axis=(0, 1)) - seen) / len(x)
        grad["out"], grad["bias"] = np.tensordot(both, d, axes=((0, 1), (0, 1))), d.sum(axis=(0, 1))
        d_both = d @ self.p["out"].T
        self._lstm_back("f", x, f_tape, d_both[:, :, :HIDDEN], grad)
        self._lstm_back("b", x, b_tape, d_both[:, :, HIDDEN:], grad)
        return grad

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 2) -> Tagger:
        """Adam over shuffled batches, the same number of steps however few windows; the same windows give the same weights."""
        draw, first, second, turn = np.random.default_rng(seed), {}, {}, 0
        while turn < steps:
            order = draw.permutation(len(x))
            for at in range(0, len(x), BATCH):
                turn += 1
                batch = order[at:at + BATCH]
                for k, g in self.gradient(x[batch], y[batch]).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                    second[k] = 0.999 * second.get(k, 0) + 0.001 * g * g
                    self.p[k] -= RATE * first[k] / (1 - 0.9 ** turn) / (np.sqrt(second[k] / (1 - 0.999 ** turn)) + 1e-8)
        return self


def reconcile(probability: np.ndarray, starts: Sequence[int], begin: int, end: int) -> np.ndarray:
    """Tag probabilities of a stretch from those of its windows, blended by distance to the window's edge."""
    edge = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(float)
    blend, weight = np.zeros((end - begin, probability.shape[2])), np.zeros((end - begin, 1))
    for p, s in zip(probability, starts):
        n = min(WINDOW, end - s)
        blend[s - begin:s - begin + n] += p[:n] * edge[:n, None]
        weight[s - begin:s - begin + n] += edge[:n, None]
    return blend / weight


def best_spans(probability: np.ndarray, begin: int) -> list[tuple[int, int, int, float]]:
    """(start, end, kind, mean probability) of the best tagging of a stretch in which spans open before they go on."""
    n_tags = probability.shape[1]
    allowed = np.ones((n_tags, n_tags), dtype=bool)
    for inside in range(2, n_tags, 2):
        allowed[:, inside] = False
        allowed[[inside - 1, inside], inside] = True
    log = np.log(probability + 1e-12)
    score, trace = log[0].copy(), np.zeros(probability.shape, dtype=np.int64)
    score[2::2] = -np.inf
    barred = np.where(allowed, 0.0, -np.inf)
    for t in range(1, len(log)):
        step = score[:, None] + barred
        trace[t] = step.argmax(axis=0)
        score = step.max(axis=0) + log[t]
    tag = [int(score.argmax())]
    for t in range(len(log) - 1, 0, -1):
        tag.append(int(trace[t, tag[-1]]))
    tag.reverse()
    out, t = [], 0
    while t < len(tag):
        if tag[t] % 2 == 0:
            t += 1
            continue
        a, inside = t, tag[t] + 1
        t += 1
        while t < len(tag) and tag[t] == inside:
            t += 1
        out.append((begin + a, begin + t, tag[a] // 2, float(np.mean([probability[i, tag[i]] for i in range(a, t)]))))
    return out


def _plausible(text: str, a: int, b: int, kind: int) -> bool:
    """Whether a span ends where its words and numbers do and holds what its kind needs, in whatever form."""
    if a and text[a - 1].isalnum() or b < len(text) and text[b].isalnum():
        return False
    numbers = re.findall("[0-9]+", text[a:b])
    digits = "".join(numbers)
    if kind == 0:
        name, at, host = text[a:b].partition("@")
        return bool(at) and any(map(str.isalnum, name)) and any(map(str.isalnum, host))
    if kind == 1:
        return len(numbers) == 4 and all(len(n.lstrip("0")) <= 3 and int(n.lstrip("0") or 0) <= 255 for n in numbers)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else DIGITS <= len(digits) <= 15


def _added(text: str, spans: list[tuple[int, int, int, float]], matches: list[tuple[int, int, int, bool]]) -> list[Span]:
    """What the network adds: sure, plausible spans apart from every base span; a match that failed its check bars nothing."""
    base = [(x, y) for x, y, _, good in matches if good]
    return [
        (a, b, kind) for a, b, kind, sure in spans
        if sure >= SURE and _plausible(text, a, b, kind) and all(b <= x or a >= y for x, y in base)
    ]


def find_spans(texts: Sequence[str], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text, as (start, end, kind) in code points."""
    matches = [base_matches(t) if TRIGGER.search(t) else [] for t in texts]
    spans: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    if tagger is not None:
        waiting: list[tuple[int, int, int, list[int]]] = []
        held = 0

        def settle() -> None:
            x = np.stack([symbols(texts[k][s:min(s + WINDOW, b)]) for k, _, b, starts in waiting for s in starts])
            p = np.concatenate([tagger.probabilities(x[i:i + 512]) for i in range(0, len(x), 512)])
            at = 0
            for k, a, b, starts in waiting:
                spans[k] += best_spans(reconcile(p[at:at + len(starts)], starts, a, b), a)
                at += len(starts)
            waiting.clear()

        for k, text in enumerate(texts):
            for a, b in stretches(text):
                waiting.append((k, a, b, windows(a, b)))
                held += len(waiting[-1][3])
                if held >= 2048:
                    settle()
                    held = 0
        if waiting:
            settle()
    order = lambda s: (s[0], s[2])
    return [
        (sorted(((a, b, k) for a, b, k, good in m if good), key=order), sorted(_added(t, s, m), key=order))
        for t, m, s in zip(texts, matches, spans)
    ]


def said(spans: Sequence[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _missed(part: str, kind: int, draw: random.Random) -> str:
    """A form of personal data that the patterns miss: an e-mail address made from ``part``, or a number of other kind."""
    n = lambda k: "".join(draw.choices("0123456789", k=k))
    if kind == 0:
        name, _, host = part.partition("@")
        return name + draw.choice((" @ ", " @ ", " @", "@ ")) + host
    if kind == 1:
        return draw.choice((" . ", ". ", " .", "[.]")).join(str(draw.randint(0, 255)) for _ in range(4))
    if kind == 2:
        return draw.choice((".", "/", "  ", " - ", "_")).join(n(4) for _ in range(4))
    return draw.choice((
        f"({n(3)}) {n(3)}-{n(4)}", f"({n(3)}) {n(3)} {n(4)}", f"({n(3)}){n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"{n(3)}.{n(3)}.{n(4)}",
        f"{n(3)} {n(3)} {n(4)}", f"{n(3)}-{n(4)}", f"1 ({n(3)}) {n(3)}-{n(4)}", f"0{n(2)} / {n(3)} {n(3)} {n(2)}", f"0{n(3)}/{n(6)}",
        f"0{n(2)} {n(7)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}",
    ))


def _other_number(draw: random.Random) -> str:
    """A number with marks that is no personal data: a date, a time or an amount."""
    year, month, day, k = draw.randint(1900, 2099), draw.randint(1, 12), draw.randint(1, 28), draw.randint(1, 999)
    return draw.choice((
        f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{month}/{day}/{year}", f"{year}-{month:02}-{day:02} {day:02}:{month:02}",
        f"{day:02}:{month:02}:{day:02}", f"{k},{year - 1800:03},{k:03}", f"{k}.{year - 1800:03}.{k:03}", f"{k}.{month:02}", f"{year}", f"{k}{year}{day}",
    ))


def rewritten(window: str, labels: Sequence[int], draw: random.Random) -> tuple[str, list[int]] | None:
    """A window and its tags with each whole span rewritten to a form that the patterns miss, one in five to another number; None without any."""
    text, out, at = "", [], 0
    while at < len(labels):
        tag, end = labels[at], at + 1
        while tag % 2 and end < len(labels) and labels[end] == tag + 1:
            end += 1
        part, own = window[at:end], labels[at:end]
        if tag % 2 and end < len(labels):
            kind = 0 if tag == 1 and draw.random() < 0.6 else draw.choice((1, 2, 3, 3))
            if draw.random() < 0.8:
                part = _missed(part, kind, draw)
                own = tags([(0, len(part), kind)], 0, len(part))
            else:
                part = _other_number(draw)
                own = [OUTSIDE] * len(part)
        text, at = text + part, end
        out += own
    return None if text == window else (text[:WINDOW], out[:WINDOW])


def _unclear(text: str, spans: Sequence[Span]) -> list[tuple[int, int]]:
    """What may be personal data outside the base spans."""
    return [
        m.span() for m in UNCLEAR.finditer(text)
        if all(m.end() <= a or m.start() >= b for a, b, _ in spans) and not DATE.fullmatch(m[0].strip("()"))
        and (m[0] == "@" or DIGITS <= sum(c in "0123456789" for c in m[0]) <= 15 and not m[0].isdigit())
    ]


def train_tagger(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_windows: int = TRAIN_WINDOWS) -> Tagger | None:
    """A tagger trained on windows of ``docs`` (doc_id, text) labelled with base spans; None without any window.

    At most ``train_docs`` documents are looked at and at most ``train_windows`` windows come to the driver, both the first in hash order.
    Windows that hold what may be personal data outside base spans are no examples; the others come a second time with
    their spans in forms that the patterns miss.
    """
    picked = checkpoint(docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                if text is None:
                    continue
                spans = [(a, b, k) for a, b, k, good in base_matches(text) if good]
                unclear = _unclear(text, spans)
                for begin, end in stretches(text):
                    near = [s for s in spans if s[0] < end and s[1] > begin]
                    doubt = [d for d in unclear if d[0] < end and d[1] > begin]
                    for s in windows(begin, end):
                        last = min(s + WINDOW, end)
                        if all(last <= a or s >= b for a, b in doubt):
                            rows.append((text[s:last], tags(near, s, last)))
            yield pd.DataFrame(rows, columns=["window", "tags"])

    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text").mapInPandas(label, "window string, tags array<int>")
    # each window once, so that the copies of one line can't crowd out the others
    rows = found.distinct().orderBy(F.xxhash64("window"), "window").limit(train_windows).collect()
    if not rows:
        return None
    labelled = [(r["window"], r["tags"]) for r in rows]
    draw = random.Random(3)
    labelled += [new for window, own in labelled if (new := rewritten(window, own, draw))]
    x, y = np.stack([symbols(window) for window, _ in labelled]), np.zeros((len(labelled), WINDOW), dtype=np.int64)
    for i, (_, own) in enumerate(labelled):
        y[i, :len(own)] = own
    return Tagger().train(x, y)


def personal_data(docs: DataFrame, tagger: Tagger | None, column: str = "text") -> DataFrame:
    """``docs`` with ``found`` (kind, start, end, text, base), n_email, n_ip, n_card, n_phone, base_sha256, spans.

    ``found`` lists base and added spans by start, then kind as listed; the counts are those of base spans, and ``base_sha256`` is the digest
    of base spans written as ``kind:start:end``, comma-joined; ``spans`` holds all spans so. Null texts count as
    empty. Without a tagger only base spans are found. New names replace columns of the same name.
    """
    counts = [f"n_{k}" for k in KINDS]
    names = ["found", *counts, "base_sha256", "spans"]
    fields = "found: array<struct<kind: string, start: long, end: long, text: string, base: boolean>>, " + ", ".join(f"{c}: long" for c in counts) + ", base_sha256: string, spans: string"

    @F.pandas_udf(f"struct<{fields}>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, rows = batch.tolist(), []
            for text, (base, added) in zip(texts, find_spans(texts, tagger)):
                every = sorted([*((*s, True) for s in base), *((*s, False) for s in added)], key=lambda s: (s[0], s[2]))
                rows.append((
                    [{"kind": KINDS[k], "start": a, "end": b, "text": text[a:b], "base": own} for a, b, k, own in every],
                    *(sum(k == kind for _, _, k in base) for kind in range(len(KINDS))),
                    hashlib.sha256(said(base).encode()).hexdigest(), said([s[:3] for s in every]),
                ))
            yield pd.DataFrame(rows, columns=names)

    docs = docs.drop(*names)
    return docs.withColumn("_pii", find(whole(F.col(column)))).select(*docs.columns, *[F.col(f"_pii.{n}").alias(n) for n in names])
