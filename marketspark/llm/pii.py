"""Operator 4: personal data by fixed rules and a character BiLSTM with CRF transitions.

Fixed rules give the base spans (email, ip, card, phone); the model adds spans
that no rule has.  The model reads character classes: a forward and a backward
LSTM (gates clipped-linear, cell output softsign, so a step is plain
arithmetic) score five labels per character, and a CRF's transition scores
choose the label sequence.  It is trained here, in numpy, by the CRF's
likelihood on windows around labelled spans of a bounded sample: those of the
fixed rules, and the same in written forms that the rules miss (spaces or other
signs between the parts, dots written out, numbers without a plus).

A text is cut into windows of ``WINDOW`` characters that overlap by
``OVERLAP``.  Each is decoded by itself; each position takes its label from the
window in which it lies farthest from an edge, and spans are read from the
labels of the whole text, so one may cross any number of windows.  An added
span must pass the kind's exact test and must not touch a base span.

The training sample is bounded: the ``SAMPLE_DOCS`` documents of smallest hash
among those with a base span, and ``PLAIN_DOCS`` without one.

Defined cases: NULL text counts as empty and has no span; a NULL doc_id is
kept; rows that repeat get equal results; an empty table (or one without any
span to learn from) gives a model that adds nothing; texts of any length are
read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import blocks, id_and_text

KINDS = ["email", "ip", "card", "phone"]
LABELS = 1 + len(KINDS)
HIDDEN, WINDOW, OVERLAP = 8, 128, 32
SAMPLE_DOCS, PLAIN_DOCS, SAMPLE_CHARS = 192, 64, 16_384
EPOCHS, BATCH, RATE, TRAIN_WINDOW, MAX_WINDOWS = 48, 128, 0.03, 64, 1024
LANES = 2048

# Character classes with a meaning in personal data; other characters share a class each for
# lower-case letters, upper-case letters, other letters and the rest.
SINGLE = "@.-+()_% ,:/\n"
CLASSES = 1 + len(SINGLE) + 5  # 0 pads a window
_AT, _DIGIT = 1 + SINGLE.index("@"), CLASSES - 5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A number run is entered at its start only: from inside it the same match fails the same way.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, start if start == at else done)
        at = text.find("@", max(at + 1, done))
    return out


def _octets(address: str) -> bool:
    """Every part is at most 255, with any number of leading zeros."""
    parts = [p.lstrip("0") or "0" for p in address.split(".")]
    return all(len(p) < 4 and int(p) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# ------------------------------------------------------- forms that the rules miss

_DOTS = [" . ", ". ", "[.]", "(.)", " dot ", "(dot)", "[dot]"]
_DOT = re.compile(r"\s*(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\bdot\b|\.)\s*")


def disguise(kind: str, s: str, r: np.random.RandomState) -> str:
    """A written form of a span that keeps its meaning and that no base rule has."""
    pick = lambda options: options[r.randint(len(options))]
    if kind == "email":
        local, domain = s.rsplit("@", 1)
        head, last = domain.rsplit(".", 1)
        at, dot = (pick(["@", " @ ", "@ "]), pick(_DOTS)) if r.randint(3) else (pick([" @ ", " @"]), ".")
        return f"{local}{at}{head}{dot}{last}"
    if kind == "ip":
        return pick([" . ", "[.]", "(.)", ". ", " dot "]).join(s.split("."))
    digits = _digits(s)
    if kind == "card":
        return pick([".", "/", "  ", " - ", " / "]).join(digits[i:i + 4] for i in range(0, len(digits), 4))
    cut = 2 + r.randint(3)
    rest = pick([" ", "-", ".", "/"]).join(digits[i:i + 3] for i in range(cut, len(digits), 3))
    return pick([f"({digits[:cut]}) {rest}", f"00{digits[:cut]} {rest}", f"+ {digits[:cut]} {rest}", f"{digits[:cut]}-{rest}"])


def disguised(text: str, r: np.random.RandomState) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its base spans in other written forms, and where these stand."""
    out, spans, done = [], [], 0
    size = 0
    for kind, a, b in sorted(base_spans(text), key=lambda x: x[1:]):
        if a < done:
            continue
        form = disguise(kind, text[a:b], r)
        out += [text[done:a], form]
        size += a - done
        spans.append((kind, size, size + len(form)))
        size, done = size + len(form), b
    return "".join([*out, text[done:]]), spans


_CLASS: list[np.ndarray] = []


def class_table() -> np.ndarray:
    if not _CLASS:
        table = np.full(0x110000, CLASSES - 1, dtype=np.uint8)
        letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
        table[letters] = CLASSES - 2
        for i in range(128):
            c = chr(i)
            if c in SINGLE:
                table[i] = 1 + SINGLE.index(c)
            elif c.isdigit():
                table[i] = CLASSES - 5
            elif c.isalpha():
                table[i] = CLASSES - 4 if c.islower() else CLASSES - 3
        _CLASS.append(table)
    return _CLASS[0]


def classes(text: str) -> np.ndarray:
    return class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]


# ------------------------------------------------------------------- the model
#
# Arrays are (feature, lane).  Gates stand in the order input, forget, output,
# candidate, HIDDEN rows each.


def _gate(z: np.ndarray) -> np.ndarray:
    return np.clip(z * np.float32(0.25) + np.float32(0.5), 0, 1)


def _squash(z: np.ndarray) -> np.ndarray:
    return z / (1 + np.abs(z))


class Tagger:
    """BiLSTM-CRF over character classes."""

    def __init__(self, seed: int = 7):
        r = np.random.RandomState(seed)
        g = 4 * HIDDEN
        self.w: dict[str, np.ndarray] = {}
        for d in ("f", "b"):
            self.w["in" + d] = (r.randn(g, CLASSES) * 0.3).astype(np.float32)
            self.w["in" + d][HIDDEN:2 * HIDDEN] += 1
            self.w["rec" + d] = (r.randn(g, HIDDEN) * 0.3).astype(np.float32)
            self.w["out" + d] = (r.randn(LABELS, HIDDEN) * 0.3).astype(np.float32)
        self.w["bias"] = np.zeros((LABELS, 1), dtype=np.float32)
        self.w["trans"] = np.zeros((LABELS, LABELS), dtype=np.float32)  # from row to column
        self.w["trans"][np.arange(LABELS), np.arange(LABELS)] = 1
        self.trained = False

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Emission part of one direction: (time, LABELS, lanes); ``x`` is (time, lanes)."""
        steps, lanes = x.shape
        table, rec, out = self.w["in" + d], self.w["rec" + d], self.w["out" + d]
        h = np.zeros((HIDDEN, lanes), dtype=np.float32)
        c = np.zeros_like(h)
        emitted = np.empty((steps, LABELS, lanes), dtype=np.float32)
        k = HIDDEN
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = rec @ h
            z += table.take(x[t], axis=1)
            gates = _gate(z[:3 * k])
            cand = _squash(z[3 * k:])
            before = c
            c = gates[k:2 * k] * before + gates[:k] * cand
            s = _squash(c)
            if keep is not None:
                keep.append((t, h, before, z, gates, cand, c, s))
            h = gates[2 * k:] * s
            np.matmul(out, h, out=emitted[t])
        return emitted

    def emissions(self, x: np.ndarray) -> np.ndarray:
        e = self._run(x, "f")
        e += self._run(x, "b")
        e += self.w["bias"]
        return e

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best label sequence of each lane: (time, lanes)."""
        e, trans = self.emissions(x), self.w["trans"]
        steps, _, lanes = e.shape
        best = np.empty_like(e)  # of the sequences that end in a label
        best[0] = e[0]
        for t in range(1, steps):
            np.max(best[t - 1][:, None, :] + trans[:, :, None], axis=0, out=best[t])
            best[t] += e[t]
        labels = np.empty((steps, lanes), dtype=np.uint8)
        labels[-1] = best[-1].argmax(axis=0)
        for t in range(steps - 1, 0, -1):
            labels[t - 1] = (best[t - 1] + trans.take(labels[t], axis=1)).argmax(axis=0)
        return labels

    # -------------------------------------------------------------- training
    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood per character and its gradient."""
        kept: dict[str, list] = {"f": [], "b": []}
        e = self._run(x, "f", kept["f"]) + self._run(x, "b", kept["b"]) + self.w["bias"]
        trans = self.w["trans"]
        steps, lanes = x.shape
        lane = np.arange(lanes)

        def logsum(a, axis):
            m = a.max(axis=axis, keepdims=True)
            return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)

        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = e[t] + logsum(alpha[t - 1][:, None, :] + trans[:, :, None], 0)
        for t in range(steps - 2, -1, -1):
            beta[t] = logsum(trans[:, :, None] + (e[t + 1] + beta[t + 1])[None], 1)
        total = logsum(alpha[-1], 0)
        grad_e = np.exp(alpha + beta - total)
        grad_t = np.zeros_like(trans)
        gold = np.zeros(lanes, dtype=np.float32)
        for t in range(steps):
            gold += e[t, y[t], lane]
            grad_e[t, y[t], lane] -= 1
            if t:
                pair = np.exp(alpha[t - 1][:, None, :] + trans[:, :, None] + (e[t] + beta[t])[None] - total)
                grad_t += pair.sum(axis=2)
                gold += trans[y[t - 1], y[t]]
                np.subtract.at(grad_t, (y[t - 1], y[t]), 1)
        scale = np.float32(1 / (steps * lanes))
        grad_e *= scale
        grads = {"trans": grad_t * scale, "bias": grad_e.sum(axis=(0, 2))[:, None]}
        for d in ("f", "b"):
            grads |= self._back(x, d, kept[d], grad_e)
        return float((total - gold).sum() * scale), grads

    def _back(self, x: np.ndarray, d: str, kept: list, grad_e: np.ndarray) -> dict[str, np.ndarray]:
        rec, out, k = self.w["rec" + d], self.w["out" + d], HIDDEN
        g_in, g_rec, g_out = np.zeros_like(self.w["in" + d]), np.zeros_like(rec), np.zeros_like(out)
        dh = np.zeros((k, x.shape[1]), dtype=np.float32)
        dc = np.zeros_like(dh)
        for t, h0, c0, z, gates, cand, c, s in reversed(kept):
            h = gates[2 * k:] * s
            g_out += grad_e[t] @ h.T
            dh += out.T @ grad_e[t]
            dc += dh * gates[2 * k:] / (1 + np.abs(c)) ** 2
            dz = np.concatenate([dc * cand, dc * c0, dh * s, dc * gates[:k] / (1 + np.abs(z[3 * k:])) ** 2])
            dz[:3 * k] *= np.float32(0.25) * ((gates > 0) & (gates < 1))
            dc = dc * gates[k:2 * k]
            g_rec += dz @ h0.T
            hot = np.zeros((CLASSES, x.shape[1]), dtype=np.float32)
            hot[x[t], np.arange(x.shape[1])] = 1
            g_in += dz @ hot.T
            dh = rec.T @ dz
        return {"in" + d: g_in, "rec" + d: g_rec, "out" + d: g_out}

    def fit(self, texts: list[str]) -> Tagger:
        """Adam on windows around labelled spans and on plain windows.

        Each text is taken as it is, labelled by its base spans, and with these
        in written forms that the rules miss.
        """
        r = np.random.RandomState(11)
        xs, ys = [], []
        labelled = [x for t in texts for x in ((t, base_spans(t)), *([disguised(t, r)] * bool(t)), *([disguised(t, r)] * bool(t)))]
        for text, spans in labelled:
            c = classes(text)
            y = np.zeros(len(c), dtype=np.uint8)
            for kind, a, b in spans:
                y[a:b] = 1 + KINDS.index(kind)
            starts = [max(0, a - r.randint(TRAIN_WINDOW // 2 + 1)) for _, a, _ in spans[:8]]
            starts += [r.randint(max(1, len(c) - TRAIN_WINDOW)) for _ in range(2)] if len(c) else []
            for a in starts:
                x = np.zeros(TRAIN_WINDOW, dtype=np.uint8)
                t = np.zeros(TRAIN_WINDOW, dtype=np.uint8)
                part = c[a:a + TRAIN_WINDOW]
                x[:len(part)], t[:len(part)] = part, y[a:a + TRAIN_WINDOW]
                xs.append(x)
                ys.append(t)
        if not xs or not any(t.any() for t in ys):
            return self
        chosen = r.permutation(len(xs))[:MAX_WINDOWS]
        x, y = np.array(xs)[chosen].T, np.array(ys)[chosen].T
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS) + 0.002
            order = r.permutation(x.shape[1])
            for at in range(0, len(order), BATCH):
                part = order[at:at + BATCH]
                _, grads = self.gradient(np.ascontiguousarray(x[:, part]), np.ascontiguousarray(y[:, part]))
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] = (self.w[k] - rate * (first[k] / (1 - 0.9 ** step)) /
                                 (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
        self.trained = True
        return self

    # -------------------------------------------------------------- whole texts
    def label(self, texts: list[str], every: bool = False) -> list[np.ndarray]:
        """Labels of every character, reconciled over the windows of each text.

        Every span that can pass its test holds an ``@`` or a digit.  So windows
        with one are decoded, then, as long as labels reach such an edge, the
        windows beside them; a label elsewhere could not become a span.
        ``every`` decodes all windows.
        """
        coded = [classes(t) for t in texts]
        step = WINDOW - OVERLAP
        counts = np.array([max(1, -(-(len(c) - OVERLAP) // step)) if len(c) else 0 for c in coded], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])
        owner = np.repeat(np.arange(len(texts)), counts)
        begin = (np.arange(first[-1]) - first[owner]) * step
        want = np.ones(first[-1], dtype=bool)
        if not every:
            for i, c in enumerate(coded):
                want[first[i]:first[i + 1]] = False
                marks = np.flatnonzero((c == _AT) | (c == _DIGIT))
                for near in (marks // step, np.maximum(marks - OVERLAP, 0) // step):  # the windows that hold it
                    want[np.minimum(first[i] + near, first[i + 1] - 1)] = True
        done = np.zeros(first[-1], dtype=bool)
        out = [np.zeros(len(c), dtype=np.uint8) for c in coded]
        while len(todo := np.flatnonzero(want & ~done)):
            for at in range(0, len(todo), LANES):
                part = todo[at:at + LANES]
                x = np.zeros((len(part), WINDOW), dtype=np.uint8)
                pieces = [coded[owner[w]][begin[w]:begin[w] + WINDOW] for w in part]
                for row, piece in enumerate(pieces):
                    x[row, :len(piece)] = piece
                labels = self.decode(np.ascontiguousarray(x.T)).T
                for row, w in enumerate(part):
                    # Of two windows the one that has a position farther from its edge gives the label.
                    a, n, i = begin[w], len(pieces[row]), owner[w]
                    low = OVERLAP // 2 if a else 0
                    high = n if w + 1 == first[i + 1] else WINDOW - OVERLAP // 2
                    out[i][a + low:a + high] = labels[row, low:high]
                    if labels[row, low] and a:
                        want[w - 1] = True
                    if labels[row, high - 1] and w + 1 < first[i + 1]:
                        want[w + 1] = True
            done[todo] = True
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Model spans that pass their kind's test."""
        out = []
        for text, labels in zip(texts, self.label(texts), strict=True):
            edge = np.flatnonzero(np.diff(labels, prepend=0, append=0))
            found = []
            for a, b in zip(edge, edge[1:], strict=False):
                if labels[a]:
                    kind = KINDS[labels[a] - 1]
                    s = text[a:b]
                    lead = len(s) - len(s.lstrip(" \n\t,.:;-"))
                    s = s.strip(" \n\t,.:;-")
                    if passes(kind, s):
                        found.append((kind, int(a) + lead, int(a) + lead + len(s)))
            out.append(found)
        return out


def passes(kind: str, s: str) -> bool:
    """The exact test of an added span: read without spaces and other signs between its parts, it is of its kind."""
    if kind == "email":
        plain = _DOT.sub(".", re.sub(r"\s*@\s*", "@", s))
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", plain))
    if kind == "ip":
        plain = _DOT.sub(".", s)
        return bool(re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", plain)) and _octets(plain)
    n = len(_digits(s))
    if kind == "card":
        return 13 <= n <= 19 and luhn(_digits(s)) and bool(re.fullmatch(r"[0-9](?:[ ./-]{0,3}[0-9])+", s))
    return 9 <= n <= 15 and bool(re.fullmatch(r"(?:\+ ?|\()?[0-9](?:[ ()./-]{0,3}[0-9])+", s)) and bool(re.search(r"[ ()./-]", s))


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """(base spans, all spans by kind and start) of each text."""
    out = []
    added = tagger.spans(texts) if tagger.trained else [[] for _ in texts]
    for text, more in zip(texts, added, strict=True):
        base = base_spans(text)
        more = [s for s in more if all(s[2] <= a or s[1] >= b for _, a, b in base)]
        every = sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))
        out.append((base, every))
    return out


def train(docs: DataFrame) -> Tagger:
    """A tagger fitted on the bounded sample."""
    d = id_and_text(docs).where(F.length("text").between(1, SAMPLE_CHARS) & F.col("doc_id").isNotNull())
    marked = F.col("text").rlike(r"@[A-Za-z0-9-]+\.|[0-9]{4}[ -]?[0-9]{4}|\+[0-9]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]")
    narrow = d.select("doc_id", marked.alias("marked"), F.xxhash64("doc_id", F.lit("pii-sample")).alias("key"))
    ids = [r[0] for part, n in (("marked", SAMPLE_DOCS), ("NOT marked", PLAIN_DOCS))
           for r in narrow.where(part).orderBy("key", "doc_id").limit(n).select("doc_id").collect()]
    chosen = d.where(F.col("doc_id").isin(ids)).distinct().orderBy("doc_id", "text").limit(SAMPLE_DOCS + PLAIN_DOCS).collect() if ids else []
    return Tagger().fit([r["text"] for r in chosen])


_RESULT = "base string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS)


def find(text: Column, tagger: Tagger) -> Column:
    """Struct of joined base spans, joined spans and base counts (Arrow batches, no shuffle)."""

    @F.pandas_udf(_RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for batch in batches:
            texts = batch.fillna("").tolist()
            rows = []
            for a, b in blocks(texts):
                for base, every in all_spans(texts[a:b], tagger):
                    rows.append((joined(base), joined(every), *(sum(s[0] == k for s in base) for k in KINDS)))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _RESULT.split(", ")])

    return scan(text)


def personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    tagger = tagger or train(docs)
    found = id_and_text(docs).withColumn("f", find(F.col("text"), tagger))
    return found.select("doc_id", *[f"f.n_{k}" for k in KINDS], F.sha2("f.base", 256).alias("base_sha256"), "f.spans")
