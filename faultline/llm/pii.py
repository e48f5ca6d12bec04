"""Personal data: patterns, and a bidirectional character LSTM with CRF transitions.

The patterns give the base spans (email, ip, card, phone), leftmost and
non-overlapping for each kind; a match that fails its check is dropped.  The tagger
finds what the patterns lose, such as a phone number that runs into a card number.

*Training.*  Labelled spans come from the corpus itself: base spans that stand alone
and the words around them, from about ``SAMPLE_DOCS`` documents with a digit (twice that at most), drawn
by a hash of the row.  Training sequences set such spans among words and beside each
other.  The network is numpy only and learns by Adam with a fixed seed.

*Decoding.*  Windows of ``WINDOW`` characters every ``STRIDE`` cover the text.  Every
span holds a digit or an at-sign, so windows without either cannot give one and are
not run; nothing is lost by that.  Each window is decoded by Viterbi.  The spans of all
windows of a text are reconciled together: a span must satisfy its kind's pattern and
check and must not be part of a longer run of its characters; of overlapping ones the
longest stays, then the one more windows found, then the leftmost.  Base spans always
stay, and added spans never overlap them.

Null text is empty.  Texts without a digit or at-sign are done at once.  A corpus
without labelled spans trains no tagger and has base spans only.  Repeated rows repeat;
an empty table gives an empty result; only doc_id and text are read.
"""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from faultline.llm.base import drawn, own_prefix, text_columns

KINDS = ["email", "ip", "card", "phone"]
SAMPLE_DOCS = 600
WINDOW, STRIDE = 64, 32
HIDDEN = 20
STEPS = 160
BATCH = 96
RATE = 0.02
#: Windows run through the network together.
RUN = 2048

IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ANCHOR = re.compile("[0-9@]")
DIGITS = "0123456789"


def _digits(text):
    return [int(c) for c in text if c in DIGITS]


def luhn(digits):
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def _good_ip(text):
    return all(int(part.lstrip("0")[:4] or 0) <= 255 for part in text.split("."))


def _good_card(text):
    digits = _digits(text)
    return 16 <= len(digits) <= 19 and luhn(digits)


def _good_phone(text):
    return 8 <= len(_digits(text)) <= 15


def _emails(text):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = EMAIL_TAIL.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def _matches(pattern, good, text):
    return [m.span() for m in pattern.finditer(text) if good(m.group())]


def has_anchor(text):
    return "@" in text or any(digit in text for digit in DIGITS)


def base_spans(text):
    """(kind, start, end) of the patterns, by kind as listed, then start."""
    if not has_anchor(text):
        return []
    found = [("email", *span) for span in _emails(text)]
    for kind, pattern, good in (
        ("ip", IP, _good_ip),
        ("card", CARD, _good_card),
        ("phone", PHONE, _good_phone),
    ):
        found += [(kind, *span) for span in _matches(pattern, good, text)]
    return found


def _whole(kind, text, start, end):
    """Whether a found span is that kind of datum and not part of a longer run."""
    part, before, after = text[start:end], text[start - 1 : start], text[end : end + 1]
    if kind == "email":
        spans = list(_emails(part))
        return spans == [(0, len(part))] and before not in LOCAL and not after.isalnum()
    if before.isdigit() or after.isdigit():
        return False
    pattern, good = {"ip": (IP, _good_ip), "card": (CARD, _good_card), "phone": (PHONE, _good_phone)}[kind]
    return bool(pattern.fullmatch(part)) and good(part)


# --- the tagger -------------------------------------------------------------------

LABELS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
ALPHABET = 100


def codes(text):
    """Small integers for characters: printable ASCII by itself, all else by class."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.where((points >= 32) & (points < 127), points - 31, 97)
    out[(points == 10) | (points == 9) | (points == 13)] = 98
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """A bidirectional LSTM over characters with CRF transitions between labels."""

    def __init__(self, seed=7, hidden=HIDDEN):
        draw = np.random.default_rng(seed)
        self.hidden = hidden
        scale = lambda *shape: draw.normal(0, 0.15, shape).astype(np.float32)
        self.weights = {"out": scale(2 * hidden, LABELS), "bias": np.zeros(LABELS, np.float32)}
        self.weights["step"] = np.zeros((LABELS, LABELS), np.float32)
        for way in "fb":
            self.weights[f"x{way}"] = scale(ALPHABET, 4 * hidden)
            self.weights[f"h{way}"] = scale(hidden, 4 * hidden)
            self.weights[f"c{way}"] = np.zeros(4 * hidden, np.float32)
            self.weights[f"c{way}"][hidden : 2 * hidden] = 1

    def _lstm(self, text, way, keep):
        """States over time of one direction; ``text`` is (time, batch)."""
        w, u, c0 = (self.weights[f"{n}{way}"] for n in "xhc")
        n, size = text.shape[1], self.hidden
        h = cell = np.zeros((n, size), np.float32)
        states, trace = np.zeros((len(text), n, size), np.float32), []
        for t in range(len(text)):
            z = w[text[t]] + h @ u + c0
            gates = _sigmoid(z[:, : 3 * size])
            i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
            g = np.tanh(z[:, 3 * size :])
            before, old = cell, h
            cell = f * before + i * g
            tall = np.tanh(cell)
            h = states[t] = o * tall
            if keep:
                trace.append((i, f, o, g, before, tall, old))
        return states, trace

    def _lstm_back(self, text, way, trace, d_states):
        u = self.weights[f"h{way}"]
        grad = {f"{n}{way}": np.zeros_like(self.weights[f"{n}{way}"]) for n in "xhc"}
        dh = np.zeros_like(d_states[0])
        dc = np.zeros_like(dh)
        for t in range(len(text) - 1, -1, -1):
            i, f, o, g, before, tall, old = trace[t]
            dh = dh + d_states[t]
            dc = dc + dh * o * (1 - tall**2)
            dz = np.concatenate(
                [dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tall * o * (1 - o), dc * i * (1 - g**2)],
                axis=1,
            )
            np.add.at(grad[f"x{way}"], text[t], dz)
            grad[f"h{way}"] += old.T @ dz
            grad[f"c{way}"] += dz.sum(0)
            dh, dc = dz @ u.T, dc * f
        return grad

    def emissions(self, text, keep=False):
        """Label scores (time, batch, label) of texts given as (batch, time)."""
        ahead = np.ascontiguousarray(text.T)
        f, trace_f = self._lstm(ahead, "f", keep)
        b, trace_b = self._lstm(ahead[::-1], "b", keep)
        both = np.concatenate([f, b[::-1]], axis=2)
        return both @ self.weights["out"] + self.weights["bias"], (ahead, both, trace_f, trace_b)

    @staticmethod
    def _sum(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

    def gradient(self, text, labels):
        """Mean negative log-likelihood of label sequences and its gradient."""
        scores, (ahead, both, trace_f, trace_b) = self.emissions(text, keep=True)
        step, gold = self.weights["step"], labels.T
        time, n, _ = scores.shape
        alpha = [scores[0]]
        for t in range(1, time):
            alpha.append(self._sum(alpha[-1][:, :, None] + step, 1) + scores[t])
        beta = [np.zeros_like(scores[0])]
        for t in range(time - 1, 0, -1):
            beta.append(self._sum(step + (scores[t] + beta[-1])[:, None, :], 2))
        beta = beta[::-1]
        norm = self._sum(alpha[-1], 1)
        d_scores, d_step = np.zeros_like(scores), np.zeros_like(step)
        rows = np.arange(n)
        for t in range(time):
            d_scores[t] = np.exp(alpha[t] + beta[t] - norm[:, None])
            d_scores[t][rows, gold[t]] -= 1
            if t:
                pair = alpha[t - 1][:, :, None] + step + (scores[t] + beta[t])[:, None, :]
                d_step += np.exp(pair - norm[:, None, None]).sum(0)
                np.add.at(d_step, (gold[t - 1], gold[t]), -1)
        path = scores[np.arange(time)[:, None], rows, gold].sum(0)
        path = path + step[gold[:-1], gold[1:]].sum(0)
        d_scores /= n
        grad = {"step": d_step / n, "bias": d_scores.sum((0, 1))}
        grad["out"] = np.tensordot(both, d_scores, ([0, 1], [0, 1]))
        d_both = d_scores @ self.weights["out"].T
        grad |= self._lstm_back(ahead, "f", trace_f, d_both[:, :, : self.hidden])
        grad |= self._lstm_back(ahead[::-1], "b", trace_b, d_both[::-1, :, self.hidden :])
        return float((norm - path).mean()), grad

    def decode(self, text):
        """The best label sequence of each window: (batch, time)."""
        scores, _ = self.emissions(text)
        step, best, back = self.weights["step"], scores[0], []
        for t in range(1, len(scores)):
            ways = best[:, :, None] + step
            back.append(ways.argmax(1))
            best = ways.max(1) + scores[t]
        labels = [best.argmax(1)]
        for pointers in reversed(back):
            labels.append(pointers[np.arange(len(pointers)), labels[-1]])
        return np.array(labels[::-1]).T

    def fit(self, draw_batch, steps=STEPS, rate=RATE):
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        losses = []
        for at in range(1, steps + 1):
            loss, grad = self.gradient(*draw_batch())
            losses.append(loss)
            size = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / max(size, 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g**2
                move = mean[k] / (1 - 0.9**at) / (np.sqrt(square[k] / (1 - 0.99**at)) + 1e-8)
                self.weights[k] = (self.weights[k] - rate * (1 - at / (steps + 1)) * move).astype(np.float32)
        return losses


def _sample_texts(texts):
    """From each text its spans that stand alone, and words near them."""
    out = [[], []]
    for text in texts:
        spans = base_spans(text)
        kinds, words = [], []
        for kind, start, end in spans:
            alone = not any(s < end + 2 and start - 2 < e for k, s, e in spans if (k, s, e) != (kind, start, end))
            if alone and end - start < WINDOW - 8:
                kinds.append(f"{kind} {text[start:end]}")
        for kind, start, end in spans[:4]:
            words += ANCHOR.sub("", text[max(0, start - 60) : start]).split()[1:]
            words += ANCHOR.sub("", text[end : end + 60]).split()[:-1]
            words += [w for w in text[max(0, start - 200) : end + 200].split() if ANCHOR.search(w) and not any(text[s:e] in w or w in text[s:e] for _, s, e in spans)]
        out[0].append("\t".join(kinds))
        out[1].append("\t".join(words[:80]))
    return out


def _sequence(draw, spans, words):
    """One training window: words with spans among them or side by side."""
    text, labels = "", []
    while len(text) < WINDOW + 24:
        if draw.random() < 0.4:
            kind = KINDS[draw.integers(len(KINDS))]
            if not spans[kind]:
                continue
            piece = spans[kind][draw.integers(len(spans[kind]))]
            tag = 1 + 2 * KINDS.index(kind)
            marks = [tag] + [tag + 1] * (len(piece) - 1)
        else:
            piece = words[draw.integers(len(words))]
            marks = [0] * len(piece)
        gap = " " if draw.random() < 0.95 else "\n"
        text, labels = text + piece + gap, labels + marks + [0]
    at = draw.integers(0, 24)
    return codes(text[at : at + WINDOW]), labels[at : at + WINDOW]


def train(docs, sample_docs=SAMPLE_DOCS, steps=STEPS, seed=7):
    """A tagger learnt from a bounded sample of the documents, or None without spans."""
    texts = docs.filter("text RLIKE '[0-9]'").select("doc_id", "text")
    sample = drawn(texts, sample_docs, "doc_id", "text")
    rows = text_columns(sample, {"spans": "string", "words": "string"}, _sample_texts).collect()
    rows.sort(key=lambda row: (row["spans"], row["words"]))
    spans = {kind: [] for kind in KINDS}
    for row in rows:
        for item in filter(None, row["spans"].split("\t")):
            kind, _, piece = item.partition(" ")
            spans[kind].append(piece)
    words = [word for row in rows for word in row["words"].split("\t") if word]
    if not any(spans.values()) or not words:
        return None
    draw = np.random.default_rng(seed)
    tagger = Tagger(seed)

    def batch():
        pairs = [_sequence(draw, spans, words) for _ in range(BATCH)]
        return np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])

    tagger.fit(batch, steps)
    return tagger


def windows(length):
    """Starts of the overlapping windows over a text."""
    return range(0, max(1, length - WINDOW + STRIDE), STRIDE)


def _label_spans(labels, start, length):
    """Spans of one window's labels, in text positions."""
    end = min(WINDOW, length - start)
    at = 0
    while at < end:
        label = labels[at]
        if label == 0:
            at += 1
            continue
        kind, stop = (label - 1) // 2, at + 1
        while stop < end and labels[stop] == 2 * kind + 2:
            stop += 1
        yield KINDS[kind], start + at, start + stop
        at = stop


def reconcile(text, votes, base):
    """The added spans of a text from all its windows' spans with their votes."""
    taken = [(s, e) for _, s, e in base]
    added = []
    good = [(k, s, e) for k, s, e in votes if _whole(k, text, s, e)]
    for kind, s, e in sorted(good, key=lambda x: (x[1] - x[2], -votes[x], x[1], x[0])):
        if not any(s < b and a < e for a, b in taken):
            taken.append((s, e))
            added.append((kind, s, e))
    return added


def added_spans(texts, tagger, every_window=False):
    """For each text the spans that the tagger adds to its base spans."""
    jobs, chars = [], []
    for at, text in enumerate(texts):
        if not has_anchor(text):
            continue
        coded = np.pad(codes(text), (0, WINDOW))
        starts = {
            start
            for found in ANCHOR.finditer(text)
            for start in range(max(0, found.start() // STRIDE - WINDOW // STRIDE + 1) * STRIDE, found.start() + 1, STRIDE)
        }
        last = windows(len(text))[-1]
        for start in windows(len(text)) if every_window else sorted(s for s in starts if s <= last):
            jobs.append((at, start))
            chars.append(coded[start : start + WINDOW])
    votes = {}
    for first in range(0, len(jobs), RUN):
        labels = tagger.decode(np.array(chars[first : first + RUN]))
        for (at, start), row in zip(jobs[first : first + RUN], labels.tolist(), strict=True):
            for span in _label_spans(row, start, len(texts[at])):
                if ANCHOR.search(texts[at], span[1], span[2]):
                    seen = votes.setdefault(at, {})
                    seen[span] = seen.get(span, 0) + 1
    return votes


def find_spans(texts, tagger):
    """Base and added spans (kind, start, end) of each text."""
    votes = added_spans(texts, tagger) if tagger else {}
    found = []
    for at, text in enumerate(texts):
        base = base_spans(text)
        found.append((base, reconcile(text, votes.get(at, {}), base)))
    return found


def _join(spans):
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _order(span):
    return KINDS.index(span[0]), span[1], span[2]


SPAN_COLUMNS = {
    **{f"n_{kind}": "long" for kind in KINDS},
    "base_sha256": "string",
    "spans": "string",
    "n_added": "long",
}


def spans(docs, tagger):
    """The other columns of ``docs`` with SPAN_COLUMNS instead of text.

    The counts are of base spans; ``spans`` holds all of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def find(texts):
        texts = [text or "" for text in texts]
        rows = []
        for base, added in find_spans(texts, shared.value):
            counts = [sum(kind == k for k, _, _ in base) for kind in KINDS]
            digest = hashlib.sha256(_join(base).encode()).hexdigest()
            rows.append((*counts, digest, _join(sorted(base + added, key=_order)), len(added)))
        return list(zip(*rows, strict=True)) or [[] for _ in SPAN_COLUMNS]

    return text_columns(docs, SPAN_COLUMNS, find)


def mask(text, found):
    """The text with every span replaced by its kind in brackets; overlaps become one."""
    out, end, pieces = [], 0, sorted((s, e, kind) for kind, s, e in found)
    for start, stop, kind in pieces:
        if start >= end:
            out += [text[end:start], f"[{kind.upper()}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def redact(docs, tagger):
    """The same rows with personal data masked; ``n_chars``, if there, follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def masked(texts):
        found = find_spans([text or "" for text in texts], shared.value)
        return [
            [None if t is None else mask(t, base + added) for t, (base, added) in zip(texts, found, strict=True)]
        ]

    name = f"{own_prefix(docs)}masked"
    out = text_columns(docs, {name: "string"}, masked).withColumnRenamed(name, "text")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return out.select(*docs.columns)
