r"""Secret scans: rules plus a character convolutional network.

Base findings are leftmost non-overlapping matches per kind (``assign``,
``access``, ``hex``), dropped where too short.  Every candidate - a run of at
least ``LEAST`` token characters that mixes letters and digits - is scored by a
small convolutional network over the candidate and its surrounding characters,
written in numpy.  A candidate longer than ``INSIDE`` characters is scored in
overlapping stretches of that length and counts by its largest probability.  A
candidate that no base finding touches and whose calibrated
probability reaches the threshold is added as kind ``cnn``; base findings stay.

The network is trained here, on ``TRAINING`` labelled findings made from the
fixed rules in ``labelled_findings`` (random secrets in key, header and
configuration contexts against identifiers, paths, dates, addresses and plain
words).  A second part calibrates its output by a logistic curve, and a third
sets the threshold: the largest one that still recalls ``RECALL`` of the
secrets, at most ``MOST_PROBABILITY``.

Defined results: a null text is empty and has no findings; positions are code
points with exclusive ends; repeated rows are scanned each; further columns are
ignored; an empty table has no findings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches
from .words import filled, text_slices

TRAINING = 4_000
RECALL = 0.97
MOST_PROBABILITY = 0.99
#: Least length of a candidate.
LEAST = 16
#: Characters before, of, and after the candidate that the network sees.
BEFORE, INSIDE, AFTER = 24, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
#: Distance of the stretches of a long candidate: each run of INSIDE - STEP characters lies whole in one.
STEP = 10
KINDS = ("assign", "access", "hex", "cnn")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: Supersets of the patterns above that a linear-time matcher runs over whole slices first.
_MAYBE = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]",
    "hex": r"[0-9a-f]{24}",
    "cnn": r"[A-Za-z0-9+/_=-]{%d}" % LEAST,
}

Span = tuple[int, int, str]


def base_findings(text: str, kinds: tuple[str, ...] = KINDS) -> list[Span]:
    out: list[Span] = []
    if "assign" in kinds:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "access" in kinds:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if "hex" in kinds:
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]


def stretches(start: int, end: int) -> list[tuple[int, int]]:
    """What the network sees of a candidate, one after another: all of it from its start, then each ``INSIDE`` characters of a long one."""
    last = end - INSIDE
    return [(start, end), *((at, at + INSIDE) for at in range(start + STEP, last, STEP)), *([(last, end)] if last > start else [])]


# --- the network ---------------------------------------------------------------

_CLASSES = 9


def _classes() -> np.ndarray:
    """Character class of each code below 128; others are class 8, class 0 is padding."""
    table = np.full(129, 8, np.int64)
    for c in range(128):
        x = chr(c)
        table[c] = 1 if x.islower() else 2 if x.isupper() else 3 if x.isdigit() else 4 if x in "+/=_-" else 5 if x in ":=\"'`" else 6 if x.isspace() else 7
    table[ord("=")] = 4
    return table


_TABLE = _classes()
_VOWEL = np.array([chr(c).lower() in "aeiou" if c < 128 else False for c in range(129)])
_HEXA = np.array([chr(c) in "0123456789abcdef" if c < 128 else False for c in range(129)])
CHANNELS = _CLASSES + 4


def encoded(text: str, start: int, end: int) -> np.ndarray:
    """The window of a candidate as WIDTH x CHANNELS: one-hot class, vowel, hexadecimal, inside flag, change of class."""
    inner = text[start : min(end, start + INSIDE)]
    left, right = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    x = np.zeros((WIDTH, CHANNELS), np.float32)
    for at, part, flag in ((BEFORE - len(left), left, 0.0), (BEFORE, inner, 1.0), (BEFORE + INSIDE, right, 0.0)):
        if part:
            codes = np.minimum(np.array([ord(c) for c in part]), 128)
            rows = np.arange(at, at + len(part))
            x[rows, _TABLE[codes]] = 1
            x[rows, _CLASSES] = _VOWEL[codes]
            x[rows, _CLASSES + 1] = _HEXA[codes]
            x[rows, _CLASSES + 2] = flag
            x[rows[1:], _CLASSES + 3] = _TABLE[codes][1:] != _TABLE[codes][:-1]
    return x


FILTERS, KERNEL, HIDDEN = 16, 5, 16


@dataclass
class Network:
    conv: np.ndarray
    conv_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def forward(self, x: np.ndarray) -> dict[str, np.ndarray]:
        wins = np.lib.stride_tricks.sliding_window_view(x, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - KERNEL + 1, -1)
        a = np.maximum(wins @ self.conv + self.conv_bias, 0)
        top = a.argmax(axis=1)
        core = a[:, BEFORE : BEFORE + INSIDE - KERNEL + 1]
        pooled = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], core.mean(axis=1)], axis=1)
        h = np.maximum(pooled @ self.hidden + self.hidden_bias, 0)
        return {"wins": wins, "a": a, "top": top, "pooled": pooled, "h": h, "logit": (h @ self.out)[:, 0] + self.out_bias[0]}

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 512])["logit"] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * self.logits(x) + self.curve[1], -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 5, batch: int = 64, rate: float = 4e-3) -> Network:
    """Adam on the logistic loss, gradients by hand."""
    start = lambda scale, *shape: (scale * rng.standard_normal(shape)).astype(np.float32)
    net = Network(
        start(0.15, KERNEL * CHANNELS, FILTERS), start(0, FILTERS), start(0.2, 2 * FILTERS, HIDDEN), start(0, HIDDEN), start(0.3, HIDDEN, 1), start(0, 1)
    )
    names = ("conv", "conv_bias", "hidden", "hidden_bias", "out", "out_bias")
    state = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            pick = order[i : i + batch]
            f = net.forward(x[pick])
            n = len(pick)
            g = ((1 / (1 + np.exp(-f["logit"])) - y[pick]) / n)[:, None]
            grads = {"out": f["h"].T @ g, "out_bias": g.sum(0)}
            gh = (g @ net.out.T) * (f["h"] > 0)
            grads |= {"hidden": f["pooled"].T @ gh, "hidden_bias": gh.sum(0)}
            gp = gh @ net.hidden.T
            ga = np.zeros_like(f["a"])
            np.put_along_axis(ga, f["top"][:, None], gp[:, None, :FILTERS], 1)
            span = INSIDE - KERNEL + 1
            ga[:, BEFORE : BEFORE + span] += gp[:, None, FILTERS:] / span
            ga *= f["a"] > 0
            grads |= {"conv": f["wins"].reshape(-1, KERNEL * CHANNELS).T @ ga.reshape(-1, FILTERS), "conv_bias": ga.sum((0, 1))}
            step += 1
            for k in names:
                m, v = state[k]
                m += 0.1 * (grads[k] - m)
                v += 0.001 * (grads[k] ** 2 - v)
                getattr(net, k).__isub__(rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    return net


def labelled_findings(n: int, rng: np.random.Generator) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of ``n`` made findings, half of them secrets."""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllables = [c + v for c in "bcdfglmnprstvwz" for v in "aeiou"] + ["th", "er", "ing", "tion", "en", "ou"]
    draw = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    word = lambda: "".join(syllables[i] for i in rng.integers(0, len(syllables), rng.integers(1, 4)))
    size = lambda lo, hi: int(rng.integers(lo, hi))
    secrets = [
        lambda: draw(lower + upper + digits, size(20, 48)),
        lambda: draw(lower + upper + digits + "+/", size(24, 64)) + "=" * size(0, 3),
        lambda: draw(digits + "abcdef", size(20, 64)),
        lambda: draw(digits + "ABCDEF", size(24, 64)),
        lambda: "AKIA" + draw(upper + digits, 16),
        lambda: ["ghp_", "sk-", "sk_live_", "xoxb-", "glpat-"][size(0, 5)] + draw(lower + upper + digits, size(20, 40)),
        lambda: draw(lower + digits, size(20, 40)),
        lambda: draw(lower + upper + digits + "_-", size(22, 44)),
    ]
    plain = [
        lambda: "_".join(word() for _ in range(size(2, 5))) + draw(digits, size(1, 4)),
        lambda: "/".join(word() for _ in range(size(3, 6))) + "/" + draw(digits, size(1, 5)),
        lambda: f"{size(1990, 2030)}-{size(10, 13)}-{size(10, 29)}T{size(10, 24)}-{size(10, 60)}-{size(10, 60)}",
        lambda: "-".join(word() for _ in range(size(3, 6))) + "-" + draw(digits, size(1, 5)),
        lambda: "".join(word().title() for _ in range(size(3, 7))) + draw(digits, size(1, 3)),
        lambda: word() + "=" + draw(digits, size(8, 16)),
        lambda: "v" + "-".join(draw(digits, size(1, 3)) for _ in range(4)) + "-" + word() + word(),
        lambda: "-".join([draw(digits, 4)] * size(4, 6)) + "x",
        lambda: "".join(word() for _ in range(size(5, 9))) + draw(digits, size(1, 3)),
        lambda: "=" * size(12, 30) + word() + draw(digits, 1),
    ]
    keyed = ["key: ", "auth=", "Bearer ", "credentials = '", 'secret_key="', "export TOKEN=", "private_key: ", "x-api-key: ", "pass: ", "with ", "use "]
    loose = ["see ", "in ", "file ", "at https://", "of the ", "version ", "id ", "page ", "from ", "and ", "path: ", "key "]
    out = []
    for i in range(n):
        label = i % 2
        body = (secrets[size(0, len(secrets))] if label else plain[size(0, len(plain))])()
        heads = keyed if (rng.random() < 0.6) == bool(label) else loose
        left = " ".join(word() for _ in range(size(0, 5))) + " " + heads[size(0, len(heads))]
        text = left + body + ["", " ", ".", "'", "\n", ", "][size(0, 6)] + word()
        out.append((text, len(left), len(left) + len(body), label))
    return out


@lru_cache(maxsize=2)
def trained(seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    rows = labelled_findings(TRAINING, rng)
    x, y = np.stack([encoded(t, a, b) for t, a, b, _ in rows]), np.array([r[3] for r in rows], np.float32)
    fit, tune = int(0.6 * len(x)), int(0.8 * len(x))
    net = _fit(x[:fit], y[:fit], rng)
    z, t = net.logits(x[fit:tune]).astype(float), y[fit:tune].astype(float)
    w = np.array([1.0, 0.0])
    for _ in range(50):  # logistic calibration by Newton's method
        p = 1 / (1 + np.exp(-np.clip(w[0] * z + w[1], -30, 30)))
        g = np.array([((t - p) * z).sum() - 0.05 * (w[0] - 1), (t - p).sum()])
        s = p * (1 - p)
        h = np.array([[(s * z * z).sum() + 0.05, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        w += np.linalg.solve(h, g)
    net.curve = (float(w[0]), float(w[1]))
    found = np.sort(net.probabilities(x[tune:])[y[tune:] == 1])
    net.threshold = min(MOST_PROBABILITY, float(found[int((1 - RECALL) * len(found))]))
    return net


# --- scanning ------------------------------------------------------------------


def spans_of(texts: pa.Array, net: Network) -> list[list[Span]]:
    """All findings of each text in order of start, then kind."""
    texts = filled(texts)
    maybe = {kind: pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False) for kind, pattern in _MAYBE.items()}
    found: list[list[Span]] = [[] for _ in range(len(texts))]
    windows, places = [], []
    for i in np.flatnonzero(np.any(list(maybe.values()), axis=0)).tolist():
        text = texts[i].as_py()
        base = base_findings(text, tuple(k for k in KINDS if maybe[k][i]))
        found[i] = base
        if maybe["cnn"][i]:
            for a, b in candidates(text):
                if any(a < e and s < b for s, e, _ in base):
                    continue
                for x, y in stretches(a, b):
                    windows.append(encoded(text, x, y))
                    places.append((i, a, b))
                    if len(windows) >= 4096:
                        _judge(windows, places, found, net)
    _judge(windows, places, found, net)
    return [sorted(s, key=lambda x: (x[0], KINDS.index(x[2]))) for s in found]


def _judge(windows: list[np.ndarray], places: list[tuple[int, int, int]], found: list[list[Span]], net: Network) -> None:
    if windows:
        for (i, a, b), p in zip(places, net.probabilities(np.stack(windows)), strict=True):
            # The stretches of a candidate follow each other.
            if p >= net.threshold and found[i][-1:] != [(a, b, "cnn")]:
                found[i].append((a, b, "cnn"))
    windows.clear()
    places.clear()


def _written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_cnn of every document."""
    small_batches(docs.sparkSession)
    net = trained()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = spans_of(batch.column("text"), net)
            base = [[s for s in r if s[2] != "cnn"] for r in rows]
            count = lambda kind: pa.array([sum(s[2] == kind for s in r) for r in rows], pa.int64())
            digest = [hashlib.sha256(_written(b).encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), count("assign"), count("access"), count("hex"), pa.array(digest, pa.string()), pa.array([_written(r) for r in rows], pa.string()), count("cnn")],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long")


MASK = "[SECRET]"


def masked(text: str, spans: list[Span]) -> str:
    """The text with each maximal run of overlapping findings replaced by ``MASK``."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with their findings masked and ``n_chars`` brought up to date where they changed."""
    small_batches(docs.sparkSession)
    net, names = trained(), docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = spans_of(batch.column("text"), net)
            if not any(rows):
                yield batch
                continue
            texts = [masked(t, r) if r else t for t, r in zip(batch.column("text").to_pylist(), rows, strict=True)]
            columns = {n: batch.column(n) for n in names}
            columns["text"] = pa.array(texts, batch.column("text").type)
            if "n_chars" in columns:
                changed = pa.array([len(t) if r else None for t, r in zip(texts, rows, strict=True)], columns["n_chars"].type)
                columns["n_chars"] = pc.coalesce(changed, columns["n_chars"])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(scan, docs.schema).select(*(F.col(n) for n in names))
