"""Personal data: rule spans and a character-level BiLSTM with CRF transitions.

Base spans (leftmost, non-overlapping per kind, no retries): email, ip (parts at
most 255), card (14 to 19 digits that pass Luhn), phone (+ and 10 to 15 digits).

The model reads characters, two LSTMs run over a window from both sides, and a
linear-chain CRF over O / B-kind / I-kind scores the tags. It is trained in numpy
by gradient descent on the CRF likelihood from labelled spans: windows of at most
``TRAIN_WINDOWS`` rows with their base spans, and spans of the same kinds written
in other layouts into such windows. A text is cut into windows of WINDOW
characters every STRIDE; each is decoded by Viterbi, and the spans of all windows
are reconciled over the whole text: a span that a window's edge may cut is taken
from the window that holds it whole or, if it is longer than the windows overlap, put
together from its parts, and the heaviest set of spans that do not
overlap is chosen (weighted interval scheduling, weight: the Viterbi score over
that of the same characters outside any span). Every kind is made of digits or
an at sign, so a decoded span without either is dropped; a window that holds
neither can yield no span and is not run, which changes no result.

Model spans are added where they overlap no base span, pass the kind's exact
check (digit counts, Luhn, parts, an at sign) and are no plain failing match.
Null text counts as empty; positions are code points, ends exclusive. A very long
text is as many windows, run in groups; of equally heavy sets the earlier in order wins;
repeated rows get equal results, an empty table an empty one (the model then rests on
made-up windows). The column functions add one column, so others may have any name.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from triageflow.llm import bilstm
from triageflow.llm.common import bound_batches, struct_udf

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 128, 48
HIDDEN = 20
CHARS = 130
TAGS = 1 + 2 * len(KINDS)
TRAIN_WINDOWS = 400
STEPS, BATCH = 300, 40
RUN_ROWS = 512

_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else (2 * v if v < 5 else 2 * v - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """Same matches as the plain pattern, in linear time: a match has one at
    sign, with the run of local characters before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the rules, by start, then kind as listed."""
    if not text or not _TRIGGER.search(text):
        return []
    out = [(s, 0, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


# ---------------------------------------------------------------- the model

def char_ids(text: str) -> np.ndarray:
    """0: control; ASCII as is; 128: other letters and signs; 129 is padding."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(codes < 32, 0, np.minimum(codes, 128)).astype(np.int16)


def tags_of(length: int, spans) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for k, s, e in spans:
        i = KINDS.index(k)
        tags[s:e] = 2 + 2 * i
        tags[s] = 1 + 2 * i
    return tags


def _allowed() -> np.ndarray:
    """-inf where a tag may not follow another: I-kind needs B- or I-kind before."""
    a = np.zeros((TAGS, TAGS), np.float32)
    for i in range(len(KINDS)):
        inside = 2 + 2 * i
        a[:, inside] = -1e4
        a[[inside - 1, inside], inside] = 0
    return a


ALLOWED = _allowed()
START = np.where((np.arange(TAGS) % 2 == 0) & (np.arange(TAGS) > 0), -1e4, 0).astype(np.float32)


def emissions(p: dict, ids: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """(T, B, TAGS) scores of the tags; ids and mask are (T, B)."""
    a, b = ([], []) if keep is not None else (None, None)
    fw = bilstm.run(p["xf"][ids], p["hf"], mask, a)
    bw = bilstm.run(p["xb"][ids[::-1]], p["hb"], mask[::-1], b)[::-1]
    both = np.concatenate([fw, bw], 2)
    if keep is not None:
        keep.update(a=a, b=b, both=both)
    return both @ p["o"] + p["c"]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def crf_gradient(e: np.ndarray, tags: np.ndarray, mask: np.ndarray, trans: np.ndarray):
    """Mean negative log likelihood and its gradients by emission and transition."""
    steps, rows, k = e.shape
    t2 = trans + ALLOWED
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[0] = e[0] + START
    for t in range(1, steps):
        new = e[t] + _lse(alpha[t - 1][:, :, None] + t2, 1)
        alpha[t] = np.where(mask[t][:, None] > 0, new, alpha[t - 1])
    z = _lse(alpha[-1], 1)
    for t in range(steps - 2, -1, -1):
        new = _lse((beta[t + 1] + e[t + 1])[:, None, :] + t2, 2)
        beta[t] = np.where(mask[t + 1][:, None] > 0, new, beta[t + 1])
    de = np.exp(alpha + beta - z[None, :, None]) * mask[:, :, None]
    dt = np.zeros_like(trans)
    row = np.arange(rows)
    gold = e[0, row, tags[0]].copy()
    de[0, row, tags[0]] -= mask[0]
    for t in range(1, steps):
        pair = np.exp(alpha[t - 1][:, :, None] + t2 + (e[t] + beta[t])[:, None, :] - z[:, None, None]) * mask[t][:, None, None]
        dt += pair.sum(0)
        np.add.at(dt, (tags[t - 1], tags[t]), -mask[t])
        gold += mask[t] * (e[t, row, tags[t]] + t2[tags[t - 1], tags[t]])
        de[t, row, tags[t]] -= mask[t]
    return float((z - gold).mean()), de / rows, dt / rows


def viterbi(e: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (T, B)."""
    steps, rows, _ = e.shape
    t2, score = trans + ALLOWED, e[0] + START
    back = np.zeros(e.shape, np.int8)
    for t in range(1, steps):
        options = score[:, :, None] + t2
        back[t] = options.argmax(1)
        m = mask[t][:, None] > 0
        score = np.where(m, options.max(1) + e[t], score)
        back[t] = np.where(m, back[t], np.arange(e.shape[2]))
    tags, row = np.zeros((steps, rows), np.int64), np.arange(rows)
    tags[-1] = score.argmax(1)
    for t in range(steps - 1, 0, -1):
        tags[t - 1] = back[t, row, tags[t]]
    return tags


def _pad(windows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, windows))
    ids = np.full((steps, len(windows)), CHARS - 1, np.int16)
    mask = np.zeros((steps, len(windows)), np.float32)
    for b, w in enumerate(windows):
        ids[:len(w), b] = char_ids(w)
        mask[:len(w), b] = 1
    return ids, mask


def layouts(rng: np.random.Generator) -> tuple[str, str | None]:
    """A made-up piece of text and its kind (None: looks alike, is none)."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    w = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9)))
    pick = rng.integers(-1, 12)
    if pick < 2:
        at = rng.choice(["@", " @ "])
        many = int(rng.integers(2, 5)) if rng.random() < 0.3 else 1  # some are long
        local, host = "".join(w() + rng.choice([".", "_", "-"]) for _ in range(many - 1)), "".join(w() + rng.choice([".", "-"]) for _ in range(many - 1))
        return f"{local}{w()}{rng.choice(['.', '_', '-', ''])}{d(rng.integers(0, 3))}{at}{host}{w()}.{rng.choice(['com', 'org', 'net', 'example.com', 'co.uk'])}", "email"
    if pick < 4:
        return rng.choice([".", ".", " . "]).join(str(x) for x in rng.integers(0, 256, 4)), "ip"
    if pick < 6:
        n = d(15)
        n += next(c for c in "0123456789" if luhn(n + c))
        sep = rng.choice(["", " ", "-", "."])
        return sep.join(n[i:i + 4] for i in range(0, 16, 4)), "card"
    if pick < 8:
        a, b, c = d(3), d(3), d(4)
        return str(rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+49 {a} {b}{c}", f"({a}) {b} {c}", f"+1-{a}-{b}-{c}"])), "phone"
    h = "".join(rng.choice(list("0123456789abcdef"), 18))
    return str(rng.choice([f"version {d(1)}.{d(1)}", d(4), f"{d(4)}-{d(2)}-{d(2)}", f"password={h}", f'token = "{h}{h}"',
                           f"AKIA{w().upper()}{d(2)}{w().upper()}", f"{d(2)}:{d(2)}", f"{d(3)},{d(3)}", d(9), "4.0", f"{d(3)}.{d(1)}%"])), None


def train(windows: list[str], seed: int = 7, steps: int = STEPS) -> dict:
    """Fit on windows of text, labelled by their base spans, with the spans of
    other layouts written into half of them at a random place."""
    rng = np.random.default_rng(seed)
    windows = sorted(set(w for w in windows if w)) or ["lorem ipsum dolor sit amet, consectetur adipiscing elit sed do"]
    p = {"xf": bilstm.start(rng, CHARS, 4 * HIDDEN) * 4, "hf": bilstm.start(rng, HIDDEN, 4 * HIDDEN),
         "xb": bilstm.start(rng, CHARS, 4 * HIDDEN) * 4, "hb": bilstm.start(rng, HIDDEN, 4 * HIDDEN),
         "o": bilstm.start(rng, 2 * HIDDEN, TAGS), "c": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
    adam = bilstm.Adam(p)
    for step in range(steps):
        texts, tags = [], []
        for w in rng.choice(len(windows), BATCH):
            w = windows[w]
            spans = base_spans(w)
            if rng.random() < 0.75:
                piece, kind = layouts(rng)
                spaces = [i for i, c in enumerate(w) if c.isspace() and not any(s <= i < e for _, s, e in spans)]
                at = int(rng.choice(spaces)) if spaces else 0
                w = f"{w[:at]} {piece} {w[at:]}"
                more = len(piece) + 2
                spans = [(k, s + more * (s >= at), e + more * (s >= at)) for k, s, e in spans]
                if kind:
                    spans.append((kind, at + 1, at + 1 + len(piece)))
            cut = int(rng.integers(0, 30))
            if spans and min(s for _, s, _ in spans) < cut:
                cut = 0
            # the right edge cuts spans as it does in a long text: what is left of one is one
            w, spans = w[cut:cut + WINDOW], [(k, s - cut, min(WINDOW, e - cut)) for k, s, e in spans if s < cut + WINDOW]
            texts.append(w or " ")
            tags.append(tags_of(len(w) or 1, spans))
        ids, mask = _pad(texts)
        gold = np.zeros(ids.shape, np.int64)
        for b, t in enumerate(tags):
            gold[:len(t), b] = t
        kept: dict = {}
        e = emissions(p, ids, mask, kept)
        _, de, dt = crf_gradient(e, gold, mask, p["t"])
        both = kept["both"]
        dboth = de @ p["o"].T
        dxf, dhf = bilstm.back(np.ascontiguousarray(dboth[:, :, :HIDDEN]), p["hf"], kept["a"])
        dxb, dhb = bilstm.back(np.ascontiguousarray(dboth[::-1, :, HIDDEN:]), p["hb"], kept["b"])
        gxf, gxb = np.zeros_like(p["xf"]), np.zeros_like(p["xb"])
        np.add.at(gxf, ids.ravel(), dxf.reshape(-1, 4 * HIDDEN))
        np.add.at(gxb, ids[::-1].ravel(), dxb.reshape(-1, 4 * HIDDEN))
        adam.step({"xf": gxf, "hf": dhf, "xb": gxb, "hb": dhb, "t": dt, "c": de.sum((0, 1)),
                   "o": both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS)}, rate=0.02 * (1 - step / steps) + 0.001)
    return p


def windows_of(text: str) -> list[tuple[int, str]]:
    """(start, window) over the whole text, without those that hold neither a
    digit nor an at sign."""
    hits = [m.start() for m in _TRIGGER.finditer(text)]
    out = []
    for at in range(0, max(1, len(text) - (WINDOW - STRIDE)), STRIDE) if hits else ():
        k = bisect.bisect_left(hits, at)
        if k < len(hits) and hits[k] < at + WINDOW:
            out.append((at, text[at:at + WINDOW]))
    return out


def valid(kind: str, s: str) -> bool:
    """The exact check of a model span."""
    d = _digits(s)
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+ ?@ ?[A-Za-z0-9.-]+\.[A-Za-z]{2,}", s))
    if kind == "ip":
        parts = re.split(r"\s*\.\s*", s)
        return len(parts) == 4 and all(re.fullmatch(r"[0-9]{1,3}", x) and int(x) <= 255 for x in parts)
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d) and not re.search(r"[^0-9 ./-]", s)
    return 10 <= len(d) <= 15 and bool(re.fullmatch(r"[+(0-9][0-9 ().+-]*[0-9]", s)) and bool(re.search(r"[ ().-]", s)) \
        and not re.fullmatch(r"[0-9 ]*|[0-9.]*", s)


def decoded(p: dict, jobs: list[tuple[int, int, str, int]]) -> dict[int, list[tuple[float, int, int, str]]]:
    """Viterbi spans of windows (text number, start, window, text length), as
    (weight, start, end, kind) per text. A span that a window's edge may cut is in
    the neighbouring window as a whole if it is shorter than their overlap; a longer
    one is put together from its parts, each cut where the next window goes on."""
    found: dict[int, list] = {}
    open_parts: dict[tuple[int, str], tuple[float, int, int]] = {}
    for k in range(0, len(jobs), RUN_ROWS):
        some = jobs[k:k + RUN_ROWS]
        ids, mask = _pad([w for _, _, w, _ in some])
        e = emissions(p, ids, mask)
        tags = viterbi(e, mask, p["t"])
        for b in np.flatnonzero((tags * mask).any(0)):  # windows of a text in their order
            n, at, w, length = some[b]
            t = tags[:len(w), b]
            for s in np.flatnonzero(t % 2 == 1):
                end = s + 1
                while end < len(t) and t[end] == t[s] + 1:
                    end += 1
                kind = KINDS[(int(t[s]) - 1) // 2]
                part = (float((e[np.arange(s, end), b, t[s:end]] - e[s:end, b, 0]).sum()), at + int(s), at + int(end))
                if s == 0 and at > 0:
                    before = open_parts.get((n, kind))
                    if before is None or not before[1] < part[1] <= before[2]:
                        continue  # starts before this window
                    # what both windows saw counts once
                    part = (before[0] + part[0] * (part[2] - before[2]) / (part[2] - part[1]), before[1], max(before[2], part[2]))
                if end == len(t) and at + len(w) < length:
                    open_parts[n, kind] = part
                else:
                    found.setdefault(n, []).append((*part, kind))
    return found


def reconciled(spans: list[tuple[float, int, int, str]]) -> list[tuple[str, int, int]]:
    """The heaviest set of spans that do not overlap; ties: the earlier in order."""
    best: dict[tuple[int, int, str], float] = {}
    for w, s, e, k in spans:
        best[s, e, k] = max(w, best.get((s, e, k), w))
    order = sorted((e, s, k, w) for (s, e, k), w in best.items() if w > 0)
    ends = [e for e, *_ in order]
    total, take = [0.0], []
    for i, (_, s, _, w) in enumerate(order):
        j = bisect.bisect_right(ends, s, 0, i)
        take.append((total[j] + w > total[-1], j))
        total.append(max(total[-1], total[j] + w))
    out, i = [], len(order)
    while i:
        yes, j = take[i - 1]
        if yes:
            e, s, k, _ = order[i - 1]
            out.append((k, s, e))
            i = j
        else:
            i -= 1
    return out[::-1]


def find(p: dict, texts: list[str | None]):
    """(base spans, all spans) per text."""
    jobs, base = [], []
    for n, t in enumerate(texts):
        base.append(base_spans(t or ""))
        jobs += [(n, at, w, len(t)) for at, w in (windows_of(t) if t else ())]
    found = decoded(p, jobs)
    for n, t in enumerate(texts):
        added, taken = [], sorted((s, e) for _, s, e in base[n])
        reach = []  # furthest end of the base spans so far
        for _, e in taken:
            reach.append(max(e, reach[-1] if reach else 0))
        for k, s, e in reconciled(found.get(n, [])):
            i = bisect.bisect_left(taken, (e, 0))
            if (i == 0 or reach[i - 1] <= s) and valid(k, t[s:e]):
                added.append((k, s, e))
        yield base[n], sorted(base[n] + added, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def training_windows(docs: DataFrame, text: str = "text", rows: int = TRAIN_WINDOWS) -> list[str]:
    """At most ``rows`` windows, one per text that holds a digit or an at sign,
    from different texts in the order of a hash."""
    spark = docs.sparkSession
    bound_batches(spark)
    base = docs.where(F.col(text).rlike("[0-9@]")).select(F.col(text).alias("text"), F.xxhash64(text).alias("h"))

    def cut(texts):
        for t in texts:
            at = next((s for _, s, _ in base_spans(t)), _TRIGGER.search(t).start())
            yield (t[max(0, at - 50):at + WINDOW],)

    picked = base.select("h", struct_udf("w string", cut)("text").alias("w")).select("h", "w.w").dropDuplicates(["h"])
    return [r.w for r in picked.orderBy("h").limit(rows).collect()]


def fit(docs: DataFrame, text: str = "text", rows: int = TRAIN_WINDOWS) -> dict:
    return train(training_windows(docs, text, rows))


def pii(spark: SparkSession, model: dict):
    """Column function text -> struct(base, spans): arrays of (kind, start, end)."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # weights, under 100 KB
    kind = "array<struct<kind:string,start:int,end:int>>"
    as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
    return struct_udf(f"base {kind}, spans {kind}", lambda texts: ((as_rows(a), as_rows(b)) for a, b in find(shared.value, texts)))


def pii_digest(spark: SparkSession, model: dict):
    """Column function text -> counts per kind of base span, their digest, all spans."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(texts):
        for base, spans in find(shared.value, texts):
            yield (*(sum(k == x for x, _, _ in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))

    return struct_udf("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string", run)


def redact(text: str, spans) -> str:
    """The text with every span replaced by its kind in angle brackets; of
    overlapping spans the first stands for all."""
    out, at = [], 0
    for k, s, e in spans:
        if s >= at:
            out += [text[at:s], f"<{k}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redacted(spark: SparkSession, model: dict):
    """Column function text -> struct(text, n): the redacted text (null stays
    null) and the number of spans."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    return struct_udf("text string, n bigint", lambda texts: (
        (None if t is None else redact(t, s), len(s)) for t, (_, s) in zip(texts, find(shared.value, texts))))
