"""Personal data: base patterns, and a character-level bidirectional LSTM with a CRF that adds spans.

Kinds are email, ip, card and phone. Base spans come from patterns (base_spans). The network reads characters as SYMBOLS classes, in windows of WINDOW
characters every STRIDE; each window is decoded by Viterbi, its spans weighed by the CRF's posterior. Spans that touch an inner edge
of their window are left to the next window, which holds those of up to STRIDE characters whole; what no window held whole is
read again in the middle of a longer one, until no edge cuts it. Per document the spans of all windows and the base
spans are reconciled at once: base spans stay, and of the rest the set without overlaps of the greatest total weight is
taken (weighted interval scheduling). A span added must have the form of its kind (well_formed), and a weight of SURE.

Every kind holds a digit or an @, so windows without any can't hold a span and aren't read; this drops no span.
The network is trained in numpy on the driver, from TRAIN synthetic windows of labelled spans among other numbers and words; the seed
fixes them, so that each run has the same weights. Its parameters (some 20 KB) are sent with the tasks. Texts are read whole.

Nulls: a null text is empty and has no spans; null doc_ids are kept. Repeated rows give repeated rows. Empty tables give empty results.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarrylog.llm.common import column, session, texts

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
#: Length of the longer windows that the network is trained on last.
LONG = 480
#: Characters of windows that are decoded at once, about.
CELLS = 512 * WINDOW
SURE = 0.9
TRAIN, EPOCHS, BATCH, SEED = 2048, 12, 64, 17
EMBED, HIDDEN = 12, 16
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
Span = tuple[int, int, int]  # start, kind, end

# --- base patterns -----------------------------------------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match begins where its run of digits does: a run that fails from its first digit fails from each
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @, so that long runs of other characters cost nothing twice."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _octet(digits: str) -> bool:
    """If the digits, however many zeros come first, are at most 255."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, in order of start, then kind."""
    if not _ANY.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def well_formed(text: str, span: Span) -> bool:
    """If an added span has the form of its kind, in a wider sense than the base patterns."""
    s, kind = text[span[0] : span[2]], span[1]
    d = _digits(s)
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@]+ ?@ ?[^\s@]+ ?\. ?[^\s@]*[A-Za-z0-9]", s))
    if kind == 1:
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[A-Za-z]", s)
    if re.search(r"[^0-9 ().+_/-]", s) or not s[-1].isdigit():
        return False
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and len(re.findall(r"[ ().-]+", s)) >= 2


# --- labelled windows ---------------------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each ASCII character; 0 is beyond the text, 1 other letters, 2 anything else."""
    out = np.full(128, 2, np.int64)
    for k, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        out[ord(c)] = out[ord(c.upper())] = 3 + k
    out[ord("0") : ord("9") + 1] = 29
    for k, c in enumerate(" !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
        out[ord(c)] = 30 + k
    return out


SYMBOLS = 64


def symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(code < 128, _classes()[np.minimum(code, 127)], np.where(code < 0x250, 1, 2))


def _number(rng, form: str) -> str:
    return "".join(str(rng.integers(10)) if c == "d" else c for c in form)


def _card(rng, form: str) -> str:
    s = _number(rng, form)
    at = max(k for k, c in enumerate(s) if c.isdigit())
    return next(t for k in range(10) if luhn(_digits(t := s[:at] + str(k) + s[at + 1 :])))


def _word(rng) -> str:
    return "".join(rng.choice(list("etaoinshrdlucmfpgywbvk"), rng.integers(2, 9)))


def _positive(rng, kind: int, words: int = 12) -> str:
    pick = lambda *x: x[rng.integers(len(x))]
    if kind == 0:
        user, host, top = _word(rng) + pick("", "." + _word(rng), _number(rng, ".dd"), "_" + _word(rng)), _word(rng) + pick("", _number(rng, "d"), "-" + _word(rng)), pick("com", "org", "net", "example.com", "co.uk", "de")
        if rng.random() < 0.4:  # long ones
            user, host = (pick("", ".", "-", "_").join(_word(rng) for _ in range(rng.integers(2, words))) for _ in range(2))
        return pick(f"{user}@{host}.{top}", f"{user}@{host}.{top}", f"{user} @ {host}.{top}", f"{user} @ {host}.{top}", f"{user}@{host} . {top}")
    if kind == 1:
        parts = [str(rng.integers(256)) for _ in range(4)]
        return pick(".", ".", " . ", "[.]").join(parts)
    if kind == 2:
        return _card(rng, pick("dddddddddddddddd", "dddd dddd dddd dddd", "dddd-dddd-dddd-dddd", "dddd.dddd.dddd.dddd", "dddd dddddd ddddd", "dddddddddddddd"))
    return _number(rng, pick("+d (ddd) ddd-dddd", "(ddd) ddd-dddd", "ddd-ddd-dddd", "+dd dd dddd dddd", "ddd.ddd.dddd", "+dd ddd ddddddd", "00dd ddd ddd dddd"))


def _negative(rng) -> str:
    pick = lambda *x: x[rng.integers(len(x))]
    hexa = "".join(rng.choice(list("0123456789abcdef"), rng.integers(8, 40)))
    return pick(hexa, hexa, _number(rng, "dddd-dd-dd"), _number(rng, "dd:dd:dd"), _number(rng, "d.dd"), _number(rng, "d.d.d"), _number(rng, "dddd"), _number(rng, "d" * int(rng.integers(5, 24))), "#" + _number(rng, "ddddd"), "@" + _word(rng), _number(rng, "dd%"), _number(rng, "ddd,ddd"), "password=" + hexa[:18], f'token = "{hexa}"')


def labelled(n: int = TRAIN, seed: int = SEED, window: int = WINDOW, words: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Windows of symbols and their tags; long addresses have two parts of up to `words` words."""
    rng = np.random.default_rng(seed)
    x, y = np.zeros((n, window), np.int64), np.zeros((n, window), np.int64)
    for row in range(n):
        text, tags = "", []
        while len(text) < window + 8:
            what = rng.random()
            if what < 0.16:
                kind = int(rng.integers(len(KINDS)))
                s = _positive(rng, kind, words)
                tags += [1 + 2 * kind] + [2 + 2 * kind] * (len(s) - 1)
            else:
                s = _negative(rng) if what < 0.3 else _word(rng)
                tags += [0] * len(s)
            gap = (" ", " ", " ", ". ", ", ", "\n", " = ")[rng.integers(7)]
            text, tags = text + s + gap, tags + [0] * len(gap)
        cut = int(rng.integers(0, 8))
        x[row], y[row] = symbols(text)[cut : cut + window], tags[cut : cut + window]
    return x, y


# --- the network -------------------------------------------------------------------------------------------------------------


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _scan(table: np.ndarray, x: np.ndarray, wh: np.ndarray, order: range, keep: bool = False):
    """An LSTM over the windows x in the given order; table has the input gates of each symbol."""
    n, hidden = len(x), wh.shape[0]
    h = c = np.zeros((n, hidden), np.float32)
    out, kept = np.empty((n, x.shape[1], hidden), np.float32), {}
    for t in order:
        z = table[x[:, t]] + h @ wh
        gates = _sigmoid(z[:, : 3 * hidden])
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        g = np.tanh(z[:, 3 * hidden :])
        before, h0 = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[:, t] = h
        if keep:
            kept[t] = (h0, before, i, f, o, g, tc)
    return out, kept


def emissions(p: dict, x: np.ndarray, keep: bool = False):
    sides = []
    for s in "fb":
        order = range(x.shape[1]) if s == "f" else range(x.shape[1] - 1, -1, -1)
        sides.append(_scan(p["embed"] @ p["wx" + s] + p["b" + s], x, p["wh" + s], order, keep))
    h = np.concatenate([sides[0][0], sides[1][0]], 2)
    return (h @ p["out"] + p["bias"], h, sides) if keep else h @ p["out"] + p["bias"]


def posteriors(e: np.ndarray, trans: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Each position's tag probabilities, and the expected transitions unless they aren't asked for, under the CRF."""
    n, steps, tags = e.shape
    step = np.exp(trans)
    pot = np.exp(e - e.max(2, keepdims=True))
    a, b = np.empty((n, steps, tags)), np.empty((n, steps, tags))
    a[:, 0] = pot[:, 0] / pot[:, 0].sum(1, keepdims=True)
    for t in range(1, steps):
        v = (a[:, t - 1] @ step) * pot[:, t]
        a[:, t] = v / v.sum(1, keepdims=True)
    b[:, -1] = 1
    for t in range(steps - 2, -1, -1):
        v = (b[:, t + 1] * pot[:, t + 1]) @ step.T
        b[:, t] = v / v.sum(1, keepdims=True)
    m = a * b
    m /= m.sum(2, keepdims=True)
    if not pairs:
        return m, None
    pair = a[:, :-1, :, None] * step * (pot * b)[:, 1:, None, :]
    return m, (pair / pair.sum((2, 3), keepdims=True)).sum((0, 1))


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    n, steps, tags = e.shape
    back = np.empty((n, steps, tags), np.int8)
    best = e[:, 0]
    for t in range(1, steps):
        score = best[:, :, None] + trans
        back[:, t] = score.argmax(1)
        best = score.max(1) + e[:, t]
    out = np.empty((n, steps), np.int64)
    out[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = back[np.arange(n), t, out[:, t]]
    return out


def allowed() -> np.ndarray:
    """-1e4 for transitions that no labelling has: an inside tag follows its own begin or inside only."""
    out = np.zeros((TAGS, TAGS))
    for kind in range(len(KINDS)):
        for before in range(TAGS):
            if before not in (1 + 2 * kind, 2 + 2 * kind):
                out[before, 2 + 2 * kind] = -1e4
    return out


def _side_gradients(p: dict, x: np.ndarray, dh_out: np.ndarray, kept: dict, s: str, order: list[int], grads: dict) -> None:
    wh, hidden = p["wh" + s], HIDDEN
    dh = dc = np.zeros((len(x), hidden), np.float32)
    per_symbol = np.zeros((SYMBOLS, 4 * hidden), np.float32)
    gwh = np.zeros_like(wh)
    for t in reversed(order):
        h0, before, i, f, o, g, tc = kept[t]
        dh = dh + dh_out[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        gwh += h0.T @ dz
        np.add.at(per_symbol, x[:, t], dz)
        dh, dc = dz @ wh.T, dc * f
    grads["wh" + s] = gwh
    grads["b" + s] = per_symbol.sum(0)
    grads["wx" + s] = p["embed"].T @ per_symbol
    grads["embed"] = grads.get("embed", 0) + per_symbol @ p["wx" + s].T


def _gradients(p: dict, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean of -ln p(y | x)."""
    e, h, sides = emissions(p, x, keep=True)
    de, pairs = posteriors(e.astype(float), p["trans"] + allowed())
    np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
    de = (de / len(x)).astype(np.float32)
    np.add.at(pairs, (y[:, :-1], y[:, 1:]), -1.0)
    grads = {"trans": (pairs / len(x)).astype(np.float32), "out": np.einsum("nth,ntk->hk", h, de), "bias": de.sum((0, 1))}
    dh = de @ p["out"].T
    steps = list(range(x.shape[1]))
    _side_gradients(p, x, dh[:, :, :HIDDEN], sides[0][1], "f", steps, grads)
    _side_gradients(p, x, dh[:, :, HIDDEN:], sides[1][1], "b", steps[::-1], grads)
    return grads


@functools.lru_cache(maxsize=1)
def trained(n: int = TRAIN, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """The network's parameters: likelihood of the labelled windows, by Adam."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {"embed": draw(SYMBOLS, EMBED) * 4, "out": draw(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
    for s in "fb":
        p |= {"wx" + s: draw(EMBED, 4 * HIDDEN), "wh" + s: draw(HIDDEN, 4 * HIDDEN), "b" + s: np.zeros(4 * HIDDEN, np.float32)}
        p["b" + s][HIDDEN : 2 * HIDDEN] = 1  # cells remember at first
    sets = [(*labelled(n, seed), epochs), (*labelled(n // 8, seed + 1, LONG, LONG // 12), epochs // 2)]
    steps = sum(rounds * -(-len(x) // (BATCH * WINDOW // x.shape[1])) for x, _, rounds in sets)
    first, second, k = {c: np.zeros_like(v) for c, v in p.items()}, {c: np.zeros_like(v) for c, v in p.items()}, 0
    for x, y, rounds in sets:
        for order in (rng.permutation(len(x)) for _ in range(rounds)):
            for some in np.array_split(order, -(-len(x) // (BATCH * WINDOW // x.shape[1]))):
                k += 1
                grads = _gradients(p, x[some], y[some])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                rate = 0.02 * (1 - 0.9 * k / steps)
                for c, g in grads.items():
                    g = g * min(1.0, 5.0 / max(norm, 1e-9))
                    first[c] = 0.9 * first[c] + 0.1 * g
                    second[c] = 0.99 * second[c] + 0.01 * g * g
                    p[c] = (p[c] - rate * (first[c] / (1 - 0.9**k)) / (np.sqrt(second[c] / (1 - 0.99**k)) + 1e-6)).astype(np.float32)
    return p


# --- finding -----------------------------------------------------------------------------------------------------------------


def windows(text: str) -> list[int]:
    """The starts of the windows that hold a digit or an @."""
    starts: set[int] = set()
    for m in _ANY.finditer(text):
        k = m.start() // STRIDE
        starts.add(k * STRIDE)
        if k:
            starts.add((k - 1) * STRIDE)
    return sorted(starts)


def decoded(p: dict, x: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
    """Window, start, kind, end, weight of the spans of each window; one that begins before the window has an inside tag first."""
    e = emissions(p, x)
    trans = p["trans"] + allowed()
    tags, m = viterbi(e, trans), posteriors(e.astype(float), trans, pairs=False)[0]
    sure = np.take_along_axis(m, tags[:, :, None], 2)[:, :, 0]
    begins = tags % 2 == 1
    begins[:, 0] |= tags[:, 0] > 0
    for w, a in zip(*np.nonzero(begins), strict=True):
        kind, b = (tags[w, a] - 1) // 2, a + 1
        while b < x.shape[1] and tags[w, b] == 2 + 2 * kind:
            b += 1
        yield int(w), int(a), int(kind), int(b), float(sure[w, a:b].mean())


def extendable(s: str, kind: int) -> bool:
    """If a text that begins, ends or goes on with s can have the form of its kind."""
    if kind == 0:
        return s.count("@") <= 1 and len(re.findall(r"\s", s)) <= 4
    return sum(map(str.isdigit, s)) <= (12, 19, 15)[kind - 1]


class _Reading:
    """The spans of some texts by the network, a batch of windows of one length at a time."""

    def __init__(self, p: dict, some: list[str], base: list[list[Span]]):
        self.p, self.some, self.base = p, some, base
        self.found: list[list[tuple[int, int, int, float]]] = [[] for _ in some]
        self.cut: list[tuple[int, int, int, int]] = []  # text, start, kind, end of spans that touch an inner edge of their window

    def decode(self, todo: list[tuple[int, int, int, int]], length: int) -> None:
        """todo: text, start of the window, and the range of the text that spans have to meet."""
        x = np.zeros((len(todo), length), np.int64)
        for row, (n, start, *_) in enumerate(todo):
            s = symbols(self.some[n][start : start + length])
            x[row, : len(s)] = s
        for w, a, kind, b, sure in decoded(self.p, x):
            n, start, low, high = todo[w]
            if start + a >= high or start + b <= low:
                continue
            if (a == 0 and start > 0) or (b == length and start + length < len(self.some[n])):
                self.cut.append((n, start + a, kind, start + b))
            elif start + b <= len(self.some[n]):
                self.found[n].append((start + a, kind, start + b, sure))

    def stretches(self) -> list[tuple[int, int, int]]:
        """Text, start, end of what has to be read again: cut spans, joined where they overlap, that no whole span covers."""
        taken = {n: Cover([(a, b) for a, _, b in self.base[n]] + [(a, b) for a, k, b, w in self.found[n] if w >= SURE and well_formed(self.some[n], (a, k, b))]) for n in {c[0] for c in self.cut}}
        out: list[tuple[int, int, int]] = []
        for n, a, kind, b in sorted(self.cut, key=lambda c: (c[0], c[1])):
            if taken[n].meets(a, b) or not extendable(self.some[n][a:b], kind):
                continue
            if out and out[-1][0] == n and a <= out[-1][2]:
                out[-1] = (n, out[-1][1], max(b, out[-1][2]))
            else:
                out.append((n, a, b))
        self.cut.clear()
        return out

    def again(self) -> None:
        """Reads cut spans once more in the middle of longer windows, which double from round to round, until none is cut."""
        least = WINDOW
        while todo := self.stretches():
            least *= 2
            by: dict[int, list[tuple[int, int, int, int]]] = {}
            for n, a, b in todo:
                length = least
                while length < 3 * (b - a):
                    length *= 2
                by.setdefault(length, []).append((n, max(0, (a + b - length) // 2), a, b))
            for length, some in by.items():
                rows = max(1, CELLS // length)
                for at in range(0, len(some), rows):
                    self.decode(some[at : at + rows], length)


class Cover:
    """Ranges, joined where they overlap."""

    def __init__(self, ranges: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(ranges):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.starts, b) - 1
        return k >= 0 and self.ends[k] > a


def reconciled(text: str, base: list[Span], found: list[tuple[int, int, int, float]]) -> list[Span]:
    """Base spans, and of found (start, kind, end, weight) the heaviest set without overlaps."""
    weight: dict[Span, float] = {}
    taken = Cover([(a, b) for a, _, b in base])
    for a, kind, b, w in found:
        if w >= SURE and not taken.meets(a, b) and well_formed(text, (a, kind, b)):
            weight[a, kind, b] = max(w, weight.get((a, kind, b), 0.0))
    spans = sorted(weight, key=lambda s: (s[2], s))
    ends = [s[2] for s in spans]
    best, before = [0.0], []  # the weight of the first n spans' best set; of a set that ends with a span, how many come before it
    for n, s in enumerate(spans):
        before.append(bisect.bisect_right(ends, s[0], 0, n))
        best.append(max(best[n], best[before[n]] + weight[s] * (s[2] - s[0])))
    chosen, n = [], len(spans)
    while n:
        if best[n] == best[n - 1]:
            n -= 1
        else:
            chosen.append(spans[n - 1])
            n = before[n - 1]
    return sorted([*base, *chosen])


def find(p: dict, some: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in some]
    reading, todo = _Reading(p, some, base), []
    for n, t in enumerate(some):
        for start in windows(t):
            todo.append((n, start, start, start + WINDOW))
            if len(todo) == CELLS // WINDOW:
                reading.decode(todo, WINDOW)
                todo = []
    if todo:
        reading.decode(todo, WINDOW)
    reading.again()
    return [(b, reconciled(t, b, f)) for t, b, f in zip(some, base, reading.found, strict=True)]


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added for each row of docs."""
    session(docs)
    p = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = find(p, texts(b))
            counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64()) for kind in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string())
            rest = [pa.array([listed(every) for _, every in found], pa.string()), pa.array([len(every) - len(base) for base, every in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(column(b, "doc_id"), pa.int64()), *counts, digests, *rest], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {kinds}, base_sha256 string, spans string, n_added long")


def masked(text: str, every: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for a, kind, b in every:
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data in text masked, and n_chars, where there is such a column, of the new text. Null texts stay null."""
    session(docs)
    p, names = trained(), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = column(b, "text")
            new = [None if t is None else masked(t, every) for t, (_, every) in zip(old, find(p, [t or "" for t in old]), strict=True)]
            put = {"text": pa.array(new, pa.string())}
            if "n_chars" in names:
                field = b.schema.field("n_chars").type
                put["n_chars"] = pa.array([n if t == o else len(t) for n, t, o in zip(column(b, "n_chars"), new, old, strict=True)], field)
            yield pa.RecordBatch.from_arrays([put.get(c, b.column(k)) for k, c in enumerate(names)], names)

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
