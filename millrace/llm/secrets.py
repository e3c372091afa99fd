"""Secret scans: fixed patterns, and a character convolutional network over other candidates.

The patterns (assigned values, access keys, hex keys) always count. Candidates are all runs of 20 or
more token characters, whatever they hold, and the token after a credential word from six characters
on. A candidate wholly within spans of the patterns is left out; one that reaches beyond is kept whole.
Each is judged together with its surroundings by a small network in numpy: character embeddings,
filters of two widths, and the maximum and mean of each filter, trained on labelled findings. Its
outputs are calibrated (Platt) on findings held out from training, and the threshold is the highest
at which an exact binomial bound on other held-out findings still promises the wanted recall.

For scoring, embeddings times filters are multiplied out, so a filter of width w is a sum of w table
rows; a long candidate goes through in overlapping blocks whose maxima and sums are joined, which is
exact and takes bounded memory.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_rows, small_batches, tidy, whole_row

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "neural")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: A token after a credential word that begins where a word does (or a capital, as in dbKey). With a sign of assignment
#: any token counts; after "is", or a scheme of authorization alone, one that no plain word is: with a digit or a sign of passwords.
NEAR = re.compile(
    r"""(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z])(?=[A-Z])))"""
    r"""(?:(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|cred(?:ential)?s?|auth(?:orization)?|bearer|keys?|login)["']?"""
    r"""(?:\x20?[:=]>?\x20?(?:(?:basic|bearer|digest)\x20)?|\x20is\x20(?=[^\s"'<>,;(){}\[\]]*[0-9!@#$%^&*+])))"""
    r"""|(?:basic|bearer|digest)\x20(?=[^\s"'<>,;(){}\[\]]*[0-9!@#$%^&*+]))"""
    r"""["']?([^\s"'<>,;(){}\[\]]{6,})""", re.IGNORECASE | re.ASCII)  # fmt: skip
NEAR_HINTS = ("pass", "pwd", "secret", "token", "cred", "auth", "bearer", "basic", "digest", "key", "login")
BEFORE, AFTER = 24, 12
#: Plain words of four languages: every other one is in the findings that the net learns from, the rest is for tests.
WORDS = tuple("""
ability account action address almost another answer apache archive article balance because before behind between branch bridge broken button camera
catalog center change chapter children client coffee column common company compass content context control country course create culture custom default
deliver design detail different document domain during early editor either engine enough escape evening example expect factory family feature figure
filter finger follow forest friend garden general group handle harbor history however import include inside island january keyboard kitchen language
letter library listen little machine manager market master matter meeting member memory method minute monkey morning mountain network nothing number
abend anfang antwort arbeit aufgabe bedeutung beispiel bericht bewegung bibliothek dampfer entwicklung erfahrung ergebnis familie freiheit gemeinde
geschichte gesellschaft grundlage hoffnung nachricht wirklich zusammen abandon affaire ancien aujourd bonheur campagne chapitre chemin courage demain
depuis ensemble histoire lumiere maison montagne nouvelle pendant quelque rapport toujours voyage abierto alguien anterior bastante camino ciudad
cuando despues durante entonces escuela historia hombre iglesia lejos manera mientras noche nosotros palabra pregunta primero pueblo respuesta siempre
""".split())
#: Places that the net looks at together, and characters of a block of a long candidate.
LOT, BLOCK = 1 << 15, 1 << 12

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and not overlapping within each kind."""
    spans: list[Span] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Candidates ``(start, end)`` in order, none inside another or wholly within the joined spans ``taken`` (sorted)."""
    found = [m.span() for m in CANDIDATE.finditer(text)]
    low = text.lower()
    if any(h in low for h in NEAR_HINTS):
        found = sorted({*found, *(m.span(1) for m in NEAR.finditer(text))}, key=lambda x: (x[0], -x[1]))
    starts: list[int] = []
    ends: list[int] = []
    for s, _, e in taken:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out: list[tuple[int, int]] = []
    for start, end in found:
        k = bisect_right(starts, start) - 1
        if (out and end <= out[-1][1]) or (k >= 0 and end <= ends[k]):
            continue
        out.append((start, end))
    return out


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """``n`` findings (text, start, end, label) drawn from templates: what reviewers call a secret, and what not."""
    r = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllables = ("th", "er", "on", "an", "re", "ing", "tion", "ent", "ver", "sch", "que", "ment", "lo", "ra", "do", "ed", "is", "ou",
                 "schaft", "fahrt", "dampf", "gesell", "lich", "keit", "ung", "haupt", "stadt", "kapit", "eaux", "ille", "mente", "ando", "ero", "ci", "ma", "ta", "pe", "gra", "fi", "str", "bahn", "hof", "zu", "ver")

    def chars(alphabet: str, least: int, most: int) -> str:
        return "".join(r.choices(alphabet, k=r.randint(least, most)))

    def word() -> str:
        return r.choice(WORDS[::2]) if r.random() < 0.5 else "".join(r.choices(syllables, k=r.randint(1, 4)))

    def positive() -> str:
        return r.choice((
            lambda: chars(lower + upper + digits, 24, 64),
            lambda: chars(lower + upper + digits + "+/", 30, 60) + r.choice(("", "=", "==")),
            lambda: r.choice(("ghp_", "gho_", "sk_live_", "sk-", "xoxb-", "AIza", "glpat-", "npm_")) + chars(lower + upper + digits, 20, 40),
            lambda: "eyJ" + chars(lower + upper + digits + "-_", 24, 80),
            lambda: chars("0123456789ABCDEF", 32, 64),
            lambda: chars(lower + digits, 28, 50),
            lambda: chars(lower + upper, 24, 50),
            lambda: f"{chars(lower + upper + digits, 12, 24)}.{chars(lower + upper + digits + '-_', 12, 40)}",
        ))()

    def short_positive() -> str:
        return r.choice((
            lambda: chars(lower + upper + digits, 8, 19),
            lambda: chars(lower + upper + digits + "!@#$%^&*+-", 8, 19),
            lambda: word() + chars(digits, 2, 5) + r.choice("!@#$%&*"),
            lambda: word().capitalize() + r.choice("!@#_-") + chars(digits, 3, 6),
            lambda: chars(digits, 9, 19),
            lambda: chars(lower + digits, 8, 19),
        ))()

    def short_negative() -> str:
        return r.choice((
            lambda: word() + word(),
            lambda: (word() + word()).capitalize() + r.choice(("", ".", ":", "?")),
            lambda: word() + word() + r.choice((".", ":", "!")),
            lambda: "-".join((word(), word())),
            lambda: f"{word()}/{word()}",
            lambda: f"{word()}_{word()}",
            lambda: word() + r.choice(("", "s", "ing", "ed", ".", "s.", ":")),
            lambda: word().capitalize() + word().capitalize() + r.choice(("", ".", "()")),
            lambda: r.choice("*x.-_") * r.randint(6, 12),
        ))()

    def negative() -> str:
        return r.choice((
            lambda: "_".join(word() for _ in range(r.randint(4, 7))) + str(r.randint(0, 99)),
            lambda: "".join(word().capitalize() for _ in range(r.randint(4, 7))) + str(r.randint(1, 99)),
            lambda: "/".join(word() for _ in range(r.randint(4, 8))) + f"/{word()}{r.randint(1, 9)}",
            lambda: f"{r.randint(1990, 2035)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}-{r.randint(10, 59)}Z",
            lambda: "-".join(str(r.randint(1000, 9999)) for _ in range(5)) + r.choice("abx"),
            lambda: "-".join(word() for _ in range(r.randint(4, 8))) + f"-{r.randint(1, 2100)}",
            lambda: r.choice(lower + "=-_x") * r.randint(20, 60) + (f"{word()}{r.randint(0, 9)}" if r.random() < 0.6 else ""),
            lambda: "/".join(word() for _ in range(r.randint(3, 6))) + "/" + r.choice((word().upper(), word().capitalize(), word() + "-" + word(), word() + "_" + word())),
            lambda: "/".join((*(word() for _ in range(r.randint(2, 5))), word() + r.choice(digits), word().capitalize() + word().capitalize())),
            lambda: "".join(word().capitalize() for _ in range(r.randint(3, 6))),
            lambda: r.choice("-/_").join(r.choice(WORDS[::2]) for _ in range(r.randint(3, 6))),
            lambda: "".join(r.choice(WORDS[::2]).capitalize() for _ in range(r.randint(3, 6))),
            lambda: "_".join(word() for _ in range(r.randint(3, 6))).upper(),
            lambda: f"{word()}=" + "+".join(f"{word()}{r.randint(0, 9)}" for _ in range(r.randint(4, 7))),
            lambda: "".join(word() for _ in range(r.randint(8, 14))) + str(r.randint(0, 9)),
            lambda: f"v{r.randint(0, 20)}-{r.randint(0, 20)}-{r.randint(0, 20)}-" + "-".join((word(), word(), word())),
            lambda: "-".join(chars("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)),
            lambda: "".join(word() for _ in range(r.randint(7, 14))),
            lambda: "".join(word() for _ in range(r.randint(7, 12))).capitalize(),
            lambda: "-".join(word() for _ in range(r.randint(5, 9))),
            lambda: r.choice("=-_+/") * r.randint(20, 90),
            lambda: chars(digits, 20, 30),
        ))()

    out = []
    for k in range(n):
        label, short = k % 2, r.random() < 0.3
        if short:
            token = short_positive() if label else short_negative()
        else:
            token = positive() if label else negative()
        if short and label:
            lead = r.choice(("pwd=", "pwd: ", "Authorization: Basic ", "Bearer ", "key=", "passphrase is ", "login: ", 'auth="', "passcode: ", "credentials=", "key: ", "PWD = "))
        elif short:
            lead = r.choice(("key = ", "the key: ", "auth=", "login: ", "pass: ", "passphrase: ", "credentials: ", "Keys: ", "key: ", "bearer: ", "auth: ", "pwd: "))
        elif label and r.random() < 0.5:
            lead = r.choice(("key: ", "Bearer ", "export KEY=", 'auth = "', "credential ", "pw "))
        else:
            lead = r.choice(("see ", "in ", "file ", "", "at ", "(", "id ", "path "))
        before = " ".join(word() for _ in range(r.randint(0, 6))) + " " + lead
        text = before + token + " " + " ".join(word() for _ in range(r.randint(0, 5)))
        out.append((text, len(before), len(before) + len(token), label))
    return out


class CharNet:
    """Characters with a flag for "inside" -> embeddings -> filters -> maximum and mean -> probability."""

    SYMBOLS = 98  # padding, the 95 printable ASCII characters, other white space, anything else

    def __init__(self, seed: int = 7, dim: int = 10, filters: int = 16, widths: tuple[int, ...] = (3, 5)) -> None:
        g = np.random.default_rng(seed)
        self.widths = widths
        self.p = {"E": g.normal(0, 0.3, (2 * self.SYMBOLS, dim))}
        for w in widths:
            self.p[f"W{w}"] = g.normal(0, (2 / (w * dim)) ** 0.5, (w * dim, filters))
            self.p[f"b{w}"] = np.zeros(filters)
        self.p["out"] = g.normal(0, 0.1, 2 * filters * len(widths))
        self.p["bias"] = np.zeros(1)
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5
        self._tables: dict[int, np.ndarray] = {}

    @classmethod
    def codes(cls, text: str, start: int, end: int, low: int | None = None, high: int | None = None) -> np.ndarray:
        """A candidate with its surroundings (or the places ``low`` to ``high`` of them); codes of inside characters are moved up."""
        low = max(0, start - BEFORE) if low is None else low
        high = min(len(text), end + AFTER) if high is None else high
        points = np.frombuffer(text[low:high].encode("utf-32-le", "surrogatepass"), "<u4")
        code = np.where((points >= 32) & (points < 127), points - 31, np.where(points < 32, 96, 97)).astype(np.uint8)
        code[max(0, start - low) : max(0, end - low)] += cls.SYMBOLS
        return code

    @staticmethod
    def _padded(rows: list[np.ndarray], size: int) -> np.ndarray:
        ids = np.zeros((len(rows), size), np.int64)
        for i, x in enumerate(rows):
            ids[i, : len(x)] = x
        return ids

    def forward(self, rows: list[np.ndarray]) -> tuple[np.ndarray, tuple]:
        """Probabilities of whole rows before calibration, and what the gradients need."""
        width = max(self.widths)
        ids = self._padded(rows, max(len(x) for x in rows) + width - 1)
        real = ids > 0
        emb = self.p["E"][ids] * real[:, :, None]
        pooled, kept = [], []
        for w in self.widths:
            view = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1)  # rows, places, dim, w
            places = view.shape[1]
            view = view.transpose(0, 1, 3, 2).reshape(len(rows), places, -1)
            act = np.maximum(view @ self.p[f"W{w}"] + self.p[f"b{w}"], 0)
            inside = (ids[:, :places] > self.SYMBOLS).astype(float)
            act_real = act * real[:, :places, None]
            top = act_real.argmax(axis=1)
            share = inside / np.maximum(inside.sum(axis=1, keepdims=True), 1)
            pooled += [np.take_along_axis(act_real, top[:, None], 1)[:, 0], (act * share[:, :, None]).sum(axis=1)]
            kept.append((view, act, top, share, places))
        h = np.concatenate(pooled, axis=1)
        z = h @ self.p["out"] + self.p["bias"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), (ids, real, h, kept)

    def gradients(self, rows: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        prob, (ids, real, h, kept) = self.forward(rows)
        dz = (prob - labels) / len(rows)
        g = {"out": h.T @ dz, "bias": dz.sum(keepdims=True)}
        dh = dz[:, None] * self.p["out"]
        demb = np.zeros((*ids.shape, self.p["E"].shape[1]))
        at = 0
        for w, (view, act, top, share, places) in zip(self.widths, kept, strict=True):
            n = act.shape[2]
            dact = share[:, :, None] * dh[:, None, at + n : at + 2 * n]
            i, f = np.indices(top.shape)
            np.add.at(dact, (i, top, f), dh[:, at : at + n])
            dact *= act > 0
            at += 2 * n
            g[f"W{w}"] = np.einsum("bpi,bpf->if", view, dact)
            g[f"b{w}"] = dact.sum(axis=(0, 1))
            dview = (dact @ self.p[f"W{w}"].T).reshape(len(rows), places, w, -1)
            for k in range(w):
                demb[:, k : k + places] += dview[:, :, k]
        g["E"] = np.zeros_like(self.p["E"])
        np.add.at(g["E"], ids[real], demb[real])
        return g

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on the log loss."""
        g = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = g.permutation(len(rows))
            for at in range(0, len(rows), batch):
                pick = order[at : at + batch]
                step += 1
                for k, d in self.gradients([rows[i] for i in pick], labels[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self._tables = {}

    def _pooled(self, ids: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
        """Maxima over real places and sums over inside places of each filter; the first ``places`` columns count, later ones are read ahead."""
        if not self._tables:
            dim = self.p["E"].shape[1]
            emb = self.p["E"] * (np.arange(2 * self.SYMBOLS) > 0)[:, None]  # padding adds nothing
            self._tables = {w: np.stack([emb @ self.p[f"W{w}"][k * dim : (k + 1) * dim] for k in range(w)]) for w in self.widths}
        real, inside = ids[:, :places] > 0, ids[:, :places] > self.SYMBOLS
        tops, sums = [], []
        for w in self.widths:
            act = self.p[f"b{w}"] + sum(self._tables[w][k][ids[:, k : k + places]] for k in range(w))
            act = np.maximum(act, 0)
            tops.append((act * real[:, :, None]).max(axis=1))
            sums.append((act * inside[:, :, None]).sum(axis=1))
        return np.concatenate(tops, axis=1), np.concatenate(sums, axis=1)

    def _logits(self, tops: np.ndarray, sums: np.ndarray, inside: np.ndarray) -> np.ndarray:
        means = sums / np.maximum(inside, 1)[:, None]
        n, h = tops.shape[1] // len(self.widths), []
        for k in range(len(self.widths)):
            h += [tops[:, k * n : (k + 1) * n], means[:, k * n : (k + 1) * n]]
        return np.concatenate(h, axis=1) @ self.p["out"] + self.p["bias"]

    def logits(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """Outputs before calibration of candidates ``(text, start, end)``.

        Candidates of like length share a lot of at most about ``LOT`` places; one longer than
        ``BLOCK`` goes through alone, block by block.
        """
        out, ahead = np.zeros(len(found)), max(self.widths) - 1
        span = lambda i: (max(0, found[i][1] - BEFORE), min(len(found[i][0]), found[i][2] + AFTER))
        sizes = [span(i)[1] - span(i)[0] for i in range(len(found))]
        order = sorted(range(len(found)), key=lambda i: sizes[i])
        at = 0
        while at < len(order) and sizes[order[at]] <= BLOCK:
            stop = at + 1
            while stop < len(order) and sizes[order[stop]] <= BLOCK and (stop + 1 - at) * sizes[order[stop]] <= LOT:
                stop += 1
            pick = order[at:stop]
            size = sizes[pick[-1]]
            tops, sums = self._pooled(self._padded([self.codes(*found[i]) for i in pick], size + ahead), size)
            out[pick] = self._logits(tops, sums, np.array([found[i][2] - found[i][1] for i in pick]))
            at = stop
        for i in order[at:]:
            text, start, end = found[i]
            low, high = span(i)
            best, total = 0.0, 0.0
            for k in range(low, high, BLOCK):
                stop = min(high, k + BLOCK)
                tops, sums = self._pooled(self._padded([self.codes(text, start, end, k, min(high, stop + ahead))], stop - k + ahead), stop - k)
                best, total = np.maximum(best, tops), total + sums
            out[i] = self._logits(best, total, np.array([end - start]))[0]
        return out

    def score(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """Calibrated probabilities of candidates."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(found) + self.shift, -30, 30)))

    def calibrate(self, z: np.ndarray, labels: np.ndarray, rounds: int = 50) -> None:
        """Slope and shift by Newton's method on the log loss, with Platt's smoothed targets."""
        n1, n0 = (labels == 1).sum(), (labels == 0).sum()
        if not n1 or not n0:
            return
        target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        x = np.stack([z, np.ones_like(z)], axis=1)
        w = np.array([1.0, 0.0])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
            w -= step
            if abs(step).max() < 1e-9:
                break
        if w[0] > 0:
            self.slope, self.shift = float(w[0]), float(w[1])


def misses_allowed(n: int, recall: float, delta: float) -> int:
    """The most misses k among ``n`` at which P(Bin(n, 1 - recall) <= k) is at most ``delta``; -1 if none."""
    tail, k = 0.0, -1
    while k + 1 <= n:
        j = k + 1
        tail += math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(1 - recall) + (n - j) * math.log(recall))
        if tail > delta:
            break
        k = j
    return k


def train_net(findings: list[tuple[str, int, int, int]], recall: float = 0.97, delta: float = 0.05, seed: int = 7) -> CharNet:
    """Train on half of the findings; a quarter calibrates the outputs, a quarter sets the threshold.

    The threshold is the highest that, with confidence 1 - ``delta`` (exact binomial), finds at least
    ``recall`` of the secrets; 0, so that every candidate counts, if the findings are too few for that.
    """
    part = np.array([hashlib.md5(f"{f[1]}:{f[0]}".encode()).digest()[0] % 4 for f in findings])
    labels = np.array([f[3] for f in findings], float)
    net = CharNet(seed)
    net.fit([CharNet.codes(*f[:3]) for f, k in zip(findings, part, strict=True) if k < 2], labels[part < 2])
    z = net.logits([f[:3] for f in findings])
    net.calibrate(z[part == 2], labels[part == 2])
    good = np.sort(net.score([f[:3] for f, k in zip(findings, part, strict=True) if k == 3 and f[3] == 1]))
    k = misses_allowed(len(good), recall, delta)
    net.threshold = float(good[k]) if 0 <= k < len(good) else 0.0
    return net


_NETS: dict[tuple[int, int, float], CharNet] = {}


def default_net(n: int = 6400, seed: int = 7, recall: float = 0.97) -> CharNet:
    """The net trained on ``n`` template findings, once in a driver process."""
    if (n, seed, recall) not in _NETS:
        _NETS[n, seed, recall] = train_net(labelled_findings(n, seed), recall, seed=seed)
    return _NETS[n, seed, recall]


def scan_texts(texts: list[str | None], net: CharNet) -> list[list[Span]]:
    """All spans of each text, sorted by start, then kind."""
    found, where = [], []
    for i, text in enumerate(texts):
        text = text or ""
        spans = base_spans(text)
        found.append(spans)
        where += [(i, text, start, end) for start, end in candidates(text, spans)]
    if where:
        for (i, _, start, end), p in zip(where, net.score([x[1:] for x in where]), strict=True):
            if p >= net.threshold:
                found[i] = sorted([*found[i], (start, 3, end)])
    return found


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, net: CharNet | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of every row: id, ``n_assign, n_access, n_hex, base_sha256, spans``.

    Spans are ``kind:start:end`` in code points, end exclusive. Null texts count as empty; whole
    texts are scanned, however long; repeated rows each give a row; an empty table gives an empty
    one. Other columns are not read. One narrow stage; the net (a few kilobytes) is broadcast.
    """
    net = net or default_net()

    def make():
        def work(row_id, text):
            found = scan_texts(text.to_pylist(), net)
            base = [[x for x in spans if x[1] < 3] for spans in found]
            counts = [[sum(x[1] == k for x in spans) for spans in base] for k in range(3)]
            return [row_id, *counts, [hashlib.sha256(as_text(b).encode()).hexdigest() for b in base], [as_text(s) for s in found]]

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", make, [id_col, text_col])


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """``text`` with overlapping spans joined and each replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, net: CharNet | None = None, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every found secret replaced by ``[SECRET]``; rows and columns stay.

    ``chars_col``, if the table has it, gets the new number of code points where a text was changed.
    A null text stays null. Edge cases otherwise as in :func:`scan_secrets`.
    """
    net = net or default_net()

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = list(texts)
            yield pd.Series([None if t is None else redact(t, s) if s else t for t, s in zip(values, scan_texts(values, net), strict=True)], dtype=object)
        tidy()

    small_batches(docs.sparkSession)
    rows = docs.select(whole_row(docs).alias("_x_row"), clean(F.col(text_col)).alias("_x_text"))
    new_text = F.col("_x_text")
    columns = []
    for c in docs.columns:
        old = F.col("_x_row").getField(c)
        if c == text_col:
            old = new_text
        elif c == chars_col:
            old = F.when(new_text.isNull() | (new_text == F.col("_x_row").getField(text_col)), old).otherwise(F.length(new_text).cast(docs.schema[c].dataType))
        columns.append(old.alias(c))
    return rows.select(*columns)
