"""Secret scans: patterns against plain scanning, the blocked net against the direct one, its gradients, memory."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from millrace.llm import secrets

WORD = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def plain_runs(text, begins, alphabet, least):
    """Leftmost runs of ``alphabet`` after ``begins``, character by character."""
    out, at = [], 0
    while at < len(text):
        if text.startswith(begins, at):
            end = at + len(begins)
            while end < len(text) and text[end] in alphabet:
                end += 1
            if end > at + len(begins) or begins == "":
                if end - at >= least:
                    out.append((at, end))
                if end > at:
                    at = end
                    continue
        at += 1
    return out


def plain_assign(text):
    out, at = [], 0
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    while at < len(text):
        hit = None
        for key in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not low.startswith(key, at):
                continue
            for quote in ([1, 0] if text[at + len(key) : at + len(key) + 1] in ('"', "'") and at + len(key) < len(text) else [0]):
                i = at + len(key) + quote
                while text[i : i + 1] == " ":
                    i += 1
                if text[i : i + 1] not in (":", "="):
                    continue
                i += 1
                while text[i : i + 1] == " ":
                    i += 1
                if text[i : i + 1] in ('"', "'") and i < len(text):
                    i += 1
                end = i
                while end < len(text) and text[end] in WORD:
                    end += 1
                if end > i:
                    hit = (at, end, end - i)
                    break
            if hit:
                break
        if hit:
            if hit[2] >= 6:
                out.append(hit[:2])
            at = hit[1]
        else:
            at += 1
    return out


def test_base_patterns_against_plain_scanning():
    r = random.Random(5)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", "API_KEY", '"', "'", " ", "  ", ":", "=", "abc", "abcdef", "hunter22", "AKIA", "AKIAABCDEFGHIJ", "0123456789abcdef", "deadbeef", "é", "\n", "x.y-z", "Z9", "K"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        expected = [(s, 0, e) for s, e in plain_assign(text)]
        expected += [(s, 1, e) for s, e in plain_runs(text, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20)]
        expected += [(s, 2, e) for s, e in plain_runs(text, "", set("0123456789abcdef"), 24)]
        assert secrets.base_spans(text) == sorted(expected), text


def test_candidates_reach_beyond_the_patterns():
    text = "sk_live_0123456789abcdef01234567Zq9xYtR pwd=Xy7!kk92 Authorization: Basic dXNlcjpw password=abcdef012345678901234567"
    found = {text[s:e] for s, e in secrets.candidates(text, secrets.base_spans(text))}
    assert {"sk_live_0123456789abcdef01234567Zq9xYtR", "Xy7!kk92", "dXNlcjpw"} <= found
    assert not any("abcdef012345678901234567" in x for x in found)
    assert secrets.candidates("a" * 30, []) == [(0, 30)] and secrets.candidates("9" * 30, []) == [(0, 30)]


def test_blocks_change_nothing(monkeypatch):
    net = secrets.default_net()
    rows = [f[:3] for f in secrets.labelled_findings(120, 31)]
    rows += [("x" * 40 + "aB3" * 400 + " y", 40, 1240), ("aB3" * 200, 0, 600), ("q " + "Z" * 333, 2, 335)]
    direct = np.concatenate([net.forward([secrets.CharNet.codes(*x)])[0] for x in rows])
    for block, lot in ((1 << 12, 1 << 15), (16, 1 << 15), (7, 50), (300, 400)):
        monkeypatch.setattr(secrets, "BLOCK", block)
        monkeypatch.setattr(secrets, "LOT", lot)
        assert 1 / (1 + np.exp(-net.logits(rows))) == pytest.approx(direct, abs=1e-12)


def test_gradients():
    net = secrets.CharNet(3, dim=4, filters=3)
    found = secrets.labelled_findings(6, 8)
    rows, y = [secrets.CharNet.codes(*f[:3]) for f in found], np.array([f[3] for f in found], float)

    def loss():
        p = net.forward(rows)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = np.random.default_rng(0)
    for name, d in net.gradients(rows, y).items():
        for _ in range(6):
            at = tuple(g.integers(0, n) for n in net.p[name].shape)
            if name == "E":
                at = (int(g.choice(np.concatenate(rows))), at[1])
            old = net.p[name][at]
            net.p[name][at] = old + 1e-6
            up = loss()
            net.p[name][at] = old - 1e-6
            down = loss()
            net.p[name][at] = old
            assert d[at] == pytest.approx((up - down) / 2e-6, abs=2e-5)


def test_long_candidates_in_little_memory():
    net = secrets.default_net()
    run = (hashlib.sha256(b"x").hexdigest().upper() + "q") * 60_000  # 3.9 million characters
    texts = ["see " + run + " end", *["key=aB3dE6gH9kLm2nOp5qRs8t"] * 63, "b " + run[:300_000]]
    tracemalloc.start()
    spans = secrets.scan_texts(texts, net)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert spans[0] == [(4, 3, 4 + len(run))] and all(spans[1:64]) and peak < 200e6


def test_recall_bound():
    from math import comb

    for n in (50, 98, 99, 400, 900):
        k = secrets.misses_allowed(n, 0.97, 0.05)
        tail = lambda m: sum(comb(n, j) * 0.03**j * 0.97 ** (n - j) for j in range(m + 1))
        assert (k < 0 or tail(k) <= 0.05) and tail(k + 1) > 0.05
    net = secrets.default_net()
    test = secrets.labelled_findings(2000, 4242)
    y, p = np.array([f[3] for f in test]), net.score([f[:3] for f in test])
    assert (p[y == 1] >= net.threshold).mean() >= 0.97 and (p[y == 0] >= net.threshold).mean() < 0.02


PLAIN = (
    "We think the key takeaways are many.", "The compass pointed north-west.", "The turkey sandwiches were good.", "The password requirements changed.", "monkeys-and-donkeys like bananas",
    "https://github.com/apache/spark/blob/master/README.md", "My password is important to me.", "the bearer certificate was lost", "Key: answers follow.", "login: required today", "The basic elements of passphrases",
    "see AbstractSingletonProxyFactoryBean for more", "the auth module passes, the token counter does not", "a passing keyboard player with credentials", "Your login is somewhere, the secret is patience.",
)


def test_plain_words_are_no_secrets():
    net = secrets.default_net()
    for text, spans in zip(PLAIN, secrets.scan_texts(list(PLAIN), net), strict=True):
        assert secrets.redact(text, [s for s in spans if s[1] == 3]) == text
    said = ["pwd=Xy7!kk92", "Authorization: Basic dXNlcjpwYXNz", "token Bearer eyJhbGciOiJIUzI1NiJ9abc", "dbKey=9fKq27LmPz", "MY_KEY: 7hGf92kLmQ"]
    assert all("[SECRET]" in secrets.redact(t, s) for t, s in zip(said, secrets.scan_texts(said, net), strict=True))


def test_false_alarms_over_prose():
    """100,000 words that the net has not seen, credential words among them: one finding at most; with identifiers and paths, six."""
    r, words, net = random.Random(1), secrets.WORDS[1::2], secrets.default_net()
    lead = [f"{k}{v}" for k in ("key", "token", "secret", "pass", "login", "bearer", "auth", "password", "credentials") for v in ("", " is", " was", "s")]
    named = (lambda: "/".join(r.choices(words, k=4)) + ".md", lambda: "https://www." + "/".join(r.choices(words, k=4)), lambda: "".join(w.capitalize() for w in r.choices(words, k=4)), lambda: "-".join(r.choices(words, k=4)))
    prose, dense = [], []
    for _ in range(2500):
        text = r.choices(words, k=40)
        for _ in range(4):
            text[r.randrange(40)] = r.choice(lead)
        prose.append(" ".join(text) + ".")
        for make in named:
            if r.random() < 0.5:
                text[r.randrange(40)] = make()
        dense.append(" ".join(text) + ".")
    count = lambda texts: sum(s[1] == 3 for spans in secrets.scan_texts(texts, net) for s in spans)
    assert count(prose) <= 1 and count(dense) <= 6
    # a plain word behind a sign of assignment is the hard case: about one in a hundred is taken
    assert count([f"{r.choice(words)} {k}: {r.choice(words)} {r.choice(words)}" for k in ("key", "pass", "login", "credentials", "auth") for _ in range(400)]) <= 40
