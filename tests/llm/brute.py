"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def jaccard(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(parent, i)) for i, s in sets.items()}


def repeats(rows, width):
    texts = [(i, words(t)) for i, t in rows]
    seen = collections.Counter(tuple(x[k : k + width]) for _, x in texts for k in range(len(x) - width + 1))
    out = {}
    for i, x in texts:
        gone = [False] * len(x)
        for k in range(len(x) - width + 1):
            if seen[tuple(x[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        kept = " ".join(w for w, g in zip(x, gone) if not g)
        out[i] = (len(x), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def digest(spans, kinds):
    return hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans)).encode()).hexdigest()


PII = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii(text, kinds):
    out, n = [], [0] * 4
    for k, p in enumerate(PII):
        for m in p.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
                n[k] += 1
    return (*n, digest(out, kinds))


def _any(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_any(k) for k in ("password", "passwd", "secret", "token", "api_?key"))
SECRETS = [re.compile(rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]


def secrets(text, kinds):
    out, n = [], [0] * 3
    for k, p in enumerate(SECRETS):
        for m in p.finditer(text or ""):
            if (len(m[2]) >= 8) if k == 0 else len(m[0]) >= (0, 16, 32)[k]:
                out.append((m.start(), k, m.end()))
                n[k] += 1
    return (*n, digest(out, kinds))


def text_counts(text):
    t = text or ""
    w = words(t)
    win = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)
