"""Plain definitions that the operators are held against."""

import hashlib
import re


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def components(texts):
    """{id: (set size, smallest id reachable)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in texts}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a1, b1 = top(a), top(b)
                up[max(a1, b1)] = min(a1, b1)
    return {i: (len(sets[i]), top(i)) for i in ids}


def dedup(texts, length=100):
    """{id: (bytes, removed, runs, digest of the rest)}."""
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


PII = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
SECRETS = (("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))


def keeps(kind, m):
    d = re.sub("[^0-9]", "", m[0])
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(d) <= 15
    if kind == "assign":
        return len(m[1]) >= 6
    return len(m[0]) >= {"access": 20, "hex": 24}.get(kind, 0)


def spans(text, kinds):
    found = sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(kinds) for m in re.finditer(p, text or "") if keeps(k, m))
    return [f"{kinds[i][0]}:{a}:{b}" for a, i, b in found]
