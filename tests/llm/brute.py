"""Brute-force versions of the operators' contracts, in plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

LOW = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOW)].append(i)
    out = []
    for i, t in rows:
        n = (t or "").translate(LOW)
        ids = [x for x in groups[n] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[n]), i == keep, sha(n)))
    return Counter(out)


def targets(rows, weights=(3, 1, 2), budget=1.5, most=2):
    size = defaultdict(int)
    for _, s, t in rows:
        size[s] += len(SPACE.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed, open_ = budget * sum(size.values()), {}, set(names)
    while open_:
        left, w = total - sum(fixed.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > most * size[s]]
        if not over:
            return {**fixed, **{s: left * weight[s] / w for s in open_}}, size
        for s in over:
            fixed[s] = float(most * size[s])
            open_.discard(s)
    return fixed, size


def luhn(d):
    t = 0
    for i, c in enumerate(d[::-1]):
        v = int(c) * (1 + i % 2)
        t += v if v < 10 else v - 9
    return t % 10 == 0


def personal(t):
    t = t or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15))
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, t) if ok(m[0])]


def secrets(t):
    t = t or ""
    kinds = (("assign", r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
             ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24))
    found = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m)]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def license_base(t):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    places = [(i, label) for p, label in phrases.items() for q in [p.split()] for i in range(len(words)) if words[i:i + len(q)] == q]
    return len(words), sorted(places)


def fingerprint(t, k=4, distinct=False):
    import xxhash
    w = SPACE.findall((t or "").translate(LOW))
    sh = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])
    sh = set(sh) if distinct else sh
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def conversation(turns):
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
    said = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    return len(turns), sha(said), len(loss), sha(loss)
