"""Plain Python statements of the contracts, for small inputs."""

import re

LOW = {i: i + 32 for i in range(65, 91)}
WS = re.compile(r"[^\x20\x09-\x0D]+")
BW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WS.findall((text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def near(docs):
    """{position: (n, component, kept)} by all pairs."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for i, s in enumerate(sets):
        for h in s:
            index.setdefault(h, []).append(i)
    seen = set()
    for ids in index.values():
        for a in range(len(ids)):
            for b in ids[a + 1:]:
                if (ids[a], b) in seen:
                    continue
                seen.add((ids[a], b))
                x, y = sets[ids[a]], sets[b]
                if 100 * len(x & y) >= 75 * len(x | y):
                    parent[find(b)] = find(ids[a])
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(docs)]


def quality(text):
    text = text or ""
    w = WS.findall(text)
    lines = [x for x in text.split("\n") if WS.search(x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    hit = {k for v in seen.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed)
