"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SOLID = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(LOWER))


def decontaminated(docs, items):
    windows = {}
    for item, text in items:
        w = words(text, SOLID)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for key, text in docs:
        w, hit, found = words(text, SOLID), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        names = sorted(str(i) for i in found if i is not None)
        out.append((key, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def shingle_sets(texts):
    out = []
    for t in texts:
        w = words(t)
        n = min(5, len(w))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    return out


def near(docs):
    sets = shingle_sets([t for _, t in docs])
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(key)
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return [(key, len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(docs)]


ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
    r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def secret_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def base_scores(docs):
    """{key: (held_out, n_tokens, n_known, train_tokens, base_score)}"""
    split = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in docs}
    tokens = {k: [*words(t), None] for k, t in docs}
    count = Counter(x for k, _ in docs if not split[k] for x in tokens[k])
    total, kinds = sum(count.values()), len(count)
    share = lambda x: math.log10((count[x] + 0.1) / (total + 0.1 * (kinds + 1)))
    return {
        k: (split[k], len(t), sum(count[x] > 0 for x in t), total, sum(map(share, t))) for k, t in tokens.items()
    }
