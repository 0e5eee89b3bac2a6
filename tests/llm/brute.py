"""The operators' contracts, straightforwardly."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = {i: i + 32 for i in range(65, 91)}
WHITE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return (text or "").translate(LOWER)


def held(doc_id, mod, remainder=2):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod == remainder


def token_counts(rows, vocabulary):
    known = set(vocabulary) | {bytes([b]) for b in range(256)}
    longest = max(map(len, known))

    def pieces(word):
        n, i = 0, 0
        while i < len(word):
            i += next(k for k in range(min(longest, len(word) - i), 0, -1) if word[i : i + k] in known)
            n += 1
        return n

    out = []
    for doc_id, text in rows:
        words = WHITE.findall(text or "")
        memo = {w: pieces(b" " + w.encode()) for w in set(words)}
        out.append((doc_id, len((text or "").encode()), len(words), sum(memo[w] for w in words)))
    return out


def shingles(text, size=5):
    words = WHITE.findall(low(text))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_duplicates(rows, percent=80):
    """Rows with an id are nodes by id, those without by text."""
    sets = [(("id", d) if d is not None else ("text", t or ""), d, shingles(t)) for d, t in rows]
    parent = {node: node for node, _, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held_by = defaultdict(set)
    for k, (_, _, s) in enumerate(sets):
        for x in s:
            held_by[x].add(k)
    for k, (node, _, s) in enumerate(sets):
        for j in set().union(*(held_by[x] for x in s)) if s else ():
            other, _, t = sets[j]
            shared = len(s & t)
            if 100 * shared >= percent * len(s | t):
                parent[root(node)] = root(other)
    least = {}
    for node, d, _ in sets:
        if d is not None:
            least[root(node)] = min(d, least.get(root(node), d))
    return [(d, len(s), least.get(root(node))) for node, d, s in sets]


def without_near_duplicates(rows, percent=80):
    """One row of each group of texts with words, the least id, null ids last: the ids that stay."""
    sets = [(d, shingles(t)) for d, t in rows]
    group = list(range(len(sets)))
    for k, (_, s) in enumerate(sets):
        for j, (_, t) in enumerate(sets):
            if s and 100 * len(s & t) >= percent * len(s | t):
                old, new = group[j], group[k]
                group = [new if g == old else g for g in group]
    out = []
    for g in set(group):
        out.append(min(((d is None, d or 0) for (d, _), h in zip(sets, group) if h == g)))
    return sorted(None if none else d for none, d in out if not none) + [None] * sum(none for none, _ in out)


def near_links(rows, percent=80):
    sets = [(d, shingles(t)) for d, t in rows]
    out = []
    for k, (d, s) in enumerate(sets):
        linked = [j for j, (_, t) in enumerate(sets) if j != k and s and 100 * len(s & t) >= percent * len(s | t)]
        equal = [sets[j][0] for j in linked if sets[j][1] == s]
        out.append((d, len(s), min((x for x in [d, *equal] if x is not None), default=None), 1 + len(equal), len(linked)))
    return out


def exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    seen = Counter()
    for d, t in rows:
        ids = groups[t or ""]
        keep = max((i for i in ids if i is not None), default=None)
        stays = d == keep and not seen[t or ""]
        seen[t or ""] += stays
        out.append((d, keep, len(ids), stays, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def contamination(rows, items, window=13):
    runs = defaultdict(set)
    sizes = set()
    for item, text in items:
        words = ALNUM.findall(low(text))
        if words:
            n = min(window, len(words))
            sizes.add(n)
            for i in range(len(words) - n + 1):
                runs[tuple(words[i : i + n])].add(item)
    out = []
    for d, text in rows:
        words = ALNUM.findall(low(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in runs:
                    hit |= set(range(i, i + n))
                    found |= runs[tuple(words[i : i + n])]
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def phrases(text, table):
    words = ALNUM.findall(low(text))
    out = []
    for phrase, label in table:
        parts = phrase.split()
        out += [(i, -(i + len(parts)), 4, label) for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
    return sorted(out)


def licenses(text, rules):
    words = ALNUM.findall(low(text))
    norm = " " + "".join(w + " " for w in words)
    spans = []
    for r in rules:
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm):
            start = norm[: m.start()].count(" ") - 1
            spans.append((start, -(start + len(m[0].split())), r.priority, r.label))
    spans.sort()
    kept = []
    for k, (start, to, priority, label) in enumerate(spans):
        if not any(-t >= -to and p <= priority for _, t, p, _ in spans[:k]):
            kept.append((start, to, priority, label))
    return kept


def word_model(rows, mod=7):
    tokens = [(d, [*WHITE.findall(low(t)), None]) for d, t in rows]
    counts = Counter(w for d, ws in tokens if not held(d, mod) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [
        (d, held(d, mod), len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in tokens
    ]


def segmentations(word, pieces):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            for rest in segmentations(word[k:], pieces):
                yield [word[:k], *rest]


def secrets(text):
    text = text or ""
    kinds = (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    )
    out = [(m.start(), k, m.end(), name) for k, (name, p, f, ok) in enumerate(kinds) for m in re.finditer(p, text, f) if ok(m)]
    return [(name, s, e) for s, _, e, name in sorted(out)]
