"""Plain Python versions of the text operators, for small inputs."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from netresil.llm.token_counts import byte_letters


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def spaced(text: str | None) -> list[str]:
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def alnum(text: str | None) -> list[str]:
    return [w for w in "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in lower(text or "")).split(" ") if w]


def runs(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def remove_repeats(docs, window):
    """[(id, text)] -> {id: (n_words, removed flags)}"""
    seen, out = set(), {}
    for i, text in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        w = spaced(text)
        gone = [False] * len(w)
        for p, r in enumerate(runs(w, window)):
            if r in seen:
                gone[p : p + window] = [True] * window
            seen.add(r)
        out[i] = w, gone
    return out


def contamination(text, items, window):
    w = alnum(text)
    hit, found = set(), set()
    for item, body in items:
        v = alnum(body)
        for pattern in runs(v, window) if len(v) >= window else [tuple(v)] if v else []:
            for p, r in enumerate(runs(w, len(pattern))):
                if r == pattern:
                    hit.update(range(p, p + len(pattern)))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


def shingles(text, n):
    w = spaced(lower(text or ""))
    return frozenset(runs(w, n)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(docs, n, percent):
    sets = {i: shingles(t, n) for i, t in docs}
    part = {i: i for i in sets}

    def find(a):
        while part[a] != a:
            a = part[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                r, s = find(a), find(b)
                part[max(r, s)] = min(r, s)
    return {i: (len(sets[i]), find(i)) for i in ids}


def unigram(docs):
    count = Counter()
    for _, text in docs:
        count.update(spaced(lower(text or "")))
        count[None] += 1
    total, kinds = sum(count.values()), len(count)

    def score(text):
        tokens = [*spaced(lower(text or "")), None]
        base = sum(math.log10((count[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in tokens)
        return len(tokens), sum(count[t] > 0 for t in tokens), total, base

    return score


class ContextTree:
    """PPM with method C, byte by byte."""

    def __init__(self, texts, order):
        self.order, self.seen = order, defaultdict(Counter)
        for text in texts:
            data = b"\n" * order + lower(text).encode()
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.seen[data[i - k : i]][data[i]] += 1

    def bits(self, text):
        data, total = b"\n" * self.order + lower(text).encode(), 0.0
        for i in range(self.order, len(data)):
            for k in range(self.order, -1, -1):
                after = self.seen.get(data[i - k : i])
                if after is None:
                    continue
                n, d = sum(after.values()), len(after)
                if after[data[i]]:
                    total += math.log2((n + d) / after[data[i]])
                    break
                total += math.log2((n + d) / d)
            else:
                total += 8.0
        return total


def alignment(text, plain, model):
    """Both tokenizations of a space and the text, every overlapping and every linked pair, and the groups."""
    none = {"n_a": 0, "n_b": 0, "n_overlaps": 0, "groups": [], "links": []}
    if not text:
        return none
    body = (" " + text).encode()
    letters = byte_letters()
    a = [(i, bytes(letters[c] for c in plain.id_to_token(i))) for i in plain.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()) for i in model.encode(text)]
    if any(b"".join(x for _, x in side) != body for side in (a, b)):
        return none
    spans = []
    for side in (a, b):
        at, out = 0, []
        for i, x in side:
            out.append((at, at + len(x), i))
            at += len(x)
        spans.append(out)
    n_overlaps, first, links = 0, 0, []
    for s, e, i in spans[0]:
        while spans[1][first][1] <= s:
            first += 1
        for s2, e2, j in spans[1][first:]:
            if s2 >= e:
                break
            n_overlaps += 1
            if e == e2:
                links.append((i, j))
    cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups = [([], []) for _ in cuts]
    for side in (0, 1):
        at = 0
        for _, e, i in spans[side]:
            while e > cuts[at]:
                at += 1
            groups[at][side].append(i)
    return {"n_a": len(a), "n_b": len(b), "n_overlaps": n_overlaps, "groups": groups, "links": links}


def told(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def ranking(docs, items, k):
    """(item, rank, document, score) by scoring every document for every item; null ids last."""
    held = [(i, Counter(alnum(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in items:
        scores = []
        asked = set(alnum(text))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c in held) + 1))) for t in asked}
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return out
