"""Plain Python versions of the operators' contracts, on small tables."""

from __future__ import annotations

import base64
import collections
import hashlib
import re

from doclith.llm import pii, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def quality(text):
    text, w = text or "", words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))


def stop_words(text):
    return sum(x in quality_rules.STOP_WORDS for x in re.split(r"[^a-zà-öø-ÿœß]+", (text or "").lower()))


def spans(text):
    out = []
    for n, kind in enumerate(pii.KINDS):
        for m in re.finditer(pii.PLAIN[kind], text or ""):
            digits = [int(c) for c in m.group() if c.isdigit() and c.isascii()]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, m.end()))
    return [f"{pii.KINDS[n]}:{a}:{b}" for a, n, b in sorted(out)]


def shingles(text, k):
    w = words(lowered(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def components(rows, k, percent):
    """For (id, text): id -> (set size, smallest id that links reach). Ids are unique."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def rule(url, rules):
    """host, path, rule, verdict."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = lowered(re.match(r"[^/?#]*", rest, re.S).group())
    path = re.match(r"[^?#]*", rest[len(host) :], re.S).group()
    best = None
    for verdict, text in rules:
        name, start = text.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(text) > len(best[0])):
            best = (text, verdict)
    return (host, path, *(best or (None, None)))


def warc(rows):
    """For (id, html): id -> payload bytes, digest, type, refers_to."""
    first = {}
    for i, h in rows:
        first[h or ""] = min(first.get(h or "", i), i)
    out = {}
    for i, h in rows:
        body = (h or "").encode()
        f = first[h or ""]
        out[i] = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if f == i else "revisit", None if f == i else f)
    return out


def targets(sizes, weights=(1, 2, 3), most=3):
    """source -> size to source -> target, by resharing until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total >= most * sizes[s]}
        if not above:
            return out | {s: left * weight[s] / total for s in free}
        for s in above:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in above)
        free -= above
    return out


def coverage(item, text, least=4):
    """Greedy tiling the plain way: the longest match first, marked, again and again."""
    free = [[True] * len(item), [True] * len(text)]
    covered = 0
    while True:
        best = (0, 0, 0)
        for p in range(len(text)):
            for q in range(len(item)):
                n = 0
                while q + n < len(item) and p + n < len(text) and free[0][q + n] and free[1][p + n] and item[q + n] == text[p + n]:
                    n += 1
                best = max(best, (n, -p, -q))
        n, p, q = best
        if n < least:
            return covered / len(item)
        for j in range(n):
            free[0][j - q] = free[1][j - p] = False
        covered += n
