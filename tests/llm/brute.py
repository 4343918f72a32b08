"""Plain versions of the operators' results, for small inputs."""

import hashlib
import re
import zlib
from itertools import combinations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def licenses(text, base):
    w = WORD.findall((text or "").translate(LOW))
    starts, labels = [], set()
    for label, phrase in base:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def contamination(text, items, window=10):
    w = WORD.findall((text or "").translate(LOW))
    hit, found = set(), set()
    for item, it in items:
        x = WORD.findall((it or "").translate(LOW))
        n = min(window, len(x))
        for s in range(len(x) - n + 1) if n else ():
            for d in range(len(w) - n + 1):
                if w[d : d + n] == x[s : s + n]:
                    hit |= set(range(d, d + n))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def shingle_set(text, n):
    w = SPACED.findall((text or "").translate(LOW))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard(rows, n, percent):
    """[(id, size, component)] for rows (id, text)."""
    sets = [shingle_set(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        o = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
            up[top(b)] = top(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return [(i, len(s), least.get(top(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def substrings(rows, width):
    """[(id, words, removed, sha)] for rows (id, text), windows of words in a smaller id."""
    first = {}
    for i, t in rows:
        w = SPACED.findall(t or "")
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = SPACED.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def suffixes(rows, width, keep="none"):
    """[(id, bytes, removed, spans, sha)]; keep="first" spares the first start by (id, place)."""
    where = {}
    for n, (i, t) in enumerate(rows):
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            where.setdefault(b[k : k + width], []).append((i, k, n))
    out = []
    for n, (i, t) in enumerate(rows):
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - width + 1):
            at = where[b[k : k + width]]
            if len(at) > 1 and (keep == "none" or (i, k, n) != min(at)):
                gone[k : k + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out


def pieces(rows, tokenizer, capacity=4096):
    out = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            one = ids[k : k + capacity]
            out.append((i, k // capacity, k, len(one), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in one))))
    return out
