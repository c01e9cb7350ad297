"""Plain versions of the operators, for small inputs."""

import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) >= k:
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
    return {tuple(words)} if words else set()


def near(rows, k, per_cent):
    """{row number: (size, component)} by all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a = len(sets[i] & sets[j])
            if a and 100 * a >= per_cent * (len(sets[i]) + len(sets[j]) - a):
                up[root(i)] = root(j)
    least = {}
    order = lambda d: -(1 << 63) if d is None else d
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d, key=order)
    return [(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)]


def repeats(rows, length):
    """[(id, bytes, removed, spans, sha256)]: each row against rows with smaller ids and itself."""
    order = lambda d: -(1 << 63) if d is None else d
    data = [(order(d), (t or "").encode()) for d, t in rows]
    out = []
    for (d, _), (key, b) in zip(rows, data):
        before = {x[s : s + length] for k, x in data if k < key for s in range(len(x) - length + 1)}
        gone, seen = bytearray(len(b)), set()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in before or w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def left_over(rows, length):
    """[(id, text)]: what ``repeats`` leaves, characters kept whole if any of their bytes stays."""
    data = [(d, (t or "").encode()) for d, t in rows]
    seen_in = {}
    for d, b in data:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            seen_in[w] = min(seen_in.get(w, d), d)
    out = []
    for d, b in data:
        gone, own = bytearray(len(b)), set()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if seen_in[w] < d or w in own:
                gone[s : s + length] = b"\1" * length
            own.add(w)
        text, at = "", 0
        for c in b.decode():
            n = len(c.encode())
            if not all(gone[at : at + n]):
                text += c
            at += n
        out.append((d, text))
    return out


def best_count(word, score, unknown):
    """Fewest tokens of the best segmentation of one pre-token."""
    best = [(0.0, 0)] + [None] * len(word)
    longest = max(map(len, score))
    for e in range(1, len(word) + 1):
        options = [(best[s][0] + score[word[s:e]], best[s][1] - 1) for s in range(max(0, e - longest), e) if word[s:e] in score]
        if word[e - 1] not in score:
            n = len(word[e - 1].encode())
            options.append((best[e - 1][0] + unknown * n, best[e - 1][1] - n))
        best[e] = max(options)
    return -best[-1][1]


M64 = (1 << 64) - 1


def mixed(h):
    h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & M64
    h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 & M64
    return h ^ h >> 33


def plain_cut(word, ranks, dropout, seed, doc_id, place):
    """Pieces of one pre-token: of all adjacent pairs not yet skipped the lowest id merges, unless its draw skips it."""
    occurrence = mixed(mixed((doc_id + seed) & M64) + place & M64)
    key = (seed * 0x9E3779B97F4A7C15 + occurrence * 0xC2B2AE3D27D4EB4F + 1) & M64
    key = (key ^ key >> 31) * 0xFF51AFD7ED558CCD & M64
    # a space mark of the text has no piece
    parts = [(i, c if i else "\u2581") for i, c in enumerate([" ", *word.replace("\u2581", "\ue000")])]
    skipped = set()
    while True:
        options = []
        for (a, x), (b, y) in zip(parts, parts[1:]):
            if x + y in ranks and (a, b, x, y) not in skipped:
                options.append((ranks[x + y], a, b, x, y))
        if not options:
            return [x.replace("\ue000", "\u2581") if "\ue000" in x else x for _, x in parts]
        rank, a, b, x, y = min(options)
        h = (key + (a << 20 | b - a) * 0x165667B19E3779F9 + rank * 0x27D4EB2F165667C5) & M64
        h = (h ^ h >> 32) * 0xC4CEB9FE1A85EC53 & M64
        if (h ^ h >> 29) >> 32 < int(dropout * (1 << 32)):
            skipped.add((a, b, x, y))
            continue
        parts = [(i, x + y if i == a else t) for i, t in parts if i != b]
