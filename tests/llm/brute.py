"""Plain forms of the operators, for small inputs: straight from the definitions."""

import collections
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def words(t):
    return WORD.findall(t or "")


def simhash(text):
    w = words(lower_ascii(text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def simhash_components(docs):
    """component id (smallest id, NULL if there is none) of each (id, text), in order."""
    fps = [simhash(t) for _, t in docs]
    n = len(fps)
    comp = components(n, [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    low = collections.defaultdict(list)
    for (i, _), c in zip(docs, comp):
        if i is not None:
            low[c].append(i)
    return [(i, f"{f:016x}", min(low[c], default=None)) for (i, _), f, c in zip(docs, fps, comp)]


def _common(a, b, n_words):
    """Plain patience alignment of two line lists: pairs of places. Equal heads, then equal tails; in between the lines that
    occur once on both sides (else the first with the first, and so on), a longest ascending chain of them, and so on."""
    if not a or not b:
        return []
    if a[0][1] == b[0][1]:
        return [(a[0][0], b[0][0])] + _common(a[1:], b[1:], n_words)
    if a[-1][1] == b[-1][1]:
        return _common(a[:-1], b[:-1], n_words) + [(a[-1][0], b[-1][0])]
    mine, theirs = collections.defaultdict(list), collections.defaultdict(list)
    for k, (_, x) in enumerate(a):
        if n_words(x):
            mine[x].append(k)
    for k, (_, x) in enumerate(b):
        theirs[x].append(k)
    pairs = sorted((p[0], theirs[x][0]) for x, p in mine.items() if len(p) == 1 == len(theirs.get(x, ())))
    pairs = pairs or sorted(m for x, p in mine.items() for m in zip(p, theirs.get(x, ())))
    if not pairs:
        return []
    long = []  # length of the longest chain that ends with each pair
    for _, q in pairs:
        long.append(1 + max((n for n, (_, r) in zip(long, pairs) if r < q), default=0))
    at = max(k for k, n in enumerate(long) if n == max(long))
    chosen = [at]
    while long[at] > 1:
        at = max(k for k in range(at) if long[k] == long[at] - 1)
        chosen.append(at)
    out, i, j = [], 0, 0
    for k, q in [pairs[c] for c in reversed(chosen)]:
        out += _common(a[i:k], b[j:q], n_words) + [(a[k][0], b[q][0])]
        i, j = k + 1, q + 1
    return out + _common(a[i:], b[j:], n_words)


def dedup_text(docs, min_words=30, rare=8):
    """The texts after the stated rule: runs of lines of ``min_words`` words that a document with a smaller id holds go. Documents
    that share a line of at most ``rare`` rows, or of which one owns (has first) a line or smallest run of the other, are aligned;
    if the aligned lines have ``min_words`` words, those go, with the blank ones between neighbours."""
    lines = [[x.strip() for x in t.split("\n")] if t is not None else [] for _, t in docs]
    n_words = lambda x: len(x.split())

    def smallest_runs(ls):
        """Every run that has enough words but not without its last line, or not without its first; each line by itself."""
        for i in range(len(ls)):
            if n_words(ls[i]):
                yield (i, i)
            for j in range(i, len(ls)):
                w = sum(map(n_words, ls[i:j + 1]))
                if w >= min_words:
                    if n_words(ls[i]) and n_words(ls[j]) and (w - n_words(ls[j]) < min_words or w - n_words(ls[i]) < min_words):
                        yield (i, j)
                    if w - n_words(ls[i]) >= min_words:
                        break

    holders, places = collections.defaultdict(list), []
    for k, (i, t) in enumerate(docs):
        runs = {tuple(lines[k][p:q + 1]) for p, q in smallest_runs(lines[k])} if i is not None else set()
        places.append(runs)
        for r in runs:
            holders[r].append(k)
    out = []
    for k, (i, t) in enumerate(docs):
        if t is None or i is None:
            out.append(t)
            continue
        mine, gone, partners = lines[k], set(), set()
        for r in places[k]:
            first = min(docs[h][0] for h in holders[r])
            if first < i:
                partners |= {min((h for h in holders[r] if docs[h][0] == first), key=lambda h: h)}
                if len(r) == 1 and len(holders[r]) <= rare:
                    partners |= {h for h in holders[r] if docs[h][0] < i}
        for j, other in enumerate(docs):
            if other[0] is None or other[0] >= i:
                continue
            for p in range(len(mine)):
                for q in range(len(lines[j])):
                    if p and q and mine[p - 1] == lines[j][q - 1]:
                        continue
                    n = 0
                    while p + n < len(mine) and q + n < len(lines[j]) and mine[p + n] == lines[j][q + n]:
                        n += 1
                    if sum(map(n_words, mine[p:p + n])) >= min_words:
                        full = [x for x in range(p, p + n) if mine[x]]
                        gone.update(range(full[0], full[-1] + 1))
        for j in partners:
            pairs = _common(list(enumerate(mine)), list(enumerate(lines[j])), n_words)
            if sum(n_words(mine[x]) for x, _ in pairs) < min_words:
                continue
            block = []
            for x, y in [*pairs, (None, None)]:
                if block and (x, y) != (block[-1][0] + 1, block[-1][1] + 1):
                    full = [z for z, _ in block if n_words(mine[z])]
                    gone.update(range(full[0], full[-1] + 1) if full else ())
                    block = []
                block.append((x, y))
        out.append("\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone))
    return out


def crc_ids(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
