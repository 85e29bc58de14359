"""Plain restatements of the operators, for small inputs."""

from collections import defaultdict

LOWER = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def shingle_set(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(rows):
    """doc_id -> (set size, component) of rows (doc_id, text)."""
    sets = {d: shingle_set(t) for d, t in rows}
    index, up = defaultdict(list), {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for d in sorted(sets):
        shared = defaultdict(int)
        for s in sets[d]:
            for other in index[s]:
                shared[other] += 1
            index[s].append(d)
        for other, n in shared.items():
            if 100 * n >= 80 * (len(sets[d]) + len(sets[other]) - n):
                a, b = root(d), root(other)
                up[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def repeated(rows, size=13):
    """doc_id -> (words, removed, kept text) of rows (doc_id, text)."""
    first = {}
    for d, t in sorted(rows):
        w = words(t)
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), d)
    out = {}
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def tiled(doc, item, least_match=5):
    """Greedy tiling of two lists of words: the longest free match first, then the leftmost."""
    free_doc, free_item, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and free_doc[a + n] and free_item[b + n]:
                    n += 1
                best = max(best, (n, -a, -b))
        n, a, b = best[0], -best[1], -best[2]
        if n < least_match or not n:
            return sorted(out)
        free_doc[a : a + n], free_item[b : b + n] = [False] * n, [False] * n
        out.append((a, b, n))


def leaks(rows, items, least=0.5):
    """(doc_id, item_id) -> (covered words, tiles) of rows and items (id, text)."""
    strip = lambda t: "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (t or "").lower()).split()
    out = {}
    for d, text in rows:
        for i, item in items:
            w = strip(item)
            if w:
                found = tiled(strip(text), w, min(5, len(w)))
                covered = sum(x[2] for x in found)
                if covered >= least * len(w):
                    out[d, i] = (len(w), covered, found)
    return out


def languages(rows):
    """key -> (language, posterior, text language, kept) of rows (key, text, declared, host, suffix)."""
    import math

    def pairs(text):
        raw = b" " + (text or "").lower().encode("utf-8", "replace") + b" "
        raw = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in raw)
        return [raw[i : i + 2] for i in range(len(raw) - 1) if raw[i : i + 2] != b"  "]

    counts = defaultdict(lambda: defaultdict(int))
    for _, text, declared, _, _ in rows:
        if declared is not None:
            for p in pairs(text):
                counts[declared][p] += 1
    names = sorted(k for k, v in counts.items() if sum(v.values()) >= 200)
    seen = sorted({p for k in names for p in counts[k]})
    whole = {k: sum(counts[k].values()) + 0.5 * (len(seen) + 1) for k in names}
    log = {k: defaultdict(lambda k=k: math.log(0.5 / whole[k]), {p: math.log((counts[k].get(p, 0) + 0.5) / whole[k]) for p in seen}) for k in names}
    scored = []
    for key, text, declared, host, suffix in rows:
        found = pairs(text)
        score = [sum(log[k][p] for p in found) for k in names]
        best = sum(max(sum(log[k][p] for p in found[i : i + 64]) for k in names) for i in range(0, len(found), 64))
        by_text = score.index(max(score)) if found else None
        scored.append((key, score, -len(found) * math.log(len(seen) + 1) - best, by_text, declared if declared in names else None, host or "", suffix or ""))
    n = len(names)
    tally = defaultdict(lambda: [0.0] * n)
    for _, _, _, by_text, said, host, suffix in scored:
        for k in ("all", ("said", said), ("suffix", suffix), ("host", suffix, host)):
            if by_text is not None:
                tally[k][by_text] += 1
    smooth = lambda own, wide: [(x + 20 * p) / (sum(own) + 20) for x, p in zip(own, wide)]
    wide = [(x + 0.5) / (sum(tally["all"]) + 0.5 * n) for x in tally["all"]]
    said = {s: [x + 0.5 for x in tally["said", s]] for s in [None, *names]}
    column = [sum(said[s][i] for s in said) for i in range(n)]
    out = {}
    for key, score, unknown, by_text, declared, host, suffix in scored:
        prior = smooth(tally["host", suffix, host], smooth(tally["suffix", suffix], wide))
        logs = [0.25 * t + math.log(p) + math.log(said[declared][i] / column[i]) for i, (t, p) in enumerate(zip(score, prior))]
        posterior = 1 / sum(math.exp(x - max(logs)) for x in logs) / (1 + 0.001 * math.exp(min(0.25 * unknown, 700)))
        out[key] = (names[logs.index(max(logs))], posterior, None if by_text is None else names[by_text], by_text is not None and posterior >= 0.45)
    return out


def longest_stretch(lengths, sizes, window=4, surge=80):
    """[start, end) by the definition: windows summed one by one, every surge followed to its dive."""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    best, i = (0, 0, 0), 0
    while i < len(lengths):
        if lengths[i] and sums[i] >= surge:
            j = next((j for j in range(i + 1, len(lengths)) if not sums[j]), len(lengths))
            if sum(sizes[i:j]) > best[2]:
                best = (i, j, sum(sizes[i:j]))
            i = j
        else:
            i += 1
    return best
