"""Plain restatement of the base patterns, for comparison."""

import hashlib
import re

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    out = []
    for i, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), i, m.end()))
    return sorted(out)


def digest(text):
    return hashlib.sha256(",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in base(text)).encode()).hexdigest()


WORD = r"[^\x20\x09-\x0D]"


def folded(word):
    low = re.sub("[0-9]", "0", word.lower())
    letters = [i for i, c in enumerate(low) if c.isalnum()]
    return low[letters[0] : letters[-1] + 1] if letters else low


def candidates(text):
    """(start, end, value, words before, words after) of a text's candidates."""
    tokens = [(m.start(), m.end()) for m in re.finditer(f"{WORD}+", text)]
    is_first = lambda t: len(re.findall("[0-9]", t)) > 1 or "@" in t or "(at)" in t or re.match(r"\+[0-9]", t)
    runs, k = [], 0
    while k < len(tokens):
        first = k
        if is_first(text[slice(*tokens[k])]):
            while k + 1 < len(tokens) and text[tokens[k][1] : tokens[k + 1][0]] == " " and re.fullmatch(r"[^A-Za-z]*[0-9][^A-Za-z]*", text[slice(*tokens[k + 1])]):
                k += 1
            runs.append((first, k))
        k += 1
    out = []
    for i, (a, b) in enumerate(runs):
        start, end = tokens[a][0], tokens[b][1]
        while start < end and not (text[start].isalnum() or text[start] == "+"):
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        low = runs[i - 1][1] + 1 if i else 0
        high = runs[i + 1][0] if i + 1 < len(runs) else len(tokens)
        word = lambda t: text[slice(*tokens[t])]
        before = [word(t) for t in range(low, a)][::-1][:2] + ["", ""]
        after = [word(t) for t in range(b + 1, high)][:2] + ["", ""]
        if end - start >= 6:
            out.append((start, end, text[start:end], before[:2], after[:2]))
    return out


def added(texts):
    """Row -> added spans (start, kind, end) of all texts of a corpus."""
    trust, kinds, edges, open_ = {}, {}, set(), []
    for row, text in enumerate(texts):
        text = text or ""
        spans = base(text)
        for s, e, value, before, after in candidates(text):
            reach = max(((y, k) for x, k, y in spans if x <= s), default=None)
            after_it = min(((x, k) for x, k, y in spans if x >= s), default=None)
            kind = reach[1] if reach and reach[0] > s else after_it[1] if after_it and after_it[0] < e else None
            digits = len(re.sub("[^0-9]", "", value))
            refuted = re.fullmatch(r"[0-9]+(\.[0-9]+){3}", value) or (re.fullmatch(r"[0-9+][0-9 ().+-]*", value) and digits >= 10)
            state = 1 if kind is not None else 0 if refuted else None
            states = [x for x in (trust.get(value), state) if x is not None]
            trust[value] = max(states, default=None)
            kinds[value] = min((x for x in (kinds.get(value), kind) if x is not None), default=None)
            if state is None:
                open_.append((row, s, e, value))
            shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub("[0-9]", "0", value)))
            for view, (one, two) in enumerate((before, after)):
                one, two = folded(one), folded(two)
                found = ([(False, (one,)), (True, (one, "shape", shape))] if one else []) + ([(False, ("skip", two)), (True, (one, two))] if two else [])
                edges |= {(value, view, specific, pattern) for specific, pattern in found}
    edges = {x for x in edges if x[0] in trust}
    seen = {x[0] for x in edges}
    values = {v: t for v, t in trust.items() if v in seen}
    n = [sum(t == x for t in values.values()) for x in (1, 0, None)]
    share = n[0] / max(1.0, n[0] + n[1] + 0.25 * n[2])
    found = {}
    while True:
        groups = {}
        for v, view, specific, pattern in edges:
            groups.setdefault((view, specific, pattern), set()).add(v)
        score = {}
        for p, held in groups.items():
            t = [values[v] for v in held]
            score[p] = (t.count(1) + 2 * share) / (t.count(1) + t.count(0) + 0.25 * t.count(None) + 2)
        worth = {}
        for v, view, specific, pattern in edges:
            worth.setdefault((v, view), []).append(score[view, specific, pattern])
        mean = {k: sum(x) / len(x) for k, x in worth.items()}
        best = {}
        for (view, specific, pattern), held in groups.items():
            if not specific or len(held) < 5:
                continue
            total = sum(values[v] if values[v] is not None else mean.get((v, 1 - view), share) for v in held)
            value = (total + 2 * share) / (len(held) + 2)
            if value >= 0.6:
                votes = [sum(kinds.get(v) == k for v in held) for k in range(4)]
                kind = next((k for k in range(4) if 2 * votes[k] >= len(held)), 4)
                for v in held:
                    if values[v] is None:
                        best[v] = max(best.get(v, (0, 0)), (value, kind))
        if not best:
            break
        for v, (_, kind) in best.items():
            values[v], kinds[v], found[v] = 1, kind, kind
    out = {row: [] for row in range(len(texts))}
    for row, s, e, v in open_:
        if v in found:
            out[row].append((s, found[v], e))
    return {row: sorted(x) for row, x in out.items()}
