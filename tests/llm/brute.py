"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict

BLANKS = r"[^\x20\x09-\x0D]+"


def components(rows, k, percent):
    sets = []
    for _, text in rows:
        words = re.findall(BLANKS, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for j, s in enumerate(sets):
        shared = Counter(o for g in s for o in holders[g])
        for g in s:
            holders[g].append(j)
        for o, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                parent[find(j)] = find(o)
    smallest = {}
    for j, (i, _) in enumerate(rows):
        smallest[find(j)] = min(smallest.get(find(j), i), i)
    return [(i, len(sets[j]), smallest[find(j)]) for j, (i, _) in enumerate(rows)]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    text, out = text or "", []
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )
    for kind, pattern in rules:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits or "0"), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def repetition(text):
    text = text or ""
    words = re.findall(BLANKS, text)
    lines = [line for line in text.split("\n") if re.search(BLANKS, line)]
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def water_fill(sizes, share=1.5, epochs=2.0, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, clamped = {s: 0.0 for s in names}, set()
    while True:
        rest = share * sum(sizes.values()) - sum(epochs * sizes[s] for s in clamped)
        open_ = [s for s in names if s not in clamped and sizes[s]]
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > epochs * sizes[s]}
        for s in open_:
            target[s] = rest * weight[s] / total
        if not over:
            break
        clamped |= over
    for s in clamped:
        target[s] = epochs * sizes[s]
    return target


def verdict(text):
    """The repetition verdict: base rules, then characters of words in later copies of n-grams and lines."""
    text = text or ""
    n_words, total, _, _, again = repetition(text)
    if n_words < 50 or 100 * again > 50 * n_words:
        return False
    words = re.findall(BLANKS, text)
    for n in range(5, 11):
        seen, covered = set(), set()
        for i in range(len(words) - n + 1):
            gram = tuple(words[i : i + n])
            if gram in seen:
                covered.update(range(i, i + n))
            seen.add(gram)
        if sum(len(words[i]) for i in covered) > 0.15 * total:
            return False
    seen, chars = set(), 0
    for line in text.split("\n"):
        if re.search(BLANKS, line):
            chars += sum(map(len, re.findall(BLANKS, line))) if line in seen else 0
            seen.add(line)
    return chars <= 0.30 * total


def neighbours(rows, k):
    import numpy as np

    good = [(i, np.array(v, float)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 100 == 0:
            out[i] = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in good if j != i and len(v) == len(q))[:k]
    return out


def quality(model, text, bits, hashed):
    """A softmax over plain means: of every kind of feature the mean of its buckets' weights, and the mean of the kinds."""
    import numpy as np

    kinds = [[model.weights[b] for b in found] for found in hashed(text)]
    kinds = [k for k in kinds if k]
    z = model.bias + (sum(np.mean(k, axis=0, dtype=float) for k in kinds) / len(kinds) if kinds else 0)
    e = np.exp(z - z.max())
    return e / e.sum()
