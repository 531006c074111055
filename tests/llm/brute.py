"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def measures(text):
    w = words(text)
    text = text or ""
    lines = [x for x in text.split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_upper": sum("A" <= c <= "Z" for c in text),
        "n_lower": sum("a" <= c <= "z" for c in text),
    }


def kept_by_rules(text):
    m = measures(text)
    n = m["n_words"]
    return not (
        n < 50
        or 100 * m["n_repeat_words"] > 50 * n
        or 100 * m["n_symbols"] > 30 * n
        or 100 * m["n_dup_lines"] > 50 * m["n_lines"]
        or m["word_chars"] < 2 * n
        or m["word_chars"] > 20 * n
        or m["n_upper"] > m["n_lower"]
    )


def shingles(text, n):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_components(docs, n, percent=80):
    """docs: (doc_id, text). doc_id to the least doc_id of its component."""
    sets = {d: shingles(t, n) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}, {d: len(s) for d, s in sets.items()}


def _spans(starts, least):
    out = []
    for i in sorted(starts):
        if out and i <= out[-1][1]:
            out[-1][1] = i + least
        else:
            out.append([i, i + least])
    return [tuple(x) for x in out]


def repeats(docs, least=50):
    """(doc_id, kind, start, end) of repeated spans and of their parts that occurred earlier."""
    seen = defaultdict(list)
    for d, t in sorted(docs):
        w = words(t)
        for i in range(len(w) - least + 1):
            seen[tuple(w[i : i + least])].append((d, i))
    repeat, cut = defaultdict(set), defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for k, (d, i) in enumerate(sorted(places)):
                repeat[d].add(i)
                if k:
                    cut[d].add(i)
    return {(d, kind, a, b) for kind, by in (("repeat", repeat), ("cut", cut)) for d, s in by.items() for a, b in _spans(s, least)}


def without_repeats(docs):
    spans = defaultdict(list)
    for d, kind, a, b in repeats(docs):
        if kind == "cut":
            spans[d].append((a, b))
    out = []
    for d, t in docs:
        found = [m.span() for m in WORD.finditer(t or "")]
        for a, b in sorted(spans.get(d, ()), reverse=True):
            t = t[: found[a][0]] + (t[found[b][0] :] if b < len(found) else "")
        if d not in spans or words(t):
            out.append((d, t))
    return out


def shared_out(budget, children):
    """children: (name, weight, capacity): water-filling found by testing which children are full."""
    live = [c for c in children if c[1] and c[2]]
    full, got = [], {name: 0 for name, _, _ in children}
    while live:
        weight = sum(w for _, w, _ in live)
        more = [c for c in live if c[2] * weight <= budget * c[1]]
        if not more:
            break
        first = min(more, key=lambda c: (Fraction(c[2], c[1]), c[0]))
        got[first[0]] = first[2]
        budget -= first[2]
        live.remove(first)
        full.append(first)
    weight, upto = sum(w for _, w, _ in live), 0
    for name, w, _ in sorted(live, key=lambda c: (Fraction(c[2], c[1]), c[0])):
        got[name] = budget * (upto + w) // weight - budget * upto // weight
        upto += w
    return got


def mixed(docs, path, weight, share, epochs, seed):
    """docs: (doc_id, text, ...). (doc, epoch, tokens taken) of every selection."""
    leaves = defaultdict(list)
    for d in docs:
        if words(d[1]):
            leaves[path(d)].append(d)
    supply = {p: sum(len(words(d[1])) for d in v) for p, v in leaves.items()}
    got = {(): min(sum(supply.values()) * share[0] // share[1], sum(supply.values()) * epochs)}
    for level in range(3):
        after = {}
        for parent, budget in got.items():
            names = sorted({p[level] for p in supply if p[:level] == parent})
            children = [(n, weight(level, n), epochs * sum(s for p, s in supply.items() if p[: level + 1] == (*parent, n))) for n in names]
            after |= {(*parent, n): b for n, b in shared_out(budget, children).items()}
        got = after
    out = []
    for p, members in leaves.items():
        whole, rest = divmod(got[p], supply[p])
        out += [(d, e, len(words(d[1]))) for d in members for e in range(whole)]
        at = 0
        for d in sorted(members, key=lambda d: (hashlib.md5(f"{seed}:{whole}:{'' if d[0] is None else d[0]}".encode()).hexdigest(), len(words(d[1])))):
            n = len(words(d[1]))
            if at < rest:
                out.append((d, whole, min(n, rest - at)))
            at += n
    return out


def pieces(text, tokenizer, length=2048):
    import numpy as np

    ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
    return [(a, len(ids[a : a + length]), zlib.crc32(ids[a : a + length].tobytes()), len(ids)) for a in range(0, len(ids), length)]


def vocabulary(seed, n=800):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghiklmnoprstuvwé", k=r.randint(2, 8))) for _ in range(n)]
