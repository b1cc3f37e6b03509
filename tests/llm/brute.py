"""Plain-Python versions of what the corpus queries return, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def rule_base(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    hit = {j for i, x in enumerate(windows) if many[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    n = len(w)
    return {
        "n_words": n,
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "base_failed": n < 50 or 100 * len(hit) > 50 * n,
    }


def fingerprint(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(rows):
    """(doc_id, text) -> sorted (doc_id, fingerprint, component_id)."""
    prints = [(i, fingerprint(t)) for i, t in rows]
    distinct = sorted({f for _, f in prints})
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for i, f in prints:
        r = find(f)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, f"{f:016x}", least.get(find(f))) for i, f in prints]


def secret_base(text):
    text = text or ""
    assign = re.compile(
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    )
    found = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ["assign", "access", "hex"]
    found.sort(key=lambda x: (x[1], kinds.index(x[0])))
    return found


def targets(sizes, weights=(5, 2, 1), limit=3):
    """source -> words -> source -> target, by sharing again and again."""
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ranked)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(limit * sizes[s] for s in full)
        w = sum(weight[s] for s in ranked if s not in full)
        got = {s: limit * sizes[s] if s in full else rest * weight[s] / w for s in ranked}
        above = {s for s in ranked if s not in full and got[s] >= limit * sizes[s]}
        if not above:
            return got
        full |= above
        if len(full) == len(ranked):
            return {s: limit * sizes[s] for s in ranked}


def exact(rows, pick=max):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = pick(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return out
