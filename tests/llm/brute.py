"""Plain Python versions of the operators, for comparison on small inputs."""

import re

BASE_SECRETS = {
    "assign": re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(?:password", "(?i:password")),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
BASE_PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m[0])
    return {
        "assign": lambda: len(m[2]) >= 8, "access": lambda: len(m[0]) >= 16, "hex": lambda: len(m[0]) >= 32, "email": lambda: True,
        "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def base_spans(text, rules):
    out = [(m.start(), i, f"{kind}:{m.start()}:{m.end()}", kind) for i, (kind, p) in enumerate(rules.items()) for m in p.finditer(text or "") if passes(kind, m)]
    return sorted(out)


def words(text, lower=False):
    b = (text or "").encode()
    return (b.lower() if lower else b).split()


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def linked(ids, links):
    """{id: (number of links, smallest id reachable)} for distinct ids and index pairs."""
    roots = components(len(ids), links)
    low, n = {}, [0] * len(ids)
    for i, r in enumerate(roots):
        low[r] = min(low.get(r, ids[i]), ids[i])
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {ids[i]: (n[i], low[roots[i]]) for i in range(len(ids))}


def near_texts(rows, similarity=0.8, size=5):
    sets = []
    for _, t in rows:
        w = words(t, True)
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9]
    return linked([r[0] for r in rows], links)


def near_vectors(rows, cosine=0.98):
    import numpy as np

    def ok(r):
        v = r[1]
        return r[2] is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    links = []
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if ok(a) and ok(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    links.append((i, j))
    return linked([r[0] for r in rows], links)


def without_repeats(rows, window=35):
    from collections import Counter

    all_words = [words(t) for _, t in rows]
    seen = Counter(tuple(w[j : j + window]) for w in all_words for j in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, all_words):
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def disclosed(rows, disclosure=0.9, support=3, context=60):
    """{row number: {(start, end)}} of disclosing terms, as pii.disclose defines them."""
    import math
    from collections import defaultdict

    near, df_e = [], defaultdict(set)
    for k, (_, text) in enumerate(rows):
        text = text or ""
        for start, _, span, kind in base_spans(text, BASE_PII):
            end = int(span.split(":")[2])
            entity = f"{kind}:{text[start:end].lower()}"
            df_e[entity].add(k)
            left_at = max(0, start - context)
            left = text[left_at:start]
            cut = len(left) - len(re.sub(r"^[^\W\d_]+", "", left))
            for at, part in ((left_at + cut, left[cut:]), (end, re.sub(r"[^\W\d_]+$", "", text[end : end + context]))):
                near += [(k, entity, m[0].lower(), at + m.start(), at + m.end()) for m in re.finditer(r"[^\W\d_]{4,}", part)]
    df_t, df_et = defaultdict(int), defaultdict(set)
    for _, text in rows:
        for t in {m.lower() for m in re.findall(r"[^\W\d_]{4,}", (text or "").lower())}:
            df_t[t] += 1
    for k, e, t, _, _ in near:
        df_et[e, t].add(k)
    n, out = len(rows), defaultdict(set)
    for k, e, t, s, x in near:
        de, dt, det = len(df_e[e]), df_t[t], len(df_et[e, t])
        if de >= support and det >= support and de < n and math.log(det * n / (de * dt)) >= disclosure * math.log(n / de):
            out[k].add((s, x))
    return out
