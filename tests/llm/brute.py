"""Plain Python versions of what the operators return, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text, end_id):
    import public_tokenizers
    from tokenizers import Tokenizer
    global _T
    try:
        t = _T
    except NameError:
        t = _T = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return t.encode(text or "", add_special_tokens=False).ids + [end_id]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = SPLIT.findall(low)
    grams = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash(docs):
    """[(id, text)] -> {id: (fingerprint, component)}; ids distinct and not null."""
    docs = sorted(docs)
    f = [fingerprint(t) for _, t in docs]
    links = [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 3]
    root = components(len(f), links)
    return {d: (f"{x:016x}", docs[r][0]) for (d, _), x, r in zip(docs, f, root)}


def repeats(texts, width):
    """(n_bytes, n_removed, n_spans, sha256) of each text."""
    raw = [(t or "").encode() for t in texts]
    c = Counter(t[i:i + width] for t in raw for i in range(len(t) - width + 1))
    out = []
    for t in raw:
        m = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if c[t[i:i + width]] > 1:
                m[i:i + width] = b"\1" * width
        spans = sum(1 for i in range(len(m)) if m[i] and not (i and m[i - 1]))
        out.append((len(t), sum(m), spans, hashlib.sha256(bytes(b for b, x in zip(t, m) if not x)).hexdigest()))
    return out


def embeddings(rows, min_cos=0.95):
    """[(id, vector)] -> {id: (n_links, component)}; ids distinct."""
    rows = sorted(rows)

    def fine(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
    links = []
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if fine(a) and fine(b) and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= min_cos:
                    links.append((i, j))
    n = Counter(k for p in links for k in p)
    root = components(len(rows), links)
    return {r[0]: (n[i], rows[root[i]][0]) for i, r in enumerate(rows)}


def line_chunks(lines, mean_lines=4):
    """[(lines before it, its lines)] of the content-defined chunks."""
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    mark = [sum(h[i - d] * 31 ** d for d in range(3) if i >= d) % mean_lines == 0 for i in range(len(h))]
    cuts = [i + 1 for i in range(1, len(h) - 1) if mark[i] and not (i > 1 and mark[i - 1])] + [len(h)]
    return [(a, lines[a:b]) for a, b in zip([0, *cuts], cuts)]


def passages(docs, k=2):
    """[(id, text)] -> {id: numbers of the lines to remove}; ids distinct and not null."""
    first, out = {}, {}
    for d, t in sorted((d, t) for d, t in docs if t is not None):
        lines = t.split("\n")
        parts = [(i, lines[i:i + k]) for i in range(len(lines) - k + 1)] + [c for c in line_chunks(lines) if len(c[1]) > k]
        out[d] = set()
        for at, part in sorted(parts):
            if SPLIT.search("\n".join(part)):
                e, p = first.setdefault(tuple(part), (d, at))
                if e != d or at >= p + len(part):
                    out[d] |= set(range(at, at + len(part)))
    return out


def removed_chunks(docs, k=2):
    """[(id, text)] -> {id: number of content-defined chunks to remove}; ids distinct and not null."""
    seen, out = set(), {}
    for d, t in sorted((d, t) for d, t in docs if t is not None):
        for _, part in line_chunks(t.split("\n")):
            if len(part) >= k and SPLIT.search("\n".join(part)):
                out[d] = out.get(d, 0) + (tuple(part) in seen)
                seen.add(tuple(part))
    return out


def spelling(docs, min_length=7, min_count=2, misspell=31, times=10):
    """(word, form, root, n, n_near, form_n) of (doc_id, text) rows."""
    import re
    import zlib
    from collections import Counter
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            w = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if misspell and h % misspell == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
            if len(w) >= min_length:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    others = {w: [o for o in n if near(w, o)] for w in n}
    form = {}
    for w, os in others.items():
        best = min(os, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return rows


def audit(docs, labels):
    """Rows of the filter audit by applying every order to every document; docs: (doc_id, text, source)."""
    import re
    from itertools import permutations
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    bad = {d for d, _, t in labels if t == 1 and d is not None}
    low = {}
    for d, t, _ in docs:
        if d is not None:
            low[t or ""] = min(low.get(t or "", d), d)
    fails, rows = {}, []
    for d, t, s in docs:
        t = t or ""
        ws = [w for w in re.split("[\x20\x09-\x0D]+", t) if w]
        f = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
             "D": bool(set(t) & set("#$%&*|")), "E": d is not None and low[t] < d}
        fails.setdefault(s or "", []).append((d, {k for k, v in f.items() if v}))
    for part, ds in fails.items():
        made, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(ds)
            for step, k in enumerate(order, 1):
                gone = [x for x in left if k in x[1]]
                left = [x for x in left if k not in x[1]]
                total[k] += len(gone)
                made.append([part, "".join(order), step, len(left), len(gone), sum(k in f for _, f in ds) - len(gone),
                             sum(f == {k} for _, f in ds), sum(d in good for d, _ in gone), sum(d in bad for d, _ in gone)])
        rows += [(*r, total[r[1][r[2] - 1]]) for r in made]
    return rows


def lexicon(rows, patterns=500, min_docs=4, min_odds=2.5):
    """(weights, harmless words) learned from (folded words, label) rows by plain counting."""
    import math
    import re
    bad, good = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    t, c = {}, {}
    for ws, y in rows:
        for g in {p for w in ws for p in [w[:k] for k in range(3, min(len(w), 10) + 1)] + [w + " "]}:
            d = t if y else c
            d[g] = d.get(g, 0) + 1
    odds = {g: math.log((t.get(g, 0) + 0.5) / (bad + 1)) - math.log((c.get(g, 0) + 0.5) / (good + 1)) for g in t.keys() | c.keys()}
    strong = [g for g in t if t[g] >= min_docs and odds[g] >= min_odds]
    strong = sorted(strong, key=lambda g: (-odds[g], -t[g], -len(g), g))[:8 * patterns]
    keep = [g for g in strong if not any(o != g and o.startswith(g) and t[o] >= 0.8 * t[g] for o in strong)][:patterns]
    begins = [g for g in keep if not g.endswith(" ")]
    harmless = [g for g in c if begins and g.endswith(" ") and odds[g] < 0 and c[g] >= min_docs and re.match("|".join(map(re.escape, begins)), g)]
    return {g: odds[g] for g in keep}, [g.strip() for g in sorted(harmless, key=lambda g: (odds[g], g))[:patterns]]


def toxic_sum(words, weights, exceptions):
    """Sum over the words of the largest weight of their patterns, nothing where an exception phrase starts."""
    total = 0.0
    for i in range(len(words)):
        rest = " ".join(words[i:]) + " "
        if not any(rest.startswith(e + " ") for e in exceptions):
            total += max((w for g, w in weights.items() if rest.startswith(g)), default=0.0)
    return total
