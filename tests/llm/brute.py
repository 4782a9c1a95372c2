"""Plain versions of the operators, over lists of rows."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return SPACES.findall(text or "")


def plain(text):
    return PLAIN.findall((text or "").lower())


def fingerprint(text):
    ws = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, reach=2):
    """Smallest index reachable by links of at most ``reach`` differing bits."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= reach:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def substrings(texts, window):
    """Number of words, kept words of each text."""
    split = [words(t) for t in texts]
    seen = Counter(
        tuple(ws[i : i + window]) for ws in split for i in range(len(ws) - window + 1)
    )
    out = []
    for ws in split:
        gone = set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(ws), [w for i, w in enumerate(ws) if i not in gone]))
    return out


def lines_removed(texts, t=0.8):
    """Numbers of the removed lines of each text; texts in order of doc_id."""
    earlier, out = [], []
    for text in texts:
        gone = []
        for i, line in enumerate([] if text is None else text.split("\n")):
            s = frozenset(plain(line))
            if not s:
                continue
            if any(len(s & o) >= t * len(s | o) - 1e-9 for o in earlier):
                gone.append(i)
            earlier.append(s)
        out.append(gone)
    return out


def shingles(text, size=5):
    ws = plain(text)
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} or ({tuple(ws)} if ws else set())


def contained(docs, items, share=0.8):
    """(doc, item, size of the item, shared) of the pairs that match."""
    held = [(d, shingles(t)) for d, t in docs]
    out = set()
    for i, t in items:
        s = shingles(t)
        for d, h in held:
            if s and len(s & h) >= share * len(s) - 1e-9:
                out.add((d, i, len(s), len(s & h)))
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Target by source name (None last), by sharing again until none is above its limit."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[n] for n in open_)
        over = {n for n in open_ if left * weight[n] / total >= most * sizes[n]}
        if not over:
            return out | {n: left * weight[n] / total for n in open_}
        for n in over:
            out[n] = float(most * sizes[n])
        left -= sum(most * sizes[n] for n in over)
        open_ -= over
    return out


def mix(docs):
    """size, source_size, target, taken of (doc_id, source, text) rows, in order."""
    size = [len(words(t)) for _, _, t in docs]
    place = [
        int(
            hashlib.md5(
                f"{'-' if d is None else d}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()
            ).hexdigest()[:14],
            16,
        )
        for d, _, t in docs
    ]
    total = Counter()
    for (_, s, _), n in zip(docs, size):
        total[s] += n
    goal, out = targets(dict(total)), []
    for (_, s, _), n, p in zip(docs, size, place):
        whole = int(goal[s] >= total[s]) + int(goal[s] >= 2 * total[s]) if total[s] else 0
        below = sum(m for (_, o, _), m, q in zip(docs, size, place) if o == s and q <= p)
        more = below <= goal[s] - whole * total[s]
        out.append((n, total[s], goal[s], n * (whole + more)))
    return out


def top(vectors, k=10, every=100):
    """(query_id, rank, vec_id, score); vectors: id, list of integers."""
    out = []
    for q, v in vectors:
        if q % every:
            continue
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return out


def hard_negatives(rows, every, n_positives=5, n_negatives=3):
    """Over (id, label, vector of ints) rows, one anchor per distinct row."""
    out = []
    for a, own, q in sorted({(i, lab, tuple(v)) for i, lab, v in rows if i % every == 0}):
        scored = sorted(
            (-sum(x * y for x, y in zip(q, v)), i, lab == own) for i, lab, v in rows if i != a and len(v) == len(q)
        )
        for s, p, _ in [x for x in scored if x[2]][:n_positives]:
            inside = [x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:n_negatives]
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(inside, 1)]
    return out


def spellings(docs, every=31):
    """word -> (form, root, n, n_near, form_n) of (doc_id, text) rows."""
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w in n:
        about = [v for v in n if v != w and near(w, v)]
        top = min(about, key=lambda v: (-n[v], v), default=None)
        form = top if top and n[top] >= 10 * n[w] else None
        out[w] = [form, None, n[w], len(about), n[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return {w: tuple(row) for w, row in out.items()}


def alike_components(texts, similarity=0.8):
    """Smallest index reachable by word shingle sets of that Jaccard similarity."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if root[i] != root[j] and (a == b or len(a & b) >= similarity * len(a | b) - 1e-9):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root
