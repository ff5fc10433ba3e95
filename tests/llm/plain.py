"""Plain versions of the contracts, row by row."""

import hashlib
import re

import numpy as np
import xxhash

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
FOLDED, PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def folded(t):
    return FOLDED.findall((t or "").translate(LOW))


def plain(t):
    return PLAIN.findall(t or "")


def license_base(t):
    w = folded(t)
    found = [(i, v) for p, v in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({v for _, v in found}))


def fingerprint(t):
    w = plain((t or "").translate(LOW))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, bits=4):
    """Root of every fingerprint, all pairs compared."""
    u = sorted(set(fps))
    root = {f: f for f in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(b)] = find(a)
    return {f: find(f) for f in u}


def leaks(t, items, k=10):
    w, win = folded(t), {}
    for i, x in items:
        v = folded(x)
        n = min(k, len(v))
        for a in range(len(v) - n + 1 if n else 0):
            win.setdefault(tuple(v[a : a + n]), set()).add(i)
    hit, seen = set(), set()
    for n in {len(x) for x in win}:
        for a in range(len(w) - n + 1):
            if (x := tuple(w[a : a + n])) in win:
                hit.update(range(a, a + n))
                seen |= win[x]
    names = sorted(str(i) for i in seen if i is not None)
    return len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


def top_products(rows, k=5, every=50):
    v = {i: np.floor(256 * np.array(x, float)).astype(int) for i, x in rows if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)}
    out = []
    for q in v:
        if q % every == 0:
            best = sorted((-int(v[q] @ x), i) for i, x in v.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def without_repeats(docs, n=13):
    first, out = {}, []
    for d, t in docs:
        w = plain(t)
        for a in range(len(w) - n + 1):
            x = tuple(w[a : a + n])
            first[x] = min(first.get(x, d), d)
    for d, t in docs:
        w = plain(t)
        keep = [True] * len(w)
        for a in range(len(w) - n + 1):
            if first[tuple(w[a : a + n])] < d:
                keep[a : a + n] = [False] * n
        kept = " ".join(x for x, y in zip(w, keep, strict=True) if y)
        out.append((d, len(w), len(w) - sum(keep), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def mix(rows, weights=(5, 2, 1), most=3):
    """Target of each source by handing the excess on until none is left."""
    size = {}
    for s, n in rows:
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(size.values()), {}
    while True:
        left = [s for s in order if s not in full]
        share = (total - sum(full.values())) / max(1, sum(w[s] for s in left))
        over = [s for s in left if w[s] * share > most * size[s]]
        if not over:
            return {s: full.get(s, w[s] * share) for s in order}
        full |= {s: most * size[s] for s in over}


def align(docs, byte_path="/opt/tokenizers/byte_bpe_50k.json", piece_path="/opt/tokenizers/piece_bpe_32k.model"):
    """Rows of the alignment contract; groups cut, and links listed, one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(byte_path)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in printable}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    links_of, groups_of = [], []
    for _, t in docs:
        groups, want = [], b" " + (t or "").encode()
        a = [(i, bytes(byte[c] for c in one.id_to_token(i))) for i in one.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = [(i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()) for i in (two.encode(t) if t else []) for p in [two.id_to_piece(i)]]
        if t and b"".join(x for _, x in a) == want == b"".join(x for _, x in b):
            ends = lambda s: np.cumsum([len(x) for _, x in s]).tolist()
            cuts = sorted(set(ends(a)) & set(ends(b)))
            groups = [([], []) for _ in cuts]
            for side, s in enumerate((a, b)):
                for (i, _), e in zip(s, ends(s), strict=True):
                    groups[next(k for k, c in enumerate(cuts) if c >= e)][side].append(i)
        groups_of.append(groups)
        links_of.append([(x, y) for g in groups for x in g[0] for y in g[1]])
    count, best = {}, {}
    for links in links_of:
        for pair in set(links):
            count[pair] = count.get(pair, 0) + 1
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (d, _), groups, links in zip(docs, groups_of, links_of, strict=True):
        text = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        out.append((
            d, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[p] == best[p[0]] for p in links),
            sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out


def clusters(rows, k=16, rounds=3):
    """Rows of the clustering contract in Python integers."""
    kept = [(i, [int(np.floor(64 * float(c))) for c in x]) for i, x in rows if x is not None and len(x) == 64 and all(c is not None and np.isfinite(c) for c in x)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [v for _, v in start]
    for turn in range(rounds + 1):
        where = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents)) for _, v in kept]
        if turn == rounds:
            break
        for j in range(len(cents)):
            mine = [v for (_, v), (_, c) in zip(kept, where, strict=True) if c == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    of = [sum(d for d, c in where if c == j) for j in range(len(cents))]
    return [(i, c, d, of[c], sum(of), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, where, strict=True)]
