"""Plain Python versions of the corpus operators, written from their contracts, for tests on small tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHINGLE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def warc(pages, least=0):
    top = {}
    for page_id, html in pages:
        b = (html or "").encode()
        if len(b) >= least and page_id is not None:
            top[b] = max(page_id, top.get(b, page_id))
    out = []
    for page_id, html in pages:
        b = (html or "").encode()
        t = top.get(b)
        revisit = t is not None and t != page_id
        out.append((page_id, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", t if revisit else None))
    return out


def exact(docs):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in docs]
    ids, n = {}, Counter(t for _, t in norm)
    for i, t in norm:
        known = [x for x in (ids.get(t), i) if x is not None]
        ids[t] = min(known) if known else None
    return [(i, ids[t], n[t], i == ids[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm]


def decontaminate(docs, items, window=8):
    owners = defaultdict(set)
    for item_id, text in items:
        w = WORD.findall(lower(text))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            owners[tuple(w[k : k + window])].add(item_id)
    sizes = {len(k) for k in owners}
    out = []
    for doc_id, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := owners.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        names = sorted(map(str, found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(names).encode()).hexdigest(), len(found) >= 2))
    return out


def tokens(docs, tokenizer, end=2):
    out, start = [], 0
    for doc_id, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def shingles(text, k=5):
    w = SHINGLE_WORD.findall(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def near(docs, percent=80):
    """(doc_id, set size, component id), each pair compared."""
    sets = [(i, shingles(t)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(k)
    shared = Counter()
    for ks in holders.values():
        for a in range(len(ks)):
            for b in range(a):
                shared[ks[b], ks[a]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        least[r] = min(i, least.get(r, i))
    return [(i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)]


def spread(docs, least=8):
    """(doc_id, cleaned text, lines, removed) of (doc_id, text, site)."""
    sites = defaultdict(set)
    strip = lambda line: line.strip(" \t\r\x0b\f")
    for _, text, site in docs:
        for line in (text or "").split("\n"):
            if site is not None:
                sites[strip(line)].add(site)
    out = []
    for i, text, _ in docs:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not strip(x) or len(sites[strip(x)]) < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def shard_law(rows, shards=16):
    """What any law-``bytes`` sharding must hold, from (size, shard, slot) rows: gapless slots, near equal bytes."""
    by = defaultdict(list)
    for size, shard, slot in rows:
        by[shard].append((slot, size))
    assert set(by) <= set(range(shards))
    assert all(sorted(slot for slot, _ in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(size for _, size in by[s]) for s in range(shards)]
    mean, most = sum(sizes) / shards, max((r[0] for r in rows), default=0)
    assert all(abs(x - mean) <= 0.01 * mean + most for x in sizes), sizes


def mix(weights, blocks):
    """(source, block, phase, release, deadline) of each slot: every slot looks at all sources' next blocks."""
    left, out, phase = dict(blocks), [], 0
    while any(left.values()):
        active = {s: weights[s] for s in left if left[s]}
        total, ran, slot = sum(active.values()), Counter(), 0
        while all(left[s] for s in active):
            window = {s: (ran[s] * total // w, -(-(ran[s] + 1) * total // w)) for s, w in active.items()}
            s = min((s for s in active if window[s][0] <= slot), key=lambda s: (window[s][1], -active[s], s))
            out.append((s, blocks[s] - left[s], phase, *window[s]))
            ran[s] += 1
            left[s] -= 1
            slot += 1
        phase += 1
    return out
