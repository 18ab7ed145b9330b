"""Plain single-machine versions of the corpus contracts, for comparison on small tables."""

import base64
import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(texts, length):
    """Per text: bytes, removed bytes, spans, digest of the rest."""
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(hash(r[i : i + length]) for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        covered = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[hash(r[i : i + length])] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(r, covered, strict=True) if not c)
        out.append((len(r), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, words):
    found = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not found:
        return set()
    if len(found) < words:
        return {tuple(found)}
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def near_duplicates(rows, words, percent):
    """{id: (shingles, component)} by comparing all pairs."""
    sets = {i: shingles(t, words) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_shingle = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].append(i)
    pairs = collections.Counter()
    for ids in by_shingle.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                pairs[min(a, b), max(a, b)] += 1
    for (a, b), both in pairs.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def secrets(text):
    """n_assign, n_access, n_hex, digest of the base spans."""
    text, spans = text or "", []
    spans += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    shown = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    n = collections.Counter(s[3] for s in spans)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(shown.encode()).hexdigest()


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    n, repeated = len(words), len(inside)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeated, n < 20 or 100 * repeated > 30 * n


def archive(pages):
    """{page: (bytes, digest, type, refers_to)}"""
    payload = {p: (h or "").encode() for p, h in pages}
    first = {}
    for p in sorted(payload):
        first.setdefault(payload[p], p)
    return {
        p: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == p else "revisit", None if first[b] == p else first[b])
        for p, b in payload.items()
    }


def top_k(vectors, every, k):
    """[(query, rank, vec_id, score)] by inner products of the floored vectors."""
    import math

    whole = {i: [math.floor(256 * float(x)) for x in v] for i, v in vectors}
    out = []
    for q in sorted(i for i in whole if i % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k):
    """[(item, rank, doc, score)] by scoring every document for every item."""
    import math

    split = lambda t: TERM.findall((t or "").translate(LOWER))
    tf = [(i, collections.Counter(split(t))) for i, t in docs if i is not None]
    n_docs, n_all = sum(bool(c) for _, c in tf), sum(c.total() for _, c in tf)
    df = collections.Counter(x for _, c in tf for x in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(split(t))
    out = []
    for item, terms in sorted(asked.items()):
        found = []
        for i, c in tf:
            m = 50 + 50 * c.total() * n_docs // max(1, n_all)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 20 * m)) for x in terms if c[x])
            if score > 0:
                found.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


def slips(docs, every):
    """Occurrences of all runs of letters, some read with a slip."""
    import zlib

    counts = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return counts


def variants(counts, factor):
    """{(word, form, root, n, n_near, form_n)} by comparing all pairs."""

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {w: [x for x in counts if near(w, x)] for w in counts}
    form = {}
    for w, others in found.items():
        if others and counts[best := min(others, key=lambda x: (-counts[x], x))] >= factor * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(found[w]), counts.get(form.get(w))) for w, n in counts.items()}
