"""Plain-Python versions of the operators, written from their contracts."""

import re
from collections import Counter

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return BLANK_WORD.findall(text or "")


def base_stats(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text):
    import xxhash

    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_ids(rows, distance=3):
    """rows: (id, fingerprint) → least id reachable, per row."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= distance:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i, (x, _) in enumerate(rows):
        if x is not None:
            r = root(i)
            least[r] = min(least.get(r, x), x)
    return [least.get(root(i)) for i in range(len(rows))]


def repeats(rows, window=20):
    """rows: (doc_id, text) → (kept text, words, removed words) per row; null ids come first."""
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    first = {}
    split = [words(t) for _, t in rows]
    for i in sorted(range(len(rows)), key=lambda i: order(rows[i])):
        for s in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][s:s + window]), (rows[i], s))
    out = []
    for row, w in zip(rows, split):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] != (row, s):
                gone.update(range(s, s + window))
        out.append((" ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return out


def collocations(rows, longest=5, min_count=100, top=2000):
    """rows: (lang, text) → (lang, rank, phrase, a, l, r, n, score)."""
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update(tuple(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = [p for p, a in f.items() if len(p) > 1 and a >= min_count]
        inside = {p[i:i + k] for p in found for k in range(2, len(p)) for i in range(len(p) - k + 1)
                  if f[p[i:i + k]] <= f[p]}
        scored = []
        for p in found:
            if p not in inside:
                score, k = min((1000 * f[p] * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return out


def damage(rows):
    import zlib

    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Cheapest edits by search over (place, last kept initial), cost first, then audit: rows of
    (role, text, must go, truncated) → (cost, audit, repaired turns)."""
    import heapq

    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(out)
        if (i, last) in done:
            continue
        done.add((i, last))
        ok = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for r in ("user", "assistant"):
            if r[0] in ok:
                heapq.heappush(heap, (cost + 3, audit + "I", i, r[0], (*out, f"{r}:")))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, out))
            if not gone:
                if role[:1] and role[:1] in ok:
                    heapq.heappush(heap, (cost + 3 * cut, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    if r[0] in ok:
                        heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", i + 1, r[0], (*out, f"{r}:{text}")))


def repair(rows):
    """rows of conversations (before damage) → {conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)}."""
    import hashlib

    convs = {r[0]: [] for r in rows}
    for r in damage(rows):
        convs[r[0]].append(r)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[1] for r in own if r[1] is not None]
        seen, n, marked = set(), Counter(), []
        for _, _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, fixed = cheapest(marked)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"],
                     illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest())
    return out
