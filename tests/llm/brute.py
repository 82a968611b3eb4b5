"""Brute-force versions of the operators' contracts, in plain Python."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import defaultdict


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def folded_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))


def substring_dedup(docs, window=13):
    least = {}
    for doc_id, text in docs:
        w = plain_words(text)
        for i in range(len(w) - window + 1):
            key, order = tuple(w[i : i + window]), float("inf") if doc_id is None else doc_id
            least[key] = min(order, least.get(key, order))
    out = []
    for doc_id, text in docs:
        w = plain_words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (float("inf") if doc_id is None else doc_id):
                gone |= set(range(i, i + window))
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def byte_dedup(docs, width=50):
    least = {}
    for doc_id, text in docs:
        b, order = (text or "").encode(), float("inf") if doc_id is None else doc_id
        for i in range(len(b) - width + 1):
            key = b[i : i + width]
            if order < least.get(key, float("inf")) or key not in least:
                least[key] = order
    out = []
    for doc_id, text in docs:
        b, order = (text or "").encode(), float("inf") if doc_id is None else doc_id
        gone = bytearray(len(b))
        end = 0
        for i in range(len(b) - width + 1):
            if least[b[i : i + width]] < order:
                a = max(i, end)
                gone[a : i + width] = b"\1" * (i + width - a)
                end = i + width
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc_id, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def contamination(docs, items, k=10):
    windows = {}
    for item_id, text in items:
        w = folded_words(text)
        if not w:
            continue
        for i in range(max(1, len(w) - k + 1)):
            windows.setdefault(tuple(w[i : i + k]), set()).add(None if item_id is None else str(item_id))
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w = folded_words(text)
        hit, names = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    names |= own
        names.discard(None)  # hit, but without a name
        out.append((doc_id, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return out


def shingles(text, k=5):
    w = plain_words(lower_ascii(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard_components(docs, k=5):
    """docs: (doc_id, text); pairs through shared shingles, then union-find."""
    sets = [shingles(t, k) for _, t in docs]
    where, root = {}, list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    same = {}
    for i, s in enumerate(sets):
        if s:
            first = same.setdefault(frozenset(s), i)
            root[find(i)] = find(first)
    for i in same.values():
        shared = {}
        for x in sets[i]:
            for j in where.get(x, ()):
                shared[j] = shared.get(j, 0) + 1
            where.setdefault(x, []).append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def kd_shards(rows, shards):
    """rows: (doc_id, text, lang, source), no two with the same coordinate and text; {doc_id: shard} by sorting every cell whole."""
    points = []
    for doc_id, text, lang, source in rows:
        raw = (text or "").encode()
        low = zlib.crc32(raw) >> 1
        coarse = lambda c: -1 if c is None else zlib.crc32(c.encode())
        size = len(raw) + 1
        points.append((doc_id, size, {"size": (size << 31) + low, "source": (coarse(source) << 31) + low, "lang": (coarse(lang) << 31) + low, "doc": doc_id}))
    axes = ("size", "source", "lang", "doc")
    extent = lambda own, d: max(p[2][d] for p in own) - min(p[2][d] for p in own)
    wide = {d: max(1, extent(points, d)) for d in axes}
    out = {}

    def split(own, first, n):
        if n == 1 or not own:
            out.update({p[0]: first for p in own})
            return
        axis = max(axes, key=lambda d: extent(own, d) / wide[d])
        own = sorted(own, key=lambda p: p[2][axis])
        need, at, k = sum(p[1] for p in own) * (n // 2) / n, 0, 0
        while k < len(own) and abs(need - at) > abs(need - at - own[k][1]):
            at, k = at + own[k][1], k + 1
        split(own[:k], first, n // 2)
        split(own[k:], first + n // 2, n - n // 2)

    split(points, 0, shards)
    return out


def likeness(docs, lexicon, subsets):
    """docs: texts; lexicon: word -> subsets that keep it, of the words in the band; drawn: the same for any word. A function of two texts."""
    drawn = lexicon["drawn"]

    def kept(text):
        words = set(folded_words(text))
        banded = {w for w in words if w in lexicon["band"]}
        own = banded or words
        return [frozenset(w for w in own if j in drawn(w)) for j in range(subsets)]

    def of(a, b):
        x, y = kept(a), kept(b)
        either = [j for j in range(subsets) if x[j] or y[j]]
        return sum(x[j] == y[j] for j in either) / len(either) if either else 1.0

    return of


def bootstrap(scanned, rounds, least_seeds, least_pattern, least_instance, smoothing, unseen):
    """scanned: {doc: mentions}; {doc: {(kind, start, end)}} of what patterns discover, in plain dictionaries."""
    edges = defaultdict(bool)
    for mentions in scanned.values():
        for m in mentions:
            for p in m["patterns"]:
                edges[m["kind"], p, m["instance"]] |= m["seed"]
    confidence, seeds = {}, {}
    for (kind, _, x), seed in edges.items():
        confidence[kind, x] = max(confidence.get((kind, x), 0.0), 1.0 if seed else 0.0)
        seeds[kind, x] = seeds.get((kind, x), False) or seed
    trusted = {}
    for _ in range(rounds):
        of = defaultdict(list)
        for (kind, p, x), seed in edges.items():
            of[kind, p].append((x, seed))
        trusted = {}
        for (kind, p), own in of.items():
            known = sum(confidence[kind, x] for x, _ in own)
            score = known / (known + unseen * (len(own) - known) + smoothing)
            if score >= least_pattern and sum(s for _, s in own) >= least_seeds:
                trusted[kind, p] = score
        miss = defaultdict(float)
        for kind, p, x in edges:
            miss[kind, x] += math.log1p(-min(trusted.get((kind, p), 0.0), 0.999))
        confidence = {k: 1.0 if seeds[k] else 1 - math.exp(v) for k, v in miss.items()}
    return {
        d: {(m["kind"], m["start"], m["end"]) for m in mentions if (not m["seed"] or m["kind"] == 4) and confidence.get((m["kind"], m["instance"]), 0) >= least_instance and any((m["kind"], p) in trusted for p in m["patterns"])}
        for d, mentions in scanned.items()
    }


def audit(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic); every document walks through every order."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    parts = defaultdict(list)
    for d, text, lang in docs:
        t = text or ""
        w = plain_words(t)
        first = least.get(t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": first is not None and d != first,
        }
        parts[lang or ""].append((fails, d in good, d in toxic))
    out = []
    for part, own in parts.items():
        shapley, rows = defaultdict(int), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                here = [x for x in left if x[0][f]]
                redundant = sum(x[0][f] for x in own) - len(here)
                unique = sum(x[0][f] and sum(x[0].values()) == 1 for x in own)
                left = [x for x in left if not x[0][f]]
                shapley[f] += len(here)
                rows.append((f, "".join(order), step, len(left), len(here), redundant, unique, sum(x[1] for x in here), sum(x[2] for x in here)))
        out += [(part, *r[1:], shapley[r[0]]) for r in rows]
    return out


def line_dedup(docs, least_chars=40, least_documents=5):
    """docs: (doc_id, text), each row a document."""
    white = " \t\n\x0b\x0c\r"
    key = lambda line: lower_ascii(line.strip(white))
    holders = defaultdict(list)
    for d, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least_chars:
                holders[k].append(d)
    last = {k: max(named) for k, own in holders.items() if len(own) >= least_documents and (named := [d for d in own if d is not None])}
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if last.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def alignment(docs, a_ids, a_bytes, b_ids, b_bytes):
    """docs: (doc_id, text); the ids of a text and the bytes of an id, for both; every pair of tokens is looked at by its byte range."""
    out, pair_counts, rows = [], defaultdict(int), []
    for d, text in docs:
        full = (" " + (text or "")).encode()
        a, b = (a_ids(text), b_ids(text)) if text else ([], [])
        if not text or b"".join(map(a_bytes, a)) != full or b"".join(map(b_bytes, b)) != full:
            rows.append((d, [], [], [], []))
            continue
        ends_a, ends_b = list(itertools.accumulate(len(a_bytes(i)) for i in a)), list(itertools.accumulate(len(b_bytes(i)) for i in b))
        shared = sorted(set(ends_a) & set(ends_b))
        place_a, place_b = {e: i + 1 for i, e in enumerate(ends_a)}, {e: i + 1 for i, e in enumerate(ends_b)}
        groups, i, j = [], 0, 0
        for cut in shared:
            groups.append((a[i : place_a[cut]], b[j : place_b[cut]]))
            i, j = place_a[cut], place_b[cut]
        links, j = [], 0
        for i, (id_a, end) in enumerate(zip(a, ends_a)):
            start = ends_a[i - 1] if i else 0
            while ends_b[j] <= start:
                j += 1
            k = j
            while k < len(b) and (ends_b[k - 1] if k else 0) < end:
                links.append((id_a, b[k]))
                k += 1
        for p in links:
            pair_counts[p] += 1
        rows.append((d, a, b, groups, links))
    best = defaultdict(int)
    for (_, b), n in pair_counts.items():
        best[b] = max(best[b], n)
    for d, a, b, groups, links in rows:
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(pair_counts[p] == best[p[1]] for p in links), sum(pair_counts[p] for p in links), sha(spelled) if a else ""))
    return out
