"""Plain Python versions of the operators of the pipeline, over lists of rows; written from the docstrings, without Spark or numpy.

A row is a dict with doc_id, text, lang, source. Samples for fitting are meant to hold all rows, so fixtures stay below them.
"""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"\w+")


def crc(text):
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def fold(doc_id, folds):
    return crc("" if doc_id is None else str(doc_id)) % folds


# --- language -------------------------------------------------------------------------------------------------------


def buckets(text, orders=(1, 2, 3), bits=16):
    """Counts of hashed n-grams: letters in lower case, one space after each word inside the text."""
    plain, spaced = [], False
    for c in (text or "").lower():
        if c.isalpha():
            plain.append(ord(c))
            spaced = True
        elif spaced:
            plain.append(32)
            spaced = False
    out = Counter()
    for n in orders:
        for i in range(len(plain) - n + 1):
            if n == 1 and plain[i] == 32:
                continue
            h = 0
            for k in range(n):
                h = (h * 0x100000001B3 + plain[i + k]) % 2**64 if k else plain[i]
            out[(((h + n) * 0x9E3779B97F4A7C15) % 2**64) >> (64 - bits)] += 1
    return out


def languages(rows, folds=3, held_out=1, alpha=0.1, size=1 << 16):
    """(prediction, score) of every row, learned outside the held-out fold."""
    train = [r for r in rows if r["lang"] is not None and fold(r["doc_id"], folds) != held_out]
    count = Counter(r["lang"] for r in train)
    found = {lang: Counter() for lang in count}
    for r in train:
        found[r["lang"]].update(buckets(r["text"]))
    out = []
    for r in rows:
        grams = buckets(r["text"])
        if not grams or not count:
            out.append(("und", 0.0))
            continue
        score = {}
        for lang in sorted(count):
            total = sum(found[lang].values()) + alpha * size
            score[lang] = math.log(count[lang] / len(train)) + sum(n * math.log((found[lang][g] + alpha) / total) for g, n in grams.items())
        top = max(score.values())
        best = next(lang for lang in sorted(score) if score[lang] == top)
        out.append((best, 1 / sum(math.exp(v - top) for v in score.values())))
    return out


# --- toxicity -------------------------------------------------------------------------------------------------------


def segments(hits, drift):
    """All maximal scoring segments' scores: the best stretch, then what is left and right of it."""
    if not hits:
        return []
    line = []
    last = 0
    for i, s in hits:
        line += [(drift * (i - last), False), (s, True)] if i > last else [(s, True)]
        last = i + 1

    def solve(part):
        best = (0.0, None)
        for a in range(len(part)):
            total = 0.0
            for b in range(a, len(part)):
                total += part[b][0]
                if total > best[0] + 1e-12:
                    best = (total, (a, b))
        if best[1] is None:
            return []
        a, b = best[1]
        return solve(part[:a]) + [best[0]] + solve(part[b + 1 :])

    return solve(line)


def near_copy(a, b, share=0.8):
    def runs(t):
        w = WORD.findall((t or "").lower())
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    x, y = runs(a), runs(b)
    return len(x & y) >= share * len(x | y)


def toxicity_scores(rows, labels, folds=5, held_out=0, drift=-0.3, prefixes=(6, 5, 4), prior_share=0.1, min_effect=2.0):
    """Score of every row; ``labels`` is {doc_id: toxic}. No two labelled texts of the fixture may be near copies."""
    train = [(r["text"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels and fold(r["doc_id"], folds) != held_out]
    assert not any(near_copy(a[0], b[0], 0.5) and a[1] == b[1] for a, b in combinations(train, 2))
    n = Counter(y for _, y in train)
    seen = {0: Counter(), 1: Counter()}
    for text, y in train:
        seen[y].update(set(WORD.findall((text or "").lower())))
    words = set(seen[0]) | set(seen[1])
    all1, all0 = sum(seen[1].values()), sum(seen[0].values())
    prior = prior_share * (all1 + all0)
    least_z = math.sqrt(2 * math.log(max(len(words), 2)))

    def judge(y1, y0):
        a = prior / (all1 + all0) * (y1 + y0)
        up, down = y1 + a, y0 + a
        effect = math.log(up / (all1 + prior - up)) - math.log(down / (all0 + prior - down))
        z = effect / math.sqrt(1 / up + 1 / down)
        return (effect, down / (all0 + prior)) if effect >= min_effect and z >= least_z else None

    scores, clean, left = {}, {}, words
    for k in (0, *prefixes):
        pool = defaultdict(lambda: [0, 0])
        for w in left:
            if k == 0 or len(w) > k:
                term = w if k == 0 else w[:k]
                pool[term][0] += seen[1][w]
                pool[term][1] += seen[0][w]
        kept = {t: j for t, (y1, y0) in pool.items() if (j := judge(y1, y0))}
        scores |= {(k, t): j[0] for t, j in kept.items()}
        clean |= {(k, t): j[1] for t, j in kept.items()}
        left = {w for w in left if not ((w in kept) if k == 0 else (len(w) > k and w[:k] in kept))}

    def known(w):
        for key in [(0, w), *((k, w[:k]) for k in prefixes if len(w) > k)]:
            if key in scores:
                return scores[key]
        return None

    def hits(text):
        ws = WORD.findall((text or "").lower())
        return len(ws), [(i, s) for i, w in enumerate(ws) if (s := known(w)) is not None]

    rest = max(0.0, 1 - sum(clean.values()))

    def excess(x):
        return sum(p * math.exp(min(x * scores[t], 600)) for t, p in clean.items()) + rest * math.exp(x * drift) - 1

    low, high = 1e-6, 1.0
    while excess(high) < 0:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    rate = high
    scanned = [(y, *hits(t)) for t, y in train]
    scanned = [(y, m, segments(h, drift)) for y, m, h in scanned]
    tokens = sum(m for y, m, _ in scanned if not y)
    chance = sorted(x for y, _, f in scanned if not y for x in f)
    cut = chance[len(chance) // 2] if chance else min(scores.values())
    log_k = math.log((sum(x >= cut for x in chance) + 0.5) / max(tokens, 1)) + rate * cut

    def evidence(m, found):
        floor = log_k + math.log(max(m, 1))
        best = total = 0.0
        for r, x in enumerate(sorted((rate * s - floor for s in found if rate * s - floor > 0), reverse=True), 1):
            total += x
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
        return min(best, 60.0)

    xs, ys = [evidence(m, f) for _, m, f in scanned], [y for y, _, _ in scanned]
    base = slope = 0.0  # ridge logistic fit by Newton steps
    for _ in range(100):
        g0, g1, a, b, c = -1e-3 * base, -slope, 1e-3, 0.0, 1.0
        for x, y in zip(xs, ys, strict=True):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, base + slope * x))))
            g0, g1 = g0 + y - p, g1 + (y - p) * x
            w = p * (1 - p)
            a, b, c = a + w, b + w * x, c + w * x * x
        det = a * c - b * b
        s0, s1 = (c * g0 - b * g1) / det, (a * g1 - b * g0) / det
        size = max(abs(s0), abs(s1))
        base, slope = base + s0 * min(1, 2 / max(size, 1e-12)), slope + s1 * min(1, 2 / max(size, 1e-12))
        if size < 1e-9:
            break
    slope = max(slope, 0.0)
    out = []
    for r in rows:
        m, h = hits(r["text"])
        out.append(1 / (1 + math.exp(-(base + slope * evidence(m, segments(h, drift))))))
    return out, {"rate": rate, "log_k": log_k, "scores": scores, "clean": clean}


# --- near copies ----------------------------------------------------------------------------------------------------


def classes(rows, threshold=0.8):
    """Class number of every row by the exact weighted Jaccard similarity of all pairs; wordless rows are alone."""
    grams = []
    for r in rows:
        w = WORD.findall((r["text"] or "").lower())
        grams.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if grams[i] and grams[j] and sum((grams[i] & grams[j]).values()) >= threshold * sum((grams[i] | grams[j]).values()):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def one_of_each(rows):
    """Of each class the row with the least doc_id, null last."""
    best = {}
    for r, c in zip(rows, classes(rows), strict=True):
        key = (r["doc_id"] is None, r["doc_id"])
        if c not in best or key < (best[c]["doc_id"] is None, best[c]["doc_id"]):
            best[c] = r
    return list(best.values())


# --- mixing ---------------------------------------------------------------------------------------------------------


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, pattern=(5.0, 2.0, 1.0), share=1.5, cap=2.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: pattern[i % len(pattern)] for i, s in enumerate(order)}
    full, total = set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in sizes if s not in full]
        if not open_ or not total:
            return {s: cap * sizes[s] if total else 0.0 for s in sizes}
        level = max(0.0, total - sum(cap * sizes[s] for s in full)) / sum(weight[s] for s in open_)
        more = {s for s in open_ if cap * sizes[s] <= weight[s] * level}
        if not more:
            return {s: cap * sizes[s] if s in full else weight[s] * level for s in sizes}
        full |= more


def copies(rows, unit, cap=2.0):
    """Copies of every row; ``unit`` is the hash place of each."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += size_of(r["text"])
    goal, out = targets(sizes, cap=cap), [0] * len(rows)
    for s in sizes:
        mine = [i for i, r in enumerate(rows) if r["source"] == s]
        n = {i: size_of(rows[i]["text"]) for i in mine}
        mean = sizes[s] / len(mine)
        if goal[s] >= cap * sizes[s] * (1 - 1e-12):
            rate = dict.fromkeys(mine, cap)
        else:
            low, high = -1.0, 1.0

            def at(tilt):
                return {i: min(cap, math.exp(min(tilt * n[i] / mean, 1.0))) for i in mine}

            def words(tilt):
                return sum(n[i] * x for i, x in at(tilt).items())

            while words(low) > goal[s]:
                low *= 2
            while words(high) < goal[s]:
                high *= 2
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (mid, high) if words(mid) < goal[s] else (low, mid)
            rate = at((low + high) / 2)
        rate = {i: x if n[i] else 1.0 for i, x in rate.items()}
        for i in mine:
            out[i] = math.floor(rate[i] + 1e-9)
        wanted = goal[s] - sum(out[i] * n[i] for i in mine)
        share = {i: rate[i] - out[i] for i in mine if rate[i] - out[i] > 1e-9 and n[i]}
        run = 0.0
        for i in sorted(share, key=lambda i: unit[i] / (unit[i] + share[i])):
            if run >= wanted:
                break
            run += n[i]
            if run - n[i] / 2 <= wanted:
                out[i] += 1
    return out


# --- tokens ---------------------------------------------------------------------------------------------------------


def token_row(library, doc_id, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    packed = b"".join(i.to_bytes(4, "little") for i in ids)
    return (doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), tuple(ids))
