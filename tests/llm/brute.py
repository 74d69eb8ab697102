"""Plain versions of what the operators do, for small inputs."""

import hashlib
import itertools
import math
import re
import struct
from collections import defaultdict

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def jaccard_components(docs, n, t):
    """{id: (size, least linked id)}"""
    sets, up = {}, {}
    for i, x in docs:
        w = WORD.findall((x or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        up[i] = i

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    having = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            having[g].append(i)
    for i, s in sets.items():
        common = defaultdict(int)
        for g in s:
            for j in having[g]:
                if j < i:
                    common[j] += 1
        for j, k in common.items():
            if 100 * k >= t * (len(s) + len(sets[j]) - k):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def without_repeats(docs, length):
    """[(id, bytes, removed, spans, kept)]"""
    raws = [(i, (t or "").encode()) for i, t in docs]
    seen = defaultdict(list)
    for at, (_, b) in enumerate(raws):
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]].append((at, k))
    cover = [bytearray(len(b)) for _, b in raws]
    for places in seen.values():
        if len(places) > 1:
            for at, k in places:
                cover[at][k : k + length] = b"\1" * length
    out = []
    for (i, b), c in zip(raws, cover, strict=True):
        runs = sum(1 for k in range(len(c)) if c[k] and (k == 0 or not c[k - 1]))
        out.append((i, len(b), sum(c), runs, bytes(x for x, y in zip(b, c, strict=True) if not y)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[4]))


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(d)) % 10 == 0


def identifiers(text):
    """[(start, kind, end)]"""
    out = []
    for k, (name, p) in enumerate(PII.items()):
        for m in re.finditer(p, text or ""):
            v = m.group()
            n = sum(c.isdigit() for c in v)
            if name == "ip" and any(int(x) > 255 for x in v.split(".")):
                continue
            if name == "card" and not (12 <= n <= 19 and luhn(v)):
                continue
            if name == "phone" and not 9 <= n <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def entities_of(text):
    """kind, kind~class and kind=value of each identifier."""
    out = set()
    for a, k, b in identifiers(text):
        v = text[a:b]
        digits = "".join(c for c in v if c.isdigit())
        of = [v.split("@")[-1].lower(), ".".join(v.split(".")[:2]) + ".", digits[:6], re.match(r"\+[0-9]{1,3}", v + "").group() if v[0] == "+" else ""][k]
        out |= {f"{k}", f"{k}~{of}", f"{k}={v}"}
    return out


def disclosing_terms(docs, alpha, support):
    """{term: whether it is certain} by a plain loop over all entities and terms. docs: [text]"""
    held, words, seen = [], [], set()
    for t in docs:
        t = t or ""
        if t in seen and identifiers(t):
            continue  # equal texts with identifiers count once
        seen.add(t)
        blank = list(t)
        for a, _, b in identifiers(t):
            blank[a:b] = " " * (b - a)
        held.append(entities_of(t))
        words.append({w.lower() for w in re.findall(r"[^\W_]{2,}", "".join(blank))})
    n, df_e, df_t, both = len(held), defaultdict(int), defaultdict(int), defaultdict(int)
    for es, ws in zip(held, words, strict=True):
        for w in ws:
            df_t[w] += 1
        for e in es:
            df_e[e] += 1
            for w in ws:
                both[e, w] += 1
    out = {}
    for (e, w), k in both.items():
        m, z = df_t[w], 1.2816
        p = k / m
        low = (p + z * z / (2 * m) - z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
        if df_e[e] < n and k >= support and math.log2(low * n / df_e[e]) >= alpha * math.log2(n / df_e[e]) - 1e-9:
            out[w] = out.get(w, False) or k >= df_t[w]
    return out


def term_spans(text, given):
    """[(start, end)] of given terms outside identifiers."""
    blank = list(text or "")
    for a, _, b in identifiers(text):
        blank[a:b] = " " * (b - a)
    return [m.span() for m in re.finditer(r"[^\W_]{2,}", "".join(blank)) if m.group().lower() in given]


def topic_of(t):
    if not t:
        return "empty"
    if " | " in t:
        return "table"
    if re.search(r"[#$%&*]{3}", t):
        return "marked"
    if "!!" in t:
        return "shouting"
    if "Licen" in t:
        return "notice"
    return "long prose" if len(t) > 6000 else "prose"


def uniform(id, seed=42):
    """The number between 0 and 1 that a document is drawn by: XXH64 of the seed, then of the id."""
    first = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    return (xxhash.xxh64_intdigest(struct.pack("<q", id), first) >> 11) / float(1 << 53)


def mixed_documents(docs, share, power=0.7):
    """{id: (tokens, probability, sampled)} by plain raking. docs: (id, lang, source, text)"""
    cell, tokens, cells = {}, {}, defaultdict(float)
    for i, lang, source, text in docs:
        cell[i], tokens[i] = (source or "(none)", lang or "(none)", topic_of(text)), len(WORD.findall(text or ""))
        cells[cell[i]] += tokens[i]
    w, targets = {c: n for c, n in cells.items() if n}, []
    for d in range(3):
        sums = defaultdict(float)
        for c, n in w.items():
            sums[c[d]] += n
        all_of = sum(n**power for n in sums.values())
        targets.append({k: n**power / all_of for k, n in sums.items()})
    for _ in range(500):
        for d in range(3):
            have = defaultdict(float)
            for c, x in w.items():
                have[c[d]] += x
            w = {c: x * targets[d][c[d]] / have[c[d]] for c, x in w.items()}
    budget, c, sure = share * sum(cells.values()), 0.0, set()
    while True:
        rest = sum(x for k, x in w.items() if k not in sure)
        c = (budget - sum(cells[k] for k in sure)) / rest
        more = {k for k, x in w.items() if x / cells[k] * c >= 1}
        if more <= sure:
            break
        sure |= more
    out = {}
    for i in tokens:
        k = cell[i]
        p = min(1.0, c * w[k] / cells[k]) if cells[k] else 1.0
        out[i] = (tokens[i], p, uniform(i) < p)
    return out


def lines_left(docs, min_docs, min_chars):
    """[(id, lines, dropped lines, text left)]"""
    order = lambda i: (i is None, i or 0)
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        goes = lambda k: len(k) >= min_chars and len(holders[k]) >= min_docs and i != min(holders[k], key=order)  # noqa: B023, E731
        left = [x for x in lines if not goes(key(x))]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def plain_alignment(rows, hf, sp):
    """[(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)] by the contract's words."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    told, links = [], []
    for i, text in rows:
        a = hf.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        bytes_a, bytes_b = [bytes(char[c] for c in hf.id_to_token(x)) for x in a], [piece(x) for x in b]
        if not text or not (b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode()):
            told.append((i, 0, 0, "")), links.append([])
            continue
        ends = lambda parts: list(itertools.accumulate(map(len, parts)))
        ea, eb = ends(bytes_a), ends(bytes_b)
        at_end = dict(zip(eb, b, strict=True))
        links.append([(x, at_end[p]) for x, p in zip(a, ea, strict=True) if p in at_end])
        both, groups, i_a, i_b = set(ea) & set(eb), [], 0, 0
        for cut in sorted(both):
            to_a, to_b = ea.index(cut, i_a) + 1, eb.index(cut, i_b) + 1
            groups.append(",".join(map(str, a[i_a:to_a])) + "|" + ",".join(map(str, b[i_b:to_b])))
            i_a, i_b = to_a, to_b
        told.append((i, len(a), len(b), ";".join(groups)))
    count = defaultdict(int)
    for x in links:
        for p in x:
            count[p] += 1
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(i, na, nb, g.count(";") + 1 if g else 0, len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), g) for (i, na, nb, g), x in zip(told, links, strict=True)]


def phrases(docs, longest, least, top):
    """[(lang, rank, phrase, a, l, r, n, score)] of (lang, text) rows by the contract's words."""
    f, n = defaultdict(int), defaultdict(int)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in found.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                if 100 * a >= 50 * found[lang, w[i : i + size]]:
                    gone.add((lang, w[i : i + size]))
    rows = defaultdict(list)
    for (lang, w), a in found.items():
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        if (lang, w) not in gone:
            rows[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in rows.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top])]
