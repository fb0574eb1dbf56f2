"""Plain versions of the operators, for small inputs."""

import re


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, width):
    w = words(text)
    return [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []


def simhash(text, width=4):
    import xxhash

    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, width)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None):
    """Rows of the documents table from texts (or pairs of id and text)."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    sources = sources or [f"s{i % 5}" for i in range(len(rows))]
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for (i, t), s in zip(rows, sources, strict=True)], DOCUMENTS)


# --- benchmark leaks, window by window -----------------------------------------------------------------------------------


def read_slots(text):
    """Slots of a text as (kind or None, plain words), word by word."""
    import unicodedata

    import regex

    from clinspark.llm.decontaminate import UNITS

    out, name_open, at = [], False, 0
    tokens = [(m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{N}]+", text)]
    for k, (i, j) in enumerate(tokens):
        word, between = text[i:j], text[at:i]
        inner = [p for p in range(i, j) if regex.match(r"\p{Lu}\p{Ll}", text[p : p + 2])]
        named = False
        if inner and inner[0] == i and i >= 2 and text[i - 1] in " \t":
            before = text[i - 2]
            if before in "\"',)]" and i >= 3 and regex.match(r"[^\s.!?:;\"'(\[\x01]", text[i - 3]):
                named = True
            elif regex.match(r"[^\s.!?:;\"'(\[\x01]", before):
                named = True
        low = word.lower()
        digit = lambda c: unicodedata.category(c) == "Nd"
        if out and named and name_open and set(between) <= set(" \t"):
            out[-1][1].append(low)
        elif out and not named and not name_open and len(between) == 1 and between in ".," and digit(text[i - 2]) and digit(word[0]):
            out[-1][1].append(low)
        else:
            kind = "<name>" if named else "<number>" if "0" <= low[0] <= "9" else "<unit>" if low in UNITS else None
            out.append([kind, [low]])
            name_open = named
        at = j
    for slot in out:
        if slot[0] == "<unit>" and len(slot[1]) > 1:
            slot[0] = None
    return [(k, tuple(w)) for k, w in out]


def leaks(docs, items, width=8, share=0.65, enough=18, band=16):
    """{(document, item): (windows, coverage, changed slots)} of pairs of id and text."""
    from collections import Counter, defaultdict
    from itertools import accumulate

    def windows_of(slots, words, w, form):
        if form:
            return [(i, tuple(words[i : i + w])) for i in range(len(words) - w + 1)]
        shape = [k or w for k, w in slots]
        return [(i, tuple(shape[i : i + w])) for i in range(len(slots) - w + 1)]

    found = {}
    read = lambda t: (lambda s: (s, [x for _, w in s for x in w]))(read_slots(t or ""))
    places = lambda slots: [0, *accumulate(len(w) for _, w in slots)]
    docs = [(d, *read(t)) for d, t in docs]
    docs = [(d, s, w, places(s), {}) for d, s, w in docs]
    for item, (slots, words) in ((i, read(t)) for i, t in items):
        m = len(words)
        if not m:
            continue
        wide = m if m < width else max(width // 2 + 1, (m - 1) // 2) if m <= 2 * width else width
        n = m - wide + 1
        place = places(slots)
        t = min(wide, len(slots))
        by = defaultdict(list)
        for i, shape in windows_of(slots, words, t, 0):
            if sum(not isinstance(x, str) for x in shape) >= min(4, t):
                by[0, shape].append(i)
        for i, shape in windows_of(slots, words, wide, 1):
            by[1, shape].append(i)
        for d, dslots, dwords, dplace, cut in docs:
            hits = []
            for form, w in ((0, t), (1, wide)):
                if (form, w) not in cut:
                    cut[form, w] = windows_of(dslots, dwords, w, form)
                for j, shape in cut[form, w]:
                    for i in by.get((form, shape), ()):
                        if form:
                            hits.append((j - i, i, wide, ()))
                        else:
                            filled = tuple((slots[i + k][0], slots[i + k][1], dslots[j + k][1], place[i + k]) for k in range(w) if slots[i + k][0])
                            hits.append((dplace[j] - place[i], place[i], place[i + w] - place[i], filled))
            cells = defaultdict(set)
            for h in set(hits):
                for g, c in enumerate((h[0], h[0] // band, (h[0] + band // 2) // band)):
                    cells[g, c].add(h)
            for run in cells.values():
                fills = Counter((k, a, b) for h in run for k, a, b, _ in h[3])
                best = {}
                for (k, a, b), c in fills.items():
                    best[k, a] = max(best.get((k, a), (0, ())), (c, b), key=lambda x: (x[0], "\x02".join(x[1])))
                chosen = {(k, a, b) for (k, a), (_, b) in best.items()}
                fits = [h for h in run if all((k, a, b) in chosen for k, a, b, _ in h[3])]
                refilled = {p + x for h in fits for k, a, b, p in h[3] if a != b for x in range(len(a))}
                covered = {p for h in fits for p in range(h[1], h[1] + h[2])}
                if len(fits) < len(run):
                    covered -= refilled
                windows = len({h[1] for h in fits})
                coverage = max(windows / n, len(covered) / m)
                changed = sum(a != b for (_, a), (_, b) in best.items())
                if coverage >= share or windows >= enough:
                    new = (coverage, windows, -changed)
                    found[d, item] = max(found.get((d, item), new), new)
    return {k: (w, round(c, 9), -x) for k, (c, w, x) in found.items()}


# --- boilerplate lines ----------------------------------------------------------------------------------------------------


def without_boilerplate(docs):
    """{id: text} of rows (id, text, site), line by line."""
    from collections import defaultdict

    lines = lambda t: [x.strip(" \t\r") for x in t.split("\n")]
    size = lambda x: x.count(" ") + 1 if x else 0
    sites = defaultdict(set)
    for _, t, s in docs:
        if t is not None and s is not None:
            for x in lines(t):
                sites[x].add(s)
    spread = {x for x, s in sites.items() if size(x) >= 3 and len(s) >= (3 if size(x) >= 20 else 8)}

    def pieces(x):
        w = x.split(" ")
        if len(w) < 5:
            return {x}
        return {" ".join(p) for p in ((w[:5], w[-5:]) if len(w) < 10 else (w[:5], w[5:10], w[-5:], w[-10:-5]))}

    holders = defaultdict(set)
    stats = {}
    for i, t, _ in docs:
        if t is not None:
            total, lost = sum(map(size, lines(t))), sum(size(x) for x in lines(t) if x in spread)
            stats[i, t] = total, lost
            if lost and lost >= 0.2 * total:
                for x in lines(t):
                    if x:
                        for p in pieces(x):
                            holders[p].add((i, t))
    out = {}
    for i, t, _ in docs:
        out[i] = t
        if t is None or not stats[i, t][1]:
            continue
        total, lost = stats[i, t]
        near = sum(size(x) for x in lines(t) if x and x not in spread and any(len(holders[p]) > 1 for p in pieces(x))) if lost >= 0.2 * total else 0
        if lost + near < 8 / 9 * total:
            out[i] = "\n".join(raw for raw, x in zip(t.split("\n"), lines(t), strict=True) if x not in spread)
    return out
