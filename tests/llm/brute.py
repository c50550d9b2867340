"""Plain versions of the corpus operators, one document after the other."""

import random
import re

BLANK_WORD = re.compile("[^\x20\x09-\x0d]+")
ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return BLANK_WORD.findall(text or "")


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    found, places, covered = words(text), {}, set()
    for i in range(len(found) - 7):
        places.setdefault(tuple(found[i : i + 8]), []).append(i)
    for at in places.values():
        if len(at) > 1:
            covered.update(k for i in at for k in range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return (
        len(found),
        sum(map(len, found)),
        symbols,
        len(lines) - len(set(lines)),
        len(covered),
    )


def without_repeats(docs, window):
    """{id: (n_words, n_removed, kept text)} of (id, text) rows."""
    low, out = {}, {}
    for doc, text in docs:
        found = words(text)
        for i in range(len(found) - window + 1) if doc is not None else ():
            key = tuple(found[i : i + window])
            low[key] = min(low.get(key, doc), doc)
    for doc, text in docs:
        found, gone = words(text), set()
        for i in range(len(found) - window + 1) if doc is not None else ():
            if low[tuple(found[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(found) if i not in gone)
        out[doc] = (len(found), len(gone), kept)
    return out


def contamination(docs, items, window=10):
    """{id: (n_words, n_hit, items)}."""
    windows, out = {}, {}
    for item, text in items:
        found = ITEM_WORD.findall((text or "").translate(LOWER))
        size = min(window, len(found))
        for i in range(len(found) - size + 1) if size else ():
            windows.setdefault(tuple(found[i : i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        found = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, named = set(), set()
        for size in sizes:
            for i in range(len(found) - size + 1):
                if by := windows.get(tuple(found[i : i + size])):
                    hit.update(range(i, i + size))
                    named |= by
        out[doc] = (len(found), len(hit), sorted(str(x) for x in named if x is not None))
    return out


def components(fingerprints, radius):
    """{id: smallest id reachable} of (id, fingerprint) rows."""
    root = {doc: doc for doc, _ in fingerprints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(fingerprints):
        for b, y in fingerprints[:i]:
            if (x ^ y).bit_count() <= radius:
                a_root, b_root = find(a), find(b)
                root[max(a_root, b_root)] = min(a_root, b_root)
    return {doc: find(doc) for doc, _ in fingerprints}


def texts(seed, count, longest, alphabet="ab"):
    """Rows (id, text) of few words, so that most windows repeat; then the odd cases."""
    draw = random.Random(seed)
    rows = [
        (i, " ".join(draw.choice(alphabet) for _ in range(draw.randint(0, longest))))
        for i in range(count)
    ]
    rows += [(10_000, None), (10_001, ""), (10_002, " \t\r\n"), (10_003, "a " * 3000)]
    return rows + [(10_004, rows[1][1]), (10_005, "É\u00a0ß\x1c日本 x")]
