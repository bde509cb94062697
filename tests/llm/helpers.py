"""Plain versions of the operators, and documents with the odd cases."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def components(rows, percent=75):
    """Smallest doc_id that links lead to, for (doc_id, text) rows of different ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def kept_words(rows, window=20):
    """Words left of (doc_id, text) rows of different ids."""
    first, out = {}, {}
    for i, text in sorted(rows):
        w = words(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k : k + window]), (i, k)) != (i, k):
                gone.update(range(k, k + window))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def line_template(line, depth=6):
    """The words of a line, None for those with a digit; if the leading ones all have one, the words as they are."""
    w = words(line)
    masked = tuple(None if re.search("[0-9]", x) else x for x in w)
    return masked if any(masked[:depth]) else tuple(w)


def alike(a, b, percent=75):
    fixed = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return 100 * sum(x == y for x, y in fixed) >= percent * len(fixed)


def without_recurring_lines(rows, min_docs=5, depth=6):
    """Texts by id, of rows with different ids: lines are compared with the most frequent line that has a quarter in common."""
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if words(line):
                holders.setdefault(line_template(line, depth), set()).add(i)
    sharing = {}
    for t in holders:
        sharing.setdefault(("whole", t), []).append(t)
        tail = max(0, len(t) - depth)
        for k in range(4):
            part = t[depth + tail * k // 4 : depth + tail * (k + 1) // 4]
            if part:
                sharing.setdefault((len(t), t[:depth], k, part), []).append(t)
    drop = {}
    for lines in sharing.values():
        lead = max(lines, key=lambda t: (len(holders[t]), -min(holders[t])))
        members = [t for t in lines if alike(t, lead)]
        docs = set().union(*[holders[t] for t in members])
        if len(docs) >= min_docs:
            for t in members:
                drop.setdefault(t, set()).update(holders[t] - {min(docs)})
    out = {}
    for i, text in rows:
        out[i] = "\n".join(x for x in (text or "").split("\n") if not words(x) or i not in drop.get(line_template(x, depth), ()))
    return out


def statistics(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    where = {}
    for k in range(len(w) - 4):
        where.setdefault(tuple(w[k : k + 5]), []).append(k)
    repeated = {k + j for places in where.values() if len(places) > 1 for k in places for j in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))


def leaks(text, item, percent=75):
    plain = lambda t: re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", " ", (t or "").translate(LOWER))
    mine, its = shingles(plain(text)), shingles(plain(item))
    return bool(its) and 100 * len(mine & its) >= percent * len(its)


PASSAGE = " ".join(f"p{k}" for k in range(60))

#: Nulls, empty and blank texts, a very long text, ties, repeated rows, one word, long words.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "a b c d"), (7, PASSAGE), (8, PASSAGE), (9, "x " + PASSAGE + " y"),
    (10, " ".join(f"w{k % 997}" for k in range(30_000))), (11, "q" * 5000), (12, "z z z z z z z z z z z z z z z z z z z z z z z z z"),
    (13, "z " * 40), (14, PASSAGE + "\n" + PASSAGE), (15, "Licence text 12 applies here today\nown line of fifteen"),
    *[(20 + k, f"Licence text {k} applies here today\nunique{k} words{k} only{k} in{k} this{k} one{k}") for k in range(6)],
]
