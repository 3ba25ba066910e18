"""Plain versions of the operators, and a small table with the awkward cases in it."""

from __future__ import annotations

import random
import re
from hashlib import sha256

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `kept` string, `size` long, `h` long, `key` string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(seed=1, n=120):
    """(doc_id, text, lang, source, n_chars, and columns with clashing names): copies, near copies, shared passages,
    repeated rows, nulls, empty and long texts, odd white space."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 6))) for _ in range(300)]
    sentence = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, line = sentence(34), sentence(14)
    texts = []
    for i in range(n):
        t = "\n".join(sentence(r.randint(1, 40)) for _ in range(r.randint(1, 5)))
        kind = i % 10
        if kind == 1 and texts:
            t = r.choice(texts) or ""
        elif kind == 2 and texts:
            words = (r.choice(texts) or "x").split(" ")
            words[r.randrange(len(words))] = "zz"
            t = " ".join(words)
        elif kind == 3:
            t = sentence(5) + " " + passage + " " + sentence(6)
        elif kind == 4:
            t = line + "\n" + t + "\n" + line.replace(" ", "\t")
        elif kind == 5 and texts:
            t = (r.choice(texts) or "").upper()
        texts.append(t)
    texts += [None, "", " \t\n\x0b", "a", "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a", "x y z 日本語 🙂", "\n\n", sentence(4000), passage, passage]
    patterned = "".join("ab"[i.bit_count() % 2] for i in range(1024))  # words of over 1000 bytes
    texts += [f"{passage[:60]} {patterned} {line}", f"{passage[:60]} {patterned.translate({97: 98, 98: 97})} {line}"]
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["s1", "s2", "é", None]), None if t is None else len(t), "k", 1, 2, "q") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], None, None, 1, "k", 1, 2, "q"), (None, None, None, None, None, None, None, None, None)]
    r.shuffle(rows)
    return rows


def exact(rows):
    """(doc_id, text) -> (keep_id, group_size, sha) and how many rows of each text stay."""
    groups = {}
    for d, t in ((r[0], lowered(r[1])) for r in rows):
        groups.setdefault(t, []).append(d)
    keep = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    return sorted((str(r[0]), str(keep[lowered(r[1])]), len(groups[lowered(r[1])]), sha256(lowered(r[1]).encode()).hexdigest()) for r in rows), len(groups)


def simhash(text):
    words = WORD.findall(lowered(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(rows):
    """(doc_id, fingerprint, component) of each row, in order."""
    prints = [simhash(r[1]) for r in rows]
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(distinct):
        for q in distinct[:i]:
            if (p ^ q).bit_count() <= 2:
                a, b = find(p), find(q)
                root[max(a, b)] = min(a, b)
    low = {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            low[find(p)] = min(low.get(find(p), r[0]), r[0])
    return sorted((str(r[0]), f"{p:016x}", str(low.get(find(p)))) for r, p in zip(rows, prints, strict=True))


def substrings(rows, window=20):
    """(doc_id, n_words, n_removed, sha) of each row; rows at the same place don't remove each other."""
    order = lambda r: (r[0] is None, r[0] or 0)
    first = {}
    for r in sorted(rows, key=order):
        w = WORD.findall(r[1] or "")
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (*order(r), s))
    out = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (*order(r), s):
                gone |= set(range(s, s + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(r[0]), len(w), len(gone), sha256(kept.encode()).hexdigest()))
    return sorted(out)


def lines(rows, size=1):
    """(doc_id, n_lines, lines that go, sha) of each row: a line goes for an earlier one, by its doc_id and place.
    Tokens are runs of `size` words."""
    place = lambda r, k: (r[0] is None, r[0] or 0, k)
    split = lambda line: tuple(x for x in re.split(r"[\x20\x09-\x0D]+", line) if x)
    tokens = lambda w: frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset([w])
    first = {}
    for at, w in sorted((place(r, k), split(line)) for r in rows for k, line in enumerate((r[1] or "").split("\n"))):
        if w:
            first.setdefault(w, at)
    sets = [(at, tokens(w)) for w, at in first.items()]
    near = {w for w, at in first.items() if any(o < at and 5 * len(tokens(w) & t) >= 4 * len(tokens(w) | t) for o, t in sets)}
    out = []
    for r in rows:
        all_ = (r[1] or "").split("\n")
        stay = [line for k, line in enumerate(all_) if not (w := split(line)) or (first[w] == place(r, k) and w not in near)]
        out.append((str(r[0]), len(all_), len(all_) - len(stay), sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places = {}
    for s in range(len(w) - 7):
        places.setdefault(tuple(w[s : s + 8]), []).append(s)
    covered = {i for ss in places.values() if len(ss) > 1 for s in ss for i in range(s, s + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)
