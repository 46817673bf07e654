"""Small documents with what can go wrong in them, and plain versions of what operators compute."""

import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size double, node long"
VOCABULARY = [f"{a}{b}{c}" for a in ("ba", "co", "du", "fe") for b in ("li", "mo", "na", "ré") for c in ("s", "t", "ns", "")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def documents(n: int = 60) -> list[tuple]:
    """Rows of ``SCHEMA``: copies, near copies, shared passages, junk, nulls, empties, a long text, clashing names."""
    rng = random.Random(5)
    texts: list[str | None] = [prose(rng, rng.randrange(25, 120)) for _ in range(n)]
    passage = prose(rng, 60)
    for i in range(5, 25, 5):
        texts[i] = prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30)
    base = prose(rng, 150).split(" ")
    for i in range(30, 42):
        copy = list(base)
        copy[rng.randrange(150)] = "changed"
        texts[i] = " ".join(copy)
    texts[43] = texts[44] = texts[45] = prose(rng, 80)
    texts[46] = "\n".join(["same line here"] * 30 + [prose(rng, 40)])
    texts[47] = "### $$$ && ||| <> " * 30
    texts[48] = "WORD!! " * 60
    texts[49], texts[50], texts[51], texts[52] = None, "", " \n\t ", "two words"
    texts[53] = prose(rng, 6000)
    texts[54] = "tab\tand  two   blanks\r\n\n" + prose(rng, 30) + "<|endoftext|> after\0zero"
    texts[55] = "日本語の文 und Übergröße, naïve café — " + prose(rng, 25)
    texts[56] = "abcabc" * 60
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", "c", None][min(i % 7, 3)], None if t is None else len(t), "x", -1.0, 7) for i, t in enumerate(texts)]
    rows.append(rows[12])
    rows.append((None, prose(rng, 40), "en", "a", 1, "x", -1.0, 7))
    return rows


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base_counts(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    found = words(text)
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    seen, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            inside.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def groups(nodes, links) -> dict:
    """Smallest reachable node of each node."""
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


def shingle_sets(rows, width: int) -> dict:
    out = {}
    for doc_id, text in rows:
        w = words(lower(text))
        out[doc_id] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    return out


def similar(rows, width: int, percent: int) -> dict:
    """doc_id: (size of the set, smallest doc_id of its component)."""
    sets = shingle_sets(rows, width)
    ids = sorted(sets)
    links = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    top = groups(ids, links)
    return {x: (len(sets[x]), top[x]) for x in ids}


def uncovered(rows, match: int = 100) -> dict:
    """doc_id: (bytes, removed, spans, what is left) with every repeated string of ``match`` bytes removed."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - match + 1):
            w = data[i : i + match]
            if w in seen:
                gone[i : i + match] = b"\1" * match
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(data), sum(gone), spans, bytes(c for c, g in zip(data, gone) if not g))
    return out
