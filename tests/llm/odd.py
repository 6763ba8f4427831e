"""Tables with everything a table may hold, and brute-force versions of the operators."""

from __future__ import annotations

from collections import defaultdict

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, node long, size string"
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
EN = "the quick brown fox jumps over the lazy dog and then it runs home again."
DE = "der schnelle braune fuchs springt über den faulen hund und läuft dann heim."


def documents(spark):
    rows = [
        (1, f"{EN}\nSecond line of this text is here to stay.", "en", "a"),
        (2, f"{EN}\nSecond line of this text is here to stay.", "en", "a"),   # an exact copy
        (3, f"{DE}\nNoch eine Zeile, die bleiben soll.", "de", "b"),
        (3, f"{DE}\nNoch eine Zeile, die bleiben soll.", "de", "b"),          # a repeated row
        (4, None, "en", "b"), (5, "", None, "c"), (6, " \n\t ", "en", None), (7, "12 34 !!", "en", "c"),
        (None, "A text without an id still is a text of some words.", "en", None),
        (8, LONG, "en", "a"), (9, "x" * 100_000, "en", "c"), (10, "one two", "en", "b"), (11, "one two", "en", "b"),
        (12, "Released under the MIT License. Released under the MIT License.", "en", "d"),
        (13, f"{EN} {DE} " * 40, None, "d"), (14, "mail bob@example.com now\x00\U0001f600 ok", "en", "d"),
    ]
    return spark.createDataFrame([(i, t, l, s, len(t or ""), 1.0, "l", 2, "s") for i, t, l, s in rows], DOCUMENTS)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def near_components(rows):
    """(doc_id, text) rows -> {doc_id: smallest id reachable}, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1:]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: root(i) for i in parent}


def removed(rows):
    """(doc_id, text) rows in order -> {doc_id: removed line numbers}, with an inverted index over all words."""
    index, sets, gone = defaultdict(list), [], {}
    for doc_id, text in rows:
        gone[doc_id] = []
        for number, line in enumerate((text or "").split("\n")):
            own = frozenset(words(line))
            if len(own) < 3:
                continue
            shared = defaultdict(int)
            for word in own:
                for k in index[word]:
                    shared[k] += 1
            if any(9 * n >= 4 * (len(own) + len(sets[k])) for k, n in shared.items()):
                gone[doc_id].append(number)
            for word in own:
                index[word].append(len(sets))
            sets.append(own)
    return gone
