"""Small tables and brute-force versions for the operators' tests."""

import random
import re
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def prose(rng: random.Random, n: int) -> str:
    """Invented words, a few of them common."""
    parts = ["ba", "ko", "ri", "tun", "sel", "mo", "gra", "phi", "lo", "ze"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(seed: int = 0) -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([3, 40, 150, 400])) for _ in range(40)]
    passage = prose(rng, 120)
    base = prose(rng, 300)
    for k in range(12):
        words = base.split()
        for _ in range(k):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(1000)}"
        texts.append(" ".join(words))
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(5)]
    texts += [texts[5], texts[5], texts[7], base.upper(), "", None, None, " \t\n", "one", "one", "one two", "é" * 900, "ab " * 500, prose(rng, 9000)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", None]), len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[5], (None, texts[9], None, None, None), (None, None, "en", "src0", 0)]


def shingles(text, size):
    words = WORDS.findall((text or "").encode().translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def near_groups(rows, size, percent):
    """doc_id to (set size, smallest linked id) of rows with an id, by all pairs that share a shingle."""
    sets = {r[0]: shingles(r[1], size) for r in rows if r[0] is not None}
    holders, parent = {}, {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, s in sets.items():
        common = Counter()
        for x in s:
            common.update(holders[x])
        for j, k in common.items():
            if j < i and 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def without_repeats(texts, length):
    """For each text the maximal runs of bytes inside a string of ``length`` that starts twice."""
    texts = [(t or "").encode() for t in texts]
    times = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        runs = []
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        out.append(runs)
    return out
