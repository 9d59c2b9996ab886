"""Brute-force versions that several test modules share."""

import itertools
import random
import re
from collections import Counter

import public_tokenizers

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SPACE = r"[^\x20\x09-\x0D]+"
SF = "/root/testdata/sf0.001"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def shingles(text, width):
    w = re.findall(SPACE, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def groups_by_force(rows, width, percent=80):
    sets = [shingles(r["text"], width) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [x["doc_id"] for k, x in enumerate(rows) if find(k) == find(i) and x["doc_id"] is not None]
        out.append((r["doc_id"], len(sets[i]), min(ids, default=None)))
    return Counter(out)
