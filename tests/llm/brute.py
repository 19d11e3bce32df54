"""Plain versions of the operators for small inputs."""

import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def simhash(text, shingle=4):
    found = WORD.findall((text or "").translate(LOWER))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + shingle]) for i in range(max(1, len(found) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def components(n, linked):
    """The smallest member of each member's component."""
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def words(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "th", "on", "st", "ing", "re", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
