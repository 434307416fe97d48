"""A brute-force model of sketching in plain Python, for comparison."""

from collections import Counter

import xxhash

CODE = {"A": 0, "C": 1, "T": 2, "G": 3}
OTHER = str.maketrans("ACGT", "TGCA")


def number(s):
    n = 0
    for c in s:
        n = 4 * n + CODE[c]
    return n


def canonical(s):
    return min(number(s), number(s.translate(OTHER)[::-1]))


def hashed(code):
    return xxhash.xxh64_intdigest(code.to_bytes(8, "little"), seed=1312)


def minimizers(seq, k, m):
    """(pos, minimizer, hash, offset of its leftmost occurrence) of every k-mer."""
    codes = [canonical(seq[i : i + m]) for i in range(len(seq) - m + 1)]
    keys = [hashed(c) for c in codes]
    out = []
    for i in range(len(seq) - k + 1):
        at = min(range(i, i + k - m + 1), key=lambda j: (keys[j], j))
        out.append((i, codes[at], keys[at], at))
    return out


def sketch(seqs, k, m, threshold, abundance=1):
    counts = Counter()
    for seq in seqs:
        for i, code, h, _ in minimizers(seq, k, m):
            if h <= threshold:
                counts[code, canonical(seq[i : i + k])] += 1
    return {key: n for key, n in counts.items() if n >= abundance}


def tracked(seq, k, m):
    """Super-k-mers of a sequence by a scan that remembers one position: (start, length, minimizer, reversed)."""
    w = k - m
    number_at = [number(seq[i : i + m]) for i in range(len(seq) - m + 1)]
    code = [canonical(seq[i : i + m]) for i in range(len(seq) - m + 1)]
    key = [hashed(c) for c in code]
    turned = [c != n for c, n in zip(code, number_at)]

    def search(start):
        best, place, rev = code[start + w], 0 if turned[start + w] else w, turned[start + w]
        for i in range(1, w + 1):
            at = start + w - i
            if key[at] < hashed(best):
                best, place, rev = code[at], w - i, turned[at]
            elif code[at] == best and turned[at] == rev:
                place = min(place, i if rev else w - i)
        return best, place, rev

    out, begun = [], 0
    best, place, rev = search(0)
    old = best, rev
    for i in range(len(seq) - k):
        cut = False
        if key[i + 1 + w] < hashed(best):
            best, place, rev = code[i + 1 + w], i + 1 + w, turned[i + 1 + w]
            cut = True
        elif i >= place:
            best, place, rev = search(i + 1)
            place += i + 1
            cut = True
        if cut:
            out.append((begun, i + k - begun, *old))
            begun, old = i + 1, (best, rev)
    return [*out, (begun, len(seq) - begun, *old)]
