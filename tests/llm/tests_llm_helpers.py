"""Plain versions of operators, written down as they are defined."""


def similar_groups(texts, shingle=5, similarity=0.8):
    """For each text the number of the first one that links of at least that similarity lead to."""
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    first = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(sets)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if first[i] != first[j] and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                    first[i] = first[j] = min(first[i], first[j])
                    changed = True
    return first


def remove_seen(text, match):
    """Texts by id without the bytes in strings that a smaller id has; emptied ones go."""
    least, out = {}, {}
    for i in sorted(text):
        b = text[i].encode()
        for k in range(len(b) - match + 1):
            least.setdefault(b[k : k + match], i)
    for i, t in text.items():
        b, gone = t.encode(), bytearray(len(t.encode()))
        for k in range(len(b) - match + 1):
            if least[b[k : k + match]] < i:
                gone[k : k + match] = b"\x01" * match
        kept = bytes(x for x, g in zip(b, gone) if not g)
        if kept or not b:
            out[i] = kept.decode("utf-8", "ignore")
    return out
