"""Suffix dedup: front-coded sorted suffix runs, merged by loser trees that know common prefixes.

A byte string of `match` bytes that occurs in two documents has, in both, the same anchor: the
position whose `seed`-byte string has the smallest hash among those inside the string. So only
suffixes at anchors are sorted, each with the bytes that any match round the anchor can use: up
to `match` bytes from the anchor on, then up to `match - seed` bytes before it, read backwards.

1. Every batch of texts sends the hashes of its anchors' seeds (narrow ones: a false hit costs
   time only); each gets one bit back, set if the seed occurs in another document too.
2. The suffixes at those anchors are sorted in the batch, one run for each range of seed hashes,
   front-coded (length of the prefix shared with the entry before, then the rest) and exchanged.
3. A range's runs are merged by a loser tree whose nodes carry the common prefix with the last
   winner: two suffixes are compared only behind the prefix they are known to share. The merged
   common prefixes show which documents share each string; what a smaller doc_id has too goes
   back to the batch as byte ranges.

A seed that more batches have than one merge takes (the edge of a passage in a third of all
documents) has as many different surroundings as documents. Such seeds are known from step 1. Round
them the suffixes are cut to whole strings of `match` bytes, so that they spread over ranges of
strings, and go through the same runs and loser trees in two levels: groups of batches first, whose
runs of different strings are merged then. Equality is always that of bytes.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
from pyspark.sql import DataFrame

from .batches import NO_ID, Batch, covered, dealt, pack_bits, parts_of, sha256, unpack_bits
from .common import K1, mix, planes, ship, unplanes, window_hash

SEED_BASE = 0xC2B2AE3D27D4EB4F
RANGES, STRINGS, MEMO, REPLY = range(4)  # kinds of rows between merges


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Minimum or maximum of every `width` consecutive values, from windows of doubling length."""
    size = 1
    while size * 2 <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    return best(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def anchors(data: np.ndarray, ends: np.ndarray, match: int, seed: int, chunk: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors and the 64-bit hashes of their seeds, chunk by chunk."""
    n, width = len(data), match - seed + 1
    at, seeds = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    step = np.zeros(n + 1, np.int32)
    a, b = ends[:-1], ends[1:]
    long_ = b - a >= match
    np.add.at(step, a[long_], 1)
    np.add.at(step, b[long_] - match + 1, -1)
    valid = np.cumsum(step, out=step) > 0  # where a string of `match` bytes starts that stays in one text
    for s in range(0, n, chunk):
        lo, hi = max(0, s - width + 1), min(n, s + chunk + match)
        if hi - lo < match:
            continue
        hashes = mix(window_hash(data[lo:hi].astype(np.uint64) + np.uint64(1), seed, SEED_BASE))
        rank = np.maximum((hashes >> np.uint64(32)).astype(np.uint32), 1)  # 0 stands for no string
        least = sliding(rank, width, np.minimum)  # for each string
        chosen = np.zeros(len(least) + 2 * (width - 1), np.uint32)
        chosen[width - 1 : len(least) + width - 1] = np.where(valid[lo : lo + len(least)], least, 0)
        found = np.flatnonzero(sliding(chosen, width, np.maximum)[: len(rank)] == rank)
        found = found[(found >= s - lo) & (found < s + chunk - lo)]
        at.append(found + lo)
        seeds.append(mix(hashes[found] * K1))  # chosen for being small: spread them evenly again
    return np.concatenate(at), np.concatenate(seeds)


def contexts(data: np.ndarray, ends: np.ndarray, at: np.ndarray, doc: np.ndarray, match: int, seed: int) -> np.ndarray:
    """A row of bytes for each anchor: what follows, what precedes backwards, both padded, and the two true lengths."""
    before = match - seed
    right = np.minimum(ends[doc + 1] - at, match)
    left = np.minimum(at - ends[doc], before)
    out = np.zeros((len(at), match + before + 2), np.uint8)
    padded = np.concatenate([np.zeros(before, np.uint8), data, np.zeros(match, np.uint8)])
    for k in range(match):
        out[:, k] = np.where(k < right, padded[at + before + k], 0)
    for k in range(before):
        out[:, match + k] = np.where(k < left, padded[at + before - 1 - k], 0)
    out[:, -2], out[:, -1] = right, left
    return out


def front_coded(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Of sorted rows that all differ: prefix lengths shared with the row before, and the rests behind one another."""
    shared = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        shared[1:] = (rows[1:] != rows[:-1]).argmax(axis=1)
    return shared, rows[np.arange(rows.shape[1]) >= shared[:, None]].tobytes()


class Run:
    """A front-coded run, read entry by entry."""

    __slots__ = ("at", "head", "lcp", "n", "payload", "place", "shared", "width")

    def __init__(self, shared: bytes, payload: bytes, width: int):
        self.shared, self.payload, self.width = shared, payload, width
        self.n, self.place, self.at, self.head, self.lcp = len(shared), -1, 0, b"", 0

    def step(self) -> bool:
        """On to the next entry; lcp is then what it shares with the entry before."""
        self.place += 1
        if self.place == self.n:
            return False
        self.lcp = self.shared[self.place]
        to = self.at + self.width - self.lcp
        self.head = self.head[: self.lcp] + self.payload[self.at : to]
        self.at = to
        return True


def merged(runs: list[Run], width: int):
    """Yield (number of the run, number of the entry in it, prefix shared with the entry yielded before).

    A loser tree. Each node's loser carries its common prefix with the winner it lost to, and each
    run its common prefix with the last entry yielded: of two, the longer prefix wins unread, and
    only at equal prefixes are the bytes behind them compared. A full prefix marks an equal entry.
    """
    size = 1 << max(0, (len(runs) - 1).bit_length())
    lcp, head = [0] * size, [b""] * size
    done = [True] * size
    for k, run in enumerate(runs):
        if run.step():
            done[k], head[k], lcp[k] = False, run.head, 0
    losers = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's lcp becomes the one with the winner."""
        if done[a] or done[b]:
            return (b, a) if done[a] else (a, b)
        p, q = lcp[a], lcp[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        if p >= width:
            return (a, b)
        x, y = head[a], head[b]
        differ = int.from_bytes(x[p:], "big") ^ int.from_bytes(y[p:], "big")
        if not differ:
            lcp[b] = width
            return (a, b)
        h = width - (differ.bit_length() + 7) // 8
        if x[h] < y[h]:
            lcp[b] = h
            return (a, b)
        lcp[a] = h
        return (b, a)

    def build(node: int) -> int:
        if node >= size:
            return node - size
        win, lose = play(build(2 * node), build(2 * node + 1))
        losers[node] = lose
        return win

    top = build(1) if runs else 0
    while runs and not done[top]:
        run = runs[top]
        yield top, run.place, lcp[top]
        if run.step():
            head[top], lcp[top] = run.head, run.lcp
        else:
            done[top] = True
        node, win = (top + size) >> 1, top
        while node:
            win, losers[node] = play(win, losers[node])
            node >>= 1
        top = win


def ranges_to_remove(order_lcp: np.ndarray, rows: np.ndarray, smallest: np.ndarray, match: int, seed: int) -> np.ndarray:
    """For each distinct suffix and each distance of a match's start before the anchor, the smallest doc_id that has the match.

    rows: distinct contexts in merged order; order_lcp: prefix shared with the one before;
    smallest: smallest doc_id of each. Documents too short for a match get NO_ID.
    """
    before, n = match - seed, len(rows)
    right, left = rows[:, -2], rows[:, -1]
    out = np.full((n, before + 1), NO_ID)
    backwards = np.ascontiguousarray(rows[:, match : match + before])
    by_left = np.argsort(backwards.view(f"S{before}").ravel(), kind="stable")
    backwards = backwards[by_left]
    left_lcp = np.zeros(n, np.int64)
    if n > 1:
        differ = backwards[1:] != backwards[:-1]
        left_lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), before)
    same_left = np.empty(n, np.int64)
    for d in range(before + 1):
        same_left[by_left] = np.cumsum(left_lcp < d)  # equal in the d bytes before
        block = np.cumsum(order_lcp < match - d)  # equal in the first match - d bytes
        ok = np.flatnonzero((right >= match - d) & (left >= d))
        if not len(ok):
            continue
        key = same_left[ok] * (n + 1) + block[ok]
        order = np.argsort(key, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = key[order[1:]] != key[order[:-1]]
        least = np.minimum.reduceat(smallest[ok][order], np.flatnonzero(first))
        out[ok[order], d] = least[np.cumsum(first) - 1]
    return out


def string_hashes(data: np.ndarray, at: np.ndarray, match: int, chunk: int = 1 << 19) -> np.ndarray:
    """64-bit hashes of the strings of `match` bytes at sorted places."""
    out = [np.zeros(0, np.uint64)]
    for s in range(0, len(data), chunk):
        some = at[np.searchsorted(at, s) : np.searchsorted(at, s + chunk)] - s
        if len(some):
            out.append(mix(window_hash(data[s : s + chunk + match].astype(np.uint64) + np.uint64(1), match, SEED_BASE))[some])
    return np.concatenate(out)


def starts_of(at: np.ndarray, doc: np.ndarray, ends: np.ndarray, match: int, before: int) -> np.ndarray:
    """Sorted places of all strings of `match` bytes inside one document that hold one of the anchors."""
    first, last = np.maximum(at - before, ends[doc]), np.minimum(at, ends[doc + 1] - match)
    n = np.maximum(last - first + 1, 0)
    return np.unique(np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()))


def by_planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(payload: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(payload, np.uint8).reshape(size, -1).T).view(kind).ravel()


def suffix_dedup(docs: DataFrame, match: int = 50, seed: int = 20, batch_mb: float = 6, bucket_anchors: int = 500_000, fan_in: int = 1024, keep_text: bool = False, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a string of `match` bytes that also starts in a document with a smaller id.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte intervals) and, with
    keep_text, text (characters that a span cuts through go as a whole). Null text: no bytes.
    Rows with one id are one document: nothing is removed on account of each other. A null id
    counts as 2**63 - 1, larger than every other. fan_in: from how many batches one merge takes a
    seed or string; more go through two levels. An empty table gives an empty result; other columns come
    along if carry names them.
    """
    ship(docs.sparkSession)
    deal, n_bytes = dealt(docs, batch_mb, id_col, text_col, carry)
    expected = max(1, n_bytes * 2 // (match - seed + 2))
    buckets = max(1, expected // bucket_anchors + 1)
    drop = np.uint64(max(0, 64 - (math.ceil(math.log2(expected + 1)) + 12)))
    before, width = match - seed, 2 * match - seed + 2

    def seeds(batch: Batch):
        """Anchors, their hashes, and the batch's distinct narrow hashes with whether several documents have them."""
        at, hashes = anchors(batch.data, batch.ends, match, seed)
        narrow = hashes >> drop << drop
        order = np.argsort(narrow, kind="stable")
        values = narrow[order]
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        first = np.flatnonzero(new)
        ids = batch.ids[batch.doc_of(at)][order]
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(first) else np.zeros(0, bool)
        return at, hashes, order, new, values[first], several

    def send(table):
        import pyarrow as pa

        number = table.column("batch")[0].as_py()
        *_, values, several = seeds(Batch(table))
        cuts = parts_of(values, buckets)
        full = [k for k in range(buckets) if cuts[k + 1] > cuts[k]]
        return pa.table({
            "bucket": pa.array(full, pa.int32()), "batch": pa.array([number] * len(full), pa.int32()),
            "hashes": pa.array([planes(values[cuts[k] : cuts[k + 1]] >> drop) for k in full], pa.binary()),
            "several": pa.array([pack_bits(several[cuts[k] : cuts[k + 1]]) for k in full], pa.binary()),
        })

    def count(table):
        import pyarrow as pa

        blocks = [unplanes(x.as_py()) for x in table.column("hashes")]
        every = np.sort(np.concatenate(blocks))
        new = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        n = np.diff(np.append(new, len(every)))
        twice, hot = every[new[n > 1]], every[new[n > fan_in]]
        replies, hots = [], []
        for block, several in zip(blocks, table.column("several")):
            flags = unpack_bits(several.as_py(), len(block))
            for values, mark in ((twice, flags), (hot, is_hot := np.zeros(len(block), bool))):
                if len(values):
                    k = np.searchsorted(values, block)
                    mark |= values[np.minimum(k, len(values) - 1)] == block
            replies.append(pack_bits(flags))
            hots.append(pack_bits(is_hot) if is_hot.any() else b"")
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "n": pa.array([len(b) for b in blocks], pa.int32()), "flags": pa.array(replies, pa.binary()), "hot": pa.array(hots, pa.binary())})

    def add_run(cols: dict, small, bucket: int, part: int, rows: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        """A sorted, front-coded run of the different rows, with the documents and places of each."""
        by = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
        rows = rows[by]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        shared, rests = front_coded(rows[fresh])
        for c, v in (("bucket", bucket), ("part", part), ("shared", shared.tobytes()), ("rests", small.compress(rests)), ("members", np.diff(np.append(np.flatnonzero(fresh), len(rows))).astype(np.int32).tobytes()), ("docs", by_planes(ids[by])), ("places", by_planes(places[by].astype(np.uint32)))):
            cols[c].append(v)

    def hot_strings(batch: Batch, at: np.ndarray, number: int, cols: dict, small) -> None:
        """Runs of the strings round hot anchors, one for each range of string hashes."""
        where = starts_of(at, batch.doc_of(at), batch.ends, match, before)
        hashes = string_hashes(batch.data, where, match)
        order = np.argsort(hashes, kind="stable")
        where = where[order]
        cuts, doc = parts_of(hashes[order], buckets), batch.doc_of(where)
        windows = np.lib.stride_tricks.sliding_window_view(batch.data, match) if len(where) else None
        for k in range(buckets):
            i, j = cuts[k], cuts[k + 1]
            if j > i:
                add_run(cols, small, -1 - k, number // fan_in, windows[where[i:j]], batch.ids[doc[i:j]], where[i:j])

    def runs(texts, replies):
        """One sorted, front-coded run for each range of seed hashes; members: documents and places of each entry."""
        import pyarrow as pa
        import zstandard

        small = zstandard.ZstdCompressor(level=3)
        number = texts.column("batch")[0].as_py()
        batch = Batch(texts)
        at, hashes, order, new, values, _ = seeds(batch)
        told = sorted(zip(*(replies.column(c).to_pylist() for c in ("bucket", "n", "flags", "hot"))))
        flags = np.concatenate([unpack_bits(f, n) for _, n, f, _ in told] or [np.zeros(0, bool)])
        hot = np.concatenate([unpack_bits(h, n) if h else np.zeros(n, bool) for _, n, _, h in told] or [np.zeros(0, bool)])
        if len(flags) != len(values):
            raise ValueError(f"a batch has {len(values)} hashes and {len(flags)} replies")
        of = np.cumsum(new) - 1
        hot_at = np.sort(at[order[hot[of]]]) if hot.any() else at[:0]
        keep = order[(flags & ~hot)[of]] if len(new) else order
        at, narrow = at[keep], hashes[keep] >> drop << drop
        cols = {c: [] for c in ("bucket", "part", "shared", "rests", "members", "docs", "places")}
        doc = batch.doc_of(at)
        every = contexts(batch.data, batch.ends, at, doc, match, seed)
        cuts = parts_of(narrow, buckets)  # keep is in the order of narrow hashes
        for k in range(buckets):
            i, j = cuts[k], cuts[k + 1]
            if i == j:
                continue
            add_run(cols, small, k, 0, every[i:j], batch.ids[doc[i:j]], at[i:j])
        if len(hot_at):
            hot_strings(batch, hot_at, number, cols, small)
        n = len(cols["bucket"])
        return pa.table({c: pa.array(cols.pop(c), pa.int32()) for c in ("bucket", "part")} | {"batch": pa.array([number] * n, pa.int32())} | {c: pa.array(v, pa.binary()) for c, v in cols.items()})

    def tree(shared: list[bytes], rests: list[bytes], width: int, least: list[np.ndarray]):
        """Runs merged: for every run the number of each entry among the different ones, those, their shared prefixes, and the smallest document of each."""
        import zstandard

        whole = zstandard.ZstdDecompressor()
        streams = [Run(s, whole.decompress(r), width) for s, r in zip(shared, rests)]
        base = np.concatenate([[0], np.cumsum([s.n for s in streams])])
        entry, lcp, heads = array("q"), array("q"), bytearray()
        for k, place, common in merged(streams, width):
            entry.append(base[k] + place)
            lcp.append(common)
            if common < width:
                heads += streams[k].head
        entry, lcp = np.frombuffer(entry, np.int64), np.frombuffer(lcp, np.int64)
        new = lcp < width
        of = np.empty(len(entry), np.int64)
        of[entry] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        smallest = np.minimum.reduceat(np.concatenate(least)[entry], at)
        return np.split(of, base[1:-1]), np.frombuffer(heads, np.uint8).reshape(-1, width), lcp[at], smallest

    def joined(start: np.ndarray, stop: np.ndarray) -> tuple[bytes, bytes]:
        """Ranges that touch or overlap become one before they travel."""
        by = np.argsort(start, kind="stable")
        start, stop = start[by], np.maximum.accumulate(stop[by])
        first = np.append(True, start[1:] > stop[:-1])
        start, stop = start[first], stop[np.append(np.flatnonzero(first)[1:] - 1, len(stop) - 1)]
        return start.astype(np.uint32).tobytes(), stop.astype(np.uint32).tobytes()

    def rows_out(rows: list[tuple]):
        """(key, kind, batch, x, y, z, w); kinds: ranges of a batch, a run of strings, what a group of batches remembers, a reply to it."""
        import pyarrow as pa

        types = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.table({c: pa.array([r[k] if k < len(r) else None for r in rows], t) for k, (c, t) in enumerate(zip(("key", "kind", "batch", "x", "y", "z", "w"), types))})

    def merge(table):
        import zstandard

        t = {c: table.column(c).to_pylist() for c in table.column_names}
        bucket, part = t["bucket"][0], t["part"][0]
        members = [np.frombuffer(m, np.int32) for m in t["members"]]
        ids, places = [from_planes(d, np.int64) for d in t["docs"]], [from_planes(p, np.uint32).astype(np.int64) for p in t["places"]]
        least = [np.minimum.reduceat(d, np.cumsum(m) - m) for d, m in zip(ids, members)]
        of, rows, lcp, smallest = tree(t["shared"], t["rests"], width if bucket >= 0 else match, least)
        out = []
        if bucket >= 0:
            by_distance = ranges_to_remove(lcp, rows, smallest, match, seed)
            for k, m in enumerate(members):
                gone = by_distance[np.repeat(of[k], m)] < ids[k][:, None]
                some = gone.any(axis=1)
                gone, place = gone[some], places[k][some]
                if len(place):
                    out.append((t["batch"][k], RANGES, t["batch"][k], *joined(place - (before - gone[:, ::-1].argmax(axis=1)), place - gone.argmax(axis=1) + match)))
            return rows_out(out)
        group = -1 - buckets + bucket - buckets * part  # a key of its own for each range and group of batches
        lcp = lcp.copy()
        lcp[:1] = 0
        rests = rows[np.arange(match) >= lcp[:, None]].tobytes()
        out.append((bucket, STRINGS, part, lcp.astype(np.uint8).tobytes(), zstandard.ZstdCompressor(level=3).compress(rests), by_planes(smallest)))
        out += [(group, MEMO, t["batch"][k], of[k].astype(np.int32).tobytes(), t["members"][k], t["docs"][k], t["places"][k]) for k in range(len(members))]
        return rows_out(out)

    def level(table):
        """Runs of strings of one range merged, and the smallest documents told to every group of batches. Else rows go on."""
        if table.column("kind")[0].as_py() != STRINGS:
            return table
        t = {c: table.column(c).to_pylist() for c in ("key", "batch", "x", "y", "z")}
        of, _, _, smallest = tree(t["x"], t["y"], match, [from_planes(z, np.int64) for z in t["z"]])
        return rows_out([(-1 - buckets + t["key"][k] - buckets * t["batch"][k], REPLY, t["batch"][k], by_planes(smallest[of[k]])) for k in range(len(of))])

    def replied(table):
        """Ranges of the strings that a smaller document has. Else rows go on."""
        t = {c: table.column(c).to_pylist() for c in table.column_names}
        if RANGES in t["kind"]:
            return table
        least = from_planes(t["x"][t["kind"].index(REPLY)], np.int64)
        out = []
        for kind, number, x, y, z, w in zip(*(t[c] for c in ("kind", "batch", "x", "y", "z", "w"))):
            if kind == MEMO:
                place = from_planes(w, np.uint32).astype(np.int64)[np.repeat(least[np.frombuffer(x, np.int32)], np.frombuffer(y, np.int32)) < from_planes(z, np.int64)]
                if len(place):
                    out.append((number, RANGES, number, *joined(place, place + match)))
        return rows_out(out)

    def cut(texts, removals):
        import pyarrow as pa

        batch = Batch(texts)
        starts, stops = (np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x.as_py(), np.uint32) for x in removals.column(c))]).astype(np.int64) for c in ("x", "y"))
        gone = covered(len(batch.data), starts, stops)
        removed = [int(gone[i:j].sum()) for i, j in zip(batch.ends[:-1], batch.ends[1:])]
        spans, hashes, text = [], [], []
        for k in range(len(batch)):
            i, j = batch.ends[k], batch.ends[k + 1]
            if not removed[k]:
                kept = batch.data[i:j].tobytes()
                spans.append([])
            else:
                flags = gone[i:j]
                kept = batch.data[i:j][~flags].tobytes()
                edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
                spans.append([{"from": int(a), "to": int(b)} for a, b in edges.reshape(-1, 2)])
            hashes.append(sha256(kept))
            if keep_text:
                text.append(kept.decode("utf-8", "ignore"))
        cols = {
            "doc_id": batch.id_array(), "n_bytes": pa.array(np.diff(batch.ends), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array([len(s) for s in spans], pa.int64()), "kept_sha256": pa.array(hashes, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
        }
        if keep_text:
            cols["text"] = pa.array(text, pa.string())
        return pa.table(cols | batch.carried())

    sent = deal.groupBy("batch").applyInArrow(send, "bucket int, batch int, hashes binary, several binary")
    told = sent.groupBy("bucket").applyInArrow(count, "batch int, bucket int, n int, flags binary, hot binary")
    sorted_ = deal.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(runs, "bucket int, part int, batch int, shared binary, rests binary, members binary, docs binary, places binary")
    rows = "key long, kind int, batch int, x binary, y binary, z binary, w binary"
    met = sorted_.groupBy("bucket", "part").applyInArrow(merge, rows)
    removals = met.groupBy("key").applyInArrow(level, rows).groupBy("key").applyInArrow(replied, rows)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<from:int,to:int>>" + (", text string" if keep_text else "")
    schema += "".join(f", c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    out = deal.groupBy("batch").cogroup(removals.groupBy("batch")).applyInArrow(cut, schema)
    return out.withColumnsRenamed({f"c{k}": c for k, c in enumerate(carry)})


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
