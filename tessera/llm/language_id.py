"""Language identification by prediction by partial matching.

Per language, a byte context tree of orders 0 to 3 with escape probabilities (method C, with
exclusion) is counted on a bounded sample of labelled texts and frozen, whole. A text's exact code
length under each tree is the sum over its bytes of minus log2 of the frozen probability; the
language with the shortest code wins.

A tree is kept as it was counted: a cost for each (context, byte) that was seen, and for each
context the cost of escaping from it, exclusion included, which does not depend on the byte. So the
cost of a byte is that of the longest context that has seen it plus the escapes of the longer ones.
Memory grows with the sample (a parameter) times the number of languages, by about 16 bytes for each
different four bytes of a language's sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_files, flat, held_out, ship, slices, stored

#: ASCII letters in lower case stay, other ASCII counts as a space, bytes of other characters stay.
LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[128:] = np.arange(128, 256)
LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)

ORDER = 3
STATISTIC_BYTES = 24  # what one counted statistic takes at least while the model is made
BLOCK = 1 << 20  # bytes whose costs are looked up at once


def symbols(texts):
    """Bytes of all texts, lower-cased and folded; where each begins; for each byte the three before it in its text, as a number."""
    import pyarrow as pa
    import pyarrow.compute as pc

    data, ends = flat(pc.utf8_lower(texts.cast(pa.large_string())))
    data = LETTERS[data]
    n, key = len(data), np.zeros(len(data), np.int32)
    for back in range(ORDER, 0, -1):
        before = np.full(n, 0x20, np.uint8)
        before[back:] = data[:-back] if back < n else data[:0]
        for k in range(back):
            at = ends[:-1] + k
            before[at[at < n]] = 0x20
        key = (key << 8) | before
    return data, ends, key


class Tree:
    """One language's frozen statistics, order by order: sorted (context, byte) numbers with costs in bits, sorted contexts with escape costs."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        """From the different numbers of (three bytes, byte) and how often each occurs."""
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []
        self.escape: list[tuple[np.ndarray, np.ndarray]] = []
        for order in range(ORDER + 1):
            mask = (1 << (8 * order)) - 1
            pairs, back = np.unique(((gram >> 8) & mask) << 8 | (gram & 255), return_inverse=True)
            times = np.bincount(back, n, len(pairs))
            context, first, size = np.unique(pairs >> 8, return_index=True, return_counts=True)
            if not len(pairs):
                self.seen.append((pairs, times))
                self.escape.append((context, np.zeros(0)))
                continue
            whole = np.add.reduceat(times, first) + size  # method C: as many escapes as different bytes
            lower = np.exp2(-self.costs(pairs, order - 1))  # what the shorter contexts give to the bytes seen here
            rest = np.maximum(1 - np.add.reduceat(lower, first), 1e-12)
            self.seen.append((pairs, np.log2(np.repeat(whole, size)) - np.log2(times)))
            self.escape.append((context, np.log2(whole) - np.log2(size) + np.log2(rest)))

    def costs(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of each number of (context, byte) by the contexts of up to `order` bytes."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))
        for k in range(order, -1, -1):
            own = grams[left] & ((1 << (8 * (k + 1))) - 1)
            (pairs, bits), (context, escape) = self.seen[k], self.escape[k]
            if len(pairs):
                at = np.minimum(np.searchsorted(pairs, own), len(pairs) - 1)
                hit = pairs[at] == own
                out[left[hit]] += bits[at[hit]]
                left, own = left[~hit], own[~hit]
                at = np.minimum(np.searchsorted(context, own >> 8), len(context) - 1)
                there = context[at] == own >> 8
                out[left[there]] += escape[at[there]]
            if not len(left):
                return out
        out[left] += 8  # below order 0 all bytes are alike
        return out

    def bytes_held(self) -> int:
        return sum(a.nbytes for table in (*self.seen, *self.escape) for a in table)


@dataclass
class Model:
    """Frozen statistics of all languages."""

    languages: list[str]
    trees: list[Tree]

    def code_lengths(self, texts) -> np.ndarray:
        """Bits of each text under each language, (texts, languages): block by block, each different number of four bytes looked up once."""
        data, ends, key = symbols(texts)
        out = np.zeros((len(ends) - 1, len(self.languages)))
        for s in range(0, len(data), BLOCK):
            z = min(s + BLOCK, len(data))
            grams, back = np.unique(key[s:z].astype(np.uint32) << np.uint32(8) | data[s:z], return_inverse=True)
            first, last = np.searchsorted(ends, s, "right") - 1, np.searchsorted(ends, z, "left")
            bounds = np.clip(ends[first : last + 1], s, z) - s
            full = np.flatnonzero(np.diff(bounds) > 0)
            for k, tree in enumerate(self.trees):
                out[first + full, k] += np.add.reduceat(tree.costs(grams.astype(np.int64))[back], bounds[:-1][full])
        return out


def freeze(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """counts: per language the numbers of (three bytes, byte) and how often each occurs."""
    languages = sorted(counts)
    return Model(languages, [Tree(*counts[k]) for k in languages])


def train(docs: DataFrame, mb_per_language: float = 4, max_model_mb: float = 512, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn from whole texts with a language that are not held out.

    The sample's bound is a parameter: about mb_per_language of text a language, picked by a hash,
    and the text with the smallest hash whatever its length, so that every language has one. All
    statistics of the sample are kept. The model goes to every task: over max_model_mb ValueError is
    raised (sample less, or give executors more memory and raise it).
    """
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null").where(~held_out("doc_id"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = {r["lang"]: max(int(min(1.0, mb_per_language * 1e6 / max(1, r["n"])) * (1 << 30)), r["least"] + 1) for r in d.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n"), F.min(place).alias("least")).collect()}
    if not share:
        return None
    pick = place < F.create_map(*(F.lit(x) for k, v in share.items() for x in (k, v)))[F.col("lang")]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for b in slices(batch, 0):
                for lang in pc.unique(b.column(1)).to_pylist():
                    data, _, key = symbols(b.column(0).filter(pc.equal(b.column(1), lang)))
                    gram, n = np.unique(key.astype(np.int64) << 8 | data, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counted = d.where(pick).select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = stored(few_files(counted), "grams")
    rows = counted.count()
    if rows * STATISTIC_BYTES > max_model_mb * 1e6:  # before anything comes to the driver
        raise ValueError(f"{rows} statistics of {len(share)} languages take over max_model_mb")
    places = {k: i for i, k in enumerate(sorted(share))}
    numbered = counted.select(F.create_map(*(F.lit(x) for k, i in places.items() for x in (k, i)))[F.col("lang")].alias("lang"), "gram", "n")
    got = numbered.toArrow()
    lang, gram, n = (got.column(c).to_numpy() for c in ("lang", "gram", "n"))
    order = np.lexsort((gram, lang))
    lang, gram, n = lang[order], gram[order], n[order]
    ends = np.searchsorted(lang, np.arange(len(places) + 1))
    model = freeze({k: (gram[ends[places[k]] : ends[places[k] + 1]], n[ends[places[k]] : ends[places[k] + 1]]) for k in share})
    held = sum(t.bytes_held() for t in model.trees)
    if held > max_model_mb * 1e6:
        raise ValueError(f"the model of {len(share)} languages takes {held / 1e6:.0f} MB, over max_model_mb")
    return model


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte) for every row.

    lang_pred is `und`, with score 0, for a null text, one without letters, or where nothing could
    be learned; ties go to the first name. score is the winner's share of the likelihoods. Other
    columns are not carried.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        m = sent.value
        for batch in batches:
            for b in slices(batch, 2):
                text = b.column(2)
                known = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if m is None:
                    known[:] = False
                    bits = np.zeros((b.num_rows, 1))
                else:
                    bits = m.code_lengths(text)
                best = bits.argmin(axis=1)
                score = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
                size = np.maximum(pc.fill_null(pc.binary_length(text), 0).to_numpy(), 1)
                names = [m.languages[k] if ok else "und" for k, ok in zip(best, known)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, bits.min(axis=1) / size, 0.0))], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits_per_byte double")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
