"""Quality rules by tokeniser fertility.

Public vocabularies are read, never trained: a piece vocabulary with byte fallback and a
byte-level one. Both encode every whole text as it is. Per text: characters of words per token of both, the share of byte-fallback tokens and the
entropy of the tokens (over its greatest possible value at that many tokens). Bands of the usual
are taken per language (per script where no language is given) over all documents; a text outside
a band on the bad side is rejected.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .batches import covered
from .common import SPACE, few_files, flat, mix, salted_left_join, ship, slices, stored, window_hash, word_hashes, words_of

SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

#: First code points of blocks whose letters belong to one script, and its name.
SCRIPTS = ((0x0, "Latn"), (0x370, "Grek"), (0x400, "Cyrl"), (0x530, "Zyyy"), (0x590, "Hebr"), (0x600, "Arab"), (0x700, "Zyyy"), (0x900, "Deva"), (0x980, "Zyyy"), (0xE00, "Thai"), (0xE80, "Zyyy"), (0x1E00, "Latn"), (0x1F00, "Grek"), (0x2000, "Zyyy"), (0x3040, "Kana"), (0x3100, "Zyyy"), (0x3400, "Hani"), (0xA000, "Zyyy"), (0xAC00, "Hang"), (0xD7A4, "Zyyy"))

METRICS = ("chars_per_piece", "chars_per_byte_token", "fallback_share", "entropy_share")
BROADCAST_BANDS = 20_000  # rows of bands that are broadcast; more are joined by a shuffle
BROADCAST_BANDS = 20_000  # rows of bands that are broadcast; more are joined by a shuffle
STEP = 1000  # bins a unit in the histograms of metrics


def script(text: str | None, block: int = 1 << 20) -> str:
    """The script of most characters that are not ASCII white space, digits or punctuation."""
    which = np.zeros(len(SCRIPTS), np.int64)
    for at in range(0, len(text or ""), block):
        points = np.frombuffer(text[at : at + block].encode("utf-32-le", "replace"), np.uint32)
        points = points[(points > 127) | ((points >= 65) & (points <= 90)) | ((points >= 97) & (points <= 122))]
        which += np.bincount(np.searchsorted([s for s, _ in SCRIPTS], points, "right") - 1, minlength=len(SCRIPTS))
    if not which.any():
        return "Zyyy"
    totals: dict[str, int] = {}
    for n, (_, name) in zip(which.tolist(), SCRIPTS):
        totals[name] = totals.get(name, 0) + n
    return max(sorted(totals), key=totals.get)


class Vocabularies:
    """Both vocabularies, and which piece ids are fallback bytes."""

    def __init__(self, pieces: str | None = None, ranks: str | None = None):
        self.pieces, self.ranks = tokens.piece_bpe(pieces), tokens.byte_bpe(ranks)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])

    def measure(self, text: str) -> tuple[int, int, int, float]:
        """Pieces, fallback pieces, byte-level tokens and the entropy of the pieces in bits, of one whole text."""
        ids = tokens.piece_ids(self.pieces, text)
        n = np.bincount(ids, minlength=len(self.is_byte))
        share = n[n > 0] / max(len(ids), 1)
        return len(ids), int(n[self.is_byte].sum()), len(tokens.byte_ids(self.ranks, text)), float(-(share * np.log2(share)).sum())


def per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags each text has."""
    out, full = np.zeros(len(ends) - 1, np.int64), np.flatnonzero(np.diff(ends) > 0)
    if len(full):
        out[full] = np.add.reduceat(flags.view(np.uint8), ends[:-1][full], dtype=np.int64)
    return out


def repeated_words(words: np.ndarray, doc: np.ndarray, n: int, window: int = 5) -> np.ndarray:
    """Per text, how many words lie in a window of words that the text has twice or more."""
    stretch = window_hash(words, window, 0x9E3779B97F4A7C15)
    inside = np.flatnonzero(doc[window - 1 :] == doc[: len(stretch)]) if len(stretch) else np.zeros(0, np.int64)
    key = mix(stretch[inside] ^ mix(doc[inside].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    at = inside[twice]
    return np.bincount(doc[covered(len(words), at, at + window)], minlength=n)


def measure(texts, vocabularies: Vocabularies) -> dict[str, np.ndarray]:
    data, ends = flat(texts)
    n = len(ends) - 1
    starts, stops, first = words_of(data, ends)
    sizes = np.diff(first)
    doc = np.repeat(np.arange(n), sizes)
    hashes = word_hashes(data, starts, stops)
    chars = per_text(~SPACE[data] & ((data & 0xC0) != 0x80), ends)
    lines = []
    for k in range(n):
        full = [x for x in data[ends[k] : ends[k + 1]].tobytes().split(b"\n") if x.strip()]
        lines.append(len(full) - len(set(full)))
    told = [vocabularies.measure(t.as_py() or "") for t in texts]
    measured = {c: np.array([t[k] for t in told]) for k, c in enumerate(("n_pieces", "n_fallback", "n_byte_tokens", "entropy"))}
    return {"n_words": sizes, "word_chars": chars, "n_symbols": per_text(SYMBOLS[data], ends), "n_dup_lines": np.array(lines, np.int64), "n_repeat_words": repeated_words(hashes, doc, n)} | measured


def metrics(docs: DataFrame, pieces: str | None = None, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts and token measures of every whole text."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_pieces", "n_fallback", "n_byte_tokens")

    def run(batches):
        import pyarrow as pa

        vocabularies = Vocabularies(pieces, ranks)
        for batch in batches:
            for b in slices(batch, 2, 1024):
                m = measure(b.column(2), vocabularies)
                scripts = [script(x.as_py()) for x in b.column(2)]
                lang = [x if x is not None else y for x, y in zip(b.column(1).to_pylist(), scripts)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(scripts, pa.string()), *(pa.array(m[c].astype(np.int64)) for c in longs), pa.array(m["entropy"])], names=["doc_id", "band", "script", *longs, "entropy"])

    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, band string, script string, {', '.join(f'{c} long' for c in longs)}, entropy double")


def with_shares(m: DataFrame) -> DataFrame:
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return m.withColumns({
        "chars_per_piece": over("word_chars", "n_pieces"), "chars_per_byte_token": over("word_chars", "n_byte_tokens"), "fallback_share": over("n_fallback", "n_pieces"),
        "entropy_share": F.when(F.col("n_pieces") > 1, F.col("entropy") / F.log2(F.col("n_pieces").cast("double"))),
    })


def length_class(min_tokens: int):
    """0 for texts of min_tokens pieces or more, then 1, 2, 3 for those of half, a quarter and less: few tokens make the measures noisy."""
    return F.when(F.col("n_pieces") >= min_tokens, 0).when(F.col("n_pieces") >= min_tokens / 2, 1).when(F.col("n_pieces") >= min_tokens / 4, 2).otherwise(3)


def bands(m: DataFrame, min_tokens: int, spread: float, entropy_spread: float) -> DataFrame:
    """(level, name, class, total, metric lows, highs and margins): quartiles from exact histograms, per language and per script; margins are spread times their distance and 0.02.

    Short texts of fewer than ten words, which the base rules reject, are left out.
    """
    some = m.where((F.col("n_pieces") >= min_tokens) | (F.col("n_words") >= 10))
    long_ = some.select("band", "script", "class", F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.round(F.col(c) * STEP).cast("long").alias("bin")) for c in METRICS))).alias("x")).select("band", "script", "class", "x.*").where("bin is not null")
    fine = stored(few_files(long_.groupBy("band", "script", "class", "metric", "bin").agg(F.count("*").alias("n"))), "bins")
    counts = reduce(DataFrame.union, (fine.groupBy(F.lit(c).alias("level"), F.col(c).alias("name"), "class", "metric", "bin").agg(F.sum("n").alias("n")) for c in ("band", "script")))
    w = Window.partitionBy("level", "name", "class", "metric")
    upto = counts.select("level", "name", "class", "metric", "bin", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(w).alias("total"))
    at = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin"))) / STEP)
    quartiles = upto.groupBy("level", "name", "class", "metric").agg(at(0.25).alias("low"), at(0.75).alias("high"), F.max("total").alias("total"))
    wide = F.when(F.col("metric") == "entropy_share", entropy_spread).otherwise(spread) * (F.col("high") - F.col("low")) + 0.02
    limit = quartiles.withColumn("wide", wide)
    return limit.groupBy("level", "name", "class").agg(F.max("total").alias("total"), *(F.max(F.when(F.col("metric") == c, F.col(side))).alias(f"{side}_{c}") for c in METRICS for side in ("low", "high", "wide")))


def judged(docs: DataFrame, min_tokens: int = 200, spread: float = 2.0, entropy_spread: float = 4.0, min_docs: int = 50, **kw) -> DataFrame:
    """Base counts, token measures, and whether to keep each document.

    kept is false if base_failed, or if a text has too few characters per token in either
    vocabulary, too many byte-fallback tokens, or too low a token entropy for the usual of its
    language and length class. One cannot know the usual from few: the figures of a band of n texts count with
    n / (n + min_docs), those of its script with the rest, and margins are widened by the root of
    1 + min_docs / n, so no band's size switches from one rule to another.
    Null and empty texts have no words and fail the base rules. A null language falls to
    the script. Repeated rows get equal verdicts. An empty table gives an empty result; other
    columns are not carried.
    """
    m = with_shares(stored(metrics(docs, **kw), "fertility")).withColumn("class", length_class(min_tokens))
    b = stored(few_files(bands(m, min_tokens, spread, entropy_spread)), "bands")
    figures = [f"{side}_{c}" for c in METRICS for side in ("low", "high", "wide")]
    own, wider = (b.where(F.col("level") == level).select(F.col("name").alias(level), "class", F.col("total").alias(f"{level}_total"), F.struct(*figures).alias(f"{level}_figures")) for level in ("band", "script"))
    few = b.count() <= BROADCAST_BANDS  # languages are values of the data: there may be as many as rows
    met = lambda left, right, key: left.join(F.broadcast(right), [key, "class"], "left") if few else salted_left_join(left, right, [key, "class"])
    joined = met(met(m, own, "band"), wider, "script")
    joined = joined.withColumns({"weight": F.col("band_total") / (F.col("band_total") + min_docs), "widen": F.sqrt(1 + min_docs / F.col("band_total"))})
    figure = lambda name: F.col("weight") * F.coalesce(f"band_figures.{name}", f"script_figures.{name}") + (1 - F.col("weight")) * F.col(f"script_figures.{name}")
    limit = lambda side, c: figure(f"{side}_{c}") + (-1 if side == "low" else 1) * F.col("widen") * figure(f"wide_{c}")
    low = lambda c: F.col(c) < limit("low", c)
    high = lambda c: F.col(c) > limit("high", c)
    wrong = reduce(lambda x, y: x | y, (F.coalesce(t, F.lit(False)) for t in (low("chars_per_piece"), low("chars_per_byte_token"), high("fallback_share"), low("entropy_share"))))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~wrong).alias("kept"), "band", "n_pieces", "n_byte_tokens", "n_fallback", "entropy", *METRICS)
    return out


def op6_fertility_rules(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *METRICS)
