import zlib

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import tokens
from tests_llm_helpers import remove_seen, similar_groups


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    import random

    r = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "gé", "lo", "mi") for b in ("n", "st", "r", "la", "ti", "mo")]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    item, passage, base = prose(40), prose(25), prose(900)
    near = base.split()
    near[400] = "changed"
    rows = [(i, prose(80)) for i in range(60)] + [(100 + i, prose(60).upper().replace(" ", "!! ")) for i in range(40)]
    rows += [(200, base), (201, base), (202, " ".join(near)), (210, f"{prose(20)} {passage} {prose(20)}"), (211, f"{prose(20)} {passage} {prose(20)}"), (220, f"{prose(30)} {item} {prose(30)}"), (230, prose(3000))]
    at = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, batch string")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(30))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, passage


def test_stages_and_run(spark, tables):
    at, rows, passage = tables
    seen, docs = {}, spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.stored(out, name)
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    text = {i: t for i, t in rows if not 100 <= i < 200}
    assert seen["quality_classifier"] == text
    ids = sorted(text)
    text = {i: text[i] for i, g in zip(ids, similar_groups([text[i] for i in ids])) if i == ids[g]}  # five words and 0.8, as the stage is asked for
    assert seen["simhash_near_dedup"] == text and 201 not in text and 202 not in text
    text = remove_seen(text, 50)
    assert seen["suffix_array_dedup"] == text and passage not in text[211] and passage in text[210]
    text.pop(220)
    assert seen["benchmark_decontamination"] == text
    encode = lambda text: tokens.reference_bpe().encode(text, add_special_tokens=False).ids
    want = set()
    for i, t in text.items():
        e = np.array([*encode(t), 2], "<u4")
        cuts = [0, len(e)] if len(e) <= 1024 else [0, *range(len(e) % 1024 or 1024, len(e) + 1, 1024)]
        want |= {(i, k, a, b - a, zlib.crc32(e[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    got = corpus_pipeline.run(spark, at).collect()
    assert {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got} == want and len(got) == len(want)


def test_odd_rows_pass_through(spark, tables, tmp_path):
    at, _, _ = tables
    odd = [(1, None), (2, ""), (3, " \n"), (None, "no id, but some ordinary words"), (None, None), (5, "x"), (5, "x")]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", None, None, None, "d", "e", "f") for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long, batch string, `a.b` string, text_hash string, _tessera_text string").write.parquet(f"{d}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{at}/{t}.parquet").where("false").write.parquet(f"{d}/{t}.parquet")
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == [(False, 0), (False, 0), (True, 1), (True, 5)]
    spark.read.parquet(f"{d}/documents.parquet").where("false").write.parquet(f"{d}/e/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").write.parquet(f"{d}/e/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{d}/e").collect() == []


def test_rows_with_one_id_and_other_texts_stay(spark, tables):
    """Of rows that are alike in id and text one stays, the same however they lie."""
    at, _, _ = tables
    rows = [(1, "one text of its own with some words", "a"), (1, "quite another text about other things", "b"), (2, "twice the same words in this text here", "y"), (2, "twice the same words in this text here", "x"), (None, "z", "n")]
    found = []
    for parts in (1, 3):
        docs = spark.createDataFrame(rows[::-1] if parts == 3 else rows, "doc_id long, text string, source string").repartition(parts)
        found.append(sorted(map(str, corpus_pipeline.near_duplicates(spark, docs, at).collect())))
    assert found[0] == found[1] and len(found[0]) == 4
