import pytest

from tessera.llm import common, fertility, language_id, token_counts, tokens


def test_every_limit(docs, words, odd):
    rows = odd + [(100 + i, words(i * 7 % 300, i)) for i in range(80)]
    n = [len(tokens.byte_bpe().encode_ordinary(t or "")) for _, t in rows]
    got = token_counts.token_counts(docs(rows)).collect()
    assert sorted(r["context"] for r in got) == sorted(set(n))
    for r in got:
        c = r["context"]
        assert r["n_docs"] == n.count(c) and r["n_tokens"] == c * n.count(c)
        assert r["docs_over"] == sum(x > c for x in n) and r["tokens_over"] == sum(x for x in n if x > c)
        assert r["truncated_total"] == sum(min(x, c) for x in n) and r["lost_tokens"] == sum(max(0, x - c) for x in n)
        assert r["docs_within"] == sum(x <= c for x in n) and abs(r["quantile"] - r["docs_within"] / len(n)) < 1e-12
        assert (r["total_docs"], r["total_tokens"]) == (len(n), sum(n))


def test_buckets_do_not_matter(spark):
    h = spark.createDataFrame([(k, 1 + k % 3) for k in range(0, 5000, 7)], "length long, n_docs long")
    a, b = (sorted(map(tuple, token_counts.limits(h, bucket).collect())) for bucket in (16, 10_000))
    assert a == b


def test_empty_table(docs):
    assert token_counts.token_counts(docs([]).where("false")).collect() == []


def test_any_limit(spark, docs, words):
    rows = [(i, words(3 + i * 13 % 200, i)) for i in range(60)]
    n = [len(tokens.byte_bpe().encode_ordinary(t)) for _, t in rows]
    asked = [None, -3, 0, 1, min(n) - 1, min(n), 50, 77, 77, 128, max(n), 10**6]
    table = token_counts.token_counts(docs(rows))
    limits = spark.createDataFrame([(x,) for x in asked], "context long")
    got = {r["context"]: r for r in token_counts.at_limits(table, limits).collect()}
    assert set(got) == {x for x in asked if x is not None}
    for c, r in got.items():
        kept = sum(min(x, max(c, 0)) for x in n)
        assert (r["docs_over"], r["docs_within"], r["truncated_total"], r["lost_tokens"]) == (sum(x > c for x in n), sum(x <= c for x in n), kept, sum(n) - kept)
    assert token_counts.at_limits(token_counts.token_counts(docs([]).where("false")), limits).collect() == []


def test_files_do_not_follow_shuffle_partitions(spark, docs, words, monkeypatch):
    """Both tables are small, so neither has a file for each of many shuffle partitions."""
    kept, most = [], spark.sparkContext.defaultParallelism
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    monkeypatch.setattr(token_counts, "stored", lambda df, name: kept.append(common.stored(df, name)) or kept[-1])
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 8 * most)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        table = token_counts.token_counts(docs([(i, words(1 + i * 5, i)) for i in range(20 * most)]))
        files, parts, got = len(kept[0].inputFiles()), table.rdd.getNumPartitions(), table.count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got > 4 * most and 0 < files <= most and parts <= most


@pytest.mark.parametrize("of", ["op3", "op6"])
def test_other_counts_go_to_few_files(spark, docs, words, monkeypatch, of):
    kept, most = {}, spark.sparkContext.defaultParallelism
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    monkeypatch.setattr(language_id if of == "op3" else fertility, "stored", lambda df, name: kept.setdefault(name, common.stored(df, name)))
    rows = [(i, words(1 + i * 5, i), f"l{i % 7}") for i in range(20 * most)]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 8 * most)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        language_id.train(docs(rows)) if of == "op3" else fertility.judged(docs(rows))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name in ("grams",) if of == "op3" else ("bins", "bands"):
        assert 0 < len(kept[name].inputFiles()) <= most
