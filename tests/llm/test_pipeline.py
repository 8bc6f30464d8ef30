"""The pipeline over a small corpus whose kept documents are known."""

import numpy as np
import xxhash

import corpus_pipeline
from ledgerline.llm import simhash


def test_stages_keep_what_they_should(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 120)) for _ in range(6)]
    item = " ".join(texts[5].split()[20:35])
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    rows += [(10, texts[0], "en", "s0", 0), (11, texts[1] + " end", "en", "s1", 0), (12, "too short", "en", "s0", 0), (13, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = [{*range(6), 10, 11}, {*range(6)}, {*range(5)}, None, None]
    for (_, stage), ids in zip(corpus_pipeline.STAGES[:3], want, strict=False):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(r.doc_id for r in docs.collect()) == sorted(ids)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {*range(5)} and sum(r.n_tokens for r in out) > 0
    starts = sorted((r.start, r.n_tokens) for r in out)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_stages_take_odd_rows(spark, tmp_path):
    kinds = "`a.b` string, id long, doc_id long, text string, lang string, source string, n_chars long, size long, node long, key string, t string"
    words = " ".join(f"word{i}" for i in range(30))
    long = " ".join(f"x{i * 7919 % 100_003}" for i in range(60_000))
    odd = [("c", 1, 1, words, "en", "s", 0, 7, 9, "k", "t"), ("c", 1, 1, words, "en", "s", 0, 7, 9, "k", "t"), ("d", 2, None, words + " more", None, None, 0, 7, 9, "k", "t"), ("e", 3, 5, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None), ("f", 4, 6, "", "en", "s", 0, 0, 0, "", ""), ("g", 5, 7, long, "en", "s", 0, 0, 0, "", "")]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0, 3), (None, 0, 1, 3), (5, None, None, 3)], "doc_id long, quality int, toxic int, id long").write.parquet(f"{tmp_path}/labels.parquet")
    for rows, kept in ((odd, [4, 2, 2]), ([], [0, 0, 0])):
        docs = spark.createDataFrame(rows, kinds)
        for (_, stage), n in zip(corpus_pipeline.STAGES[:3], kept, strict=False):
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns[:3] == ["a.b", "id", "doc_id"] and docs.count() == n
        docs = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
        assert docs.columns[0] == "a.b" and {r.text for r in docs.collect()} <= {words, long}
        assert corpus_pipeline.token_records(spark, spark.createDataFrame(rows, kinds), str(tmp_path)).count() == len(rows)


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups_of(spark, texts):
    """The sets of positions that ``similar_groups`` puts together."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {}
    for r in simhash.similar_groups(df).collect():
        out.setdefault(r.root, set()).add(r.d)
    return {frozenset(x) for x in out.values()}


def test_near_dedup_joins_block_edits(spark):
    rng = np.random.default_rng(5)
    line = " ".join(f"common{i}" for i in range(20))
    texts = []
    for i in range(45):
        words = [f"a{i}x{j}" for j in rng.integers(0, 300, 200)]
        block = [f"b{i}x{j}" for j in range(int(rng.integers(15, 40)))]
        at = int(rng.integers(20, 180))
        other = [words + block, words[: 200 - len(block)], words[:at] + block + words[at:]][i % 3]
        texts += [" ".join(words) + "\n" + line, " ".join(other) + "\n" + line]
    got = groups_of(spark, texts)
    for k in range(0, len(texts), 2):
        x, y = grams(texts[k]), grams(texts[k + 1])
        if len(x & y) >= 0.8 * len(x | y):
            assert frozenset((k, k + 1)) in got
    assert len(got) >= len(texts) // 2


def test_near_dedup_counts_the_similarity(spark):
    rng = np.random.default_rng(6)
    texts = []
    for i in range(60):
        words = [f"a{i}x{j}" for j in range(150)]
        other = list(words)
        for at in rng.choice(150, 1 + i % 6, replace=False):
            other[at] = "changed"
        texts += [" ".join(words), " ".join(other)]
    sets = [grams(t) for t in texts]
    want = set()
    for k in range(0, len(texts), 2):
        x, y = sets[k], sets[k + 1]
        want |= {frozenset((k, k + 1))} if len(x & y) >= 0.8 * len(x | y) else {frozenset((k,)), frozenset((k + 1,))}
    assert any(len(x) == 1 for x in want) and groups_of(spark, texts) == want


def simhashes(text, tables=16):
    """The plain form: per table, the majority of the bits of all two-word shingles' hashes."""
    w = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 2]), 42) for i in range(max(1, len(w) - 1))] if w else []
    out = []
    for _ in range(tables):
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
        h = [(x ^ x >> 29) * 0x9E3779B97F4A7C15 % (1 << 64) for x in h]
        h = [x ^ x >> 32 for x in h]
    return out


def test_near_dedup_stage_goes_by_simhash(spark, tmp_path):
    rng = np.random.default_rng(8)
    texts = []
    for i in range(40):
        words = [f"a{i}x{j}" for j in range(150)]
        other = list(words)
        for at in rng.choice(150, 2 + i % 8, replace=False):
            other[at] = "changed"
        texts += [" ".join(words), " ".join(other)]
    prints = [simhashes(t) for t in texts]
    root = list(range(len(texts)))
    linked = set()
    for i in range(len(texts)):
        for j in range(i):
            if any((a ^ b).bit_count() <= 3 for a, b in zip(prints[i], prints[j], strict=True)):
                linked.add((j, i))
                root = [root[j] if r == root[i] else r for r in root]
    alike = {(i, j): len(grams(texts[i]) & grams(texts[j])) / len(grams(texts[i]) | grams(texts[j])) for i, j in [(k, k + 1) for k in range(0, len(texts), 2)]}
    assert linked <= set(alike) and any(alike[p] < 0.8 for p in linked)
    near = {p for p in alike if alike[p] >= 0.8}
    assert len(near & linked) >= 0.9 * len(near)
    want = {root.index(r) for r in root}
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[0] + " twice"), (90, None), (91, " "), (92, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == sorted([*want, 90])
