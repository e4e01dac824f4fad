"""Places where an operator once did less than its whole job."""

import glob
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import exact_dedup, licenses, mixing, ngram_join, packing, quality, substrings, suffixes
from attestry.llm.shared import is_file_scan, shared_dir

PLAIN = "doc_id long, text string, place int"


def prose(rnd, n=60):
    return " ".join(rnd.choice(["the", "house", "walks", "quietly", "home"]) + str(rnd.randint(0, 400)) for _ in range(n))


def test_decisions_are_for_rows_not_ids(spark):
    rnd = random.Random(8)
    good = [" ".join(rnd.choice(["the", "house", "walks", "quietly", "home"]) for _ in range(60)) + "." for _ in range(40)]
    bad = [" ".join(rnd.choice(["buy$$", "now!!", "###", "x|y"]) for _ in range(60)) for _ in range(40)]
    rows = [(k, t, k) for k, t in enumerate(good[:38] + bad[:38])] + [(None, good[38], 100), (None, bad[38], 101), (7, bad[39], 102)]
    labels = spark.createDataFrame([(k, int(k < 38), 0) for k in range(76) if k != 7], "doc_id long, quality int, toxic int")
    kept = {r.place for r in quality.keep_good(spark.createDataFrame(rows, PLAIN), labels).select("place").collect()}
    assert {100, 7} <= kept and not {101, 102} & kept


def test_representatives_are_rows_not_ids(spark):
    rnd = random.Random(5)
    a, b, c = (prose(rnd) for _ in range(3))
    rows = [(1, a, 0), (None, a + " tail", 1), (None, b, 2), (None, b + " tail", 3), (5, c, 4), (5, a + " end", 5), (None, None, 6), (8, "", 7)]
    kept = sorted(r.place for r in ngram_join.keep_representatives(spark.createDataFrame(rows, PLAIN)).collect())
    assert len(kept) == 5 and {0, 4, 6, 7} <= set(kept) and len({2, 3} & set(kept)) == 1


def test_copies_are_for_rows_not_ids(spark):
    rnd = random.Random(6)
    good, bad = (lambda: " ".join(rnd.choice(["the", "house", "walks"]) for _ in range(60))), (lambda: " ".join(rnd.choice(["buy", "now", "win"]) for _ in range(60)))
    rows = [(k, good() if k < 40 else bad(), k) for k in range(80)] + [(None, good(), 80 + k) for k in range(20)] + [(None, bad(), 100 + k) for k in range(20)]
    docs = spark.createDataFrame(rows, PLAIN)
    labels = spark.createDataFrame([(k, int(k < 40), 0) for k in range(80)], "doc_id long, quality int, toxic int")
    got = Counter(r.place for r in mixing.mixed_docs(docs, labels, epochs=1.25).select("place").collect())
    assert sum(got[k] for k in range(100, 120)) <= 8 < 18 <= sum(got[k] for k in range(80, 100))


def mixture(spark, toxic=True):
    rnd = random.Random(2)
    kinds = (["the", "house", "walks"], ["buy", "now", "win"], ["vile", "foul", "hate"])
    shares = (60, 36, 4 * toxic)
    rows = [(i, " ".join(rnd.choice(kinds[k] + ["and", "of"]) for _ in range(rnd.randint(20, 60))), k) for i, k in enumerate(k for k, n in enumerate(shares) for _ in range(n))]
    labels = [(i, int(k == 0), int(k == 2)) for i, _, k in rows]
    return spark.createDataFrame(rows, PLAIN), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_totals_have_the_asked_shares(spark):
    weights = (0.85, 0.12, 0.03)
    rows = mixing.mix(*mixture(spark), weights).collect()
    t, p, r = np.array([x.n_tokens for x in rows], float), np.array([x.p for x in rows]), np.array([x.rate for x in rows])
    assert (t[:, None] * p).sum(0)[0] / t.sum() < weights[0] / 1.25  # where a bound of epochs would cut
    assert np.allclose((r * t) @ p / t.sum(), weights, rtol=1e-3) and (r >= 0).all()


def test_shares_out_of_reach(spark):
    """The nearest rates, by the optimality conditions of their least squares; an error where asked for."""
    docs, labels = mixture(spark, toxic=False)
    with pytest.raises(ValueError, match="no rates"):
        mixing.mix(docs, labels, (0.1, 0.1, 0.8), must_reach=True)
    with pytest.warns(UserWarning, match="nearest"):
        rows, fit = mixing.mix_with_totals(docs, labels, (0.1, 0.1, 0.8))
    rows = rows.collect()
    t, p, r = np.array([x.n_tokens for x in rows], float), np.array([x.p for x in rows]), np.array([x.rate for x in rows])
    part, asked = t / t.sum(), np.array((0.1, 0.1, 0.8))
    assert np.allclose((r * t) @ p, fit.reached) and not np.allclose(fit.reached / t.sum(), asked, rtol=0.01)
    slope = p @ ((r * part) @ p - asked) + mixing.NEAR * (r - 1)
    assert (slope > -1e-4).all() and np.abs(slope[r > 0]).max() < 1e-4


def test_mixing_without_what_it_needs(spark):
    docs, labels = mixture(spark)
    one_kind = labels.filter("quality = 1 and toxic = 0")
    with pytest.warns(UserWarning):
        for epochs in (None, 1.25):
            got = mixing.mix(docs, labels.limit(0), epochs=epochs).collect()
            assert len(got) == 100 and all(r.rate == r.copies == 1 and np.allclose(r.p, 1 / 3) for r in got)
            for some in (docs.limit(1), docs):
                kept = mixing.mix(some, one_kind, epochs=epochs).collect()
                assert len(kept) == some.count() and all(r.rate >= 0 and np.isfinite(r.rate) for r in kept)
            lone = mixing.mix(docs.limit(1), labels, epochs=epochs).collect()
            assert len(lone) == 1 and 0 <= lone[0].rate < 2
        once = mixing.mixed_docs(docs, labels.limit(0), epochs=1.25)
        assert Counter(map(tuple, once.collect())) == Counter(map(tuple, docs.collect()))
        nulls = spark.createDataFrame([(1, None, 0), (None, None, 1)], PLAIN)
        assert mixing.mix(nulls, labels).count() == 2 and mixing.mixed_docs(nulls, labels, epochs=1.25).count() == 2


@pytest.mark.parametrize("keep", [(0,), (0, 2), (0, 1, 2)])
def test_a_scarce_domain_costs_no_tokens(spark, keep):
    docs, labels = mixture(spark)
    docs = docs.filter(F.col("place").isin(*keep) & (F.col("place") != 1) | (F.col("place").isin(*keep) & (F.col("doc_id") < 62)))
    rows, fit = mixing.mix_with_totals(docs, labels, epochs=1.25)
    assert abs(fit.targets.sum() / fit.natural.sum() - 1) < 1e-6 and abs(fit.reached.sum() / fit.natural.sum() - 1) < 0.01
    copies = {r.doc_id: r.copies for r in rows.collect()}
    assert all(copies[k] >= 1 for k in range(60))  # clean documents stay


def test_what_a_domain_lacks_goes_to_others():
    for asked, most, want in (((0.97, 0.02, 0.01), (1.25, 0.001, 0.02), (0.97 + 0.019 * 0.97 / 0.98, 0.001, 0.01 + 0.019 * 0.01 / 0.98)), ((0.5, 0.3, 0.2), (0.6, 0.1, 0.25), (0.6, 0.1, 0.25)), ((0.5, 0.5), (1, 1), (0.5, 0.5)), ((1.0, 0.0), (0.4, 0.5), (0.4, 0.5))):
        assert np.allclose(mixing.reachable(np.array(asked, float), np.array(most, float)), want)


def test_a_hot_label_sends_one_row(spark):
    docs, labels = mixture(spark)
    hot = docs.filter("doc_id = 3").crossJoin(spark.range(500)).select("doc_id", "text", "place")
    chosen = docs.unionByName(hot).join(labels, "doc_id").select(F.col("doc_id").alias("_id"), F.lit(0).alias("domain"), "text")
    rows, domain = mixing.training_rows(chosen)
    assert len(rows) == len(domain) == 100


def test_the_domains_fit_is_small_on_the_driver():
    rnd = np.random.default_rng(5)
    rows = [np.unique(rnd.integers(0, mixing.BUCKETS, 250)).astype("<u2") for _ in range(3000)]
    domain = rnd.integers(0, 3, len(rows))
    tracemalloc.start()
    mixing.fit_softmax(rows, domain, 3, 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10e6


def test_blocks_do_not_change_the_domains_fit(monkeypatch):
    rnd = np.random.default_rng(6)
    rows = [np.unique(rnd.integers(0, 300, rnd.integers(0, 60))).astype("<u2") for _ in range(90)]
    domain = rnd.integers(0, 3, len(rows))
    whole = mixing.fit_softmax(rows, domain, 3)
    monkeypatch.setattr(mixing, "FIT_ROWS", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, mixing.fit_softmax(rows, domain, 3)))


def test_a_pass_of_the_lasso_is_one_task(spark):
    rnd = np.random.default_rng(7)
    x = rnd.random((400, len(quality.STATISTICS)))
    rows = [(float(r[0] + r[1] > 1), *map(float, r)) for r in x]
    train = spark.createDataFrame(rows, "y double, " + ", ".join(f"{k} double" for k in quality.STATISTICS)).repartition(8)
    spark.sparkContext.setJobGroup("lasso", "lasso")
    try:
        assert quality.fit_rules(train)[1]
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    seen = spark.sparkContext.statusTracker()
    jobs = [seen.getJobInfo(j) for j in seen.getJobIdsForGroup("lasso")]
    passes = [[s for k in j.stageIds if (s := seen.getStageInfo(k))] for j in jobs if j]
    passes = [p for p in passes if any("RDDLossFunction" in s.name for s in p)]
    assert passes and all([s.numTasks for s in p if "RDDLossFunction" in s.name] == [1] for p in passes)


def test_long_white_space_is_encoded(spark):
    texts = ["a" + " " * 1_000_000 + "b <|endoftext|>", "x" + "\n" * 400_000]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    plain = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, text in enumerate(texts):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, packing.CLOSING], "<u4")
        assert {(r.start, r.ids_crc32) for r in rows if r.doc_id == k} == {(s, zlib.crc32(ids[s : s + 2048].tobytes())) for s in range(0, len(ids), 2048)}


def test_sequences_are_packed_to_their_tier(spark):
    """A short tier's sequences are full; the others are padded to the window, and together hardly at all."""
    rnd = random.Random(4)
    docs = spark.createDataFrame([(k, "word " * rnd.choice([rnd.randint(1, 30)] * 24 + [rnd.randint(150, 250)] * 8 + [rnd.randint(300, 500)] * 5 + [rnd.randint(600, 1000)] * 3 + [rnd.randint(1100, 3000)])) for k in range(900)], "doc_id long, text string")
    sequences = {}
    for r in packing.pack(docs).collect():
        sequences.setdefault(r.sequence_id, []).append(r)
    per_group, ids, padded = {}, 0, 0
    for rows in sequences.values():
        tier, n = next(t for t in packing.TIERS if max(r.length for r in rows) <= t), sum(r.length for r in rows)
        length = tier if n == tier else packing.WINDOW
        assert {r.sequence_length for r in rows} == {length} and n <= length
        per_group.setdefault(rows[0].step_group, Counter())[length] += 1
        ids, padded = ids + n, padded + (n if n & (n - 1) == 0 else packing.WINDOW)
    assert len(per_group) > 1 and padded - ids < 0.01 * padded
    for t in packing.TIERS:
        n = [c[t] for c in per_group.values()]
        assert sum(n) and max(n) - min(n) <= 1


def test_wrapped_statements_are_found(spark):
    filler = "some other words " * 30
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy\nof this software"
    gpl = " * This work is licensed\n * under the GNU General\n * Public License version 3"
    texts = [a + "\n" + s + "\n" + a for s in (bsd, mit, gpl) for a in ("", filler)]
    got = [r.labels for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert all(want in labels.split(",") for labels, want in zip(got, [x for w in ("bsd-terms", "mit-grant", "gpl-3") for x in (w, w)]))


def test_megabytes_of_phrases(spark):
    text = "cc by x " * 700_000
    got = licenses.scan_licenses(spark.createDataFrame([(1, text), (2, "all rights reserved")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert tuple(got[0])[1:6] == (2_100_000, 700_000, 0, 2_099_997, "cc-by") and got[1].n_base == 1


@pytest.mark.parametrize("form", ["json", "orc", "csv"])
def test_rows_of_any_format(spark, tmp_path, form):
    """Only Parquet tells a row's place in its file; other rows are written to such files first."""
    rnd = random.Random(9)
    a, b = prose(rnd), prose(rnd)
    rows = [(1, a, 0), (2, a, 1), (3, b, 2), (4, b + " end", 3), (5, None, 4)]
    spark.createDataFrame(rows, PLAIN).repartition(2).write.format(form).save(str(tmp_path / form))
    docs = spark.read.schema(PLAIN).format(form).load(str(tmp_path / form))
    assert not is_file_scan(docs)
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert sorted(r.place for r in exact_dedup.drop_copies(docs).collect()) in ([0, 2, 3, 4], [1, 2, 3, 4])
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert sorted(r.doc_id for r in ngram_join.keep_representatives(docs).collect()) == [1, 3, 5]
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()} == {1: 60, 2: 60, 3: 60, 4: 60, 5: 0}
    assert {r.doc_id for r in suffixes.remove_repeated_bytes(docs).collect() if r.n_removed} == {1, 2, 3, 4}


def test_a_file_listed_twice(spark, tmp_path):
    rnd = random.Random(10)
    path = str(tmp_path / "docs")
    spark.createDataFrame([(k, prose(rnd), k) for k in range(40)], PLAIN).repartition(3).write.parquet(path)
    assert is_file_scan(spark.read.parquet(path).filter("doc_id > 1").select("doc_id", "text"))
    docs = spark.read.parquet(path, path)
    assert docs.count() == 80 and not is_file_scan(docs)
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(docs).collect()) == list(range(40))
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()} == {(k, k, 2) for k in range(40)}
    assert sorted(r.doc_id for r in ngram_join.keep_representatives(docs).collect()) == list(range(40))


def test_a_long_log_of_states_is_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_BATCHES", 2)
    for k in range(5):
        path = str(tmp_path / f"feed{k}")
        spark.createDataFrame([(10 - k, "a b"), (100 + k, f"own {k}")], "doc_id long, text string").write.parquet(path)
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark.read.parquet(path), state_dir=str(tmp_path / "state"), run=str(k)).collect()}
        assert got == {10 - k: (10 - k, k + 1), 100 + k: (100 + k, 1)}
    assert len(glob.glob(str(tmp_path / "state" / "changed" / "*"))) <= 4


def test_a_call_leaves_no_state(spark):
    before = set(glob.glob(f"{shared_dir(spark)}/dedup-*/*"))
    exact_dedup.exact_dedup(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")).collect()
    left = set(glob.glob(f"{shared_dir(spark)}/dedup-*/*")) - before
    assert {x.rsplit("/", 1)[1] for x in left} <= {"fed"}
