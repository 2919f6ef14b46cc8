import os
import random

import pytest

from tidewell.llm import mixing
from tidewell.llm.mixing import mix, rates, shares
from tidewell.llm.tokens import TOKENIZERS, encoding, with_tokens

TARGETS = "source string, target_share double, max_repeats int"
TOKENS = "doc_id long, source string, n_tokens long, copy_no string"


def tokens(spark, seed=1, count=3000):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.choice(["a", "a", "a", "a", "b", "c", "d", None]), rng.choice([0, 3, 10, 50, 400]), "x") for i in range(count)], TOKENS)


def test_shares_and_limits(spark):
    t = tokens(spark)
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.3, 4), ("gone", 0.1, 2), (None, 0.5, 1), ("d", 0.0, 1)], TARGETS)
    found = rates(t, targets)
    out = mix(t, found, row_id="doc_id").collect()
    most = {"a": 1, "b": 3, "c": 4}
    copies, by_source = {}, {}
    for r in out:
        copies.setdefault(r["doc_id"], []).append(r["copy_no"])
        by_source[r["source"]] = by_source.get(r["source"], 0) + r["n_tokens"]
        assert r["copy_no"] <= most[r["source"]]
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values())
    whole = sum(by_source.values())
    for s, want in (("a", 0.2), ("b", 0.5), ("c", 0.3)):
        assert abs(by_source[s] / whole - want) < 0.05
    assert sorted(map(str, mix(t.repartition(7), found, row_id="doc_id").collect())) == sorted(map(str, out))
    told = {r["source"]: r for r in shares(mix(t, found, row_id="doc_id"), found).collect()}
    assert told["gone"]["tokens_used"] == 0 and abs(told["b"]["actual_share"] - by_source["b"] / whole) < 1e-12
    assert any(abs(r.rate - r.most) < 1e-9 for r in found)


def test_a_copy_is_as_likely_for_every_length_and_told_deviations_hold(spark):
    rows = [(i, "a", 10 if i % 2 else 1000, "x") for i in range(20_000)] + [(100_000 + i, "b", 500, "x") for i in range(2000)]
    t = spark.createDataFrame(rows, TOKENS)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGETS)
    found = rates(t, targets)
    for balanced in (False, True):
        out = mix(t, found, row_id="doc_id", balanced=balanced)
        taken = {r["n_tokens"]: r["count"] for r in out.where("source = 'a'").groupBy("n_tokens").count().collect()}
        rate = next(r for r in found if r.source == "a").rate
        for n in (10, 1000):
            assert abs(taken[n] / 10_000 - rate) < (0.0002 if balanced else 0.02)
        told = {r["source"]: r for r in shares(out, found).collect()}
        miss = abs(told["a"]["tokens_used"] - told["a"]["tokens_expected"])
        assert miss <= (2000 if balanced else 4 * told["a"]["expected_deviation"])


@pytest.mark.parametrize("ranked", [50_000, 50])
def test_balanced_draw_meets_shares(spark, monkeypatch, ranked):
    monkeypatch.setattr(mixing, "RANKED_ROWS", ranked)
    t = tokens(spark)
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.3, 4), ("gone", 0.1, 2)], TARGETS)
    found = rates(t, targets)
    out = mix(t, found, row_id="doc_id", balanced=True)
    for r in shares(out, found).collect():
        assert abs(r["deviation"]) < 0.002
    again = mix(t.repartition(7), found, row_id="doc_id", balanced=True)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    copies = out.groupBy("doc_id").count().join(t, "doc_id").groupBy("source").max("count").collect()
    assert all(r[1] <= {"a": 1, "b": 3, "c": 4}[r[0]] for r in copies)


def test_a_smaller_mix(spark):
    t = tokens(spark)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    found = rates(t, targets, total_tokens=5000)
    assert abs(sum(r.rate * r.tokens for r in found) - 5000) < 1e-6
    spread = sum(r.fraction * (1 - r.fraction) * r.squares for r in found) ** 0.5
    for balanced, most in ((False, 4 * spread), (True, 800)):
        used = mix(t, found, row_id="doc_id", balanced=balanced).groupBy().sum("n_tokens").first()[0]
        assert abs(used - 5000) <= most


def test_nothing_to_mix(spark):
    t, targets = tokens(spark).limit(0), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mix(t, rates(t, targets), row_id="doc_id").count() == 0
    assert shares(mix(t, rates(t, targets), row_id="doc_id"), rates(t, targets)).first()["actual_share"] == 0.0
    assert mix(tokens(spark), rates(tokens(spark), targets.limit(0)), row_id="doc_id").count() == 0


@pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no vocabulary files here")
def test_tokens_are_whole_and_round_trip(spark):
    own = encoding()
    texts = ["", None, "Hello world", " \n\t ", "Größe déjà señor 数据", "<|endoftext|>", "word " * 30_000, "a" * 50_000]
    out = {r["doc_id"]: r["n_tokens"] for r in with_tokens(spark.createDataFrame(list(enumerate(texts)) + [(None, "x")], "doc_id long, text string"), "doc_id", "text").collect()}
    for i, t in enumerate(texts):
        assert out[i] == (len(own.encode_ordinary(t)) if t else 0)
        assert not t or own.decode(own.encode_ordinary(t)) == t
    assert len(out) == len(texts)
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for t in texts[2:6]:
        assert other.encode(t, add_special_tokens=False).ids == own.encode_ordinary(t)
