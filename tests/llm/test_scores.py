"""Toxicity, quality, language, language model."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, language_model, quality, samples, toxicity
from tidemark.llm.tables import crc_mod

rnd = random.Random(9)
PLAIN = [f"p{i}q" for i in range(400)]


def text(n=60, pool=PLAIN):
    return " ".join(rnd.choice(pool) for _ in range(n))


@pytest.fixture(scope="module")
def marked(spark):
    """Toxic texts hold two of a few words; bad texts shout."""
    rows, labels = [], []
    for i in range(600):
        toxic, good = i % 6 == 0, i % 4 != 0
        t = text()
        if toxic:
            t += " badword nasty" + (" badword" if i % 12 else "")
        if not good:
            t = " ".join(w.upper() + "!!" for w in t.split())
        rows.append((i, t))
        if i % 5 < 3:
            labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_crc_split_is_that_of_the_id_as_text(spark):
    got = {r[0]: r[1] for r in spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", crc_mod("doc_id", 4)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 for i in range(50)}


def test_toxicity_finds_toxic_texts(marked, odd_docs, no_docs):
    docs, labels = marked
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    right = [(got[i] >= 0.3) == (i % 6 == 0) for i in got]
    assert np.mean(right) > 0.98
    out = toxicity.score_documents(odd_docs, model).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    added = toxicity.add_score(odd_docs, model)
    assert added.columns == odd_docs.columns and sorted(r["score"] for r in added.collect()) == pytest.approx(sorted(r["score"] for r in out))
    nothing = toxicity.train(no_docs, labels)
    assert {r["score"] for r in toxicity.score_documents(odd_docs, nothing).collect()} == {0.0}
    assert not len(toxicity.train(docs, labels.where("toxic = 0")).biases)
    assert toxicity.score_documents(no_docs, model).count() == 0


def test_risk_stays_non_negative():
    """A single feature that marks all positives, seen in a tenth of the unlabelled rows: their scores meet the prior's share."""
    positive = (np.zeros(50, np.int64), np.arange(51))
    held = np.arange(500) < 50
    unlabelled = (np.zeros(50, np.int64), np.concatenate([[0], np.cumsum(held)]))
    w, b = toxicity.nnpu(positive, unlabelled, 1, 0.1, steps=600)
    assert 1 / (1 + math.exp(-(w[0] + b))) > 0.9 and 1 / (1 + math.exp(-b)) < 0.05


def test_quality_votes(marked, odd_docs, no_docs):
    docs, labels = marked
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, model).collect()}
    assert np.mean([(got[i] >= 0.7) == (i % 4 != 0) for i in got]) > 0.98
    out = {r["doc_id"]: r["score"] for r in quality.score_documents(odd_docs, model).collect()}
    assert out[0] == out[1] == out[2] == pytest.approx(model.labels.mean()) and all(0 <= s <= 1 for s in out.values())
    assert {r["score"] for r in quality.score_documents(odd_docs, quality.train(no_docs, labels)).collect()} == {0.5}
    assert quality.score_documents(no_docs, model).count() == 0


def test_neighbours_are_exact():
    texts = pa.array([text(20) for _ in range(40)])
    counts, labels = quality.bags(texts), np.arange(40) % 2
    model = quality.fit(counts, labels, dims=8)
    vectors = model.project(counts)
    want = []
    for v in vectors:
        cosine = vectors @ v
        near = np.argsort(-cosine, kind="stable")[:5]
        weight = np.maximum(cosine[near], 0).astype(float) ** quality.POWER
        want.append((weight * labels[near]).sum() / weight.sum())
    assert model.score(texts, k=5) == pytest.approx(want, abs=1e-4)


def test_softmax_without_levelling_is_exact_and_large_weights_are_levelled():
    rng = np.random.default_rng(4)
    p = language_model.new_parameters(100, 2, rng)
    states, target = np.tanh(rng.standard_normal((500, language_model.HIDDEN))).astype(np.float32), rng.integers(0, 100, 500)
    valid = language_model.valid_members(100)
    large = {k: v * 200 for k, v in p.items()}
    assert not language_model._must_level(p) and language_model._must_level(large)
    assert language_model._must_level({k: v * np.nan for k, v in p.items()})
    for q in (p, large):
        of, member = target // language_model.CLASS, target % language_model.CLASS
        want = np.zeros(500)
        for x, at in (
            (states.astype(float) @ q["to_class"] + q["class_bias"], of),
            (np.einsum("nh,nhm->nm", states.astype(float), q["to_member"][of]) + q["member_bias"][of] + valid[of], member),
        ):
            want += x[np.arange(500), at] - np.logaddexp.reduce(x, axis=1)
        assert language_model.log_members(q, states, target, valid) == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_language_words_first_then_shorter_grams(spark, odd_docs, no_docs):
    rows = [(i, "the cat and the dog in house", "en") for i in range(5)] + [(10 + i, "der hund und die katze im haus", "de") for i in range(5)] + [(20, None, "en"), (21, "x", None)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    texts = ["the dog", "und HAUS", "katzen hunde", "houses", None, "123 !!", "日本", "th"]
    got = language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert [by[i][0] for i in (0, 1, 2, 3, 7)] == ["en", "de", "de", "en", "en"]
    assert by[4] == by[5] == ("und", 0.0) and by[6][1] == pytest.approx(0.5)
    out = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd_docs, model).collect()}
    assert out[0] == out[1] == out[14] == "und" and out[8] in ("de", "en")
    empty = language.train(no_docs)
    assert {r["lang_pred"] for r in language.identify(odd_docs, empty).collect()} == {"und"}
    assert language.identify(no_docs, model).count() == 0


def test_grams_of_code_points():
    for order, n in ((5, 1), (3, 3), (1, 3)):
        gram, owner = language._grams(["éab".encode(), b"q"], order)
        assert (owner == 0).sum() == n


def tokens_of(t):
    lower = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def test_language_model_base_and_probabilities(spark, odd_docs, no_docs):
    learned = odd_docs.where("doc_id between 3 and 9").select("doc_id", "text")
    counts = language_model.token_counts(learned).persist()
    model = language_model.train(learned, counts, vocabulary=40, known=60, epochs=1)
    seen = collections.Counter(w for r in learned.collect() for w in tokens_of(r["text"]))
    n, v = sum(seen.values()), len(seen)
    out = language_model.score_documents(odd_docs, model, counts).collect()
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        own = tokens_of(r["text"])
        want.append((r["doc_id"], len(own), sum(w in seen for w in own), sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)))
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in out), key=str)
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9)
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in out)
    # all outputs of one step make up one, and so do the known and one unknown token of each bucket
    p, width = model.network, model.n_outputs
    state = np.repeat(language_model.step(p, np.zeros((1, language_model.HIDDEN), np.float32), np.array([width])), width, 0)
    logs = language_model.log_members(p, state, np.arange(width), language_model.valid_members(width))
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-5)
    nothing = language_model.token_counts(no_docs)
    blank = language_model.train(no_docs, nothing, epochs=1)
    assert {r["n_known"] for r in language_model.score_documents(odd_docs, blank, nothing).collect()} == {0}
    assert language_model.score_documents(no_docs, model, counts).count() == 0


def test_state_is_carried_and_batches_do_not_matter(spark, odd_docs):
    learned = odd_docs.where("doc_id between 3 and 9").select("doc_id", "text")
    counts = language_model.token_counts(learned).persist()
    model = language_model.train(learned, counts, vocabulary=40, known=60, epochs=1)
    texts = pa.array(["one w38x w7x", "w7x " * 50, "", "w38x"])
    hashes, bucket, first = language_model.tokens(texts)
    numbers = model.numbers(model.places(hashes), bucket)
    together = language_model._states_and_scores(model, numbers, first, block=7)
    one_by_one = []
    for low, high in zip(first, first[1:]):
        state, before = np.zeros((1, language_model.HIDDEN), np.float32), np.array([model.n_outputs])
        for at in range(low, high):
            state = language_model.step(model.network, state, before)
            before = numbers[at : at + 1]
            one_by_one.append(language_model.log_members(model.network, state, before, language_model.valid_members(model.n_outputs))[0])
    assert together == pytest.approx(one_by_one, abs=1e-4)


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    outputs, start = 70, 70
    p = {k: v.astype(np.float64) for k, v in language_model.new_parameters(outputs, 2, rng).items()}
    ids = rng.integers(0, outputs, (3, 6))
    before = np.hstack([np.full((3, 1), start), ids[:, :-1]])
    valid = language_model.valid_members(outputs)

    def loss():
        state, total = np.zeros((3, language_model.HIDDEN)), 0.0
        for t in range(6):
            state = language_model.step(p, state * (before[:, t] != start)[:, None], before[:, t])
            total -= language_model.log_members(p, state, ids[:, t], valid).sum() / 3
        return total

    _, grads = language_model._window(p, np.zeros((3, language_model.HIDDEN)), before, ids, start, valid)
    for name in p:
        at = tuple(rng.integers(0, s) for s in p[name].shape) if name not in ("embed",) else (int(ids[0, 0]), 2)
        old, e = p[name][at], 1e-5
        p[name][at] = old + e
        up = loss()
        p[name][at] = old - e
        down = loss()
        p[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * e), rel=1e-3, abs=1e-6), name


def test_training_sees_all_tokens_of_all_texts(spark):
    words = [f"v{i}" for i in range(8)]
    late = " ".join(f"u{i % 50}" for i in range(3000)) + " " + " ".join(words * 400)
    rows = [(None, " ".join(words * 20))] * 1500 + [(None, None), (1, late), (1, late), (2, "")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    counts = language_model.token_counts(texts).persist()
    model = language_model.train(texts, counts, vocabulary=100, known=200, shard=150_000, rounds=2)
    # texts without an id are learned from too: after each word the next one is known
    out = language_model.score_documents(texts.where("doc_id is null and text is not null").limit(3), model, counts).collect()
    assert len(out) == 3 and all(r["score"] > r["base_score"] / 2 for r in out)
    # every token is dealt once, the last ones of long texts too, and nothing ends where no text does
    numbers = collections.Counter()
    for r in language_model.dealt(texts, model, 7).collect():
        before, target, heads = language_model._sequence([bytes(r["numbers"])], language_model._kind(model.n_outputs))
        numbers.update(target.tolist())
        assert heads[0] and before[0] == model.n_outputs and (before[1:] == target[:-1]).all() and not heads[1:].any()
    assert numbers[0] == len(rows) and sum(numbers.values()) == model.total


def test_long_texts_are_dealt_in_runs(spark, monkeypatch):
    monkeypatch.setattr(language_model, "RUN", 10)
    texts = spark.createDataFrame([(1, " ".join(f"u{i}" for i in range(34)))], "doc_id long, text string")
    model = language_model.train(texts, language_model.token_counts(texts).persist(), epochs=1)
    rows = sorted(language_model.dealt(texts, model, 3).collect(), key=lambda r: r["nth"])
    kind = language_model._kind(model.n_outputs)
    parts = [language_model._sequence([bytes(r["numbers"])], kind) for r in rows]
    assert [len(p[1]) for p in parts] == [10, 10, 10, 5] and parts[-1][1][-1] == 0
    assert all(b[0][0] == a[1][-1] for a, b in zip(parts, parts[1:]))


def test_samples_keep_rows_of_tiny_shares_and_stay_bounded(spark):
    assert 0 < samples.threshold(1, 10**12) < samples.DRAWS // 10**11
    assert samples.threshold(5, 5) == samples.DRAWS
    rows = spark.range(20_000).select(F.col("id"), F.lit("x").alias("label"))
    kept = samples.sample_rows(rows, "id", 500, "label", 1).count()
    assert 380 < kept < 620
    same = spark.range(20_000).select(F.lit(1).alias("id"), F.lit("the same").alias("text")).unionByName(spark.range(30).select(F.lit(2).alias("id"), F.col("id").cast("string").alias("text")))
    assert samples.distinct_texts(same, 10, 1).count() == 10
    assert samples.distinct_texts(same, 100, 1).count() == 31


def test_features_counted_in_spark_leave_the_model_as_it_is(marked):
    """All features on the driver, or the likely ones only: the same choice and the same weights."""
    docs, labels = marked
    toxic = [r["doc_id"] for r in labels.where("toxic = 1").collect()]
    both = docs.where(F.col("doc_id").isin(toxic)).select(F.lit(1).alias("role"), "text").unionByName(docs.select(F.lit(0).alias("role"), "text")).orderBy("role", "text")
    table = toxicity._featured(both.coalesce(1)).toArrow()
    lists = table["features"].combine_chunks()
    first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    whole = toxicity.fit(table["role"].to_numpy(), lists.flatten().to_numpy(), first, 0.2)
    few = toxicity.fit(*toxicity._collected(both.coalesce(1)), 0.2)
    assert len(whole.numbers) and (whole.numbers == few.numbers).all()
    np.testing.assert_allclose(whole.weights, few.weights)


def test_scoring_steps_hold_few_texts_of_like_length(spark, odd_docs, monkeypatch):
    learned = odd_docs.where("doc_id between 3 and 9").select("doc_id", "text")
    model = language_model.train(learned, language_model.token_counts(learned).persist(), vocabulary=40, known=60, epochs=1)
    hashes, bucket, first = language_model.tokens(pa.array(["w38x " * n for n in (1, 90, 3, 0, 2, 88, 700, 1)]))
    # the table of top bits finds what a search of all known tokens finds
    odd = np.concatenate([hashes, model.tokens, model.tokens + np.uint64(1), model.tokens - np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
    where = {int(t): i for i, t in enumerate(model.tokens)}
    assert model.places(odd).tolist() == [where.get(int(h), -1) for h in odd]
    numbers = model.numbers(model.places(hashes), bucket)
    want = language_model._states_and_scores(model, numbers, first)
    widths, turn = [], language_model._turn
    monkeypatch.setattr(language_model, "ABREAST", 3)
    monkeypatch.setattr(language_model, "_turn", lambda *a: (widths.append(a[0].shape[1]), turn(*a)))
    assert language_model._states_and_scores(model, numbers, first, block=50) == pytest.approx(want, abs=1e-4)
    # 701, 91 and 89 tokens side by side, then 4, 3, 2 and 2, 1: short texts are not drawn along by the longest
    assert max(widths) == 3 and 701 <= len(widths) <= 701 + 4 + 2 and sum(widths) < 2 * len(numbers)
