"""The log-frequency filter and the language model against plain counts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orogen.llm import ngrams

SCHEMA = "doc_id long, text string"
LETTERS = random.Random(0)
WORDS = ["".join(LETTERS.choice("abcdefgh") for _ in range(4)) for _ in range(300)]


def prose(seed, n):
    """Words that depend on the one before."""
    r, at, out = random.Random(seed), seed % 300, []
    for _ in range(n):
        at = (at * 7 + r.choice([1, 1, 1, 2, 3, 5, 11])) % 300
        out.append(WORDS[at])
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    out = [(k, prose(k, random.Random(k).randint(1, 400))) for k in range(300)]
    return out + [(300, None), (301, ""), (302, " \t\x0b\n"), (303, "Ünï çødé\x1cÉ UP up"), (None, prose(3, 60)), (5, out[5][1]), (6, "another text"), (304, "long " * 30_000)]


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def held_out(d):
    return d is None or zlib.crc32(str(d).encode()) % 10 == 0


def plain_base(rows):
    counts = Counter(t for d, x in rows if not held_out(d) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    base = [sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x)) for _, x in rows]
    return [(d, held_out(d), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), n, round(b, 6)) for (d, x), b in zip(rows, base)]


def in_order(found):
    return sorted(found, key=str)


@pytest.fixture(scope="module")
def scored(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("clash"), "row": F.lit(1), "n": F.lit(2)})
    return ngrams.scores(table).collect()


def test_base_scores_are_exact(rows, scored):
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in scored]
    assert in_order(got) == in_order(plain_base(rows))


def test_the_model_beats_the_base_on_texts_it_has_not_seen(scored):
    held = [r for r in scored if r["held_out"] and r["n_tokens"] > 20]
    assert len(held) > 15 and sum(r["score"] for r in held) > 0.6 * sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in scored)


@pytest.mark.parametrize("order", [2, 3])
def test_rare_words_are_joined_and_large_filters_shuffled_with_the_same_scores(spark, rows, order):
    table = spark.createDataFrame(rows, SCHEMA)
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    one = ngrams.language_model_scores(table, learn, order).collect()
    small = lambda r: (r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6))
    few = ngrams.language_model_scores(table, learn, order, common=20).collect()
    assert in_order(map(small, few)) == in_order(map(small, one))
    far = ngrams.language_model_scores(table, learn, order, common=20, filter_bytes=0).collect()
    full = lambda r: (*small(r), round(r["score"], 9))
    assert in_order(map(full, far)) == in_order(map(full, few))


def test_levels_are_never_too_low_and_seldom_too_high():
    r = np.random.default_rng(1)
    keys, counts = r.integers(0, 2**63, 60_000).astype(np.uint64), np.minimum(r.zipf(1.6, 60_000), 10**6)
    held = ngrams.Slices([(0, bits := ngrams.filter_slice(keys, counts).tobytes())], 1, len(bits))
    got = held.levels(keys, np.zeros(len(keys), np.int64))
    true = ngrams.level_of(counts)
    assert (got >= true).all() and (got > true).mean() < 0.05
    others = r.integers(0, 2**63, 60_000).astype(np.uint64)
    assert (held.levels(others, np.zeros(len(others), np.int64)) > 0).mean() < 0.05
    assert (ngrams.level_of(np.array([0, 1, 2, 3, 4])) == [0, 1, 2, 3, 4]).all() and abs(ngrams.COUNT_OF[ngrams.level_of(np.array([1000]))] / 1000 - 1) < 0.13


def test_probabilities_equal_the_formula_on_plain_counts():
    """With a dictionary in place of the filter, the score is the interpolation of relative frequencies."""
    texts = ["a b a b a c", "b a", None]
    model = ngrams.Model(2, 11, 4, {})
    model.back_off = np.full(ngrams.CLASSES, 0.4)
    p = ngrams.Passage(pa.array(texts), model)
    seen = Counter(np.concatenate([p.word_keys[p.at], *p.keys]).tolist())
    got = p.log_probability(lambda keys: np.array([seen[k] for k in keys.tolist()]), model)
    one, two = Counter(), Counter()
    for text in texts:
        t = [None, *tokens(text)]
        one.update(t[1:])
        two.update(zip(t, t[1:]))
    prior = lambda w: (one[w] + 0.1) / (11 + 0.1 * 5)
    want = [sum(math.log10(0.6 * two[v, w] / one[v] + 0.4 * prior(w)) for v, w in zip([None, *tokens(t)], tokens(t))) for t in texts]
    assert np.allclose(got, want)


def test_empty_tables_and_nothing_learned(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ngrams.scores(none).count() == 0
    only = ngrams.language_model_scores(spark.createDataFrame([(1, "a b")], SCHEMA), F.lit(False)).first()
    assert (only["n_tokens"], only["n_known"], only["train_tokens"], only["base_score"], only["score"]) == (3, 0, 0, 0.0, 0.0)


def test_a_large_filter_is_probed_without_writing_the_n_grams_of_each_text(spark):
    """Each block of texts sends its different keys once and gets a byte for each; keys by row took over ten times the texts."""
    r = np.random.default_rng(5)
    at = np.minimum(r.zipf(1.2, 500_000), 40_000)
    texts = [" ".join(f"w{x:05d}" for x in at[k : k + 500]) for k in range(0, len(at), 500)]
    table = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4)
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def written():
        bus.waitUntilEmpty()
        return store.executorList(True).head().totalShuffleWrite()

    before = written()
    found = ngrams.language_model_scores(table, F.col("doc_id") % 10 > 0, filter_bytes=0).collect()
    assert len(found) == len(texts) and written() - before < 5 * sum(map(len, texts))


def test_keys_come_back_from_lists_in_their_order():
    r = np.random.default_rng(6)
    for slices in (1 << 10, 1 << 14):
        keys = np.unique(r.integers(0, 2**64, 20_000, np.uint64))
        turned = np.sort(ngrams._turned(keys, slices))
        assert (np.sort(ngrams._turned_back(turned, slices)) == keys).all() and (np.diff((turned >> np.uint64(65 - slices.bit_length())).astype(int)) >= 0).all()
        assert (ngrams.Model(2, 1, 1, {}, slices).slice_of(ngrams._turned_back(turned, slices)) == (turned >> np.uint64(65 - slices.bit_length())).astype(int)).all()
    for x in (keys, np.array([0, 0], np.uint64), np.array([300, 1], np.uint64)):
        for plain in (0, ngrams.PLAIN):
            assert (ngrams._from_planes(ngrams._planes(x, plain), len(x), plain) == x).all()
