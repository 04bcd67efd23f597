"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orogen.llm import spelling


def distance_is_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if distance_is_one(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = [best if best and counts[best] >= ratio * n else None, n, len(near)]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.append(root)
    return {w: (form, root, n, near, counts[form] if form else None) for w, (form, n, near, root) in out.items()}


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("key_pairs", [0, 4, 1024])
def test_variants_equal_all_pairs_however_far_keys_are_split(spark, key_pairs):
    r = random.Random(5)
    words = {"".join(r.choice("abé") for _ in range(r.randint(1, 7))) for _ in range(350)} | {"station" + c * k for c in "sz" for k in range(5)} | {"x" * k for k in (50, 51, 53)}
    counts = {w: r.choice([5, 6, 26, 131, 700, 3600]) for w in sorted(words)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("key", F.lit("clash"))
    got = found(spelling.variants(table, key_pairs=key_pairs))
    assert got == plain(counts)
    assert any(root not in (w, form) for w, (form, root, *_) in got.items())  # chains of forms are followed


def test_a_hot_ending_is_not_searched_by_all_pairs(spark):
    """Thousands of words with one ending: pairs that are compared stay far below those that share it."""
    words = [(f"{a}{b}{c}tion", 5) for a in "abcdefghijklm" for b in "aeioubcdfg" for c in "klmnprst"]
    table = spark.createDataFrame(words, "word string, n long")
    got = spelling.near_pairs(table, key_pairs=64)
    assert got.count() == sum(distance_is_one(a, b) for a, _ in words for b, _ in words) // 2


def test_words_of_odd_rows(spark):
    rows = [(1, "Station station STATION. Éstation×x", 0), (1, "Station", 0), (None, "station", 0), (2, None, 0), (3, "", 0), (4, " ...", 0), (5, "station " * 40_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumn("word", F.lit("clash"))
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, least_length=1, least_count=1).collect()}
    want = Counter()
    for d, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate({k: k + 32 for k in range(65, 91)})
            h = zlib.crc32(f"{d}:{low}".encode())
            want[low if d is None or h % 199 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    want.pop("", None)
    assert got == {w: n for w, n in want.items() if w}
    assert spelling.spelling_variants(docs.where("false")).count() == 0
    assert [r["n_near"] for r in spelling.variants(docs.select(F.lit("lonely").alias("word"), F.lit(7).cast("long").alias("n")).limit(1)).collect()] == [0]


def test_the_misspelling_takes_the_code_point_that_the_hash_names():
    hits = [(d, w) for d in range(400) for w in ("station", "élan", "x") if zlib.crc32(f"{d}:{w}".encode()) % 199 == 0]
    assert hits and all(len(spelling.misspelt(d, w)) == len(w) - 1 for d, w in hits)
    assert all(spelling.misspelt(d, w) == w for d in range(50) for w in ("station",) if (d, w) not in hits)
