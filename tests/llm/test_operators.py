"""The ten operators against brute-force versions, and on null, empty, repeated and clashing rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from orogen.llm import base, chat, components, decontamination, fingerprint, langid, packing, paragraphs, quality, queries, sharding, simhash, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(11)
VOCABULARY = ["".join(random.choice("abdeilmnorstu") for _ in range(random.randint(2, 8))) for _ in range(900)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + ("." if r.random() < 0.1 else "") for _ in range(n))


def odd_texts():
    long = prose(4000, 99)
    return [None, "", "   \n ", "a", "Ünï çødé. 日本語 text!", prose(40, 1), prose(40, 1), prose(300, 2), long, long, "x " * 3000, "no.stops\nat all\n\n" * 5]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en" if k % 2 else None, f"src{k % 3}", len(t or "")) for k, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("size", F.lit(1)).withColumn("component_id", F.lit(1)).withColumn("keys", F.lit(1))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, prose(random.Random(k).randint(1, 260), k), "en", "s", 0) for k in range(150)]
    rows += [(1000 + k, rows[k % 20][1], "en", "s", 0) for k in range(60)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def text_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


# --- 1


def test_url_rules_equal_a_plain_search(spark):
    hosts = ["a.org", "org", "example.org", "x.Example.ORG", "badorg", "b.com", "com", "d.net", "e.org.", "h.com:80"]
    urls = [f"{s}{h}{p}" for h in hosts for s in ("http://", "https://", "") for p in ("", "/", "/es/1", "/es", "/en/1", "/en/12?x", "/fr/q", "/de/", "/de", "?a/b", "#/es/")]
    urls += [None, "", "://", "http://org/#a://com/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages).collect()}
    by_join = urlfilter.judge(pages, most_bytes=0)
    assert got == {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in by_join.collect()}
    twice = pages.unionByName(pages).withColumn("page_id", F.lit(None).cast("long"))
    assert urlfilter.judge(twice).count() == 2 * len(urls) and urlfilter.judge(pages.where("false")).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(pages, [("org/", "block"), ("org/", "allow")]).where("rule is not null").collect()} == {"block"}
    assert urlfilter.judge(pages, []).where("rule is null and verdict = 'allow'").count() == len(urls)
    for k, url in enumerate(urls):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = rest[:cut].lower(), rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fit = [(r, v) for r, v in urlfilter.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
        assert got[k] == (host, path, *best), url


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("key like '%7'")
    cascade = urlfilter.build_cascade(listed, universe)
    rows = universe.select((cascade.listed(F.col("key")) == F.col("key").endswith("7")).alias("ok"))
    assert rows.where("not ok").count() == 0 and len(cascade.levels) > 2
    assert urlfilter.build_cascade(listed.where("key is null"), universe).levels == ()


# --- 2


def plain_scores(items):
    """For each item the weights of its words by BM25 over all items, as parts of its own score."""
    words = {i: decontamination.words_of(t or "") for i, t in items}
    words = {i: w for i, w in words.items() if w}
    df, mean = Counter(w for ws in words.values() for w in set(ws)), sum(map(len, words.values())) / len(words)
    out = {}
    for i, ws in words.items():
        own = {w: math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, f in Counter(ws).items()}
        out[i] = {w: x / sum(own.values()) for w, x in own.items()}
    return words, out


def plain_leaks(texts, items, least=0.5, similarity=0.8):
    words, weights = plain_scores(items)
    stride, item_text, found = max([64, *map(len, words.values())]), dict(items), {}
    grams = lambda ws: {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}
    for d, text in texts:
        ws = decontamination.words_of(text or "")
        for start in range(0, max(1, len(ws) - stride), stride):
            passage = ws[start : start + 2 * stride]
            for i, own in weights.items():
                score = sum(x for w, x in own.items() if w in set(passage))
                if score < least or not passage:
                    continue
                n = len(words[i])
                overlap = len(grams(words[i]) & grams(passage)) / len(grams(words[i])) if n >= 5 else float(any(passage[k : k + n] == words[i] for k in range(len(passage))))
                q, a = (len(set(p) & set(passage)) / len(set(p)) for p in decontamination.question_and_answer(item_text[i]))
                if overlap >= similarity and min(q, a) >= 0.5 and (d, i) not in found:
                    found[d, i] = (round(score, 9), overlap)
                elif (d, i) in found and (overlap, round(score, 9)) > found[d, i][::-1]:
                    found[d, i] = (round(score, 9), overlap)
    return found


def test_leaks_equal_a_plain_search(spark, docs, odd, none):
    items = [(k, prose(30, 5000 + k)) for k in range(70)] + [(900, None), (901, ""), (902, "two words"), (7, prose(30, 5007)), (8, prose(30, 5008))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    bad = [(5000 + k, prose(200, 700 + k) + " " + items[k][1].upper() + " " + prose(90, 800 + k), "en", "s", 0) for k in range(10)]
    bad += [(5050, prose(100, 5) + " two words " + prose(40, 6), "en", "s", 0), (5051, " ".join(items[20][1].split()[:27]) + " else", "en", "s", 0)]
    bad += [(5052, prose(4000, 77) + " " + items[30][1], "en", "s", 0)]
    all_ = docs.unionByName(spark.createDataFrame(bad, DOCS)).unionByName(odd.select(docs.columns).withColumn("doc_id", F.col("doc_id") + 7000))
    want = plain_leaks(list(text_of(all_).items()), list({i: t for i, t in reversed(items)}.items()))
    assert {(5000 + k, k) for k in range(10)} | {(5050, 902), (5051, 20), (5052, 30)} == set(want)
    for most in (3_000_000, 100):
        got = {(r["doc_id"], r["item_id"]): (round(r["score"], 9), r["overlap"]) for r in decontamination.contaminated(all_.withColumn("item_id", F.lit(0)), bench, most_postings=most).collect()}
        assert got == want
    assert text_of(decontamination.without_leaks(all_, bench)).keys() == text_of(all_).keys() - {d for d, _ in want}
    big = 2**53 + 1
    named = spark.createDataFrame([(None, bad[0][1], "en", "s", 0), (big, bad[1][1], "en", "s", 0), (big, bad[1][1], "en", "s", 0), (big, "clean", "en", "s", 0), (None, None, "en", "s", 0)], DOCS)
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in decontamination.contaminated(named, bench).collect()) == [(str(big), 1), (str(big), 1), ("None", 0)]
    left = decontamination.without_leaks(named.withColumn("score", F.lit("x")), bench)
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == [(str(big), "clean"), ("None", None)] and left.columns[-1] == "score"
    assert decontamination.contaminated(none, bench).count() == 0 and decontamination.contaminated(docs, bench.where("false")).count() == 0
    assert decontamination.without_leaks(none, bench).count() == 0 and decontamination.without_leaks(docs, bench.where("false")).count() == docs.count()


def test_block_max_wand_loses_nothing(spark):
    items = [(k, prose(25, 40 + k)) for k in range(90)]
    _, weights = plain_scores(items)
    index = next(decontamination.indexes(spark.createDataFrame(items, "item_id long, text string")))
    for seed in range(30):
        have = set(decontamination.words_of(prose(random.Random(seed).randint(5, 400), seed)))
        terms, every = sorted(index.terms[w] for w in have if w in index.terms), list(range(index.blocks))
        for least in (0.2, 0.4, 0.6):
            want = {i: s for i, own in weights.items() if (s := sum(x for w, x in own.items() if w in have)) >= least}
            got = {index.ids[i]: s for i, s in index.wand(terms, least, every)}
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    text = decontamination.words_of(" ".join(prose(60, k) for k in (41, 900, 77)) + " " + prose(25, 50) + " " + prose(100, 60))
    for least in (0.2, 0.4, 0.6):
        want = set()
        for start in range(0, max(1, len(text) - index.stride), index.stride):
            have = set(text[start : start + 2 * index.stride])
            want |= {(start, i) for i, own in weights.items() if sum(x for w, x in own.items() if w in have) >= least}
        assert {(s, index.ids[i]) for s, i, _ in index.search(text, least)} == want and want


# --- 3, 8


def plain_kernel(a, b):
    grams = [{t.lower()[k : k + n] for n in (1, 2, 3) for k in range(len(t) - n + 1)} for t in (a, b)]
    return len(grams[0] & grams[1]), len(grams[0])


def test_kernels_equal_plain_sets(spark):
    texts = ["the cat and the dog", "der Hund und die Katze", "日本語の文", "çà et là", ""] + [prose(30, k) for k in range(5)]
    grams = langid.Grams(texts)
    everything = {g for t in texts for n in (1, 2, 3) for g in (t.lower()[k : k + n] for k in range(len(t) - n + 1))}
    assert grams.columns == len(everything)
    p = grams.presence(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            (both, na), (_, nb) = plain_kernel(a, b), plain_kernel(b, a)
            assert abs(float(p[i] @ p[j]) - both / max(1, na * nb) ** 0.5) < 1e-4
    assert np.allclose(langid.Numbered(np.array([3, 9]), 1 << 40)[np.array([0, 3, 9, 10])], [-1, 0, 1, -1])
    few = langid.MOST_TABLE
    try:
        langid.MOST_TABLE = 1  # by search, with the same results
        assert np.array_equal(langid.Grams(texts).presence(texts), p)
    finally:
        langid.MOST_TABLE = few
    model = langid.fit(texts[:4], ["en", "de", "ja", "fr"])
    p = model.grams.presence(texts)  # of the four landmarks' n-grams
    kernel = np.array([[float(p[i] @ p[j]) for j in range(4)] for i in range(len(texts))])
    assert np.allclose(langid.score(model, texts), kernel @ model.coefficients, atol=1e-3)
    # Ridge regression in the span of the landmarks: the gradient of the weighted squared error and the penalty is null.
    k, y = kernel[:4], 2 * np.eye(4)[[2, 1, 3, 0]] * 0 + np.where(np.array(model.languages)[None, :] == np.array(["en", "de", "ja", "fr"])[:, None], 1.0, -1.0)
    assert np.allclose(k.T @ (4 * (k @ model.coefficients - y)) + 0.01 * 4 * k @ model.coefficients, 0, atol=1e-4)


def test_languages_of_held_out_documents(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    truth = base.read(spark, sf, "documents").select("doc_id", "lang")
    got = queries.op3_language_id(spark, sf).join(truth, "doc_id").where("held_out and lang is not null")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    model = langid.fit(["the cat and the dog", "der hund und die katze"], ["en", "de"])
    clash = odd.selectExpr("*", "1 as lang_pred", "2 as _rank").unionByName(odd.selectExpr("*", "1 as lang_pred", "2 as _rank").where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long")))
    rows = langid.identify(clash, model).collect()
    assert len(rows) == 15 and all(0 <= r["score"] <= 1 for r in rows) and sum(r["doc_id"] is None for r in rows) == 3
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (0, 1, 2, None)} == {"und"} == {r["lang_pred"] for r in langid.identify(odd, langid.fit([], [])).collect()}
    digits = spark.createDataFrame([(2**53 + 1, "½ ² ① 12"), (None, "日本"), (1, "a")], "doc_id long, text string")
    assert [(r["doc_id"], r["lang_pred"]) for r in langid.identify(digits, model).collect()] == [(2**53 + 1, "und"), (None, "de"), (1, langid.identify(digits, model).where("doc_id = 1").first()["lang_pred"])]
    assert langid.identify(none, model).count() == 0 and langid.learned(none, F.lit(True)).languages == []


def test_quality_of_held_out_documents(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_quality(spark, sf).join(base.read(spark, sf, "labels"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9
    nothing = np.zeros((0, quality.FEATURES))
    model = quality.fit(nothing, nothing, 0.7)
    assert all(abs(r["score"] - 0.7) < 1e-9 and r["predicted"] == 1 for r in quality.scored(odd, model).collect())
    kept = quality.accepted(odd.withColumn("doc_id", F.lit(None).cast("long")), model)
    assert kept.count() == 12 and kept.columns == odd.columns and {r["score"] for r in kept.collect()} == {"clash"}
    assert quality.scored(none, model).count() == quality.accepted(none, model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert abs(quality.learned(odd, labels, F.lit(True)).prior - 0.5) < 1e-9


def test_risk_and_prior():
    r = np.random.default_rng(3)
    p, u = r.normal(2, 1, 500), np.concatenate([r.normal(2, 1, 600), r.normal(-2, 1, 400)])
    plain = lambda z, y: np.mean([math.log1p(math.exp(-y * x)) for x in z])
    a, b = quality.risk(p, u, 0.6)
    assert abs(a - 0.6 * plain(p, 1)) < 1e-9 and abs(b - (plain(u, -1) - 0.6 * plain(p, -1))) < 1e-9
    assert 0.55 < quality.estimated_prior(p, u) < 0.72 and quality.estimated_prior(p, p) > 0.95
    # Steps lower the non-negative risk of the model below that of the constant one, and no gradient is left.
    x, w = np.zeros((500, quality.FEATURES)), np.zeros((1000, quality.FEATURES))
    x[:, 1], w[:, 1] = p, u
    model = quality.fit(x, w, 0.6)
    out = lambda z: np.log(quality.predict(model, z) / (1 - quality.predict(model, z)))
    assert sum(quality.risk(out(x), out(w), 0.6)) < 0.9 * sum(quality.risk(np.full(500, 0.4), np.full(1000, 0.4), 0.6))
    assert ((quality.predict(model, w) > 0.5) == (np.arange(1000) < 600)).mean() > 0.93


# --- 4


def smallest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        used, room = 1, mid
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("summary_rows", [20, 60_000])
def test_minimax_cuts_equal_a_plain_search(spark, summary_rows):
    r = random.Random(4)
    sizes = [r.choice([16, 20, 500, 3000, 9000]) for _ in range(400)]
    groups = spark.createDataFrame([(hashlib.sha256(str(k).encode()).hexdigest(), s) for k, s in enumerate(sizes)], "group string, bytes long")
    ordered = [x["bytes"] for x in groups.orderBy("group").collect()]
    ends = sharding.with_ends(groups).cache()
    capacity, cuts = sharding.minimax_cuts(ends, sum(sizes), max(sizes), 7, summary_rows)
    assert capacity == smallest_capacity(ordered, 7) and cuts[-1] == sum(sizes)
    even = sharding.even_cuts(ends, sum(sizes), capacity, cuts, 7, summary_rows)
    parts = [b - a for a, b in zip([0, *even], even)]
    assert set(even) <= {sum(ordered[: k + 1]) for k in range(len(ordered))} and max(parts) <= capacity and len(parts) == 7
    assert max(parts) - min(parts) < max(sizes) + 1 and min(parts) >= sum(sizes) / 7 - max(sizes)


def test_shards_keep_copies_together(spark, docs, odd, none):
    copy = "the same text " * 30
    hot = docs.unionByName(spark.createDataFrame([(9000 + k, copy, "en", "s", 0) for k in range(90)], DOCS))
    rows, texts = sharding.shard_documents(hot, shards=6).collect(), text_of(hot)
    assert len(rows) == hot.count()
    by_text, slots, sizes = {}, {}, {}
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 16 and r["text_crc32"] == zlib.crc32(t.encode()) and r["grown_shard"] is None
        by_text.setdefault(t, set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert all(len(s) == 1 for s in by_text.values()) and set(slots) == set(range(6))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    rest = [v for k, v in sizes.items() if {k} != by_text[copy]]
    assert max(rest) - min(rest) < 8000
    assert sharding.shard_documents(odd, shards=40).count() == 12 and sharding.shard_documents(none).count() == 0


# --- 5


def plain_simhash(text):
    words = (text or "").encode().translate(simhash._LOWER).split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64(g, seed=42).intdigest() >> b & 1 for g in grams) > len(grams))


def test_near_duplicates_equal_all_pairs(spark, docs, odd, none):
    extra = spark.createDataFrame([(3000 + k, prose(260, k % 12).replace("a", "A", 2).rsplit(" ", k // 12)[0], "en", "s", 0) for k in range(60)], DOCS)
    all_ = docs.unionByName(extra).unionByName(odd.select(docs.columns).withColumn("doc_id", F.col("doc_id") + 7000))
    fp = {d: plain_simhash(t) for d, t in text_of(all_).items()}
    parent = {d: d for d in fp}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(all_).collect()}
    assert got == {d: (fp[d], root(d)) for d in ids}
    assert {r["doc_id"] for r in simhash.one_of_each(all_).collect()} == {d for d in ids if root(d) == d}
    assert simhash.near_duplicates(none).count() == 0


def test_ball_hashing_finds_every_pair_within_the_radius(spark):
    r = random.Random(8)
    fps = {r.getrandbits(64) for _ in range(24)}
    for b in sorted(fps)[:16]:
        for flips in (1, 3, 4, 5, 8):
            fps.add(b ^ sum(1 << k for k in r.sample(range(64), flips)))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    for most in (simhash.MOST_VARIANTS, 3000):  # with 3,000, blocks are split up to whole variants
        links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), most=most)
        label = {x["node"]: x["label"] for x in components.components(links).collect()}
        for i, a in enumerate(signed):
            for b in signed[i + 1 :]:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                    assert label[a] == label[b]


def test_one_of_each_with_odd_ids(spark):
    a, b, big = prose(60, 1), prose(60, 2), 2**53 + 1
    rows = [(None, a), (big, a), (big, a), (big, b), (None, b), (5, prose(60, 3)), (5, prose(60, 4)), (None, prose(60, 5)), (None, prose(60, 5)), (7, None), (8, ""), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS).selectExpr("*", "1 as first", "'x' as fp", "2 as n")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(big, a), (big, b), (5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (7, None)])


def test_components_of_chains_and_stars(spark):
    rows = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5000), (None, 3)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert len({got[k] for k in range(301)}) == 1 and len({got[1000 + k] for k in range(200)}) == 1 and got[0] != got[1000]


# --- 6


def test_preferences_of_given_pairs(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, "user", None), (2, 0, None, "only"), (4, 0, "user", "s"), (5, 0, "user", "s")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("side", F.lit("clash"))
    pairs = spark.createDataFrame([(k // 2, k, "rejected" if k % 2 else "chosen") for k in range(6)], "pair_id long, conv_id long, side string")
    got = {r["pair_id"]: r for r in chat.preferences(chat.of_pairs(turns, pairs)).collect()}
    assert got[0]["prompt"] == "<|user|>\nq<|end|>\n" and got[0]["n_common"] == 1
    a, b = map(int, got[0]["chosen_spans"].split("-"))
    assert got[0]["chosen"][a:b] == "good<|end|>\n" and got[0]["rejected"].endswith("<|user|>\n<|end|>\n")
    assert got[1]["n_common"] == 0 and got[1]["chosen"] == "<||>\nonly<|end|>\n" and got[1]["rejected"] == ""
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[2]["n_common"] == 1
    assert chat.preferences(chat.of_pairs(turns.where("false"), pairs)).count() == 0


def test_preferences_against_another_answer(spark):
    rows = [(6, 0, "user", "q"), (6, 1, "assistant", "a"), (6, 2, "user", "more"), (6, 3, "assistant", "six"), (6, 4, "user", "thanks"), (7, 0, "assistant", "seven"), (7, 0, "assistant", "seven")]
    rows += [(-1, 0, "user", "m"), (-1, 1, "assistant", "minus one"), (-2, 0, "user", "n"), (-2, 1, "assistant", None), (1, 0, "user", "no answer"), (12, 0, "user", ""), (12, 1, "assistant", "x"), (None, 0, "user", "lost")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'c' as side", "0 as pair_id", "1 as at")
    got = {r["pair_id"]: r for r in chat.preferences(chat.swapped_answers(turns)).collect()}
    end = "<|end|>\n"
    assert set(got) == {6, 7, -1, -2, 1, 12}
    assert got[6]["n_common"] == 3 and got[6]["chosen"] == f"<|assistant|>\nsix{end}<|user|>\nthanks{end}" and got[6]["rejected"] == f"<|assistant|>\nseven{end}"
    assert got[7]["n_common"] == 0 and got[7]["rejected"] == f"<|assistant|>\nsix{end}"
    assert got[-1]["prompt"] == f"<|user|>\nm{end}" and got[-1]["rejected"] == f"<|assistant|>\n{end}" and got[-2]["rejected"] == f"<|assistant|>\nminus one{end}"
    assert got[1]["n_common"] == 1 and got[1]["chosen"] == got[1]["rejected"] == "" and got[12]["rejected"] == "" and got[12]["n_common"] == 1
    assert chat.preferences(chat.swapped_answers(turns.where("false"))).count() == 0
    whole = queries.op6_chat_preferences(spark, "/root/testdata/sf0.01")
    assert whole.where("n_common > 0 and prompt <> '' and rejected <> ''").count() > 0.9 * whole.count()


# --- 7


def test_packing_holds_every_token_once(spark, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    model = Tokenizer.from_file(path)
    special = ["<|endoftext|> [PAD] </s> x", "a<|endoftext|>B", "<|ENDOFTEXT|> <|startoftext|>", "É<|startoftext|><|endoftext|>\u0301日本", "don't<|endoftext|>'t\n<|endoftext|", "<|endoftext|>" * 3000]
    some = [(100 + k, prose(1 + 37 * k % 900, k)) for k in range(60)] + [(200 + k, t) for k, t in enumerate([*special, " ".join(special)])]
    more = odd.select("doc_id", "text").unionByName(spark.createDataFrame(some, "doc_id long, text string"))
    rows = packing.pack_documents(more, path).collect()
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    for d, t in text_of(more).items():
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want = [(k, 2048 * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(np.split(ids, range(2048, len(ids), 2048)))]
        assert sorted(pieces[d]) == want
    whole = packing.token_pieces(more, path).where("doc_id = 8").orderBy("piece").collect()
    assert [len(r["ids"]) for r in whole] == [r["length"] for r in whole]
    assert len(bins) <= sum(r["length"] for r in rows) / 2048 + 2
    assert packing.pack_documents(none, path).count() == 0


def test_plan_matches_large_items_two_by_two():
    plan = packing.plan({1100: 10, 900: 10, 700: 2, 48: 20})
    assert max(first + -(-ranks // each) for _, _, ranks, first, each, _ in plan) == 11
    assert sum(ranks for _, _, ranks, *_ in plan) == 42


# --- 9


def test_fingerprints_and_likeness(spark, docs, odd, none):
    all_ = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 7000).alias("doc_id"), "text"))
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(all_, quantiles=7, part_rows=5).collect()}
    texts = {d: t or "" for d, t in text_of(all_).items()}
    order = sorted(texts, reverse=True)
    parts = lambda t: {p for p in re.split(r"\n+|(?<=\.)\s+", t) if p}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, d in enumerate(order):
        t, following = texts[d], texts[order[(k + 1) % len(order)]]
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - like(parts(t), parts(edited))) < 1e-9 and abs(r["near_next"] - like(parts(t), parts(following))) < 1e-9
    by_text = {}
    for d, t in texts.items():
        by_text.setdefault(t, set()).add(got[d]["fingerprint"])
    assert all(len(s) == 1 for s in by_text.values())
    assert fingerprint.edited_fingerprints(none).count() == 0


# --- 10


def test_repeated_passages_are_found_and_cut(spark, docs, odd, none):
    passage = prose(60, 321)
    planted = [(6000 + k, prose(80 + 7 * k, 400 + k) + " " + passage + " " + prose(50, 500 + k), "en", "s", 0) for k in range(12)]
    clean = docs.where("doc_id < 150")
    all_ = clean.unionByName(spark.createDataFrame(planted, DOCS))
    got = {r["doc_id"]: r for r in paragraphs.repeated_passages(all_).collect()}
    assert set(got) == {6000 + k for k in range(12)}
    assert got[6000]["n_removed"] == 0 and all(6000 in got[6000 + k]["other_docs"] for k in range(1, 12))
    after = text_of(paragraphs.without_repeats(all_))
    assert after[6000] == planted[0][1] and all(passage not in after[6000 + k] for k in range(1, 12))
    assert all(after[r["doc_id"]] == r["text"] for r in clean.collect())
    assert all(planted[k][1].split()[:20] == after[6000 + k].split()[:20] for k in range(12))
    assert paragraphs.without_repeats(odd).columns == odd.columns and paragraphs.repeated_passages(none).count() == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs, kept = base.read(spark, sf, "documents"), []
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, docs, sf).cache())
        docs = kept[-1]
    assert [k.columns == columns for k in kept] == [True] * 4 + [False]
    counts = [k.count() for k in kept[:4]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert kept[-1].select("doc_id").distinct().count() == counts[-1]
