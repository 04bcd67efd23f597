"""The five stages, each against a brute-force version on its own input, and on odd rows."""

import random
from collections import Counter

import numpy as np
import pytest
from test_operators import DOCS, plain_leaks, plain_simhash, prose

import corpus_pipeline
from orogen.llm import paragraphs, quality, queries
from orogen.llm.base import crc32_of_id, read


def junk(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["$$$", "!!!", "BUY", "###", "%%", "NOW!!!"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with copies, near copies, shared passages, leaks and junk."""
    base = str(tmp_path_factory.mktemp("corpus"))
    items = [(k, prose(30, 7000 + k)) for k in range(12)]
    passage = prose(70, 8000)
    rows = [(k, prose(random.Random(k).randint(60, 240), k)) for k in range(90)]
    rows += [(200 + k, rows[k][1]) for k in range(8)] + [(300 + k, rows[20 + k][1] + " end") for k in range(8)]
    rows += [(400 + k, prose(90, 400 + k) + " " + passage + " " + prose(60, 500 + k)) for k in range(6)]
    rows += [(500 + k, prose(90, 600 + k) + " " + items[k][1] + " " + prose(60, 700 + k)) for k in range(5)]
    rows += [(600 + k, junk(80 + k, k)) for k in range(30)]
    rows += [(700 + k, prose(80, 900 + k) + f" {s} " + prose(70, 950 + k)) for k, s in enumerate(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "x<|endoftext|>Y"])]
    random.Random(1).shuffle(rows)
    labels = [(d, 0 if 600 <= d < 700 else 1, 0) for d, _ in rows if d % 3]
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOCS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_equal_brute_force(spark, folder):
    from tokenizers import Tokenizer

    docs, kept = read(spark, folder, "documents"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        kept.append((texts(docs), docs := spark.read.parquet(f"{folder}/stage{k}")))
        assert k == 4 or docs.columns == columns
    given, out = kept[0]
    model = quality.learned(read(spark, folder, "documents"), read(spark, folder, "labels"), crc32_of_id() % 5 != 0)
    want = {d for d, t in given.items() if quality.predict(model, quality.features(t).astype(np.float64)[None])[0] >= 0.3}
    assert texts(out).keys() == want and not any(600 <= d < 700 for d in want) and len(want) > 100

    given, out = kept[1]
    fp, least = {d: plain_simhash(t) for d, t in given.items()}, {}
    group = {d: {d} for d in fp}
    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 4 and group[a] is not group[b]:
                group[a] |= group[b]
                for d in group[b]:
                    group[d] = group[a]
    least = {min(g) for g in group.values()}
    assert texts(out) == {d: given[d] for d in least} and len(least) < len(given)

    given, out = kept[2]
    after, words = texts(out), {d: paragraphs._WORD.findall(t.lower()) for d, t in given.items()}
    seen, runs = {}, Counter()
    for d in sorted(words):
        own = [tuple(words[d][k : k + 40]) for k in range(len(words[d]) - 39)]
        runs[d] = sum(w in seen for w in own)
        seen.update((w, d) for w in own if w not in seen)
    assert sum(n > 0 for n in runs.values()) == 5 and {d for d in given if after[d] == given[d]} == {d for d, n in runs.items() if not n}
    left, seen = {d: paragraphs._WORD.findall(t.lower()) for d, t in after.items()}, set()
    for d in sorted(left):
        own = {tuple(left[d][k : k + 40]) for k in range(len(left[d]) - 39)}
        assert not own & seen
        seen |= own

    given, out = kept[3]
    items = [(r["item_id"], r["text"]) for r in read(spark, folder, "benchmark").collect()]
    bad = {d for d, _ in plain_leaks(list(given.items()), items)}
    assert texts(out) == {d: t for d, t in given.items() if d not in bad} and bad == {500, 501, 502, 503, 504}

    given, out = kept[4]
    model = Tokenizer.from_file(queries.tokenizer_path())
    lengths = {d: len(model.encode(t, add_special_tokens=False).ids) + 1 for d, t in given.items()}
    rows = [tuple(r) for r in out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()]
    total = Counter()
    for d, _, _, n, *_ in rows:
        total[d] += n
    assert total == lengths
    bins = Counter()
    for *_, n, _, s, _ in rows:
        bins[s] += n
    # No packing has fewer sequences than the tokens fill, or than half of the pieces over half of the capacity ask for.
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(lengths.values()) // 2048) + 1
    ran = [tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "piece", "start", "length", "ids_crc32").collect()]
    assert Counter(ran) == Counter(r[:5] for r in rows)


def test_stages_on_odd_rows(spark, folder):
    big = 2**53 + 1
    rows = [(None, prose(80, 1)), (None, prose(80, 1)), (None, None), (1, None), (2, ""), (3, "   \n"), (big, prose(120, 2)), (big, prose(120, 2)), (big, prose(90, 3)), (7, "x " * 30_000), (8, prose(30, 7001)), (None, prose(40, 9) + " " + prose(30, 7002))]
    docs = spark.createDataFrame([(d, t, "en", None, 0) for d, t in rows], DOCS)
    docs = docs.selectExpr("*", "1 as score", "'p' as predicted", "2 as first", "3 as _text", "4 as _row", "5 as spans", "6 as key", "7 as item_id", "8 as length", "9 as sequence_id", "10 as fp", "11 as piece")
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), folder).count() == 0, name
        out = stage(spark, docs, folder)
        got = out.collect()
        counts[name] = Counter((r["doc_id"], r["text"]) if "text" in out.columns else r["doc_id"] for r in got)
        if name != "best-fit packing":
            assert out.schema == docs.schema, name
            assert all((r["score"], r["predicted"], r["_text"], r["fp"]) == (1, "p", 3, 10) for r in got)
    given = Counter(rows)
    assert counts["quality classifier"] <= given and counts["quality classifier"][(big, rows[6][1])] in (0, 2)
    alone = counts["simhash near-dedup"]
    assert alone[(None, rows[0][1])] == 1 and alone[(big, rows[6][1])] == 1 and alone[(big, rows[8][1])] == 1 and alone[(1, None)] == 1 and (2, "") not in alone and alone[(7, rows[9][1])] == 1
    assert counts["substring dedup"] == given
    assert given - counts["benchmark decontamination"] == Counter([rows[10], rows[11]])
    assert set(counts["best-fit packing"]) == {d for d, _ in rows} and sum(counts["best-fit packing"].values()) > len(rows)
