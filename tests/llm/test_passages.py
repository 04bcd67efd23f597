"""Passages that documents share: whole words compared, and nothing taken for a repeat that is none."""

import random

from orogen.llm import paragraphs, spans

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abdeilmnorstu") for _ in range(6)) for _ in range(n)]


def table(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], DOCS)


def test_a_large_family_of_unlike_paragraphs_is_left_alone(spark):
    """2,000 license lines inside texts of 120 words: they differ in one inner word, Jaccard 12 / 22, and are no passages."""
    line = words(21, 1)
    family = {k: " ".join([*words(60, 10_000 + k), *line[:10], f"name{k}", *line[11:], *words(40, 20_000 + k)]) for k in range(2000)}
    docs = table(spark, family)
    assert paragraphs.repeated_passages(docs).count() == 0
    assert paragraphs.paragraph_keys(docs).groupBy("key").count().where("count > 500").count() > 0  # though they do collide


def test_a_repeat_is_found_though_earlier_documents_own_its_phrases(spark):
    """Each phrase of 8 to 30 words of a shared passage stands in earlier documents of its own, which lack the rest."""
    texts, passages = {}, [words(n, 50 + n) for n in (51, 60, 90, 140)]
    for k, passage in enumerate(passages):
        for j, at in enumerate(range(0, len(passage) - 8, 3)):
            n = (8, 12, 20, 30)[j % 4]
            for copy in range(3):
                texts[1000 * k + 3 * j + copy] = " ".join(words(40, 30_000 + 999 * k + 3 * j + copy) + passage[at : at + n] + words(40, 60_000 + 999 * k + 3 * j + copy))
        for d in (900, 901):
            texts[1000 * k + d] = " ".join(words(50, 100_000 + 10 * d + k) + passage + words(50, 200_000 + 10 * d + k))
    got = {r["doc_id"]: r for r in paragraphs.repeated_passages(table(spark, texts)).collect()}
    assert {d for d, r in got.items() if r["n_removed"]} == {901, 1901, 2901, 3901}
    for k, passage in enumerate(passages):
        row = got[1000 * k + 901]
        covered = {w for s in row["spans"] for w in range(s["start"], s["end"])}
        assert row["other_docs"] == [1000 * k + 900] and covered >= set(range(50, 50 + len(passage)))


def test_runs_of_changed_words_are_part_of_a_near_passage(spark):
    """100 to 400 words with runs of 2 to 8 words replaced, left out or put in: like at 0.8, and found whole."""
    texts, want, r = {}, {}, random.Random(3)
    for k in range(90):
        passage, n = words((100, 160, 400)[k % 3], 200 + k), 3 + k % (4 if k % 3 == 0 else 6)
        at = r.choice([25, 30, 40, 50, len(passage) - 40])
        near = passage[:at] + words(n if k % 4 != 1 else 0, 300 + k) + passage[at + (n if k % 4 != 2 else 0) :]
        texts[k] = " ".join(words(60, 40_000 + k) + passage + words(40, 41_000 + k))
        texts[500 + k] = " ".join(words(45, 42_000 + k) + near + words(50, 43_000 + k))
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (passage, near))
        if len(a & b) >= 0.8 * len(a | b):
            want[500 + k] = [(45, 45 + len(near))]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in paragraphs.repeated_passages(table(spark, texts)).collect() if r["n_removed"]}
    assert len(want) > 75 and {d: got.get(d) for d in want} == want


def test_many_passages_of_one_document_are_dealt_in_portions(spark):
    """A document that repeats more documents than one row takes, and a keeper that more ranges are asked of."""
    own = {k: words(60, 70_000 + k) for k in range(3 * paragraphs.PORTION)}
    texts = {k: " ".join(words(30, 80_000 + k) + p + words(20, 90_000 + k)) for k, p in own.items()}
    texts[5000] = " ".join(w for k, p in own.items() for w in [*p, f"between{k}", f"and{k}"])
    texts |= {6000 + k: " ".join(words(40, 95_000 + k) + own[k] + own[k + 1] + words(20, 96_000 + k)) for k in range(0, len(own) - 1, 2)}
    got = {r["doc_id"]: r for r in paragraphs.repeated_passages(table(spark, texts)).collect()}
    assert got[5000]["other_docs"] == sorted(own) and got[5000]["n_removed"] == len(own)
    assert all(set(got[6000 + k]["other_docs"]) >= {k, k + 1} for k in range(0, len(own) - 1, 2))


def test_near_copies_of_51_to_60_words_are_found(spark):
    """One passage in two documents, one inner word changed: at 51 words and more similarity is 0.8 or more."""
    texts, r = {}, random.Random(5)
    for k in range(150):
        passage = words(51 + k % 10, 1000 + k)
        near = list(passage)
        near[r.randrange(1, len(near) - 1)] = f"other{k}"
        texts[k] = " ".join(words(70, 3000 + k) + passage + words(40, 4000 + k))
        texts[500 + k] = " ".join(words(50, 5000 + k) + near + words(60, 6000 + k))
    got = {r["doc_id"]: r["other_docs"] for r in paragraphs.repeated_passages(table(spark, texts)).collect()}
    assert all(got.get(500 + k) == [k] for k in range(150))


def test_no_word_of_a_repeated_passage_is_left(spark):
    """Exact copies and copies with one inner word changed, of 51 to 200 words; all other words stay."""
    texts, want = {}, {}
    for k in range(40):
        passage = words((51, 60, 79, 100, 200)[k % 5], 100 + k)
        copy, before, after = list(passage), words(33 + k, 7000 + k), words(45, 8000 + k)
        if k % 2:
            copy[len(copy) // 2 - k % 11] = "changed"
        texts[k] = " ".join(words(40, 9000 + k) + passage + words(30, 9500 + k))
        texts[100 + k] = " ".join(before + copy + after)
        want[k], want[100 + k] = texts[k].split(), before + after
    got = {r["doc_id"]: r["text"].split() for r in paragraphs.without_repeats(table(spark, texts)).collect()}
    assert got == want


def runs_of(spark, sf, length):
    """For each document of a corpus the places at which so many words stand in a document with a smaller id too."""
    rows = sorted((r["doc_id"], paragraphs._WORD.findall((r["text"] or "").lower())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    seen, found = {}, {}
    for d, ws in rows:
        own = [hash(tuple(ws[k : k + length])) for k in range(len(ws) - length + 1)]
        found[d] = [k for k, h in enumerate(own) if seen.get(h, d) != d]
        for h in own:
            seen.setdefault(h, d)
    return found


def test_recall_and_clean_documents_of_a_corpus(spark):
    """Against all shared runs of the corpus: 40 words in common are cut, and a cut has 20 words in a row in common."""
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r["spans"] for r in paragraphs.repeated_passages(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r["n_removed"]}
    long, short = runs_of(spark, sf, 40), runs_of(spark, sf, 20)
    want = {d for d, at in long.items() if at}
    assert want <= got.keys()
    words = [any(s["start"] <= k and k + 40 <= s["end"] for s in got.get(d, ())) for d, at in long.items() for k in at]
    assert sum(words) >= 0.99 * len(words)
    assert all(any(s["start"] <= k and k + 20 <= s["end"] for k in short[d]) for d, spans in got.items() for s in spans)


def test_odd_rows(spark):
    passage = " ".join(words(60, 1))
    rows = [(None, passage, "en", "s", 1), (None, None, "en", "s", 0), (1, "", "en", "s", 0), (2, passage, "en", "s", 1), (2, passage, "en", "s", 1), (2**53 + 1, "İ ſ ß " + passage + " end", "en", "s", 7)]
    rows += [(2**53 + 2, "other text of the same id " * 3, "en", "s", 7), (2**53 + 2, passage + " " + passage, "en", "s", 7), (9, "a " * 5000, "en", "s", 7), (10, "a " * 9000 + "b", "en", "s", 7)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as spans", "2 as _text", "3 as key", "doc_id as component")
    got = {r["doc_id"]: r for r in paragraphs.repeated_passages(docs).collect()}
    assert set(got) == {2, 2**53 + 1, 2**53 + 2, 9, 10} and got[2]["n_removed"] == 0 and got[2**53 + 1]["other_docs"] == [2] and got[10]["other_docs"] == [9]
    left = paragraphs.without_repeats(docs)
    assert left.columns == docs.columns and left.schema == docs.schema
    kept = sorted((str(r["doc_id"]), r["text"], r["n_chars"]) for r in left.where("doc_id is null or doc_id <> 10").collect() if r["text"] is not None)
    assert kept == sorted([("None", passage, 1), ("1", "", 0), ("2", passage, 1), ("2", passage, 1), (str(2**53 + 1), "İ ſ ß  end", 10), (str(2**53 + 2), rows[6][1], 7), ("9", rows[8][1], 7)])
    assert paragraphs.without_repeats(docs.where("false")).count() == 0 and paragraphs.repeated_passages(docs.where("false")).count() == 0


def test_words_are_those_of_the_pattern_in_all_of_unicode():
    """Every sign between letters, alone and beside others: the same hashes as of the words that _WORD finds."""
    from xxhash import xxh32_intdigest

    signs = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    texts = ["a" + "b".join(signs[k : k + 4096]) + "ſ" for k in range(0, len(signs), 4096)] + ["".join(signs), "", " ", "_a-B\x00\x1fc\x85d", None]
    for text in texts:
        want = [xxh32_intdigest(w) for w in paragraphs._WORD.findall((text or "").lower())]
        assert paragraphs.word_hashes(text).tolist() == want


def test_places_that_come_to_no_passage_are_not_followed(monkeypatch):
    """Texts with words changed, left out and put in, and with repeated words: what is followed finds all that all places find, and is less."""
    r, tried = random.Random(8), []
    follow = spans.aligned_from

    def counted(x, y, *rest):
        tried.append(1)
        return follow(x, y, *rest)

    monkeypatch.setattr(paragraphs, "aligned_from", counted)
    asked = []
    for k in range(300):
        one = words(r.choice([60, 150, 400]), 500 + k)
        for _ in range(k % 3):
            at = r.randrange(len(one))
            one[at:at] = [r.choice(["spam", one[at]])] * r.randrange(60)
        two, every = [], r.choice([12, 25, 40, 80])
        for w in one:
            what = r.randrange(4 * every)
            two += [] if what == 0 else [w, f"put{r.random()}"] if what == 1 else [f"other{r.random()}"] if what < 4 else [w]
        if k % 4 == 0:
            two = words(r.randrange(50), 900 + k) + two[len(two) // 2 :] + two[: len(two) // 2]
        x, y = paragraphs.word_hashes(" ".join(one)), paragraphs.word_hashes(" ".join(two))
        shared = set(paragraphs.key_hashes(x).tolist()) & set(paragraphs.key_hashes(y).tolist())
        asked += [(x, [{"keeper_doc": 1, "lo": 0, "words": y.tobytes(), "own": own}]) for own in (sorted(shared), None)]
    counts = []
    for least, similarity in ((40, 0.8), (40, 0.9), (25, 0.7), (40, 1.0), (60, 0.5)):
        tried.clear()
        got = [paragraphs.passages(x, a, least, similarity) for x, a in asked]
        some = len(tried)
        with monkeypatch.context() as m:
            m.setattr(paragraphs, "hopeful", lambda same, *_: same | True)
            assert [paragraphs.passages(x, a, least, similarity) for x, a in asked] == got
        counts.append((some, len(tried) - some))
        assert sum(map(len, got)) > 100
    assert counts[0][0] < 0.6 * counts[0][1]
