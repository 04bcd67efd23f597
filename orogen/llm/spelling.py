"""Spelling variants: words one edit apart, found by asymmetric chunks and grams; each leads to its far commoner form."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import join_counted, keep, map_batches

LEAST_LENGTH, LEAST_COUNT, RATIO, MISSPELT = 6, 5, 5, 199
#: Pairs of one key that are compared; keys with more are split by chunks of what is still open in them.
KEY_PAIRS = 1024
_RUN = re.compile("[a-zÀ-ÿ]+")


def misspelt(doc_id: int | None, run: str, every: int = MISSPELT) -> str:
    """The run, without one code point if `every` divides the CRC-32 of '<doc_id>:<run>'; as it stands without an id."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run


def word_counts(docs: DataFrame, every: int = MISSPELT, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: maximal runs of Latin letters, A-Z lower-cased, one in `every` misspelt.

    Null and empty texts have no words; rows that repeat an id or a text count each. Rows with a null doc_id count
    with no run misspelt. Counts are combined in each batch and again before the shuffle.
    """

    def each(batches: Iterator[list[list]]) -> Iterator[list]:
        for ids, texts in batches:
            found: Counter[str] = Counter()
            for d, text in zip(ids, texts):
                for run, n in Counter(_RUN.findall(text.encode().lower().decode()) if text else ()).items():
                    word = misspelt(d, run, every)
                    if len(word) >= least_length:
                        found[word] += n
            yield [list(found), list(found.values())]

    rows = map_batches(docs, ["doc_id", "text"], each, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: with the first half of its open part fixed as a chunk, and with the second half."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    ends = F.array(F.struct(middle.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), middle.alias("hi")))
    split = rows.withColumn("_end", F.explode(ends)).withColumns({"lo": F.col("_end.lo"), "hi": F.col("_end.hi")})
    return split.select("word", "n", "chunked", "length", "more", "lo", "hi", _key().alias("key"))


def _key() -> Column:
    """The chunks that a row has fixed, with their places: all of the word but its open part."""
    before = F.substring(F.col("word"), F.lit(1), F.col("lo"))
    after = F.substring(F.col("word"), F.col("hi") + F.col("more") + 1, F.char_length("word"))
    return F.concat_ws(":", "length", "lo", "hi", F.concat(before, after))


def near_pairs(words: DataFrame, key_pairs: int = KEY_PAIRS) -> DataFrame:
    """a, b, na, nb: all pairs of different words that one inserted, deleted or replaced code point parts, each once.

    The shorter word (of equal ones: the smaller) gives two disjoint chunks, its halves. One edit leaves one of them
    whole, the first where it was, the second shifted by the difference of the lengths, which is 0 or 1. The other
    word gives its positional grams for words of its length and of one less; grams at places where no chunk of
    these can stand meet nothing and are not made. Where a key would pair too many words, what is still open is
    parted into two chunks in the same way, down to one code point: so a common beginning or ending is never
    searched by all pairs. Candidates are verified by their edit distance.
    """
    size = F.char_length("word")
    roles = F.array(*(F.struct(F.lit(c).alias("chunked"), (size - m).alias("length"), F.lit(m).alias("more")) for c, m in ((True, 0), (False, 0), (False, 1))))
    rows = keep(_halves(words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.*", F.lit(0).alias("lo"), F.col("r.length").alias("hi"))))
    found = None
    while True:
        sides = rows.groupBy("key").agg(
            F.count_if("chunked").alias("_a"), F.count_if(~F.col("chunked")).alias("_b"), F.count(F.lit(1)).alias("rows_of_key"), F.max(F.col("hi") - F.col("lo")).alias("_open")
        ).where("_a > 0 and _b > 0")
        counted = keep(join_counted(rows, keep(sides), "key", rows.count(), "rows_of_key"))
        heavy = (F.col("_a") * F.col("_b") > key_pairs) & (F.col("_open") > 1)
        light = counted.where(~heavy)
        one = light.where("chunked").select("key", F.col("word").alias("a"), F.col("n").alias("na"))
        two = light.where("not chunked").select("key", F.col("word").alias("b"), F.col("n").alias("nb"), "more")
        near = one.join(two, "key").where("(more = 1 or a < b) and levenshtein(a, b, 1) = 1").select("a", "b", "na", "nb")
        found = near if found is None else found.unionByName(near)
        rest = counted.where(heavy)
        if rest.isEmpty():
            return found.dropDuplicates(["a", "b"])
        rows = keep(_halves(rest))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for each word, form: links are followed to their last, by doubling; links must not run in circles."""
    at = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = keep(at.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        at = step.select("word", "root")
        if step.where("_moved").isEmpty():
            return at


def variants(words: DataFrame, ratio: int = RATIO, key_pairs: int = KEY_PAIRS) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of different words and their counts.

    A word's form is its near word of the largest count (ties: the smallest), if that is `ratio` times the word's own
    at least; its root is where forms lead. Words without near words have n_near 0 and are their own root. An empty
    table gives no rows; other columns are ignored.
    """
    pairs = near_pairs(words.select("word", "n"), key_pairs)
    ends = F.array(*(F.struct(F.col(x).alias("word"), F.col(f"n{x}").alias("n"), F.col(y).alias("near"), F.col(f"n{y}").alias("near_n")) for x, y in ("ab", "ba")))
    near = pairs.select(F.explode(ends).alias("e")).select("e.*")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    known = near.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    known = keep(known.withColumn("_led", -F.col("best.less") >= ratio * F.col("n")).select(
        "word", "n_near", F.when(F.col("_led"), F.col("best.near")).alias("form"), F.when(F.col("_led"), -F.col("best.less")).alias("form_n")
    ))
    led = roots(known.where("form is not null").select("word", "form"))
    return words.select("word", "n").join(known, "word", "left").join(led, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """variants() of the words of all documents. A table without words gives no rows."""
    return variants(keep(word_counts(docs)))


ORACLE_SQL = r"""
with recursive polynomial(v, k, c) as (
  select range, 0, range from range(256)
  union all select v, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from polynomial where k < 8),
crc_table as (select list(c order by v) as t from polynomial where k = 8),
runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents),
counted as (select doc_id, run, count(*) as n from runs group by all),
coded as (
  select doc_id, run, n, hex(encode(doc_id::varchar || ':' || run)) as x from counted),
hashed as (
  select run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(1, length(x), 2), lambda k: ('0x' || substr(x, k, 2))::bigint)),
    lambda h, b: xor(h >> 8, t[xor(h & 255, b) + 1]))) as h
  from coded, crc_table where doc_id is not null
  union all select run, n, 1 from coded where doc_id is null),
words as (
  select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, sum(n)::bigint as n
  from hashed group by 1),
kept as (select word, n from words where length(word) >= 6 and n >= 5),
cut as (
  select word, n, k, substr(word, 1, k) || substr(word, k + 2) as less
  from (select word, n, unnest(range(length(word))) as k from kept)),
near as (
  select distinct a.word, a.n, b.word as other, b.n as other_n from cut a join cut b on a.less = b.less and a.k = b.k and a.word <> b.word
  union select distinct a.word, a.n, b.word, b.n from cut a join kept b on a.less = b.word
  union select distinct b.word, b.n, a.word, a.n from cut a join kept b on a.less = b.word),
best as (
  select word, n, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from near group by word, n),
forms as (select word, n_near, case when other_n >= 5 * n then other end as form, case when other_n >= 5 * n then other_n end as form_n from best),
followed(word, root) as (
  select word, form from forms where form is not null
  union all select f.word, g.form from followed f join forms g on f.root = g.word where g.form is not null),
last as (select f.word, f.root from followed f left join forms g on f.root = g.word where g.form is null)
select k.word, f.form, coalesce(l.root, k.word) as root, k.n, coalesce(f.n_near, 0) as n_near, f.form_n
from kept k left join forms f using (word) left join last l using (word)
"""
