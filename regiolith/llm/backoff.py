"""Stupid-backoff scores of documents under a bigram model of the whole corpus.

The score of a word is c(before word) / c(before) if the pair occurs MIN_COUNT times or more, else ALPHA times
c(word) / N; a document's score is the sum of the logarithms. A pair seen once in a corpus that holds the document
is the document's own evidence, so MIN_COUNT is 2. Words are in lower case (A-Z), separated by white space, and
known by 63-bit hashes. All counts are exact:

1. one pass counts all words, and densely the pairs of a few FREQUENT words found on a bounded sample, which alone
   could be hot keys; another choice of frequent words changes the work and no count;
2. the VOCABULARY most frequent words have ids by rank, and their counts and the dense counts are sent to all
   tasks (both of a bounded size); any other word is rare and goes by its hash, which is negative;
3. the other pairs of known words are exploded to (doc_id, pair, times) and dealt by a hash of the pair. The count
   table of pairs is made there, gets the gain of each known pair over backing off, and is joined back to the rows;
4. a pair with a rare word is dealt by the rare word, so that one partition has all rows of the pair and all
   occurrences of the rare word, and counts both;
5. gains, and what needs no count from elsewhere, are summed by document.

A null or empty text has 0 words and score 0. Rows that share a doc_id (or have none) are summed together. An
empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regiolith.llm.common import map_rows, sampled_texts, table, texts
from regiolith.llm.shingles import MULTIPLIER, Lookup, WordHashes, counted

ALPHA = 0.4
MIN_COUNT = 2
VOCABULARY = 524_288
FREQUENT = 1_024
#: Documents on which the frequent words are found.
SAMPLE_ROWS = 4_000
ROWS = 1_024
#: Set in every word hash, so that hashes are negative as signed longs and ids are not.
TOP = np.uint64(1 << 63)
#: What the side of a row says of its rare word: the second word of a pair, the first, or the start of a document.
SECOND, FIRST, START = 1, 2, 3


class Model:
    """Counts by id, ids of word hashes, and counts of the pairs of frequent words."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, frequent: np.ndarray, dense: np.ndarray):
        """hashes and counts: signed hashes and counts of the vocabulary, most frequent first; frequent: ids."""
        self.hashes, self.counts, self.total, self.frequent, self.dense = hashes, counts, max(total, 1), frequent, dense

    def dense_gains(self, shift: float, min_count: int) -> np.ndarray:
        """Gains over backing off of the pairs of frequent words, 0 of those not known."""
        logs = np.log(self.counts[self.frequent].astype(float))
        n = np.maximum(self.dense, 1)
        return np.where(self.dense >= min_count, np.log(n) - logs[:, None] - logs[None, :] - shift, 0.0).astype(np.float32)


class WordNumbers:
    """Ids of the words of a text, or their hashes as negative numbers if they are rare."""

    def __init__(self, known: np.ndarray, frequent: np.ndarray):
        """known: signed hashes by id; frequent: ids."""
        self.hashes, self.known = WordHashes(), Lookup(known.view(np.uint64))
        self.places = np.full(len(known) + 1, -1, np.int32)  # the last is that of rare words
        self.places[frequent] = np.arange(len(frequent))

    def __call__(self, text: str) -> np.ndarray:
        h = self.hashes(text) | TOP
        ids = self.known(h).astype(np.int64)
        return np.where(ids < 0, h.view(np.int64), ids)

    def dense_places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words among the frequent ones, and whether a word and the next one both have one."""
        place = self.places[np.maximum(ids, -1)]
        return place, (place[:-1] >= 0) & (place[1:] >= 0)


def frequent_words(docs: DataFrame, frequent: int, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Signed hashes of the most frequent words of a bounded sample."""
    if not frequent:
        return np.zeros(0, np.int64)
    top = count_words(sampled_texts(docs, rows), np.zeros(0, np.int64)).orderBy(F.desc("n"), "key").limit(frequent)
    return top.select("key").toArrow().column("key").to_numpy()


def count_words(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(key, n): occurrences of each word, by its hash, and of each pair of frequent words, by their places."""
    width = len(frequent)

    def task():
        hashes, places = WordHashes(), Lookup(frequent.view(np.uint64))

        def step(block):
            if not block["text"]:
                return {"key": [], "n": []}
            parts = [hashes(t) | TOP for t in block["text"]]
            words = np.concatenate(parts)
            place = places(words).astype(np.int64)
            both = (place[:-1] >= 0) & (place[1:] >= 0)
            ends = np.cumsum([len(p) for p in parts])  # no pair reaches over the end of a text
            both[ends[(ends > 0) & (ends < len(words))] - 1] = False
            pairs = place[:-1][both] * width + place[1:][both]
            keys, n = zip(*(np.unique(x, return_counts=True) for x in (words.view(np.int64), pairs)))
            return {"key": np.concatenate(keys), "n": np.concatenate(n)}

        return step

    return map_rows(texts(docs), task, "key long, n long", rows=ROWS).groupBy("key").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, vocabulary: int = VOCABULARY, frequent: int = FREQUENT) -> Model:
    """The model of the most frequent words, at most ``vocabulary`` of them.

    Counts fall into steps of a sixteenth of a doubling. Whole steps are taken from the top while they fit, so only
    the words of the model and frequent * frequent pairs at most come to the driver."""
    chosen = frequent_words(docs, frequent)
    found = count_words(docs, chosen).withColumn("step", F.floor(16 * F.log2("n"))).cache()
    try:
        words, pairs = found.where("key < 0"), found.where("key >= 0")
        steps = words.groupBy("step").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()  # about 1,000 at most
        total, taken, least = sum(r["n"] for r in steps), 0, None
        for r in sorted(steps, key=lambda r: -r["step"]):
            taken += r["words"]
            if taken > vocabulary:
                break
            least = r["step"]
        top = words.where(F.lit(False) if least is None else F.col("step") >= least).select("key", "n").toArrow()
        square = pairs.select("key", "n").toArrow()
    finally:
        found.unpersist()
    hashes, counts = (top.column(c).to_numpy() for c in ("key", "n"))
    order = np.lexsort((hashes, -counts))
    hashes, counts = hashes[order], counts[order]
    dense = np.zeros(len(chosen) ** 2, np.int64)
    dense[square.column("key").to_numpy()] = square.column("n").to_numpy()
    dense = dense.reshape(len(chosen), len(chosen))
    ids = Lookup(hashes.view(np.uint64))(chosen.view(np.uint64))
    known = np.flatnonzero(ids >= 0)  # frequent in the sample, and in the vocabulary too
    return Model(hashes, counts, int(total), ids[known], np.ascontiguousarray(dense[np.ix_(known, known)]))


def with_side(other: np.ndarray, role: int) -> np.ndarray:
    """The other word of a pair and the role of the key in the last two bits; the sign stays."""
    return np.where(other >= 0, other << 2, other & ~np.int64(3)) | role


def pairs_of_known(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, pair, times) of each distinct pair of words with ids, at least one of them not frequent, in a document."""
    width, known, frequent = len(model.counts), model.hashes, model.frequent

    def task():
        numbers = WordNumbers(known, frequent)

        def step(block):
            ids_out, pairs, times = [], [], []
            for doc_id, text in zip(block["doc_id"], block["text"]):
                ids = numbers(text)
                _, both = numbers.dense_places(ids)
                a, b = ids[:-1], ids[1:]
                other = ~both & (a >= 0) & (b >= 0)
                found = a[other] * width + b[other]
                at, n = counted(found)
                ids_out += [doc_id] * len(at)
                pairs.append(found[at])
                times.append(n)
            joined = lambda parts: np.concatenate(parts) if parts else []
            return {"doc_id": ids_out, "pair": joined(pairs), "times": joined(times)}

        return step

    return map_rows(texts(docs), task, "doc_id long, pair long not null, times long not null")


def rare_rows(docs: DataFrame, model: Model, alpha: float, min_count: int) -> DataFrame:
    """(doc_id, word, side, times, words, base): rows for each distinct pair of a document with a rare word, one for a
    rare word at its start, and one (side 0) with its number of words and the score as if no pair of the other rows
    and none of pairs_of_known were known and every rare word occurred once."""

    known, frequent, log_alpha = model.hashes, model.frequent, math.log(alpha)
    shift = log_alpha - math.log(model.total)
    gains = model.dense_gains(shift, min_count)
    back = np.append(np.log(model.counts.astype(float)), 0.0) + shift  # the last is that of rare words

    def task():
        numbers = WordNumbers(known, frequent)

        def step(block):
            ids_out, word_parts, side_parts, times, words, base = [], [], [], [], [], []
            for row, (doc_id, text) in enumerate(zip(block["doc_id"], block["text"])):
                ids = numbers(text)
                place, both = numbers.dense_places(ids)
                score = 0.0
                if len(ids):  # the first word has no word before it
                    score = float(back[np.maximum(ids, -1)].sum() - log_alpha + gains[place[:-1][both], place[1:][both]].sum(dtype=float))
                a, b = ids[:-1], ids[1:]
                second, first, start = b < 0, a < 0, ids[:1][ids[:1] < 0]
                rare = np.concatenate([b[second], a[first]])
                side = np.concatenate([with_side(a[second], SECOND), with_side(b[first], FIRST)])
                at, n = counted(rare.view(np.uint64) * MULTIPLIER + side.view(np.uint64))
                ids_out += [doc_id] * (len(at) + len(start) + 1)
                word_parts += [rare[at], start, [hash((doc_id, row)) & 0x7FFFFFFF]]  # no rare word, and not one key
                side_parts += [side[at], np.full(len(start), START, np.int64), [0]]
                times += [n, np.ones(len(start), np.int64), [0]]
                words += [0] * (len(at) + len(start)) + [len(ids)]
                base += [0.0] * (len(at) + len(start)) + [score]
            joined = lambda parts: np.concatenate(parts).astype(np.int64) if parts else []
            return {"doc_id": ids_out, "word": joined(word_parts), "side": joined(side_parts), "times": joined(times), "words": words, "base": base}

        return step

    return map_rows(texts(docs), task, "doc_id long, word long, side long, times long, words long, base double")


def known_pairs(rows: DataFrame, model: Model, shift: float, min_count: int, min_docs: int) -> DataFrame:
    """The count table of pairs: (pair, gain) of each known pair, the gain over backing off."""
    spark = rows.sparkSession
    width = max(len(model.counts), 1)
    single = F.broadcast(  # at most vocabulary rows
        spark.createDataFrame(pd.DataFrame({"id": np.arange(len(model.counts)), "log_n": np.log(model.counts.astype(float))}), "id long, log_n double")
    )
    counts = rows.groupBy("pair").agg(F.sum("times").alias("n"), F.count("doc_id").alias("docs"))
    known = counts.where((F.col("n") >= min_count) & (F.col("docs") >= min_docs))
    first, second = (single.withColumnsRenamed({"id": f"id_{i}", "log_n": f"log_{i}"}) for i in (1, 2))
    return (
        known.join(first, F.floor(F.col("pair") / width) == F.col("id_1"))
        .join(second, F.col("pair") % width == F.col("id_2"))
        .select("pair", (F.log(F.col("n").cast("double")) - F.col("log_1") - F.col("log_2") - shift).alias("gain"))
    )


def rare_gains(rows: DataFrame, model: Model, shift: float, min_count: int) -> DataFrame:
    """(doc_id, words, gain) of the rows of rare_rows."""
    spark = rows.sparkSession
    single = F.broadcast(
        spark.createDataFrame(pd.DataFrame({"other": np.arange(len(model.counts)), "log_other": np.log(model.counts.astype(float))}), "other long, log_other double")
    )
    role = F.col("side").bitwiseAND(3)
    of_word = Window.partitionBy("word").orderBy("side").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = (
        rows.withColumn("c", F.sum(F.when(role.isin(SECOND, START), F.col("times"))).over(of_word))
        .withColumn("n", F.sum("times").over(Window.partitionBy("word", "side")))
        .withColumn("known", role.isin(SECOND, FIRST) & (F.col("n") >= min_count))
        .withColumn("other", F.when(F.col("known"), F.shiftright("side", 2)))  # negative, and so without a count, if it is rare
        .join(single, "other", "left")
    )
    log_c, zero = F.log(F.col("c").cast("double")), F.lit(0.0)
    # The row of the second word has the gain of a pair of two rare words; that of the first word has its count only.
    whole = F.log(F.col("n").cast("double")) - F.coalesce("log_other", zero) - shift
    gain = F.when(role == FIRST, F.when(F.col("known"), F.when(F.col("other") < 0, zero).otherwise(whole) - log_c)).when(
        role.isin(SECOND, START), F.when(F.col("known"), whole).otherwise(log_c)
    )
    return counts.select("doc_id", "words", (F.col("base") + F.coalesce(F.col("times") * gain, zero)).alias("gain"))


def backoff_scores(
    docs: DataFrame, alpha: float = ALPHA, min_count: int = MIN_COUNT, vocabulary: int = VOCABULARY, frequent: int = FREQUENT, min_docs: int = 0
) -> DataFrame:
    """(doc_id, n_words, log_score) of every document.

    ``min_docs``: how many distinct documents with an id must hold a pair of known words for it to count as known;
    pairs are then not counted densely."""
    model = fit(docs, vocabulary, 0 if min_docs else frequent)
    shift = math.log(alpha) - math.log(model.total)
    rows = pairs_of_known(docs, model).repartition("pair")  # read by the count table and by the join: shuffled once
    table_of_pairs = known_pairs(rows, model, shift, min_count, min_docs)
    gains = rows.join(table_of_pairs.hint("shuffle_hash"), "pair").select("doc_id", F.lit(0).cast("long").alias("words"), (F.col("times") * F.col("gain")).alias("gain"))
    return (
        gains.unionByName(rare_gains(rare_rows(docs, model, alpha, min_count), model, shift, min_count))
        .groupBy("doc_id")
        .agg(F.sum("words").alias("n_words"), F.sum("gain").alias("log_score"))
    )


def op1_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff_scores(table(spark, sf_dir, "documents"))
    return scored.select(
        "doc_id", "n_words", F.round("log_score", 3).alias("log_score"),
        F.round(F.try_divide(F.col("log_score"), F.col("n_words")), 5).alias("mean_log_score"),
    )


ORACLES = {
    "op1_backoff": r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') words
  from documents),
t as (select doc_id, unnest(range(1, len(words) + 1)) i, words from w),
p as (select doc_id, i, words[i] word, case when i > 1 then words[i - 1] end before from t),
u as (select word, count(*) n from p group by word),
b as (select before, word, count(*) n from p where before is not null group by before, word),
total as (select count(*) n from p),
s as (
  select p.doc_id, case
      when p.before is null then ln(u.n) - ln(total.n)
      when b.n >= 2 then ln(b.n) - ln(f.n)
      else ln(0.4) + ln(u.n) - ln(total.n) end score
  from p cross join total join u on u.word = p.word
    left join b on b.before = p.before and b.word = p.word left join u f on f.word = p.before)
select w.doc_id, cast(count(score) as bigint) n_words, round(coalesce(sum(score), 0), 3) log_score,
  round(case when count(score) > 0 then sum(score) / count(score) end, 5) mean_log_score
from w left join s on s.doc_id = w.doc_id group by w.doc_id"""
}
