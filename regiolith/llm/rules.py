"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Every rule is a column that is true where a document fails. On a bounded sample each rule's cost (seconds for the
sample with all that the rule computes from the text, less those of a rule that computes nothing) and selectivity
(share of the sample that it rejects) are measured; rules are then tried in order of rejections per second inside one
CASE expression, which stops at the first rule that fails. The order changes the work, never the verdict. Texts are
split into words and lines once for all rules.

A null or empty text has no words and fails the base rules. Ties, repeated rows and empty tables need no care:
each row is judged alone, and with an empty sample the rules keep their given order. ``filter_quality`` keeps
all columns of its input.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regiolith.llm.common import checkpointed, sampled_texts, table, texts

SPACES = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
#: Rows on which cost and selectivity are measured.
SAMPLE_ROWS = 2_000
#: The least cost of a rule; differences below it are noise of the clock.
LEAST_SECONDS = 0.005


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES + "+"), lambda w: w != "")


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are compared by their 64-bit hash. A repeated window at position p covers p to p + 2, so the count
    is the sum of the distances to the next repeated window, 3 at most."""

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeats(p: Column) -> Column:
            return F.filter(
                p,
                lambda x, k: F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)),
            )

        starts = F.sort_array(F.transform(let(pairs, repeats), lambda x: x["i"]))
        steps = let(starts, lambda q: F.transform(q, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(q, k + 1) - x, F.lit(3)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(hashes))

    found = let(let(words, windows), count)
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(found)


class Parts:
    """A text, its words and lines, and what rules measure of them; nothing is computed that no column asks for."""

    def __init__(self, text: Column, words: Column, lines: Column | None = None):
        """``lines``: the lines with a word, if a column holds them already."""
        self.text, self.words, self.lines = text, words, lines
        self.n_words = F.size(words).cast("long")
        self.word_chars = F.length(F.translate(text, WHITE, "")).cast("long")
        self.n_symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")
        self.n_repeat_words = repeated_words(words)

    def of_lines(self, body: Callable[[Column], Column]) -> Column:
        return let(lines_of(self.text), body) if self.lines is None else body(self.lines)

    @property
    def n_dup_lines(self) -> Column:
        return self.of_lines(lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))

    def letters(self, pattern: str) -> Column:
        return F.length(F.regexp_replace(self.text, pattern, ""))

    def words_with(self, pattern: str) -> Column:
        return F.size(F.filter(self.words, lambda w: w.rlike(pattern)))


def of_parts(text: Column, body: Callable[[Parts], Column]) -> Column:
    """``body`` of the parts of a text, which is split once."""
    return let(words_of(text), lambda words: body(Parts(text, words)))


def fails_base(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Parts], Column]


BASE = Rule("base", lambda p: fails_base(p.n_words, p.n_repeat_words))


def production_rules() -> list[Rule]:
    """Rules of the method."""
    return [
        Rule("symbols", lambda p: 10 * p.n_symbols > 3 * p.n_words),
        Rule("repeated_lines", lambda p: p.of_lines(lambda x: 2 * (F.size(x) - F.size(F.array_distinct(x))) > F.size(x))),
        Rule("word_length", lambda p: ~p.word_chars.between(2 * p.n_words, 20 * p.n_words)),
        Rule("shouting", lambda p: 2 * p.letters(r"[^\p{Lu}]") > p.letters(r"[^\p{L}]")),
        Rule("no_letters", lambda p: 5 * p.words_with(r"\p{L}") < 4 * p.n_words),
        Rule("word_ends", lambda p: 10 * p.words_with(r"[#*$%&<>]{2}|!!") > p.n_words),
        Rule("word_runs", lambda p: 5 * F.size(F.filter(p.words, lambda x, i: F.coalesce(x == F.get(p.words, i - 1), F.lit(False)))) > p.n_words),
    ]


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def estimates(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost and selectivity of each rule on a bounded sample of documents with a non-null text."""
    sample = checkpointed(sampled_texts(docs, rows))

    def measured(fails: Column) -> tuple[float, float]:
        best, share = float("inf"), 0.0
        for _ in range(2):  # the first run also compiles
            began = time.perf_counter()
            row = sample.agg(F.count(F.lit(1)).alias("n"), F.count_if(fails).alias("failed")).first()
            best = min(best, time.perf_counter() - began)
            share = row["failed"] / row["n"] if row["n"] else 0.0
        return best, share

    idle, _ = measured(F.length("text") < 0)  # what any rule costs: a job that reads the sample
    made = []
    for rule in rules:
        seconds, share = measured(of_parts(F.col("text"), rule.fails))
        made.append(Estimate(rule.name, max(seconds - idle, LEAST_SECONDS), share))
    return made


def ordered(rules: list[Rule], found: list[Estimate]) -> list[Rule]:
    """By rejections per second, most first; rules without an estimate come last."""
    worth = {e.name: e.worth for e in found}
    return sorted(rules, key=lambda r: -worth.get(r.name, -1.0))


def first_failure(rules: list[Rule], parts: Parts) -> Column:
    """Name of the first rule that fails, null if none does. CASE evaluates no rule after it."""
    if not rules:
        return F.lit(None).cast("string")
    chain = F.when(F.coalesce(rules[0].fails(parts), F.lit(False)), F.lit(rules[0].name))
    for rule in rules[1:]:
        chain = chain.when(F.coalesce(rule.fails(parts), F.lit(False)), F.lit(rule.name))
    return chain


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_cascade(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, measures, base_failed, reject_reason, kept) of every document."""
    rules = production_rules() if rules is None else rules
    base = texts(docs)
    chain = ordered(rules, estimates(base, rules, sample_rows))

    split = base.withColumn("words", words_of(F.col("text"))).withColumn("lines", lines_of(F.col("text")))
    parts = Parts(F.col("text"), F.col("words"), F.col("lines"))
    measured = split.select("*", *[getattr(parts, m).alias(m) for m in MEASURES])
    for m in ("n_words", "word_chars", "n_symbols"):  # from here on they are columns too
        setattr(parts, m, F.col(m))
    failed = fails_base(F.col("n_words"), F.col("n_repeat_words"))
    reason = F.when(failed, F.lit("base")).otherwise(first_failure(chain, parts))
    return measured.select("doc_id", *MEASURES, failed.alias("base_failed"), reason.alias("reject_reason")).withColumn("kept", F.col("reject_reason").isNull())


def filter_quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of the input that pass the base and all rules, with the input's columns."""
    rules = [BASE, *production_rules()]
    chain = ordered(rules, estimates(texts(docs), rules, sample_rows))
    return docs.where(of_parts(F.coalesce("text", F.lit("")), lambda p: first_failure(chain, p)).isNull())


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLES = {
    "op5_rules": r"""
with d as (select doc_id, coalesce(text, '') text from documents),
w as (
  select doc_id, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines
  from d),
win as (
  select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] g
  from (select doc_id, words, unnest(range(1, len(words) - 1)) i from w where len(words) >= 3)),
rep as (select doc_id, i, count(*) over (partition by doc_id, g) n from win),
gap as (select doc_id, least(3, coalesce(lead(i) over (partition by doc_id order by i) - i, 3)) s from rep where n > 1),
r as (select doc_id, sum(s) n_repeat from gap group by doc_id),
m as (
  select w.doc_id, words, text, len(words) n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) n_symbols,
    len(lines) n_lines, len(lines) - len(list_distinct(lines)) n_dup_lines,
    coalesce(n_repeat, 0) n_repeat_words
  from w left join r using (doc_id)),
b as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) base_failed from m)
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols,
  cast(n_dup_lines as bigint) n_dup_lines, cast(n_repeat_words as bigint) n_repeat_words, base_failed,
  not (base_failed
    or 10 * n_symbols > 3 * n_words
    or 2 * n_dup_lines > n_lines
    or word_chars < 2 * n_words or word_chars > 20 * n_words
    or 2 * length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > length(regexp_replace(text, '[^\p{L}]', '', 'g'))
    or 5 * len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) < 4 * n_words
    or 10 * len(list_filter(words, lambda x: regexp_matches(x, '[#*$%&<>]{2}|!!'))) > n_words
    or 5 * len(list_filter(list_zip(words[:-2], words[2:]), lambda x: x[1] = x[2])) > n_words) kept
from b"""
}
