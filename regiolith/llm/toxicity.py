"""Toxicity by noisy-channel deobfuscation.

A word that does not look plain (digits or signs among its letters, letters spaced out, long repeats) is read as
a lattice: each character may stand for itself, for the letters it resembles, for nothing, or for a repeat of
the letter before. Viterbi search under a character language model picks the likeliest plain word; in a run of
spaced-out letters, of any length, words may end at each gap, so one run gives several words. Weights of
words and of word beginnings, learned as log odds of document frequencies from labelled rows, are then summed
over the restored text, and the strongest ones are calibrated to a score.

A null or empty text has no words and gets the score of a text without hits. Without labels the score is the
constant 0.5. Labels are read only outside the held-out fold; text is the only input of a score. Repeated rows
give repeated results; an empty table gives no rows. ``drop_toxic`` keeps all columns of its input.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiolith.llm import fitting
from regiolith.llm.common import checkpointed, fold, is_held_out, labelled_texts, map_rows, stored, table, texts, training_rows

#: Features that the model keeps, the strongest first: the size of the model.
LEXICON = 20_000
THRESHOLD = 0.5
#: Toxic documents that must hold a feature, and how much likelier it must be in them.
MIN_DOCS, MIN_ODDS = 4, 8.0
PREFIXES = (4, 5, 6)
#: Words that a task remembers; workers of Python live through all stages of a job, so it is kept small.
MEMO = 40_000
STRONGEST = 3

# Characters and the letters they stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "×": "x",
}
SEPARATORS = frozenset(".-_*~'`^:;,/\\#%&")
EDGES = ".,;:!?\"'()[]{}<>«»“”‘’…-–—|*#$%&_~`"
#: Costs in nats: a look-alike, a dropped separator, a repeat of the letter before, a shorter context, an unknown letter.
COST_LOOK, COST_DROP, COST_REPEAT, COST_BACK_OFF, FLOOR = 1.0, 0.5, 0.7, 1.0, -12.0
#: Letters of a character n-gram, how often one must occur in the labelled rows, and once in how many letters at least, which
#: bounds the size of the model and not what is counted.
ORDER, MIN_COUNT, ONCE_IN = 4, 3, 5_000_000
#: Costs of a new word after one separator of a spaced-out run, and of none after two.
COST_BREAK, COST_JOIN = 1.0, 2.0
#: Characters of the words that the character model learns from.
LEARNT_MOST = 40

SPACED = re.compile(r"(?<!\S)(?:[^\W_](?:[ \t.\-_*]{1,2})){3,}[^\W_](?!\S)")
GAP = re.compile(r"[ \t.\-_*]+")
PLAIN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
THREE = re.compile(r"(.)\1\1")
REPEATS = re.compile(r"(.)\1{2,}", re.S)


def looks_plain(word: str) -> bool:
    return (word.isalpha() or PLAIN.fullmatch(word) is not None) and THREE.search(word) is None


class Restorer:
    """Viterbi search of the likeliest plain word behind an obfuscated one, under a backed-off character model."""

    def __init__(self, grams: dict[str, float]):
        self.grams = grams

    def step(self, context: str, letter: str) -> float:
        """Log probability of a letter after its context, with a cost for each letter of context given up."""
        lost = 0.0
        while True:
            known = self.grams.get(context + letter)
            if known is not None:
                return known - lost
            if not context:
                return FLOOR
            context, lost = context[1:], lost + COST_BACK_OFF

    def restore(self, word: str) -> str:
        """The likeliest plain word; a repeat of more than two adds the same cost to all readings."""
        return self.likeliest((0, c) for c in REPEATS.sub(r"\1\1", word))

    def restore_run(self, run: str) -> list[str]:
        """The likeliest plain words of a spaced-out run of any length."""
        gaps = [0, *(len(g) for g in GAP.findall(run))]
        return self.likeliest(zip(gaps, GAP.sub("", run))).split()

    def likeliest(self, characters: Iterable[tuple[int, str]]) -> str:
        """States are the last letters written and whether the last repeats; characters are read one by one, each
        after a gap of so many separators, at which a word may end. Texts are linked from their ends."""
        beams: dict[tuple[str, int], tuple[float, tuple | None]] = {("^", 0): (0.0, None)}
        for gap, c in characters:
            if gap:
                score, text = max(((s + self.step(context, "$"), t) for (context, _), (s, t) in beams.items()), key=lambda x: x[0])
                if gap > 1:
                    beams = {state: (s - COST_JOIN, t) for state, (s, t) in beams.items()}
                broken = (score - (COST_BREAK if gap == 1 else 0.0), (text, " "))
                if ("^", 0) not in beams or broken[0] > beams["^", 0][0]:
                    beams["^", 0] = broken
            fresh: dict[tuple[str, int], tuple[float, tuple | None]] = {}

            def offer(state, score, text, letter):
                if state not in fresh or score > fresh[state][0]:
                    fresh[state] = (score, (text, letter) if letter else text)

            letters = [(c, 0.0)] if c.isalpha() else []
            letters += [(x, COST_LOOK) for x in LOOKS_LIKE.get(c, "")]
            for (context, run), (score, text) in beams.items():
                for x, cost in letters:
                    if x == context[-1]:
                        offer((context, run), score - COST_REPEAT - cost, text, "")  # one letter, held longer
                    if x != context[-1] or run == 0:
                        state = ((context + x)[1 - ORDER :], int(x == context[-1]))
                        offer(state, score - cost + self.step(context, x), text, x)
                if c in SEPARATORS or not letters:
                    offer((context, run), score - COST_DROP, text, "")
            beams = fresh
        ends = [(s + self.step(context, "$"), t) for (context, _), (s, t) in beams.items()]
        best = max((s for s, _ in ends), default=0.0)
        return max((unlinked(t) for s, t in ends if s == best), default="")


def unlinked(text: tuple | None) -> str:
    letters = []
    while text is not None:
        text, letter = text
        letters.append(letter)
    return "".join(reversed(letters))


def cut(word: str) -> str:
    return word.strip(EDGES)


def restored_words(text: str, restorer: Restorer | None, memo: dict[str, tuple[str, ...]], each: Callable[[str], Iterable[str]] | None = None) -> set[str]:
    """The distinct plain words of a text, after restoring the others; plain words stay as they are.

    ``each`` gives what is wanted of a plain word instead of the word; the memo remembers that, so it goes with one ``each``."""
    lower = text.lower()
    out: set[str] = set()
    if restorer is not None:
        for m in SPACED.finditer(lower):
            joined = GAP.sub("", m[0])
            # all as one word; a single letter at an end may be a word of its own
            words = {*restorer.restore_run(m[0]), *(restorer.restore(x) for x in (joined, joined[1:], joined[:-1], joined[1:-1]))}
            out.update(words if each is None else (x for w in words for x in each(w)))
    for word in set(lower.split()):
        made = memo.get(word)
        if made is None:
            bare = cut(word)
            if not bare:
                made = ()
            elif looks_plain(bare):
                made = (bare,)
            elif restorer is None:
                made = ()
            else:  # signs at the ends may be letters too
                made = tuple({bare, restorer.restore(word.strip(".,;:?\"")), restorer.restore(bare)} - {""})
            if each is not None:
                made = tuple(x for w in made for x in each(w))
            if len(memo) >= MEMO:
                memo.clear()
            memo[word] = made
        if made:
            out.update(made)
    return out


def features_of(word: str) -> list[str]:
    return [word] + ["^" + word[:n] for n in PREFIXES if len(word) > n]


@dataclass
class Model:
    grams: dict[str, float]
    weights: dict[str, float]
    calibration: fitting.Calibration


class Scorer:
    """Weights of the strongest features of a text, for the calibration."""

    def __init__(self, grams: dict[str, float], weights: dict[str, float]):
        self.restorer, self.weights = Restorer(grams), weights
        self.strong = max(weights.values(), default=math.inf) / 2
        self.starts = {f[1 : 1 + PREFIXES[0]] for f in weights if f[0] == "^"}
        self.words: dict[str, tuple[str, ...]] = {}

    def weight(self, word: str) -> float:
        if word[: PREFIXES[0]] not in self.starts:
            return self.weights.get(word, 0.0)
        return max(self.weights.get(f, 0.0) for f in features_of(word))

    def hit(self, word: str) -> tuple[str, ...]:
        return (word,) if self.weight(word) else ()

    def features(self, text: str) -> list[float]:
        """Only words with a weight are remembered and listed; the others add nothing."""
        hits = sorted(map(self.weight, restored_words(text, self.restorer, self.words, self.hit)), reverse=True)
        top = hits[:STRONGEST] + [0.0] * (STRONGEST - len(hits[:STRONGEST]))
        return [*top, math.log1p(sum(hits)), float(top[0] >= self.strong)]


WIDTH = STRONGEST + 2


def gram_counts(words: dict[str, int]) -> dict[str, int]:
    """How often each run of 1 to ORDER characters occurs in the words, each between ^ and $, times the word's count.

    Runs of n characters are numbered by the number of the run of n - 1 before and the last character, so numbers stay small."""
    text = "".join(f"^{w}$" for w in words)
    if not text:
        return {}
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, letters = np.unique(points, return_inverse=True)
    times = np.repeat(np.fromiter(words.values(), np.int64), [len(w) + 2 for w in words])
    starts, runs, out = np.arange(len(points)), letters, {}
    for n in range(1, ORDER + 1):
        if n > 1:
            open_ = points[starts + n - 2] != ord("$")  # a run ends with its word, which has no other $
            starts = starts[open_]
            runs = runs[open_] * len(alphabet) + letters[starts + n - 1]
        _, first, runs = np.unique(runs, return_index=True, return_inverse=True)
        sums = np.zeros(len(first), np.int64)
        np.add.at(sums, runs, times[starts])
        out.update((text[i : i + n], v) for i, v in zip(starts[first].tolist(), sums.tolist()))
    return out


def character_model(rows: DataFrame) -> dict[str, float]:
    """Log probabilities of letters after up to ORDER - 1 others in the plain words of the rows; ^ and $ are ends.

    Counts are made in the tasks and summed by Spark over all rows. The model keeps n-grams that are not too rare, so it has
    at most ORDER * ONCE_IN of them however large the table is; what an n-gram begins with is as frequent and stays too."""

    def task():
        def step(block):
            words: Counter[str] = Counter()
            for text in block["text"]:
                words.update(set(map(cut, text.lower().split())))
            counts = gram_counts({w: n for w, n in words.items() if len(w) <= LEARNT_MOST and looks_plain(w)})
            return {"gram": list(counts), "n": list(counts.values())}

        return step

    counted = checkpointed(map_rows(rows, task, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    letters = counted.where(F.char_length("gram") == 1).agg(F.sum("n")).first()[0] or 1
    n = {r["gram"]: r["n"] for r in counted.where(F.col("n") >= max(MIN_COUNT, letters / ONCE_IN)).collect()}
    return {g: math.log(v / (n[g[:-1]] if len(g) > 1 else letters)) for g, v in n.items()}


def feature_weights(rows: DataFrame, grams: dict[str, float], sizes: dict[int, int]) -> dict[str, float]:
    """Log odds of document frequencies of restored words and word beginnings; the strongest LEXICON of them."""

    def task():
        restorer, memo = Restorer(grams), {}

        def step(block):
            counts: Counter[tuple[str, int]] = Counter()
            for text, y in zip(block["text"], block["y"]):
                counts.update((f, y) for f in restored_words(text, restorer, memo, features_of))
            return {"feature": [f for f, _ in counts], "y": [y for _, y in counts], "n": list(counts.values())}

        return step

    n1, n0 = max(sizes.get(1, 0), 1), max(sizes.get(0, 0), 1)
    counted = (
        map_rows(rows, task, "feature string, y int, n long")
        .groupBy("feature")
        .agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"))
        .where(F.col("toxic") >= MIN_DOCS)
        .withColumn("odds", (F.col("toxic") + 0.1) / n1 / ((F.col("clean") + 0.5) / n0))
        .where(F.col("odds") >= MIN_ODDS)
        .withColumn("weight", F.log("odds") * F.log1p("toxic"))
        .orderBy(F.desc("weight"), "feature")
        .limit(LEXICON)
    )
    return {r["feature"]: float(r["weight"]) for r in counted.select("feature", "weight").collect()}


def train(docs: DataFrame, labels: DataFrame, per_class: int | None = None) -> Model:
    """Three quarters of the labelled rows, by a hash of doc_id, give the weights; the rest calibrates.

    All labelled rows outside the held-out fold count; ``per_class`` takes only so many of each class, for trials."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id") != 0))
    share = usable.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) > 0
    rows = labelled_texts(docs, labels, "toxic") if per_class is None else training_rows(docs, labels, "toxic", per_class)
    rows = stored(rows.withColumn("learns", half), "toxicity")
    learns = rows.where("learns").drop("learns")
    grams = character_model(learns)
    sizes = {r["y"]: r["count"] for r in learns.groupBy("y").count().collect()}
    weights = feature_weights(learns, grams, sizes)

    def task():
        scorer = Scorer(grams, weights)

        def step(block):
            return {"y": block["y"], "x": [scorer.features(t) for t in block["text"]]}

        return step

    held = checkpointed(map_rows(rows.where("not learns").drop("learns"), task, "y int, x array<double>"))
    return Model(grams, weights, fitting.fit_table(held, WIDTH, 0.5 if share is None else share))


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def task():
        scorer = Scorer(model.grams, model.weights)

        def step(block):
            return {"doc_id": block["doc_id"], "score": [model.calibration(scorer.features(t)) for t in block["text"]]}

        return step

    scored = map_rows(texts(docs), task, "doc_id long, score double")
    return scored.select(
        "doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of the input that score under the threshold, with the input's columns."""

    def task():
        scorer = Scorer(model.grams, model.weights)

        def step(block):
            keep = [model.calibration(scorer.features(t or "")) < threshold for t in block["text"]]
            return {c: [v for v, k in zip(block[c], keep) if k] for c in block}

        return step

    return map_rows(docs, task, docs.schema.toDDL())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
