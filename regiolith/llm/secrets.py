"""Secrets in text: fixed patterns, and strings that a primed compressor finds new in a sensitive context.

Patterns give spans of the kinds assign, access and hex. The novelty scan then looks at long runs of code characters in
documents that have a word such as key, login or bearer anywhere. A zstandard dictionary is trained on identifiers and
paths: those of the corpus, and ones made of the plain words that the corpus has beside such words, so it has the words
and the frequencies of the characters of names. A candidate is novel if its surroundings do not have it, so that it adds
bytes to them, and if the dictionary finds no names in it: the bytes that it adds to texts of shuffled letters, which only
give the compressor the usual frequencies, cost more bits a character than names and paths do, also those of words that the
dictionary lacks. The bound between them is ``NOVEL_BITS``; a test on planted keys and names holds it to it. Strings in the form of a UUID are names and no secrets. What a pattern span covers is not reported
again. Words are counted over all documents; only plain words are learned, so that a secret in many copies stays new.

A null or empty text has no spans. Repeated rows and ties are independent rows. An empty table gives no rows.
Other columns of the input are kept by ``redact`` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiolith.llm.common import map_rows, table, texts

# The patterns that the result is defined by.
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "novel")

#: Words that make their surroundings sensitive.
SENSITIVE = re.compile(
    r"(?ai)password|passwd|secret|token|api.?key|credential|private.?key|access.?key|bearer|authorization|passphrase|passcode|signature|client.?id"
    r"|(?<![a-z0-9])(?:pwd|pin|auth|login|key)(?![a-z0-9])"
)
CANDIDATE_LENGTH = 16
CANDIDATE = re.compile(r"(?a)[A-Za-z0-9+/_=-]{%d,}" % CANDIDATE_LENGTH)
#: Characters on each side of a candidate that count as its surroundings, and the bits a character that it adds to them.
AROUND, ADDED_BITS = 1024, 3.0
#: Compressed bits a character that a candidate adds to texts of shuffled letters of so many characters. Of 300 each, random
#: keys of 16 to 40 characters reach it in 0.97 of the cases and more, camel-case, snake-case and path names of words that
#: were never learned in less than 0.03.
SHUFFLED, NOVEL_BITS = (600, 400, 500), 6.8
UUID = re.compile(r"(?ai)(?<![0-9a-z])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-z])")
#: What is learned: words in lower case or with a capital, and names whose parts are such words, in so many documents;
#: the most frequent ones of each kind, which bounds what reaches the driver, not what is measured.
LEARNED = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z]?[a-z]{3,14}(?![A-Za-z0-9+/=])")
PART = re.compile(r"[_/+=-]+|(?<=[a-z])(?=[A-Z])")
WORD_START = re.compile(r"[A-Z](?=[a-z]{2})")
PLAIN = re.compile(r"[A-Za-z]?[a-z]{2,14}")
LEARNED_DOCS, LEARNED_MOST = 3, 8_000
#: The dictionary's bytes, and names that are made of learned words to train it.
DICTIONARY, MADE_NAMES = 32_768, 4_000
#: Words of names for a corpus that has few.
SEED = (
    "username password secret token access private client authorization bearer signature session cookie header request response config settings environment "
    "variable default example sample placeholder local library python packages index connection user import from return function class static public void "
    "string integer value create element listener attribute application content type server database table column account service manager handler provider "
    "factory message event process thread network address payment order customer product invoice report window button controller"
).split()


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of the base kinds, in order of start, then kind."""
    found = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def learned_names(docs: DataFrame) -> bytes:
    """A dictionary trained on names: plain words and names of the documents that have a sensitive word, at most LEARNED_MOST of them."""

    def task():
        def step(block):
            counts: Counter[str] = Counter()
            for text in block["text"]:
                if SENSITIVE.search(text):
                    found = set(LEARNED.findall(text))
                    for m in CANDIDATE.finditer(text):
                        if len(m[0]) <= 80 and all(map(PLAIN.fullmatch, filter(None, PART.split(m[0])))):
                            found.add(m[0])
                    counts.update(found)
            return {"word": list(counts), "n": list(counts.values())}

        return step

    counted = map_rows(texts(docs), task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEARNED_DOCS)
    return trained_dictionary([r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(LEARNED_MOST).collect()])


def trained_dictionary(learned: list[str]) -> bytes:
    """Names of the corpus and ones made of its words: camel case, snake case, paths and class names."""
    r = random.Random(1)
    words = [w for w in learned if len(w) <= 15] + SEED
    samples = [w for w in learned if len(w) > 15]
    for k in range(MADE_NAMES):
        parts = [r.choice(words).lower() for _ in range(r.randrange(2, 5))]
        capital = [w.capitalize() for w in parts]
        samples.append((parts[0] + "".join(capital[1:]), "_".join(parts), "/".join(parts), "".join(capital))[k % 4])
    return zstandard.train_dictionary(DICTIONARY, [s.encode() for s in samples], level=9).as_bytes()


class Novelty:
    """Compressed bits that a string adds to its surroundings."""

    def __init__(self, names: bytes, level: int = 9):
        self.compressor = zstandard.ZstdCompressor(
            level=level, dict_data=zstandard.ZstdCompressionDict(names), write_content_size=False, write_checksum=False, write_dict_id=False
        )
        letters, r, at = list(" ".join(SEED * 3)), random.Random(7), 0
        r.shuffle(letters)
        self.shuffled = []
        for n in SHUFFLED:
            part = "".join(letters[at : at + n]).encode()
            self.shuffled.append((part, len(self.compressor.compress(part))))
            at += n

    def bits(self, value: str) -> float:
        """The mean over the shuffled texts, as one of them only tells whole bytes."""
        data = WORD_START.sub(lambda m: m[0].lower(), value).encode()  # a capital at a word's start tells nothing
        more = sum(len(self.compressor.compress(p + data)) - n for p, n in self.shuffled)
        return 8.0 * more / len(self.shuffled) / len(data)

    def added(self, text: str, start: int, end: int) -> float:
        """What a string adds to its surroundings; little if they have it too."""
        around = (text[end : end + AROUND] + text[max(0, start - AROUND) : start]).encode("utf-8", "surrogatepass")
        return 8.0 * (len(self.compressor.compress(around + text[start:end].encode())) - len(self.compressor.compress(around))) / (end - start)

    def is_novel(self, text: str, start: int, end: int) -> bool:
        return self.bits(text[start:end]) >= NOVEL_BITS and self.added(text, start, end) >= ADDED_BITS

    def spans(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Novel runs of a text with a sensitive word, each whole but for what the taken spans cover."""
        if not SENSITIVE.search(text):
            return []
        found, at = [], 0
        covered: list[list[int]] = []
        for a, b in sorted([(a, b) for a, _, b in taken] + [m.span() for m in UUID.finditer(text)]):
            if covered and a <= covered[-1][1]:
                covered[-1][1] = max(covered[-1][1], b)
            else:
                covered.append([a, b])
        for run in CANDIDATE.finditer(text):
            start, end = run.span()
            while at < len(covered) and covered[at][1] <= start:
                at += 1
            k, pieces = at, []
            while k < len(covered) and covered[k][0] < end:
                pieces.append((start, covered[k][0]))
                start, k = covered[k][1], k + 1
            for a, b in [*pieces, (start, end)]:
                if b - a < CANDIDATE_LENGTH:
                    continue
                value = text[a:b]
                kinds = bool(re.search("[a-z]", value)) + bool(re.search("[A-Z]", value)) + bool(re.search("[0-9]", value))
                if kinds >= 2 and self.is_novel(text, a, b):
                    found.append((a, 3, b))
        return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row for each document: counts by pattern, a digest of the pattern spans, and all spans as text."""
    names = learned_names(docs)

    def task():
        novelty = Novelty(names)

        def step(block):
            out = {"doc_id": block["doc_id"], "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
            for text in block["text"]:
                base = pattern_spans(text)
                for name, kind in (("n_assign", 0), ("n_access", 1), ("n_hex", 2)):
                    out[name].append(sum(k == kind for _, k, _ in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(sorted(base + novelty.spans(text, base))))
            return out

        return step

    return map_rows(texts(docs), task, SPANS)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span, or run of overlapping spans, replaced by the kind of the first."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of the input with the secrets in text masked; n_chars follows where there is one."""
    names = learned_names(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"))

    def task():
        novelty = Novelty(names)

        def masked(text: str | None) -> str | None:
            if not text:
                return text
            base = pattern_spans(text)
            return redacted(text, sorted(base + novelty.spans(text, base)))

        def step(block):
            return block | {"text": [masked(t) for t in block["text"]]}

        return step

    out = map_rows(docs, task, docs.schema.toDDL())
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(docs.columns)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
