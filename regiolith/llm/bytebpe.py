"""Byte-level BPE by a rank file: the tokenizers library encodes, over Arrow batches; decoding reverses the byte table.

Every byte stands for one character (a printable byte for itself, the others for characters from 256 on), so the
vocabulary of a rank file becomes one of strings. Its merges follow from the ranks: a token's parts are those that the
tokens of lower rank leave of it. Ids are those of the tiktoken library: the parts of a token that merges reach in a
piece are the same as in the token alone, and a piece that is a token is one (``ignore_merges``).

A text is split by the pattern into pieces, distinct short pieces of a task are encoded once. Tokens are given with
offsets in characters; a character whose bytes lie in several tokens belongs to all of them. The libraries' Unicode
versions differ: characters that the splitter takes for letters or numbers and tiktoken does not are found by asking
tiktoken about every character, and split as what it takes them for.

A null or empty text has no tokens. Repeated rows give repeated rows, a null doc_id stays null, an empty table gives no
rows, further columns are ignored. A long text is worked through by blocks of pieces, so only its ids need memory, and
the query keeps none of them. Decoding skips ids outside the vocabulary and null ids, and counts them.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from regiolith.llm.common import map_rows, table, texts

#: Pieces that are worked on at once; texts of up to as many characters are split in one go.
BLOCK = 1 << 16
#: Distinct pieces that a task keeps with their ids, and their length in characters.
MEMO, MEMO_CHARS = 400_000, 40


def byte_characters() -> list[str]:
    """The character of each byte."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(ranks_file: str) -> dict[bytes, int]:
    with open(ranks_file, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def parts_below(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What the tokens of lower rank leave of a token."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 1:
        found = [ranks.get(a + b, limit) for a, b in zip(parts, parts[1:])]
        least = min(found)
        if least >= limit:
            break
        at = found.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@functools.cache
def vocabulary_json(ranks_file: str) -> str:
    """The rank file as a tokenizer of the tokenizers library; made once by the driver and sent to the tasks."""
    from tokenizers import Tokenizer, models

    ranks, chars = read_ranks(ranks_file), byte_characters()
    name = lambda token: "".join(map(chars.__getitem__, token))
    merges = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__):
        parts = parts_below(token, ranks)
        if len(parts) == 2:  # others are found as whole pieces only
            merges.append((name(parts[0]), name(parts[1])))
    model = models.BPE(vocab={name(t): i for t, i in ranks.items()}, merges=merges, ignore_merges=True)
    return Tokenizer(model).to_str()


@functools.cache
def disputed_characters() -> str:
    """A class of the characters that the splitter takes for letters or numbers and tiktoken for neither; empty if none.

    Asked of tiktoken with a vocabulary of single bytes: what a pattern does not match is left out of the ids."""
    import regex
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    every = "".join(chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000)
    theirs = tiktoken.Encoding("class", pat_str=r"[\p{L}\p{N}]", mergeable_ranks=single, special_tokens={})
    known = set()
    for at in range(0, len(every), 1 << 14):
        known.update(bytes(theirs.encode_ordinary(every[at : at + (1 << 14)])).decode("utf-8"))
    codes = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if c not in known]
    edges = [i for i in range(len(codes)) if i == 0 or codes[i] != codes[i - 1] + 1] + [len(codes)]
    return "".join(f"{chr(codes[a])}-{chr(codes[b - 1])}" for a, b in zip(edges, edges[1:]))


class Splitter:
    """Blocks of the pieces of a text, by the public pattern."""

    def __init__(self, disputed: str):
        import public_tokenizers
        import regex

        self.full = regex.compile(public_tokenizers.PATTERN)
        narrow = public_tokenizers.PATTERN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
        # of ASCII the classes are known, and the standard library is faster
        self.ascii = re.compile(re.sub(r" \?(A-Za-z|0-9)\+", r" ?[\1]+", narrow), re.ASCII)
        self.disputed = re.compile(f"[{disputed}]") if disputed else None

    def __call__(self, text: str) -> Iterator[list[str]]:
        if text.isascii():
            return self.cut(self.ascii, text)
        if self.disputed and self.disputed.search(text):
            return self.same_lengths(text, self.disputed.sub("#", text))
        return self.cut(self.full, text)

    def cut(self, pattern, text: str) -> Iterator[list[str]]:
        if len(text) <= BLOCK:
            yield pattern.findall(text)
        else:
            found = (m[0] for m in pattern.finditer(text))
            while block := list(islice(found, BLOCK)):
                yield block

    def same_lengths(self, text: str, shadow: str) -> Iterator[list[str]]:
        at = 0
        for block in self.cut(self.full, shadow):
            ends = np.cumsum([at, *map(len, block)]).tolist()
            yield [text[a:b] for a, b in zip(ends, ends[1:])]
            at = ends[-1]


class PieceIds(dict):
    """Piece -> its ids as little-endian 32-bit bytes, made by the model of the tokenizers library."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model = self.tokenizer.model
        self.table = {b: c for b, c in enumerate(byte_characters())}

    def __missing__(self, piece: str) -> bytes:
        shown = piece.encode("utf-8").decode("latin-1").translate(self.table)
        made = np.fromiter((t.id for t in self.model.tokenize(shown)), dtype="<u4").tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = made
        return made


class ByteTable:
    """Id -> bytes, from the vocabulary's strings by the reversed table of bytes."""

    def __init__(self, tokenizer):
        back = {c: b for b, c in enumerate(byte_characters())}
        vocab = tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            self.bytes[i] = bytes(map(back.__getitem__, name))
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def data(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def split_characters(data: bytes) -> tuple[bytes, str, bytes]:
    """(bytes at the start that belong to a character before, the text between, bytes at the end whose character goes on).

    What is no character anywhere else becomes U+FFFD."""
    head = 0
    while head < min(3, len(data)) and data[head] & 0xC0 == 0x80:
        head += 1
    tail = len(data)
    for back in range(1, min(4, len(data) - head) + 1):
        byte = data[-back]
        if byte & 0xC0 == 0xC0:
            needs = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
            tail = len(data) - back if needs > back else tail
            break
        if byte < 0x80:
            break
    return data[:head], data[head:tail].decode("utf-8", "replace"), data[tail:]


def character_spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) in characters of tokens of so many bytes; a character split between tokens is part of each."""
    ends = np.cumsum(lengths)
    if text.isascii():
        return ends - lengths, ends
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    before = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # characters that began before a byte
    starts = ends - lengths
    inside = (data[np.minimum(starts, len(data) - 1)] & 0xC0) == 0x80
    return before[starts] - inside, before[ends]


def encode(docs: DataFrame, ranks_file: str) -> DataFrame:
    """(doc_id, ids array<int>, starts array<long>, ends array<long>): tokens of each text with offsets in characters."""
    vocabulary, disputed = vocabulary_json(ranks_file), disputed_characters()

    def task():
        split, memo = Splitter(disputed), PieceIds(vocabulary)
        table = ByteTable(memo.tokenizer)

        def step(block):
            out = {"doc_id": block["doc_id"], "ids": [], "starts": [], "ends": []}
            for text in block["text"]:
                ids = np.frombuffer(b"".join(b"".join(map(memo.__getitem__, p)) for p in split(text)), "<u4").astype(np.int32)
                starts, ends = character_spans(text, table.lengths[ids])
                for name, values in (("ids", ids), ("starts", starts), ("ends", ends)):
                    out[name].append(values)
            return out

        return step

    return map_rows(texts(docs), task, "doc_id long, ids array<int>, starts array<long>, ends array<long>", rows=64)


def decode(tokens: DataFrame, ranks_file: str) -> DataFrame:
    """(doc_id, data binary, head binary, text, tail binary, unknown long) of rows (doc_id, ids).

    ids may be cut anywhere: ``head`` and ``tail`` are the bytes of characters that the cuts have split, so the tail of a
    row and the head of the next one make the character between."""
    vocabulary = vocabulary_json(ranks_file)

    def task():
        from tokenizers import Tokenizer

        table = ByteTable(Tokenizer.from_str(vocabulary))

        def step(block):
            out = {k: [] for k in ("data", "head", "text", "tail", "unknown")} | {"doc_id": block["doc_id"]}
            for ids in block["ids"]:
                known = [i for i in ids or [] if i is not None and 0 <= i < len(table.bytes) and table.bytes[i]]
                data = table.data(known)
                for name, value in zip(("head", "text", "tail"), split_characters(data)):
                    out[name].append(value)
                out["data"].append(data)
                out["unknown"].append(len(ids or []) - len(known))
            return out

        return step

    return map_rows(tokens.select("doc_id", "ids"), task, "doc_id long, data binary, head binary, text string, tail binary, unknown long", rows=64)


def round_trip(docs: DataFrame, ranks_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of what they decode to, block by block."""
    vocabulary, disputed = vocabulary_json(ranks_file), disputed_characters()

    def task():
        split, memo = Splitter(disputed), PieceIds(vocabulary)
        table = ByteTable(memo.tokenizer)
        decimal = [str(i) for i in range(len(table.bytes))]

        def step(block):
            out = {"doc_id": block["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in block["text"]:
                n, shown, data = 0, hashlib.sha256(), hashlib.sha256()
                for pieces in split(text):
                    ids = np.frombuffer(b"".join(map(memo.__getitem__, pieces)), "<u4").tolist()
                    if ids:
                        shown.update(((" " if n else "") + " ".join(map(decimal.__getitem__, ids))).encode())
                        data.update(table.data(ids))
                        n += len(ids)
                out["n_tokens"].append(n)
                out["ids_sha256"].append(shown.hexdigest())
                out["decoded_sha256"].append(data.hexdigest())
            return out

        return step

    return map_rows(texts(docs), task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
