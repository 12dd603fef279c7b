"""Packing of documents into sequences of a fixed number of tokens (shortest pack first over the length histogram).

Documents become token ids; each is cut into whole sequences and one rest. The lengths of all pieces form a
histogram with as many bins as a sequence has tokens; the packing works on that histogram alone, so its cost
does not depend on the number of documents. Lengths are placed longest first, each into the open packs with
the most room (the shortest packs). The resulting patterns are joined back to pieces by their rank among the
pieces of the same length.

Null and empty texts are a single end id. Repeated rows are packed as often as they occur. An empty table
gives no rows. Further columns of the input are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regiolith.llm.common import checkpointed, map_rows, table, texts

SEQUENCE = 2048
END_ID = 1
#: Distinct chunks that a task keeps with their ids.
MEMO = 150_000
SPECIAL = "<|endoftext|>"


class _Unsafe(Exception):
    """The chunk cannot be encoded apart from its neighbours."""


class ChunkIds(dict):
    """Chunk of text -> its ids as little-endian 32-bit bytes.

    The pre-tokenizer never joins a character before a single space with what follows it, so text may be cut
    before each space that stands between two other characters. Chunks with white space at an end are refused."""

    def __init__(self, encode, lead: str):
        self.encode, self.lead = encode, lead

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Unsafe
        if len(self) >= MEMO:
            self.clear()
        made = np.asarray(self.encode(self.lead + chunk), dtype="<u4").tobytes()
        if len(chunk) <= 40:
            self[chunk] = made
        return made


def text_encoder(tokenizer_file: str, ranks_file: str | None):
    """A function of a text that returns its ids as bytes; equal to the tokenizer file's own encoding."""
    from tokenizers import Tokenizer

    @functools.cache
    def whole() -> Tokenizer:  # loaded where it is needed only
        return Tokenizer.from_file(tokenizer_file)

    if ranks_file:  # the same vocabulary as ranks, for a faster encoder
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        encode = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
    else:
        def encode(text: str) -> list[int]:
            return whole().encode(text, add_special_tokens=False).ids

    first, later = ChunkIds(encode, ""), ChunkIds(encode, " ")

    def ids(text: str) -> bytes:
        if not text:
            return b""
        if SPECIAL in text:  # an added token of the vocabulary: left to the tokenizer itself
            return np.asarray(whole().encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        head, *rest = text.split(" ")
        try:
            return first[head] + b"".join(map(later.__getitem__, rest))
        except _Unsafe:
            return np.asarray(encode(text), dtype="<u4").tobytes()

    return ids


def cut_pieces(
    docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None, sequence: int = SEQUENCE, with_ids: bool = False
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): whole sequences and the rest of every document."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

    def task():
        encode = text_encoder(tokenizer_file, ranks_file)
        end = np.asarray([END_ID], dtype="<u4").tobytes()

        def step(block):
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for doc_id, text in zip(block["doc_id"], block["text"]):
                data = encode(text) + end
                for at in range(0, len(data), 4 * sequence):
                    piece = data[at : at + 4 * sequence]
                    out["doc_id"].append(doc_id)
                    out["start"].append(at // 4)
                    out["length"].append(len(piece) // 4)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    out["doc_tokens"].append(len(data) // 4)
                    if with_ids:
                        out["ids"].append(np.frombuffer(piece, "<u4").tolist())
            return out

        return step

    return map_rows(texts(docs), task, schema + (", ids array<long>" if with_ids else ""))


def pack_histogram(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Shortest pack first: (lengths of a pattern, longest first; how many packs have it)."""
    open_packs: dict[int, list[list]] = {}  # room left -> [lengths, packs]
    rooms: list[int] = []
    full: list[tuple[tuple[int, ...], int]] = []

    def put(room: int, lengths: tuple[int, ...], packs: int) -> None:
        if room == 0:
            full.append((lengths, packs))
        else:
            open_packs.setdefault(room, []).append([lengths, packs])

    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        left = counts[length]
        while left:
            room = max((r for r, packs in open_packs.items() if packs), default=0)
            if room < length:  # not even the shortest pack has room: new packs, as full of this length as can be
                each = min(sequence // length, left)
                packs = left // each
                put(sequence - each * length, (length,) * each, packs)
                left -= packs * each
                continue
            entry = open_packs[room].pop()
            packs = min(entry[1], left)
            put(room - length, entry[0] + (length,), packs)
            if packs < entry[1]:
                open_packs[room].append([entry[0], entry[1] - packs])
            left -= packs
    return full + [(lengths, packs) for entries in open_packs.values() for lengths, packs in entries if packs]


def slot_rows(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, copies in a pack, first offset) of each length of each pattern."""
    rows, used, sequence = [], Counter(), 0
    for lengths, packs in sorted(patterns, reverse=True):
        at = 0
        for length, copies in sorted(Counter(lengths).items(), reverse=True):
            rows.append((length, used[length], used[length] + copies * packs, sequence, copies, at))
            used[length] += copies * packs
            at += copies * length
        sequence += packs
    return rows


def ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """Adds the rank of each piece among those of its length, from 0, without gaps.

    A length may hold most pieces, so ranks are counted within hashed parts of a length and shifted by the
    sizes of the parts before; the table of sizes has at most lengths x salts rows."""
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    sizes = salted.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    inner = Window.partitionBy("length", "part").orderBy("doc_id", "start")
    numbered = salted.withColumn("nth", F.row_number().over(inner) - 1)
    return (
        numbered.join(F.broadcast(shifts), ["length", "part"])
        .withColumn("rank", F.col("nth") + F.col("shift"))
        .drop("part", "nth", "shift")
    )


def pack(pieces: DataFrame, sequence: int = SEQUENCE, salts: int = 16) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ...)."""
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # <= sequence rows
    rows = slot_rows(pack_histogram(counts, sequence))
    slots = spark.createDataFrame(
        rows, "length long, from_rank long, to_rank long, first_sequence long, copies long, first_offset long"
    )
    slot = F.col("rank") - F.col("from_rank")
    return (
        ranked(pieces, salts)
        .join(F.broadcast(slots), "length")
        .where((F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
        .withColumn("sequence_id", F.col("first_sequence") + F.floor(slot / F.col("copies")))
        .withColumn("offset", F.col("first_offset") + F.pmod(slot, F.col("copies")) * F.col("length"))
        .drop("rank", "from_rank", "to_rank", "first_sequence", "copies", "first_offset")
    )


def pack_documents(
    docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None, sequence: int = SEQUENCE, with_ids: bool = False
) -> DataFrame:
    """Pieces of every document with their place in a sequence. The pieces are checkpointed: the histogram
    and the join both read them, and tokens are made once."""
    return pack(checkpointed(cut_pieces(docs, tokenizer_file, ranks_file, sequence, with_ids)), sequence)


def pack_with_public_tokenizer(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return pack_documents(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_with_public_tokenizer(table(spark, sf_dir, "documents"))
