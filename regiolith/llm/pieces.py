"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

A text of more than CHUNK characters is cut into chunks at fixed places. The pieces that end at or cross a cut
are the states of that boundary, known from the text around it. Each chunk yields a transfer matrix: the best
weight of a chain of pieces from every entry state to every exit state. Matrices combine associatively under
(max, +), in a tree: products of FAN neighbours each, level by level, until a document has one; then the levels are
walked down again, where each product's entry and exit state fix those of its parts. So no task gets more than FAN
matrices of a document, however long it is. Every chunk is then traced back on its own.

Weights. For a unigram model the weight of a piece is its score. A BPE model is a path problem too: a chain of
pieces is the encoding of its text exactly if every two neighbours are the encoding of theirs, so the weight of
a piece after another is 0 if that holds and minus infinity if not; one chain is left, the one that merging
gives. No piece reaches over the start of a word, so a chunk that holds a word start has a matrix of rank one
and is stored as two vectors.

Texts of one chunk are encoded word by word with the library. A null or empty text has no ids. Decoding gives
the text back (a character U+2581 in it comes back as a space, as in the library). Repeated rows give repeated
results, and so do rows that share a doc_id or have none; an empty table gives no rows; other columns of the input
are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiolith.llm.common import checkpointed, map_rows, table, texts

SPACE = "▁"
CHUNK = 16_384
#: Matrices that one task combines.
FAN = 64
MEMO = 300_000
UNKNOWN_PENALTY = 10.0
NONE = float("-inf")


class Vocabulary:
    """Pieces, ids and scores of a model file, and the weights of pieces after one another."""

    def __init__(self, model_file: str, kind: str = "bpe"):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.kind = kind
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes = [0] * 256
        self.written: list[bytes] = []
        for i in range(self.library.vocab_size()):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes[value] = i
                self.written.append(bytes([value]))
            elif self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i):
                self.written.append(b"")
            else:
                self.ids[piece] = i
                self.scores[piece] = self.library.get_score(i)
                self.written.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        self.pairs: dict[tuple[str, str], float] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces by merging, best score first, leftmost among equals; for short texts."""
        symbols = list(text)
        while True:
            best, at = NONE, -1
            for i in range(len(symbols) - 1):
                score = self.scores.get(symbols[i] + symbols[i + 1], NONE)
                if score > best:
                    best, at = score, i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def weight(self, before: str | None, piece: str) -> float:
        if self.kind == "unigram":
            return self.scores.get(piece, self.unknown)
        if before is None or (piece[0] == SPACE and before[-1] != SPACE):
            return 0.0 if len(piece) == 1 or self.alone(piece) else NONE
        found = self.pairs.get((before, piece))
        if found is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            found = self.pairs[before, piece] = 0.0 if self.merged(before + piece) == [before, piece] else NONE
        return found

    def alone(self, piece: str) -> bool:
        found = self.pairs.get(("", piece))
        if found is None:
            found = self.pairs["", piece] = 0.0 if self.merged(piece) == [piece] else NONE
        return found == 0.0

    def starting(self, text: str, at: int) -> list[str]:
        """The pieces at a place; a character alone is always one."""
        out = [text[at]]
        out += [p for n in range(2, min(self.longest, len(text) - at) + 1) if (p := text[at : at + n]) in self.ids]
        return out

    def ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.written.__getitem__, ids.tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def normalised(text: str) -> str:
    return (" " + text).replace(" ", SPACE) if text else ""


def is_word_start(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] == SPACE and text[at - 1] != SPACE


class WordIds(dict):
    """Word with its leading spaces but one -> ids as little-endian 32-bit bytes; the library adds that space."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.encode = vocabulary.library.encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        if self.vocabulary.kind == "bpe":
            ids = self.encode(word) if word else [self.vocabulary.ids[SPACE]]
        else:
            ids = self.vocabulary.ids_of(trace(self.vocabulary, SPACE + word.replace(" ", SPACE), None, 0, None))
        made = np.asarray(ids, "<u4").tobytes()
        if len(word) <= 40:
            self[word] = made
        return made

    def of_text(self, text: str) -> bytes:
        """Ids of words that begin with a space each; the first space is implied."""
        parts = text.split(" ")
        if "" not in parts:
            return b"".join(map(self.__getitem__, parts))
        out, spaces = [], 0
        for part in parts[:-1]:
            if part:
                out.append(self[" " * spaces + part])
                spaces = 0
            else:
                spaces += 1
        out.append(self[" " * spaces + parts[-1]])
        return b"".join(out)


def boundary_states(v: Vocabulary, text: str, edge: int) -> list[tuple[str, int]]:
    """(piece, start) of every piece that ends at the edge or crosses it, in a fixed order."""
    found = []
    for start in range(max(0, edge - v.longest), edge):
        for piece in v.starting(text, start):
            if start + len(piece) >= edge and not any(is_word_start(text, start + k) for k in range(1, len(piece))):
                found.append((piece, start))
    return found


def forward(v: Vocabulary, text: str, begin: dict[tuple[int, str | None], np.ndarray], end: int) -> dict[tuple[int, str | None], np.ndarray]:
    """Best weights from the entries to every (end place, piece) at or beyond ``end``.

    ``begin`` has vectors over the entries, by the place where the first piece starts and the piece before it."""
    waiting: dict[int, dict[str | None, np.ndarray]] = {}
    out: dict[tuple[int, str | None], np.ndarray] = {}
    for (place, piece), values in begin.items():
        target = out if place >= end else waiting.setdefault(place, {})
        key = (place, piece) if place >= end else piece
        target[key] = np.maximum(target[key], values) if key in target else values
    place = min(waiting, default=end)
    while waiting and place < end:
        states = waiting.pop(place, None)
        if states:
            for piece in v.starting(text, place):
                stop = place + len(piece)
                for before, values in states.items():
                    w = v.weight(before, piece)
                    if w == NONE:
                        continue
                    reached = values + w
                    target = out if stop >= end else waiting.setdefault(stop, {})
                    key = (stop, piece) if stop >= end else piece
                    target[key] = np.maximum(target[key], reached) if key in target else reached
        place += 1
    return out


def trace(v: Vocabulary, text: str, before: str | None, start: int, last: tuple[str, int] | None) -> list[str]:
    """The best chain of pieces from ``start`` to the end of the text, or to the piece ``last`` (piece, start), included."""
    end = len(text) if last is None else last[1]
    best: dict[tuple[int, str | None], tuple[float, tuple[int, str | None] | None]] = {(start, before): (0.0, None)}
    at: dict[int, list[str | None]] = {start: [before]}
    for place in range(start, end):
        for piece in v.starting(text[:end] if last is None else text, place) if place in at else ():
            stop = place + len(piece)
            if stop > end:
                continue
            for b in at[place]:
                w = best[place, b][0] + v.weight(b, piece)
                if w == NONE:
                    continue
                if (stop, piece) not in best:
                    at.setdefault(stop, []).append(piece)
                if (stop, piece) not in best or w > best[stop, piece][0]:
                    best[stop, piece] = (w, (place, b))
    finals = [(best[end, b][0] + (v.weight(b, last[0]) if last else 0.0), (end, b)) for b in at.get(end, [])]
    score, node = max(finals, key=lambda x: x[0], default=(NONE, None))
    if score == NONE:
        raise ValueError("no chain of pieces")
    out = [last[0]] if last else []
    while node != (start, before):
        out.append(node[1])
        node = best[node][1]
    return out[::-1]


class Chunk:
    """A chunk of a document with the characters around it that its boundary states need."""

    def __init__(self, v: Vocabulary, text: str, first: int, size: int, total: int):
        """``text`` starts at character ``first - around`` of the document, see cut_chunks."""
        self.v, self.text = v, text
        around = min(v.longest, first)
        self.begin, self.end = around, around + size
        self.is_first, self.is_last = first == 0, first + size >= total
        self.entries = [(None, self.begin)] if self.is_first else boundary_states(v, text, self.begin)
        self.exits = [(None, self.end)] if self.is_last else boundary_states(v, text, self.end)
        starts = [i for i in (self.first_start(), self.last_start()) if i is not None]
        self.left, self.right = starts if len(starts) == 2 else (None, None)

    def first_start(self) -> int | None:
        if self.is_first and self.text:
            return self.begin
        i = self.begin
        while 0 <= (i := self.text.find(SPACE, i)) < self.end:
            if is_word_start(self.text, i):
                return i
            i += 1
        return None

    def last_start(self) -> int | None:
        i = self.end
        while (i := self.text.rfind(SPACE, self.begin, i)) >= 0:
            if i == 0 or is_word_start(self.text, i):
                return i
        return self.begin if self.is_first else None

    def entry_place(self, entry: tuple[str | None, int]) -> int:
        return self.begin if entry[0] is None else entry[1] + len(entry[0])

    def into_exits(self, reached: dict[tuple[int, str | None], np.ndarray], width: int) -> np.ndarray:
        columns = []
        for piece, start in self.exits:
            if piece is None:
                values = [x for (stop, _), x in reached.items() if stop == self.end]
            else:
                values = [x for (stop, p), x in reached.items() if p == piece and stop == start + len(piece)]
            columns.append(np.max(values, axis=0) if values else np.full(width, NONE))
        return np.array(columns).T.reshape(width, len(self.exits))

    def matrix(self) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray | None]:
        """(entries to the first word start, last word start to the exits, None), or (None, None, whole matrix)."""
        width = len(self.entries)
        stop = self.end if self.left is None else self.left
        begin: dict[tuple[int, str | None], np.ndarray] = {}
        for i, entry in enumerate(self.entries):
            key = (self.entry_place(entry), entry[0])
            values = np.full(width, NONE)
            values[i] = 0.0
            begin[key] = np.maximum(begin[key], values) if key in begin else values
        if self.left is None:
            return None, None, self.into_exits(forward(self.v, self.text, begin, stop), width)
        reached = [x for (place, _), x in forward(self.v, self.text, begin, stop).items() if place == stop]
        into = np.max(reached, axis=0) if reached else np.full(width, NONE)
        out = self.into_exits(forward(self.v, self.text, {(self.right, None): np.zeros(1)}, self.end), 1)[0]
        return into, out, None

    def ids(self, entry: int, exit: int, words: WordIds) -> bytes:
        """Ids of the pieces that start in this chunk, on the chain between the two states."""
        (before, start), last = self.entries[entry], self.exits[exit]
        start = self.entry_place((before, start))
        goal = None if last[0] is None else last
        end = self.end if goal is None else goal[1]
        as_bytes = lambda pieces: np.asarray(self.v.ids_of(pieces), "<u4").tobytes()
        text = self.text[: self.end] if goal is None else self.text
        if self.left is None:
            return as_bytes(trace(self.v, text, before, start, goal)) if start <= end else b""
        head = as_bytes(trace(self.v, self.text[: self.left], before, start, None)) if start < self.left else b""
        middle = self.text[self.left : self.right]
        body = words.of_text(middle[1:].replace(SPACE, " ")) if middle else b""
        return head + body + as_bytes(trace(self.v, text, None, self.right, goal))


Transfer = tuple[np.ndarray | None, np.ndarray | None, np.ndarray | None]


def product(a: Transfer, b: Transfer) -> Transfer:
    """The (max, +) product of two transfer matrices; each is a sum of two vectors or a whole matrix."""
    if a[2] is None and b[2] is None:
        return a[0], np.max(a[1] + b[0]) + b[1], None
    if a[2] is None:
        return a[0], np.max(a[1][:, None] + b[2], axis=0), None
    if b[2] is None:
        return np.max(a[2] + b[0][None, :], axis=1), b[1], None
    return None, None, np.max(a[2][:, :, None] + b[2][None, :, :], axis=1)


def scan(chunks: list[Transfer], entry: int = 0, leave: int = 0) -> list[tuple[int, int]]:
    """(entry, exit) of every chunk on the best chain from one state to another, from the (max, +) products before and
    after each boundary."""
    sizes = lambda m, side: len(m[side]) if m[2] is None else m[2].shape[side]
    only = lambda n, i: np.where(np.arange(n) == i, 0.0, NONE)
    before = [only(sizes(chunks[0], 0), entry)]
    for into, out, whole in chunks:
        row = before[-1]
        before.append(np.max(row + into) + out if whole is None else np.max(row[:, None] + whole, axis=0))
    after = [only(sizes(chunks[-1], 1), leave)]
    for into, out, whole in reversed(chunks):
        column = after[-1]
        after.append(into + np.max(out + column) if whole is None else np.max(whole + column[None, :], axis=1))
    after.reverse()
    states = [int(np.argmax(b + a)) for b, a in zip(before, after)]
    return list(zip(states, states[1:]))


def cut_chunks(text: str, longest: int, chunk: int) -> list[tuple[int, str, int, int]]:
    """(number, text with up to ``longest`` characters on either side, first, size) of each chunk of a normalised text."""
    return [
        (k, text[max(0, at - longest) : at + chunk + longest], at, min(chunk, len(text) - at))
        for k, at in enumerate(range(0, len(text), chunk))
    ]


def chunk_rows(giants: DataFrame, model_file: str, kind: str, chunk: int) -> DataFrame:
    """(row_id, k, text, first, size, total): the chunks of giant documents."""

    def task():
        longest = Vocabulary(model_file, kind).longest

        def step(block):
            names = ("row_id", "k", "text", "first", "size", "total")
            out = {n: [] for n in names}
            for row_id, text in zip(block["row_id"], map(normalised, block["text"])):
                for row in cut_chunks(text, longest, chunk):
                    for n, value in zip(names, (row_id, *row, len(text))):
                        out[n].append(value)
            return out

        return step

    return map_rows(giants, task, "row_id long, k long, text string, first long, size long, total long", rows=16)


def transfers(chunks: DataFrame, model_file: str, kind: str) -> DataFrame:
    def task():
        v = Vocabulary(model_file, kind)

        def step(block):
            out = {"row_id": block["row_id"], "k": block["k"], "into": [], "out": [], "whole": [], "entries": []}
            for text, first, size, total in zip(block["text"], block["first"], block["size"], block["total"]):
                c = Chunk(v, text, first, size, total)
                into, leave, whole = c.matrix()
                out["entries"].append(len(c.entries))
                for name, m in (("into", into), ("out", leave), ("whole", whole)):
                    out[name].append(None if m is None else m.astype("<f8").tobytes())
            return out

        return step

    return map_rows(chunks, task, "row_id long, k long, into binary, out binary, whole binary, entries long", rows=64)


def transfers_of(group: pd.DataFrame) -> list[Transfer]:
    as_array = lambda data: None if data is None else np.frombuffer(data, "<f8")
    return [
        (as_array(i), as_array(o), None if w is None else as_array(w).reshape(n, -1))
        for i, o, w, n in zip(group["into"], group["out"], group["whole"], group["entries"])
    ]


def combined(group: pd.DataFrame) -> pd.DataFrame:
    """The product of the matrices of one block, FAN at most."""
    group = group.sort_values("k")
    into, out, whole = functools.reduce(product, transfers_of(group))
    as_bytes = lambda m: None if m is None else m.astype("<f8").tobytes()
    first = group.iloc[0]
    return pd.DataFrame({"row_id": [first["row_id"]], "k": [first["block"]], "into": [as_bytes(into)], "out": [as_bytes(out)], "whole": [as_bytes(whole)], "entries": [len(into) if whole is None else len(whole)]})


def scanned(group: pd.DataFrame) -> pd.DataFrame:
    """The states of the matrices of one block, whose own states are known."""
    group = group.sort_values("k")
    found = scan(transfers_of(group), int(group["block_entry"].iloc[0]), int(group["block_leave"].iloc[0]))
    return pd.DataFrame({"row_id": group["row_id"], "k": group["k"], "entry": [a for a, _ in found], "leave": [b for _, b in found]})


def chunk_states(matrices: DataFrame, chunks: int, fan: int = FAN) -> DataFrame:
    """(row_id, k, entry, leave) of every chunk. ``chunks``: the most that a document has, which gives the levels."""
    tasks = int(matrices.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the rows are small, the work is not: one number of tasks

    def in_blocks(df: DataFrame):
        return df.repartition(tasks, "row_id", "block").groupBy("row_id", "block")

    levels = [matrices.withColumn("block", F.floor(F.col("k") / fan))]
    while chunks > fan:
        chunks = -(-chunks // fan)
        parts = levels[-1] = checkpointed(levels[-1])
        above = in_blocks(parts).applyInPandas(combined, "row_id long, k long, into binary, out binary, whole binary, entries long")
        levels.append(above.withColumn("block", F.floor(F.col("k") / fan)))
    states = None  # a document has one block at the top, with one way in and one way out
    for level in reversed(levels):
        if states is None:
            held = level.withColumn("block_entry", F.lit(0)).withColumn("block_leave", F.lit(0))
        else:
            held = level.join(states.withColumnsRenamed({"k": "block", "entry": "block_entry", "leave": "block_leave"}), ["row_id", "block"])
        states = in_blocks(held).applyInPandas(scanned, "row_id long, k long, entry long, leave long")
    return states


def encode(docs: DataFrame, model_file: str, kind: str = "bpe", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(doc_id, ids): ids of every document as little-endian 32-bit bytes."""
    base = texts(docs)
    is_giant = F.length("text") + 1 > chunk

    def short():
        words = WordIds(Vocabulary(model_file, kind))

        def step(block):
            return {"doc_id": block["doc_id"], "ids": [words.of_text(t.replace(SPACE, " ")) if t else b"" for t in block["text"]]}

        return step

    def traced():
        v = Vocabulary(model_file, kind)
        words = WordIds(v)

        def step(block):
            out = {"row_id": block["row_id"], "k": block["k"], "ids": []}
            for text, first, size, total, entry, leave in zip(*(block[n] for n in ("text", "first", "size", "total", "entry", "leave"))):
                out["ids"].append(Chunk(v, text, first, size, total).ids(entry, leave, words))
            return out

        return step

    one = map_rows(base.where(~is_giant), short, "doc_id long, ids binary")
    # Rows are told apart by a number of their own, fixed by a checkpoint: ids may be null or repeated.
    giants = checkpointed(base.where(is_giant).withColumn("row_id", F.monotonically_increasing_id()))
    cut = chunk_rows(giants.select("row_id", "text"), model_file, kind, chunk)
    longest = giants.agg(F.max(F.length("text"))).first()[0] or 0
    states = chunk_states(transfers(cut, model_file, kind), -(-(longest + 1) // chunk), fan)
    parts = map_rows(cut.join(states, ["row_id", "k"]), traced, "row_id long, k long, ids binary", rows=64)
    whole = parts.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))

    def joined():
        return lambda block: {"row_id": block["row_id"], "ids": [b"".join(p["ids"] for p in parts) for parts in block["parts"]]}

    long = map_rows(whole, joined, "row_id long, ids binary", rows=16).join(giants.select("row_id", "doc_id"), "row_id")
    return one.unionByName(long.select("doc_id", "ids"))


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids, text) from (doc_id, ids)."""

    def task():
        v = Vocabulary(model_file)

        def step(block):
            return {"doc_id": block["doc_id"], "ids": block["ids"], "text": [v.decode(np.frombuffer(i, "<u4")) for i in block["ids"]]}

        return step

    return map_rows(encoded, task, "doc_id long, ids binary, text string")


def with_id_lists(encoded: DataFrame) -> DataFrame:
    """The ids as an array of integers in place of bytes."""

    def task():
        def step(block):
            return {"doc_id": block["doc_id"], "ids": [np.frombuffer(i, "<u4").tolist() for i in block["ids"]]}

        return step

    return map_rows(encoded.select("doc_id", "ids"), task, "doc_id long, ids array<int>")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text decoded from them."""
    import public_tokenizers

    model_file = public_tokenizers.path("piece_bpe_32k.model")
    both = decode(encode(table(spark, sf_dir, "documents"), model_file), model_file)
    return both.select(
        "doc_id",
        F.floor(F.length("ids") / 4).alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"),
    )
