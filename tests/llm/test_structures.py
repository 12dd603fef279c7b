"""Merkle manifest, byte-level BPE and the trie of conversations, each against a brute-force version."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from regiolith.llm import bytebpe, merkle, trie

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def hexed(text):
    return sha256(text.encode()).hexdigest()


# merkle


@pytest.mark.parametrize("more", [0, 1, 3])
def test_postorder_addresses(more):
    for n in range(1, 90):
        levels = merkle.height(n) + more
        rows = [[sha256(str(i).encode()).digest() for i in range(n)]]
        log = merkle.postorder_log(rows[0], levels)
        for _ in range(levels):
            rows.append([merkle.digest(b"".join(rows[-1][k : k + 3])) for k in range(0, len(rows[-1]), 3)])
        assert len(log) == 32 * sum(map(len, rows))
        for level, row in enumerate(rows):
            for i, value in enumerate(row):
                at = merkle.address(level, i, n, levels)
                assert log[32 * at : 32 * at + 32] == value


def manifest_by_lists(rows):
    """Rows (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r: hexed("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def levels(row):
        out = [row]
        while len(out[-1]) > 1:
            out.append([hexed("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
        return out

    def path(tree, i):
        for row in tree[:-1]:
            first = i - i % 3
            yield row[first:i], row[i + 1 : first + 3]
            i //= 3

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: levels([leaf(r) for r in groups[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            siblings = [*path(trees[s], i), *path(top, k)]
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = leaf((*r[:4], r[4].replace("\n", "")) if even and r[4] is not None else r)
            for a, b in siblings:
                folded = hexed("".join(a) + folded + "".join(b))
            proof = hexed("".join("".join(a + b) for a, b in siblings))
            yield r[0], leaf(r), trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]


def manifest_rows(df):
    return sorted(map(str, ((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())))


def test_manifest_of_the_given_documents(spark):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = merkle.op11_merkle(spark, SF)
    assert manifest_rows(got) == sorted(map(str, manifest_by_lists(rows)))
    assert 0 < got.where("verified").count() < len(rows)


def test_manifest_with_a_hot_source_nulls_ties_and_repeats(spark):
    r = random.Random(4)
    rows = [(i if i % 17 else None, r.choice([None, "a", "a", "a", "é", "", "zz"]), r.choice(["en", None]), i % 5 or None, "x\ny" * (i % 4) if i % 5 else None) for i in range(240)]
    rows += [(5, "a", "en", 1, "t\n")] * 4 + [(7, "lone", "en", 1, "l" * 200_000 + "\n")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 as rank", "2 as size", "'x' as tree", "3 as leaf")
    want = sorted(map(str, manifest_by_lists(rows)))
    for levels in (1, 2, 6):  # many rounds of builders, or one
        assert manifest_rows(merkle.Manifest(df, levels).verified()) == want
    for p in merkle.Manifest(df, 2).proofs().limit(50).collect():
        assert merkle.fold(bytes(p.leaf), [(bytes(a), bytes(b)) for a, b in zip(p.left, p.right)]) == bytes(p.root)
    one = df.where("source = 'lone'")
    assert manifest_rows(merkle.Manifest(one).verified()) == sorted(map(str, manifest_by_lists([rows[-1]])))
    assert merkle.Manifest(df.limit(0)).verified().count() == 0


# byte-level BPE


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(1)
    pool = [chr(c) for c in (0x558, 0x88F, 0x208F, 0x11DE0, 0x1246F, 0x85, 0x1C, 0x1F, 0x200B, 0x3000, 0xA0, 0x301, 0x1F600, 0x4E00, 0xE9, 0x2028)]
    pool += [*"ab 'sS\t\n\r12#.<|>!", "endoftext", " the", "'re", "'ll"]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(1, 60))) for _ in range(400)]
    texts += ["".join(chr(c) for c in (r.randrange(32, 0x110000) for _ in range(50)) if not 0xD800 <= c < 0xE000) for _ in range(300)]
    return [*texts, "", None, "a" * 50_000, " " * 5000 + "x", "<|endoftext|>", "=" * 3000, "\n\n\n \t" * 2000, "word é " * 40_000]


def test_ids_equal_the_library(spark, reference):
    texts = odd_texts()
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens", "3 as data")
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.round_trip(df, RANKS).collect())
    want = collections.Counter()
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want[i, len(ids), hexed(" ".join(map(str, ids))), hexed(t or "")] += 1
    assert got == want
    assert bytebpe.round_trip(df.limit(0), RANKS).count() == 0


def test_every_character_is_split_as_the_library_does(reference):
    memo, split = bytebpe.PieceIds(bytebpe.vocabulary_json(RANKS)), bytebpe.Splitter(bytebpe.disputed_characters())
    for at in range(0, 0x110000, 0x1100):
        text = "".join(f"a{chr(c)}1{chr(c)} " for c in range(at, at + 0x1100, 7) if not 0xD800 <= c < 0xE000)
        ids = np.frombuffer(b"".join(b"".join(map(memo.__getitem__, p)) for p in split(text)), "<u4").tolist()
        assert ids == reference.encode_ordinary(text)


def test_offsets_and_decoding_of_cut_tokens(spark):
    texts = ["plain text, 12", "漢字仮名 \U0001f600\U0001f468 ñandú", "", None, "é" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens = bytebpe.encode(df, RANKS)
    memo = bytebpe.PieceIds(bytebpe.vocabulary_json(RANKS))
    table = bytebpe.ByteTable(memo.tokenizer)
    for r in tokens.collect():
        text, at = texts[r.doc_id] or "", 0
        places = [i for i, c in enumerate(text) for _ in c.encode()]  # the character of each byte
        for i, start, end in zip(r.ids, r.starts, r.ends):
            n = len(table.bytes[i])
            assert (start, end) == (places[at], places[at + n - 1] + 1)
            at += n
        assert at == len(places)
    cuts = tokens.select("doc_id", F.posexplode("ids").alias("at", "id")).select((F.col("doc_id") * 1000 + F.col("at")).alias("doc_id"), F.array("id").alias("ids"))
    parts = collections.defaultdict(list)
    for r in bytebpe.decode(cuts, RANKS).orderBy("doc_id").collect():
        assert bytes(r.head) + r.text.encode() + bytes(r.tail) == bytes(r.data)
        parts[r.doc_id // 1000].append(r)
    for i, rows in parts.items():
        pending, made = b"", ""
        for r in rows:
            pending += bytes(r.head)
            if r.text or r.tail:
                made += pending.decode() + r.text
                pending = bytes(r.tail)
        assert made + pending.decode() == texts[i]
    odd = spark.createDataFrame([(1, [15496, -1, None, 10**6]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [(r.text, r.unknown) for r in bytebpe.decode(odd, RANKS).orderBy("doc_id").collect()] == [("Hello", 3), ("", 0), ("", 0)]


# trie


def trie_by_lists(rows):
    """Rows (conv_id, turn, role, text)."""
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, role, hexed(f"{len(role.encode())}:{role}{text}"), text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in turns.items()}
    members, children = collections.defaultdict(list), collections.defaultdict(set)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
            if d:
                children[tuple(whole[c][: d - 1])].add(tuple(whole[c][:d]))
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        own_words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = sum(saved[k] for k in children[p]) + (len(members[p]) - 1) * own_words
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        yield min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hexed(ends)


def trie_rows(df):
    return sorted(map(str, ((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())))


def test_trie_of_the_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(trie.op13_trie(spark, SF)) == sorted(map(str, trie_by_lists(rows)))


@pytest.fixture
def many_partitions(spark):
    """So many range partitions that forests are merged in more than one round."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_trie_with_nulls_ties_and_repeats(spark, many_partitions):
    r = random.Random(3)
    rows = []
    for c in [None, *range(-30, 140)]:
        for t in range(r.choice([0, 1, 2, 3, 6, 9])):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["u", "a", None]), r.choice(["x", "x", "x y", None, "z é 　 q"])))
    rows += [(200, t, "u", "long " * 30_000 if t == 1 else "x") for t in range(60)] + [(201, 1, "u", "x")] * 5
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as n", "2 as path", "3 as depth", "4 as part")
    assert trie_rows(trie.trie(df)) == sorted(map(str, trie_by_lists(rows)))
    assert trie.trie(df.limit(0)).count() == 0
    assert trie_rows(trie.trie(df.where("conv_id = 201"))) == sorted(map(str, trie_by_lists(rows[-5:])))


def test_forests_of_parts_equal_the_whole():
    """Contracted forests of any cuts give the nodes of one pass, and keep few components."""
    r = random.Random(6)
    for _ in range(150):
        paths = sorted({tuple(r.choice("ab") for _ in range(r.randrange(9))) for _ in range(r.randrange(1, 60))})
        lcp = [-1] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(paths, paths[1:])] + [-1]
        row = lambda low, high: [trie.Component(len(paths[i]), 1, i, 0, 0, 0, 1, 0, str(i), lcp[i], lcp[i + 1]) for i in range(low, high)]
        show = lambda found: sorted((p, c.depth, c.n, c.conv_id, c.leaves, c.children, str(c.ends)) for p, c in found)
        want, rest = trie.contracted(row(0, len(paths)))
        assert not rest
        cuts = sorted({0, len(paths), *(r.randrange(len(paths) + 1) for _ in range(4))})
        got, waiting = [], []
        for low, high in zip(cuts, cuts[1:]):
            whole, rest = trie.contracted(row(low, high))
            got += whole
            waiting += rest
            assert len(rest) <= 2 * (max(lcp) + 2)
        whole, rest = trie.contracted(waiting)
        assert not rest and show(got + whole) == show(want)


def test_end_lists_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    df = spark.range(500).selectExpr("case when id % 3 = 0 then 'hot' else concat('k', id % 11) end as key", "id * 37 % 501 as conv_id")
    want = collections.defaultdict(list)
    for r in df.collect():
        want[r.key].append(r.conv_id)
    got = {r.key: r.ends for r in trie.end_digests(df).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}
