"""Each operator against a brute-force version, and its edge cases."""

import collections
import functools
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from regiolith.llm import backoff, common, fitting, html, jaccard, media, packing, pieces, quality, rules, secrets, toxicity
from regiolith.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in over under river stone cloud paper light winter summer engine garden market valley signal copper".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


EDGES = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, prose(1, 80), "en", "a", 1), (5, prose(1, 80), "en", "b", 1),
    (5, prose(1, 80), "en", "b", 1), (6, prose(1, 80).upper(), "en", "b", 1), (7, "one", "en", "b", 3), (8, "one", "en", "b", 3), (9, prose(2, 30_000), "en", "b", 1),
    (10, "x" * 40_000, "en", "b", 1), (11, "ñandú 漢字 \U0001f600 password = abcdef12", "es", "b", 1),
]


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empty and long texts, ties and repeated rows, with columns whose names clash with those of results."""
    return spark.createDataFrame(EDGES, SCHEMA).selectExpr("*", "'x' as n", "1 as score", "2 as words", "3 as rep", "4 as ids", "5 as kept")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents with labels: shouting is poor, some words are toxic."""
    rows, labels = [], []
    for i in range(400):
        text = prose(i, 120)
        poor, toxic = i % 7 == 0, i % 5 == 1
        text = " ".join(w.upper() + "!!" for w in text.split()) if poor else text
        if toxic:
            text += " you " + ("gr1mp" if i % 2 else "grimp") + " and zorbling"
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not poor), int(toxic)))
    labels += [(None, 1, 1), (10_000, None, None)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_backoff_against_counts(spark, edges, empty):
    got = {r.doc_id: (r.n_words, r.log_score) for r in backoff.backoff_scores(edges.where("doc_id <> 5")).collect()}
    lists = {r.doc_id: (r.text or "").lower().split() for r in edges.where("doc_id <> 5").collect()}
    one, two = collections.Counter(), collections.Counter()
    for w in lists.values():
        one.update(w)
        two.update(zip(w, w[1:]))
    total = sum(one.values())
    for doc, w in lists.items():
        want = math.log(one[w[0]] / total) if w else 0.0
        for a, b in zip(w, w[1:]):
            want += math.log(two[a, b] / one[a]) if two[a, b] >= 2 else math.log(0.4 * one[b] / total)
        assert got[doc][0] == len(w) and abs(got[doc][1] - want) < 1e-6 * max(1, abs(want))
    assert backoff.backoff_scores(empty).count() == 0
    small = backoff.backoff_scores(edges, vocabulary=3, frequent=2)  # unknown words
    assert small.count() == 11


@pytest.mark.parametrize("vocabulary, frequent", [(0, 2), (3, 2), (12, 5), (30, 100)])
def test_backoff_counts_rare_words(spark, edges, vocabulary, frequent):
    """Words beyond the vocabulary have their own counts."""
    docs = edges.unionByName(edges.where("doc_id = 9").selectExpr("12 as doc_id", "'rare odd ' || substr(text, 1, 900) || ' rare odd' as text"), allowMissingColumns=True)
    want, got = ({r.doc_id: r for r in backoff.backoff_scores(docs, **k).collect()} for k in ({}, {"vocabulary": vocabulary, "frequent": frequent}))
    assert got.keys() == want.keys()
    for doc, w in want.items():
        assert got[doc].n_words == w.n_words and abs(got[doc].log_score - w.log_score) < 1e-6 * max(1, abs(w.log_score))


def test_html_blocks(spark):
    page = "<html><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><h1>Title &amp; more</h1><p>One <b>two</b>\n three.<p>Four.</article><div id=comments>c</div><footer>f</footer>"
    assert html.main_text(page) == "Title & more\nOne two three.\nFour."
    assert html.main_text(None) == html.main_text("") == "" and html.main_text("<div") == ""
    assert html.main_text("<p>" * 3000 + "deep") == "deep"
    assert html.main_text("<div>" * 3000 + "deep<p>er") == "deep\ner"
    df = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x")], "page_id long, url string, html string, text string")
    assert {r.page_id: r.n_chars for r in html.extract_main_text(df).collect()} == {1: 33, 2: 0}
    assert html.extract_main_text(df.limit(0)).count() == 0


ARTICLE = "<h1>Title of it</h1>" + "".join(f"<p>{prose(50 + i, 30)}</p>" for i in range(3))
ARTICLE_TEXT = "\n".join(["Title of it", *(prose(50 + i, 30) for i in range(3))])
CHROME = [
    "<nav><ul><li><a href=x>Home</a></li><li><a href=y>News of today</a></li></ul></nav>", "<div class='site-footer'>all rights reserved</div>", "<div class=cookie-notice><p>We use cookies to be of use to you on this site.</p></div>",
    "<ul class='main-menu'><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>", "<div id=comments><p>I read it twice and I still disagree.</p></div>", "<form id=search><input><button>Go</button></form>",
    "<aside><p>Most read of the week</p></aside>", "<script>var a = '<p>no</p>';</script>", "<style>p{}</style>", "<div role=banner>Site of sites</div>", "<svg><svg>x</svg>leak</svg>", "<div hidden>secret words</div>",
]
WRAPPERS = [
    "<article>%s</article>", "<div>%s</div>", "<main><div>%s</div></main>", '<div class="no-sidebar"><article>%s</article></div>', '<div class="content has-comments"><article>%s</article></div>',
    '<form id="aspnetForm"><div>%s</div></form>', "<table><tr><td>%s</td></tr></table>", "<section id=story>%s</section>",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_html_finds_the_article_among_chrome(wrapper):
    """Pages whose text is known, most of them without an article or main element."""
    for seed in range(30):
        r = random.Random(seed)
        before, after = (r.sample(CHROME, r.randrange(5)) for _ in range(2))
        assert html.main_text("<html><head><title>t</title></head><body>" + "".join(before) + wrapper % ARTICLE + "".join(after) + "</body></html>") == ARTICLE_TEXT


def test_html_density_decides(monkeypatch):
    """Without any evidence of names the densest subtree is found, and not the page."""
    monkeypatch.setattr(html, "evidence", lambda *_: html.NONE)
    links = "<div><ul>" + "".join(f"<li><a href=/{i}>go to {i}</a></li>" for i in range(12)) + "</ul></div>"
    assert html.main_text(f"<body>{links}<div><div>{ARTICLE}</div></div>{links}</body>") == ARTICLE_TEXT


def test_html_names_against_an_element():
    grade = lambda name: html.words_against(name, False)
    assert [grade(n) for n in ("content", "no-sidebar", "has-comments", "notice-board", "sidebar", "cookie-notice")] == [html.NONE] * 3 + [html.WEAK, html.STRONG, html.STRONG]
    kept = f"<article>{ARTICLE}<p class='notice-board'>{prose(9, 20)}</p><p class=ad>Buy</p></article>"
    assert html.main_text(kept) == ARTICLE_TEXT + "\n" + prose(9, 20)


@pytest.mark.parametrize("piece", ['<a "', '"', "<a ", "<", "</", '<div "', "<!--", "<svg>", "<script ", "<p>", "<!x"])
def test_html_takes_time_in_proportion(piece):
    for head in ("<p>a</p>", "<p>a</p><a "):
        began = time.perf_counter()
        html.main_text(head + piece * 20_000)
        assert time.perf_counter() - began < 5


def test_media_round_trip(spark, edges, empty):
    out = media.audio_features(media.store_media(edges))
    texts = {r.doc_id: r.text or "" for r in edges.collect()}
    rows = out.collect()
    assert len(rows) == 12
    for r in rows:
        data = texts[r.doc_id].encode()
        data += bytes(-len(data) % 64) if data else bytes(64)
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-64:])
    same = {r.doc_id: r.feature for r in rows}
    assert same[4] == same[5] and same[7] == same[8] and same[1] == same[2]
    for r in rows:
        assert [c.start_s for c in r.clips[1:]] == [c.end_s for c in r.clips[:-1]] and r.clips[0].start_s == 0.0
        assert all(len(c.log_mel) == 2 * media.CLIP_FRAMES * media.MELS for c in r.clips)
        rate, samples = media.wave_samples(media.wave_bytes((texts[r.doc_id].encode() + bytes(-len(texts[r.doc_id].encode()) % 64)) or bytes(64)))
        assert np.allclose(np.concatenate([np.frombuffer(c.log_mel, "<f2") for c in r.clips]).reshape(-1, media.MELS)[: len(brute_log_mel(samples, rate))], brute_log_mel(samples, rate), atol=0.05)
    batch = media.clip_rows(out).toArrow().combine_chunks().to_batches()[0]
    kind = media.tensor_batch(batch).schema.field("log_mel").type
    assert kind.shape == [media.CLIP_FRAMES, media.MELS] and kind.value_type == media.pa.float16()
    assert media.audio_features(media.store_media(empty)).count() == 0


def test_resampling_and_segments():
    x = np.random.RandomState(0).rand(1001).astype(np.float32)
    h = media.filter_phases(3, 4, 8)
    padded = np.concatenate([np.zeros(7), x, np.zeros(8)])
    want = [padded[(m * 4) // 3 : (m * 4) // 3 + 8] @ h[(m * 4) % 3] for m in range(-(-1001 * 3 // 4))]
    assert np.allclose(media.resample(x, h, 3, 4), want, atol=1e-5)
    level = np.array([0, 5, 5, 0.5, 5, -9, -9, 5, 5, 5.0])
    assert media.hysteresis_segments(level, 1, -1) == [(1, 5), (7, 10)]


def brute_log_mel(samples, rate):
    """Frame by frame, with the filter applied by plain convolution."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    phases = media.filter_phases()
    padded = np.concatenate([np.zeros(media.TAPS - 1), x, np.zeros(media.TAPS)])
    count = -(-len(x) * media.UP // media.DOWN)
    y = np.array([padded[(m * media.DOWN) // media.UP :][: media.TAPS] @ phases[(m * media.DOWN) % media.UP] for m in range(count)])
    weights, out = media.mel_matrix(rate * media.UP / media.DOWN), []
    for at in range(0, max(1, len(y) - media.FRAME + media.HOP), media.HOP):
        frame = np.zeros(media.FRAME)
        frame[: len(y[at : at + media.FRAME])] = y[at : at + media.FRAME]
        power = np.abs(np.fft.rfft(frame * np.hanning(media.FRAME))) ** 2
        out.append(np.log(power @ weights + 1e-6))
        if len(y) <= media.FRAME:
            break
    return np.array(out)


def test_quality_scores(spark, labelled, edges, empty):
    docs, labels = labelled
    model = quality.train(docs, labels, 300)
    out = quality.score_quality(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 for r in quality.score_quality(edges, model).collect())
    assert quality.score_quality(empty, model).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert {round(r.score, 6) for r in quality.score_quality(edges, none).collect()} == {0.5}


def brute_rules(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules_against_python(spark, edges, empty):
    extra = [(20, "a b c a b c a b c\na b c\na b c\n#$ |", "en", "s", 1), (21, "x x x x x", "en", "s", 1), (22, "##" + prose(4, 60), "en", "s", 1)]
    docs = spark.createDataFrame(EDGES + extra, SCHEMA)
    for r in rules.quality_cascade(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert rules.quality_cascade(empty).count() == 0
    kept = rules.filter_quality(edges)
    assert kept.columns == edges.columns and {r.doc_id for r in kept.collect()} >= {4, 5}
    assert rules.filter_quality(empty).columns == empty.columns
    plan = rules.quality_cascade(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # words once, lines once


def test_rules_are_ordered_by_rejections_per_second():
    named = [rules.Rule(n, lambda p: F.lit(True)) for n in "abc"]
    found = [rules.Estimate("a", 1.0, 0.1), rules.Estimate("b", 0.1, 0.1), rules.Estimate("c", 0.01, 0.0)]
    assert [r.name for r in rules.ordered(named, found)] == ["b", "a", "c"]


def test_secret_spans(spark, edges, empty):
    text = 'é password=token:abcdefgh api_key: "abcdef" AKIA' + "A" * 16 + " " + "0a" * 12 + " AKIAB token=x"
    spans = secrets.pattern_spans(text)
    assert secrets.joined(spans) == "assign:26:42,access:44:64,hex:65:89"
    novel = secrets.Novelty(secrets.trained_dictionary([]))
    hit = "the bearer is tGz9Kd0LmQ2xVw7Rb4Nc8Yp1 now"
    assert secrets.joined(novel.spans(hit, [])) == "novel:14:38"
    assert novel.spans("the bearer is username_password_secret_token now", []) == []
    out = secrets.redact(edges)
    assert out.columns == edges.columns and out.count() == 12
    assert [r.text for r in out.where("doc_id = 11").collect()] == ["ñandú 漢字 \U0001f600 [assign]"]
    assert secrets.find_secrets(edges).where("n_assign > 0").count() == 1
    assert secrets.find_secrets(empty).count() == secrets.redact(empty).count() == 0


def brute_base_spans(text):
    """The base kinds by plain scanning of characters."""
    word = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    found = []

    def run(at, allowed):
        end = at
        while end < len(text) and text[end] in allowed:
            end += 1
        return end

    lower = "".join(c.lower() if c in word else c for c in text)
    at = 0
    while at < len(text):
        hit = None
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not lower.startswith(name, at):
                continue
            i = at + len(name)
            i += text[i : i + 1] in ("'", '"') and text[i : i + 1] != ""
            i = run(i, " ")
            if text[i : i + 1] not in (":", "="):
                continue
            i = run(i + 1, " ")
            i += text[i : i + 1] in ("'", '"') and text[i : i + 1] != ""
            end = run(i, word | set("+/_.=-"))
            if end > i:
                hit = (i, end)
                break
        if hit:
            if hit[1] - hit[0] >= 6:
                found.append((at, 0, hit[1]))
            at = hit[1]
        else:
            at += 1
    for kind, head, allowed, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), (2, "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(text):
            end = run(at + len(head), allowed) if text.startswith(head, at) else at
            if end > at + len(head):
                if end - at >= least:
                    found.append((at, kind, end))
                at = end
            else:
                at += 1
    return sorted(found)


def test_base_spans_against_brute_force():
    pieces_ = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", "api__key", "=", ":", " ", "  ", "'", '"', "abcdef", "x/y+z==", "AKIA", "AKIA" + "B7" * 9, "0a" * 14, "0A", "é", "\n", "\t", "ſ", "K", "token=token:abcdefgh"]
    for seed in range(3_000):
        r = random.Random(seed)
        text = "".join(r.choice(pieces_) for _ in range(r.randrange(14)))
        assert secrets.pattern_spans(text) == brute_base_spans(text), text


def test_secrets_learn_words_of_the_corpus(spark):
    value = "tGz9Kd0LmQ2xVw7Rb4Nc8Yp1Hs5Jf3Ue6Ao2Iq9Z"
    name = "quonkleZarbiftMurgeonPlistow1"
    rows = [(i, f"the login of quonkle and Zarbift by murgeon, Plistow or venkarth {i}; key is {value} of quonkleZarbiftMurgeonPlistow") for i in range(20)]
    learned = secrets.learned_names(spark.createDataFrame(rows, "doc_id long, text string"))
    bare = secrets.Novelty(secrets.trained_dictionary([]))
    assert bare.bits(name) > secrets.Novelty(learned).bits(name) + 0.5
    assert value.encode() not in learned
    assert secrets.joined(secrets.Novelty(learned).spans(f"key {value}", [])) == "novel:4:44"
    began = time.perf_counter()
    secrets.Novelty(learned).spans("key " * 50_000, [])
    assert time.perf_counter() - began < 5


def test_novelty_tells_keys_from_names(spark):
    """Planted keys are found and names are not, wherever the sensitive word of the document stands; the words of the
    names occur nowhere else, the dictionary is that of the given documents."""
    import string
    import uuid

    r = random.Random(11)
    words = "ledger harbor mountain velocity bracket compute window widget builder factory registry scheduler monitor gateway profile avatar banner cluster shard replica pipeline cursor canvas pixel vector matrix kernel socket packet".split()
    pick = lambda n: [r.choice(words) for _ in range(n)]
    camel = lambda: "".join(w.capitalize() if i else w for i, w in enumerate(pick(4)))
    drawn = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    plain = string.ascii_letters + string.digits
    makers = {
        "keys": [lambda: drawn(plain, 20), lambda: drawn(plain + "+/", 40), lambda: drawn(string.ascii_uppercase + string.digits, 32), lambda: drawn(string.ascii_lowercase + string.digits, 32)],
        "names": [camel, lambda: "_".join(pick(4)) + "_2", lambda: "/".join(pick(4)) + "/V2", lambda: str(uuid.UUID(int=r.getrandbits(128))), lambda: "_".join(w.capitalize() for w in pick(4))],
    }
    novel = secrets.Novelty(secrets.learned_names(spark.read.parquet(f"{SF}/documents.parquet")))
    share = {}
    for kind, some in makers.items():
        for make in some:
            hits = n = 0
            for seed in range(60):
                value = make()
                if not secrets.pattern_spans(value):
                    text = prose(seed, 60) + f" {value} " + prose(seed + 1, 40 + seed * 10) + " bearer " + prose(seed, 30)
                    at, n = text.index(value), n + 1
                    hits += any(a < at + len(value) and at < b for a, _, b in novel.spans(text, []))
            share.setdefault(kind, []).append(hits / max(n, 1))
    assert min(share["keys"]) >= 0.95 and max(share["names"]) <= 0.05, share


def test_novel_secrets_beside_the_base_words():
    value = "tGz9Kd0LmQ2xVw7Rb4Nc8Yp1Hs5Jf3Ue6Ao2Iq9Z"
    novel = secrets.Novelty(secrets.trained_dictionary([]))
    for before in ('secret_key = "', "api_key => '", "the password is ", "token | ", "signing_key: ", "db_pwd, "):
        text = f"{before}{value} end"
        base = secrets.pattern_spans(text)
        assert base == [] and secrets.joined(novel.spans(text, base)) == f"novel:{len(before)}:{len(before) + 40}"
    for gap in (90, 119, 200, 5000):  # the whole document is the context
        text = value + " " * gap + "bearer"
        assert secrets.joined(novel.spans(text, [])) == "novel:0:40"
    text = "bearer " + value + "0a" * 12  # what a pattern leaves of a run
    base = secrets.pattern_spans(text)
    assert secrets.joined(sorted(base + novel.spans(text, base))) == "novel:7:47,hex:47:71"
    text = "my_secret=" + value
    base = secrets.pattern_spans(text)
    assert secrets.joined(base + novel.spans(text, base)) == "assign:3:50"


def test_pieces_equal_the_library(spark, edges, empty):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = pieces.encode(edges.where("doc_id <> 5"), path, chunk=1024)
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in pieces.decode(encoded, path).collect()}
    for r in edges.where("doc_id <> 5").collect():
        assert got[r.doc_id] == (library.encode(r.text or ""), r.text or "")
    assert pieces.encode(empty, path).count() == 0
    v = pieces.Vocabulary(path)
    words = pieces.WordIds(v)
    random.seed(5)
    for _ in range(150):
        t = "".join(random.choice(["a", "the", "ing", " ", "  ", "é", "1", "\n", "tion", " in", "漢", "e", "t"]) for _ in range(50))
        n = pieces.normalised(t)
        chunks = [pieces.Chunk(v, x, f, s, len(n)) for _, x, f, s in pieces.cut_chunks(n, v.longest, 37)]
        matrices = [c.matrix() for c in chunks]
        states = pieces.scan(matrices)
        half = len(matrices) // 2
        if half:  # products of parts, and states from the top down, are those of the whole
            parts = [functools.reduce(pieces.product, m) for m in (matrices[:half], matrices[half:])]
            (a, middle), (_, z) = pieces.scan(parts)
            assert pieces.scan(matrices[:half], a, middle) + pieces.scan(matrices[half:], middle, z) == states
        assert np.frombuffer(b"".join(c.ids(a, b, words) for c, (a, b) in zip(chunks, states)), "<u4").tolist() == library.encode(t)


def test_giant_rows_without_an_own_id(spark):
    """Giant texts with a null or a repeated id, equal or not, are one row each."""
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    one, two, three = prose(11, 900), prose(12, 700), prose(13, 800)
    rows = [(None, one), (None, two), (None, two), (1, one), (1, one), (2, two), (2, three), (2, "short"), (None, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in pieces.encode(docs, path, chunk=512, fan=3).collect()]
    assert sorted(got, key=str) == sorted([(i, library.encode(t)) for i, t in rows], key=str)


def test_unigram_scan_is_the_best_path():
    import public_tokenizers

    v = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"), "unigram")
    words = pieces.WordIds(v)
    for seed in range(40):
        r = random.Random(seed)
        n = pieces.normalised("".join(r.choice(["a", "the", "ing", " ", "tion", "e", "t", "in"]) for _ in range(40)))
        best = [0.0] + [-math.inf] * len(n)
        for i in range(len(n)):
            for p in v.starting(n, i):
                best[i + len(p)] = max(best[i + len(p)], best[i] + v.weight(None, p))
        chunks = [pieces.Chunk(v, x, f, s, len(n)) for _, x, f, s in pieces.cut_chunks(n, v.longest, 33)]
        ids = np.frombuffer(b"".join(c.ids(a, b, words) for c, (a, b) in zip(chunks, pieces.scan([c.matrix() for c in chunks]))), "<u4")
        names = {i: p for p, i in v.ids.items()}
        assert sum(v.scores[names[i]] for i in ids.tolist()) == best[-1]


def test_toxicity(spark, labelled, edges, empty):
    docs, labels = labelled
    model = toxicity.train(docs, labels, 300)
    out = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in out) / len(out) > 0.97
    restorer = toxicity.Restorer(model.grams)
    assert restorer.restore("gr1mp") == "grimp" and restorer.restore("z0rbl1ng") == "zorbling"
    assert "grimp" in toxicity.restored_words("a g r i m p here", restorer, {})
    kept = toxicity.drop_toxic(edges, model)
    assert kept.columns == edges.columns and kept.count() == 12
    assert toxicity.score_toxicity(empty, model).count() == toxicity.drop_toxic(empty, model).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert {round(r.score, 6) for r in toxicity.score_toxicity(edges, none).collect()} == {0.5}


def test_components_of_few_edges_stay_in_one_partition(spark, monkeypatch):
    """A small graph goes through its rounds without shuffles, with the result of the dealt way; before, each round had its own
    tasks and files for every shuffle partition."""
    r = random.Random(4)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(5)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = components(edges)
        assert found.rdd.getNumPartitions() <= 2
        one = {x.node: x.component for x in found.collect()}
        monkeypatch.setattr("regiolith.llm.components.FEW_EDGES", 0)
        assert one == {x.node: x.component for x in components(edges).collect()} and components(edges.limit(0)).count() == 0
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    group = {n: n for p in pairs for n in p if p[0] != p[1]}
    for _ in group:
        changed = False
        for u, v in pairs:
            if u != v and group[u] != group[v]:
                group[u] = group[v] = min(group[u], group[v])
                changed = True
        if not changed:
            break
    assert one == group


def test_toxicity_counts_and_scores_as_word_by_word(spark):
    """Runs of characters counted at once, and weights remembered by word, are those of the plain way; labels are joined
    without a broadcast, which would change how the shuffle grows."""
    words = {"a": 3, "banana": 2, "l'été": 1, "\U0001d4d0x": 4, "ananas": 5}
    slow = collections.Counter()
    for word, n in words.items():
        marked = f"^{word}$"
        for size in range(1, toxicity.ORDER + 1):
            for at in range(len(marked) - size + 1):
                slow[marked[at : at + size]] += n
    assert toxicity.gram_counts(words) == slow and toxicity.gram_counts({}) == {}
    weights = {"^grim": 2.0, "^grimpl": 3.0, "stone": 1.0, "zap": 4.0}
    scorer = toxicity.Scorer({}, weights)
    for text in ("grimple stone zap", "grim grimp stones", "", "z.a.p gr1mple stone stone"):
        found = toxicity.restored_words(text, scorer.restorer, {})
        hits = sorted((w for x in found if (w := max(weights.get(f, 0.0) for f in toxicity.features_of(x)))), reverse=True)
        assert scorer.features(text)[:3] == (hits + [0.0] * 3)[:3] and scorer.features(text)[3] == math.log1p(sum(hits))
    docs = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    plan = common.labelled_texts(docs, labels, "toxic")._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """Every labelled row outside the held-out fold counts: with no number given, none is left out, and the calibration over a
    table is that over all of its rows at once."""
    monkeypatch.setattr(toxicity, "PER_CLASS", 5, raising=False)
    rows = [(i, f"word{i % 7} " + ("grimp zorbling" if i % 3 == 0 else "stone")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    seen = common.labelled_texts(docs, labels, "toxic")
    assert {r.doc_id for r in seen.collect()} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5}
    learns = [r.text for r in seen.where("pmod(xxhash64(doc_id, 7), 4) > 0").collect()]
    grams = toxicity.train(docs, labels).grams
    full = toxicity.character_model(spark.createDataFrame([(t,) for t in learns], "text string"))
    assert grams == full
    r = random.Random(2)
    table = [(int(r.random() < 0.4), [r.gauss(0, 1), r.gauss(1, 2)]) for _ in range(300)]
    table = [(y, [a + y, b]) for y, (a, b) in table]
    one = fitting.fit(np.array([x for _, x in table]), np.array([y for y, _ in table]), 0.3)
    many = fitting.fit_table(spark.createDataFrame(table, "y int, x array<double>").repartition(3), 2, 0.3)
    assert np.allclose(one.weights, many.weights, atol=1e-6) and abs(one.bias - many.bias) < 1e-6


def test_long_obfuscations(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels, 300)
    restorer = toxicity.Restorer(model.grams)
    read = lambda text: toxicity.restored_words(text, restorer, {})
    assert {"you", "grimp"} <= read("y o u g r i m p") and {"you", "grimp"} <= read("y o u  g r i m p")
    passage = "river stone and cloud you grimp winter paper garden zorbling market signal copper"
    for gap in (" ", "  "):
        assert {"grimp", "zorbling"} <= read(gap.join(" ".join(w) for w in passage.split()))
    assert "grimp" in read("gri" + "m" * 60 + "p") and "zorbling" in read("z0" + "r" * 30 + "b" * 40 + "l1ng")
    assert restorer.restore("x1" * 20_000) and restorer.restore_run(" ".join("grimp" * 4_000))


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_against_all_pairs(spark, edges, empty):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [random.choice(vocabulary) for _ in range(60)]
    rows = [(r[0], r[1]) for r in EDGES]
    k = 100
    for _ in range(10):
        base = [random.choice(vocabulary) for _ in range(random.choice([3, 10, 40, 80, 120]))] + passage * random.choice([0, 1])
        for _ in range(random.choice([1, 3, 25])):
            w = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
                w[random.randrange(len(w))] = random.choice(vocabulary)
            rows.append((k, " ".join(w)))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.linked_components(docs).collect()
    want = brute_components(rows)
    assert len(got) == len(rows) and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
    kept = jaccard.one_of_each(edges)
    assert kept.columns == edges.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 7, 9, 10, 11]
    assert jaccard.linked_components(empty).count() == jaccard.one_of_each(empty).count() == 0
    shared = spark.createDataFrame([(1, prose(1, 40)), (1, prose(2, 40)), (2, prose(2, 40) + " x"), (3, prose(3, 40)), (3, prose(3, 40)), (4, prose(1, 40)), (4, " ")], "doc_id long, text string")
    by_text = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.linked_components(shared).collect())
    assert by_text == {(1, 37, 1): 2, (2, 38, 1): 1, (3, 37, 3): 2, (4, 37, 1): 1, (4, 0, 4): 1}
    assert sorted(tuple(r) for r in jaccard.one_of_each(shared).collect()) == sorted([(1, prose(1, 40)), (1, prose(2, 40)), (3, prose(3, 40)), (4, " ")])
    null = jaccard.linked_components(spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in null} == {(None, None), (1, 1)}


def check_packed(rows, texts, sequence):
    from tokenizers import Tokenizer
    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= sequence
    for doc, text in texts.items():
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            piece = np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.start == at and zlib.crc32(piece) == r.ids_crc32 and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)


def test_packing(spark, edges, empty):
    rows = packing.pack_with_public_tokenizer(edges.where("doc_id <> 5")).collect()
    check_packed(rows, {r.doc_id: r.text for r in edges.where("doc_id <> 5").collect()}, 2048)
    assert packing.pack_with_public_tokenizer(edges).count() > len(rows)
    assert packing.pack_with_public_tokenizer(empty).count() == 0


def test_histogram_packing_places_everything():
    r = random.Random(1)
    counts = {n: r.randrange(50) for n in range(1, 65)}
    patterns = packing.pack_histogram(counts, 64)
    placed = collections.Counter()
    for lengths, packs in patterns:
        assert sum(lengths) <= 64
        for n in lengths:
            placed[n] += packs
    assert all(placed[n] == c for n, c in counts.items())
    assert packing.pack_histogram({}, 64) == []


def test_pipeline_stages(spark, labelled):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "secrets", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, SF)
        if name != "packing":
            assert docs.columns == columns
            docs = docs.checkpoint()
        if name == "quality_rules":
            judged = rules.quality_cascade(before).where("kept").select("doc_id")
            assert {r[0] for r in judged.collect()} == {r[0] for r in docs.select("doc_id").collect()}
        if name == "near_duplicates":
            want = {c for n, c in brute_components([(r.doc_id, r.text) for r in before.collect()]).values()}
            assert {r.doc_id for r in docs.collect()} == want
    assert docs.count() > 0


def test_pipeline_links_five_word_copies(spark):
    """Copies with a five-word Jaccard from 0.80 to 0.85 count as near duplicates in the pipeline."""
    import corpus_pipeline

    r = random.Random(8)
    new = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    base = new(104)  # 100 shingles of five words
    longer, shorter, edge, far = base + new(22), base[:86], base + new(25), base + new(26)
    rows = [(i, " ".join(w)) for i, w in enumerate([base, longer, shorter])]
    other, third = new(104), new(104)
    rows += [(10, " ".join(other)), (11, " ".join(other + edge[104:])), (20, " ".join(third)), (21, " ".join(third + far[104:]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    assert sorted(d.doc_id for d in corpus_pipeline.keep_one_of_each(spark, docs, SF).collect()) == [0, 10, 20, 21]
