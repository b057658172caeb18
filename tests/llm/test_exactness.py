"""Texts, ids and rows that hashes, doubles, caps or hot keys could get wrong."""

import collections
import random
import re
import warnings
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from floppyscope.llm import common, html, lm, packing, pii, quality, simhash, tokenfiles, tokens
from floppyscope.llm.chat import op3_chat, preference_pairs
from floppyscope.llm.common import SPACE, scratch_path, span_hashes, string_chunks, word_spans
from floppyscope.llm.linededup import dedup

VOCABULARIES = (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True))


def vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def thue_morse(n):
    """The two strings of n letters that polynomials modulo a power of two can't tell apart."""
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


PAIRS = [t for n in (1024, 2048, 4096, 8192) for t in thue_morse(n)]


# ---------------------------------------------------------------- hashes


def test_span_hashes_tell_regular_texts_apart():
    data = np.frombuffer("".join(PAIRS).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in PAIRS])
    assert len(set(span_hashes(data, ends - [len(t) for t in PAIRS], ends).tolist())) == len(PAIRS)


def test_span_hashes_are_alike_anywhere():
    rnd = np.random.default_rng(1)
    data = rnd.integers(0, 256, common.EXACT_BYTES + 5000).astype(np.uint8)
    for a, b in ((0, 10), (common.EXACT_BYTES, common.EXACT_BYTES + 700), (5, 5)):
        own = span_hashes(data[a:b].copy(), np.array([0]), np.array([b - a]))
        assert span_hashes(data, np.array([a]), np.array([b])) == own


@pytest.mark.parametrize("name, fold", VOCABULARIES)
@pytest.mark.parametrize("collide", [False, True])
def test_encoder_compares_bytes(monkeypatch, name, fold, collide):
    from tokenizers import Tokenizer

    texts = [*PAIRS, "The quick brown fox, 12 lazy dogs.\nMore é text", "another text of words", "", "x"]
    if collide:  # every piece of a length has the same hash, nearly
        monkeypatch.setattr(tokens, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(7))
    encoder = tokens.PieceEncoder(vocabulary(name), fold)
    want = [e.ids for e in Tokenizer.from_file(vocabulary(name)).encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # pieces that are new, and pieces that are held
        got = [ids[b - n : b].tolist() for _, ids, c in encoder.rows(pa.array(texts)) for b, n in zip(np.cumsum(c), c)]
        assert got == want


def test_packing_and_files_of_regular_texts(spark):
    from tokenizers import Tokenizer

    df = spark.createDataFrame(list(enumerate(PAIRS)), "doc_id long, text string").coalesce(1)
    ids = [[*e.ids, 0] for e in Tokenizer.from_file(vocabulary("byte_bpe_50k.json")).encode_batch(PAIRS, add_special_tokens=False)]
    for r in packing.pack(df, vocabulary("byte_bpe_50k.json")).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])


def test_lm_counts_of_regular_words(spark):
    rows = [(k, t) for k, t in enumerate(PAIRS * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.train(df)
    assert (model.total, model.distinct) == (2 * len(rows), len(PAIRS) + 1)


# ---------------------------------------------------------------- packing


def placed(lengths, size=64, **more):
    packer = packing.Packer(size, **more)
    for k, n in enumerate(lengths):
        packer.add(k, np.arange(n, dtype=np.uint32))
        assert packer.levels.sum() <= packer.max_open + 1
    packer.finish()
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in packer.taken():
        by_sequence[sequence].append((offset, length))
        by_doc[doc].append((start, length))
        assert total == lengths[doc] and crc == zlib.crc32(np.arange(start, start + length, dtype="<u4").tobytes())
    for k, n in enumerate(lengths):
        at = 0
        for start, length in sorted(by_doc[k]):
            assert start == at
            at += length
        assert at == n
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        padding += size - at if at & at - 1 else 0
    assert padding == 0
    return packer, by_doc


@pytest.mark.parametrize("seed", range(6))
def test_packing_any_lengths(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([rnd.randrange(1, 64), 1, 63, 64, 65, 200]) for _ in range(rnd.choice([1, 7, 400]))]
    placed(lengths)
    placed(lengths, max_open=3)


def test_packing_holds_few_sequences_of_equal_documents():
    packer, by_doc = placed([38] * 3000, max_open=16)  # no two fit together
    # What a closed sequence lacks is cut off another one; no more than that.
    assert packer.filled <= 3000 * 38 * 26 / 64


def test_packing_keeps_placements():
    rnd = random.Random(4)
    lengths = [rnd.randrange(1, 64) for _ in range(3000)]
    packer, by_doc = placed(lengths)
    assert packer.filled < 0.05 * sum(lengths)
    assert sum(len(p) == 1 for p in by_doc.values()) > 0.9 * len(lengths)


# ---------------------------------------------------------------- token files


def test_files_roll_and_split_hot_ids(spark, monkeypatch):
    from tokenizers import Tokenizer

    rnd = random.Random(8)
    words = "far id the quick brown fox jumps over a lazy dog".split()
    rows = [(None if k % 3 else 7, " ".join(rnd.choice(words) for _ in range(rnd.randrange(40)))) for k in range(300)] + [(8, "long " * 3000), (9, None), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(tokenfiles, "FILE_IDS", 500)
    monkeypatch.setattr(tokenfiles, "FILE_DOCS", 30)
    monkeypatch.setattr(tokenfiles, "READ_IDS", 300)
    folder = scratch_path(spark, "rolled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = tokenfiles.write_files(df, folder, vocabulary("word_bpe_49k.json"), fold=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = tokenfiles.read_files(spark, folder, files).orderBy("start").collect()
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = [(d, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for d, x in rows]
    assert len(files) > 10 and len({name.split("-")[0] for name, _ in files}) > 2
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    want = collections.Counter((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


def test_index_reads_ranges(tmp_path):
    rnd = np.random.default_rng(3)
    lengths = rnd.integers(1, 900, 50)
    ids = rnd.integers(0, 50_000, int(lengths.sum())).astype(np.uint32)
    with open(tmp_path / "f", "wb") as out:
        writer = tokenfiles.FileWriter(out)
        writer.add(list(range(50)), ids, lengths)
        assert writer.close() == (50, len(ids))
    with open(tmp_path / "f", "rb") as source:
        index = tokenfiles.read_index(source)
        assert index.ends.tolist() == np.cumsum(lengths).tolist() and index.doc_ids.tolist() == list(range(50))
        for a, b in ((0, 1), (127, 129), (128, 256), (1000, 5000), (len(ids) - 1, len(ids))):
            assert (tokenfiles.read_ids(source, index, a, b) == ids[a:b]).all()
    with open(tmp_path / "g", "wb") as out:
        out.write(b"FPTOKEN1 and then nothing that is an index, really")
    with open(tmp_path / "g", "rb") as source, pytest.raises(ValueError):
        tokenfiles.read_index(source)


# ---------------------------------------------------------------- language model


def prose_rows(n=60):
    rnd = random.Random(6)
    words = [f"w{int(rnd.paretovariate(0.7)) % 400}" for _ in range(40_000)]
    return [(k, " ".join(words[k * 500 : (k + 1) * 500])) for k in range(n)]


def lm_scores_of(model, rows):
    """Scores by dictionaries: exact counts, each put on its level."""
    one, two = collections.Counter(), collections.Counter()
    streams = []
    for _, text in rows:
        stream = [*text.split(), "\0"]
        streams.append(stream)
        one.update(stream)
        two.update(zip(["\0", *stream], stream))
    quantised = lambda n: float(lm.count_of(lm.level_of(np.array([n])))[0]) if n else 0.0
    total, distinct = sum(one.values()), len(one)
    mu = lm.MU + 10 * model.noise
    for stream in streams:
        score = 0.0
        for v, w in zip(["\0", *stream], stream):
            prior = (quantised(one[w]) + 0.5) / (total + 0.5 * (distinct + 1))
            score += np.log10((quantised(two[v, w]) + mu * prior) / (quantised(one[v]) + model.noise + mu))
        yield score


@pytest.mark.parametrize("sliced", [False, True])
def test_lm_scores_against_dictionaries(spark, monkeypatch, sliced):
    if sliced:  # many parts, several of them in one segment
        monkeypatch.setattr(lm, "PART_BYTES", 4000)
        monkeypatch.setattr(lm, "HELD", 3000)
    rows = prose_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.train(df)
    got = {r["doc_id"]: r["score"] for r in lm.score(df, model).collect()}
    for (k, _), want in zip(rows, lm_scores_of(model, rows)):
        assert got[k] == pytest.approx(want, rel=2e-3)  # but for chance hits


def test_lm_slices_fill_the_same_filter(spark, monkeypatch):
    df = spark.createDataFrame(prose_rows(), "doc_id long, text string")
    whole = lm.train(df)
    monkeypatch.setattr(lm, "PART_BYTES", 3000)
    sliced = lm.train(df)
    assert (whole.bits == sliced.bits).all() and (whole.total, whole.distinct) == (sliced.total, sliced.distinct)


def test_lm_noise_is_what_chance_adds():
    rng = np.random.default_rng(2)
    bits = np.packbits(rng.random(1 << lm.SEGMENT_BITS) < 0.75, bitorder="little")
    model = lm.LanguageModel(bits, np.zeros(0, np.uint64), np.zeros(0, np.int64), 1, 1, 100_000)
    chance = model.quantised(common.mix(np.arange(100_000, dtype=np.uint64))).sum()
    assert model.noise == pytest.approx(chance, rel=0.05)


# ---------------------------------------------------------------- quality


def test_labels_of_other_documents_change_nothing(spark):
    rnd = random.Random(11)
    rows = [(i, " ".join(rnd.choice(("quick", "brown", "hills") if i % 2 else ("buy", "cheap", "now")) for _ in range(40))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    others = spark.range(1000, 6000).selectExpr("id AS doc_id", "0 AS quality")
    own = quality.fit_on_labels(df, labels, 50)
    both = quality.fit_on_labels(df, labels.unionByName(others), 50)
    assert np.array_equal(own.weights, both.weights) and (own.a, own.b) == (both.a, both.b) and own.weights.any()
    with pytest.warns(UserWarning, match="no label"):
        quality.fit_on_labels(df, others)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        quality.fit_on_labels(df, others.limit(0))


def test_fit_takes_the_rows_of_least_hash(spark):
    rows = [(i, f"text number {i} " * 5) for i in range(40)] + [(3, "another text of document three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = quality.fit_on_labels(df, labels, 12)
    order = df.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(12).collect()
    want = quality.fit([r["text"] for r in order], [r["doc_id"] % 2 for r in order])
    assert np.array_equal(got.weights, want.weights)


# ---------------------------------------------------------------- conversations


def test_chat_ids_beyond_doubles(spark, tmp_path):
    base = 2**60
    turns = [(base + k, 0, "user", "hi", "x") for k in range(4)] + [(base + k, 1, "assistant", f"answer {k}", "x") for k in range(4)] + [(-3, 0, "user", "below"), (-4, 0, "user", "zero")]
    turns = [(*t, "x")[:5] for t in turns]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, pair_id string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["pair_id"]: r for r in op3_chat(spark, str(tmp_path)).collect()}
    assert sorted(got) == [-2, base // 2, base // 2 + 1]
    for k in (0, 1):
        assert got[base // 2 + k]["n_common"] == 1
        assert f"answer {2 * k}<" in got[base // 2 + k]["chosen"] and f"answer {2 * k + 1}<" in got[base // 2 + k]["rejected"]
    assert "zero" in got[-2]["chosen"] and "below" in got[-2]["rejected"]


def test_chat_turns_without_an_id_are_never_gathered(spark):
    turns = [(None, k % 2 == 0, k, "assistant", f"t{k}") for k in range(9)] + [(None, None, 1, "user", "x"), (1, None, 0, "user", "y")]
    got = preference_pairs(spark.createDataFrame(turns, "pair_id long, chosen boolean, turn long, role string, text string")).collect()
    assert len(got) == 11
    alone = [r for r in got if r["pair_id"] is None]
    assert sorted(r["chosen"] or r["rejected"] for r in alone if r["chosen"] or "t" in r["rejected"][14:16]) == sorted(f"<|assistant|>\nt{k}<|end|>\n" for k in range(9))
    assert all(r["n_common"] == 0 and not r["prompt"] and bool(r["chosen"]) != bool(r["rejected"]) for r in alone)


def test_chat_long_conversation(spark):
    turns = [(1, side, k, "user" if k % 2 == 0 else "assistant", f"turn {k}" if k < 1500 or side else f"other {k}") for k in range(3000) for side in (True, False)]
    got = preference_pairs(spark.createDataFrame(turns, "pair_id long, chosen boolean, turn long, role string, text string")).first()
    assert got["n_common"] == 1500 and got["prompt"].count("<|end|>") == 1500 and got["chosen_spans"].count(",") == 749
    for span in got["rejected_spans"].split(",")[:5]:
        a, b = map(int, span.split(":"))
        assert re.fullmatch(r"other \d+<\|end\|>", got["rejected"][a:b])


# ---------------------------------------------------------------- line dedup


def test_dedup_of_equal_rows_with_other_columns(spark):
    rows = [(1, "first line\n\nsecond line", k, None) for k in (1, 1, 2, 3)] + [(2, "first line\nown line", 0, "z"), (None, "null line", 0, None), (None, "null line", 0, None), (3, None, 1, None), (3, None, 1, None)]
    out = dedup(spark.createDataFrame(rows, "doc_id long, text string, n_lines int, times string"))
    got = sorted((repr(r["document"]["doc_id"]), repr(r["document"]["text"]), r["n_lines"], r["n_removed"]) for r in out.collect())
    want = [("1", repr("first line\n\nsecond line"), 2, 0), *[("1", repr(""), 2, 2)] * 3, ("2", repr("own line"), 2, 1), ("3", "None", 0, 0), ("3", "None", 0, 0), ("None", repr("null line"), 1, 0), ("None", repr(""), 1, 1)]
    assert got == sorted(want)
    assert sorted(r["document"]["n_lines"] for r in out.where("document.doc_id = 1").collect()) == [1, 1, 2, 3]


def test_dedup_min_chars(spark):
    df = spark.createDataFrame([(1, "short line a"), (2, "short line b")], "doc_id long, text string")
    assert [r["n_removed"] for r in dedup(df).orderBy("document.doc_id").collect()] == [0, 0]
    assert [r["n_removed"] for r in dedup(df, min_chars=5).orderBy("document.doc_id").collect()] == [0, 1]


# ---------------------------------------------------------------- components


@pytest.mark.parametrize("nodes", [100, 1 << 18])
def test_components_with_hubs(spark, monkeypatch, nodes):
    """With fewer nodes broadcast than there are, so that hubs and others are joined apart, and with more."""
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", nodes * simhash.ROW_BYTES)
    star = [(k, 0) for k in range(1, 400)] + [(1000 + k, k) for k in range(300, 600)] + [(5001, 5000)]
    edges = spark.createDataFrame(star, "a long, b long")
    got = {r["a"]: r["b"] for r in simhash.components(edges).collect()}
    root = {k: k for e in star for k in e}
    for _ in range(5):
        for a, b in star:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k != v}


# ---------------------------------------------------------------- pages


def stretches_of(weights, surge, window):
    """By definition: a line belongs to the text if a run of windows that hold something reaches it from a surge."""
    n = len(weights)
    sums = [sum(weights[i : i + window]) for i in range(n)]
    surge = min(surge, html.SURGE_SHARE * max(sums, default=0))
    runs, i = [], 0
    while i < n:
        j = i
        while j < n and sums[j]:
            j += 1
        if j > i and max(sums[i:j]) >= surge:
            runs.append((i, j))
        i = max(j, i + 1)
    return runs


def test_stretches_by_definition():
    rnd = random.Random(12)
    for _ in range(3000):
        weights = [rnd.choice([0, 0, 0, 1, 20, 90, 400]) for _ in range(rnd.randrange(25))]
        window = rnd.randrange(1, 5)
        assert html.stretches(weights, 86, window) == stretches_of(weights, 86, window)


LONG = "A long paragraph of the article, long enough to make the sum of its window surge over any threshold there is."


@pytest.mark.parametrize(
    "page, text",
    [
        # A run of links is no text, nor is a short line behind it; one link between paragraphs is.
        (f"<article><h1><a href=x>Title</a></h1><p>{LONG}<p><a href=y>Source</a><p>{LONG}" + "<p><a href=z>More</a>" * 4 + "<p>Share</article>", f"Title\n\n{LONG}\n\nSource\n\n{LONG}"),
        (f"<div><p>{LONG}</div>" + "<ul>" + "<li><a href=q>Link</a>" * 5 + "</ul><p>tiny</p>", LONG),
        ("<p title=it's>one</p><p>two</p><p>that's</p>", "one\n\ntwo\n\nthat's"),
        ("<p>a &am<b>p;</b> &amp; b", "a &amp; & b"),
        ("<p title='a>b' class = \"x>\">one", "one"),
        ("<article><div class='article-header'><h1>T</h1></div><p class='side-by-side'>x</p><p class='search-results'>y</p><p data-x=' class=ad '>z</p></article>", "T\n\nx\n\ny\n\nz"),
        ("<article><p>x</p><div class='ad-box'>no</div><div id=comments-list>no</div><div class='site-footer'>no</div><p class='widget-2'>no</p></article>", "x"),
        ("<article><div class='post-header'><h1>T</h1></div><p>x</p><div class='post-comments'>no</div></article>", "T\n\nx"),
    ],
)
def test_pages(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("part", ["<" + "a" * 50_000 + '"', "<p " + "a='" * 50_000, "<div>" * 20_000 + "</b></x></span>" * 20_000, "<span class=ad>" * 20_000 + "</i>" * 20_000, "<ul><li>" * 20_000 + "<li>" * 20_000, "<p a" + " " * 200_000 + "=x>y"])
def test_hostile_pages_take_linear_time(part):
    import time

    start = time.process_time()
    html.main_text(part)
    assert time.process_time() - start < 15


# ---------------------------------------------------------------- personal data


def planted_pii(rnd, kind):
    n = lambda a, b: rnd.randrange(a, b)
    name, host = f"{rnd.choice(('jane', 'max', 'li', 'ana'))}.{rnd.choice(('doe', 'roe', 'kim'))}{n(1, 99)}", rnd.choice(("mail", "post", "web")) + str(n(1, 9))
    card = [4, *(n(0, 10) for _ in range(14))]
    card = "".join(map(str, card))
    card += next(c for c in "0123456789" if pii.luhn(card + c))
    ip = [str(n(1, 250)) for _ in range(4)]
    return {
        "email": lambda: rnd.choice((f"{name} [at] {host}.example.com", f"{name}(at){host}(dot)example(dot)org", f"{name} at {host} dot net", f"{name} @ {host}.example.com", f"{name} {{AT}} {host} DOT de")),
        "ip": lambda: rnd.choice(("[.]", " . ", "(dot)", " dot ")).join(ip),
        "card": lambda: rnd.choice((".", "/", "_", " - ", "  ")).join(card[i : i + 4] for i in range(0, 16, 4)),
        "phone": lambda: rnd.choice((f"(555) {n(100, 999)}-{n(1000, 9999)}", f"555-{n(100, 999)}-{n(1000, 9999)}", f"0049 30 {n(100000, 9999999)}", f"01 {n(10, 99)} {n(10, 99)} {n(10, 99)} {n(10, 99)}", f"030/{n(1000000, 9999999)}")),
        "secret": lambda: rnd.choice((f'token = "{rnd.getrandbits(160):040x}"', f"api_key: {rnd.getrandbits(128):032x}", f"SECRET=ghp_{rnd.getrandbits(160):040x}")),
    }[kind]()


CONTEXT = {"email": ("mail me at", "contact", "and then"), "ip": ("login from", "the host", "and then"), "card": ("pay by card", "visa", "and then"), "phone": ("call", "phone", "and then"), "secret": ("with", "and", "set")}
CLEAN = ["look at amazon.com today", "he stayed at home dot that is all", "chapter 4.3.2 of the book", "isbn 978-3-16-148410-0 here", "order 2024 2025 2026 years", "the token was used and the key word is open", "from 1990-1995 to 2000", "version 1 . 2 of it", "a secret: nobody knows", "the password is long enough"]


def test_pii_adds_what_is_spelt_otherwise(spark):
    rnd = random.Random(21)
    rows, want = [], {}
    for k in range(600):
        kind = pii.KINDS[k % 5]
        rows.append((k, f"Some words {rnd.choice(CONTEXT[kind])} {planted_pii(rnd, kind)} and more words here."))
        want[k] = kind
    rows += [(1000 + k, f"Words before {rnd.choice(CLEAN)} and words after.") for k in range(200)]
    # Base spans, which say how reliable the labelers are.
    rows += [(2000 + k, f"mail jane{k}@mail.example.com or call +1 (555) 010-{1000 + k} from 10.1.2.{k % 250} now") for k in range(200)]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in pii.KINDS:
        ids = [k for k, v in want.items() if v == kind]
        found = sum(f"{kind}:" in got[k]["spans"] for k in ids) / len(ids)
        assert found >= 0.9, (kind, found, [dict(rows)[k] for k in ids if f"{kind}:" not in got[k]["spans"]][:5])
    clean = [got[k]["n_spans"] for k in range(1000, 1200)]  # none holds what the format rules find
    assert sum(n > 0 for n in clean) <= 0.05 * len(clean)
    assert all(r["n_spans"] == len([s for s in r["spans"].split(",") if s]) for r in got.values())


def test_free_spans_by_definition():
    rnd = random.Random(3)
    for _ in range(2000):
        make = lambda: sorted((a, 0, a + rnd.randrange(1, 6)) for a in (rnd.randrange(40) for _ in range(rnd.randrange(6))))
        taken, spans = make(), make()
        out = []
        for s in spans:
            if not any(s[0] < b and a < s[2] for a, _, b in taken + out):
                out.append(s)
        assert pii._free(spans, taken) == out


# ---------------------------------------------------------------- shared folder


def test_scratch_tables_can_be_deleted(spark):
    df = common.written(spark.range(5), "kept")
    path = common._scratch[-1]
    assert df.count() == 5
    common.discard(spark, [path])
    assert path not in common._scratch
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_words_and_chunks_of_regular_texts():
    for _a, _b, data, offsets in string_chunks(pa.array([" ".join(PAIRS)])):
        starts, ends, first = word_spans(data, offsets, SPACE)
        assert len(set(span_hashes(data, starts, ends).tolist())) == len(PAIRS) == first[-1]
