"""The operators over documents against brute force, on odd rows and on an empty table."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from floppyscope.llm import linededup, lm, pii, quality, simhash, similar, tokenfiles
from floppyscope.llm.common import mix, row_key, scratch_path, string_chunks
from floppyscope.llm.decontaminate import decontaminate
from floppyscope.llm.linededup import MIN_CHARS, dedup
from floppyscope.llm.packing import pack
from floppyscope.llm.tokens import PieceEncoder

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- quality


def quality_base(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = collections.Counter(windows)
    covered = {k for i, w in enumerate(windows) if times[w] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts(spark, odd):
    model = quality.fit(["good words here", "### bad ###"] * 10, [1, 0] * 10)
    got = quality.score_documents(odd, model).collect()
    want = sorted((i is None, i or 0, *quality_base(t)) for i, t in pairs_of(odd))
    assert sorted((r[0] is None, r[0] or 0, *r[1:6]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["p_good"] <= 1


def test_quality_counts_random():
    rnd = random.Random(5)
    for _ in range(500):
        t = "".join(rnd.choice(["a", "b", " ", "\n", "\t", "a b a b a ", "é\x0b", "#|"]) for _ in range(rnd.randrange(60)))
        assert quality.count_base(t) == quality_base(t), repr(t)


def test_quality_learns():
    rnd = random.Random(1)
    good = [" ".join(rnd.choice("alpha beta gamma delta rho sigma".split()) for _ in range(30)) for _ in range(150)]
    bad = [" ".join(rnd.choice("buy cheap $$$ now click ###".split()) for _ in range(30)) for _ in range(150)]
    texts = [t for pair in zip(good, bad) for t in pair]
    model = quality.fit(texts[:200], [1, 0] * 100)
    p = np.concatenate([model.probability(quality.scores(d, o, model)) for _, _, d, o in string_chunks(pa.array(texts[200:]))])
    assert ((p >= 0.5) == np.array([1, 0] * 50, bool)).mean() > 0.97


def test_quality_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit_on_labels(odd, none)
    assert all(r["kept"] != r["base_failed"] for r in quality.score_documents(odd, model).collect())
    assert quality.score_documents(empty, quality.fit_on_labels(empty, none)).count() == 0
    assert quality.keep_good(odd, model).columns == odd.columns


# ---------------------------------------------------------------- language model


def test_lm_scores(spark, odd, monkeypatch):
    rows = pairs_of(odd)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [(i, WORD.findall(t.translate(AZ)) + ["\x20"]) for i, t in rows]
    counts = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((i is None, i or 0, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in tokens)
    for most in (lm.MAX_HEAD, 5):  # all counts broadcast, and rare words joined
        monkeypatch.setattr(lm, "MAX_HEAD", most)
        model = lm.train(odd.where(~lm.is_held_out()))
        got = lm.score(odd, model).collect()
        assert sorted((r[0] is None, r[0] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["score"] < 0 for r in got)


def test_lm_filter_counts():
    grams = mix(np.arange(1, 2001, dtype=np.uint64))
    counts = np.random.default_rng(1).zipf(1.5, 2000).clip(1, 10**6)
    bits = np.frombuffer(lm.fill_segment(grams, counts), np.uint8)
    model = lm.LanguageModel(bits, grams[:0], counts[:0], 1, 1, 1)
    got = model.quantised(grams)
    assert (got >= counts / lm.LOG_BASE).all()  # never under its level
    assert (got <= counts * lm.LOG_BASE * 1.01 + 1e-9).mean() > 0.99
    assert (model.quantised(grams + np.uint64(1)) > 0).mean() < 0.01


def test_lm_empty(empty):
    assert lm.score(empty, lm.train(empty)).count() == 0


# ---------------------------------------------------------------- packing and token files


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    rnd = random.Random(7)
    parts = ["a", "Ab", " ", "\n", "é", "́", " ", "1", "'s", "'S", ".", "!", "=", "̸", "\t", "Σ", "　", "ñ", "ö ", "<|endoftext|>", "|", "-", "\x1c", " ", "😀"]
    texts = ["", " ", "<|endoftext|> a <|startoftext|>x", *("".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(1500))]
    for name, fold in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        own = PieceEncoder(vocabulary(name), fold)
        got = [ids[b - n : b].tolist() for _, ids, c in own.rows(pa.array(texts)) for b, n in zip(np.cumsum(c), c)]
        assert got == [e.ids for e in Tokenizer.from_file(vocabulary(name)).encode_batch(texts, add_special_tokens=False)]


def check_packing(rows, want):
    """Pieces cover each document once, and sequences are gapless; returns the padding."""
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    found = []
    for doc, pieces in by_doc.items():
        found += [(doc is None, doc or 0, r["start"], r["length"], r["doc_tokens"]) for r in pieces]
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= 1024
        padding += 0 if at & at - 1 == 0 else 1024 - at
    assert sum(r["length"] for r in rows) == sum(map(len, want))
    return padding


def test_packing(odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    docs = [(i, [*t.encode(x, add_special_tokens=False).ids, 0]) for i, x in pairs_of(odd)]
    rows = pack(odd, vocabulary("byte_bpe_50k.json")).collect()
    assert check_packing(rows, [ids for _, ids in docs]) == 0
    crc = collections.Counter()
    for i, ids in docs:
        a = np.array(ids, "<u4")
        for r in rows:
            if r["doc_id"] == i and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(a[r["start"] : r["start"] + r["length"]].tobytes()):
                crc[id(ids)] += r["length"]
        assert crc[id(ids)] >= len(ids)
    assert pack(empty, vocabulary("byte_bpe_50k.json")).count() == 0


def test_token_files(spark, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ordered = sorted(((i is not None, i or 0, x), [*t.encode(x, add_special_tokens=False).ids, 2]) for i, x in pairs_of(odd))
    want, at = [], 0
    for (known, i, _), ids in ordered:
        want.append((i if known else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    folder = scratch_path(spark, "test-files")
    got = tokenfiles.read_files(spark, folder, tokenfiles.write_files(odd, folder, vocabulary("word_bpe_49k.json"), fold=True))
    key = lambda r: (r[1], r[2])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    folder = scratch_path(spark, "test-files")
    assert tokenfiles.read_files(spark, folder, tokenfiles.write_files(empty, folder, vocabulary("word_bpe_49k.json"), fold=True)).count() == 0


@pytest.mark.parametrize("n", [1, 5, 127, 128, 129, 1000])
def test_blocks_round_trip(n):
    rnd = np.random.default_rng(n)
    x = rnd.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
    x[rnd.random(n) < 0.7] %= 9
    data, sizes = tokenfiles.encode_blocks(x)
    assert (tokenfiles.decode_blocks(np.frombuffer(data, np.uint8), np.cumsum(sizes) - sizes)[:n] == x).all()


# ---------------------------------------------------------------- near-duplicates


def simhash_of(text, k=4):
    words = WORD.findall(text.translate(AZ))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


def test_simhash(odd, empty):
    rows = pairs_of(odd)
    fps = [simhash_of(t) for _, t in rows]
    label = classes(fps)
    least = {c: min((i for (i, _), x in zip(rows, label) if x == c and i is not None), default=None) for c in set(label)}
    want = sorted(repr((i, f"{f:016x}", least[c])) for (i, _), f, c in zip(rows, fps, label))
    got = simhash.near_duplicates(odd.selectExpr("doc_id AS id", "text"))
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    assert simhash.near_duplicates(empty.selectExpr("doc_id AS id", "text")).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_simhash_links(seed):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(5)]
    fps = []
    for _ in range(rnd.choice([20, 160])):
        x = rnd.choice(base)
        for _ in range(rnd.randrange(7)):
            x ^= 1 << rnd.randrange(64)
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    canon = lambda label: [list(label).index(x) for x in label]
    a = np.array(fps, np.uint64)
    assert canon(simhash.link_large(a).tolist()) == canon(classes(fps))
    keys = simhash.variants(a)
    order = np.argsort(keys.ravel(), kind="stable")
    x, y = simhash.link_buckets(keys.ravel()[order], np.repeat(a, keys.shape[1])[order])
    at = {f: k for k, f in enumerate(fps)}
    label = simhash._roots(len(fps), np.array([at[int(v)] for v in x], int), np.array([at[int(v)] for v in y], int))
    assert canon(label.tolist()) == canon(classes(fps))


def test_simhash_splits_hot_buckets(spark, monkeypatch):
    rnd = random.Random(9)
    fps = set()
    while len(fps) < 400:  # a cluster around one fingerprint, and some strangers
        x = 0x0123456789ABCDEF if len(fps) < 300 else rnd.getrandbits(64)
        for _ in range(rnd.randrange(4)):
            x ^= 1 << rnd.randrange(64)
        fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = classes([f & (1 << 64) - 1 for f in fps])
    for hot in (simhash.HOT, 30):
        monkeypatch.setattr(simhash, "HOT", hot)
        monkeypatch.setattr(simhash, "SAMPLE", 2)
        root = {r["a"]: r["b"] for r in simhash.components(simhash.links(df)).collect()}
        got = [root.get(f, f) for f in fps]
        assert [got.index(x) for x in got] == [want.index(x) for x in want]


def test_components_of_a_long_chain(spark):
    chain = spark.range(1, 300).selectExpr("id AS a", "id - 1 AS b")
    assert {tuple(r) for r in simhash.components(chain).collect()} == {(k, 0) for k in range(1, 300)}


def test_similar_takes_simhash_of_distinct_shingles():
    rnd = random.Random(3)
    sets = [[rnd.getrandbits(64) for _ in range(n)] for n in (1, 0, 4, 5, 255, 256, 2000, 0)]
    h, bounds = np.array([x for s in sets for x in s], np.uint64), np.cumsum([0, *map(len, sets)])
    _key, prints = similar.signatures(h, bounds)
    assert [len(p) for p in prints] == [22, 0, 23, 27, 22, 22, 22, 0]
    assert prints[2][22] == _key[2] and similar.signatures(np.array(sets[3][1:], np.uint64), np.array([0, 4]))[0] in prints[3][22:]
    for s, words in zip(sets, prints):
        hashed = [mix((np.array(s, np.uint64) ^ similar._KEYS[0, k]) * (similar._KEYS[1, k] | np.uint64(1))).tolist() for k in range(22 if s else 0)]
        want = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in word) > len(s)) for word in hashed]
        assert words[:22].tolist() == want
        if s:
            whole = sum(w << 64 * k for k, w in enumerate(want))
            assert similar.segments(words[None, :22])[0].tolist() == [whole >> 20 * k & (1 << 20) - 1 for k in range(70)]


def test_similar_links_segments_with_one_bit_off():
    rnd = random.Random(4)
    base = [rnd.getrandbits(1408) for _ in range(4)]
    prints = []
    for i in range(240):
        x = base[i % 4]
        for _ in range(rnd.choice((1, 200, 350, 500))):
            x ^= 1 << rnd.randrange(1408)
        prints.append(x)
    words = [[x >> 64 * k & (1 << 64) - 1 for k in range(22)] for x in prints]
    rows = next(similar._indexed(iter([pa.record_batch([pa.array(np.array(words, np.uint64).view(np.int64).tolist(), pa.list_(pa.int64()))], ["prints"])])))
    rows = rows.take(pa.array(np.argsort(rows.column(0).to_numpy(), kind="stable")))
    node = np.array([w[0] for w in words], np.uint64).view(np.int64).tolist()
    at = {a: i for i, a in enumerate(node)}
    label = [at[a] for a in node]  # equal first words are one node
    want = list(label)
    for batch in similar._linked(iter([rows.slice(k, 1000) for k in range(0, rows.num_rows, 1000)])):
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            assert a > b
            a, b = label[at[a]], label[at[b]]
            label = [b if x == a else x for x in label]
    want = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            d = prints[i] ^ prints[j]
            if (d & (1 << 192) - 1).bit_count() <= 62 and any((d >> 20 * k & (1 << 20) - 1).bit_count() <= 1 for k in range(70)) and want[i] != want[j]:
                a, b = want[i], want[j]
                want = [b if x == a else x for x in want]
    assert [label.index(x) for x in label] == [want.index(x) for x in want] and 4 < len(set(want)) < 200


def test_near_duplicates_of_five_words(spark, monkeypatch):
    """Pairs of 0.8 and of just less, sets of four and five shingles among them, in whole and split buckets."""
    rnd = random.Random(5)
    texts, want = [], []
    for n, more, alike in [(8, 1, True), (8, 2, False), (12, 2, True), (12, 3, False), (104, 25, True), (104, 26, False)] * 12:
        words = [f"w{rnd.getrandbits(32)}" for _ in range(n + more)]
        texts += [" ".join(words[:n]), " ".join(words)]
        want += [len(want), len(want) + (not alike)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for hot in (simhash.HOT, 1):
        monkeypatch.setattr(simhash, "HOT", hot)
        monkeypatch.setattr(simhash, "SAMPLE", 1)
        got = {r["id"]: (r["component_id"], int(r["fingerprint"], 16)) for r in simhash.near_duplicates(df, words=5).collect()}
        assert [got[i][0] for i in range(len(texts))] == want
        # Fingerprints of near-duplicates are near, too.
        assert all((got[i][1] ^ got[i + 1][1]).bit_count() < 24 for i in range(8, len(texts), 12))


# ---------------------------------------------------------------- decontamination


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def contaminated_of(rows, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    sizes = {len(w) for w in windows}
    for i, t in rows:
        w = bench_words(t)
        hit, ids = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    ids |= {str(x) for x in found if x is not None}
        yield i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_decontaminate(spark, odd, empty):
    rows = pairs_of(odd)
    long = next(t for i, t in rows if i == 10 and len(t) > 1000)
    words = long.split()
    items = [(1, " ".join(words[50:75])), (2, "QUICK, brown"), (3, None), (4, ""), (5, "word"), (2, " ".join(words[60:80])), (None, " ".join(words[400:412])), (7, "no such thing at all in any of these texts, is there"), (10, "a lazy dog while")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(odd, bench).drop("key").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr(r) for r in contaminated_of(rows, items))
    assert not decontaminate(odd, bench.limit(0)).where("contaminated").count()
    assert decontaminate(empty, bench).count() == 0


# ---------------------------------------------------------------- line dedup


def near_lines(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k:] == b[k + 1 :]


def dedup_of(rows):
    """rows: (doc_id, text, key), read in the order of id and key: every line that was read before goes."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][2]))
    first, out = {}, {}
    for k in order:
        text = rows[k][1]
        if text is None:
            out[k] = (None, 0, 0)
            continue
        kept, n, removed = [], 0, 0
        for line in text.split("\n"):
            key = line.strip(" \t\r")
            if not key:
                kept.append(line)
                continue
            n += 1
            near = len(key) >= MIN_CHARS and any(len(o) >= MIN_CHARS and near_lines(key, o) for o in first if o != key)
            if key in first and first[key][0] == "near":
                near = True
            if key in first or near:
                removed += 1
            else:
                kept.append(line)
            first.setdefault(key, ("near" if near else "first",))
        out[k] = ("\n".join(kept), n, removed)
    return [(rows[k][0], *out[k]) for k in range(len(rows))]


LINES = [
    (1, "A line of some length here\nshort\nshort\n\n  A line of some length here \t"),
    (2, "A line of some length hero\nshorT\nA line of some length her\nA line of some length heeere"),
    (3, "xA line of some length here\nB line of some length here\n another one that stands alone here"),
    (4, None), (5, ""), (6, "\n\n"), (None, "A line of some length heRe\nnull id comes first, in a long line"), (7, "null id comes first, in a long line!"),
    (7, "null id comes first, in a long line!"), (12, "twice the same text\n\nin equal rows"), (12, "twice the same text\n\nin equal rows"), (12, "twice the same text\n\nin equal rows"), (8, "z" * 3000 + "\n" + "z" * 2999 + "y\n" + "z" * 3001), (9, "日本語の長い行がここにありますのでどうぞ\n日本語の長い行がここにありますのでどうも\r"),
]


def test_line_dedup(spark, odd, empty):
    for df in (spark.createDataFrame(LINES, "doc_id long, text string").coalesce(1), odd.coalesce(1)):
        rows = [tuple(r) for r in df.select("doc_id", "text", row_key()).collect()]
        got = dedup(df).select("document.doc_id", "document.text", "n_lines", "n_removed").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, dedup_of(rows)))
    assert dedup(empty).count() == 0
    assert dedup(odd).select("document.*").columns == odd.columns


def test_line_dedup_random(spark, monkeypatch):
    monkeypatch.setattr(linededup, "PART", 7)  # lines in several parts
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcde ") for _ in range(rnd.randrange(19, 27))).strip() + "q" for _ in range(25)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rnd.randrange(1, 4)):
            s = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 1, 1, 2])):
                k = rnd.randrange(len(s))
                kind = rnd.randrange(3)
                s[k : k + (kind != 0)] = [] if kind == 1 else [rnd.choice("abcx")]
            lines.append("".join(s))
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rows = [tuple(r) for r in df.select("doc_id", "text", row_key()).collect()]
    got = dedup(df).select("document.doc_id", "document.text", "n_lines", "n_removed").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, dedup_of(rows)))


# ---------------------------------------------------------------- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_of(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": name != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[name]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(odd, empty):
    got = pii.find(odd).collect()
    names = list(PATTERNS)
    want = []
    for i, t in pairs_of(odd):
        spans = pii_of(t)
        base = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        want.append(repr((i, *(sum(k == x for _, k, _ in spans) for x in range(4)), hashlib.sha256(base.encode()).hexdigest())))
    assert sorted(repr(tuple(r)[:6]) for r in got) == sorted(want)
    twelve = next(r for r in got if r["doc_id"] == 12)
    assert [twelve[k] for k in ("n_email", "n_ip", "n_card", "n_phone")] == [1, 1, 1, 1] and twelve["spans"].count(",") == 3
    assert pii.find(empty).count() == 0


def test_pii_base_random():
    rnd = random.Random(2)
    parts = ["1", "23", "255", "256", ".", " ", "-", "+", "(", ")", "@", "a", "b.c", "x@y.z", "4111111111111111", "4111 1111 1111 1111", "+1 (555) 555-1234", "é", "\n", "00"]
    for _ in range(5000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))
        assert pii.base_spans(t)[0] == pii_of(t), repr(t)


def test_pii_added_spans(spark):
    rows = [(k, f"please call (555) 010-{1000 + k} today") for k in range(30)] + [(100 + k, f"phone +1 (555) 010-{2000 + k} now") for k in range(30)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["spans"] for r in got if r["doc_id"] >= 100)
    assert all(r["n_phone"] == 0 and r["spans"].startswith("phone:") for r in got if r["doc_id"] < 100)


def test_pii_reliabilities():
    q = pii.reliabilities([("+++0+", 500), ("-+-0+", 300), ("0+0++", 40), ("0--0-", 60)])
    assert q["+++0+"] > 0.9 and q["0+0++"] > 0.5 and q["0--0-"] < 0.5 and q["-+-0+"] < 0.5


def test_quality_fit_reads_whole_texts(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(("quick", "brown", "hills", "river", "quiet")) for _ in range(600)) + (" zqzqzq junk" * 30 if i % 2 else "")) for i in range(60)]
    assert all(len(t) > 2000 and "zqzqzq" not in t[:2000] for _, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    model = quality.fit_on_labels(df, labels)
    order = [r["doc_id"] for r in df.orderBy(F.xxhash64("doc_id")).collect()]
    want = quality.fit([dict(rows)[i] for i in order], [1 - i % 2 for i in order])
    assert np.array_equal(model.weights, want.weights) and (model.a, model.b) == (want.a, want.b)
    bad, good = (model.probability(quality.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]), model))[0] for t in (b"zqzqzq junk " * 9, b"quiet river hills " * 9))
    assert bad < 0.5 < good
