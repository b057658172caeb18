import corpus_pipeline as p
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 0, 0), (15, 0, 1), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "far id the quick brown fox jumps over a lazy dog"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["quality", "line_dedup", "near_dedup", "decontaminate"])
def test_stage_keeps_columns(spark, odd, empty, folder, name):
    stage = dict(p.STAGES)[name]
    out = stage(spark, odd, folder)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    assert out.count() <= odd.count()
    assert stage(spark, empty, folder).count() == 0


def test_near_dedup_keeps_one_of_each_group(spark, odd, folder):
    from floppyscope.llm.simhash import near_duplicates

    out = p.near_dedup(spark, odd, folder)
    assert out.where("doc_id = 2 OR doc_id = 11").count() == 0 and out.where("doc_id = 1 OR doc_id = 4").count() == 2
    groups = near_duplicates(odd.selectExpr("row AS id", "text"), words=p.WORDS).select("component_id").distinct().count()
    assert out.count() == groups


def test_line_dedup_drops_whole_copies_only(spark, folder):
    rows = [(1, "one line here\nand another", "en", "s", 0), (2, "one line here\nand another", "en", "s", 0), (3, "", "en", "s", 0), (4, None, "en", "s", 0), (5, "one line here\nnew", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in p.line_dedup(spark, df, folder).collect()}
    assert got == {1: ("one line here\nand another", 25), 3: ("", 0), 4: (None, None), 5: ("new", 3)}


def test_decontaminate_drops_hits_only(spark, folder):
    rows = [(1, "so far id the quick, brown fox jumps over a lazy dog it is"), (2, "far id the quick brown fox jumps over a dog"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in p.decontaminate(spark, df, folder).orderBy("doc_id").collect()] == [None, 2]


def test_run(spark, odd, folder):
    odd.write.parquet(f"{folder}/documents.parquet")
    out = p.run(spark, folder)
    assert out.columns[0] == "doc_id" and out.count() > 0


def test_near_dedup_finds_similarities_of_80_percent(spark, folder):
    import random

    rnd = random.Random(7)
    texts = []
    for changes in (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12) * 6:
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice((8, 60, 300)))]
        other = list(words)
        for i in rnd.sample(range(len(words)), min(changes * len(words) // 300 + (changes > 0), len(words))):
            other[i] = "changed"
        texts += [" ".join(words), " ".join(other)]
    texts += ["", None, " \n"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert 20 < len(set(root)) < len(texts) - 20
    out = p.near_dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), folder)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(root))
