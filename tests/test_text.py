import pytest

from lexloom.operators import text
from lexloom.plans import scale
from lexloom.sources import corpus as sources


def docs(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "doc_id bigint, text string")


def words(df, order="pos"):
    return [r["word"] for r in df.orderBy(order).collect()]


def test_tokenize_splits_on_unicode_blanks_and_keeps_order(spark):
    tokens = text.tokenize(docs(spark, " The quick　FOX\n\n", "", "émigré  Été"), ["doc_id"])
    placed = text.token_positions(tokens, ["doc_id", "tok"])
    assert words(placed) == ["the", "quick", "fox", "émigré", "été"]
    assert sorted(r["pos"] for r in placed.collect()) == list(range(5))


def test_empty_corpus(spark):
    prepared = text.preprocess_standard(text.tokenize(docs(spark, "", "  "), ["doc_id"]), ["doc_id", "tok"])
    assert prepared.corpus.count() == 0 and prepared.vocab.count() == 0


def test_rare_words_and_keep_words(spark):
    tokens = text.tokenize(docs(spark, "a a a b b c d_c"), ["doc_id"])
    kept, counts = text.filter_rare_words(tokens, limit=2, keep_words={"c", "absent"})
    assert sorted(words(kept, "tok")) == ["a", "a", "a", "b", "b", "c"]
    assert {r["word"]: r["n"] for r in counts.collect()} == {"a": 3, "b": 2, "c": 1}


def test_standard_frequencies_are_shares_of_the_raw_tokens(spark):
    tokens = text.tokenize(docs(spark, "a a a b b c"), ["doc_id"])
    prepared = text.preprocess_standard(tokens, ["doc_id", "tok"], limit=2, downsample=False)
    assert words(prepared.corpus) == ["a", "a", "a", "b", "b"]
    assert {r["word"]: r["freq"] for r in prepared.vocab.collect()} == {"a": 0.5, "b": 2 / 6}


def test_downsampling_keeps_about_the_expected_share(spark):
    tokens = text.tokenize(docs(spark, *(["x " * 500 + "y " * 20] * 20)), ["doc_id"])
    counts = text.word_counts(tokens)
    thin = text.downsample_common_words(tokens, counts, ["doc_id", "tok"], cutoff=0.01, seed=3)
    left = {r["word"]: r["n"] for r in text.word_counts(thin).collect()}
    share = 10000 / 10400
    assert abs(left["x"] / 10000 - (0.01 / share) ** 0.5) < 0.02
    again = text.downsample_common_words(tokens.repartition(7), counts, ["doc_id", "tok"], cutoff=0.01, seed=3)
    assert thin.exceptAll(again.select(*thin.columns)).count() == 0


def test_partitioned_labels_use_global_counts_and_sum_to_one(spark):
    rows = [(0, "Dog dog. a_c", "2010", 0), (1, "dog cat", "2011", 1), (2, "zz", "2012", 2)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, label string, part int")
    tokens = text.tokenize(table, ["part", "doc_id"], label="label", lowercase=False)
    prepared = text.preprocess_partitioned(tokens, ["doc_id", "tok"], ["part"], limit=2, downsample=False)
    freqs = {(r["word"], r["label"]): r["freq"] for r in prepared.vocab.collect()}
    assert freqs == {("dog", "2010"): 0.5, ("dog", "2011"): 0.5}
    assert [r["label"] for r in text.empty_partitions(table, prepared.corpus).collect()] == ["2012"]
    bare = text.preprocess_partitioned(
        tokens, ["doc_id", "tok"], ["part"], labelled=False, limit=1, downsample=False
    )
    assert {r["label"] for r in bare.corpus.collect()} == {""}


def test_punctuation_may_leave_empty_tokens(spark):
    tokens = text.tokenize(docs(spark, "hi ! there?"), ["doc_id"])
    assert words(text.strip_punctuation(tokens), "tok") == ["hi", "", "there"]
    assert words(text.strip_punctuation(tokens, drop_empty=True), "tok") == ["hi", "there"]


def test_contiguous_split_rebases_positions(spark, text_corpus):
    parts = text.contiguous_split(text_corpus, 840)
    assert [p.count() for p in parts] == [588, 126, 126]
    assert all(p.agg({"pos": "min"}).first()[0] == 0 for p in parts)


def test_lookup_join_beyond_the_broadcast_limit_splits_hot_keys(spark):
    big = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('w', id % 2500)) AS word")
    small = scale.materialise(big.select("word").distinct().selectExpr("word", "length(word) AS len"))
    small = small.where("word <> 'w7'")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = big.join(small, "word", how)
        got = scale.lookup_join(big, small, ["word"], how, limit=64)
        assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_running_total_and_dense_index(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k", "1L AS one")
    indexed = scale.dense_index(df, ["k"], "pos")
    assert indexed.where("pos <> k").count() == 0 and indexed.count() == 1000
    total = scale.running_total(df, ["k"], "one", "upto")
    assert total.where("upto <> k + 1").count() == 0


def test_text_files(spark, tmp_path):
    (tmp_path / "fi.txt").write_text("Moi mitä\nkuuluu\n")
    (tmp_path / "en.b.txt").write_text("hello there\n")
    stream = sources.read_corpus_text(spark, str(tmp_path))
    assert words(stream) == ["hello", "there", "moi", "mitä", "kuuluu"]
    labelled = sources.read_partitioned_files(spark, str(tmp_path))
    assert {(r["label"], r["word"]) for r in labelled.collect()} >= {("fi", "mitä"), ("en.b", "hello")}


def test_the_same_files_are_the_same_corpus(spark, tmp_path):
    """Whatever the splits are and wherever the folder lies: positions and draws agree."""
    names = {"a+b ü.txt": "\n", "sub/c.txt": "\r\n", "z.txt": "\n"}
    for folder in ("one", "two/deeper"):
        for i, (name, end) in enumerate(names.items()):
            file = tmp_path / folder / name
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_bytes(end.join(f"w{i} w{j % 7} é{j}" * (j % 3) for j in range(401)).encode())
    found = []
    for folder in ("one", "two/deeper"):
        for size in ("128m", "1500b", "97b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            try:
                where = str(tmp_path / folder)
                lines = sources.read_lines(spark, where)
                assert [r["line"] for r in lines.where("path = 'z.txt'").orderBy("line").collect()] == list(range(401))
                corpus, vocab = text.preprocess_standard(
                    text.tokenize(sources.read_lines(spark, where + "/*"), sources.LINE_KEY), [*sources.LINE_KEY, "tok"], limit=2, cutoff=0.02
                )
                found.append((sorted(map(tuple, lines.collect())), sorted(map(tuple, corpus.collect())), words(sources.read_corpus_text(spark, where))))
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
                spark.conf.unset("spark.sql.files.openCostInBytes")
    assert all(f == found[0] for f in found)
    assert {r[0] for r in found[0][0]} == {"a+b ü.txt", "z.txt"} and 10 < len(found[0][1]) < len(found[0][2])
    one = sources.read_lines(spark, str(tmp_path / "one" / "z.txt"))
    assert {r["path"] for r in one.select("path").distinct().collect()} == {"z.txt"}


def test_csv_grouped_by_label(spark, tmp_path):
    (tmp_path / "s.csv").write_text('year,speech\n2011,"Well, then. Stop"\n2010,Go on!\n')
    tokens = sources.read_labelled_csv(spark, str(tmp_path / "s.csv"))
    found = [(r["label"], r["word"]) for r in tokens.orderBy("label", "tok").collect()]
    assert found == [("2010", "go"), ("2010", "on!"), ("2011", "wellthenstop")]


def test_similarity_sets(spark, tmp_path):
    (tmp_path / "RG.tsv").write_text("a\tb\t1.5\nc\td\t2\n")
    sets = {"RG": str(tmp_path / "RG.tsv"), "none": str(tmp_path / "none.tsv")}
    found = sources.read_similarity_set(spark, sets, skip_missing=True).collect()
    assert sorted((r["dataset"], r["word1"], r["similarity"]) for r in found) == [("RG", "a", 1.5), ("RG", "c", 2.0)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sources.read_similarity_set(spark, sets)
