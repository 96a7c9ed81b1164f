"""Sources, text preprocessing and training examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.catalog import inputs
from lexloom.catalog import sqlparts as sql
from lexloom.catalog.inputs import corpus, document_tokens, partitioned, table
from lexloom.catalog.sqlparts import BATCH, CUTOFF, LIMIT, NS, SEED, WS, with_
from lexloom.functions import hashing
from lexloom.operators import embedding, text, windows
from lexloom.plans import scale
from lexloom.sources import corpus as sources

QUERIES, SQL = {}, {}


def register(name: str, check: str | None = None):
    def add(query):
        QUERIES[name] = query
        if check is not None:
            SQL[name] = check
        return query

    return add


def _count(tokens, *by):
    return tokens.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


# --- sources ---------------------------------------------------------------------------------


@register("read_corpus_text", with_(sql.tokens(), select="SELECT word, count(*) AS n FROM tok GROUP BY word"))
def read_corpus_text(spark, sf_dir):
    path = scale.scratch_path(spark, "texts")
    table(spark, sf_dir, "documents").select("text").write.text(path)
    return _count(sources.read_corpus_text(spark, path), "word")


@register(
    "read_partitioned_files",
    with_(sql.tokens(extra=("lang AS label",)), select="SELECT label, word, count(*) AS n FROM tok GROUP BY ALL"),
)
def read_partitioned_files(spark, sf_dir):
    path = scale.scratch_path(spark, "partitions")
    table(spark, sf_dir, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    return _count(sources.read_partitioned_files(spark, path, "lang=([^/]+)/"), "label", "word")


@register(
    "group_texts_by_label",
    with_(
        sql.tokens(extra=("source AS label",), text=sql.GROUPED_TEXT),
        select="SELECT label, doc_id, tok, word FROM tok",
    ),
)
def group_texts_by_label(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    tokens = sources.group_texts_by_label(docs, "source", ["doc_id"])
    return tokens.select("label", "doc_id", F.col("tok").cast("bigint").alias("tok"), "word")


_GOLD = f"floor({sql.uniform('gold', 'a.vec_id')} * 10)::DOUBLE"
PAIRS = f"""pairs AS MATERIALIZED (
  SELECT 'set' || a.label AS dataset, a.key AS word1, coalesce(b.key, 'none') AS word2, {_GOLD} AS similarity
  FROM named a LEFT JOIN named b ON b.vec_id = a.vec_id + 1)"""


@register("read_similarity_set", with_(sql.NAMED, PAIRS, select="SELECT 'gold' AS dataset, * EXCLUDE (dataset) FROM pairs"))
def read_similarity_set(spark, sf_dir):
    path = scale.scratch_path(spark, "gold")
    pairs = inputs.similarity_pairs(inputs.vector_rows(spark, sf_dir))
    pairs.select("word1", "word2", "similarity").write.option("sep", "\t").csv(path)
    return sources.read_similarity_set(spark, {"gold": path})


# --- text preprocessing ----------------------------------------------------------------------


def _bigint(df, *names):
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


@register("tokenize", with_(sql.tokens(), select="SELECT doc_id, tok, word FROM tok"))
def tokenize(spark, sf_dir):
    return _bigint(document_tokens(spark, sf_dir), "tok").select("doc_id", "tok", "word")


@register(
    "lowercase_tokens",
    with_(sql.tokens(text="text"), select="SELECT doc_id, tok, lower(word) AS word FROM tok"),
)
def lowercase_tokens(spark, sf_dir):
    tokens = text.tokenize(table(spark, sf_dir, "documents"), ["doc_id"], lowercase=False)
    return _bigint(text.lowercase_tokens(tokens), "tok").select("doc_id", "tok", "word")


@register(
    "strip_punctuation", with_(sql.tokens(), select=f"SELECT doc_id, tok, {sql.STRIPPED} AS word FROM tok")
)
def strip_punctuation(spark, sf_dir):
    tokens = text.strip_punctuation(document_tokens(spark, sf_dir))
    return _bigint(tokens, "tok").select("doc_id", "tok", "word")


@register(
    "strip_chars",
    with_(
        sql.tokens(text="lower(translate(text, '_.,:;', ''))"),
        select="SELECT word, count(*) AS n FROM tok GROUP BY word",
    ),
)
def strip_chars(spark, sf_dir):
    docs = text.strip_chars(table(spark, sf_dir, "documents"), "_.,:;")
    return text.word_counts(text.tokenize(docs, ["doc_id"]))


@register(
    "token_positions",
    with_(
        sql.tokens("conversations", "conv_id, turn"),
        select="SELECT row_number() OVER (ORDER BY conv_id, turn, tok) - 1 AS pos, conv_id, turn, tok, word FROM tok",
    ),
)
def token_positions(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    tokens = text.tokenize(turns, ["conv_id", "turn"])
    placed = text.token_positions(tokens, ["conv_id", "turn", "tok"])
    return _bigint(placed, "tok").select("pos", "conv_id", "turn", "tok", "word")


@register("word_counts", with_(sql.tokens(), select="SELECT word, count(*) AS n FROM tok GROUP BY word"))
def word_counts(spark, sf_dir):
    return text.word_counts(document_tokens(spark, sf_dir))


# A kept word that the limit alone would drop: the rarest words of the benchmark texts.
_BENCH = "SELECT DISTINCT unnest(" + sql.split_words("lower(text)") + ") AS word FROM benchmark"


@register(
    "filter_rare_words",
    with_(
        sql.tokens(),
        "counts AS (SELECT word, count(*) AS n FROM tok GROUP BY word)",
        f"extra AS ({_BENCH})",
        select=f"""SELECT doc_id, tok, word FROM tok JOIN counts USING (word)
WHERE n >= {LIMIT} OR word IN (SELECT word FROM extra)""",
    ),
)
def filter_rare_words(spark, sf_dir):
    keep = text.tokenize(table(spark, sf_dir, "benchmark"), ["item_id"]).select("word")
    tokens, _ = text.filter_rare_words(document_tokens(spark, sf_dir), LIMIT, keep)
    return _bigint(tokens, "tok").select("doc_id", "tok", "word")


@register(
    "downsample_common_words",
    with_(sql.tokens(), sql.kept(), sql.thinned(), select="SELECT doc_id, tok, word FROM thin"),
)
def downsample_common_words(spark, sf_dir):
    tokens, counts = text.filter_rare_words(document_tokens(spark, sf_dir), LIMIT)
    thin = text.downsample_common_words(tokens, counts, ["doc_id", "tok"], CUTOFF, SEED)
    return _bigint(thin, "tok").select("doc_id", "tok", "word")


@register(
    "preprocess_standard",
    with_(
        sql.CORPUS,
        "raw AS (SELECT count(*)::DOUBLE AS raw FROM tok)",
        select=f"SELECT pos, word, n, round(n / raw, 9) AS freq FROM corpus JOIN kept USING (word), raw",
    ),
)
def preprocess_standard(spark, sf_dir):
    tokens, vocab, _ = corpus(spark, sf_dir)
    joined = scale.lookup_join(tokens, scale.materialise(vocab.drop("label"), "vocab"), ["word"])
    return joined.select("pos", "word", "n", F.round("freq", 9).alias("freq"))


PART = ("source AS label", "substr(source, 4)::INT AS part")
PARTITIONED = f"""{sql.tokens(extra=PART, text='text')},
clean AS MATERIALIZED (SELECT doc_id, label, part, tok, translate(lower(word), '.,!?', '') AS word FROM tok),
{sql.kept(source='clean')},
{sql.thinned(columns='doc_id, label, part, tok, word', source='clean')},
corpus AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY part, doc_id, tok) - 1 AS pos, word, label FROM thin),
entries AS MATERIALIZED (SELECT word, label, n FROM (SELECT DISTINCT word, label FROM corpus) JOIN kept USING (word)),
vocab AS (SELECT word, label, n, n / (SELECT sum(n)::DOUBLE FROM entries) AS freq FROM entries)"""


@register("label_tokens", with_(sql.tokens(extra=("lang AS label",)), select="SELECT doc_id, tok, word || '_' || label AS key FROM tok"))
def label_tokens(spark, sf_dir):
    tokens = text.tokenize(table(spark, sf_dir, "documents"), ["doc_id"], label="lang")
    return _bigint(text.label_tokens(tokens), "tok").select("doc_id", "tok", "key")


EMPTY_LIMIT = 400


@register(
    "empty_partitions",
    with_(
        sql.tokens("conversations", "conv_id, turn"),
        "counts AS (SELECT word, count(*) AS n FROM tok GROUP BY word)",
        select=f"""SELECT DISTINCT conv_id::VARCHAR AS label FROM conversations WHERE conv_id NOT IN (
  SELECT conv_id FROM tok JOIN counts USING (word) WHERE n >= {EMPTY_LIMIT})""",
    ),
)
def empty_partitions(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    tokens = text.tokenize(turns, ["conv_id", "turn"], label="conv_id")
    left, _ = text.filter_rare_words(tokens, EMPTY_LIMIT)
    return text.empty_partitions(turns.select(F.col("conv_id").cast("string").alias("label")), left)


@register(
    "partitioned_frequencies", with_(PARTITIONED, select="SELECT word, label, n, round(freq, 9) AS freq FROM vocab")
)
def partitioned_frequencies(spark, sf_dir):
    return partitioned(spark, sf_dir).vocab.withColumn("freq", F.round("freq", 9))


@register(
    "preprocess_partitioned",
    with_(PARTITIONED, select="SELECT pos, word || '_' || label AS key, round(freq, 9) AS freq FROM corpus JOIN vocab USING (word, label)"),
)
def preprocess_partitioned(spark, sf_dir):
    prepared = partitioned(spark, sf_dir)
    joined = scale.lookup_join(text.label_tokens(prepared.corpus), prepared.vocab, ["word", "label"])
    return joined.select("pos", "key", F.round("freq", 9).alias("freq"))


@register(
    "contiguous_split",
    with_(
        sql.CORPUS,
        "cuts AS (SELECT size, floor(0.7 * size)::BIGINT AS a, floor(0.85 * size)::BIGINT AS b FROM size)",
        select="""SELECT CASE WHEN pos < a THEN 'train' WHEN pos < b THEN 'valid' ELSE 'test' END AS part,
  pos - CASE WHEN pos < a THEN 0 WHEN pos < b THEN a ELSE b END AS pos, word FROM corpus, cuts""",
    ),
)
def contiguous_split(spark, sf_dir):
    tokens, _, size = corpus(spark, sf_dir)
    parts = text.contiguous_split(tokens, size)
    train, valid, test = (
        p.select(F.lit(name).alias("part"), "pos", "word") for name, p in zip(("train", "valid", "test"), parts)
    )
    return train.unionByName(valid).unionByName(test)


# --- training examples -----------------------------------------------------------------------

_WINDOW = "string_agg(c, ' ' ORDER BY k) AS ctx"


@register(
    "context_windows",
    with_(sql.CORPUS, sql.REACH, select=f"SELECT pos, word, {_WINDOW} FROM reach GROUP BY pos, word"),
)
def context_windows(spark, sf_dir):
    tokens, _, size = corpus(spark, sf_dir)
    found = windows.context_windows(tokens, WS, size)
    return found.select("pos", "word", F.concat_ws(" ", "ctx").alias("ctx"))


@register(
    "negative_samples",
    with_(sql.CORPUS, sql.CENTRES, select="SELECT pos, k::BIGINT AS k, drawn, word FROM negatives"),
)
def negative_samples(spark, sf_dir):
    tokens, _, size = corpus(spark, sf_dir)
    return _bigint(windows.negative_samples(tokens, tokens, size, NS, SEED), "k")


@register(
    "negative_pool",
    with_(
        sql.CORPUS,
        "bench AS (SELECT item_id, " + sql.split_words("lower(text)") + " AS w FROM benchmark)",
        "words AS (SELECT item_id, generate_subscripts(w, 1) AS tok, unnest(w) AS word FROM bench)",
        "pool AS MATERIALIZED (SELECT row_number() OVER (ORDER BY item_id, tok) - 1 AS pos, word FROM words)",
        "pool_size AS (SELECT count(*) AS size FROM pool)",
        sql.negatives("pool", "pool_size"),
        select="SELECT pos, k::BIGINT AS k, drawn, word FROM negatives",
    ),
)
def negative_pool(spark, sf_dir):
    tokens, _, _ = corpus(spark, sf_dir)
    bench = text.tokenize(table(spark, sf_dir, "benchmark"), ["item_id"])
    pool = text.token_positions(bench, ["item_id", "tok"])
    drawn = windows.negative_samples(tokens, pool, windows.corpus_size(pool), NS, SEED)
    return _bigint(drawn, "k")


_EXAMPLE_ID = f"pos * {1 + NS} + centres.k"


@register(
    "cbow_examples",
    with_(
        sql.CORPUS, sql.REACH, sql.CENTRES,
        f"wide AS MATERIALIZED (SELECT pos, {_WINDOW} FROM reach GROUP BY pos)",
        select=f"""SELECT {_EXAMPLE_ID} AS ex_id, pos // {BATCH} AS batch_id, i, ctx, x
FROM centres JOIN wide USING (pos)""",
    ),
)
def cbow_examples(spark, sf_dir):
    tokens, _, size = corpus(spark, sf_dir)
    found = windows.cbow_examples(tokens, size, WS, NS, BATCH, SEED)
    return found.withColumn("ctx", F.concat_ws(" ", "ctx"))


SGNS_SQL = with_(
    sql.CORPUS, sql.REACH, sql.CENTRES,
    select=f"""SELECT {_EXAMPLE_ID} AS ex_id, pos // {BATCH} AS batch_id, i, c AS j, x
FROM centres JOIN reach USING (pos)""",
)


@register("sgns_pairs", SGNS_SQL)
def sgns_pairs(spark, sf_dir):
    tokens, _, size = corpus(spark, sf_dir)
    return windows.sgns_pairs(windows.cbow_examples(tokens, size, WS, NS, BATCH, SEED))


@register(
    "generate_examples",
    with_(
        sql.CORPUS, sql.REACH, sql.CENTRES,
        select="SELECT i, c AS j, x, count(*) AS n FROM centres JOIN reach USING (pos) GROUP BY ALL",
    ),
)
def generate_examples(spark, sf_dir):
    tokens, _, size = corpus(spark, sf_dir)
    pairs = windows.generate_examples(tokens, size, "sgns", by_centre=True, ws=WS, ns=NS, batch_size=BATCH, seed=SEED)
    return _count(pairs, "i", "j", "x")


@register(
    "mark_context_role",
    with_(
        sql.CORPUS, sql.REACH, sql.KEYS,
        select="""SELECT pos, word || '' AS i, c || '_c' AS j, w.ix AS i_ix, v.ix AS j_ix
FROM reach JOIN keys w USING (word) JOIN keys v ON v.word = c WHERE w.role = 'w' AND v.role = 'c'""",
    ),
)
def mark_context_role(spark, sf_dir):
    tokens, vocab, size = corpus(spark, sf_dir)
    keys = scale.materialise(embedding.build_keys_shared(vocab), "keys")
    pairs = windows.context_windows(tokens, WS, size).select("pos", "word", F.explode("ctx").alias("c"))
    named = {
        "w": keys.where("role = 'w'").select("word", F.col("key").alias("i"), F.col("ix").alias("i_ix")),
        "c": keys.where("role = 'c'").select(
            F.col("word").alias("c"), F.col("key").alias("j"), F.col("ix").alias("j_ix")
        ),
    }
    found = scale.lookup_join(scale.lookup_join(pairs, named["w"], ["word"]), named["c"], ["c"])
    return found.select("pos", "i", "j", "i_ix", "j_ix")


@register(
    "assign_batches",
    with_(
        sql.CORPUS,
        f"ids AS (SELECT unnest(range((size + {BATCH - 1}) // {BATCH})) AS batch_id FROM size)",
        f"""turns AS (SELECT batch_id, row_number() OVER (
    ORDER BY {sql.uniform('batch', "'0'", 'batch_id')}, batch_id) - 1 AS turn FROM ids)""",
        select=f"SELECT pos, batch_id, turn FROM corpus JOIN turns ON batch_id = pos // {BATCH}",
    ),
)
def assign_batches(spark, sf_dir):
    tokens, _, size = corpus(spark, sf_dir)
    return windows.assign_batches(tokens, size, BATCH, 0, SEED).select("pos", "batch_id", "turn")


@register(
    "external_examples",
    with_(
        sql.CORPUS, sql.KEYS,
        select=f"""SELECT w.ix AS i, v.ix AS j, ({sql.uniform('outcome', 'a.pos')} < 0.25)::DOUBLE AS x, a.pos
FROM (SELECT pos, word, (pos + 1) % size AS seen FROM corpus, size) a JOIN corpus b ON b.pos = seen
JOIN keys w ON w.word = a.word JOIN keys v ON v.word = b.word WHERE w.role = 'w' AND v.role = 'c'""",
    ),
)
def external_examples(spark, sf_dir):
    tokens, vocab, size = corpus(spark, sf_dir)
    keys = scale.materialise(embedding.build_keys_shared(vocab), "keys")
    after = tokens.select(F.pmod(F.col("pos") - 1, F.lit(size)).alias("pos"), F.concat("word", F.lit("_c")).alias("j"))
    outcome = (hashing.uniform(SEED, "outcome", F.col("pos")) < 0.25).cast("double")
    supplied = tokens.join(after, on="pos").select(F.col("word").alias("i"), "j", outcome.alias("x"), "pos")
    return windows.external_examples(supplied, keys)
