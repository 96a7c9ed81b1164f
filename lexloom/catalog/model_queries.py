"""Embedding tables on the documents' vocabulary, likelihoods, gradients and estimation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.catalog import inputs
from lexloom.catalog import sqlparts as sql
from lexloom.catalog import unrolled
from lexloom.catalog.corpus_queries import PARTITIONED
from lexloom.catalog.inputs import corpus, fresh_model, long_vectors, partitioned, r6
from lexloom.catalog.sqlparts import BATCH, DIM, NS, SEED, WS, with_
from lexloom.operators import embedding, gradient, graph, holdout, likelihood, optimise, text, windows
from lexloom.plans import map_fit, scale, vi_fit
from lexloom.sources import models
from lexloom.streaming import partial_fit

QUERIES, SQL = {}, {}
LAMBDA0, LAMBDA1 = 1.0, 2.0


def register(name: str, check: str | None = None):
    def add(query):
        QUERIES[name] = query
        if check is not None:
            SQL[name] = check
        return query

    return add


# --- keys and vectors ------------------------------------------------------------------------

_SHARED = """keys AS MATERIALIZED (
  SELECT word, label, role, row_number() OVER (ORDER BY role, word, label) - 1 AS ix FROM (
    SELECT word, label, 'w' AS role FROM vocab UNION ALL SELECT DISTINCT word, '', 'c' FROM vocab))"""
_KEY = """CASE WHEN label = '' THEN word ELSE word || '_' || label END
  || CASE WHEN role = 'c' THEN '_c' ELSE '' END AS key"""


@register("build_keys_shared", with_(PARTITIONED, _SHARED, select=f"SELECT word, label, role, {_KEY}, ix FROM keys"))
def build_keys_shared(spark, sf_dir):
    return embedding.build_keys_shared(partitioned(spark, sf_dir).vocab)


@register(
    "build_keys_unshared",
    with_(
        PARTITIONED,
        """keys AS (SELECT word, label, role, row_number() OVER (ORDER BY role, word, label) - 1 AS ix
  FROM vocab CROSS JOIN (VALUES ('w'), ('c')) roles(role))""",
        select=f"SELECT word, label, role, {_KEY}, ix FROM keys",
    ),
)
def build_keys_unshared(spark, sf_dir):
    return embedding.build_keys_unshared(partitioned(spark, sf_dir).vocab)


_LONG = f"generate_subscripts(vec, 1) - 1 AS d, {sql.r6('unnest(vec)')} AS value"


@register("init_vectors", with_(sql.CORPUS, sql.KEYS, sql.theta(), select=f"SELECT ix, d, {sql.r6('value')} AS value FROM flat"))
def init_vectors(spark, sf_dir):
    _, vocab, _ = corpus(spark, sf_dir)
    keys = scale.materialise(embedding.build_keys_shared(vocab), "keys")
    return long_vectors(embedding.init_vectors(keys, DIM, SEED), ["ix"])


@register(
    "lookup_vectors",
    with_(sql.CORPUS, sql.KEYS, sql.theta(), sql.VECTORS, select=f"SELECT pos, word AS key, {_LONG} FROM corpus JOIN wvec USING (word)"),
)
def lookup_vectors(spark, sf_dir):
    tokens, vocab, _ = corpus(spark, sf_dir)
    found = embedding.lookup_vectors(fresh_model(vocab), tokens.select("pos", F.col("word").alias("key")))
    return long_vectors(found, ["pos", "key"])


@register(
    "embedding_shape",
    with_(
        PARTITIONED, _SHARED,
        # Shared contexts also answer to the names with a label.
        select=f"SELECT count(*) AS n_rows, {DIM} AS dim, count(*) + (SELECT count(*) FROM vocab WHERE label <> '') AS n_keys FROM keys",
    ),
)
def embedding_shape(spark, sf_dir):
    return embedding.embedding_shape(fresh_model(scale.materialise(partitioned(spark, sf_dir).vocab, "vocab")))


# --- graphs ----------------------------------------------------------------------------------


def _dynamic_model(spark, sf_dir):
    prepared = partitioned(spark, sf_dir)
    labels = graph.consecutive_labels(inputs.source_labels(spark, sf_dir), "part")
    vocab = scale.materialise(prepared.vocab, "vocab")
    edges = graph.chain_graph(vocab, labels)
    model = embedding.new_embedding(vocab, DIM, LAMBDA0, seed=SEED, edges=edges, lambda1=LAMBDA1)
    return prepared.corpus, model


_CHAIN = """labels AS (SELECT label, lead(label) OVER (ORDER BY part) AS next_label
  FROM (SELECT DISTINCT source AS label, substr(source, 4)::INT AS part FROM documents)),
chain AS MATERIALIZED (SELECT a.word, a.label AS label1, b.label AS label2
  FROM vocab a JOIN labels USING (label) JOIN vocab b ON b.word = a.word AND b.label = next_label)"""
_DYNAMIC = ",\n".join([PARTITIONED, _SHARED, sql.theta(), _CHAIN, """edges AS MATERIALIZED (
  SELECT least(a.ix, b.ix) AS src, greatest(a.ix, b.ix) AS dst, 1.0::DOUBLE AS weight FROM chain
  JOIN keys a ON a.word = chain.word AND a.label = label1 AND a.role = 'w'
  JOIN keys b ON b.word = chain.word AND b.label = label2 AND b.role = 'w')""",
"""penalties AS MATERIALIZED (SELECT src, dst, weight * list_sum(list_transform(list_zip(a.vec, b.vec),
    lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS penalty
  FROM edges JOIN theta a ON a.ix = src JOIN theta b ON b.ix = dst)"""])


@register(
    "chain_graph",
    with_(PARTITIONED, _CHAIN, select="SELECT word, label1, label2, word || '_' || label1 AS key1, word || '_' || label2 AS key2 FROM chain"),
)
def chain_graph(spark, sf_dir):
    prepared = partitioned(spark, sf_dir)
    labels = graph.consecutive_labels(inputs.source_labels(spark, sf_dir), "part")
    return graph.chain_graph(scale.materialise(prepared.vocab, "vocab"), labels).drop("weight")


# A graph with words outside the vocabulary: each document token and the one that follows it.
_RAW_EDGES = """edges AS (SELECT DISTINCT a.word AS key1, b.word AS key2 FROM tok a JOIN tok b
  ON b.doc_id = a.doc_id AND b.tok = a.tok + 1)"""


def _neighbours(spark, sf_dir):
    """``(key1, key2)`` of all tokens of a document that follow each other, once each."""
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id is not null")
    twice = scale.materialise(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    # The words of a document are its own rows' only, unless its id is repeated: then a place has several words.
    once = scale.lookup_join(docs, twice, ["doc_id"], how="left_anti")
    words = text.document_words(once, ["doc_id"])
    following = F.zip_with("words", F.slice("words", 2, F.size("words")), lambda a, b: F.struct(a.alias("key1"), b.alias("key2")))
    edges = words.select(F.inline(following)).where("key2 is not null")
    tokens = text.tokenize(scale.lookup_join(docs, twice, ["doc_id"], how="left_semi"), ["doc_id"])
    after = tokens.select("doc_id", (F.col("tok") - 1).alias("tok"), F.col("word").alias("key2"))
    more = tokens.join(after, on=["doc_id", "tok"]).select(F.col("word").alias("key1"), "key2")
    return edges.unionByName(more).distinct()


@register(
    "filter_edges",
    with_(
        sql.CORPUS, sql.KEYS, _RAW_EDGES,
        select="""SELECT DISTINCT 'kept' AS kind, least(a.ix, b.ix) AS src, greatest(a.ix, b.ix) AS dst, NULL AS key
FROM edges JOIN keys a ON a.word = key1 JOIN keys b ON b.word = key2 WHERE a.role = 'w' AND b.role = 'w'
UNION ALL SELECT 'omitted', NULL, NULL, word FROM (SELECT key1 AS word FROM edges UNION SELECT key2 FROM edges)
WHERE word NOT IN (SELECT word FROM keys UNION ALL SELECT word || '_c' FROM keys)""",
    ),
)
def filter_edges(spark, sf_dir):
    _, vocab, _ = corpus(spark, sf_dir)
    keys = scale.materialise(embedding.build_keys_shared(vocab), "keys")
    kept, omitted = graph.filter_edges(scale.materialise(_neighbours(spark, sf_dir), "edges"), keys)
    nothing = F.lit(None)
    return kept.select(F.lit("kept").alias("kind"), "src", "dst", nothing.cast("string").alias("key")).unionByName(
        omitted.select(
            F.lit("omitted").alias("kind"), nothing.cast("bigint").alias("src"), nothing.cast("bigint").alias("dst"), "key"
        )
    )


@register("edge_penalties", with_(_DYNAMIC, select=f"SELECT src, dst, {sql.r6('penalty')} AS penalty FROM penalties"))
def edge_penalties(spark, sf_dir):
    _, model = _dynamic_model(spark, sf_dir)
    found = graph.edge_penalties(model.edges, model.theta, DIM)
    return found.select("src", "dst", r6(F.col("penalty")).alias("penalty"))


# --- probability model -----------------------------------------------------------------------

_NORM = "(SELECT sum(list_dot_product(vec, vec)) FROM theta)"
_SHARE = f"({BATCH}::DOUBLE / size)"


@register(
    "gaussian_log_prior",
    with_(sql.CORPUS, sql.KEYS, sql.theta(), select=f"SELECT {sql.r6(f'-0.5 * {LAMBDA0} * {_NORM} * {_SHARE}')} AS log_prior FROM size"),
)
def gaussian_log_prior(spark, sf_dir):
    _, vocab, size = corpus(spark, sf_dir)
    found = likelihood.gaussian_log_prior(fresh_model(vocab), BATCH, size)
    return found.select(r6(F.col("log_prior")).alias("log_prior"))


_GRAPH_PRIOR = f"-0.5 * ({LAMBDA0} * {_NORM} + {LAMBDA1} * (SELECT sum(penalty) FROM penalties)) * {_SHARE}"


@register(
    "laplacian_log_prior",
    with_(
        _DYNAMIC, "size AS (SELECT count(*) AS size FROM corpus)",
        select=f"SELECT {sql.r6(_GRAPH_PRIOR)} AS log_prior FROM size",
    ),
)
def laplacian_log_prior(spark, sf_dir):
    tokens, model = _dynamic_model(spark, sf_dir)
    found = likelihood.laplacian_log_prior(model, BATCH, windows.corpus_size(tokens))
    return found.select(r6(F.col("log_prior")).alias("log_prior"))


def _encoded_bags(spark, sf_dir, dim=DIM):
    tokens, vocab, size = corpus(spark, sf_dir)
    model = fresh_model(vocab, dim)
    encoded = embedding.encode_corpus(model, tokens)
    bags = windows.example_bags(encoded, size, WS, NS, BATCH, SEED)
    # Every query reads them once, so they are not stored.
    return model, bags, size


def _examples(bags):
    """CBOW examples of the bags, numbered as in ``cbow_examples``."""
    each = bags.select("bag_id", "batch_id", "ctx", F.posexplode(F.arrays_zip("targets", "x")))
    return each.select(
        (F.col("bag_id") * (1 + NS) + F.col("pos")).alias("ex_id"), "batch_id",
        F.col("col.targets").alias("i"), "ctx", F.col("col.x").alias("x"),
    )


_LL = sql.log_sigmoid("(2 * x - 1) * z")
_PAIRS = """scored AS MATERIALIZED (SELECT pos, centres.k, reach.k AS n, w.ix AS iix, v.ix AS jix, x, w.vec AS rho, v.vec AS alpha,
    list_dot_product(w.vec, v.vec) AS z
  FROM centres JOIN reach USING (pos) JOIN wvec w ON w.word = i JOIN cvec v ON v.word = c)"""
SGNS_MODEL = ",\n".join([sql.CORPUS, sql.REACH, sql.CENTRES, sql.KEYS, sql.theta(), sql.VECTORS, _PAIRS])


@register(
    "cbow_log_likelihood",
    with_(sql.MODEL, select=f"SELECT pos * {1 + NS} + k AS ex_id, iix AS i, x, {sql.r6(_LL)} AS log_lik FROM scored"),
)
def cbow_log_likelihood(spark, sf_dir):
    model, bags, _ = _encoded_bags(spark, sf_dir)
    found = likelihood.cbow_log_likelihood(_examples(bags), model.theta, DIM)
    return found.select("ex_id", "i", "x", r6(F.col("log_lik")).alias("log_lik"))


@register(
    "sgns_log_likelihood",
    with_(SGNS_MODEL, select=f"SELECT pos * {1 + NS} + k AS ex_id, iix AS i, jix AS j, x, {sql.r6(_LL)} AS log_lik FROM scored"),
)
def sgns_log_likelihood(spark, sf_dir):
    model, bags, _ = _encoded_bags(spark, sf_dir)
    pairs = windows.sgns_pairs(_examples(bags))
    found = likelihood.sgns_log_likelihood(pairs, model.theta, DIM)
    return found.select("ex_id", "i", "j", "x", r6(F.col("log_lik")).alias("log_lik"))


@register(
    "log_posterior",
    with_(
        sql.MODEL,
        f"fit AS (SELECT sum({_LL}) AS ll, count(*) AS n FROM scored)",
        f"prior AS (SELECT -0.5 * {LAMBDA0} * {_NORM} AS lp)",
        select="SELECT n, round(ll, 4) AS log_lik, round(lp, 6) AS log_prior, round(ll + lp, 4) AS log_posterior FROM fit, prior",
    ),
)
def log_posterior(spark, sf_dir):
    model, bags, size = _encoded_bags(spark, sf_dir)
    found = likelihood.log_posterior(model, _examples(bags), "cbow", size, size)
    return found.select(
        "n", F.round("log_lik", 4).alias("log_lik"), F.round("log_prior", 6).alias("log_prior"),
        F.round("log_posterior", 4).alias("log_posterior"),
    )


def _grad_sql(both: str) -> str:
    """Gradient rows ``grad(ix, g)`` from contributions ``both(ix, vec)``, prior included."""
    prior = LAMBDA0
    return f"""parts AS MATERIALIZED ({both}),
sums AS MATERIALIZED (SELECT ix, {sql.list_sums('vec')} AS g FROM parts GROUP BY ix),
grad AS MATERIALIZED (SELECT theta.ix, theta.vec, list_transform(list_zip(
    coalesce(g, list_resize([0.0::DOUBLE], {DIM}, 0.0::DOUBLE)), theta.vec), lambda p: p[1] - {prior} * p[2]) AS g
  FROM theta LEFT JOIN sums USING (ix))"""


def _scaled(vec: str, factor: str) -> str:
    return f"list_transform({vec}, lambda e: e * ({factor}))"


_ERROR = "(x - 1.0 / (1.0 + exp(-z)))"
_CBOW_GRAD = _grad_sql(
    f"""SELECT iix AS ix, {_scaled('s', _ERROR)} AS vec FROM scored
  UNION ALL SELECT cvec.ix, {_scaled('rho', _ERROR)} FROM scored JOIN reach USING (pos) JOIN cvec ON cvec.word = c"""
)
_SGNS_GRAD = _grad_sql(
    f"""SELECT iix AS ix, {_scaled('alpha', _ERROR)} AS vec FROM scored
  UNION ALL SELECT jix, {_scaled('rho', _ERROR)} FROM scored"""
)
_GRAD_ROWS = f"SELECT ix, generate_subscripts(g, 1) - 1 AS d, {sql.r6('unnest(g)')} AS value FROM grad"


def _gradient(spark, sf_dir, kind, plan=None):
    model, bags, _ = _encoded_bags(spark, sf_dir)
    return model, gradient.posterior_gradient(model, bags, kind, 1.0, plan)


@register("posterior_gradient", with_(sql.MODEL, _CBOW_GRAD, select=_GRAD_ROWS))
def posterior_gradient(spark, sf_dir):
    return long_vectors(_gradient(spark, sf_dir, "cbow")[1], ["ix"], "grad")


@register("posterior_gradient_joined", with_(sql.MODEL, _CBOW_GRAD, select=_GRAD_ROWS))
def posterior_gradient_joined(spark, sf_dir):
    return long_vectors(_gradient(spark, sf_dir, "cbow", "blocks")[1], ["ix"], "grad")


@register("posterior_gradient_sgns", with_(SGNS_MODEL, _SGNS_GRAD, select=_GRAD_ROWS))
def posterior_gradient_sgns(spark, sf_dir):
    return long_vectors(_gradient(spark, sf_dir, "sgns")[1], ["ix"], "grad")


_ADAM = optimise.Adam()
_MOVED = f"p[2] + {_ADAM.learning_rate} * p[1] / (sqrt(p[1] * p[1]) + {_ADAM.epsilon})"


@register(
    "adam_step",
    with_(
        sql.MODEL, _CBOW_GRAD,
        f"moved AS (SELECT ix, list_transform(list_zip(g, vec), lambda p: {_MOVED}) AS vec FROM grad)",
        select=f"SELECT ix, {_LONG} FROM moved",
    ),
)
def adam_step(spark, sf_dir):
    model, grad = _gradient(spark, sf_dir, "cbow")
    state = optimise.with_moments(model.theta, DIM)
    return long_vectors(optimise.adam_step(state, grad, 1, _ADAM), ["ix"])


# --- holdout ---------------------------------------------------------------------------------

_HOLDOUT = sql.MODEL
_TIE = f"sign(round({_LL} - ln(0.5), 12)) / 2 + 0.5"
_FULL = {"kind": "cbow", "ws": WS, "ns": NS, "seed": SEED}


@register("holdout_likelihood", with_(_HOLDOUT, select=f"SELECT {sql.r6(f'avg({_LL})')} AS value, count(*) AS n FROM scored"))
def holdout_likelihood(spark, sf_dir):
    tokens, vocab, _ = corpus(spark, sf_dir)
    found = holdout.holdout_likelihood(fresh_model(vocab), tokens, **_FULL)
    return found.select(r6(F.col("value")).alias("value"), "n")


@register("holdout_accuracy", with_(_HOLDOUT, select=f"SELECT {sql.r6(f'avg({_TIE})')} AS value, count(*) AS n FROM scored"))
def holdout_accuracy(spark, sf_dir):
    tokens, vocab, _ = corpus(spark, sf_dir)
    found = holdout.holdout_accuracy(fresh_model(vocab), tokens, **_FULL)
    return found.select(r6(F.col("value")).alias("value"), "n")


@register(
    "holdout_per_example",
    with_(_HOLDOUT, select=f"SELECT pos * {1 + NS} + k AS ex_id, iix AS i, x, {sql.r6(_LL)} AS value FROM scored"),
)
def holdout_per_example(spark, sf_dir):
    tokens, vocab, _ = corpus(spark, sf_dir)
    found = holdout.holdout_per_example(fresh_model(vocab), tokens, **_FULL)
    return found.select("ex_id", "i", "x", r6(F.col("value")).alias("value"))


# --- estimation ------------------------------------------------------------------------------


def _split(spark, sf_dir):
    tokens, vocab, size = corpus(spark, sf_dir)
    train, valid, _ = text.contiguous_split(tokens, size)
    return tokens, vocab, size, scale.materialise(train, "train"), scale.materialise(valid, "valid")


def _map(model, tokens, size, **options):
    # Two steps per epoch, each over half of the corpus.
    return map_fit.map_estimate(model, tokens, batch_size=-(-size // 2), ws=WS, ns=NS, seed=SEED, **options)


def _fitted(dim: int, parts: list[str], select: str) -> str:
    return with_(sql.CORPUS, sql.KEYS, sql.theta(dim), unrolled.encoded(), *parts, select=select)


_HISTORY = f"SELECT epoch::INT AS epoch, batch::INT AS batch, metric, {sql.r6('value')} AS value, n::BIGINT AS n FROM history"
_NAMED_KEY = "word || CASE WHEN role = 'c' THEN '_c' ELSE '' END AS key"
_CBOW_FIT, _CBOW_STATE = unrolled.map_fit("cbow", 16, 1)
_SGNS_FIT, _ = unrolled.map_fit("sgns", 16, 2)


def _rounded(history):
    return history.select("epoch", "batch", "metric", r6(F.col("value")).alias("value"), "n")


@register("map_estimate", _fitted(16, _CBOW_FIT, f"SELECT {_NAMED_KEY}, {_LONG} FROM {_CBOW_STATE} JOIN keys USING (ix)"))
def map_estimate(spark, sf_dir):
    tokens, vocab, size = corpus(spark, sf_dir)
    return long_vectors(_map(fresh_model(vocab, 16), tokens, size, epochs=1).model.vectors(), ["key"])


_SPLIT_SQL = """bounds AS (SELECT floor(0.7 * size + 1e-9)::BIGINT AS one, floor((0.7 + 0.15) * size + 1e-9)::BIGINT AS two FROM size),
train AS MATERIALIZED (SELECT pos, wix, cix FROM enc, bounds WHERE pos < one),
valid AS MATERIALIZED (SELECT pos - one AS pos, wix, cix FROM enc, bounds WHERE pos >= one AND pos < two)"""
_VALID_FIT, _VALID_STATE = unrolled.map_fit("cbow", 16, 1, "train", valid="valid")


# The norm of the vectors returned shows which state was chosen.
@register(
    "map_estimate_validated",
    _fitted(
        16,
        [
            _SPLIT_SQL,
            *_VALID_FIT,
            "best AS (SELECT arg_max(epoch, value) AS epoch FROM history WHERE metric = 'validation_log_lik')",
            f"""norms AS (SELECT 0 AS epoch, sum(list_dot_product(vec, vec)) AS value, count(*) AS n FROM state_0
  UNION ALL SELECT 1, sum(list_dot_product(vec, vec)), count(*) FROM {_VALID_STATE})""",
        ],
        _HISTORY + f" UNION ALL SELECT NULL, NULL, 'squared_norm', {sql.r6('value')}, n FROM norms JOIN best USING (epoch)",
    ),
)
def map_estimate_validated(spark, sf_dir):
    _, vocab, _, train, valid = _split(spark, sf_dir)
    size = windows.corpus_size(train)
    fit = _map(fresh_model(vocab, 16), train, size, epochs=1, valid=valid, early_stopping=True)
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    kept = fit.model.theta.agg(r6(F.sum(norm)).alias("value"), F.count(F.lit(1)).alias("n"))
    nothing = F.lit(None).cast("int")
    kept = kept.select(nothing.alias("epoch"), nothing.alias("batch"), F.lit("squared_norm").alias("metric"), "value", "n")
    return _rounded(fit.history).unionByName(kept)


@register(
    "training_history",
    _fitted(
        16,
        _SGNS_FIT,
        f"""SELECT epoch::INT AS epoch, {sql.r6('avg(value)')} AS mean_loss, count(*) AS batches, sum(n)::BIGINT AS n
FROM history GROUP BY epoch""",
    ),
)
def training_history(spark, sf_dir):
    tokens, vocab, size = corpus(spark, sf_dir)
    history = map_fit.training_history(_map(fresh_model(vocab, 16), tokens, size, kind="sgns", epochs=2))
    return history.withColumn("mean_loss", r6(F.col("mean_loss")))


_ADJACENT_SQL = """pairs AS MATERIALIZED (
  SELECT a.word AS word1, b.word AS word2, count(*) AS similarity FROM corpus a JOIN corpus b ON b.pos = a.pos + 1 GROUP BY ALL),
named AS MATERIALIZED (SELECT word, vec FROM keys JOIN theta USING (ix) WHERE role = 'w'),
known AS MATERIALIZED (
  SELECT similarity, round(list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))), 9)
    AS cosine FROM pairs JOIN named a ON a.word = word1 JOIN named b ON b.word = word2),
ranks AS (
  SELECT rank() OVER (ORDER BY similarity) + (count(*) OVER (PARTITION BY similarity) - 1) / 2.0 AS rx,
    rank() OVER (ORDER BY cosine) + (count(*) OVER (PARTITION BY cosine) - 1) / 2.0 AS ry FROM known),
rho AS MATERIALIZED (SELECT corr(rx, ry) AS rho, count(*) AS n FROM ranks)"""


@register(
    "similarity_during_training",
    _fitted(
        16,
        [*_CBOW_FIT, _ADJACENT_SQL],
        f"""{_HISTORY} UNION ALL SELECT 0, NULL, 'similarity adjacent', {sql.r6('rho')}, n FROM rho
UNION ALL SELECT 0, NULL, 'similarity', {sql.r6('rho')}, NULL FROM rho""",
    ),
)
def similarity_during_training(spark, sf_dir):
    tokens, vocab, size = corpus(spark, sf_dir)
    pairs = tokens.select(
        F.col("pos"), F.col("word").alias("word1")
    ).join(tokens.select((F.col("pos") - 1).alias("pos"), F.col("word").alias("word2")), on="pos")
    # How often two words stand side by side serves as their gold similarity.
    pairs = pairs.groupBy("word1", "word2").agg(F.count(F.lit(1)).cast("double").alias("similarity"))
    pairs = scale.materialise(pairs.withColumn("dataset", F.lit("adjacent")), "pairs")
    fit = _map(fresh_model(vocab, 16), tokens, size, epochs=1, similarity_pairs=pairs)
    return _rounded(fit.history)


_GRAPH_FIT, _GRAPH_STATE = unrolled.map_fit("cbow", DIM, 1, lambda1=LAMBDA1)


@register("map_estimate_graph", with_(_DYNAMIC, unrolled.encoded(labelled=True), *_GRAPH_FIT, select=_HISTORY))
def map_estimate_graph(spark, sf_dir):
    tokens, model = _dynamic_model(spark, sf_dir)
    return _rounded(_map(model, tokens, windows.corpus_size(tokens), epochs=1).history)


@register(
    "init_variational",
    with_(
        sql.CORPUS, sql.KEYS,
        f"dims AS (SELECT ix, d FROM keys, (SELECT unnest(range({DIM})) AS d))",
        select=f"""SELECT ix, d, round({sql.normal('init-mean', 'ix', 'd')} * 1e-5, 9) + 0.0 AS mean,
round(ln(0.05) + {sql.normal('init-std', 'ix', 'd')} * 1e-5, 9) + 0.0 AS log_std FROM dims""",
    ),
)
def init_variational(spark, sf_dir):
    _, vocab, _ = corpus(spark, sf_dir)
    q = vi_fit.init_variational(fresh_model(vocab), True, 0.05, SEED)
    both = q.select("ix", F.posexplode(F.arrays_zip("mean", "log_std")))
    return both.select(
        "ix", F.col("pos").cast("bigint").alias("d"),
        (F.round("col.mean", 9) + F.lit(0.0)).alias("mean"),
        (F.round("col.log_std", 9) + F.lit(0.0)).alias("log_std"),
    )


_Q = f"""q AS MATERIALIZED (SELECT ix, d, {sql.normal('init-mean', 'ix', 'd')} * 1e-5 AS mean,
    ln(0.05) + {sql.normal('init-std', 'ix', 'd')} * 1e-5 AS log_std
  FROM keys, (SELECT unnest(range({DIM})) AS d))"""
DRAWS = 3


@register(
    "posterior_samples",
    with_(
        sql.CORPUS, sql.KEYS, _Q,
        select=f"""SELECT draw, ix, d, {sql.r6(f"mean + exp(log_std) * {sql.normal('posterior', 'draw', 'ix', 'd')}")} AS value
FROM q, (SELECT unnest(range({DRAWS})) AS draw)""",
    ),
)
def posterior_samples(spark, sf_dir):
    _, vocab, _ = corpus(spark, sf_dir)
    q = vi_fit.init_variational(fresh_model(vocab), True, 0.05, SEED)
    drawn = vi_fit.posterior_samples(q, DIM, DRAWS, SEED)
    return long_vectors(drawn.withColumn("draw", F.col("draw").cast("bigint")), ["draw", "ix"])


_FIXED = f"""fixed AS (SELECT ix, row_number() OVER (ORDER BY n DESC, word) AS keep_dims
  FROM keys JOIN kept USING (word) WHERE role = 'w' QUALIFY keep_dims < {DIM})"""


@register(
    "rotation_mask",
    with_(
        sql.CORPUS, sql.KEYS, _Q, _FIXED,
        select="""SELECT ix, d, CASE WHEN d < coalesce(keep_dims, 1000) THEN round(mean, 9) + 0.0 ELSE 0.0 END AS mean,
CASE WHEN d < coalesce(keep_dims, 1000) THEN round(log_std, 9) + 0.0 ELSE -10.0 END AS log_std
FROM q LEFT JOIN fixed USING (ix)""",
    ),
)
def rotation_mask(spark, sf_dir):
    _, vocab, _ = corpus(spark, sf_dir)
    vocab = scale.materialise(vocab, "vocab")
    model = fresh_model(vocab)
    # The most frequent words fix the rotation, one fewer than there are dimensions.
    words = vocab.orderBy(F.desc("n"), "word").limit(DIM - 1)
    named = [r["word"] for r in words.collect()]
    fixed = vi_fit.fixed_rows(model, named)
    q = optimise.rotation_mask(vi_fit.init_variational(model, True, 0.05, SEED), fixed)
    both = q.select("ix", F.posexplode(F.arrays_zip("mean", "log_std")))
    return both.select(
        "ix", F.col("pos").cast("bigint").alias("d"),
        (F.round("col.mean", 9) + F.lit(0.0)).alias("mean"),
        (F.round("col.log_std", 9) + F.lit(0.0)).alias("log_std"),
    )


_VI_FIT, _VI_STATE = unrolled.vi_fit("cbow", 8, 1)
_VI_TWICE, _ = unrolled.vi_fit("cbow", 8, 2)


def _vi(spark, sf_dir, epochs):
    tokens, vocab, size = corpus(spark, sf_dir)
    return vi_fit.mean_field_vi(
        fresh_model(vocab, 8), tokens, batch_size=-(-size // 2), ws=WS, ns=NS, epochs=epochs, seed=SEED
    )


@register(
    "mean_field_vi",
    _fitted(
        8,
        [*_VI_FIT, f"flat_vi AS (SELECT ix, unnest(mean) AS m, unnest(log_std) AS s, generate_subscripts(mean, 1) - 1 AS d FROM {_VI_STATE})"],
        f"SELECT {_NAMED_KEY}, d, {sql.r6('m')} AS mean, {sql.r6('exp(s)')} AS std FROM flat_vi JOIN keys USING (ix)",
    ),
)
def mean_field_vi(spark, sf_dir):
    fit = _vi(spark, sf_dir, 1)
    std = fit.std.theta.select("ix", F.col("vec").alias("std"))
    both = fit.mean.vectors().join(std, on="ix").select("key", F.posexplode(F.arrays_zip("vec", "std")))
    return both.select(
        "key", F.col("pos").cast("bigint").alias("d"), r6(F.col("col.vec")).alias("mean"), r6(F.col("col.std")).alias("std")
    )


@register("elbo_history", _fitted(8, _VI_TWICE, "SELECT epoch::INT AS epoch, round(elbo, 3) + 0.0 AS elbo FROM elbos"))
def elbo_history(spark, sf_dir):
    history = vi_fit.elbo_history(_vi(spark, sf_dir, 2))
    return history.select("epoch", (F.round("elbo", 3) + F.lit(0.0)).alias("elbo"))


FEED_PARTS, FEED_FILES = 3, 4
_STREAM_FIT, _STREAM_STATE = unrolled.map_fit("sgns", 16, 1, ordered=FEED_PARTS)


@register("partial_fit_stream", _fitted(16, _STREAM_FIT, f"SELECT {_NAMED_KEY}, {_LONG} FROM {_STREAM_STATE} JOIN keys USING (ix)"))
def partial_fit_stream(spark, sf_dir):
    tokens, vocab, size = corpus(spark, sf_dir)
    model = fresh_model(vocab, 16)
    encoded = embedding.encode_corpus(model, tokens)
    third, schema = -(-size // FEED_PARTS), "i bigint, j bigint, x double"
    feed = scale.scratch_path(spark, "feed")
    with scale.scope(spark):
        # The bags are stored, part by part, and not their pairs, which are twelve times as many rows.
        bags = windows.example_bags(encoded, size, WS, NS, BATCH, SEED).withColumn("part", F.floor(F.col("bag_id") / third))
        bags = scale.materialise(bags, "bags", ["part"], few=True)
        # The feed grows part by part, each in as many files as the stream picks up at a time.
        for number in range(FEED_PARTS):
            rows = bags.where(F.col("part") == number).repartition(FEED_FILES, "bag_id")
            with scale.shuffles_deleted(spark):
                windows.sgns_pairs(_examples(rows)).select("i", "j", "x").write.mode("append").parquet(feed)
    pairs = spark.read.schema(schema).parquet(feed).count()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FEED_FILES).parquet(feed)
    folder = scale.scratch_path(spark, "stream")
    partial_fit.partial_fit_stream(model, stream, folder, pairs).awaitTermination()
    return long_vectors(partial_fit.latest_model(spark, model, folder).vectors(), ["key"])


@register(
    "load_graph_embedding",
    with_(_DYNAMIC, select=f"SELECT src, dst, weight, {LAMBDA0}::DOUBLE AS lambda0, {LAMBDA1}::DOUBLE AS lambda1 FROM edges"),
)
def load_graph_embedding(spark, sf_dir):
    _, model = _dynamic_model(spark, sf_dir)
    path = scale.scratch_path(spark, "model")
    models.save_embedding(model, path)
    loaded = models.load_graph_embedding(spark, path)
    return loaded.edges.select(
        "src", "dst", "weight", F.lit(loaded.lambda0).alias("lambda0"), F.lit(loaded.lambda1).alias("lambda1")
    )
