"""Operators on ready vectors: the ``embeddings`` table as a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.catalog import inputs
from lexloom.catalog import sqlparts as sql
from lexloom.catalog.corpus_queries import PAIRS
from lexloom.catalog.inputs import long_vectors, r6, vector_model, vector_rows
from lexloom.catalog.sqlparts import NAMED, with_
from lexloom.operators import align as alignment
from lexloom.operators import embedding, neighbours, similarity
from lexloom.plans import scale
from lexloom.sources import models

QUERIES, SQL = {}, {}
D = inputs.EMBEDDING_DIM


def register(name: str, check: str | None = None):
    def add(query):
        QUERIES[name] = query
        if check is not None:
            SQL[name] = check
        return query

    return add


def _long(vec: str) -> str:
    return f"generate_subscripts({vec}, 1) - 1 AS d, {sql.r6(f'unnest({vec})')} AS value"


_ALL = with_(NAMED, select=f"SELECT key, {_long('vec')} FROM named")


# --- storage and table operators -------------------------------------------------------------


@register("save_embedding", with_(NAMED, select="SELECT key, word, label, 'w' AS role, ix FROM named"))
def save_embedding(spark, sf_dir):
    path = scale.scratch_path(spark, "model")
    models.save_embedding(vector_model(vector_rows(spark, sf_dir)), path)
    return spark.read.parquet(f"{path}/keys").select("key", "word", "label", "role", "ix")


@register("load_embedding", _ALL)
def load_embedding(spark, sf_dir):
    path = scale.scratch_path(spark, "model")
    models.save_embedding(vector_model(vector_rows(spark, sf_dir)), path)
    return long_vectors(models.load_embedding(spark, path).vectors(), ["key"])


@register("export_json", _ALL)
def export_json(spark, sf_dir):
    path = scale.scratch_path(spark, "json")
    models.export_json(vector_model(vector_rows(spark, sf_dir)), path)
    return long_vectors(spark.read.schema("key string, vec array<double>").json(f"{path}/vectors"), ["key"])


@register(
    "update_vectors",
    with_(
        NAMED,
        select=f"""SELECT key, d, {sql.r6('value')} AS value FROM (
  SELECT key, generate_subscripts(vec, 1) - 1 AS d,
    unnest(CASE WHEN doc_id IS NULL THEN vec ELSE list_reverse(vec) END) AS value
  FROM named LEFT JOIN labels ON doc_id = vec_id)""",
    ),
)
def update_vectors(spark, sf_dir):
    rows = vector_rows(spark, sf_dir)
    named = inputs.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"))
    new = rows.join(named, on="vec_id").select("key", F.reverse("vec").alias("vec"))
    return long_vectors(embedding.update_vectors(vector_model(rows), new).vectors(), ["key"])


@register(
    "contains",
    with_(
        NAMED,
        "asked AS (SELECT doc_id, doc_id || '_' || (doc_id % 10) AS key FROM documents)",
        select="SELECT doc_id, key, key IN (SELECT key FROM named) AS known FROM asked",
    ),
)
def contains(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    asked = docs.select("doc_id", F.concat_ws("_", "doc_id", F.col("doc_id") % 10).alias("key"))
    return embedding.contains(vector_model(vector_rows(spark, sf_dir)), asked).select("doc_id", "key", "known")


# --- similarity ------------------------------------------------------------------------------

_SIMS = f"""sims AS MATERIALIZED (
  SELECT dataset, word1, word2, similarity, list_cosine_similarity(a.vec, b.vec) AS cosine
  FROM pairs LEFT JOIN named a ON a.key = word1 LEFT JOIN named b ON b.key = word2)"""


def _pairs_and_model(spark, sf_dir):
    rows = vector_rows(spark, sf_dir)
    return scale.materialise(inputs.similarity_pairs(rows), "pairs"), vector_model(rows)


@register("embedding_similarities", with_(NAMED, PAIRS, _SIMS, select=f"SELECT word1, word2, {sql.r6('cosine')} AS cosine FROM sims"))
def embedding_similarities(spark, sf_dir):
    found = similarity.embedding_similarities(*_pairs_and_model(spark, sf_dir))
    return found.select("word1", "word2", r6(F.col("cosine")).alias("cosine"))


@register(
    "cosine_distance",
    with_(NAMED, PAIRS, _SIMS, select=f"SELECT word1, word2, {sql.r6('1.0 - cosine')} AS distance FROM sims WHERE cosine IS NOT NULL"),
)
def cosine_distance(spark, sf_dir):
    found = similarity.cosine_distance(*_pairs_and_model(spark, sf_dir))
    return found.select("word1", "word2", r6(F.col("distance")).alias("distance"))


_RHO = """known AS (SELECT dataset, similarity, round(cosine, 9) AS cosine FROM sims WHERE cosine IS NOT NULL),
ranks AS (SELECT dataset,
    rank() OVER (PARTITION BY dataset ORDER BY similarity) + (count(*) OVER (PARTITION BY dataset, similarity) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY dataset ORDER BY cosine) + (count(*) OVER (PARTITION BY dataset, cosine) - 1) / 2.0 AS ry
  FROM known),
rho AS (SELECT dataset, corr(rx, ry) AS rho, count(*) AS n FROM ranks GROUP BY dataset)"""


@register(
    "evaluate_word_similarity",
    with_(NAMED, PAIRS, _SIMS, _RHO, select=f"SELECT dataset, {sql.r6('rho')} AS rho, n FROM rho"),
)
def evaluate_word_similarity(spark, sf_dir):
    found = similarity.evaluate_word_similarity(*_pairs_and_model(spark, sf_dir))
    return found.select("dataset", r6(F.col("rho")).alias("rho"), "n")


# With t = sin^2 the incomplete beta function of the p-value is an integral of a power of the sine, taken by Simpson's rule.
_SIMPSON = 2000


def _sine_integral(to: str) -> str:
    weight = f"CASE WHEN i = 0 OR i = {_SIMPSON} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    each = f"list_transform(range(0, {_SIMPSON + 1}), lambda i: {weight} * pow(sin(i * {to} / {_SIMPSON}), n - 3))"
    return f"({to} / {_SIMPSON} / 3 * list_sum({each}))"


@register(
    "word_similarity_p_values",
    with_(
        NAMED, PAIRS, _SIMS, _RHO,
        select=f"""SELECT dataset, {sql.r6('rho')} AS rho, n, CASE WHEN rho IS NOT NULL AND n >= 3 THEN
  {sql.r6(_sine_integral('asin(sqrt(1 - rho * rho))') + ' / ' + _sine_integral('(pi() / 2)'))} END AS p_value FROM rho""",
    ),
)
def word_similarity_p_values(spark, sf_dir):
    found = similarity.evaluate_word_similarity(*_pairs_and_model(spark, sf_dir))
    return found.select("dataset", r6(F.col("rho")).alias("rho"), "n", r6(F.col("p_value")).alias("p_value"))


@register(
    "weighted_similarity",
    with_(NAMED, PAIRS, _SIMS, _RHO, select=f"SELECT {sql.r6('sum(rho * n) / sum(n)')} AS weighted_rho FROM rho"),
)
def weighted_similarity(spark, sf_dir):
    scores = similarity.evaluate_word_similarity(*_pairs_and_model(spark, sf_dir))
    found = similarity.weighted_similarity(scores)
    return found.select(r6(F.col("weighted_rho")).alias("weighted_rho"))


# --- neighbours ------------------------------------------------------------------------------

K = 10
# The query words are the vectors of the documents that have a row in ``labels``.
_NEIGHBOURS = f"""asked AS (SELECT named.* FROM named SEMI JOIN labels ON doc_id = vec_id),
others AS (SELECT named.* FROM named ANTI JOIN labels ON doc_id = vec_id),
scores AS (SELECT a.key AS target, b.key AS word, round(list_cosine_similarity(a.vec, b.vec), 9) AS score
  FROM asked a CROSS JOIN others b),
best AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, word) AS rank
  FROM scores QUALIFY rank <= {K})"""


def _asked(spark, sf_dir, rows):
    named = inputs.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"))
    return rows.join(named, on="vec_id", how="left_semi").select("key")


@register(
    "nearest_neighbors",
    with_(NAMED, _NEIGHBOURS, select=f"SELECT target, rank, word, {sql.r6('score')} AS score FROM best"),
)
def nearest_neighbors(spark, sf_dir):
    rows = vector_rows(spark, sf_dir)
    found = neighbours.nearest_neighbors(vector_model(rows), _asked(spark, sf_dir, rows), K)
    return found.select("target", F.col("rank").cast("bigint").alias("rank"), "word", r6(F.col("score")).alias("score"))


@register(
    "nearest_neighbors_joined",
    with_(NAMED, _NEIGHBOURS, select=f"SELECT target, rank, word, {sql.r6('score')} AS score FROM best"),
)
def nearest_neighbors_joined(spark, sf_dir):
    """The plan for queries that are too many to send to every task."""
    rows = vector_rows(spark, sf_dir)
    found = neighbours.nearest_neighbors(vector_model(rows), _asked(spark, sf_dir, rows), K, limit=1)
    return found.select("target", F.col("rank").cast("bigint").alias("rank"), "word", r6(F.col("score")).alias("score"))


_WIDE = ", ".join(f"max(word) FILTER (rank = {r}) AS \"@{r}\"" for r in range(1, K + 1))


@register("nearest_neighbors_wide", with_(NAMED, _NEIGHBOURS, select=f"SELECT target, {_WIDE} FROM best GROUP BY target"))
def nearest_neighbors_wide(spark, sf_dir):
    rows = vector_rows(spark, sf_dir)
    return neighbours.nearest_neighbors(vector_model(rows), _asked(spark, sf_dir, rows), K, wide=True)


def _chain(name: str, steps: int) -> str:
    return f"{name} LEFT JOIN named n{steps} ON n{steps}.vec_id = named.vec_id + {steps}"


_ANALOGY = with_(
    NAMED,
    """asked AS (SELECT a.vec_id AS row_id, a.key AS w1, b.key AS w2, c.key AS w3, d.key AS w4,
    list_transform(list_zip(a.vec, b.vec, c.vec), lambda p: p[1] - p[2] + p[3]) AS aim
  FROM named a JOIN named b ON b.vec_id = a.vec_id + 1 JOIN named c ON c.vec_id = a.vec_id + 2
  JOIN named d ON d.vec_id = a.vec_id + 3)""",
    """scores AS (SELECT row_id, w1, w2, w3, w4, n.key AS word,
    round(list_dot_product(list_transform(aim, lambda e: e / sqrt(list_dot_product(aim, aim))), n.vec), 9) AS score
  FROM asked CROSS JOIN named n)""",
    f"""best AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, word) AS rank
  FROM scores QUALIFY rank <= {K})""",
    select="""SELECT row_id, w1, w2, w3, w4, string_agg(word, ' ' ORDER BY rank) AS guesses,
bool_or(word = w4) AS correct FROM best GROUP BY ALL""",
)


def _analogies(spark, sf_dir, limit=None):
    rows = vector_rows(spark, sf_dir)
    asked = inputs.following(rows, 3).select(
        F.col("vec_id").alias("row_id"), F.col("key").alias("w1"), F.col("next1").alias("w2"),
        F.col("next2").alias("w3"), F.col("next3").alias("w4"),
    )
    found = neighbours.evaluate_analogy(vector_model(rows), scale.materialise(asked, "asked"), K, limit=limit)
    return found.withColumn("guesses", F.concat_ws(" ", "guesses"))


@register("evaluate_analogy", _ANALOGY)
def evaluate_analogy(spark, sf_dir):
    return _analogies(spark, sf_dir)


@register("evaluate_analogy_joined", _ANALOGY)
def evaluate_analogy_joined(spark, sf_dir):
    return _analogies(spark, sf_dir, 1)


def _bli(source: str, target: str) -> str:
    return with_(
        NAMED,
        f"""lexicon AS (SELECT {source}.key AS source, {target}.key AS target, {source}.vec AS vec, {target}.label AS grp
  FROM named a JOIN named b ON b.vec_id = a.vec_id + 1)""",
        """scores AS (SELECT source, target, n.key AS word, round(list_cosine_similarity(lexicon.vec, n.vec), 9) AS score
  FROM lexicon JOIN named n ON n.label = grp)""",
        """best AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY score DESC, word) AS rank
  FROM scores QUALIFY rank <= 15)""",
        select="""SELECT source, target, string_agg(word, ' ' ORDER BY rank) AS guesses,
bool_or(word = target AND rank <= 1) AS "p@1", bool_or(word = target AND rank <= 5) AS "p@5",
bool_or(word = target) AS "p@15" FROM best GROUP BY source, target""",
    )


def _lexicon(rows):
    pairs = inputs.following(rows, 1).select(F.col("key").alias("source"), F.col("next1").alias("target"))
    return scale.materialise(pairs, "lexicon")


def _induced(spark, sf_dir, reverse, limit=None):
    rows = vector_rows(spark, sf_dir)
    found = neighbours.bilingual_lexicon_induction(_lexicon(rows), vector_model(rows), reverse=reverse, limit=limit)
    return found.withColumn("guesses", F.concat_ws(" ", "guesses"))


@register("bilingual_lexicon_induction", _bli("a", "b"))
def bilingual_lexicon_induction(spark, sf_dir):
    return _induced(spark, sf_dir, False)


@register("bilingual_lexicon_induction_joined", _bli("a", "b"))
def bilingual_lexicon_induction_joined(spark, sf_dir):
    return _induced(spark, sf_dir, False, 1)


@register("bli_reverse", _bli("b", "a"))
def bli_reverse(spark, sf_dir):
    return _induced(spark, sf_dir, True)


@register(
    "bli_skipped_pairs",
    with_(
        NAMED,
        """pairs AS (SELECT a.key AS source, coalesce(b.key, 'none') AS target
  FROM named a LEFT JOIN named b ON b.vec_id = a.vec_id + 1)""",
        select="""SELECT source, target FROM pairs
WHERE source NOT IN (SELECT key FROM named) OR target NOT IN (SELECT key FROM named)""",
    ),
)
def bli_skipped_pairs(spark, sf_dir):
    rows = vector_rows(spark, sf_dir)
    return neighbours.bli_skipped_pairs(_lexicon(rows), vector_model(rows))


# --- relations between models ----------------------------------------------------------------


def _mirrored(spark, sf_dir):
    """The vectors, and the same vectors with their elements in reverse order (a rotation)."""
    rows = vector_rows(spark, sf_dir)
    return vector_model(rows, contexts=True), vector_model(rows, F.reverse("vec"), contexts=True)


@register(
    "cross_product",
    with_(
        NAMED,
        """flat AS (SELECT vec_id, d, list_reverse(vec)[d + 1] AS ref, vec[d + 1] AS own
  FROM named, (SELECT unnest(range(64)) AS d))""",
        select=f"""SELECT a.d AS d1, b.d AS d, {sql.r6('sum(a.ref * b.own)')} AS value
FROM flat a JOIN flat b USING (vec_id) GROUP BY a.d, b.d""",
    ),
)
def cross_product(spark, sf_dir):
    model, mirror = _mirrored(spark, sf_dir)
    words = model.keys.where("role = 'w'").select("key", F.col("key").alias("key_reference"))
    pairs = alignment.paired_vectors(mirror, model, words)
    return long_vectors(alignment.cross_product(pairs, D), ["d1"], "row")


@register("align", with_(NAMED, select=f"SELECT key, {_long('list_reverse(vec)')} FROM named"))
def align(spark, sf_dir):
    # A model turned into its mirror image must come out as the mirror image itself.
    model, mirror = _mirrored(spark, sf_dir)
    words = model.keys.where("role = 'c'").select("key")
    return long_vectors(alignment.align(mirror, model, words).vectors("w"), ["key"])


@register(
    "alignment_checks",
    with_(
        NAMED,
        select=f"""SELECT count(*) AS n_words, count(*) FILTER (vec_id IS NULL) AS n_missing,
count(*) FILTER (vec_id IS NULL) AS n_missing_reference, {D} AS dim, {D} AS dim_reference,
count(*) >= {(D - 1) / 2} AS determined
FROM labels LEFT JOIN named ON named.vec_id = doc_id AND named.label = (doc_id % 10)::VARCHAR""",
    ),
)
def alignment_checks(spark, sf_dir):
    model, mirror = _mirrored(spark, sf_dir)
    labels = inputs.table(spark, sf_dir, "labels")
    key = F.concat_ws("_", "doc_id", F.col("doc_id") % 10)
    return alignment.alignment_checks(mirror, model, labels.select(key.alias("key"), key.alias("key_reference")))


def _target(spark, sf_dir):
    """A fresh model whose words are the labelled documents, all under the label 0."""
    labels = inputs.table(spark, sf_dir, "labels")
    words = labels.select(F.col("doc_id").cast("string").alias("word"), F.lit("0").alias("label"))
    return embedding.new_embedding(words, D, seed=sql.SEED, shared_context_vectors=False)


_TARGET = f"""keys AS MATERIALIZED (
  SELECT doc_id::VARCHAR AS word, role, row_number() OVER (ORDER BY role, doc_id::VARCHAR) - 1 AS ix
  FROM labels CROSS JOIN (VALUES ('w'), ('c')) roles(role)),
{sql.theta(D)},
target AS (SELECT word, role, word || '_0' || CASE WHEN role = 'c' THEN '_c' ELSE '' END AS key, vec
  FROM keys JOIN theta USING (ix))"""


def _transferred(condition: str) -> str:
    return with_(
        NAMED, _TARGET,
        f"""moved AS (SELECT target.key, coalesce(s.vec, target.vec) AS vec FROM target
  LEFT JOIN named s ON s.word = target.word AND target.role = 'w'{condition})""",
        select=f"SELECT key, {_long('vec')} FROM moved",
    )


@register("transfer_embeddings", _transferred(" AND s.label = '0'"))
def transfer_embeddings(spark, sf_dir):
    source = vector_model(vector_rows(spark, sf_dir))
    return long_vectors(alignment.transfer_embeddings(source, _target(spark, sf_dir)).vectors(), ["key"])


@register("transfer_ignore_group", _transferred(""))
def transfer_ignore_group(spark, sf_dir):
    source = vector_model(vector_rows(spark, sf_dir))
    moved = alignment.transfer_embeddings(source, _target(spark, sf_dir), ignore_group=True)
    return long_vectors(moved.vectors(), ["key"])


@register(
    "normalize_rotation",
    with_(
        NAMED,
        select=f"""SELECT key, {sql.r6('list_dot_product(vec, vec)')} AS squared_norm,
CASE WHEN row_number() OVER (ORDER BY key) <= {D} THEN 0.0::DOUBLE END AS below FROM named""",
    ),
)
def normalize_rotation(spark, sf_dir):
    # The result is fixed up to signs only: lengths must stay, and the first D words by key must
    # have nothing below their diagonal.
    model = vector_model(vector_rows(spark, sf_dir))
    chosen = [r["key"] for r in model.keys.select("key").orderBy("key").limit(D).collect()]
    turned = alignment.normalize_rotation(model, chosen).vectors()
    order = spark.createDataFrame(list(enumerate(chosen)), "place int, key string")
    tail = F.aggregate(F.slice("vec", F.col("place") + 2, D), F.lit(0.0), lambda s, e: s + e * e)
    return turned.join(F.broadcast(order), on="key", how="left").select(
        "key",
        r6(F.aggregate("vec", F.lit(0.0), lambda s, e: s + e * e)).alias("squared_norm"),
        r6(tail).alias("below"),
    )


@register("posterior_mean", _ALL)
def posterior_mean(spark, sf_dir):
    # Rotated copies of one model must average to that model.
    rows = vector_rows(spark, sf_dir)
    model, mirror = _mirrored(spark, sf_dir)
    negative = vector_model(rows, inputs.negated_vectors(F.col("vec")), contexts=True)
    return long_vectors(alignment.posterior_mean([mirror, negative, model]).vectors("w"), ["key"])
