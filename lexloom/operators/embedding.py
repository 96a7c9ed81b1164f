"""The embedding as tables: keys, vectors, and an optional side-information graph.

``keys(word, label, role, key, ix)`` names the rows: role 'w' for word vectors, 'c' for context
vectors. ``theta(ix, vec)`` holds the vectors. With shared contexts a context vector belongs to
the word whatever its label, so its ``label`` is ''.

A row is identified by word, label and role. The string ``key`` is a name for it: names are looked up in
``names``, where a shared context also answers to the name with a label (``dog_2010_c``), and a string that
names two rows (``vitamin_c``: the word, or the context of ``vitamin``) is an error when it is asked for.
Requests may give ``word, label, role`` instead, which always name one row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import hashing, vectors
from lexloom.operators import graph
from lexloom.operators.priors import GaussianPrior, LaplacianPrior, Prior
from lexloom.operators.text import label_name
from lexloom.plans import scale

WORD, CONTEXT = "w", "c"


@dataclass(frozen=True)
class EmbeddingModel:
    keys: DataFrame
    theta: DataFrame
    dim: int
    lambda0: float = 1.0
    shared: bool = True
    edges: DataFrame | None = None
    lambda1: float | None = None
    prior: Prior | None = None

    @property
    def active_prior(self) -> Prior:
        """The prior given, or the Gaussian or graph prior that the model's settings describe."""
        if self.prior is not None:
            return self.prior
        if self.edges is None:
            return GaussianPrior(self.lambda0)
        return LaplacianPrior(self.lambda0, self.lambda1, self.edges)

    def with_theta(self, theta: DataFrame) -> "EmbeddingModel":
        other = replace(self, theta=theta)
        if "names" in self.__dict__:
            other.__dict__["names"] = self.names
        return other

    @cached_property
    def names(self) -> DataFrame:
        """``(key, ix, n_named)``: every name, a row it names, and how many rows it names; stored once."""
        return scale.materialise(names_of(self.keys), "names")

    def vectors(self, role: str | None = None) -> DataFrame:
        """Keys with their vectors, optionally of one role."""
        keys = self.keys if role is None else self.keys.where(F.col("role") == role)
        return keys.join(self.theta, on="ix")


def key_name(word: Column, label: Column, role: Column) -> Column:
    name = label_name(word, label)
    return F.when(role == CONTEXT, F.concat(name, F.lit("_c"))).otherwise(name)


def names_of(keys: DataFrame) -> DataFrame:
    """``(key, ix, n_named)`` of a key table; contexts without a label are also named with their word's labels."""
    contexts = keys.where(F.col("role") == CONTEXT)
    labelled = keys.where((F.col("role") == WORD) & (F.col("label") != "")).select("word", "label")
    without = labelled.join(contexts.select("word", "label"), ["word", "label"], "left_anti")
    shared = without.join(contexts.where("label = ''").select("word", "ix"), "word")
    more = shared.select(key_name(F.col("word"), F.col("label"), F.lit(CONTEXT)).alias("key"), "ix")
    every = keys.select("key", "ix").unionByName(more)
    return every.groupBy("key").agg(F.min("ix").alias("ix"), F.count_distinct("ix").alias("n_named"))


def check_unambiguous(requests: DataFrame, names: DataFrame, key: str = "key") -> None:
    """Raise if a requested name names two rows. Nearly always no name does, and the requests are not read."""
    twice = names.where("n_named > 1").select(F.col("key").alias(key))
    if twice.isEmpty():
        return
    asked = scale.lookup_join(requests.select(key), twice, [key], how="left_semi")
    found = [r[key] for r in asked.distinct().limit(5).collect()]
    if found:
        raise ValueError(f"these names fit two rows each, give word, label and role instead: {found}")


def located(
    requests: DataFrame, keys: DataFrame, names: DataFrame, key: str = "key", out: str = "ix", how: str = "left"
) -> DataFrame:
    """``requests`` with the row ``out`` they name: by ``word, label, role`` if there is no column ``key``."""
    if key not in requests.columns:
        exact = keys.select("word", "label", "role", F.col("ix").alias(out))
        return scale.lookup_join(requests, exact, ["word", "label", "role"], how=how)
    check_unambiguous(requests, names, key)
    return scale.lookup_join(requests, names.select(F.col("key").alias(key), F.col("ix").alias(out)), [key], how=how)


def _keys(entries: DataFrame) -> DataFrame:
    keys = scale.dense_index(entries, ["role", "word", "label"], "ix")
    name = key_name(F.col("word"), F.col("label"), F.col("role"))
    return keys.select("word", "label", "role", name.alias("key"), "ix")


def build_keys_shared(vocab: DataFrame) -> DataFrame:
    """A row per vocabulary entry, and one context row per word whatever its labels."""
    words = vocab.select("word", "label").distinct().withColumn("role", F.lit(WORD))
    contexts = vocab.select("word").distinct().select(
        "word", F.lit("").alias("label"), F.lit(CONTEXT).alias("role")
    )
    return _keys(words.unionByName(contexts))


def build_keys_unshared(vocab: DataFrame) -> DataFrame:
    """A word row and a context row per vocabulary entry."""
    roles = F.explode(F.array(F.lit(WORD), F.lit(CONTEXT))).alias("role")
    return _keys(vocab.select("word", "label").distinct().select("word", "label", roles))


def init_vectors(keys: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """Vectors drawn uniformly from [-0.5, 0.5) / dim."""
    values = hashing.drawn_vectors(dim, lambda ix, d: (hashing.uniform_array(seed, "init", ix, d) - 0.5) / dim, F.col("ix"))
    return keys.select("ix", values.alias("vec"))


def new_embedding(
    vocab: DataFrame,
    dim: int = 100,
    lambda0: float = 1.0,
    shared_context_vectors: bool = True,
    seed: int = 0,
    edges: DataFrame | None = None,
    lambda1: float = 1.0,
    prior: Prior | None = None,
) -> EmbeddingModel:
    """A fresh model; with ``edges(key1, key2[, weight])`` it has a graph prior, with ``prior`` one of your own.

    Edges may also name their ends by ``word1, label1, role1`` and ``word2, label2, role2``. A prior of your own is
    kept by the model but not saved with it.
    """
    build = build_keys_shared if shared_context_vectors else build_keys_unshared
    keys = scale.materialise(build(vocab), "keys")
    # Hashing dim numbers per key is real work; a small key table would be read by one task.
    theta = scale.materialise(init_vectors(scale.spread_small(keys, ["ix"]), dim, seed), "theta")
    model = EmbeddingModel(keys, theta, dim, lambda0, shared_context_vectors, prior=prior)
    if edges is None:
        return model
    kept, _ = graph.filter_edges(edges, keys)
    return replace(model, edges=scale.materialise(kept, "edges"), lambda1=lambda1)


def model_from_vectors(named: DataFrame, dim: int, lambda0: float = 1.0) -> EmbeddingModel:
    """Wrap ready vectors ``(word, label, role, vec)`` as a model."""
    named = scale.materialise(named, "named-vectors")
    keys = scale.materialise(_keys(named.select("word", "label", "role")), "keys")
    theta = named.join(keys, on=["word", "label", "role"]).select("ix", "vec")
    return EmbeddingModel(keys, scale.materialise(theta, "theta"), dim, lambda0)


def encode_corpus(model: EmbeddingModel, corpus: DataFrame) -> DataFrame:
    """``(pos, wix, cix)``: row indices of each token's word vector and context vector.

    A token without a key is an error.
    """
    words = model.keys.where(F.col("role") == WORD).select("word", "label", F.col("ix").alias("wix"))
    contexts = model.keys.where(F.col("role") == CONTEXT)
    on = ["word"] if model.shared else ["word", "label"]
    pairs = scale.materialise(
        words.join(contexts.select(*on, F.col("ix").alias("cix")), on=on), "key-pairs"
    )
    encoded = scale.lookup_join(corpus, pairs, ["word", "label"], how="left")
    encoded = scale.materialise(encoded.select("pos", "wix", "cix"), "encoded")
    if encoded.where("wix is null").limit(1).count():
        unknown = scale.lookup_join(corpus, pairs, ["word", "label"], how="left_anti")
        sample = [r["word"] for r in unknown.select("word").distinct().limit(5).collect()]
        raise ValueError(f"corpus has words outside the vocabulary, such as {sample}")
    return encoded


def lookup_vectors(model: EmbeddingModel, requests: DataFrame, strict: bool = True) -> DataFrame:
    """Vectors for ``requests(key, ...)`` or ``requests(word, label, role, ...)``; repeats are kept.

    A miss raises, or drops if not strict.
    """
    on = ["key"] if "key" in requests.columns else ["word", "label", "role"]
    if on == ["key"]:
        check_unambiguous(requests, model.names)
    named = (model.names if on == ["key"] else model.keys).select(*on, "ix")
    hot = None
    if strict:
        asked = scale.key_counts(requests, on)
        hot = scale.hot_of(asked).select(*on)
        with scale.shuffles_deleted(requests.sparkSession):
            # Of the names asked for, once each, not of all requests.
            _check_found(scale.lookup_join(asked.select(*on), named, on, how="left_anti").withColumn("ix", F.lit(None)))
    # Names and vectors, of which there are few, meet first; the requests are joined once, and one table is broadcast at most.
    known = scale.materialise(named.join(model.theta, "ix"), "named-vectors")
    found = scale.lookup_join(requests, known, on, dim=model.dim, hot=hot)
    return found.select("ix", *requests.columns, "vec")


def contains(model: EmbeddingModel, requests: DataFrame) -> DataFrame:
    """``requests`` with a flag for the keys the model has."""
    on = ["key"] if "key" in requests.columns else ["word", "label", "role"]
    known = (model.names if on == ["key"] else model.keys).select(*on, F.lit(True).alias("known"))
    return scale.lookup_join(requests, known, on, how="left").withColumn("known", F.coalesce("known", F.lit(False)))


def _check_found(rows: DataFrame) -> None:
    missing = rows.where("ix is null")
    if missing.limit(1).count():
        named = ["key"] if "key" in rows.columns else ["word", "label", "role"]
        sample = ["/".join(map(str, r)) for r in missing.select(*named).distinct().limit(5).collect()]
        raise ValueError(f"not in the embedding: {sample}")


def _check_unique(updates: DataFrame) -> None:
    if updates.groupBy("ix").count().where("count > 1").limit(1).count():
        raise ValueError("an update may name each key only once")


def update_vectors(model: EmbeddingModel, updates: DataFrame) -> EmbeddingModel:
    """Overwrite the vectors of ``updates(key, vec)`` or ``(word, label, role, vec)``; unknown or repeated rows raise."""
    named = scale.materialise(located(updates, model.keys, model.names).withColumnRenamed("vec", "_new"), "updates")
    _check_found(named)
    _check_unique(named)
    return model.with_theta(overwrite(model.theta, named.select("ix", "_new")))


def overwrite(theta: DataFrame, new: DataFrame) -> DataFrame:
    return theta.join(new, on="ix", how="left").select(
        "ix", F.coalesce("_new", "vec").alias("vec")
    )


def embedding_shape(model: EmbeddingModel) -> DataFrame:
    """One row: vectors, their length, and the number of keys that name them."""
    rows = model.theta.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("vec")).alias("dim"))
    return rows.crossJoin(model.names.agg(F.count(F.lit(1)).alias("n_keys")))  # one row each
