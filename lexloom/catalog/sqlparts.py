"""SQL fragments (DuckDB dialect) that the catalogue's check queries are put together from."""

from __future__ import annotations

import math

from lexloom.functions.text import NON_WORD_RUN, PUNCTUATION, WHITESPACE

# Settings of the catalogue's corpus queries; queries and check SQL share them.
LIMIT, CUTOFF, SEED = 5, 1e-5, 0
WS, NS, BATCH, DIM = 2, 2, 5000, 4


def uniform(purpose: str, *ids: str, start: int = 1, seed: int = SEED) -> str:
    joined = ", ".join([f"'{seed}:{purpose}'", *ids])
    return f"(('0x' || substr(md5(concat_ws(':', {joined})), {start}, 12))::BIGINT / 281474976710656.0)"


def normal(purpose: str, *ids: str) -> str:
    first, second = uniform(purpose, *ids), uniform(purpose, *ids, start=13)
    return f"(sqrt(-2.0 * ln(1.0 - {first})) * cos({2 * math.pi!r} * {second}))"


def log_sigmoid(z: str) -> str:
    return f"(-(greatest(-({z}), 0.0) + ln(1.0 + exp(-abs({z})))))"


def r6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def split_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WHITESPACE}'), lambda w: w <> '')"


def tokens(
    table: str = "documents", key: str = "doc_id", extra: tuple[str, ...] = (), text: str = "lower(text)"
) -> str:
    """CTE ``tok(key, extra, tok, word)``; the extra columns are given as ``expression AS name``."""
    columns = ", ".join([key, *extra])
    names = ", ".join([key, *(e.split(" AS ")[-1] for e in extra)])
    return f"""tok AS MATERIALIZED (
  SELECT {names}, generate_subscripts(w, 1) - 1 AS tok, unnest(w) AS word
  FROM (SELECT {columns}, {split_words(text)} AS w FROM {table}))"""


def kept(limit: int = LIMIT, source: str = "tok") -> str:
    return f"""counts AS MATERIALIZED (SELECT word, count(*) AS n FROM {source} GROUP BY word),
kept AS MATERIALIZED (SELECT word, n FROM counts WHERE n >= {limit}),
total AS (SELECT sum(n)::DOUBLE AS total FROM kept)"""


def thinned(key: str = "doc_id, tok", columns: str = "doc_id, tok, word", source: str = "tok") -> str:
    draw = uniform("downsample", *key.split(", "))
    return f"""thin AS MATERIALIZED (
  SELECT {columns} FROM {source} JOIN kept USING (word), total
  WHERE {draw} < least(1.0, sqrt({CUTOFF} / (n / total))))"""


# ``corpus(pos, word)``: documents after the rare-word filter and downsampling.
CORPUS = f"""{tokens()},
{kept()},
{thinned()},
corpus AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, tok) - 1 AS pos, word FROM thin),
size AS (SELECT count(*) AS size FROM corpus)"""

_OFFSETS = ", ".join(f"({k}, {o})" for k, o in enumerate([*range(-1, -WS - 1, -1), *range(1, WS + 1)]))

# ``reach(pos, k, word, c)``: the 2 * WS context words of each position, in order.
REACH = f"""offsets(k, o) AS (VALUES {_OFFSETS}),
steps AS MATERIALIZED (SELECT pos, k, word, (pos + o + size) % size AS seen FROM corpus, offsets, size),
reach AS MATERIALIZED (
  SELECT steps.pos, k, steps.word, b.word AS c FROM steps JOIN corpus b ON b.pos = seen)"""

# ``centres(pos, k, i, x)``: the centre of each window (k = 0) and its NS negatives.


def unigrams(pool: str = "corpus") -> str:
    """``unigrams(word, low)``: the words of a pool and how many of its tokens come before them in word order."""
    return f"""unigrams AS MATERIALIZED (
  SELECT word, (sum(n) OVER (ORDER BY word) - n)::BIGINT AS low FROM (SELECT word, count(*) AS n FROM {pool} GROUP BY word))"""


def negatives(pool: str = "corpus", size: str = "size") -> str:
    return f"""{unigrams(pool)},
draws AS MATERIALIZED (
  SELECT pos, k, floor({uniform('negative', 'pos', 'k')} * size)::BIGINT AS drawn
  FROM corpus, (SELECT unnest(range(1, {NS + 1})) AS k), {size}),
negatives AS MATERIALIZED (
  SELECT draws.pos, k, drawn, u.word FROM draws ASOF JOIN unigrams u ON drawn >= u.low)"""


CENTRES = f"""{negatives()},
centres AS MATERIALIZED (
  SELECT pos, k, i, x FROM (
    SELECT pos, 0 AS k, word AS i, 1.0::DOUBLE AS x FROM corpus
    UNION ALL SELECT pos, k, word, 0.0::DOUBLE FROM negatives))"""

# ``keys(word, role, ix)`` and ``theta(ix, vec)`` of a fresh model on the corpus.
KEYS = """keys AS MATERIALIZED (
  SELECT word, role, row_number() OVER (ORDER BY role, word) - 1 AS ix
  FROM (SELECT DISTINCT word FROM corpus), (VALUES ('w'), ('c')) roles(role))"""


def init_value(ix: str, d: str, dim: int) -> str:
    return f"(({uniform('init', ix, d)} - 0.5) / {dim})"


def theta(dim: int = DIM, source: str = "keys") -> str:
    return f"""flat AS MATERIALIZED (
  SELECT ix, d, {init_value('ix', 'd', dim)} AS value FROM {source}, (SELECT unnest(range({dim})) AS d)),
theta AS MATERIALIZED (SELECT ix, list(value ORDER BY d) AS vec FROM flat GROUP BY ix)"""


# ``cvec(word, a)`` and ``wvec(word, r)``: context and word vectors; ``total(pos, s)``: summed contexts.
VECTORS = """wvec AS MATERIALIZED (SELECT word, ix, vec FROM keys JOIN theta USING (ix) WHERE role = 'w'),
cvec AS MATERIALIZED (SELECT word, ix, vec FROM keys JOIN theta USING (ix) WHERE role = 'c')"""


def list_sums(vec: str, dim: int = DIM) -> str:
    return "[" + ", ".join(f"sum({vec}[{d + 1}])" for d in range(dim)) + "]"


def sums_of_contexts(dim: int = DIM) -> str:
    return f"""ctx AS MATERIALIZED (
  SELECT pos, {list_sums('vec', dim)} AS s FROM reach JOIN cvec ON cvec.word = c GROUP BY pos)"""


# ``scored(pos, k, i, x, z)``: CBOW examples with their logits.
SCORED = """scored AS MATERIALIZED (
  SELECT pos, k, i, wvec.ix AS iix, x, wvec.vec AS rho, s, list_dot_product(wvec.vec, s) AS z
  FROM centres JOIN ctx USING (pos) JOIN wvec ON wvec.word = i)"""

MODEL = ",\n".join([CORPUS, REACH, CENTRES, KEYS, theta(), VECTORS, sums_of_contexts(), SCORED])

# ``named(key, word, label, role, ix, vec)``: the vectors of the ``embeddings`` table as a model.
NAMED = """named AS MATERIALIZED (
  SELECT word || '_' || label AS key, word, label, vec_id, vec,
    row_number() OVER (ORDER BY word, label) - 1 AS ix
  FROM (SELECT vec_id::VARCHAR AS word, label::VARCHAR AS label, vec_id, embedding::DOUBLE[] AS vec
        FROM embeddings))"""

# Both texts are fixed values shared with the library.
STRIPPED = f"translate(word, '{PUNCTUATION}', '')"
GROUPED_TEXT = f"lower(regexp_replace(text, '{NON_WORD_RUN}', '', 'g'))"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
