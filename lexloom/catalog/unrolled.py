"""SQL that repeats MAP estimation and variational inference step by step, for the checks of the estimation jobs.

The random numbers are hashes, so SQL can draw the same batches, negatives and noise. An epoch has two batches, each half
of the corpus; every step is a few common table expressions on the state before it. A corpus is the table
``<p>(pos, wix, cix)`` of row indices.
"""

from __future__ import annotations

import math

from lexloom.catalog import sqlparts as sql
from lexloom.catalog.sqlparts import NS, SEED, WS
from lexloom.operators.optimise import Adam

LAMBDA0 = 1.0
# Number of batches of an epoch when a batch is half of the corpus, rounded up.
TURNS = 2
_OFFSETS = ", ".join(f"({k}, {o})" for k, o in enumerate([*range(-1, -WS - 1, -1), *range(1, WS + 1)]))


def encoded(out: str = "enc", corpus: str = "corpus", labelled: bool = False) -> str:
    own = " AND w.label = c.label" if labelled else ""
    return f"""{out} AS MATERIALIZED (
  SELECT pos, w.ix AS wix, a.ix AS cix FROM {corpus} c JOIN keys w ON w.word = c.word AND w.role = 'w'{own}
  JOIN keys a ON a.word = c.word AND a.role = 'c')"""


def windows(p: str, batches: int = TURNS) -> str:
    return f"""size_{p} AS (SELECT count(*) AS size, (count(*) + {batches - 1}) // {batches} AS half FROM {p}),
reach_{p} AS MATERIALIZED (
  SELECT a.pos, k, b.cix FROM (
    SELECT pos, k, (pos + o + size) % size AS seen FROM {p}, (VALUES {_OFFSETS}) offsets(k, o), size_{p}) a
  JOIN {p} b ON b.pos = seen),
unigrams_{p} AS MATERIALIZED (
  SELECT wix, (sum(n) OVER (ORDER BY wix) - n)::BIGINT AS low FROM (SELECT wix, count(*) AS n FROM {p} GROUP BY wix))"""


def centres(name: str, p: str, seed: int) -> str:
    """``centres_<name>(pos, wix, x)``: the corpus's words and the negatives drawn with this seed."""
    draw = sql.uniform("negative", "pos", "k", seed=seed)
    return f"""draws_{name} AS MATERIALIZED (
  SELECT pos, floor({draw} * size)::BIGINT AS drawn FROM {p}, (SELECT unnest(range(1, {NS + 1})) AS k), size_{p}),
centres_{name} AS MATERIALIZED (
  SELECT pos, wix, 1.0::DOUBLE AS x FROM {p}
  UNION ALL SELECT pos, u.wix, 0.0::DOUBLE FROM draws_{name} ASOF JOIN unigrams_{p} u ON drawn >= u.low)"""


def turns(e: int, ordered: int | None = None) -> str:
    if ordered:
        return f"turns_{e} AS (SELECT batch_id, batch_id AS turn FROM (SELECT unnest(range({ordered})) AS batch_id))"
    return f"""turns_{e} AS (
  SELECT batch_id, row_number() OVER (ORDER BY {sql.uniform('batch', f"'{e}'", 'batch_id')}, batch_id) - 1 AS turn
  FROM (SELECT unnest(range({TURNS})) AS batch_id))"""


def batch(s: str, e: int, turn: int, p: str) -> str:
    return f"""batch_{s} AS (
  SELECT batch_id, half, size, least(half, size - batch_id * half) AS rows, least(half, size - batch_id * half)::DOUBLE / size AS share
  FROM turns_{e}, size_{p} WHERE turn = {turn})"""


def scored(s: str, before: str, name: str, p: str, kind: str, dim: int, whole: bool = False) -> str:
    """``scored_<s>``: the outcomes of a batch, or of the whole corpus, with their logits under the vectors ``before``."""
    here = "" if whole else f", batch_{s} WHERE pos // half = batch_id"
    if kind == "cbow":
        return f"""ctx_{s} AS MATERIALIZED (
  SELECT pos, {sql.list_sums('vec', dim)} AS other FROM reach_{p} JOIN {before} ON ix = cix{here} GROUP BY pos),
scored_{s} AS MATERIALIZED (
  SELECT pos, wix, x, vec AS rho, other, list_dot_product(vec, other) AS z
  FROM centres_{name} JOIN ctx_{s} USING (pos) JOIN {before} ON ix = wix)"""
    return f"""scored_{s} AS MATERIALIZED (
  SELECT wix, cix, x, w.vec AS rho, v.vec AS other, list_dot_product(w.vec, v.vec) AS z
  FROM centres_{name} JOIN reach_{p} USING (pos) JOIN {before} w ON w.ix = wix JOIN {before} v ON v.ix = cix{here})"""


def sums(s: str, before: str, p: str, kind: str, dim: int) -> str:
    """``sums_<s>(ix, g)``: gradient of the batch's log likelihood."""

    def scaled(vec: str) -> str:
        return f"list_transform({vec}, lambda e: e * (x - 1.0 / (1.0 + exp(-z))))"

    each = f"reach_{p} USING (pos)" if kind == "cbow" else ""
    contexts = f"SELECT cix, {scaled('rho')} FROM scored_{s}" + (f" JOIN {each}" if each else "")
    return f"""sums_{s} AS MATERIALIZED (
  SELECT ix, {sql.list_sums('vec', dim)} AS g FROM (SELECT wix AS ix, {scaled('other')} AS vec FROM scored_{s}
    UNION ALL {contexts}) GROUP BY ix)"""


def _each(dim: int, body: str) -> str:
    return f"list_transform(range(1, {dim + 1}), lambda i: {body})"


def _moments(dim: int, adam: Adam, m: str, v: str, g: str) -> tuple[str, str]:
    return (
        _each(dim, f"{adam.beta1!r} * {m}[i] + {1 - adam.beta1!r} * {g}[i]"),
        _each(dim, f"{adam.beta2!r} * {v}[i] + {1 - adam.beta2!r} * {g}[i] * {g}[i]"),
    )


def _moved(dim: int, adam: Adam, step: int, value: str, m: str, v: str) -> str:
    one, two = 1 - adam.beta1**step, 1 - adam.beta2**step
    return _each(dim, f"{value}[i] + {adam.learning_rate!r} * ({m}[i] / {one!r}) / (sqrt({v}[i] / {two!r}) + {adam.epsilon!r})")


def _log_lik(s: str) -> str:
    return f"(SELECT sum({sql.log_sigmoid('(2 * x - 1) * z')}) FROM scored_{s})"


def map_fit(
    kind: str, dim: int, epochs: int, p: str = "enc", lambda1: float | None = None, valid: str | None = None,
    ordered: int | None = None, adam: Adam = Adam(),
) -> tuple[list[str], str]:
    """Common table expressions of a fit on the corpus ``p``, and the name of its last state.

    ``history(epoch, batch, metric, value, n)`` has its losses, and validation on the corpus ``valid``. With ``lambda1`` the prior
    has the graph ``edges(src, dst, weight)``. ``ordered`` is a number of batches taken one after another.
    """
    zero = f"list_resize([0.0::DOUBLE], {dim}, 0.0::DOUBLE)"
    parts = [windows(p, ordered or TURNS), f"state_0 AS MATERIALIZED (SELECT ix, vec, {zero} AS m, {zero} AS v FROM theta)"]
    rows, step = [], 0

    def validate(epoch: int) -> None:
        parts.append(scored(f"valid_{epoch}", f"state_{step}", "valid", valid, kind, dim, whole=True))
        mean = f"avg({sql.log_sigmoid('(2 * x - 1) * z')})"
        rows.append(f"SELECT {epoch} AS epoch, NULL::INT AS batch, 'validation_log_lik' AS metric, {mean} AS value, NULL::BIGINT AS n FROM scored_valid_{epoch}")

    if valid:
        parts += [windows(valid), centres("valid", valid, SEED)]
        validate(0)
    for e in range(epochs):
        parts += [centres(str(e), p, SEED * 1_000_003 + e), turns(e, ordered)]
        for turn in range(ordered or TURNS):
            before, step = f"state_{step}", step + 1
            s = str(step)
            parts += [batch(s, e, turn, p), scored(s, before, str(e), p, kind, dim), sums(s, before, p, kind, dim)]
            norm, pull = f"{LAMBDA0} * (SELECT sum(list_dot_product(vec, vec)) FROM {before})", f"{LAMBDA0} * vec[i]"
            near = ""
            if lambda1 is not None:
                apart = _each(dim, "weight * (a.vec[i] - b.vec[i])")
                parts.append(f"""ends_{s} AS MATERIALIZED (
  SELECT src, dst, weight, a.vec AS av, b.vec AS bv, {apart} AS apart FROM edges JOIN {before} a ON a.ix = src JOIN {before} b ON b.ix = dst),
lap_{s} AS MATERIALIZED (
  SELECT ix, {sql.list_sums('apart', dim)} AS l FROM (SELECT src AS ix, apart FROM ends_{s} WHERE src <> dst
    UNION ALL SELECT dst, list_transform(apart, lambda e: -e) FROM ends_{s} WHERE src <> dst) GROUP BY ix)""")
                norm += f" + {lambda1} * (SELECT coalesce(sum(weight * list_distance(av, bv) * list_distance(av, bv)), 0) FROM ends_{s})"
                pull, near = f"({pull} + {lambda1} * coalesce(l[i], 0.0))", f" LEFT JOIN lap_{s} USING (ix)"
            m, v = _moments(dim, adam, "m", "v", "g")
            parts.append(f"""grad_{s} AS MATERIALIZED (
  SELECT ix, vec, m, v, {_each(dim, f'coalesce(g[i], 0.0) - share * {pull}')} AS g FROM {before} LEFT JOIN sums_{s} USING (ix){near}, batch_{s}),
moments_{s} AS MATERIALIZED (SELECT ix, vec, {m} AS m, {v} AS v FROM grad_{s}),
state_{s} AS MATERIALIZED (SELECT ix, {_moved(dim, adam, step, 'vec', 'm', 'v')} AS vec, m, v FROM moments_{s})""")
            prior = f"(SELECT -0.5 * share * ({norm}) FROM batch_{s})"
            count = f"(SELECT count(*) FROM scored_{s})"
            rows.append(f"SELECT {e} AS epoch, {turn} AS batch, 'training_loss' AS metric, -({_log_lik(s)} + {prior}) / {count} AS value, {count} AS n")
        if valid:
            validate(e + 1)
    parts.append("history AS MATERIALIZED (" + " UNION ALL ".join(rows) + ")")
    return parts, f"state_{step}"


def vi_fit(kind: str, dim: int, epochs: int, p: str = "enc", adam: Adam = Adam()) -> tuple[list[str], str]:
    """Common table expressions of mean-field inference on the corpus ``p`` and the name of its last state; ``elbos(epoch, elbo)``."""
    noise, spread = sql.normal("init-mean", "ix", "d"), sql.normal("init-std", "ix", "d")
    zero = f"list_resize([0.0::DOUBLE], {dim}, 0.0::DOUBLE)"
    dims = f"(SELECT unnest(range({dim})) AS d)"
    parts = [windows(p), f"""state_0 AS MATERIALIZED (
  SELECT ix, list({noise} * 1e-5 ORDER BY d) AS mean, list({math.log(0.05)!r}::DOUBLE + {spread} * 1e-5 ORDER BY d) AS log_std,
    {zero} AS mm, {zero} AS mv, {zero} AS sm, {zero} AS sv FROM keys, {dims} GROUP BY ix)"""]
    step, elbos = 0, []
    for e in range(epochs):
        parts += [centres(str(e), p, SEED * 1_000_003 + e), turns(e)]
        posts = []
        for turn in range(TURNS):
            before, step = f"state_{step}", step + 1
            s = str(step)
            eps = sql.normal("draw", f"'{s}'", "ix", "d")
            mm, mv = _moments(dim, adam, "mm", "mv", "g")
            sm, sv = _moments(dim, adam, "sm", "sv", "sg")
            parts += [
                batch(s, e, turn, p),
                f"""noise_{s} AS MATERIALIZED (SELECT ix, list({eps} ORDER BY d) AS eps FROM keys, {dims} GROUP BY ix),
drawn_{s} AS MATERIALIZED (
  SELECT *, {_each(dim, 'mean[i] + exp(log_std[i]) * eps[i]')} AS vec FROM {before} JOIN noise_{s} USING (ix))""",
                scored(s, f"drawn_{s}", str(e), p, kind, dim),
                sums(s, f"drawn_{s}", p, kind, dim),
                f"""grad_{s} AS MATERIALIZED (
  SELECT d.*, {_each(dim, f'(coalesce(g[i], 0.0) - share * {LAMBDA0} * vec[i]) / share')} AS g
  FROM drawn_{s} d LEFT JOIN sums_{s} USING (ix), batch_{s}),
slopes_{s} AS MATERIALIZED (SELECT *, {_each(dim, 'g[i] * (exp(log_std[i]) * eps[i]) + 1.0')} AS sg FROM grad_{s}),
moments_{s} AS MATERIALIZED (
  SELECT ix, mean, log_std, {mm} AS mm, {mv} AS mv, {sm} AS sm, {sv} AS sv FROM slopes_{s}),
state_{s} AS MATERIALIZED (
  SELECT ix, {_moved(dim, adam, step, 'mean', 'mm', 'mv')} AS mean, {_moved(dim, adam, step, 'log_std', 'sm', 'sv')} AS log_std,
    mm, mv, sm, sv FROM moments_{s})""",
            ]
            prior = f"-0.5 * share * {LAMBDA0} * (SELECT sum(list_dot_product(vec, vec)) FROM drawn_{s})"
            posts.append(f"SELECT rows, ({_log_lik(s)} + {prior}) / share AS post FROM batch_{s}")
        entropy = f"(SELECT sum(list_sum(log_std)) FROM state_{step})"
        elbos.append(f"SELECT {e} AS epoch, sum(rows * post) / sum(rows) + {entropy} AS elbo FROM ({' UNION ALL '.join(posts)})")
    parts.append("elbos AS MATERIALIZED (" + " UNION ALL ".join(elbos) + ")")
    return parts, f"state_{step}"
