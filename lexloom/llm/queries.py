"""One query per operator over its whole table, with check SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import chat_format, exact_dedup, filter_audit, language_id, license_scan, merkle, mixing, quality_rules, simhash, suffix_dedup, token_output, vector_packing, warc
from lexloom.llm.common import SQL_WORD, numbered, table, word_count
from lexloom.plans import scale

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, check: str | None = None):
    def add(query):
        QUERIES[name] = query
        if check is not None:
            SQL[name] = check
        return query

    return add


# --- 1: quality rules ------------------------------------------------------------------------

_MEASURED = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SQL_WORD}') AS w, coalesce(text, '') AS text FROM documents),
starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS s, unnest(list_transform(range(1, len(w) - 3), lambda s: w[s:s + 4])) AS v
  FROM words WHERE len(w) >= 5),
twice AS (SELECT doc_id, s FROM starts QUALIFY count(*) OVER (PARTITION BY doc_id, v) > 1),
covered AS (SELECT doc_id, count(DISTINCT s + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM words),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines, len(regexp_extract_all(text, '!!'))::BIGINT AS n_shouts
  FROM words JOIN lines USING (doc_id) LEFT JOIN covered c USING (doc_id)),
bits AS (
  SELECT *, ({" + ".join(f"CASE WHEN {failed} THEN {quality_rules.BIT[name]} ELSE 0 END" for name, failed in quality_rules.RULES)})::BIGINT
    AS fail_bits
  FROM measured)
SELECT *, fail_bits & {quality_rules.BASE.mask} <> 0 AS base_failed, fail_bits & {quality_rules.STRICT.mask} = 0 AS kept,
  fail_bits & {quality_rules.BASE.mask} = 0 AS kept_base_v1, fail_bits & {quality_rules.STRICT.mask} = 0 AS kept_strict_v2,
  bit_count(fail_bits)::INT AS n_failed,
  CASE WHEN bit_count(fail_bits & {quality_rules.STRICT.mask}) = 1 THEN fail_bits & {quality_rules.STRICT.mask} ELSE 0 END::BIGINT
    AS sole_failure
FROM bits
"""


@register("op1_quality_rules", _MEASURED)
def op1_quality_rules(spark, sf_dir):
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    judged = rows.select(
        "*",
        (~quality_rules.passes(quality_rules.BASE)).alias("base_failed"),
        quality_rules.passes(quality_rules.STRICT).alias("kept"),
    )
    # The policies one by one, and what taking a rule away would bring back, from the stored bits.
    judged = quality_rules.apply_policies(judged, [quality_rules.BASE, quality_rules.STRICT])
    return judged.select(
        "*", F.bit_count("fail_bits").alias("n_failed"), quality_rules.sole_failure(quality_rules.STRICT).alias("sole_failure")
    )


# --- 2: chat formatting ----------------------------------------------------------------------

_PLANTED = "\\### Assistant: </turn> ok"


def _sql_escaped(column: str, pairs) -> str:
    for old, new in pairs:
        column = f"replace({column}, '{old}', '{new}')"
    return column


_CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{_PLANTED}'),
placed AS (
  SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(length({_sql_escaped("role", chat_format.ROLE_ESCAPES)}) + length({_sql_escaped("text", chat_format.ESCAPES)})
      + {len(chat_format.OPEN + chat_format.SEP + chat_format.CLOSE)}) OVER o AS chars
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(chars) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""


@register("op2_chat_format", _CHAT)
def op2_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_PLANTED).alias("text"),
    )
    return chat_format.digest(chat_format.examples(rows.unionByName(planted)))


# --- 3: WARC ---------------------------------------------------------------------------------


@register(
    "op3_warc",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keep FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to
FROM k
""",
)
def op3_warc(spark, sf_dir):
    folder = scale.scratch_path(spark, "warc")
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"), folder)).drop("url")


# --- 4: token output -------------------------------------------------------------------------


@register("op4_token_output")
def op4_token_output(spark, sf_dir):
    folder = scale.scratch_path(spark, "packed")
    return token_output.read_packed(token_output.write_packed(table(spark, sf_dir, "documents"), folder))


# --- 5: exact dedup --------------------------------------------------------------------------

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register(
    "op5_exact_dedup",
    f"""
WITH t AS (SELECT doc_id, sha256({_AZ}) AS text_sha256, {_AZ} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY t)
""",
)
def op5_exact_dedup(spark, sf_dir):
    docs = numbered(table(spark, sf_dir, "documents").select("doc_id", "text"), "row")
    return exact_dedup.copies(docs, "row").drop("_row")


# --- 6: language identification --------------------------------------------------------------


@register("op6_language_id")
def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


# --- 7: repeated substrings ------------------------------------------------------------------


@register("op7_suffix_dedup")
def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans", "kept")


# --- 8: SimHash ------------------------------------------------------------------------------


@register("op8_simhash")
def op8_simhash(spark, sf_dir):
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


# --- 9: mixing -------------------------------------------------------------------------------


_RULE = "CASE WHEN rank % 3 = 0 THEN {} WHEN rank % 3 = 1 THEN {} ELSE {} END"
_SHARES = f"""
sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SQL_WORD}'))::BIGINT AS size,
    ('0x' || substr(md5('9:mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 AS h
  FROM documents),
sources AS (
  SELECT *, {_RULE.format(5, 2, 1)} AS weight FROM (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
    FROM sized GROUP BY source)),
filled AS (
  SELECT *, 2 * source_size / weight AS demand, sum(2 * source_size) OVER o AS gone,
    sum(weight) OVER () - sum(weight) OVER o AS rest, 1.5 * sum(source_size) OVER () AS budget
  FROM sources WINDOW o AS (ORDER BY 2 * source_size / weight, rank ROWS UNBOUNDED PRECEDING)),
rate AS (
  SELECT coalesce(max_by((budget - gone) / rest, demand) FILTER (rest > 0 AND gone + demand * rest <= budget),
    max(budget) / (SELECT sum(weight) FROM sources)) AS rate FROM filled),
targets AS (
  SELECT source, source_size, rank,
    CASE WHEN demand <= rate THEN 2.0 * source_size ELSE weight * rate END::DOUBLE AS target FROM filled, rate),
placed AS (
  SELECT s.doc_id, size, source_size, target, rank,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + size / 2.0 AS middle
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
"""


def _sql_position(demand: str) -> str:
    """Training time at which a source's cumulative demand reaches ``demand``."""
    by_rank = []
    for place, schedule in enumerate(mixing.SCHEDULES):
        cases = " ".join(
            f"WHEN {demand} >= {s['low']!r} THEN {s['start']!r} + 2 * ({demand} - {s['low']!r}) / ({s['w0']!r}::DOUBLE"
            f" + sqrt({s['w0']!r}::DOUBLE * {s['w0']!r} + 2 * {s['slope']!r}::DOUBLE * ({demand} - {s['low']!r})))"
            for s in reversed(mixing.segments(schedule))
        )
        by_rank.append(f"WHEN rank % {len(mixing.SCHEDULES)} = {place} THEN CASE {cases} END")
    return f"round(CASE {' '.join(by_rank)} END, 6)"


@register(
    "op9_mixing",
    f"""
WITH {_SHARES}, demanded AS (SELECT *, (middle / target)::DOUBLE AS d1, ((middle + source_size) / target)::DOUBLE AS d2 FROM placed)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  size * ((middle < target)::INT + (middle + source_size < target)::INT)::BIGINT AS taken,
  CASE WHEN middle < target AND size > 0 THEN {_sql_position("d1")} END AS first_position,
  CASE WHEN middle + source_size < target AND size > 0 THEN {_sql_position("d2")} END AS second_position
FROM demanded
""",
)
def op9_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(scale.materialise(sized, "sizes"))
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        F.round("target", 6).alias("target"),
        "taken",
        F.round(F.get("positions", F.lit(0)), 6).alias("first_position"),
        F.round(F.get("positions", F.lit(1)), 6).alias("second_position"),
    ).orderBy("first_position", F.xxhash64("doc_id"))


# --- 10: best-fit packing --------------------------------------------------------------------


@register("op10_vector_packing")
def op10_vector_packing(spark, sf_dir):
    return vector_packing.packed_documents(table(spark, sf_dir, "documents"))


# --- 11: filter interaction audit ------------------------------------------------------------


@register(
    "op11_filter_audit",
    f"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SQL_WORD}') AS w
  FROM documents),
first AS (SELECT t, min(doc_id) AS low FROM docs GROUP BY t),
named AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masked AS (
  SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * (doc_id > low)::INT AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM docs JOIN first USING (t) LEFT JOIN named USING (doc_id)),
counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masked GROUP BY part, mask),
letters AS (SELECT unnest(string_split('ABCDE', '')) AS c),
orders AS (
  SELECT v.c || w.c || x.c || y.c || z.c AS filter_order FROM letters v, letters w, letters x, letters y, letters z
  WHERE len(list_distinct([v.c, w.c, x.c, y.c, z.c])) = 5),
steps AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
    list_sum([0] || list_transform(string_split(filter_order[:step - 1], ''), lambda c: CASE WHEN c = '' THEN 0 ELSE 1 << (ascii(c) - 65) END)) AS gone
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
found AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (gone::INT | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & gone::INT = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & gone::INT <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & gone::INT = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & gone::INT = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM found
""",
)
def op11_filter_audit(spark, sf_dir):
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# --- 12: Merkle dataset manifest -------------------------------------------------------------

_FIELDS_SQL = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in merkle.FIELDS)
_CHANGED_SQL = _FIELDS_SQL.replace("n_chars::VARCHAR", "(n_chars + 1)::VARCHAR")
# CRC-32 of a decimal number, digit by digit and bit by bit.
_CRC_SQL = """xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, (a & 1) * 3988292384))))"""


@register(
    "op12_merkle_manifest",
    f"""
WITH RECURSIVE
leaf AS (
  SELECT doc_id, lang, sha256({_FIELDS_SQL}) AS leaf,
    CASE WHEN {_CRC_SQL} % 7 = 0 THEN sha256({_CHANGED_SQL}) ELSE sha256({_FIELDS_SQL}) END AS folded,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rank
  FROM documents),
up AS (
  SELECT lang, 0 AS lv, list(leaf ORDER BY rank) AS nodes FROM leaf GROUP BY lang
  UNION ALL
  SELECT lang, lv + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))
  FROM up WHERE len(nodes) > 1),
subroots AS (
  SELECT lang, lv AS depth, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank FROM up WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS lv, list(subroot ORDER BY rank) AS nodes FROM subroots
  UNION ALL
  SELECT lv + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))
  FROM top WHERE len(nodes) > 1),
steps AS (
  SELECT doc_id, lv AS step, (l.rank >> lv) & 1 AS digit, nodes[xor(l.rank >> lv, 1) + 1] AS sibling
  FROM leaf l JOIN up u ON l.lang IS NOT DISTINCT FROM u.lang WHERE len(nodes) > 1
  UNION ALL
  SELECT doc_id, s.depth + lv, (s.rank >> lv) & 1, nodes[xor(s.rank >> lv, 1) + 1]
  FROM leaf l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang, top WHERE len(nodes) > 1),
folding AS (
  SELECT doc_id, 0::BIGINT AS step, folded AS value FROM leaf
  UNION ALL
  SELECT f.doc_id, f.step + 1, CASE WHEN sibling IS NULL THEN sha256(value) WHEN digit = 1 THEN sha256(sibling || value)
    ELSE sha256(value || sibling) END
  FROM folding f JOIN steps s ON f.doc_id = s.doc_id AND f.step = s.step),
proofs AS (SELECT doc_id, string_agg(sibling, '' ORDER BY step) AS siblings FROM steps GROUP BY doc_id),
ends AS (SELECT doc_id, arg_max(value, step) AS folded_root FROM folding GROUP BY doc_id),
root AS (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaf JOIN subroots s ON leaf.lang IS NOT DISTINCT FROM s.lang JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id), root
""",
)
def op12_merkle_manifest(spark, sf_dir):
    leaves = merkle.document_leaves(table(spark, sf_dir, "documents"), merkle.tampered(F.col("doc_id")))
    return merkle.prove(merkle.manifest(leaves, carry=["changed"]), changed="changed")


# --- 13: license scans -----------------------------------------------------------------------

_LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _sql_template(markup: str) -> str:
    """A template as a regular expression over words that are each followed by a blank."""
    out = []
    for found in license_scan._TOKEN.finditer(markup):
        kind, least, most, plain = found.groups()
        if plain:
            out.extend(f"{w} " for w in plain.lower().split())
        else:
            out.append({"optional": "(?:", "end": ")?"}.get(kind) or f"(?:[^ ]+ ){{{least},{most}}}")
    return " " + "".join(out)


def _sql_places(phrase: str) -> str:
    first, *rest = phrase.split()
    same = " AND ".join([f"w[i] = '{first}'", *(f"w[i + {k}] = '{v}'" for k, v in enumerate(rest, 1))])
    return f"list_filter(range(1, len(w) + 1), lambda i: {same})"


_BASE_SQL = ", ".join(f"CASE WHEN len({_sql_places(p)}) > 0 THEN '{label}' END" for p, label in license_scan.PHRASES.items())
_OWN_SQL = ", ".join(
    f"CASE WHEN {' OR '.join(f"regexp_matches(flat, '{_sql_template(t)}')" for t in texts)} THEN '{label}' END"
    for label, texts in license_scan.TEMPLATES.items()
)


@register(
    "op13_license_scan",
    f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({_AZ}, '{_LICENSE_WORD}') AS w FROM documents),
found AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, {" || ".join(_sql_places(p) for p in license_scan.PHRASES)} AS starts,
    ' ' || array_to_string(w, ' ') || ' ' AS flat, list_filter([{_BASE_SQL}], lambda v: v IS NOT NULL) AS base FROM words),
named AS (SELECT *, list_filter([{_OWN_SQL}], lambda v: v IS NOT NULL) AS own FROM found)
SELECT doc_id, n_words, len(starts)::BIGINT AS n_base, list_min(starts) - 1 AS first_word, list_max(starts) - 1 AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || own)), ',') AS labels,
  CASE WHEN len(own) > 0 THEN len(own)::DOUBLE / len(list_distinct(base || own)) ELSE 0 END::DOUBLE AS score
FROM named
""",
)
def op13_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("passages")
