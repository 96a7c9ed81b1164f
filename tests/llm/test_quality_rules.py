import re
from collections import Counter

from lexloom.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {i + k for i, w in enumerate(windows) if Counter(windows)[w] > 1 for k in range(5)} if len(windows) < 500 else None
    if twice is None:
        counts = Counter(windows)
        twice = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(twice),
    )


def test_measurements_agree_with_brute_force(odd_docs):
    extra = odd_docs.sparkSession.createDataFrame(
        [(20, "a b c d e f a b c d e x\nq\nq\n# $ & z"), (21, "x " * 4), (22, "é ü " * 9 + "\x00 \x1f")], "doc_id bigint, text string"
    )
    docs = odd_docs.select("doc_id", "text").unionByName(extra)
    want = Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    got = q.ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert Counter(map(tuple, got)) == want


def test_policies_read_the_ledger_only(odd_docs):
    rows = q.apply_policies(q.ledger(odd_docs), [q.BASE, q.STRICT]).collect()
    for r in rows:
        assert r.kept_base_v1 == (r.n_words >= 10 and 100 * r.n_repeat_words <= 20 * r.n_words)
        assert not r.kept_strict_v2 or r.kept_base_v1


def test_ablation_counts_what_each_rule_rejects(spark):
    bits = [0, 1, 1, 2, 3, 4, 16]
    rows = spark.createDataFrame([(b,) for b in bits], "fail_bits bigint")
    policy = q.Policy("two", 3, ("few_words", "repeated_windows"))
    got = {r.rule: r for r in q.ablation(rows, [policy]).collect()}
    assert set(got) == set(policy.rules)
    assert {r.n_docs for r in got.values()} == {7} and {r.n_kept for r in got.values()} == {3}
    assert (got["few_words"].n_failed, got["few_words"].n_only_this_rule) == (3, 2)
    assert (got["repeated_windows"].n_failed, got["repeated_windows"].n_only_this_rule) == (2, 1)


def test_empty_table(no_docs):
    assert q.ledger(no_docs).count() == 0
    assert q.ablation(q.ledger(no_docs), [q.BASE]).count() == 0
