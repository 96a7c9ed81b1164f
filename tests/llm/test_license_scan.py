import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import license_scan as ls

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def wordings(markup, any_word):
    """The template as a regular expression over words that are each followed by a blank."""
    return "".join(
        {"optional": "(?:", "end": ")?"}.get(kind) or (f"(?:{any_word} ){{{a},{b}}}" if kind else "".join(w + " " for w in plain.split()))
        for kind, a, b, plain in ls._TOKEN.findall(markup)
    )


def brute(text):
    words = words_of(text)
    flat = " " + "".join(w + " " for w in words)
    at, base = [], set()
    for phrase, label in ls.PHRASES.items():
        p = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += here
        base |= {label} if here else set()
    own = {label for label, texts in ls.TEMPLATES.items() if any(re.search(" " + wordings(t, "[^ ]+"), flat) for t in texts)}
    both = base | own
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(both)), len(own) / len(both) if own else 0.0)


def sample(markup, rng):
    """A wording that the template allows, with other case and punctuation."""
    out, skip = [], False
    for kind, a, b, plain in ls._TOKEN.findall(markup):
        if kind == "optional":
            skip = rng.random() < 0.5
        elif kind == "end":
            skip = False
        elif not skip:
            out += [rng.choice(["Jane", "2024", "the", "é"]) for _ in range(rng.randint(int(a), int(b)))] if kind else plain.split()
    return "".join(w.capitalize() + rng.choice([" ", ", ", "\n  ", " (", '" ']) for w in out)


def test_scan_agrees_with_regular_expressions(spark, odd_docs, no_docs):
    rng = random.Random(3)
    texts = ["MIT license, mit license; the MIT\nLicense mit", "apache-license general public LICENSE", "licensed under the apache license version 3.0", "xmit license mit licenses"]
    for templates in ls.TEMPLATES.values():
        for t in templates:
            for _ in range(6):
                good = sample(t, rng)
                spoiled = good.split()
                spoiled.insert(rng.randrange(1, len(spoiled)), "unless")
                texts += [good, "Some words before. " + good + " and after", " ".join(spoiled), " ".join(good.split()[:-1])]
    texts.append("word " * 60_000 + sample(ls.TEMPLATES["mit-text"][0], rng) + " word" * 60_000)
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id bigint, text string"))
    got = sorted((str(r.doc_id), *r[1:8]) for r in ls.scan(docs).drop("passages").collect())
    assert got == sorted((str(r.doc_id), *brute(r.text)) for r in docs.collect())
    assert {label for r in got for label in r[6].split(",")} >= set(ls.TEMPLATES)
    assert ls.scan(no_docs).count() == 0


@settings(max_examples=400, deadline=None, database=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "d"]), max_size=14), st.sampled_from([
    "a b", "a <<optional>>b<<end>> c", "<<any 0-2>> a b <<any 1-3>>", "<<optional>>a b<<end>> a <<any 0-2>> <<optional>>c <<any 1-1>><<end>> d",
    "<<optional>>a<<end>> <<optional>>b<<end>> c <<optional>>a<<end>>", "a <<any 2-2>> a",
]))
def test_automata_accept_what_the_markup_allows(words, markup):
    made = ls.compile_template(markup)
    flat, _ = ls.normalised(" ".join(words))
    want = re.search(" " + wordings(markup, "[a-d]"), " " + "".join(w + " " for w in words))
    got = list(ls.accepted(flat, made))
    assert bool(got) == bool(want)
    for start, n in got:  # every passage is allowed as a whole
        assert re.fullmatch(wordings(markup, "[a-d]"), "".join(w + " " for w in words[start : start + n]))


def test_passages_and_own_templates(spark):
    docs = spark.createDataFrame([(1, "by Ann Lee, all rights kept -- by Bob"), (2, "kept by")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in ls.scan(docs, phrases={"rights kept": "kept"}, templates={"own": ("by <<any 1-3>> all rights <<optional>>are<<end>> kept",)}).collect()}
    assert (got[1].labels, got[1].base_labels, got[1].score) == ("kept,own", "kept", 0.5)
    assert [tuple(p) for p in got[1].passages] == [("own", 0, 6)] and got[2].labels == ""


@pytest.mark.parametrize("markup", ["", "<<any 0-3>>", "<<optional>>a<<end>>", "a <<optional>> b", "a <<end>>", "a <<any 3-1>>", "a <<any>>", "a << b", "a <<optional>><<optional>>b<<end>><<end>>"])
def test_broken_markup_is_refused(markup):
    with pytest.raises(ValueError):
        ls.compile_template(markup)
