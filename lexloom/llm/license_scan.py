"""License scans: notices found by token automata compiled from template markup.

A template is wording with two kinds of regions: ``<<optional>> ... <<end>>`` may be left out, and
``<<any 0-8>>`` stands for that many words of any kind (a holder, a year, a name). Words are compared, so case,
punctuation and line breaks do not count. A template becomes an automaton over words: its states are the places in the
template, a word leads to the places that may follow, past optional regions or round replaceable ones. A text
has the template's label if the automaton accepts some passage of it, that is, if the mandatory wording stands there
word for word and everything else is allowed by the markup.

Texts are read once and whole. Every passage that is accepted holds the template's longest run of mandatory words
(its anchor), and all regions are bounded; so the automaton runs only over the words round each place of
the anchor, as far as the longest passage reaches, and no passage can be missed. Plain phrases are counted besides,
and their labels stay whatever the templates say.

Defined cases: a null or empty text has no words, no labels (empty strings), a score of zero and no first or last word;
repeated rows and null keys are scanned like any other row; an empty table gives an empty result. The score is the
share of a text's labels that an accepted template gives. Extra columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Phrase and label.
PHRASES: dict[str, str] = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Label and templates: short notices, headers and whole licenses.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0-notice": (
        "licensed under the apache license <<optional>>version<<end>> 2 0",
        """licensed under the apache license version 2 0 the license you may not use this <<any 1-4>> except in compliance with the
        license you may obtain a copy of the license at <<any 1-12>> unless required by applicable law or agreed to in writing software
        distributed under the license is distributed on an as is basis without warranties or conditions of any kind either
        express or implied see the license for the specific language governing permissions and limitations under the license""",
    ),
    "cc-by-4.0-notice": (
        "licensed under <<optional>>a<<end>> <<optional>>the<<end>> cc by 4 0",
        """licensed under <<optional>>a<<end>> <<optional>>the<<end>> creative commons attribution 4 0 <<optional>>international<<end>>
        <<optional>>public<<end>> license""",
    ),
    "cc-by-nc-4.0-notice": (
        "licensed under <<optional>>a<<end>> <<optional>>the<<end>> cc by nc 4 0",
        """licensed under <<optional>>a<<end>> <<optional>>the<<end>> creative commons attribution noncommercial 4 0
        <<optional>>international<<end>> <<optional>>public<<end>> license""",
    ),
    "cc0-notice": (
        "<<optional>>dedicated to the public domain<<end>> under <<optional>>the<<end>> <<optional>>creative commons<<end>> cc0 1 0",
    ),
    "gpl-notice": (
        "licensed under <<optional>>the terms of<<end>> the <<optional>>gnu<<end>> general public license version <<any 1-2>>",
        """this <<any 1-4>> is free software you can redistribute it and or modify it under the terms of the gnu general public license as
        published by the free software foundation either version <<any 1-2>> <<optional>>of the license<<end>> or at your option any
        later version""",
    ),
    "mit-notice": (
        "released under the <<optional>>terms of the<<end>> mit license",
        "licensed under the <<optional>>terms of the<<end>> mit license",
    ),
    "mit-text": (
        """permission is hereby granted free of charge to any person obtaining a copy of this <<any 1-8>> to deal in <<any 1-4>> without
        restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
        copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all
        copies or substantial portions of the software the software is provided as is without warranty of any kind""",
    ),
    "isc-text": (
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
        that the above copyright notice and this permission notice appear in all copies""",
    ),
    "bsd-text": (
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met <<any 0-1>> redistributions of source code must retain the above copyright notice this list of conditions and
        the following disclaimer <<any 0-1>> redistributions in binary form must reproduce the above copyright notice this list of
        conditions and the following disclaimer in the documentation and or other materials provided with the distribution
        <<optional>><<any 0-1>> neither the name of <<any 1-12>> nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission<<end>>
        this software is provided by <<any 1-12>> as is""",
    ),
}

_TOKEN = re.compile(r"<<\s*(optional|end|any)\s*(?:(\d+)\s*-\s*(\d+)\s*)?>>|([^<>]+)")
# Bytes outside words become blanks, capitals small letters; bytes from 128 on belong to words.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SLICE = 1 << 20


def normalised(text: str | None) -> tuple[bytes, int]:
    """The words of a text between single blanks, one before the first and one after the last, and their number."""
    flat, parts, n, at = (text or "").encode().translate(_NORMAL), [], 0, 0
    while at < len(flat):  # in slices that end between words, so that few words are held at a time
        end = flat.find(b" ", min(at + _SLICE, len(flat)))
        words = flat[at : len(flat) if end < 0 else end].split()
        if words:
            parts.append(b" ".join(words))
            n += len(words)
        at = len(flat) if end < 0 else end
    return (b" " + b" ".join(parts) + b" " if n else b""), n


def places(flat: bytes, phrase: bytes) -> Iterator[int]:
    """Where the words of ``phrase`` (between blanks) stand in a normalised text, overlaps included."""
    at = flat.find(phrase)
    while at >= 0:
        yield at
        at = flat.find(phrase, at + 1)


@dataclass
class Automaton:
    """States are places in a template; ``words[s]`` is the word that leads into a state, None for any word."""

    words: list[bytes | None] = field(default_factory=list)
    follow: list[set[int]] = field(default_factory=list)
    first: set[int] = field(default_factory=set)
    last: set[int] = field(default_factory=set)
    anchor: bytes = b""
    before: int = 0  # most words of a passage before its anchor, and from there on
    after: int = 0

    def passages(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Start and end of passages that are accepted, by end; of several starts the first."""
        active: dict[int, int] = {}
        for at, word in enumerate(words):
            reached: dict[int, int] = {}
            for state, start in [*((t, s) for f, s in active.items() for t in self.follow[f]), *((t, at) for t in self.first)]:
                if self.words[state] is None or self.words[state] == word:
                    reached[state] = min(start, reached.get(state, start))
            active = reached
            ends = [s for t, s in active.items() if t in self.last]
            if ends:
                yield min(ends), at + 1


def compile_template(markup: str) -> Automaton:
    """The automaton of a template; an error if its markup is broken or it has no mandatory word."""
    made = Automaton()
    # Where the wording can stand so far: the states passed last, and whether nothing has been passed yet.
    ends, fresh, open_region = set(), True, None
    run, best, longest, longest_at = [], [], 0, 0

    def step(word: bytes | None, skippable: bool) -> None:
        nonlocal ends, fresh
        state = len(made.words)
        made.words.append(word), made.follow.append(set())
        for e in ends:
            made.follow[e].add(state)
        if fresh:
            made.first.add(state)
        ends = ends | {state} if skippable else {state}
        fresh = fresh and skippable

    if re.sub(_TOKEN, "", markup).strip():
        raise ValueError(f"broken markup in {markup!r}")
    for found in _TOKEN.finditer(markup):
        kind, least, most, plain = found.groups()
        if kind == "optional":
            if open_region is not None:
                raise ValueError("optional regions do not nest")
            open_region, run = (ends, fresh), []
        elif kind == "end":
            if open_region is None:
                raise ValueError("a region ends that was not begun")
            ends, fresh = ends | open_region[0], fresh or open_region[1]
            open_region, run = None, []
        elif kind == "any":
            if most is None or int(least) > int(most):
                raise ValueError(f"a replaceable region needs its least and most words: {found.group()}")
            for k in range(int(most)):
                step(None, k >= int(least))
            run = []
        else:
            for word in normalised(plain)[0].split():
                step(word, False)
                if open_region is None:
                    run.append(word)
                    if len(run) > len(best):
                        best, longest_at = list(run), len(made.words) - len(run)
    if open_region is not None:
        raise ValueError("a region has no end")
    if not best:
        raise ValueError("a template needs a mandatory word")
    made.last, made.anchor = ends, b" " + b" ".join(best) + b" "
    # Every state takes one word, so the states before and from the anchor bound the passage.
    made.before, made.after = longest_at, len(made.words) - longest_at
    return made


def spans(flat: bytes, made: Automaton) -> Iterator[tuple[int, int]]:
    """Byte ranges of a normalised text that hold every passage round an anchor; ranges that overlap are one."""
    low = high = -1
    for at in places(flat, made.anchor):
        a = at
        for _ in range(made.before):
            if a <= 0:
                break
            a = flat.rfind(b" ", 0, a)
        b = at
        for _ in range(made.after):
            after = flat.find(b" ", b + 1)
            if after < 0:
                break
            b = after
        if high >= a:
            high = b
            continue
        if high >= 0:
            yield low, high
        low, high = a, b
    if high >= 0:
        yield low, high


def accepted(flat: bytes, made: Automaton) -> Iterator[tuple[int, int]]:
    """First word and number of words of accepted passages in a normalised text."""
    counted, at_word = 0, 0
    for low, high in spans(flat, made):
        at_word += flat.count(b" ", counted, low)
        counted = low
        for start, end in made.passages(flat[low:high].split()):
            yield at_word + start, end - start


_RESULT = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "passages array<struct<label: string, first_word: bigint, n_words: bigint>>"
)


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    phrases: Mapping[str, str] | None = None,
    templates: Mapping[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """One row per document: counts, labels and score, and the first accepted passage of every label."""
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    sought = [(b" " + b" ".join(normalised(p)[0].split()) + b" ", label) for p, label in phrases.items()]
    machines = [(label, [compile_template(t) for t in texts]) for label, texts in templates.items()]
    source = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    schema = T.StructType([source.schema.fields[0], *T.StructType.fromDDL(_RESULT).fields])

    def look(text: str | None) -> dict:
        flat, n = normalised(text)
        n_base, first, last, base = 0, None, None, set()
        for phrase, label in sought:
            found = None
            for at in places(flat, phrase):
                if found is None:
                    first = at if first is None else min(first, at)
                found = at
                n_base += 1
            if found is not None:
                base.add(label)
                last = found if last is None else max(last, found)
        passages = []
        for label, made in machines:
            hits = [p for p in (next(accepted(flat, m), None) for m in made) if p is not None]
            if hits:
                passages.append({"label": label, "first_word": min(hits)[0], "n_words": min(hits)[1]})
        own = {p["label"] for p in passages}
        return {
            "n_words": n,
            "n_base": n_base,
            "first_word": None if first is None else flat.count(b" ", 0, first),
            "last_word": None if last is None else flat.count(b" ", 0, last),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | own)),
            "score": len(own) / len(base | own) if own else 0.0,
            "passages": passages,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = pa.schema([f for f in to_arrow_schema(schema)][1:])
        for batch in batches:
            made = pa.RecordBatch.from_pylist([look(t.as_py()) for t in batch.column("text")], kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], names=schema.fieldNames())

    return source.mapInArrow(run, schema)
