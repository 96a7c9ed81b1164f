import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import queries, token_output, tokens, vector_packing
from lexloom.plans import scale

PATH = tokens.default_path()
PARTS = ["Œuvre", "l’Été", "«ÀÿÞ»", "¿Qué?…", "×", "ÿ÷", "The ", "don't", "WE'LL", "12a", "\n", " ", " ", "\x1c", "\x00", "É", "é", " ́", "ß", "İ", "ΑΣ", "<|endoftext|>", "<|", "!!", "日本", "x" * 90, "'s", "a'Re", "ſ", " ", "K"]


def reference(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    return [e.ids for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_by_word_ids_are_the_tokenizers_own():
    made = tokens.Encoder(PATH)
    assert made.by_word

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=4)), max_size=12), min_size=1, max_size=4))
    def same(texts):
        texts = ["".join(t).encode("utf-8", "ignore").decode() for t in texts]
        got = [np.frombuffer(raw, made.dtype).tolist() for raw in made.encode([*texts, None])]
        assert got == reference([*texts, None])

    same()


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(100, 100, 10000.0), (100, 3, 4000.0), (100, 100, 2500.0)])
def test_every_constraint_holds(rule, capacity):
    rng = random.Random(5)
    most = int(min(100, capacity[2] ** 0.5))
    lengths = np.array([rng.randint(1, most) for _ in range(700)])
    bins, offsets = vector_packing.best_fit(lengths, np.array(capacity, float), vector_packing.WEIGHTS, rule)
    by_bin = defaultdict(list)
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        by_bin[b].append((o, n))
    for parts in by_bin.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
        assert sum(n for _, n in parts) <= capacity[0] and len(parts) <= capacity[1] and sum(int(n) ** 2 for _, n in parts) <= capacity[2]
    if capacity[1] == 100 and capacity[2] == 10000.0:
        assert len(by_bin) <= 1.02 * lengths.sum() / 100 + 1


def test_a_piece_that_fits_nowhere_is_an_error():
    with pytest.raises(ValueError):
        vector_packing.best_fit(np.array([11]), np.array([10, 10, 100.0]), (1, 1, 1), "norm")


def brute_pieces(docs):
    rows, want = docs.select("doc_id", "text").collect(), []
    for k, ids in zip([r.doc_id for r in rows], reference([r.text for r in rows]), strict=True):
        ids = np.array([*ids, 0])
        want += [(k, n, s, len(ids[s : s + 2048]), tokens.crc32(ids[s : s + 2048])) for n, s in enumerate(range(0, len(ids), 2048))]
    return sorted(want, key=str)


@pytest.fixture(scope="module")
def expected(odd_docs):
    return brute_pieces(odd_docs)


def test_queries_agree_with_the_tokenizer_over_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    want = brute_pieces(spark.read.parquet(f"{sf}/documents.parquet"))
    for name, place in (("op4_token_output", ["bundle", "sequence"]), ("op10_vector_packing", ["sequence_id"])):
        rows = queries.QUERIES[name](spark, sf).collect()
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == want
        check_places(rows, place)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_CHARS", 7)
    texts = ["one two three four", "x" * 40, "a b", "é " * 30 + "日本 語", None, " \n ", "don't can't"]
    made = tokens.Encoder(PATH)
    assert [np.frombuffer(raw, made.dtype).tolist() for raw in made.encode(texts)] == reference(texts)


def check_places(rows, name):
    by = defaultdict(list)
    for r in rows:
        by[tuple(r[n] for n in name)].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
        assert sum(n for _, n in parts) <= 2048
    return len(by)


def test_vector_packing_of_odd_rows(odd_docs, no_docs, expected):
    rows = vector_packing.packed_documents(odd_docs).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == expected
    check_places(rows, ["sequence_id"])
    assert vector_packing.packed_documents(no_docs).count() == 0


def test_packing_wastes_little(spark):
    rng = random.Random(2)
    rows = [(i, 0, rng.choice([rng.randint(1, 2048), rng.randint(1, 300), 2048])) for i in range(6000)]
    stored = scale.materialise(spark.createDataFrame(rows, "row bigint, piece int, length bigint"), "lengths")
    packed = vector_packing.pack(stored, group_rows=2000).collect()
    least = -(-sum(n for _, _, n in rows) // 2048)
    assert check_places(packed, ["sequence_id"]) <= 1.01 * least + 3


def test_segment_tree_finds_the_least_room():
    rng, rooms, open_rooms = random.Random(1), token_output.Rooms(50), []
    for row in range(2000):
        if rng.random() < 0.5:
            room = rng.randint(0, 50)
            rooms.put(room, row)
            open_rooms.append(room)
        else:
            need = rng.randint(1, 50)
            want = min((r for r in open_rooms if r >= need), default=None)
            got = rooms.take(need)
            assert (got and got[0]) == want
            if want is not None:
                open_rooms.remove(want)


def test_written_matrices_read_back(spark, odd_docs, no_docs, expected):
    folder = scale.scratch_path(spark, "packed")
    index = token_output.write_packed(odd_docs, folder, buffer_tokens=20000)
    rows = token_output.read_packed(index).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == expected
    check_places(rows, ["bundle", "sequence"])
    ids, cu, positions = token_output.read_bundle(rows[0].bundle)
    assert ids.shape[1] == 2048 and all(c[0] == 0 and c[-1] <= 2048 for c in cu)
    assert positions[0][: cu[0][1]].tolist() == list(range(cu[0][1]))
    assert token_output.read_packed(token_output.write_packed(no_docs, folder)).count() == 0
