import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lexloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", memory="4g", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def text_corpus(spark):
    """A small text in which ``cat`` and ``dog`` are used alike, as ``(pos, word, label)``."""
    sentences = [
        "the cat eats fish in the house",
        "the dog eats meat in the house",
        "a bird sings songs on the tree",
    ]
    words = " ".join(sentences * 40).split()
    return spark.createDataFrame([(i, w, "") for i, w in enumerate(words)], "pos bigint, word string, label string")
