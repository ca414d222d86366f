import pytest

WORDS = "the of and to in is that it for was on are with as be by at from this have".split()


def made_text(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) pairs, with the other columns filled in."""

    def make(rows):
        full = [(d, t, "en", "src0", None if t is None else len(t)) for d, t in rows]
        return spark.createDataFrame(
            full, "doc_id bigint, text string, lang string, source string, n_chars bigint"
        ).repartition(3)

    return make
