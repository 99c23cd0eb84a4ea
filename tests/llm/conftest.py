import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, text_kept string, positions string, spans string, _text_hash long, row_number string"


@pytest.fixture(scope="session")
def docs_of():
    """A documents table with extra columns of awkward names, from (doc_id, text[, lang[, source]])."""

    def build(spark, rows):
        full = [(r + (None,) * 4)[:4] + (len(r[1]) if r[1] is not None else None, 0.5, 1, "k", "p", "s", 7, "r") for r in (tuple(x) for x in rows)]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and very long texts, repeated rows, equal texts under several ids."""
    long_text = " ".join(f"word{i % 997}x{i}" for i in range(20_000))
    return [(1, "The cat sat on the mat.", "en", "a"), (1, "The cat sat on the mat.", "en", "a"), (2, "", "en", "b"), (3, None, None, None), (None, "no id here at all", "en", "a"), (None, None, None, None), (4, long_text, "en", "b"), (5, long_text, "en", "b"), (6, " \t\n ", None, "c"), (7, "¿Qué? 漢字 привет", "es", "c"), (8, "a", None, None), (9, "The cat sat on the mat.", "fr", None)]
