import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, keys string, node long, segment int"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with further columns of names used inside."""
    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, "s", 0, "x", 7, 1) for r in rows],
                                     DOCUMENTS)
    return make


#: Nulls, empty and blank texts, ties and repeated rows, odd characters, special strings, a very long text.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c d e f"), (5, "A b C d e f"), (5, "A b C d e f"), (None, "a b c d e f"),
       (None, None), (6, "Éàß Ωσς ΑΣ İ ﬁ 日本 🙂 é"), (7, "<|endoftext|> x <|startoftext|>don't 12.5%"),
       (8, "word " * 30_000), (9, "z" * 50_000), (10, "\x00\x1c\x85 a b")]
