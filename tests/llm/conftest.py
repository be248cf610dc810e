import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, line string, w string, hits string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with nulls in every column and extra columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, None, f"src{k % 3}" if k % 4 else None, None if t is None else len(t), "x", None, "y") for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, control characters, other alphabets."""
    long = " ".join(f"w{i % 977} the of{i % 31}" for i in range(40_000))
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, None), (1, None), (2, ""), (3, " \t\n\r "), (None, base), (4, base), (4, base), (5, base.upper()), (6, long), (7, "a"),
            (8, "Ünïcode straße ÉÉ\x00x\x0by z 中文 words"), (9, "line\nLine \n\n line\t\nother"), (10, base + "\n" + base)]
    return rows + [(100 + k, f"shared line here\nown {k} text number {k}\n  SHARED line here ") for k in range(14)]
