import pytest

from oracle import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, rank string, copies string, score string, fp string, sketch string, kept string, target string"
CLASH = tuple("x" for _ in range(9))
LONG = "long words run on and on. " * 9000 + "end"

TEXTS = [
    None, "", "   \n\t ", "word", "two words", "a b c", "1234 567 !!", "日本語 текст é", "\x00 odd \x85 marks   here",
    "same text here for both", "same text here for both", "same text here for both", "SAME text here for both", LONG,
    "aaaa " * 300, "line one\nline one\n\nline two\nline one", "<|endoftext|> <s> </s> <unk> ▁x  y", "x" * 5000, "it's we'll they'd. ok, fine., (a), b).",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, tied, repeated and very long texts, and columns of clashing names."""
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", None, "s2")[i % 3], None if t is None else len(t), *CLASH) for i, t in enumerate(TEXTS)]
    rows += [(3, "word", "en", "s1", 4, *CLASH), (3, "word", "en", "s1", 4, *CLASH), (None, "no id here at all", None, None, None, *CLASH)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture
def as_tables(tmp_path):
    """Write a documents table and give its folder, for whole queries."""

    def write(df):
        df.write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return write
