import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(15_000))
PROSE = (
    "The river was high that spring, and the old bridge had not been mended since the war. Nobody in the village "
    "thought it would last another year, but the council met only twice, and each time the money went to the school."
)
#: Names that operators use inside or add.
CLASHING = ["size", "copies", "copy", "fp", "key", "n", "spans", "kept", "score", "pattern", "_text", "ids", "k1",
            "gram", "first", "_in0", "_bucket", "hash", "n_entities", "decoded", "target", "weight"]


@pytest.fixture(scope="session")
def fixture_docs():
    """The smallest documents, as pandas."""
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Rows no operator may fall over: missing values, empty, long and repeated texts, clashing columns."""
    rows = [
        (1, PROSE, "en", "a"), (2, "", "en", "a"), (3, None, None, None), (None, PROSE + " Once more.", "fr", "b"),
        (4, LONG, "xx", "b"), (5, PROSE, "en", None), (5, PROSE, "en", None), (6, "a" * 3000, "de", "c"),
        (7, " \n\t ", "en", "c"), (None, None, None, None), (8, "日本語のテキスト 😀 password=hunter2hunter2", "ja", "c"),
    ]
    full = [(i, t, lang, s, None if t is None else len(t), *range(len(CLASHING))) for i, t, lang, s in rows]
    names = ", ".join(f"`{c}` long" for c in CLASHING)
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {names}").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id > 1000000")
