from __future__ import annotations

import pytest

from ledgermill.llm.common import ship

LONG = "Überall long words, 10 of them; and some MORE words here\n" * 4000
ODD_TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "ONE",
    "cc by",
    "Été K İ \U0001f600 café",
    "a b c d e f g h i j k l m n",
    "A B C D E F G H I J K L M N",
    "a b c d e f g h i j k l m n",
    "a b c d e f g h i j k l m o",
    "tab\tand\x0bvertical\x0cfeed\r\nline\n\nline\nline\n line",
    "\x1f\x1c\x85   odd spaces here",
    LONG,
    LONG,
    LONG + "tail",
]


@pytest.fixture(scope="session")
def llm_spark(spark):
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def odd_docs(llm_spark):
    """Null, empty, long and repeated texts, with extra columns named like results."""
    rows = [(i, t, "en", "src", 1, True, 7) for i, t in enumerate(ODD_TEXTS)]
    return llm_spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, "
        "kept boolean, component_id long",
    )


@pytest.fixture(scope="session")
def documents(llm_spark, oracle_dir):
    return llm_spark.read.parquet(f"{oracle_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [tuple(r) for r in documents.select("doc_id", "text").orderBy("doc_id").collect()]
