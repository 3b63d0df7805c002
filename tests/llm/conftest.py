import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, anchor string, ids string, score string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in all columns, empty and long texts, ties, repeated rows, and columns with clashing names."""
    line = "This line is often found in documents, Word for word"
    near = [" ".join(f"w{i}" if i != k * 7 else f"x{k}" for i in range(60)) for k in range(6)]
    long = " ".join(f"t{i * i % 977}" for i in range(20_000))
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, f"{line}\nshort\n  {line.upper()}\t"), (4, f"a\n{line}\n\nz"), (5, line), (6, line + "  "),
            (7, long), (8, "y " + long), (9, "un seul é à ▁ 漢字 😀 mot  deux"), (10, "x"), (10, "x"), (11, near[0]), (11, near[0]), (12, near[0])]
    rows += [(20 + k, t) for k, t in enumerate(near)] + [(30, near[0] + "\n" + line)]
    rows += [(None, near[0]), (None, None), (None, line), (40, "one two three"), (41, "one two three"), (42, "ab\x0bcd\x0cef\x1cgh ij")]
    rows = [(i, t, "en" if (i or 0) % 3 else None, [None, "a", "b", "c", "é"][(i or 0) % 5], None if t is None else len(t), -1, "q", None, "s")
            for i, t in rows]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
