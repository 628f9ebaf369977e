import pytest

WORDS = ("the of and to in house river stone light water green old new small great and of the by with from "
         "garden winter summer market letter window harbour village morning evening").split()


def prose(n: int, seed: int = 0) -> str:
    """n words, the same for the same seed."""
    x, out = seed * 7919 + 13, []
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 65536 % len(WORDS)] + (str(seed) if i % 11 == 5 else "") + (".\n" if i % 9 == 8 else ""))
    return " ".join(out)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, key int, f0 string, node string, _local int"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank, very long and repeated texts, repeated ids, clashing column names."""
    rows = [(i, prose(60 + i, i), "en", f"s{i % 4}", i) for i in range(30)]
    rows += [(30, None, "en", "s0", 1), (31, "", "en", "s1", 0), (32, " \n\t ", None, None, None), (None, prose(80, 77), "en", "s2", 5),
             (33, prose(60, 0), None, "s3", 1), (34, prose(60, 0), "en", None, 1), (34, prose(60, 0), "en", None, 1),
             (35, prose(6000, 5), "en", "s0", 9), (36, "word", "xx", "s9", 1), (37, "ÄÖ ß %%% ### $$$ ***", "en", "s1", 2)]
    return [(*r, "x", 7, "f", "n", 1) for r in rows]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
