import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, raw string, fp string, sha string, row string, block int, lane string, kept boolean, queue string, n int, label string, key string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000)) + "\n" + "a" * 50_000
BASE = "the quick brown fox jumps over the lazy dog while seventeen patient herons watch from reeds near still water at dawn every single day"
TEXTS = [(1, BASE), (2, None), (3, ""), (4, "hello"), (5, BASE), (5, BASE), (6, BASE.replace(" ", "  \t")), (7, " \n\t "), (8, LONG), (9, "Ünïcode ÀÉ ß 中文 の 한 ￼ \x1c \x85 x"), (10, BASE.upper()), (11, BASE + " and night"), (None, "no id here"), (None, None), (12, "a b c"), (13, "A B C"), (14, "<|endoftext|> x <|startoftext|>"), (15, ("spam spam " * 40).strip()), (16, "\n".join(["same line here"] * 5 + ["", "other"]))]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with every awkward case, and columns whose names operators use inside."""
    rows = [(i, t, "en" if k % 3 else None, None if k % 5 == 0 else f"s{k % 2}", 1, 7, "r", "f", "s", "w", 1, "l", False, "q", 3, "b", "k") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
