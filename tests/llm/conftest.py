import random

import pytest
from llm_paths import SF
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "id long, row string, size string, target long, label string")


def awkward_rows():
    """Rows with nulls in any column, empty and very long texts, ties, repeated rows and names that clash."""
    rnd = random.Random(7)
    vocabulary = ["alpha", "Beta", "gamma", "straße", "été", "niño", "delta,", "the", "of", "x1", "|", "###", "日本語"]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    long = "\n".join(prose(40) for _ in range(400))
    shared = prose(30)
    texts = [
        None, "", " \t\n", "one", "one two", "A B C", shared, shared + " tail", "head " + shared, shared,
        long, long, long + "\nmore of it here", "Shti " * 400, "a" * 300, "a" * 49, "a" * 50, "ab" * 60,
        "x\n\n\nsame line of text\nsame line of text\n", "SAME LINE of text  \nother", "\v\fsame line of text\r",
        "ÄÖÜ same line", "äöü same line", "\x00nul \x00byte", "tab\tseparated\twords and more",
        "<|endoftext|> it's we'll don't 123abc", "é combining ́ mark", " no-break space",
        "🙂 emoji 🙂🙂", "same line of text", prose(200), prose(200), prose(3),
    ]
    rows = []
    for i, t in enumerate(texts):
        source = ["src0", "src0", "src1", "Ωmega", None, "", "src2"][i % 7]
        rows.append((i, t, ["en", None, "de"][i % 3], source, len(t or ""), 99 - i, "r", "s", i, None))
    rows += [(None, shared, None, None, None, None, None, None, None, None),
             (None, None, None, None, None, None, None, None, None, None),
             (6, shared, "en", "src1", 1, 1, "r", "s", 1, "l"), (6, shared, "en", "src1", 1, 1, "r", "s", 1, "l"),
             (6, "another text of the same id, " + shared, "en", "src1", 1, 1, "r", "s", 1, "l")]
    # a hot group: many near copies of one text, and many exact ones
    base = [rnd.choice(vocabulary) + str(rnd.randrange(30)) for _ in range(120)]
    for i in range(60):
        copy = list(base)
        for k in range(rnd.randrange(9)):
            copy[rnd.randrange(120)] = f"edit{rnd.randrange(1000)}"
        rows.append((1000 + i, " ".join(copy), "en", "hot", 1, i, "r", "s", i, "l"))
    rows += [(2000 + i, " ".join(base), "en", "hot", 1, i, "r", "s", i, "l") for i in range(20)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def rows(awkward):
    return [r.asDict() for r in awkward.collect()]


@pytest.fixture(scope="session")
def none(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def sf_rows(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
