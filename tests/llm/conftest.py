import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard string, id string"


def awkward_texts():
    """Null, empty, blank and long texts, ties, repeated rows and passages."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéß漢", k=rng.randint(1, 9))) for _ in range(300)]
    vocabulary += ["The", "the", "ÉCLAIR", "a#b", "x|y", "\U0001f600k"]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    line, passage = say(14), say(60)
    texts = [None, "", " ", "\n", "\t\n \r\n", "one", "one two", "One Two", "one two three", "a\u00a0b c", "x" * 300]
    base = say(120).split()
    for k in range(12):
        edited = list(base)
        edited[(7 * k) % 120] = f"edit{k % 5}"
        texts.append(" ".join(edited))
        texts.append(say(30) + "\n" + line + ("  " if k % 2 else "") + "\n" + say(20))
        texts.append(say(rng.randint(5, 40)) + "\n\n" + passage + "\n" + say(rng.randint(0, 30)))
        texts.append(" ".join(base) if k % 3 else " \t".join(base))
        texts.append((say(9) + "\n") * (k % 4 + 1) + say(25) + " " + say(10) * 2)
    texts.append(say(9000))
    texts.append(" ".join(base) + "  " + line.upper() + "\n" + line.upper() + "\n" + line)
    return texts


@pytest.fixture(scope="session")
def awkward(spark):
    """documents with awkward texts, unique ids and columns with clashing names."""
    rows = [(i * 3 % 1000, t, "en", None if i % 7 == 0 else f"src{i % 4}", i, "k", "s", "i") for i, t in enumerate(awkward_texts())]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def repeated(awkward):
    """As awkward, with repeated rows and a null id."""
    null = awkward.limit(1).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars", "kept", "shard", "id")
    return awkward.union(awkward.where("doc_id % 2 = 0")).union(null)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def table():
    """Writes a DataFrame as a table of a new folder and returns the folder."""
    import tempfile

    def write(**frames):
        folder = tempfile.mkdtemp(prefix="spark-")
        for name, df in frames.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return folder

    return write
