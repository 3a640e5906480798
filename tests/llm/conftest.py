import random

import pytest

from trialspark.llm.common import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=1, n=60):
    """Small corpus with copies, near copies, shared passages, nulls, blanks, a hot source and a very long text."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Über", "ça", "的", "X#", "a|b"]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([3, 40, 90, 300]))]
        if i % 5 == 0:
            words[1:1] = passage
        text = " ".join(words[:len(words) // 2]) + "\n" + "\t".join(words[len(words) // 2:])
        rows.append([i, text, "en", "hot" if i % 3 else f"s{i % 4}", len(text)])
    for i in range(12):
        rows.append([100 + i, rows[i % 4][1] + (" w7" if i % 2 else ""), "de", "hot", 1])
    rows.append([200, None, None, None, None])
    rows.append([201, "", "en", "s1", 0])
    rows.append([202, " \n\t ", "en", None, 4])
    rows.append([203, "one two", "en", "s2", 7])
    rows.append([204, "ha " * 500, "en", "s2", 1500])
    rows.append([205, "na na batman " * 60, "en", "s2", 1500])
    rows.append([206, " ".join(r.choice(vocabulary) for _ in range(30_000)), "en", "s3", 1])
    rows.append([None, "no id here but words " * 20, "en", "s3", 1])
    rows.append(list(rows[0]))  # a repeated row
    return [tuple(x) for x in rows]


@pytest.fixture(scope="session")
def corpus(spark):
    prepare(spark)
    rows = documents()
    return spark.createDataFrame(rows, DOCS).repartition(4).cache(), rows


@pytest.fixture()
def nothing(spark):
    return prepare(spark).createDataFrame([], DOCS)
