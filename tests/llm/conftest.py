import random

import pytest
from pyspark.sql import types as T

#: Columns that clash with names the operators use.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("row", "key", "size", "n", "token", "host", "rate", "shard", "spans", "gram", "media", "ids", "kept")],
    ]
)


def rows(texts, sources=None, langs=None):
    extra = ("x",) * (len(SCHEMA) - 5)
    return [(i if i is None or isinstance(i, int) else int(i), t, (langs or {}).get(k, "en"), (sources or {}).get(k, f"src{k % 3}"), len(t or ""), *extra) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    def f(texts, **options):
        """texts: a list of texts, or of (doc_id, text)."""
        pairs = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        return spark.createDataFrame(rows(pairs, **options), SCHEMA)

    return f


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, periods, odd bytes, nulls."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdeé漢xyz") for _ in range(rnd.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, long = text(60), text(3000)
    base = text(120).split()
    near = [" ".join(base[:k] + ["edit" + str(k)] + base[k + 1 :]) for k in (3, 50, 90)]
    out = [
        None, "", " ", "one", "one two", "One Two", "one two three four five", text(200), long, long + " tail", *near, *near[:1],
        text(40) + " " + passage + " " + text(40), passage + "\n" + text(30), text(10) + "\t" + passage, "ab " * 300, "z" * 900, "na na na\nna na na\n" * 20,
        "é" * 150, "é" * 149 + "e", text(80), "🙂 'll don't  stop\r\n\x0b" * 15,
    ]
    for k in range(25):
        cut = rnd.randint(0, 40)
        out.append(text(cut) + " " + passage[rnd.randint(0, 80) :] + " " + text(rnd.randint(0, 40)))
    return out
