import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.sparkContext.getConf().get("spark.checkpoint.dir") and not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")


@pytest.fixture(scope="session")
def table(spark):
    """documents from (id, text) or (id, text, lang) rows; the frame has columns whose names the operators use inside."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(parts)
        for c in ("id", "crc", "uid", "slot_", "h", "p", "spans", "run", "token", "node", "comp", "label", "word", "held_out", "lang_pred", "kind", "size"):
            df = df.selectExpr("*", f"'x' as {c}")
        return df

    return make


@pytest.fixture(scope="session")
def corpus():
    """A small corpus with nulls, empties, blanks of all kinds, ties, repeated rows, a long text and passages in common."""
    import random

    r = random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=r.randint(1, 7))) for _ in range(400)]
    line = lambda n: " ".join(r.choices(words, k=n))
    passage, base = line(60), line(120)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One two\tthree"), (6, base), (7, base), (8, base.upper()), (9, base.replace(base.split()[5], "zzz", 1)),
            (10, line(30) + "\n" + passage + " " + line(20)), (11, line(10) + " " + passage), (12, passage), (13, "la " * 90), (14, line(3000)), (None, line(40)),
            (15, "x y z\n" * 30), (16, "éà ü 漢字 <|endoftext|> it's  WE'LL 12 "), (17, line(19)), (18, line(20)), (18, line(20)), (19, base), (19, base)]
    for k in range(20, 40):
        w = base.split()
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((k, " ".join(w)))
    return rows
