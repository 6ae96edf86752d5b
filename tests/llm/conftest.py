import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "an er in on th re ed le ou ti st en at nd or".split()


def prose(seed: int, words: int, letters=SYLLABLES) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(letters, k=r.randint(1, 5))) for _ in range(words))


def edited(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join("changed%d" % r.randint(0, 99) if r.random() < share else w for w in text.split(" "))


def hard_rows():
    """Copies, near copies, shared passages, nulls, blanks, ties, a very long text and repeated rows."""
    base = [prose(i, 40 + 17 * i) for i in range(12)]
    passage = prose(99, 60)
    long_text = prose(7, 30_000)
    texts = [
        *base, base[3], base[3], base[5].upper(), edited(base[9], 1, 0.01), edited(base[10], 2, 0.01), edited(base[11], 3, 0.05), None, "", "   \n\t ", "one", "one two", "One  TWO",
        f"{base[1]} {passage} {base[2]}", f"{passage}\n{base[4]}", f"x {passage}", long_text, f"{prose(8, 40)} {long_text[5000:9000]}", "la la " * 400,
        "é" * 300 + " ü ß " + "日本語 " * 30, "a\x0bb\x0cc\rd \x85   e", f"Licensed under CC BY-NC 4.0.\n{prose(21, 60)}\nAll rights reserved.",
        "| # * " * 40 + "\n" + "| # * " * 40,
    ]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (3, base[6], "en", "src0", 1), (None, base[7], "en", "src1", 1), (None, prose(50, 80), None, None, None), (None, base[7], None, "src2", 1)]
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    """The rows above; the text column order and extra columns clash with names used inside."""
    df = spark.createDataFrame(hard_rows(), SCHEMA)
    for extra in ("doc", "tie", "spans", "words", "fp", "copies", "gone", "kept_"):
        from pyspark.sql import functions as F

        df = df.withColumn(extra, F.lit("x"))
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
