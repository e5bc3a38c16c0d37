"""Small tables of awkward rows, and brute-force versions of the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward(seed=1, words=("der", "la", "tion", "Ethe", "of,", "és", "x"), n=40):
    """Nulls in any column, empty and long texts, ties, repeated rows, and copies with small changes."""
    r = random.Random(seed)
    base = [r.choice(words) for _ in range(300)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a b"), (None, None), (None, " ".join(base)), (None, " ".join(base[40:140])), (5, " ".join(base)), (5, " ".join(base)), (6, "\n".join(base[:90])), (7, "word " * 6000)]
    rows += [(10 + i, text(r.randint(0, 120))) for i in range(n)]
    rows += [(100 + i, " ".join(base[: 60 + i] + [f"w{i}"] + base[60 + i :])) for i in range(8)]
    return rows


def frame(spark, rows, extra=True):
    """``rows`` with the columns of documents, and some whose names operators use themselves."""
    full = [(d, t, None if d is None else "en", "src", None, "x", 1) if extra else (d, t) for d, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, id int" if extra else "doc_id long, text string"
    return spark.createDataFrame(full, schema).repartition(3)


def words(text):
    return WORD.findall(text or "")


def twins(k):
    """Two strings of ``2**k`` letters that share every polynomial hash modulo a power of two, and their separation at the ends."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(1 << k))
    return a, a.translate(str.maketrans("ab", "ba"))
