import pytest
from pyspark.sql.types import StructType

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source, lang) rows, with columns whose names may clash."""

    def of(rows, extra=True):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, StructType.fromDDL(DOCS)).repartition(3)
        if extra:
            for c in ("h", "fp", "key", "size", "_doc", "_hash", "component_id", "pos"):
                df = df.selectExpr("*", f"'clash' as `{c}`")
        return df

    return of


@pytest.fixture(scope="session")
def prose():
    """Text of n words, the same for the same seed."""
    import random

    syllables = "ba be bi bo da de di do fa fe ga ge ka ke la le ma me na ne pa pe ra re sa se ta te va ve za ze".split()

    def of(n, seed):
        r = random.Random(seed)
        out = []
        for k in range(n):
            w = "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
            out.append(w + ("." if k % 11 == 10 else ""))
        return " ".join(out) + "."

    return of
