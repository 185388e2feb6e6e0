import random

import pytest

CLASHING = "id bigint, kept string, h string, size string, label string, text_sha256 string, p string, fp string, before string"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, copies, near copies, repeated rows, a null id and clashing columns."""
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta,", "epsilon.", "zeta\n", "ünïcode", "日本", "x1", "<|endoftext|>", "don't"]
    body = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 60))) for _ in range(40)]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(30_000))
    texts = [None, "", " \t\n", long, long, long.upper(), *body, *body[:12], *[b.upper() for b in body[:5]]]
    near = " ".join(f"w{i}" for i in range(400))
    texts += [near, near.replace("w7 ", "v7 "), near.replace("w9 ", "v9 "), near + " end", None, "", "a" * 5000]
    rows = [(i, t, rng.choice([None, "a", "b", "c"]), "en") for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, body[0], "a", None), (7, "another text", None, None)]
    clash = (1, None, "h", None, "0", "s", None, "f", "b")
    return spark.createDataFrame([(*r, *clash) for r in rows], f"doc_id bigint, text string, source string, lang string, {CLASHING}")


@pytest.fixture
def no_documents(odd_documents):
    return odd_documents.filter("false")
