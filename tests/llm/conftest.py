import random

import pytest

CLASHING = ["k_id", "r_hash", "bad_id", "f_id", "hash", "row", "n", "h", "score", "spans", "node", "topic", "weight", "rejected", "hit_id"]
PROSE = {
    "en": "the of and to in that with for was they have this from which there their about other",
    "fr": "le de et la les des une dans pour que avec est sur par plus être français où",
    "de": "der die und das nicht ein mit auf für sich ist werden über können straße größe",
}


def sentence(rng, lang, n):
    words = PROSE[lang].split()
    return " ".join(rng.choice(words) + rng.choice(["", "", "", "s", "er"]) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Prose in three languages with nulls, empties, repeats, a very long text and clashing columns."""
    rng = random.Random(1)
    rows = []
    for i in range(240):
        lang = ["en", "fr", "de"][i % 3]
        source = "hot" if i % 3 else f"s{i % 7}"
        rows.append((i, sentence(rng, lang, 5 + i % 60), lang, source))
    rows += [
        (240, None, "en", "s1"),
        (241, "", "en", None),
        (242, " \t\n ", None, "s1"),
        (243, "12345 --- 678", "de", "s2"),
        (None, sentence(rng, "en", 12), "en", "s1"),
        (7, rows[7][1], "fr", "hot"),
        (7, rows[7][1], "fr", "hot"),
        (244, rows[7][1], "fr", "hot"),
        (245, sentence(rng, "de", 30_000), "de", "s3"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"`{c}` string" for c in CLASHING
    )
    full = [(*r, None if r[1] is None else len(r[1]), *["x"] * len(CLASHING)) for r in rows]
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
