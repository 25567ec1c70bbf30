import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import CLASHING

from pvspark.llm import divergence as D

TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least=10, top=10):
    df, counts, groups = Counter(), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        df.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (at, t), n in df.items() if at == lang and n >= least)
        sources = sorted(s for at, s in groups if at == lang)
        n = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        n[None] = {t: sum(n[s][t] for s in sources) for t in kept}
        p = {}
        for s, c in n.items():
            total = sum(c.values()) + 2 * len(kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}
        far = lambda a, b, t: (p[a][t] - p[b][t]) ** 2 // (p[a][t] + p[b][t])
        for s in sources:
            pairs = [(-sum(far(s, o, t) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-far(s, None, t), t.encode()) for t in kept if n[s][t] and p[s][t] > p[None][t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(ranked)}
    return out


def result(docs, **kw):
    found = D.divergences(docs, **kw)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert dict(found.dtypes)["value"] == "bigint" and dict(found.dtypes)["rank"] == "int"
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = ["the", "The", "of", "\u00dcber", "\u00fcber", "x1y", "na\u00efve", "\u65e5\u672c", "a-b", "don\u2019t", "\U0001f600", "tie", "eit"]
    words += [f"w{chr(97 + i)}" for i in range(26)]
    out = []
    for i in range(400):
        lang = ["en", "en", "de", None, "fr"][i % 5]
        source = "hot" if i % 3 else rng.choice(["s1", "s2", "\u00e9", "\uffff", "\U00010000", None])
        out.append((lang, source, rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.randint(0, 30)))))
    out += [("en", "bare", None), ("en", "bare", ""), ("xx", "a", "only once"), ("xx", "b", None), ("xx", "c", "12")]
    out += [("yy", "one", "same words")] * 12 + [("de", "hot", "tie eit " * 30_000)]
    return out


def frame(spark, rows):
    extra = ", ".join(f"`{c}` string" for c in [*CLASHING, "term", "docs", "df"])
    full = [(None, *r, *["x"] * (len(CLASHING) + 3)) for r in rows]
    return spark.createDataFrame(full, f"doc_id long, lang string, source string, text string, {extra}").repartition(4)


@pytest.mark.parametrize("small", [False, True])
def test_against_plain_counts(spark, rows, monkeypatch, small):
    """The same with spills, several blocks of terms and few sources at a time."""
    if small:
        for name in ("HELD_CELLS", "LOOSE_CELLS"):
            monkeypatch.setattr(D, name, 40)
        monkeypatch.setattr(D, "BLOCK_TERMS", 5)
        monkeypatch.setattr(D, "DENSE_CELLS", 12)
    assert result(frame(spark, rows)) == plain(rows)
    assert result(frame(spark, rows), params=D.Params(least=1, top=3)) == plain(rows, 1, 3)


def test_empty_table(spark):
    assert result(frame(spark, []).limit(0)) == set()


def test_shares_of_large_counts():
    rng = random.Random(1)
    for _ in range(200):
        total = rng.randint(1, 9 * 10**15)
        count = rng.choice([total, rng.randint(0, total)])
        assert D.share(np.array([count]), np.int64(total))[0] == 1 + 10**9 * count // total
