import glob
import os
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pvspark.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = "A á ́b İI ß 's don't I'LL 12a3 … a b   \x0b\x0c <|endoftext|> 한국어 ȩ́ #".split(" ")


def expected(rows, end_id=2):
    tokenizer = Tokenizer.from_file(PATH)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for ident, text in order:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((ident, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def read_back(spark, folder):
    return sorted((tuple(r) for r in token_files.read(spark, folder).collect()), key=lambda r: r[1])


@pytest.mark.parametrize("shard_ids", [300, 1 << 22])
def test_round_trip(spark, docs, tmp_path, shard_ids):
    folder = f"file://{tmp_path}/out"
    rng = random.Random(4)
    odd = [(1000 + i, " ".join(rng.choices(ODD, k=12)).replace(" ", rng.choice([" ", "\n", "\t ", "\r"]), 3)) for i in range(60)]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + odd
    table = docs.select("doc_id", "text", "hash", "n").unionByName(
        spark.createDataFrame([(*r, "x", "y") for r in odd], "doc_id long, text string, hash string, n string")
    )
    token_files.write(table, folder, PATH, 2, shard_ids)
    got, want = read_back(spark, folder), expected(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert got == want
    listed = spark.read.parquet(f"{folder}/manifest").collect()
    assert sum(r.n_docs for r in listed) == len(rows)
    assert len(listed) == 1 if shard_ids > 1000 else len(listed) > 10
    # the 30,000-word text is not cut
    assert max(r.n_ids for r in listed) >= 30_000
    ranks = spark.read.parquet(f"{folder}/vocabulary").orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(len(ranks)))
    assert [(-r.n, r.id) for r in ranks] == sorted((-r.n, r.id) for r in ranks)


def test_unlisted_files_do_not_count_and_damage_is_seen(spark, docs, tmp_path):
    folder = str(tmp_path / "out")
    token_files.write(docs, folder, PATH, 2, 5000)
    before = read_back(spark, folder)
    files = sorted(glob.glob(f"{folder}/shards/*.ids"))
    with open(files[0], "rb") as f:
        content = f.read()
    with open(f"{folder}/shards/00000000-000000-other.ids", "wb") as f:
        f.write(content)
    assert read_back(spark, folder) == before
    with pytest.raises(ValueError):
        token_files.Shard(content[:100] + bytes([content[100] ^ 1]) + content[101:])


def test_empty_table(spark, no_docs, tmp_path):
    folder = str(tmp_path / "none")
    token_files.write(no_docs, folder, PATH, 2)
    found = token_files.read(spark, folder)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids"] and found.count() == 0
    assert not os.path.exists(f"{folder}/shards") or not os.listdir(f"{folder}/shards")


@pytest.mark.parametrize("special", [False, True])
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokenizers_with_and_without_white_space(name, special):
    """Byte pieces hold the blank before a word: such texts are encoded whole."""
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        spec = f.read()
    tokenizer, encoder = Tokenizer.from_str(spec), token_files.Encoder(spec)
    rng = random.Random(2)
    odd = [w for w in ODD if special or "<" not in w]
    texts = [None, "", " ", "\n a"] + [rng.choice([" ", "  ", "\n", "\u00a0"]).join(rng.choices(odd, k=9)) for _ in range(80)]
    texts += ["".join(rng.choices("ab'st.,-1 é\u0301AĤ", k=40)) for _ in range(300)] + ["x" * 300 + " y", "x" * 300]
    if special:
        texts.append("word<|endoftext|>word, can't")
    ((ids, at),) = encoder.encode(pa.array(texts, pa.string()), 2)
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_words_are_known_again_and_forgotten(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_WORDS", 50)
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()
    tokenizer, encoder = Tokenizer.from_str(spec), token_files.Encoder(spec)
    rng = random.Random(6)
    for _ in range(40):
        texts = [" ".join(f"w{rng.randint(0, 90)}, {'long' * rng.randint(60, 70)}" for _ in range(5)) for _ in range(4)]
        ((ids, at),) = encoder.encode(pa.array(texts), 2)
        want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
        assert len(encoder.known) <= 50 + 30


def test_coding_of_all_widths():
    rng = np.random.default_rng(1)
    edges = [0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1]
    for n in [0, 1, 3, 4, 5, token_files.BLOCK, 2 * token_files.BLOCK + 7]:
        ranks = rng.choice(np.array(edges, np.uint32), n)
        control, data, _ = token_files.pack(ranks)
        assert len(control) == -(-n // 4)
        assert (token_files.unpack(control, data, n) == ranks).all()
        shard = token_files.Shard(token_files.to_file([5], np.array([n]), ranks))
        assert (shard.ranks(0, n) == ranks).all()
        for _ in range(5):
            a, b = sorted(rng.integers(0, n + 1, 2))
            assert (shard.ranks(int(a), int(b)) == ranks[a:b]).all()
