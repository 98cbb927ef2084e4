"""Files of token ids against the tokenizer itself, place by place, and on awkward rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillstone.llm import token_files
from quillstone.llm.token_files import FileConfig, TokenFile, file_bytes

PATH = public_tokenizers.path("word_bpe_49k.json")
JSON = open(PATH, encoding="utf-8").read()


@pytest.mark.parametrize("widths", [(8, 8, 16), (4, 4, 8, 16), (2, 1, 1, 4, 8, 16), (16, 16), (32,), (1, 1, 2, 4, 8, 16)])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_codes_are_read_at_any_place(widths, n):
    r = np.random.default_rng(n)
    ids = (r.integers(0, 1 << 32, n, dtype=np.uint64) >> r.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
    held = b"".join(file_bytes(ids, [3, None], [0, n // 2], widths))
    read = []

    def at(a, k):
        read.append(k)
        return held[a : a + k]

    file = TokenFile(at)
    assert file.ids(0, n).tolist() == ids.tolist()
    docs, starts = file.documents()
    assert docs == [3, None] and starts.tolist() == [0, n // 2, n]
    for k in sorted({*range(0, n, 97), *range(max(0, n - 3), n)}):
        read.clear()
        assert file.at(k) == ids[k]
        assert sum(read) <= 90 * len(widths)  # no block of codes is decoded for one
    for a, b in ((0, 0), (n // 3, n // 2), (n // 2, n)):
        assert file.ids(a, b).tolist() == ids[a:b].tolist()
    for bad in (-1, n):
        with pytest.raises(IndexError):
            file.at(bad)


def test_ids_beyond_the_widths_and_other_files_are_refused():
    with pytest.raises(ValueError):
        file_bytes(np.array([70_000]), [1], [0], (8, 8))
    with pytest.raises(ValueError):
        TokenFile(lambda a, k: b"\x00" * k)


ROWS = [(5, "Five words are in here"), (3, None), (1, ""), (9, "x" * 30_000), (2, "the same"), (2, "the same"), (2, "another"), (None, "no id"), (None, None), (-4, "漢字 ümläut 😀 <|endoftext|>"), (7, "word " * 9000)]
KINDS = "doc_id long, text string, start string, file int, n_tokens int"


def wanted(rows, seed=0):
    """(doc_id, n_tokens, crc, ids) in order; rows that share an id are compared as a set."""
    tok = Tokenizer.from_file(PATH)
    out = []
    for doc, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc, ids.size, zlib.crc32(ids.tobytes()), ids))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("file_tokens", [1, 700, 1 << 24])
def test_documents_come_back_in_order(spark, file_tokens):
    r = random.Random(1)
    rows = ROWS + [(r.randrange(100, 10**6), " ".join(r.choice(["alpha", "Beta,", "gamma's", "12"]) for _ in range(r.randrange(60)))) for _ in range(300)]
    docs = spark.createDataFrame([(d, t, "s", 1, 2) for d, t in rows], KINDS).repartition(5)
    config = FileConfig(file_tokens=file_tokens, read_tokens=500)
    files = token_files.write_tokens(docs, JSON, config=config)
    found = sorted(token_files.read_documents(files, True, config).collect(), key=lambda r: r.start)
    right = wanted(rows)
    assert [r.doc_id for r in found] == [w[0] for w in right]
    at = 0
    for r in found:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens and zlib.crc32(r.ids) == r.ids_crc32
        at += r.n_tokens
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == sorted((str(w[0]), w[1], w[2]) for w in right)
    whole = np.frombuffer(b"".join(r.ids for r in found), "<u4")
    places = [*range(0, at, 211), at - 1, at, at + 5, -1, None]
    asked = spark.createDataFrame([(p, "t", "f") for p in places], "position long, token string, file string").repartition(3)
    tokens = token_files.tokens_at(files, asked, config).collect()
    assert {r.position: r.token for r in tokens} == {p: int(whole[p]) for p in places if p is not None and 0 <= p < at}


def test_one_id_in_most_rows_is_dealt_to_several_tasks(spark):
    rows = [(7, f"text number {k} " * 20) for k in range(2000)] + [(k, "x") for k in range(50)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), JSON).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) == 4 and max(f.docs for f in files) < 900


def test_empty_table(spark):
    files = token_files.write_tokens(spark.createDataFrame([], KINDS), JSON)
    assert token_files.read_documents(files).collect() == []
    assert token_files.tokens_at(files, spark.createDataFrame([(0,)], "position long")).collect() == []


def test_query_equals_the_tokenizer_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    right, at, rows = wanted(docs), 0, set()
    for doc, n, crc, _ in right:
        rows.add((doc, at, n, crc))
        at += n
    assert {tuple(r) for r in token_files.op11_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == rows
