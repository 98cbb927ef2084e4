"""The whole pipeline against a brute-force version that takes one document after the other, on real and awkward rows."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import language_id, quality_rules
from quillstone.llm.common import held_out
from tests.llm.test_near_text import survivors
from tests.llm.test_operators import check_packed, prose

TABLE = "/root/testdata/sf0.001/documents.parquet"
SPACE = " \t\n\x0b\f\r"


def words_of(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def awkward(first):
    """Nulls in every column, empty and very long texts, repeated rows, near copies and passages that later documents repeat."""
    shared, base = prose(71, 40), [f"w{i}" for i in range(300)]
    texts = [
        None, "", " \n\t ", "12 34", prose(72, 90), prose(72, 90), shared + "\n" + prose(73, 60), prose(74, 60) + "\n" + shared,
        " ".join(base) + ".", " ".join(["v", *base[1:]]) + ".", " ".join(f"x{i}" for i in range(60000)) + ".", "home | about | shop\n" * 30,
        prose(75, 60) + "\nAll rights reserved.\nno end here",
    ]
    return [(first + i, t, None if i % 3 else "en", None, None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    known = pd.read_parquet(TABLE)
    made = [(int(d), t, lang, s, int(n)) for d, t, lang, s, n in known[[*corpus_pipeline.COLUMNS]].itertuples(index=False)]
    return made + awkward(max(r[0] for r in made) + 1)


def language(rows, model):
    found = [(r, language_id.mixture(r[1], model)) for r in rows]
    return [r for r, (lang, share, *_) in found if lang != "und" and share >= 0.4]


def quality(rows):
    """Each text without the lines that fail, where its repeats are few enough and not too many words go with the lines."""
    out = []
    for d, text, *_ in rows:
        words = words_of(text)
        places = {}
        for i in range(len(words) - 2):
            places.setdefault(tuple(words[i : i + 3]), []).append(i)
        again = {i + k for found in places.values() if len(found) > 1 for i in found for k in range(3)}
        kept, lost = [], 0
        for line in text.split("\n"):
            own = words_of(line)
            bad = (
                not any(c in line for c in ".!?…。！？")
                or sum(c in "#*$%&|<>" for c in line) > 0.1 * len(line)
                or sum(w in ("|", "/", "»", "›", ">", "·", "•", "::", "->") for w in own) > 0.2 * len(own)
                or any(p in line.lower() for p in quality_rules.BOILERPLATE)
            )
            if own and bad:
                lost += len(own)
            else:
                kept.append(line)
        if len(words) >= 50 and 100 * len(again) <= 50 * len(words) and lost <= 0.4 * len(words):
            out.append((d, "\n".join(kept)))
    return out


def near(rows):
    first = {*survivors(rows)}
    return [r for r in rows if r[0] in first]


def passages(rows):
    starts = {}
    for d, text in rows:
        words = words_of(text)
        for i in range(len(words) - 12):
            w = tuple(words[i : i + 13])
            starts[w] = min(starts.get(w, d), d)
    out = []
    for d, text in rows:
        words = words_of(text)
        gone = {i + k for i in range(len(words) - 12) if starts[tuple(words[i : i + 13])] < d for k in range(13)}
        left = [w for i, w in enumerate(words) if i not in gone]
        if left or not words:
            out.append((d, left))
    return out


def pieces(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for d, words in rows:
        ids = np.array([*tokenizer.encode(" ".join(words), add_special_tokens=False).ids, 1], "<u4")
        out += [(d, k // 4096, k, ids[k : k + 4096].size, zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, ids.size, 4096)]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_pipeline_equals_brute_force(spark, rows, tmp_path):
    """The tokenizer cuts at white space, so that words joined by one space have the ids of the text they come from."""
    docs = frame(spark, rows)
    docs.repartition(3).withColumn("item", F.lit("x")).withColumn("a.b", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))))
    kept = [language(rows, model)]
    for step in (quality, near, passages):
        kept.append(step(kept[-1]))
    sizes = [len(rows), *map(len, kept)]
    assert all(a > b for a, b in zip(sizes, sizes[1:4])), sizes  # the first three stages each have something to do here
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = pieces(kept[-1])
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins, bound = check_packed(got, 4096), -(-sum(p[3] for p in want) // 4096)
    assert bound <= bins <= 1.02 * bound + 1


def test_stages_return_the_columns_of_documents(spark, rows):
    docs = frame(spark, rows).withColumn("item", F.lit("x")).withColumn("a.b", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            assert tuple(stage(spark, table, "").columns) == corpus_pipeline.COLUMNS
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), "").count() == 0


def test_stages_of_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
