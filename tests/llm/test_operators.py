"""The ten operators against brute force, and on the awkward rows: nulls, empty and long texts, ties, repeats, empty tables."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import byte_bpe, chat_format, embedding_dedup, language_id, packing, quality_rules, simhash, substring_dedup, suffix_dedup, toxicity
from quillstone.llm.common import components, forest, stored

DOCS = "doc_id long, text string, key string, z string, shard int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ing", "ed"]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def rows():
    shared = prose(1, 60)
    return [
        (1, prose(2, 80) + "\n" + shared, "a", "b", 1),
        (2, shared + " " + prose(3, 70), "a", "b", 2),
        (3, prose(4, 40) + " " + shared + "\n" + prose(5, 20), "a", None, 3),
        (4, None, None, None, None),
        (5, "", "a", "b", 4),
        (6, "x", "a", "b", 4),
        (7, "same " * 3000, "a", "b", 4),
        (8, prose(2, 80) + "\n" + shared, "a", "b", 1),
        (9, "漢字かな交じり文 ümläut 😀 " * 30, "a", "b", 1),
        (10, "a" * 5000, "a", "b", 1),
        (11, " \t\n ", "a", "b", 1),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_connects_what_links_connect():
    child, root = forest(np.array([3, 4, 1]), np.array([4, 5, 2]), 7)
    assert {*child.tolist()} == {2, 4, 5} and dict(zip(child.tolist(), root.tolist())) == {2: 1, 4: 3, 5: 3}


# --- 1 ------------------------------------------------------------------------------------------------------------------


def test_chat_format_reads_back(spark):
    said = "</s>[INST] a\\b <|end|><|turn|> [/INST]\\"
    turns = [
        (1, 0, "system", "be\nkind"), (1, 1, "user", said), (1, 2, "assistant", said), (2, 0, "assistant", "first"), (2, 1, "assistant", None),
        (3, 0, None, "who"), (3, 1, "user", ""), (4, 0, "user", "tie"), (4, 0, "assistant", "tie"), (4, 0, "assistant", "tie"), (None, 0, "user", "x" * 100_000), (None, None, "tool", "early"),
    ]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    segments = chat_format.format_chats(frame)
    got = {r.conv_id: r for r in chat_format.read_back(segments).collect()}
    for conv in (1, 2, 3, 4, None):
        mine = sorted(((t if t is not None else -1), r or "", x or "") for c, t, r, x in turns if c == conv)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: False}
    whole = "".join(r.text for r in segments.where("conv_id = 1").orderBy("segment").collect())
    assert whole.count("<|turn|>") == 3 and "[INST]" not in whole and "</s>" not in whole
    assert chat_format.read_back(chat_format.format_chats(frame.limit(0))).count() == 0


def test_chat_templates_that_could_not_be_read_are_refused():
    with pytest.raises(ValueError):
        chat_format.ChatTemplate(turn="<|a|>", text="<|a|>")
    with pytest.raises(ValueError):
        chat_format.ChatTemplate(controls=("x<|tu",))


# --- 2 ------------------------------------------------------------------------------------------------------------------


def test_quality_rules(spark, docs, rows):
    got = {r.doc_id: r.quality for r in quality_rules.clean(docs).select("doc_id", "quality").collect()}
    for d, text, *_ in rows:
        words = (text or "").split() if (text or "").isascii() else [w for w in (text or "").split(" ") if w]
        tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        again = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)} if len(words) < 500 else set(range(len(words)))
        assert (got[d].n_words, got[d].n_repeat_words) == (len(words), len(again)), d
        assert got[d].word_chars == sum(map(len, words))
    assert got[1].kept and not got[7].kept and not got[4].kept
    junk = "home | about | shop | more | news | cart | blog | help | jobs | press\n"
    text = prose(9, 60) + "\nAll rights reserved.\n" + "no end of a sentence here\n"
    frame = spark.createDataFrame([(1, text), (2, prose(8, 30) + "\n" + junk * 3 + prose(7, 30)), (3, junk * 12)], "doc_id long, text string")
    got = {r.doc_id: r.quality for r in quality_rules.clean(frame).collect()}
    assert got[1].kept and got[1].n_failed_lines == 2 and got[1].clean_text.rstrip("\n") == prose(9, 60)
    assert not got[3].kept and got[2].n_dup_lines == 2
    assert quality_rules.clean(empty(spark)).count() == 0


# --- 3 ------------------------------------------------------------------------------------------------------------------


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_places_each_piece_once(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    got = packing.pack_documents(docs).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(d, k // 4096, k, ids[k : k + 4096].size, zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, ids.size, 4096)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    check_packed(got, 4096)
    assert packing.pack_documents(empty(spark)).count() == 0


def test_packing_merges_over_rounds(spark):
    r = random.Random(3)
    sizes = [r.choice([1, 5, 30, 64, 100, 7, 90]) for _ in range(4000)]
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)] + [(0, sizes[0])], "doc_id long, length long")
    config = packing.PackConfig(capacity=100, slack=1, per_task=300, fan_in=4)
    got = packing.pack(frame, config).collect()
    assert sorted((x.doc_id, x.length) for x in got) == sorted([*enumerate(sizes), (0, sizes[0])])
    assert check_packed(got, 100) <= 1.05 * -(-(sum(sizes) + sizes[0]) // 100) + 1


def test_best_fit_takes_the_least_room():
    bins, places, fill = packing.best_fit([6, 5, 4, 3, 2], 10)
    assert fill == [10, 10] and bins == [0, 1, 0, 1, 1] and places == [0, 0, 6, 5, 8]


def test_word_tokens_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        source = f.read()
    ours, theirs, r = packing.WordTokens(source), Tokenizer.from_str(source), random.Random(5)
    signs = " \n\t abcéßÀİĲŉ'stre12²½ªº\x85\xa0\xad\x1c.,!?|<>#Σς漢٣́"
    for text in ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["a<|endoftext|>b", "x" * 300]:
        assert np.frombuffer(ours(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


# --- 4 and 6 ------------------------------------------------------------------------------------------------------------


def test_toxicity_learns_a_pair(spark):
    """Either word alone is clean, both together aren't: no sum of weights tells that."""
    r = random.Random(2)
    rows, labels = [], []
    for i in range(1200):
        words = [r.choice(WORDS) for _ in range(12)]
        a, b = r.random() < 0.5, r.random() < 0.5
        words += ["insultish"] * a + ["groupish"] * b
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(a and b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    machine = toxicity.fit(docs.where("doc_id < 900"), spark.createDataFrame([*labels, (5000, None), (None, 1)], "doc_id long, toxic int"))
    got = {x.doc_id: x for x in toxicity.score(docs, machine).collect()}
    right = [got[i].predicted == y for i, y in labels if i >= 900]
    assert sum(right) >= 0.95 * len(right)


def test_toxicity_score_is_a_factorization_machine(spark):
    """Bias, weights and the products of all pairs, summed one by one; a fit from hashed rows learns a pair of words."""
    r = np.random.default_rng(3)
    config = toxicity.MachineConfig(buckets=64, factors=3)
    m = toxicity.Machine(-0.3, r.normal(size=64), r.normal(size=(64, 3)) / 3, config)
    docs = spark.createDataFrame([(1, "one two three two"), (2, ""), (3, None), (3, "one")], "doc_id long, text string")
    for row in toxicity.score(docs, m).collect():
        terms = toxicity.Terms(64)(row.text).tolist()
        raw = -0.3 + sum(m.weights[t] for t in terms) + sum(float(m.vectors[a] @ m.vectors[b]) for i, a in enumerate(terms) for b in terms[i + 1 :])
        assert abs(row.score - 1 / (1 + np.exp(-raw))) < 1e-9 and row.predicted == int(row.score >= 0.3)


def test_toxicity_learns_a_balanced_pair_by_its_vectors():
    """Whether two words agree decides: neither tells anything by itself, and without its vectors the machine guesses."""
    r = np.random.default_rng(5)
    rows, y = [], []
    for _ in range(4000):
        a, b = r.random(2) < 0.5
        rows.append(np.array(sorted({*r.integers(100, 160, 12).tolist(), *([1] * int(a)), *([2] * int(b))})))
        y.append(float(a == b))
    m = toxicity.learn(rows[:3000], np.array(y[:3000], np.float32))
    right = lambda machine: np.mean([(toxicity.score_terms(t, machine) >= 0.5) == (k > 0) for t, k in zip(rows[3000:], y[3000:])])
    assert right(m) >= 0.95
    assert right(toxicity.Machine(m.bias, m.weights, np.zeros_like(m.vectors), m.config, m.values)) < 0.6


def test_toxicity_of_few_terms_rows_and_classes():
    for rows, y in (([[1], [2], [1]], [1, 0, 1]), ([[1, 2], [], [3]], [1, 0, 0]), ([[], []], [0, 1]), ([[4]], [1]), ([[4], [4]], [1, 1])):
        m = toxicity.learn([np.array(t, np.int64) for t in rows], np.array(y, np.float32))
        assert all(0 <= toxicity.score_terms(np.array(t, np.int64), m) <= 1 for t in [*rows, [9, 10]])


def test_pairs_left_are_eigenvectors_of_the_matrix_of_pairs():
    """The matrix of all pairs, made in full, has the same leading part; it is positive or zero along what is returned."""
    r = np.random.default_rng(6)
    rows = [np.flatnonzero(r.random(9) < 0.4) for _ in range(60)]
    left, value = r.normal(size=60), r.random(9).astype(np.float32)
    config = toxicity.MachineConfig(factors=9, turns=30)
    v = toxicity._pairs_left(toxicity._Rows(rows, 9), left, value, r, config)
    full = np.zeros((9, 9))
    for t, e in zip(rows, left):
        full[np.ix_(t, t)] += e * np.outer(value[t], value[t])
    np.fill_diagonal(full, 0)
    strength, axes = np.linalg.eigh(full)
    assert np.allclose(v @ v.T, (axes * np.maximum(strength, 0)) @ axes.T, atol=1e-6)


def test_toxicity_labels_that_repeat_or_contradict_count_once(spark):
    docs = spark.createDataFrame([(i, "bad word" if i % 3 == 0 else "nice word") for i in range(60)] + [(0, "bad word"), (7, None)], "doc_id long, text string")
    once = [(i, int(i % 3 == 0)) for i in range(60)]
    a = toxicity.fit(docs, spark.createDataFrame(once, "doc_id long, toxic int"))
    b = toxicity.fit(docs, spark.createDataFrame([*once, *once, (3, 0), (6, 0)], "doc_id long, toxic int"))
    assert a.bias == b.bias and (a.weights == b.weights).all() and (a.vectors == b.vectors).all()
    long = spark.createDataFrame([(1, "nice " * 200_000), (2, "bad word"), (3, "nice word")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(long, a).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_toxicity_of_awkward_rows(spark, docs):
    nothing = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score(docs.withColumn("score", F.lit("old")), nothing).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty(spark), nothing).count() == 0


def test_language_mixtures(spark, docs):
    path = "/root/testdata/sf0.01/documents.parquet"
    known = spark.read.parquet(path).select("doc_id", "text", "lang")
    model = language_id.fit(known.where("doc_id % 3 <> 0"))
    got = language_id.identify(known.where("doc_id % 3 = 0"), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    parts = {r.lang: r.text for r in known.where("length(text) > 2000").dropDuplicates(["lang"]).collect()}
    both = spark.createDataFrame([(1, parts["de"][:1500] + " " + parts["es"][:1500])], "doc_id long, text string")
    assert {*language_id.identify(both, model).first().lang_set} == {"de", "es"}
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert [got[k].lang_pred for k in (4, 5, 11)] == ["und"] * 3 and got[4].score == 0
    none = language_id.fit(known.where("lang IS NULL"))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(empty(spark), model).count() == 0


# --- 5 ------------------------------------------------------------------------------------------------------------------


def test_byte_bpe_equals_the_library(spark, docs, rows):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours, r = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN, keep=50), random.Random(4)
    signs = " \n\t  abcéñ'stre12²٣漢ですА😀́\x1c\x85\xa0　.,!?<#"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 50))) for _ in range(1500)] + ["a" * 3000, " " * 300 + "x" * 65, ""]
    for text, ids in zip(texts, ours.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)
        assert ours.decode(ids) == text.encode()
    done = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    for x in done.collect():
        text = dict((d, t) for d, t, *_ in rows)[x.doc_id] or ""
        assert bytes(x.decoded) == text.encode() and np.frombuffer(x.ids, "<u4").tolist() == theirs.encode_ordinary(text) and x.n_tokens == len(x.ids) // 4
    assert byte_bpe.encode(empty(spark), ranks, public_tokenizers.PATTERN).count() == 0
    assert base64.b64encode(b"a")  # the rank files' encoding


# --- 7 and 9 ------------------------------------------------------------------------------------------------------------


def brute_strings(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - n + 1):
            seen[b[i : i + n]] = seen.get(b[i : i + n], 0) + 1
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        out.append(bytes(x for x, g in zip(b, gone) if not g))
    return out


def test_suffix_sort_orders_and_agrees():
    r = np.random.default_rng(1)
    data = r.integers(97, 99, 400).astype(np.uint8)
    data[100:160] = data[200:260]
    starts = np.arange(0, 360)
    group = np.zeros(360, np.int64)
    order, agrees = suffix_dedup.sort_suffixes(suffix_dedup.Prefixes(suffix_dedup._UNITS[data], suffix_dedup.Powers(0xD6E8FEB86659FD93)), data, starts, group, 30)
    cut = [bytes(data[s : s + 30]) for s in starts[order]]
    assert cut == sorted(cut) and agrees.tolist() == [False] + [x == y for x, y in zip(cut, cut[1:])]


# --- 8 and 10 -----------------------------------------------------------------------------------------------------------


def reach(n, linked):
    low = [*range(n)]
    while True:
        new = [min([low[i], *(low[j] for j in range(n) if linked(i, j))]) for i in range(n)]
        if new == low:
            return low
        low = new


@pytest.mark.parametrize("block", [4096, 2])
def test_simhash_links(spark, block):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(6)]
    fps = []
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(r.randint(0, 7)):
                x ^= 1 << r.randrange(64)
            fps.append(x)
    fps = sorted({*fps})
    classes = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "node long, fp long")
    found = {x.node: x.component for x in components(simhash.link(classes, simhash.SimHashConfig(block=block))).collect()}
    want = reach(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert [found.get(i, i) for i in range(len(fps))] == want


def test_simhash_of_awkward_rows(spark, docs, rows):
    frame = docs.unionByName(spark.createDataFrame([(None, rows[0][1], "q", "q", 0)], DOCS))
    got = {r.doc_id: r for r in simhash.near_duplicates(frame).collect()}
    assert got[4].fp == got[5].fp == got[11].fp == 0 and got[5].component_id == 4
    assert got[8].component_id == 1 and got[None].component_id == 1
    assert simhash.near_duplicates(empty(spark)).count() == 0


def brute_fingerprint(text):
    """Bits set in over half of the shingles' hashes, shingle by shingle."""
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints_equal_brute_force(spark, docs, rows):
    long = [(20, "One two THREE four five " * 4000, "a", "b", 1), (21, "ÄÖ İ \x85 a\u00a0b \u3000 c d e", "a", "b", 1), (22, "w w w w w w w", "a", "b", 1)]
    frame = docs.unionByName(spark.createDataFrame(long, DOCS)).withColumn("fp", F.lit("old"))
    got = {r.doc_id: r.fp for r in simhash.near_duplicates(frame).collect()}
    assert {k: v % (1 << 64) for k, v in got.items()} == {r[0]: brute_fingerprint(r[1]) for r in [*rows, *long]}


def test_simhash_rows_that_repeat_an_id_do_not_link_by_it(spark):
    a, b, c = prose(71, 60), prose(72, 60), prose(73, 60)
    got = simhash.near_duplicates(spark.createDataFrame([(5, a), (5, b), (7, b), (9, c), (None, c), (None, prose(74, 60))], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 9), (5, 5), (5, 5), (7, 5), (9, 9)]


def test_simhash_broadcasts_hot_keys_only(spark):
    """Fingerprints of a small file are many postings, which Spark thinks as small: only the table of hot keys goes to the driver."""
    classes = stored(spark.range(2000).select(F.col("id").alias("node"), F.xxhash64("id").alias("fp")), "classes")
    plan = simhash.link(classes)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1


@pytest.mark.parametrize("mean", [0.0, 1.0])
def test_embeddings_of_clusters_meet_few_others_and_lose_no_link(spark, mean):
    """20,000 vectors in 300 clusters, some of which are near copies, with and without a common mean."""
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(300, 32))
    x = middles[rng.integers(0, 300, 20_000)] + 0.3 * rng.normal(size=(20_000, 32)) + mean
    x[15_000:] = x[:5_000] + 0.02 * rng.normal(size=(5_000, 32))
    x = x.astype(np.float32)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = np.concatenate([(u[k : k + 2000] @ u.T >= 0.95).sum(axis=1) - 1 for k in range(0, len(u), 2000)])
    config = embedding_dedup.TileConfig(tile=512, per_pivot=64)
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(8)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(frame, config).collect()}
    assert [got[k] for k in range(len(x))] == want.tolist() and want.sum() >= 10_000
    nodes = frame.select(F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("copies"), "embedding")
    pivots = embedding_dedup._pivots(nodes, len(x), config)
    placed, rings = embedding_dedup._placed(nodes, pivots, len(x), config)
    size = {r.ring: r["count"] for r in placed.groupBy("ring").count().collect()}
    visits = embedding_dedup._visits(placed, pivots, rings, config)
    met = visits.select(F.explode("met").alias("ring")).where("ring >= 0").groupBy("ring").count().collect()
    assert sum(size.values()) == len(x)
    assert sum(r["count"] * size[r.ring] for r in met) + sum(n * n / 2 for n in size.values()) < 0.1 * len(x) ** 2 / 2


def test_embeddings_copies_and_repeated_or_null_ids(spark):
    """A vector in most rows; rows without an id link with nothing, those that share one are vectors of their own."""
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(k, a) for k in range(10, 700)] + [(5, a), (5, a), (5, b), (None, a), (None, None), (3, None), (800, [0.99, 0.05, 0.0])]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert len(got) == len(rows)
    assert sorted((r.n_links, r.component_id, r.kept) for r in got if r.vec_id == 5) == [(0, 5, True), (692, 5, True), (692, 5, True)]
    assert {(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None and r.vec_id >= 10} == {(692, 5, False)}
    assert sorted((r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None) == [(0, None, True), (0, None, True)]
    assert [(r.n_links, r.component_id) for r in got if r.vec_id == 3] == [(0, 3)]


@pytest.mark.parametrize("tile", [4096, 7])
def test_embedding_links(spark, tile):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 9))
    x[20:40] = x[:20] + rng.normal(scale=0.15, size=(20, 9))
    x[40:44] = x[0]
    rows = [(i + 10, v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))]
    odd = [(1, None), (2, [0.0] * 9), (3, [float("nan")] + [1.0] * 8), (4, [float("inf")] * 9), (5, []), (6, [1.0, None]), (7, [1.0, 2.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("links", F.lit(0))
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(frame, embedding_dedup.TileConfig(tile=tile, lead=4, per_pivot=tile)).collect()}
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    low = reach(60, lambda i, j: near[i, j])
    for i in range(60):
        assert got[i + 10].n_links == near[i].sum() - 1 and got[i + 10].component_id == low[i] + 10 and got[i + 10].kept == (low[i] == i)
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(1, 8))
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0
