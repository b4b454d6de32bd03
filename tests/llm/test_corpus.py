"""Corpus operators against brute force and on odd input."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from churnlake import session
from churnlake.llm import (
    byte_bpe, components, hidden_markov, line_dedup, ngram_join, packing, projection_forest, quality_rules, sharding, tag_paths, toxicity,
)
from churnlake.llm.tables import read_table

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
ODD = [None, "", " \n\t ", "one", "Two words", "a b c d e f g h i j", "é É ß 中文 \U0001F600 x", "x" * 5000, LONG, "line one here\nline one here\n",
       "same text for two rows", "same text for two rows", "don't  stop\n\n now\x85 ok", "<|endoftext|> plain"]


def found_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated texts; a repeated row, a null id, and columns with names that operators use."""
    rows = [(i, t, None if i == 3 else "en", f"s{i % 2}", i, "clash", "clash") for i, t in enumerate(ODD)]
    rows += [rows[5], (None, "null id here", "fr", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long, key string, stretches string")


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, "/root/testdata/sf0.001", "documents")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


# -- sharding --------------------------------------------------------------------------------------
def test_sharding_splits_only_large_buckets(spark, docs):
    limit = 20_000
    rows = sharding.shard(docs, "doc_id", "text", limit).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.n_bytes)
    assert len(rows) == docs.count() and len(by) > 5
    for bits, sizes in by.items():
        assert sum(sizes) <= limit or len(sizes) == 1
        parent = sum(n for b, s in by.items() if b.startswith(bits[:-1]) for n in s)
        assert not bits or parent > limit
    prefixes = sorted(by)
    assert not any(b != a and b.startswith(a) for a in prefixes for b in prefixes)


def test_sharding_equal_rows_and_odd_input(spark, odd, empty):
    hot = spark.createDataFrame([(1, "x" * 100)] * 2500 + [(2, "y")], "doc_id long, text string")
    pages = sharding.shard(hot, "doc_id", "text", 10_000).groupBy("shard", "page").agg(F.sum("n_bytes").alias("n"), F.count("*").alias("k")).collect()
    assert max(r.n for r in pages) <= 10_000 and sum(r.k for r in pages) == 2501
    assert sharding.shard(odd, "doc_id", "text", 1000).count() == odd.count()
    assert sharding.shard(empty, "doc_id", "text").count() == 0


# -- quality rules ---------------------------------------------------------------------------------
def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = collections.defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i:i + 8])].append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(docs, odd, empty):
    for df in (docs, odd):
        for r in quality_rules.apply(df).collect():
            expected = plain_counts(r.text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
            assert r.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
            assert not (r.kept and r.base_failed)
    assert quality_rules.keep_good(empty).columns == empty.columns and quality_rules.keep_good(empty).count() == 0


def test_quality_rejects_junk_and_keeps_prose(spark):
    folder = "/root/testdata/sf0.01"
    good = read_table(spark, folder, "labels").where("quality = 1").select("doc_id")
    texts = read_table(spark, folder, "documents").where("lang = 'en' AND n_chars > 800").join(good, "doc_id").orderBy("doc_id")
    prose = [r.text for r in texts.limit(60).collect()]
    junk = [" ".join(w + "###" for w in t.split()) for t in prose[:10]] + [t.upper() for t in prose[10:20]]
    rows = [(i, t, "en") for i, t in enumerate(prose + junk)]
    kept = {r.doc_id for r in quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not kept & set(range(len(prose), len(rows))) and len(kept) >= 0.8 * len(prose)


def test_quality_judges_every_language(spark):
    folder = "/root/testdata/sf0.01"
    good = read_table(spark, folder, "labels").where("quality = 1").select("doc_id")
    texts = read_table(spark, folder, "documents").where("lang = 'en' AND n_chars > 800").join(good, "doc_id").orderBy("doc_id")
    prose = [r.text for r in texts.limit(60).collect()]
    langs = ["en"] * 30 + ["it"] * 24 + [None] * 3 + ["nl"] * 3         # nl has too few documents for a reference
    junk = [" ".join(w + "###" for w in t.split()) for t in prose[:8]]
    rows = [(i, t, x) for i, (t, x) in enumerate(zip(prose + junk, langs + [None, None, "it", "it", "nl", "nl", "en", "en"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality_rules.keep_good(df).collect()}
    assert not kept & set(range(60, 68)) and len(kept & set(range(30))) >= 24 and len(kept & set(range(30, 60))) >= 24
    assert quality_rules.apply(df).where("lang IS NULL AND class_distance IS NULL").count() == 0


def test_quality_few_documents_do_not_judge_themselves(spark, tmp_path):
    """A lone document of a language with a word list meets the corpus; the oracle agrees on every language, null too."""
    folder = "/root/testdata/sf0.01"
    texts = [r.text for r in read_table(spark, folder, "documents").where("lang = 'en' AND n_chars > 800").orderBy("doc_id").limit(70).collect()]
    junk = [" ".join(w + "###" for w in t.split()) for t in texts[:4]]
    langs = ["en"] * 40 + ["it"] * 25 + [None] * 5 + ["de", "xx", None, "en"]
    rows = [(i, t, x) for i, (t, x) in enumerate(zip(texts + junk, langs))] + [(99, None, None), (100, "short one", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in quality_rules.op10_quality_rules(spark, str(tmp_path)).collect()}
    assert not {r[0] for r in got if r[-1]} & {70, 71, 72, 73} and sum(r[-1] for r in got) >= 40
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert got == set(con.execute(quality_rules.ORACLE).fetchall())


# -- packing ---------------------------------------------------------------------------------------
def test_configurations_hold_the_histogram():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(300, 700, 3000), rng.integers(1, 1025, 500), np.array([1024] * 7 + [5]), np.array([700] * 4 + [324] * 3)):
        histogram = np.bincount(lengths, minlength=1025)
        plan = packing.configurations(histogram)
        assert (sum(times * counts for times, counts in plan) == histogram).all()
        assert max((counts * np.arange(1025)).sum() for _, counts in plan) <= 1024
        assert sum(t for t, _ in plan) <= sum(t for t, _ in packing.best_fit(histogram))


def test_program_places_nearly_all_sequences():
    histogram = np.bincount(np.random.default_rng(3).integers(300, 700, 3000), minlength=1025)
    histogram[[250, 720, 810]] = 1          # scarce lengths don't hold up the others
    plan, left = packing.program(histogram)
    placed, whole = sum(t for t, _ in plan), sum(t for t, _ in packing.configurations(histogram))
    assert (left >= 0).all() and (sum(t * counts for t, counts in plan) + left == histogram).all()
    assert placed >= 0.95 * whole and whole < sum(t for t, _ in packing.best_fit(histogram))


def test_packing(odd, docs, empty):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    for df in (odd, docs):
        texts = collections.Counter((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())
        rows = packing.pack_documents(df, keep_ids=True).collect()
        by = collections.defaultdict(list)
        pieces = collections.defaultdict(list)
        for r in rows:
            by[r.sequence_id].append(r)
            pieces[r.doc_id].append(r)
            assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        for used in by.values():
            at = 0
            for r in sorted(used, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 1024
        for (doc_id, text), n in texts.items():
            ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
            mine = sorted(pieces[doc_id], key=lambda r: r.piece)[::n]
            assert np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in mine]).tolist() == ids
            assert all(r.length == 1024 for r in mine[1:])
    assert packing.pack_documents(empty).count() == 0


# -- byte-level BPE --------------------------------------------------------------------------------
def test_byte_bpe_equals_tiktoken(spark, odd, empty):
    import tiktoken
    path = public_tokenizers.path(byte_bpe.RANKS)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    draw = random.Random(2)
    texts = ["".join(draw.choice(draw.choice(["ab ", "a\n ", "éa ", "-=", "0123 ", "中文a", ".,! ", "'s x", " ", "\U0001F600a", "\x85 \x1c"]))
                     for _ in range(draw.randint(1, 80))) for _ in range(400)]
    df = odd.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    encoded = byte_bpe.encode(df, "text", path)
    for r in encoded.collect():
        assert r.ids == other.encode_ordinary(r.text or "")
        data = (r.text or "").encode()
        assert all(data[a:].startswith(other.decode_single_token_bytes(i)) for a, i in zip(r.starts, r.ids))
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in byte_bpe.decode(encoded, path).collect())
    for r in byte_bpe.digests(df, path).join(df, "doc_id").collect():
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert byte_bpe.digests(empty.select("doc_id", "text"), path).count() == 0


# -- near-duplicate vectors ------------------------------------------------------------------------
def test_projection_forest(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((900, 64))
    near = base[:60] + 0.05 * rng.standard_normal((60, 64))
    group = base[100] + 0.02 * rng.standard_normal((500, 64))
    x = np.vstack([base, near, group, base[:30]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd_rows = [(9001, None), (9002, []), (9003, [0.0] * 64), (9004, [None] + [1.0] * 63), (9005, [float("nan")] * 64),
                (9006, [float("inf")] + [1.0] * 63), (9007, [1.0, 2.0]), (9007, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd_rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in projection_forest.near_duplicates(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= close.sum(axis=1)).all() and links.sum() >= 0.99 * close.sum()
    assert [got[i].n_links for i in range(9001, 9007)] == [0] * 6 and all(got[i].kept for i in range(9001, 9007))
    assert got[9007].n_links == 1
    assert all(got[960 + i].component_id == got[100].component_id for i in range(500)) and not got[900].kept
    assert projection_forest.near_duplicates(df.limit(0)).count() == 0


def test_projection_forest_hot_leaf_and_floats(spark):
    """A group that no cut parts, above two blocks, beside scattered pairs; floats; components and kept against brute force."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((700, 64))
    x = np.vstack([base, base[5] + 0.015 * rng.standard_normal((2300, 64)), base[100:220] + 0.1 * rng.standard_normal((120, 64))]).astype("f4")
    order = rng.permutation(len(x))
    rows = [(int(i), x[k].tolist()) for i, k in enumerate(order)]
    got = {r.vec_id: r for r in projection_forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    unit = x[order].astype("f8")
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= close.sum(axis=1)).all() and links.sum() >= 0.99 * close.sum()
    least = np.arange(len(x))
    while True:
        new = np.minimum(least, np.where(close, least[None, :], len(x)).min(axis=1))
        if (new == least).all():
            break
        least = new
    same = sum(got[i].component_id == least[i] for i in range(len(x)))
    assert same >= 0.99 * len(x) and all(got[i].kept == (got[i].component_id == i) for i in got)


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (502, 500), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in (500, 501, 502)} == {500}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- hidden Markov scoring -------------------------------------------------------------------------
def test_forward_recursion_is_exact():
    rng = np.random.default_rng(1)
    k, symbols = 3, 6
    p = hidden_markov.Parameters(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(symbols), k).T.copy())
    ids = [rng.integers(0, symbols, n).astype(np.int32) for n in (1, 2, 5, 40, 511, 512, 513, 1500, 2048)]
    got = hidden_markov.log10_likelihood(ids, p)
    for x, value in zip(ids, got):
        a, log = p.start * p.emit[x[0]], 0.0
        for i in x[1:]:
            a = (a @ p.move) * p.emit[i]
            log += math.log10(a.sum())
            a = a / a.sum()
        assert value == pytest.approx(log + math.log10(a.sum()), rel=1e-9)
    start, move, emit = hidden_markov.expected_counts(ids[:4], p)
    assert start.sum() == pytest.approx(4) and emit.sum() == pytest.approx(48) and move.sum() == pytest.approx(44)


def test_expected_counts_are_those_of_whole_sequences():
    rng = np.random.default_rng(4)
    k, symbols = 3, 6
    p = hidden_markov.Parameters(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k) / 9, k), rng.dirichlet(np.ones(symbols), k).T.copy())
    ids = [rng.integers(0, symbols, n).astype(np.int32) for n in (1, 40, 511, 512, 513, 1024, 1500)]
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k))
    for x in ids:
        forward, back, scale = np.zeros((len(x), k)), np.ones((len(x), k)), np.zeros(len(x))
        for t, i in enumerate(x):
            a = (forward[t - 1] @ p.move if t else p.start) * p.emit[i]
            scale[t] = a.sum()
            forward[t] = a / scale[t]
        for t in range(len(x) - 1, 0, -1):
            weighted = back[t] * p.emit[x[t]] / scale[t]
            back[t - 1] = p.move @ weighted
            move += np.outer(forward[t - 1], weighted) * p.move
        gamma = forward * back
        start += gamma[0]
        np.add.at(emit, x, gamma)
    for got, expected in zip(hidden_markov.expected_counts(ids, p), (start, move, emit)):
        assert np.allclose(got, expected, rtol=1e-9)


@pytest.mark.parametrize("tokens", (8, 104, 1 << 19))
def test_long_texts_are_handed_from_block_to_block(monkeypatch, tokens):
    rng = np.random.default_rng(6)
    k, symbols = 3, 6
    p = hidden_markov.Parameters(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(symbols), k).T.copy())
    ids = [rng.integers(0, symbols, n).astype(np.int32) for n in (7, 0, 8, 9, 50, 104, 105, 500, 1, 9)]
    whole, score = hidden_markov.expected_counts(ids, p), hidden_markov.log10_likelihood(ids, p)
    monkeypatch.setattr(hidden_markov, "TOKENS", tokens)
    assert all(np.allclose(x, y, rtol=1e-9) for x, y in zip(hidden_markov.expected_counts(ids, p), whole))
    assert np.allclose(hidden_markov.log10_likelihood(ids, p), score, rtol=1e-9) and score[1] == 0
    assert np.array_equal(whole[2].sum(axis=1).round(6), np.bincount(np.concatenate(ids), minlength=symbols))


def test_places_of_words():
    rng = np.random.default_rng(8)
    for n in (1, 2, 300, 40_000):
        sorted_words = np.unique(np.concatenate([rng.integers(0, 2 ** 64, n, np.uint64), np.arange(n // 3, dtype=np.uint64) + np.uint64(5)]))
        begins = np.searchsorted(sorted_words, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46))
        hashes = np.concatenate([sorted_words, rng.integers(0, 2 ** 64, 999, np.uint64), np.array([0, 2 ** 64 - 1], np.uint64)])
        at = hidden_markov._places(sorted_words, begins, hashes)
        assert np.array_equal(sorted_words[at] == hashes, np.isin(hashes, sorted_words))


def test_places_of_words():
    rng = np.random.default_rng(8)
    for n in (1, 2, 300, 40_000):
        sorted_words = np.unique(np.concatenate([rng.integers(0, 2 ** 64, n, np.uint64), np.arange(n // 3, dtype=np.uint64) + np.uint64(5)]))
        begins = np.searchsorted(sorted_words, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46))
        hashes = np.concatenate([sorted_words, rng.integers(0, 2 ** 64, 999, np.uint64), np.array([0, 2 ** 64 - 1], np.uint64)])
        at = hidden_markov._places(sorted_words, begins, hashes)
        assert np.array_equal(sorted_words[at] == hashes, np.isin(hashes, sorted_words))


def test_a_task_sends_few_rows_of_expected_counts(spark):
    """The counts of 5,000 symbols leave a task as a few values, which are summed by chunk."""
    seen = 5 * hidden_markov.CHUNK
    rows = [(i % 7, np.arange(i % 7, seen, 7, dtype=np.float64)) for i in range(14)]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([x.tobytes()], pa.binary())], ["chunk", "counts"]) for i, x in rows]
    out, = hidden_markov._added(batches)
    assert sorted(out.column("chunk").to_pylist()) == list(range(7))
    for i, x in zip(out.column("chunk").to_pylist(), out.column("counts").to_pylist()):
        assert np.array_equal(np.frombuffer(x), 2 * rows[i][1])


def test_every_pass_sees_every_training_text(spark):
    vocab = hidden_markov.Vocabulary(np.arange(3, dtype=np.uint64), np.arange(3), np.array([40.0, 30, 20, 1300, 0]), 1390, 4)
    texts = [np.array([0, 1, 2][:i % 4] + [3], "<i4") for i in range(1300)]
    rows = [(None if i % 3 == 0 else 7, bytearray(x.tobytes())) for i, x in enumerate(texts)]
    got = hidden_markov.train(spark.createDataFrame(rows, "doc_id long, ids binary").repartition(5), vocab)
    rng = np.random.default_rng(7)
    k = hidden_markov.STATES
    p = hidden_markov._normalised(np.ones(k), np.ones((k, k)) + 4 * np.eye(k), vocab.counts[:, None] * rng.gamma(1.0, 1.0, (5, k)), vocab)
    for _ in range(hidden_markov.PASSES):
        p = hidden_markov._normalised(*hidden_markov.expected_counts(texts, p), vocab)
    assert all(np.allclose(x, y, rtol=1e-6) for x, y in zip(got, p))


def test_hidden_markov(odd, docs, empty):
    for df in (odd, docs):
        rows = hidden_markov.scored(df).collect()
        texts = [(r.doc_id, found_words(r.text) + ["\0"]) for r in df.collect()]

        def held(i):
            return i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        counts = collections.Counter(w for i, t in texts if not held(i) for w in t)
        total, types = sum(counts.values()), len(counts)
        expected = sorted((i is None, i or 0, len(t), sum(w in counts for w in t), round(sum(
            math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in t), 5)) for i, t in texts)
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in rows) == expected
        assert all(r.train_tokens == total and r.held_out == held(r.doc_id) and math.isfinite(r.score) for r in rows)
    out = [r for r in hidden_markov.scored(docs).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert hidden_markov.scored(empty).count() == 0


# -- line dedup ------------------------------------------------------------------------------------
def prose(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 8))) for _ in range(n))


def test_line_dedup_cuts_later_copies(spark):
    rows = []
    for j in range(8):
        passage = prose(60, j)
        own = [prose(90, 100 + 10 * j + k) for k in range(4)]
        for k, text in enumerate([f"{own[0]}\n{passage}\n{prose(40, 900 + j)}", f"{own[1]} {passage} {prose(40, 950 + j)}",
                                  f"{passage}\n{own[2]}", f"{own[3]}. {passage}"]):
            rows.append((10 * j + k, text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup(df).collect()}
    for j in range(8):
        texts = [got[10 * j + k].text for k in range(4)]
        assert texts[0] == rows[4 * j][1]
        assert not any(prose(60, j) in t for t in texts[1:])
        for k in range(4):
            assert len(rows[4 * j + k][1].split()) - len(texts[k].split()) == got[10 * j + k].n_removed <= 60
            assert " ".join(prose(90, 100 + 10 * j + k).split()[:80 if k != 2 else 90][10:]) in texts[k]


def test_line_dedup_finds_every_run_of_its_length(spark):
    rows = []
    for j in range(400):
        passage = prose(51 if j % 2 else 25, 3000 + j)
        rows += [(2 * j + k, f"{prose(70 + j % 13, 5000 + 2 * j + k)} {passage} {prose(70, 8000 + 2 * j + k)}") for k in range(2)]
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for j in range(400):
        assert got[2 * j].n_removed == 0 and (51 if j % 2 else 25) <= got[2 * j + 1].n_removed <= 55


def plain_line_dedup(rows, n=25):
    """Words that stay, by id: a word goes if a run of n words around it stands earlier, in an earlier text or further up."""
    earliest, out = {}, {}
    for doc_id, text in sorted(rows):
        tokens, gone = found_words(text), set()
        for p in range(len(tokens) - n + 1):
            if earliest.setdefault(tuple(tokens[p:p + n]), (doc_id, p)) != (doc_id, p):
                gone.update(range(p, p + n))
        out[doc_id] = [w for i, w in enumerate(tokens) if i not in gone], len(gone)
    return out


def check_line_dedup(spark, rows):
    shuffled = random.Random(1).sample(rows, len(rows))
    got = line_dedup.dedup(spark.createDataFrame(shuffled, "doc_id long, text string").repartition(5))
    got = {r.doc_id: (found_words(r.text), r.n_removed) for r in got.collect()}
    assert got == plain_line_dedup(rows)
    return got


def test_line_dedup_equals_brute_force(spark):
    draw = random.Random(7)
    pool = [prose(60, 20_000 + k).split() for k in range(30)]
    rows = []
    for i in range(300):
        tokens = []
        for _ in range(draw.randint(0, 6)):
            tokens += prose(draw.randint(0, 30), draw.random()).split()
            run, size = draw.choice(pool), draw.randint(16, 60)
            at = draw.randint(0, 60 - size)
            tokens += [w.upper() if draw.random() < 0.1 else w for w in run[at:at + size]]
        rows.append((i, "".join(w + draw.choice([" ", " ", "  ", "\n"]) for w in tokens)))
    rows += [(300, "ha " * 100), (301, " ".join(["a", "b"] * 60)), (302, rows[5][1]), (303, rows[5][1] + " end")]
    got = check_line_dedup(spark, rows)
    assert sum(n for _, n in got.values()) > 5000


def test_line_dedup_surveys_a_row_a_fingerprint(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, 5, text), (2, 6, None), (3, 7, f"\n{text.upper()} "), (4, 8, "w0 " * 40)], "key long, rank long, text string")
    rows = line_dedup._survey(docs).collect()
    found = {k: sorted((r.place // 16, r.place % 16, r.print, r.kind) for r in rows if r.key == k) for k in (1, 2, 3, 4)}
    assert found[1] == found[3] and not found[2] and {(r.key, r.rank) for r in rows} == {(1, 5), (3, 7), (4, 8)}
    for k, windows in ((1, 60 - line_dedup.RUN_WORDS + 1), (4, 40 - line_dedup.RUN_WORDS + 1)):     # every window has one fingerprint
        assert [w for first, n, *_ in found[k] for w in range(first, first + n)] == list(range(windows))
    assert len({r.kind for r in rows}) == len({(r.print, r.kind) for r in rows})


def test_line_dedup_fingerprints_with_other_heads(spark):
    """Earlier texts that hold the words of each fingerprint, or of pieces, but no run of 25: they neither hide a repeat nor make one."""
    rows = []
    for j in range(20):
        passage = prose(40, 30_000 + j).split()
        pieces = [" ".join(passage[at:at + 16]) for at in range(25)]
        rows += [(100 * j + k, f"{prose(20, 31_000 + 100 * j + k)} {piece} {prose(20, 35_000 + 100 * j + k)}") for k, piece in enumerate(pieces)]
        rows += [(100 * j + 50 + k, f"{prose(30, 40_000 + 2 * j + k)} {' '.join(passage)} {prose(30, 41_000 + 2 * j + k)}") for k in range(2)]
    got = check_line_dedup(spark, rows)
    assert all(got[100 * j + 50][1] == 0 and got[100 * j + 51][1] == 40 for j in range(20))


def test_line_dedup_cuts_whole_batches():
    """Texts lose their stretches by a few array operations on a batch, also in a slice of one, at both ends, and next to each other."""
    texts = pa.array(["never", "  a b  c\nd é ", "x y", "p q r s t u", "not"])[1:4]
    size = line_dedup.LENGTHS
    lists = pa.array([[], [0 * size + 1, 3 * size + 2], [0 * size + 2], [2 * size + 2, 1 * size + 2, 5 * size + 1]], pa.list_(pa.int64()))[1:]
    cut, gone = line_dedup._cut(texts, lists)
    assert cut.to_pylist() == ["  b  c\n", "", "p t "] and gone.tolist() == [3, 2, 4]


def test_smallest_hash_of_each_window():
    rng = np.random.default_rng(5)
    for n in (10, 11, 500):
        gram = rng.integers(0, 40, n).astype(np.uint64)
        windows = np.lib.stride_tricks.sliding_window_view(gram, line_dedup.WINDOW)
        assert np.array_equal(line_dedup._least(gram), np.argmin(windows, axis=1) + np.arange(len(windows)))


def test_joins_are_hashed_inside_the_scope_only(spark):
    before = spark.conf.get(session.HASHED_JOINS, None)
    with pytest.raises(ValueError), session.hashed_joins(spark):
        assert spark.conf.get(session.HASHED_JOINS) != before
        raise ValueError
    assert spark.conf.get(session.HASHED_JOINS, None) == before


def test_line_dedup_odd_input(spark, odd, empty):
    got = line_dedup.dedup(odd)
    assert got.columns == [*odd.columns, "n_removed"] and got.count() == odd.count()
    assert {(r.doc_id, r.text) for r in got.collect()} == {(r.doc_id, r.text) for r in odd.collect()}
    assert line_dedup.keep_lines(empty).count() == 0
    text = prose(200, 4)
    copies = spark.createDataFrame([(3, text, 0), (1, text, 0), (2, text + " " + prose(30, 5), 0)], "doc_id long, text string, n_chars int")
    kept = {r.doc_id: r for r in line_dedup.keep_lines(copies, "n_chars").collect()}
    assert set(kept) == {1, 2} and kept[1].text == text and kept[2].n_chars == len(kept[2].text)


# -- toxicity --------------------------------------------------------------------------------------
def test_toxicity(spark, odd, empty):
    draw = random.Random(8)
    vocabulary = [prose(1, i) for i in range(400)]
    rows, labels = [], []
    for i in range(1200):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(30, 120))]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words[draw.randrange(len(words))] = draw.choice(["villain", "rotter", "scoundrel"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(5, None), (None, 1), (6, 7)], "doc_id long, toxic int")
    model = toxicity.fit(df, marks)
    got = {r.doc_id: r.score for r in toxicity.scored(df, model).collect()}
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= toxicity.THRESHOLD) == (i % 6 == 0) for i in held)
    assert right >= 0.97 * len(held) and all(0 <= x <= 1 for x in got.values())
    scores = toxicity.scored(odd, model, "risk").collect()
    assert len(scores) == odd.count() and all(0 <= r.risk <= 1 for r in scores)
    assert toxicity.keep_clean(odd, marks.limit(0)).columns == odd.columns
    assert toxicity.fit(df, marks.limit(0)) is None and toxicity.scored(empty, model).count() == 0


# -- n-gram join -----------------------------------------------------------------------------------
def plain_components(texts, n, percent):
    sets = {}
    for i, t in texts.items():
        w = found_words(t)
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    return {i: top(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 60)])
def test_ngram_join(spark, odd, n, percent):
    draw = random.Random(6)
    texts = {i: t for i, t in enumerate(ODD)}
    for group in range(6):
        words = prose(120, group).split()
        for k in range(12):
            copy = list(words)
            for _ in range(draw.randint(0, 6)):
                copy[draw.randrange(len(copy))] = prose(1, draw.random())
            texts[100 + 20 * group + k] = " ".join(copy)
    df = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(None, "a b c d e f g")], "id long, text string")
    expected, sizes = plain_components(texts, n, percent)
    rows = ngram_join.join(df, n, percent).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        if r.id is not None:
            assert (r.component_id, r.n_shingles) == (expected[r.id], sizes[r.id])
    assert [r.component_id for r in rows if r.id is None] == [None]


def test_ngram_join_pairs_by_size_and_place(spark):
    rows = [(1, s, 100, 15, s) for s in range(300)]                                     # 85 n-grams are left, a link needs 92
    rows += [(2, 400, 100, 0, 400), (2, 401, 86, 0, 401), (2, 402, 84, 0, 402)]         # 84 is too small for 100, not for 86
    rows += [(3, s, 50, 0, 500) for s in range(500, 800)]                               # one component
    df = spark.createDataFrame(rows, "gram long, sig long, size long, place int, root long")
    got = ngram_join._apart(df, 85).collect()
    assert sorted((r.a, r.b, r.size_a, r.size_b) for r in got) == [(400, 401, 100, 86), (401, 402, 86, 84)]


@pytest.mark.parametrize("n,percent", [(1, 85), (4, 80)])
def test_ngram_join_of_texts_of_many_sizes(spark, n, percent):
    draw = random.Random(9)
    texts = {}
    for group in range(12):
        words = [f"g{group}w{k}" for k in range(90)]
        for k in range(14):     # beginnings, ends and changed words: links near the limit, with and without common words
            low, high = draw.randint(0, 9), draw.randint(70, 90)
            copy = [w if draw.random() > 0.015 else f"x{draw.random()}" for w in words[low:high]]
            texts[100 * group + k] = " ".join(copy + [f"common{j}" for j in range(draw.choice([0, 4, 12]))])
    expected, sizes = plain_components(texts, n, percent)
    rows = ngram_join.join(spark.createDataFrame(list(texts.items()), "id long, text string"), n, percent).collect()
    assert {r.id: (r.component_id, r.n_shingles) for r in rows} == {i: (expected[i], sizes[i]) for i in texts}


def test_ngram_join_keeps_one(spark, odd, empty):
    kept = ngram_join.keep_one(odd)
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13] and kept.columns == odd.columns
    assert ngram_join.join(empty.select(F.col("doc_id").alias("id"), "text"), 4, 85).count() == 0


# -- main text of pages ----------------------------------------------------------------------------
def test_tag_paths(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
        <nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div id="cookie-notice">We use cookies, accept.</div>
        <main><article><h1>Big &amp; title</h1><p>First   para, with <a href=y>link</a>&nbsp;text.<p>Second <b>one</b>, longer
        text is here.<br>It goes on, and on.</p><ul><li>item one, ok.<li>item two</ul><section class="comments"><p>I liked it, really. Great
        stuff, thanks to you all.</p></section></article><aside>Side text. More, of it.</aside></main><div class="ad">Buy now, cheap. Very.</div>
        <form><p>Your name, please.</p></form><footer>(c) 2020</footer><script>x="<p>no</p>"</script><!-- gone --></body></html>"""
    text = "Big & title\n\nFirst para, with link text.\n\nSecond one, longer text is here. It goes on, and on.\n\nitem one, ok.\n\nitem two"
    assert tag_paths.main_text(page) == text
    assert tag_paths.main_text("<p>unfinished <b") == "unfinished" and tag_paths.main_text("<!-- x") == ""
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "just text &lt;b&gt;"), (4, "x", "<div>" * 500 + "deep")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = tag_paths.extract(df).collect()
    assert sorted(r.text for r in got) == sorted([text, text, "", "", "just text <b>", "deep"])
    assert all(r.n_chars == len(r.text) for r in got) and tag_paths.extract(df.limit(0)).count() == 0


def test_tag_paths_keeps_sections_with_marked_words():
    def body(k):
        return f"Paragraph {k} of the article, which is long enough. It goes on, and on, to its end."
    parts = ['<h2 id="side-effects">Side effects</h2>', '<section id="form-validation"><p>{}</p></section>',
             '<section id="related-work"><p>{}</p></section>', '<div class="notice-period"><p>{}</p></div>',
             '<p title="The hidden valley">{}</p>', '<div data-overflow="hidden"><p>{}</p></div>', '<div data-id="comment-3"><p>{}</p></div>',
             '<section id="discussion"><p>{}</p></section>']
    texts = [body(k) for k in range(len(parts))]
    page = "<body><article><p>" + body(99) + "</p>" + "".join(x.format(t) for x, t in zip(parts, texts)) \
        + '<div id="related-posts"><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></div>' \
        + '<div hidden><p>Not shown, at all.</p></div></article><div id="cookie-notice">We use cookies, accept.</div></body>'
    assert tag_paths.main_text(page) == "\n\n".join([body(99), "Side effects", *texts[1:]])


def test_added_tokens():
    """The string of an added token in a text is that token, as in the library; around it nothing changes."""
    from tokenizers import Tokenizer
    path = public_tokenizers.path(packing.TOKENIZER)
    library = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y <|endof text|>", "no such token here", "<|endoftext|><|endoftext|> é\n\n z"]
    found = byte_bpe.from_json(path).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert np.frombuffer(found[0], "<u4").tolist() == [64, 220, 50256, 275]


def test_pieces_are_encoded_when_first_looked_up(monkeypatch):
    """Each distinct piece once, in one pass over a text; odd white space makes no difference to the library's ids."""
    path = public_tokenizers.path(packing.TOKENIZER)
    codec = byte_bpe.Codec(byte_bpe.from_json(path).tokenizer, [])
    asked = []
    monkeypatch.setattr(codec, "_piece", lambda piece, find=codec._piece: asked.append(piece) or find(piece))
    texts = ["x the cat, the cat's 12 \u4e2d the\ncat.", "y the cat, the cat z", None, "", " ", "  a b", "a b ", "a  b c", "a \tb c", "a\n b", "\n a b\n"]
    found = codec.encode(texts)
    assert len(asked) == len(set(asked)) and asked[:5] == ["the", "cat,", "cat's", "12", "\u4e2d"]
    plain = codec.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [x.ids for x in plain]


@pytest.mark.parametrize("tokens", (64, 1 << 19))
def test_segments_of_long_texts_go_side_by_side(monkeypatch, tokens):
    """One long text costs no steps of its own, and segments of any length change nothing."""
    rng = np.random.default_rng(9)
    k, symbols = 3, 6
    p = hidden_markov.Parameters(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k) / 9, k), rng.dirichlet(np.ones(symbols), k).T.copy())
    ids = [rng.integers(0, symbols, n).astype(np.int32) for n in (900, 3, 16, 17, 32, 0, 45, 100)]
    whole, score = hidden_markov.expected_counts(ids, p), hidden_markov.log10_likelihood(ids, p)
    steps, packed = [], hidden_markov._packed
    monkeypatch.setattr(hidden_markov, "_packed", lambda texts: steps.append(len(texts[0])) or packed(texts))
    monkeypatch.setattr(hidden_markov, "TOKENS", tokens)
    monkeypatch.setattr(hidden_markov, "SEGMENT", 16)
    assert all(np.allclose(x, y, rtol=1e-9) for x, y in zip(hidden_markov.expected_counts(ids, p), whole))
    assert np.allclose(hidden_markov.log10_likelihood(ids, p), score, rtol=1e-9)
    assert max(steps) == 16
