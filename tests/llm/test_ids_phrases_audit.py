"""Elias-Fano id files, phrase mining and the filter audit against brute force."""

import collections
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from churnlake.llm import elias_fano, filter_audit, phrases
from churnlake.llm.elias_fano import EliasFano
from churnlake.llm.tables import read_table

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# -- Elias-Fano ------------------------------------------------------------------------------------
@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**64 - 1)), max_size=400), st.data())
def test_sequence_round_trip(values, data):
    values = sorted(values)
    found = EliasFano.from_bytes(EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert found.select(0, len(values)).tolist() == values
    first = data.draw(st.integers(0, len(values)))
    last = data.draw(st.integers(first, len(values) + 3))
    assert found.select(first, last).tolist() == values[first:last]
    for i in range(0, len(values), 7):
        assert found[i] == values[i]


def test_sequence_space_and_order():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000)).astype(np.uint64)
    size = 8 * len(EliasFano.of(values).to_bytes()) / len(values)
    assert size < 2 + np.log2(int(values[-1]) / len(values)) + 1.5         # places included; a 64-bit table takes 64
    with pytest.raises(ValueError):
        EliasFano.of(np.array([3, 2], np.uint64))
    with pytest.raises(IndexError):
        EliasFano.of(np.array([1], np.uint64))[1]


def library_ids(texts):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path(elias_fano.TOKENIZER))
    return [x.ids + [elias_fano.END] for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = [None, "", " \n\t ", "one", "Two WORDS don't we'll I'M 'S", "a b c \x1c\x1d x\x85y", "é É ̈x İ ß 中文字 \U0001F600!? 123 4a5",
       "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "<|endof text|>", "x" * 5000, " ".join(f"w{i % 97}x{i}" for i in range(20_000)),
       "same", "same", "tab\tvt\x0bff\x0ccr\rnl\n#$%&*", "​ zero‍width ﻿", "don''t ''' 'll'll"]


def test_word_codec_equals_library():
    rng = random.Random(4)
    alphabet = list("abcXYZ'’ \t\n.,!<|>#0123456789éÉ́̈中  \x1c\x85İΣ") + ["'re", "'S", "<|endoftext|>", "  "]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(4000)]
    words = elias_fano.codec(public_tokenizers.path(elias_fano.TOKENIZER))
    found = words.encode([None if t is None else t.encode() for t in texts])
    assert [np.frombuffer(x, "<u2").tolist() for x in found] == [x[:-1] for x in library_ids(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1000 - 37 * i if i % 5 else -2**40 + i, t, "en", "clash") for i, t in enumerate(ODD)]
    rows += [rows[4], rows[4], (None, "no id", "en", "x"), (None, None, None, None), (2**62, "far away", "fr", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string")


def expected_ids(rows):
    rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    found, start = [], 0
    for r, ids in zip(rows, library_ids([r.text for r in rows])):
        found.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


def test_id_files(spark, odd, tmp_path):
    path = public_tokenizers.path(elias_fano.TOKENIZER)
    manifest = elias_fano.write_ids(odd, str(tmp_path), path)
    rows = elias_fano.read_digests(manifest, str(tmp_path)).collect()
    got = sorted(map(tuple, rows), key=lambda r: r[1])
    known = expected_ids(odd.collect())
    assert [r for r in got if r[0] is not None] == [r for r in known if r[0] is not None]
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in known) and [r[1] for r in got] == [r[1] for r in known]
    # ids come back whole, and one document alone by its place in a file
    back = {r.start: r.ids for r in elias_fano.read_ids(manifest, str(tmp_path)).collect()}
    assert {s: zlib.crc32(np.array(ids, "<u4").tobytes()) for s, ids in back.items()} == {r[1]: r[3] for r in got}
    for m in manifest.collect():
        source = elias_fano.IdFile(f"{tmp_path}/ids", m.file, m.width)
        ends = source.bounds(0, m.n_docs)
        for i in range(m.n_docs):
            assert source.document(i).tolist() == back[m.start + int(ends[i])]
        source.close()


def test_id_files_small_blocks_and_empty(spark, odd, tmp_path, monkeypatch):
    path = public_tokenizers.path(elias_fano.TOKENIZER)
    monkeypatch.setattr(elias_fano, "READ_DOCS", 2)
    manifest = elias_fano.write_ids(odd, str(tmp_path / "a"), path)
    got = sorted((r.start, r.n_tokens, r.ids_crc32) for r in elias_fano.read_digests(manifest, str(tmp_path / "a")).collect())
    assert [r[0] for r in got] == [r[1] for r in expected_ids(odd.collect())]
    assert list(elias_fano._blocks(np.array([0, 3, 4, 50, 51, 52]), 5)) == [(0, 2), (2, 3), (3, 5)]
    none = elias_fano.write_ids(odd.limit(0), str(tmp_path / "b"), path)
    assert none.count() == 0 and elias_fano.read_digests(none, str(tmp_path / "b")).count() == 0


def test_id_files_of_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    got = sorted(map(tuple, elias_fano.op11_elias_fano_ids(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(expected_ids(docs.select("doc_id", "text").collect()))


# -- phrases ---------------------------------------------------------------------------------------
def brute_counts(rows):
    counts = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            found = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                counts[lang or "und" if lang is None else lang].update((k, " ".join(found[i:i + k])) for i in range(len(found) - k + 1))
    return counts


def brute_phrases(rows, least, top):
    out = []
    for lang, counts in brute_counts(rows).items():
        f = {p: n for (_, p), n in counts.items()}
        total = sum(n for (k, _), n in counts.items() if k == 1)
        candidates = {p: n for (k, p), n in counts.items() if k > 1 and n >= least}
        longer = collections.Counter()
        for p, n in candidates.items():
            w = p.split(" ")
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    q = " ".join(w[i:i + m])
                    longer[q] = max(longer[q], n)
        rows_ = []
        for p, a in candidates.items():
            if 100 * longer[p] >= 80 * a:
                continue
            w = p.split(" ")
            score, _, l, r = min((2_000_000 * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k, f[" ".join(w[:k])], f[" ".join(w[k:])])
                                 for k in range(1, len(w)))
            rows_.append((-score, -a, p.encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total, -score))
    return sorted(out)


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(9)
    vocabulary = ["en", "de", "fr", "New", "new", "york", "CITY", "hall", "é", "x.y", "a,b", "c", "d", "don't", "\x1c", "中"]
    texts = [rng.choice([" ", "  ", "\t"]).join(rng.choices(vocabulary, k=rng.randint(0, 40))) + rng.choice([".", "!\n", "", " "]) for _ in range(400)]
    texts += ["New  York City Hall; new york", None, "", " \t", "...", "z " * 3000] + ["one two three four five"] * 6
    rows = [(i // 2, t, rng.choice(["en", "de", None, ""]), "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string, n long")


@pytest.mark.parametrize("sample_of, sample_least", [(1, 2), (3, 2), (8, 40), (10**9, 1)])
def test_phrases_whatever_the_sample(talk, sample_of, sample_least):
    """A good sample, a bad one, and none at all (every phrase is then found by expansion) give the same exact result."""
    rows = [(r.lang, r.text) for r in talk.collect()]
    got = phrases.best_phrases(talk, 50, least=6, sample_of=sample_of, sample_least=sample_least).collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows, 6, 50)


def test_phrases_with_a_full_filter(talk, monkeypatch):
    """A filter that is far too small lets everything through: more work, the same result."""
    monkeypatch.setattr(phrases, "FILTER_BITS", 1 << 10)
    rows = [(r.lang, r.text) for r in talk.collect()]
    assert sorted(map(tuple, phrases.best_phrases(talk, 20, least=3, sample_of=2).collect())) == brute_phrases(rows, 3, 20)


def test_phrases_of_nothing(talk):
    assert phrases.best_phrases(talk.limit(0)).count() == 0
    assert phrases.best_phrases(talk.limit(5), least=1000).count() == 0


def test_phrase_scores_past_64_bits(spark):
    big = 10**13
    table = spark.createDataFrame([("en", 0, "", 9 * big), ("en", 1, "a", 3 * big), ("en", 1, "b", 2 * big), ("en", 2, "a b", big)],
                                  "lang string, size int, phrase string, n long")
    assert phrases.scored(table).first()["score"] == 2_000_000 * big // (5 * big)


def test_each_part_is_looked_up_once(monkeypatch):
    """A part is the first one of a phrase and the last one of another; one filter tells of it, that of its size."""
    texts = pa.array(["a b c d e f g h", "b c d. e f", "x y z"])
    keys = phrases.Keys(texts, pa.array(["en", "en", None]))
    asked, holds = [], phrases.Filter.holds
    monkeypatch.setattr(phrases.Filter, "holds", lambda one, x: asked.append(len(x)) or holds(one, x))
    none = phrases.Filter(np.zeros(16, np.uint64))
    found = dict(phrases._wanted(keys, [1, 2, 3, 4], [none, none, none], None))
    assert [len(found[k]) for k in (1, 2, 3, 4)] == [16, 0, 0, 0]
    assert asked == [16, 12, 8]


def test_phrase_filter():
    keys = np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)
    size = 1 << 17
    slot = phrases.Filter.slots(keys[:2500], size)
    bits = np.zeros(size // 64, np.uint64)
    np.bitwise_or.at(bits, slot >> np.uint64(6), np.uint64(1) << (slot & np.uint64(63)))
    found = phrases.Filter(bits).holds(keys)
    assert found[:2500].all() and found[2500:].mean() < 0.01


# -- filter audit ----------------------------------------------------------------------------------
def brute_fails(text, repeated):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {x for x, failed in zip("ABCDE", [
        len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        bool(re.search(r"[#$%&*|]", text)), repeated]) if failed}


def brute_audit(rows, labels):
    good = {i for i, q, t in labels if q == 1}
    toxic = {i for i, q, t in labels if t == 1}
    parts = collections.defaultdict(list)
    for doc_id, text, source in rows:
        text = text or ""
        repeated = doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in rows)
        parts[source or ""].append((doc_id, brute_fails(text, repeated)))
    out = []
    for part, docs in parts.items():
        total = collections.Counter()
        lines = []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                early = [d for d in docs if x in d[1]]
                left = [d for d in left if x not in d[1]]
                total[x] += len(gone)
                lines.append((part, "".join(order), step, len(left), len(gone), len(early) - len(gone), sum(d[1] == {x} for d in docs),
                              sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), x))
        out += [(*line[:-1], total[line[-1]]) for line in lines]
    return sorted(out)


def test_filter_audit(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "delta", "#tag", "é", "中", "x|y"] + [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words[rng.choice([0, 8]):rng.choice([8, 60, 208])] or words, k=rng.choice([10, 49, 50, 51, 120]))) for _ in range(60)]
    texts += [None, "", " \n", "A" * 10, "same text"] * 2
    rows = [(rng.choice([None, *range(50)]) if i % 3 == 0 else i, rng.choice(texts), rng.choice(["s1", "s2", None, ""])) for i in range(150)]
    rows += [(7, "same text", "s1"), (7, "same text", "s1"), (7, "same text", "s2"), (8, "same text", "s2")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, part string, n long")
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, n string")
    labels = [x for x in labels if x[0] is not None]
    table = filter_audit.tabulate(docs, marks)
    assert sorted(map(tuple, filter_audit.audit(table).collect())) == brute_audit(rows, labels)
    assert filter_audit.audit(filter_audit.tabulate(docs.limit(0), marks)).count() == 0
    assert filter_audit.audit(filter_audit.tabulate(docs, marks.limit(0))).where("good_lost + toxic_lost > 0").count() == 0


def test_least_squares_is_the_shapley_value():
    """Exact in rationals, for any game and any number of players."""
    rng = random.Random(5)
    for players in (2, 3, 4, 5):
        weights = filter_audit.least_squares(players)
        value = [0] + [rng.randint(-50, 50) for _ in range((1 << players) - 1)]
        orders = list(itertools.permutations(range(players)))
        for i in range(players):
            plain = Fraction(0)
            for order in orders:
                before = sum(1 << j for j in order[:order.index(i)])
                plain += value[before | 1 << i] - value[before]
            assert sum(w * v for w, v in zip(weights[i], value)) == plain / len(orders)
