import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from visitlake.llm import grammar_files
from visitlake.llm.grammar_files import Block, pack_block, re_pair, read_grammar_files, write_grammar_files
from visitlake.llm.packing import configurations, cut_pieces, pack_documents, packing_plan, sequences
from visitlake.llm.store import new_folder
from visitlake.llm.tokens import WordCodec, vocabulary_path

LIBRARY = Tokenizer.from_file(vocabulary_path())
CODEC = WordCodec(vocabulary_path())


def direct(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.text(alphabet="aBé İΣσς'.,|<> \n\x1c\x85\u0301ﬁ1")), max_size=5))
def test_codec_equals_the_library(texts):
    ids, bounds = CODEC.encode(texts)
    start = 0
    for text, end in zip(texts, bounds.tolist()):
        assert ids[start:end].tolist() == direct(text)
        start = end


def test_codec_special_strings_and_forgetting():
    texts = ["a <|endoftext|> b", "x<|startoftext|>", "it's 'tis don't, isn't.", "word, word. Word", None, ""]
    codec = WordCodec(vocabulary_path(), remembered=9)
    for _ in range(4):
        ids, bounds = codec.encode_documents(texts)
        assert [x.tolist() for x in np.split(ids, bounds[:-1])] == [direct(t) + [1] for t in texts]


def test_runs_of_marks_after_letters_are_pieces_of_their_own():
    rng, marks, asked = random.Random(3), ",.;:!?*#&$%()[]{}\"-+=/@^_~`\\<|>'", []
    codec = WordCodec(vocabulary_path(), remembered=200)
    codec._encode = lambda words, encode=codec._encode: asked.extend(words) or encode(words)
    codec.encode(["word*** word word!! Σας### e\u0301t\u00e9...", "word!! word*** ???"])
    assert sorted(asked) == sorted(["word", "***", "!!", "Σας", "###", "e\u0301t\u00e9...", "???"])  # each once, marks apart from letters
    for _ in range(40):
        texts = [" ".join(rng.choice(["le", "Été", "ΣΑΣ", "n1", "Ünd", ""]) + "".join(rng.choices(marks, k=rng.randrange(4))) + rng.choice(["", "", "s", "7"])
                          for _ in range(30)) for _ in range(10)]
        ids, bounds = codec.encode(texts)
        assert [x.tolist() for x in np.split(ids, bounds[:-1])] == [direct(t) for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_grammar_round_trip_and_random_access(seed):
    rng = np.random.default_rng(seed)
    docs = [np.append(rng.integers(0, 3 + 5 * seed, n), 1) for n in rng.integers(0, 900, 40)] + [np.array([1])] + [np.append(np.full(5_000, 7), 1)]
    ids, ends = np.concatenate(docs).astype(np.uint32), np.cumsum([len(d) for d in docs])
    grammar = re_pair(ids, ends, 49_408, 1, min_count=4)
    block = Block(pack_block(grammar, ends))
    assert len(grammar.symbols) < len(ids) and np.array_equal(block.documents(), ids) and np.array_equal(block.ends, ends)
    for _ in range(200):
        k = int(rng.integers(len(docs)))
        a = int(rng.integers(len(docs[k]) + 1))
        b = int(rng.integers(a, len(docs[k]) + 3))
        assert np.array_equal(block.ids(k, a, b), docs[k][a:b])


def test_grammar_files(spark, odd_docs, no_docs, clashing, vocabulary):
    for docs, block in ((odd_docs, 2_000_000), (clashing, 50)):
        folder = new_folder(spark, "test")
        write_grammar_files(docs, folder, vocabulary, block_tokens=block)
        rows = sorted(read_grammar_files(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
        ordered = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
        start = 0
        for got, row in zip(rows, ordered, strict=True):
            ids = direct(row.text) + [1]
            raw = np.array(ids, "<u4").tobytes()
            assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32, bytes(got.ids)) == (row.doc_id, start, len(ids), zlib.crc32(raw), raw)
            start += len(ids)
    folder = new_folder(spark, "test")
    write_grammar_files(no_docs, folder, vocabulary)
    assert read_grammar_files(spark, folder).count() == 0


@pytest.mark.parametrize("docs", ["odd_docs", "clashing"])
def test_packing(request, docs, vocabulary):
    docs = request.getfixturevalue(docs)
    placed = pack_documents(docs, vocabulary)
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r.doc_id].append(direct(r.text) + [1])
    by_sequence, lengths = defaultdict(list), defaultdict(int)
    for r in placed.collect():
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length and r.start == 4096 * r.piece and any(ids == t[r.start:r.start + r.length] for t in texts[r.doc_id])
        by_sequence[r.sequence_id].append((r.offset, r.length))
        lengths[r.doc_id] += r.length
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert lengths == {k: sum(map(len, v)) for k, v in texts.items()}
    whole = sequences(placed).collect()
    assert len(whole) == len(by_sequence)
    assert all(len(r.ids) == 4 * sum(p.length for p in r.pieces) for r in whole)


def test_packing_nothing(no_docs, vocabulary):
    assert pack_documents(no_docs, vocabulary).count() == 0


def test_plan_is_complete_and_tight():
    random.seed(5)
    histogram = defaultdict(int)
    for _ in range(30_000):
        histogram[min(4096, int(random.lognormvariate(6.3, 1.1)) + 1)] += 1
    plan = packing_plan(dict(histogram))
    for length, rows in plan.groupby("length"):
        assert rows["lo"].tolist() == [0, *rows["hi"].tolist()[:-1]] and rows["hi"].iloc[-1] == histogram[length]
    total = sum(k * n for k, n in histogram.items())
    used = int((plan["sequence"] + plan["hi"] - plan["lo"]).max())
    assert used <= 1.002 * -(-total // 4096) + 1
    lengths = np.array(sorted(k for k in histogram if k < 4096))
    columns, _ = configurations(lengths, np.array([histogram[k] for k in lengths]), 4096)
    packed = sum(n * lengths[list(c)].sum() for c, n in columns.items())
    assert packed > 0.9 * lengths @ np.array([histogram[k] for k in lengths])  # the program, not the rounding, places the bulk
    assert all(lengths[list(c)].sum() <= 4096 for c in columns)
    same = packing_plan({2049: 1_000_000, 2047: 1_000_000, 1: 3})
    assert int((same["sequence"] + same["hi"] - same["lo"]).max()) <= 1_000_001


def test_numbers_within_a_part(spark, vocabulary):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same words").alias("text")).repartition(4)
    rows = cut_pieces(docs, vocabulary).collect()
    assert len({(r.part, r.length, r.nth) for r in rows}) == 500


def test_rounds_end_when_no_pair_is_frequent():
    """Copies of one text shrink to a few symbols each, and nothing that occurs often enough is left."""
    rng = np.random.default_rng(3)
    one = rng.integers(10, 40_000, 1_000)
    copies = np.tile(np.append(one, 1), 1_999).astype(np.uint32)
    mixed = np.concatenate([np.append(rng.integers(10, 200, rng.integers(1, 400)), 1) for _ in range(300)]).astype(np.uint32)
    for ids in (copies, mixed):
        grammar = grammar_files.re_pair(ids, np.flatnonzero(ids == 1) + 1, 49_000, 1)
        flat, starts, sizes = grammar.expansions()
        assert (grammar_files.gather(flat, starts, sizes, grammar.symbols)[0] == ids).all()
        a, b = grammar.symbols[:-1].astype(np.uint64), grammar.symbols[1:].astype(np.uint64)
        inside = (a != 1) & (b != 1)
        _, often = np.unique((a << np.uint64(32) | b)[inside], return_counts=True)
        assert not len(often) or often.max() < grammar_files.MIN_COUNT
    assert len(grammar_files.re_pair(copies, np.flatnonzero(copies == 1) + 1, 49_000, 1).symbols) <= 2 * 1_999
