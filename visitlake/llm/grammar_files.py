"""Token ids in files compressed by a Re-Pair grammar for each block, with random access to any document's ids."""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlake.llm.store import write_table
from visitlake.llm.tokens import END_ID, codec

#: ids in a block, which bounds a task's memory together with the longest document
BLOCK_TOKENS = 2_000_000
#: pairs rarer than MIN_COUNT are left alone; the least count of a round is that of the round before divided by SLACK
MIN_COUNT, SLACK = 32, 8
#: slots in which pairs are counted; where no slot has a frequent pair, pairs are counted one by one
SLOTS = 1 << 19
#: symbols are stored in 16 bits, so ids and nonterminals together stay below this where the vocabulary does
SYMBOLS = 1 << 16
_HEADER = struct.Struct("<4sIIIIII")
_MAGIC = b"RPG1"


@dataclass
class Grammar:
    """A block: rules (two symbols each, numbered from `base`), how many each round added, and the documents' symbols."""
    base: int
    left: np.ndarray
    right: np.ndarray
    rounds: np.ndarray
    symbols: np.ndarray
    ends: np.ndarray  # end of each document among the symbols

    def expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids below every symbol: flat, start and length by symbol."""
        n = self.base + len(self.left)
        starts, sizes = np.arange(n, dtype=np.int64), np.ones(n, np.int64)
        flat, at = np.arange(self.base, dtype=np.uint32), 0
        for count in self.rounds.tolist():
            pair = np.stack([self.left[at:at + count], self.right[at:at + count]], axis=1).ravel()
            ids, ends = gather(flat, starts, sizes, pair)
            new = self.base + at + np.arange(count)
            sizes[new] = sizes[pair].reshape(-1, 2).sum(axis=1)
            starts[new] = len(flat) + ends[1::2] - sizes[new]
            flat, at = np.concatenate([flat, ids]), at + count
        return flat, starts, sizes


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = sizes[keys]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts[keys] - (ends - own), own)], ends


def re_pair(ids: np.ndarray, ends: np.ndarray, base: int, end_id: int, min_count: int = MIN_COUNT, max_symbols: int = SYMBOLS) -> Grammar:
    """Replace frequent pairs by nonterminals, round after round, the most frequent first.

    `ids` are documents one after the other, each closed by `end_id`; a pair with that id is never replaced, so no rule crosses from
    one document into the next. A round counts all pairs, takes every pair that is frequent enough for it, and replaces their
    occurrences from left to right without overlap. The count asked for falls from round to round to `min_count`, and rounds go on until
    no pair occurs `min_count` times or no symbol is left.
    """
    seq = ids.astype(np.uint32)
    left, right, rounds, n = [], [], [], base
    limit = max(max_symbols, base)
    spokesman = np.zeros(SLOTS + 1, np.uint64)
    least, fresh, whole = None, None, True
    while n < limit and len(seq) > 1:
        if whole:
            a, b = seq[:-1], seq[1:]
            # other slots in every round: a pair that shares its slot with a commoner one has its own in a later round
            slot = a * np.uint32(0x9E3779B1 + 2 * len(rounds))
            slot ^= b * np.uint32(0x85EBCA6B)
            slot >>= np.uint32(13)
            closed = np.flatnonzero(seq == end_id)
            slot[closed[closed < len(slot)]] = SLOTS
            slot[closed[closed > 0] - 1] = SLOTS
            counts = np.bincount(slot, minlength=SLOTS + 1)
            counts[SLOTS] = 0
            least = max(min_count, (int(counts.max()) if least is None else least) // SLACK)
            places = np.flatnonzero((counts >= least)[slot])
            own = slot[places]
            pair = a[places].astype(np.uint64) << np.uint64(32) | b[places]
            spokesman[own] = pair  # of pairs that share a slot the last one speaks for it in this round
            speaks, same = spokesman, spokesman[own] == pair
            exact = np.bincount(own[same], minlength=1)
        else:
            # what a round at the least count leaves: as a rule only pairs with one of its new symbols are frequent now
            places = np.stack([fresh - 1, fresh], axis=1).ravel()  # ascending, with a repeat where two new symbols are neighbours
            places = places[(places >= 0) & (places < len(seq) - 1) & (np.diff(places, append=len(seq)) > 0)]
            a, b = seq[places], seq[places + 1]
            kept = (a != end_id) & (b != end_id)
            places, pair = places[kept], a[kept].astype(np.uint64) << np.uint64(32) | b[kept]
            speaks, own = np.unique(pair, return_inverse=True)
            same, exact = np.ones(len(own), bool), np.bincount(own, minlength=1)
        chosen = np.flatnonzero(exact >= least)
        if not len(chosen) and least == min_count:
            if not whole:
                whole = True
                continue
            if same.all():
                break
            speaks, own = np.unique(pair, return_inverse=True)
            same, exact = np.ones(len(own), bool), np.bincount(own)
            chosen = np.flatnonzero(exact >= least)
            if not len(chosen):
                break
        if not len(chosen):
            continue
        whole = least > min_count
        places, own = places[same], own[same]
        chosen = chosen[np.argsort(-exact[chosen], kind="stable")][:limit - n]
        number = np.full(len(exact), -1)
        number[chosen] = np.arange(len(chosen))
        rule = number[own]
        places, rule = places[rule >= 0], rule[rule >= 0]
        pairs = speaks[chosen]
        first = np.concatenate([[True], np.diff(places) > 1])  # of a run of overlapping occurrences every second one is taken
        if not first.all():
            starts = np.flatnonzero(first)
            taken = (np.arange(len(places)) - np.repeat(starts, np.diff(starts, append=len(places)))) % 2 == 0
            places, rule = places[taken], rule[taken]
        seq[places] = n + rule
        fresh = places - np.arange(len(places))  # where the new symbols are once their second halves are gone
        stay = np.ones(len(seq), bool)
        stay[places + 1] = False
        seq = seq[stay]
        left.append((pairs >> np.uint64(32)).astype(np.uint32))
        right.append((pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        rounds.append(len(chosen))
        n += len(chosen)
    none = np.empty(0, np.uint32)
    grammar = Grammar(base, np.concatenate(left) if left else none, np.concatenate(right) if right else none, np.array(rounds, np.uint32), seq, none)
    _, _, sizes = grammar.expansions()
    grammar.ends = np.searchsorted(np.cumsum(sizes[seq]), ends) + 1 if len(ends) else none
    return grammar


def pack_block(grammar: Grammar, ends: np.ndarray) -> bytes:
    """Bytes of a block: header, rules, length of every rule's expansion, symbols, and each document's end in symbols and in ids."""
    width = "<u2" if grammar.base + len(grammar.left) <= 1 << 16 else "<u4"
    _, _, sizes = grammar.expansions()
    head = _HEADER.pack(_MAGIC, grammar.base, len(grammar.left), len(grammar.rounds), len(grammar.symbols), len(ends), int(width[2]))
    parts = [grammar.rounds.astype("<u4"), grammar.left.astype(width), grammar.right.astype(width), sizes[grammar.base:].astype("<u4"),
             grammar.symbols.astype(width), grammar.ends.astype("<u4"), ends.astype("<u4")]
    return head + b"".join(p.tobytes() for p in parts)


class Block:
    """A block read back: whole documents, or any range of ids of one document without expanding the rest."""

    def __init__(self, raw: bytes):
        magic, base, n_rules, n_rounds, n_symbols, n_docs, width = _HEADER.unpack_from(raw)
        if magic != _MAGIC:
            raise ValueError("not a grammar block")
        at = _HEADER.size

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        symbol = f"<u{width}"
        rounds, left, right = part("<u4", n_rounds), part(symbol, n_rules), part(symbol, n_rules)
        self.rule_sizes = part("<u4", n_rules)
        symbols, ends = part(symbol, n_symbols), part("<u4", n_docs)
        self.ends = part("<u4", n_docs).astype(np.int64)
        self.grammar = Grammar(base, left, right, rounds, symbols, ends)

    def documents(self) -> np.ndarray:
        """The ids of all documents, which end at `ends`."""
        flat, starts, sizes = self.grammar.expansions()
        return gather(flat, starts, sizes, self.grammar.symbols)[0]

    def ids(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids `start` to `stop` of a document, found by the stored lengths; only the symbols that hold them are expanded."""
        g = self.grammar
        symbols = g.symbols[(g.ends[doc - 1] if doc else 0):g.ends[doc]].astype(np.int64)
        sizes = np.where(symbols < g.base, 1, self.rule_sizes[np.maximum(symbols - g.base, 0)] if len(self.rule_sizes) else 1)
        ends = np.cumsum(sizes)
        stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop)
        out, stack = [], symbols[first:last + 1][::-1].tolist()
        while stack:
            s = stack.pop()
            if s < g.base:
                out.append(s)
            else:
                stack += [int(g.right[s - g.base]), int(g.left[s - g.base])]
        skipped = start - int(ends[first] - sizes[first])
        return np.array(out[skipped:skipped + stop - start], np.uint32)


def write_grammar_files(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
                        block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every whole text, append `end_id`, and write the ids in ascending id order.

    A shard is a range of ids, a task; its documents are sorted and go to blocks in order, each compressed by a grammar of its own.
    A block is one row of the Parquet files in `folder`: shard, block, n_tokens, doc_ids, payload (the bytes of `pack_block`).
    NULL texts are empty: one id, the end. NULL ids come first. Rows that repeat an id follow each other, smaller text first. A text
    longer than a block is a block of its own. An empty table writes an empty one. Other columns are not read.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("payload", T.BinaryType())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, number = codec(path), TaskContext.get().partitionId(), 0
        base = words.library.get_vocab_size()
        held, ids, ends, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            whole, bounds = np.concatenate(ids), np.concatenate(ends)
            raw = pack_block(re_pair(whole, bounds, base, end_id), bounds)
            column = pa.chunked_array(held).combine_chunks()
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            docs_column = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(whole)], pa.int64()),
                                               docs_column, pa.array([raw], pa.binary())], names=schema.names)

        for batch in batches:
            texts, at, step = batch.column(1).to_pylist(), 0, 1_000
            while at < len(texts):
                got, bounds = words.encode_documents(texts[at:at + step], end_id)
                while len(bounds):
                    # as many documents as fit, one at least in an empty block
                    fit = int(np.searchsorted(bounds, block_tokens - size, "right"))
                    fit = max(fit, int(size == 0))
                    if fit:
                        cut = int(bounds[fit - 1])
                        held.append(batch.column(0).slice(at, fit))
                        ids.append(got[:cut])
                        ends.append(size + bounds[:fit])
                        size, at = size + cut, at + fit
                        got, bounds = got[cut:], bounds[fit:] - cut
                    if len(bounds):
                        yield block()
                        held, ids, ends, size, number = [], [], [], 0, number + 1
        if size:
            yield block()

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    write_table(rows.mapInArrow(blocks, schema), folder)


def read_grammar_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and on request its ids.

    Starts come from the blocks' lengths: summed within a shard, and over the shards' totals, of which there is one row a shard.
    """
    files = spark.read.parquet(folder)
    doc_type = files.schema["doc_ids"].dataType.elementType
    fields = [T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("doc_id", doc_type),
              T.StructField("within", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch.column(3)[row].as_py())
                raw = memoryview(block.documents().astype("<u4").tobytes())
                ends = block.ends
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(ends)
                columns = [pa.array(np.full(n, batch.column(0)[row].as_py()), pa.int32()), pa.array(np.full(n, batch.column(1)[row].as_py()), pa.int32()),
                           batch.column(2)[row].values, pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([bytes(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    docs = files.select("shard", "block", "doc_ids", "payload").mapInArrow(decode, schema)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    order = Window.partitionBy("shard").orderBy("block")
    blocks = files.select("shard", "block", (F.sum("n_tokens").over(order) - F.col("n_tokens")).alias("earlier")).join(shards, "shard")
    placed = docs.join(blocks, ["shard", "block"])
    return placed.select("doc_id", (F.col("before") + F.col("earlier") + F.col("within")).alias("start"), "n_tokens", "ids_crc32",
                         *["ids"] * with_ids)
