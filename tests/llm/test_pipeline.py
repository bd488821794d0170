import re
import zlib
from collections import Counter

import corpus_pipeline as pipeline
import numpy as np

from tests.llm.test_set_join import shingles
from tests.llm.test_tokens import direct
from visitlake.llm.store import materialise

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, stage in pipeline.STAGES:
        tables.append(materialise(stage(spark, tables[-1], SF), name))
    raw, clear, distinct, apart, mixed, packed = (t.collect() for t in tables)
    assert all(t.columns == docs.columns for t in tables[:-1])
    assert len(clear) >= 0.97 * len(raw) and {r.doc_id for r in clear} <= {r.doc_id for r in raw}
    smallest = {}
    for r in sorted(clear, key=lambda r: r.doc_id):
        smallest.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert sorted(r.doc_id for r in distinct) == sorted(smallest.values())
    sets = {r.doc_id: shingles(r.text, 5) for r in distinct}
    near = {(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    kept = {r.doc_id for r in apart}
    assert not {p for p in near if p[0] in kept and p[1] in kept}
    assert all(i in kept for i in sets if not any(i in p for p in near))
    times = Counter(r.doc_id for r in mixed)
    assert set(times) <= kept and max(times.values()) <= 4 and len(times) > 0.3 * len(kept)
    text = {r.doc_id: r.text for r in mixed}
    tokens = {i: direct(t) + [1] for i, t in text.items()}
    room = Counter()
    for r in packed:
        ids = tokens[r.doc_id][r.start:r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 4096
    assert sum(room.values()) == sum(len(tokens[i]) * n for i, n in times.items())


def test_odd_rows_go_through(spark, odd_docs, no_docs, clashing):
    for docs in (clashing, no_docs):
        columns, stages = docs.columns, pipeline.STAGES
        for name, stage in stages:
            docs = materialise(stage(spark, docs, SF), name)
            assert name == stages[-1][0] or docs.columns == columns
        docs.count()
