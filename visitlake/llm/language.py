"""Language of whole texts by compression: the language whose dictionary makes a text smallest."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bounds of the labelled sample: distinct texts asked of each language, bytes of its dictionary, and bytes of all dictionaries, which
#: many languages share evenly
SAMPLE_ROWS, DICTIONARY_BYTES, TOTAL_BYTES = 400, 96 * 1024, 48 * 1024 * 1024
#: a text is compressed in pieces of this many bytes, each against the dictionary alone, so long texts are not their own dictionary
PIECE_BYTES = 2_048
LEVEL = 7
#: a narrow result is decided by a second coder that also finds matches of three bytes, which short texts need
FINE_LEVEL, FINE_MATCH = 3, 3
#: texts shorter than this are repeated for that coder, which else would store them as they are
SHORT_BYTES = 128
#: a document is rejected when the runner-up's size is within this share of the smallest
MIN_MARGIN = 0.005
UNKNOWN = "und"


def fit_dictionaries(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS,
                     size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Raw-content dictionaries by language, from a bounded sample of each language's distinct texts, drawn by their hashes.

    About `sample_rows` distinct texts of each language are drawn, at least nearly all that a small language has, however many copies
    they have. Each gives a piece of up to 2 * `size` / `sample_rows` characters (256 at least) from a place that its hash names, so texts that begin alike
    give different pieces; the pieces share the `size` bytes. With many languages each gets less, so that all dictionaries together
    keep to `TOTAL_BYTES` (256 bytes each at least). Rows with NULL text or language are not used.
    """
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("text is not null and lang is not null")
    # a row for each language; the counts only set how many texts are drawn
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n"))
    languages = counts.count()
    if not languages:
        return {}
    size = max(256, min(size, TOTAL_BYTES // languages))
    piece = max(256, 2 * size // sample_rows)
    asked = max(8, min(sample_rows, 2 * size // piece))
    share = counts.select("lang", F.least(F.lit(1.0), F.lit(float(asked)) / F.greatest("n", F.lit(1))).alias("share"))
    chance = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000
    start = 1 + F.pmod(F.xxhash64(F.lit(1), "text"), F.greatest(F.lit(1), F.char_length("text") - piece + 1))
    sample = rows.join(F.broadcast(share), "lang").where(chance < F.col("share")).select("lang", chance.alias("chance"), F.substr("text", start.cast("int"), F.lit(piece)).alias("text"))
    held: dict[str, list[tuple[float, str]]] = {row["lang"]: [] for row in counts.select("lang").collect()}
    for row in sample.distinct().collect():
        held[row["lang"]].append((row["chance"], row["text"]))
    return {lang: "\n".join(t for _, t in sorted(texts)).lower().encode()[:size] for lang, texts in sorted(held.items())}


def language_columns(text: Column, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> Column:
    """A struct lang_pred, score, accepted.

    The whole text, lower-cased, is compressed against every dictionary and the smallest total wins, the first in alphabetical order among equals.
    The score is the margin: how much larger the runner-up is, as a share of it. Where it is below `min_margin`, the sizes under a second
    coder are added, which also finds matches of three bytes; texts below `SHORT_BYTES`, which it would store as they are, are repeated
    eight times for it. What is still below `min_margin` is rejected.
    """
    names = sorted(dictionaries)
    shared = [dictionaries[n] for n in names]

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        def coders(level: int, **own: int) -> list[Callable[[bytes], bytes]]:
            out = []
            for content in shared:
                how = zstandard.ZstdCompressionParameters.from_level(level, source_size=PIECE_BYTES, dict_size=len(content),
                                                                     write_content_size=False, write_dict_id=False, **own)
                data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                data.precompute_compress(compression_params=how)
                out.append(zstandard.ZstdCompressor(dict_data=data, compression_params=how).compress)
            return out

        def judge(sizes: list[int]) -> tuple[str, float]:
            best = min(range(len(sizes)), key=sizes.__getitem__)
            if len(sizes) == 1:
                return names[0], 1.0
            second = min(s for k, s in enumerate(sizes) if k != best)
            return names[best], (second - sizes[best]) / second

        usual, fine = coders(LEVEL), coders(FINE_LEVEL, min_match=FINE_MATCH)

        def one(text: str) -> tuple[str, float]:
            raw = text.lower().encode("utf-8", "surrogatepass")
            pieces = [raw[i:i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
            sizes = [sum(len(code(p)) for p in pieces) for code in usual]
            found = judge(sizes)
            if found[1] < min_margin:
                if len(raw) < SHORT_BYTES:
                    pieces = [(b" " + raw) * 8]
                found = judge([a + sum(len(code(p)) for p in pieces) for a, code in zip(sizes, fine)])
            return found

        for texts in batches:
            got = [one(t) if isinstance(t, str) else (UNKNOWN, 0.0) for t in texts]
            yield pd.DataFrame({"lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "accepted": [g[1] >= min_margin for g in got]})

    # a text without letters is never compressed; a filter on the answer must not make Spark ask twice
    return classify.asNondeterministic()(F.when(text.rlike(r"\p{L}"), text))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """`docs` with lang_pred, score and accepted.

    NULL and empty texts and texts without a letter get `und`, score 0, and are rejected; so does every text when no language was
    learned. Long texts are read whole. Repeated rows get equal answers. Columns of these names are replaced.
    """
    text = F.col(f"`{text_col}`")
    if not dictionaries:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "accepted": F.lit(False)})
    rows = docs.withColumn("__language", language_columns(text, dictionaries, min_margin))
    return rows.withColumns({c: F.col(f"__language.{c}") for c in ("lang_pred", "score", "accepted")}).drop("__language")
