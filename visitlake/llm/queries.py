"""The registered queries of the operators and their SQL."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlake.llm import (chat, exact_dedup, grammar_files, language, mixing, orchard, packing, prefix_trie, pseudonyms, set_join, toxicity, url_cascade,
                           vector_dedup)
from visitlake.llm.store import materialise, new_folder
from visitlake.llm.tokens import vocabulary_path
from visitlake.plans.catalog import query


#: a deployment passes its own secret; this one makes the registered query repeatable
PSEUDONYM_SECRET = "visitlake-check"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: sources of each domain; all others are `books`
DOMAINS = {"web": ["src0"], "reference": ["src1", "src2", "src3", "src4", "src5", "src6"],
           "forum": ["src7", "src8", "src9", "src10", "src11", "src12"]}
MIX_WEIGHTS = {("web",): 4, ("reference",): 3, ("forum",): 2, ("books",): 2, ("*", "en"): 5, ("*", "de"): 2, ("*", "fr"): 2, ("*", "es"): 1,
               ("web", "en"): 6}
MIX_EPOCHS, MIX_SEED = 4, "mix-1"


def domain(source: Column) -> Column:
    out = F.lit("books")
    for name, sources in DOMAINS.items():
        out = F.when(source.isin(sources), F.lit(name)).otherwise(out)
    return out


def mix_levels() -> dict[str, Column]:
    return {"domain": domain(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def _fill_sql(depth: int) -> str:
    """One level of water filling for the SQL of the mixture."""
    path = ["l0", "l1", "l2"][:depth]
    parents = path[:-1]
    weight = {1: "CASE l0 WHEN 'web' THEN 4 WHEN 'reference' THEN 3 WHEN 'forum' THEN 2 WHEN 'books' THEN 2 ELSE 1 END",
              2: "CASE WHEN l0 = 'web' AND l1 = 'en' THEN 6 ELSE CASE l1 WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 1 ELSE 1 END END",
              3: "1"}[depth]
    above = "(SELECT least(sum(supply * 4), sum(supply))::BIGINT AS budget FROM leaves)" if depth == 1 else f"share{depth - 1}"
    join = "CROSS JOIN" if depth == 1 else "JOIN"
    using = f"USING ({', '.join(parents)})" if parents else ""
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    return f"""
n{depth} AS (SELECT {', '.join(path)}, sum(supply * 4)::BIGINT AS cap, ({weight})::BIGINT AS weight FROM leaves GROUP BY ALL),
a{depth} AS (SELECT *, (sum(cap) OVER o)::BIGINT - cap AS before, (sum(weight) OVER ({part}))::BIGINT - (sum(weight) OVER o)::BIGINT + weight AS rest
       FROM n{depth} {join} {above} {using}
       WINDOW o AS ({part} ORDER BY cap / weight, {path[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f{depth} AS (SELECT *, cap / weight <= (budget - before) / rest AS full_ FROM a{depth}),
s{depth} AS (SELECT *, (sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ({part}))::BIGINT AS taken,
             (sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER ({part}))::BIGINT AS free FROM f{depth}),
share{depth} AS (SELECT {', '.join(path)}, CASE WHEN full_ THEN cap ELSE ((budget - taken) * weight) // nullif(free, 0) END::BIGINT AS budget FROM s{depth}),"""


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, CASE WHEN source = 'src0' THEN 'web'
      WHEN source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6') THEN 'reference'
      WHEN source IN ('src7', 'src8', 'src9', 'src10', 'src11', 'src12') THEN 'forum' ELSE 'books' END AS domain,
    coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::BIGINT AS tokens FROM documents),
leaf AS (SELECT *, domain AS l0, coalesce(lang, '') AS l1, coalesce(source, '') AS l2 FROM d),
leaves AS (SELECT l0, l1, l2, sum(tokens)::BIGINT AS supply FROM leaf GROUP BY ALL),""" + "".join(_fill_sql(k) for k in (1, 2, 3)) + """
plan AS (SELECT l0, l1, l2, budget // supply AS epochs, budget % supply AS rest FROM share3 JOIN leaves USING (l0, l1, l2) WHERE supply > 0),
h AS (SELECT doc_id, domain, lang, source, tokens, l0, l1, l2, epochs, rest,
        md5('mix-1|' || epochs || '|' || doc_id) AS place FROM leaf JOIN plan USING (l0, l1, l2)),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY l0, l1, l2 ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM h),
t AS (SELECT *, epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM c)
SELECT doc_id, domain, lang, source, tokens, unnest(range(0, times))::INTEGER AS epoch FROM t WHERE times > 0"""


@query("op1_mixing", MIX_SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", domain(F.col("source")).alias("domain"), "lang", "source", mixing.word_count(F.col("text")).alias("tokens"))
    counted = materialise(docs, "counted")
    levels = {c: F.col(c) for c in ("domain", "lang", "source")}
    return mixing.mix(counted, levels, MIX_WEIGHTS, F.col("tokens"), max_epochs=MIX_EPOCHS, seed=MIX_SEED)


CONTROL_TURN = "</s>[INST] ok [/INST]"


@query("op2_chat")
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one made of control strings, formatted and read back from the formatted text and its loss mask."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TURN), (-1, 1, "assistant", CONTROL_TURN)], turns.schema)
    # a turn is one whole message; rows that repeat a turn are messages of their own
    key = F.concat_ws(" ", F.col("turn").cast("string"), F.monotonically_increasing_id().cast("string"))
    events = turns.unionByName(extra).select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), key.alias("msg"), "role", "text")
    formatted = chat.format_conversations(events)

    def read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for formatted_, loss in zip(frame["formatted"], frame["loss"]):
                read, learned = chat.parse(formatted_), chat.learned_text(formatted_, [(s["start"], s["end"]) for s in loss])
                whole = hashlib.sha256()
                for role, text in read:
                    whole.update(f"{role}\n{text}\n".encode())
                out.append((len(read), whole.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted_)))
            read = pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield pd.concat([frame[["conv_id"]].reset_index(drop=True), read], axis=1)

    # ids travel as text: pandas would turn whole numbers beside a NULL into doubles
    read = formatted.select(F.col("conv_id").cast("string"), "formatted", "loss").mapInPandas(
        read_back, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return read.withColumn("conv_id", F.col("conv_id").cast("long"))


@query("op3_pseudonyms")
def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text pseudonymised, how many values were replaced, and what they are now."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonyms.pseudonymise(docs, PSEUDONYM_SECRET)
    shown = F.transform("pii", lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["pseudonym"]))
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_replaced"), F.array_join(shown, " | ").alias("pseudonyms"))


@query("op4_grammar_files")
def op4_grammar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "grammar")
    grammar_files.write_grammar_files(table(spark, sf_dir, "documents"), folder, vocabulary_path())
    return grammar_files.read_grammar_files(spark, folder)


@query("op5_exact_dedup", r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(table(spark, sf_dir, "documents"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = language.fit_dictionaries(docs.where(~held_out()).select("text", "lang"))
    found = language.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), dictionaries)
    return found.select("doc_id", "held_out", "lang_pred", "score", "accepted")


@query("op7_small_world")
def op7_small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
             ("block", "com", "/de/")]


@query("op9_url_cascade", r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, h, pre) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                              ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (
  SELECT p.page_id, p.host, p.path, h || pre AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(h || pre) DESC NULLS LAST) AS place
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE place = 1""")
def op9_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_cascade.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op10_set_join")
def op10_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.similar_documents(table(spark, sf_dir, "documents"), width=4, percent=85)


@query("op11_toxicity")
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = toxicity.labelled_texts(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, toxicity.fit(labelled))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


TRIE_SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS token,
         octet_length(encode(coalesce(text, ''))) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
            lambda ch: list_prepend(ascii(ch)::BIGINT, [256::BIGINT, 256, 256, 256, 256, 256, 256, 256])))),
            lambda crc, b: CASE WHEN b < 256 THEN xor(crc, b) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END)) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
there AS (SELECT conv_id AS base, max(pos) AS n FROM turns GROUP BY 1),
rebuilt AS (
  SELECT i.conv_id, t.pos, t.token, t.bytes FROM ids i JOIN turns t ON t.conv_id = i.base AND t.pos <= i.h
  UNION ALL
  SELECT i.conv_id, t.pos - i.h + least(i.h, coalesce(n, 0)), t.token, t.bytes
  FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.pos > i.h LEFT JOIN there ON there.base = i.base),
steps AS MATERIALIZED (
  SELECT conv_id, 0 AS depth, '' AS path, NULL AS up, 0 AS bytes FROM ids
  UNION ALL
  SELECT conv_id, pos, string_agg(token, '') OVER w, coalesce(string_agg(token, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), bytes
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
nodes AS MATERIALIZED (SELECT depth, path, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM steps GROUP BY 1, 2),
kids AS MATERIALIZED (SELECT up AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT a.path, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
  FROM nodes n JOIN steps a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN kids k ON k.path = n.path GROUP BY 1),
ends AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(path, depth) AS path FROM steps GROUP BY 1) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves, b.saved::BIGINT AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN below b USING (path) LEFT JOIN kids k USING (path) LEFT JOIN ends e USING (path)
LEFT JOIN nodes p ON p.path = n.up AND n.depth > 0"""


@query("op12_prefix_trie", TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def _orchard_sql(rounds: int) -> str:
    far = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (SELECT v.id, min((({far}), c.cluster)) AS best FROM v CROSS JOIN c{r} c GROUP BY 1)""")
        if r < rounds:
            parts.append(f"""
m{r} AS (SELECT best[2] AS cluster, dim, sum(x)::BIGINT AS s, count(*) AS n
       FROM (SELECT best, unnest(v.q) AS x, generate_subscripts(v.q, 1) AS dim FROM a{r} JOIN v USING (id)) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(any_value(f.q), any_value(c.q)) AS q FROM c{r} c LEFT JOIN
       (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY dim) AS q FROM m{r} GROUP BY 1) f USING (cluster) GROUP BY 1)""")
    last = rounds
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS cluster, q FROM v QUALIFY cluster < 8),{','.join(parts)}
SELECT v.vec_id, best[2]::INTEGER AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia,
       (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{last} JOIN v USING (id) JOIN c{last} c ON c.cluster = best[2]"""


@query("op13_orchard", _orchard_sql(10))
def op13_orchard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.cluster(table(spark, sf_dir, "embeddings"))
