"""The registered queries of this subpackage, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .conversation_trie import encode, prefix_trie, rebuilt
from .divergence import audit
from .embed_dedup import near_vectors
from .exact_dedup import exact_classes
from .html_extract import extract
from .mixing import mix
from .ngram_lm import score_texts as lm_score_texts
from .packing import pack
from .simhash import near_components
from .substring_dedup import remove_repeats
from .token_files import read_token_files, write_token_files
from .tokens import default_vocabulary
from .toxicity import fit, sample, score_texts
from .url_filter import Rule, judge, labelled_urls
from .url_filter import fit as fit_urls

#: Target shares of the mixture; a source not named has one.
SHARES = {"src0": 8, "src1": 4, "src2": 2}
BLOCK_ROWS = 64
#: Verdicts that go before the learned one.
URL_RULES = [Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the identifier's text, mod n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), words=4, radius=4)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_vocabulary(), end_id=2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(*sample(docs, table(spark, sf_dir, "labels"), may_learn=lambda i: id_bucket(i, 5) != 0))
    out = score_texts(docs, model)
    return out.select("doc_id", (F.coalesce(id_bucket(F.col("doc_id"), 5), F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(table(spark, sf_dir, "documents"), keep="max")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score_texts(table(spark, sf_dir, "documents"), id_bucket(F.col("doc_id"), 7) == 2)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), default_vocabulary(), end_id=1))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), SHARES, block_rows=BLOCK_ROWS)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), window=35).drop("kept_text")


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), fit_urls(labelled_urls(spark)), URL_RULES)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), min_docs=10, top=10)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return prefix_trie(rebuilt(encode(table(spark, sf_dir, "conversations")), head=id_bucket(conv, 9), base=conv - conv % 5))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_token_files": op7_token_files,
    "op8_mixing": op8_mixing,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_url_filters": op11_url_filters,
    "op12_source_divergence": op12_source_divergence,
    "op13_conversation_trie": op13_conversation_trie,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256, {_LOWER} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, text_sha256
        FROM d""",
    "op8_mixing": f"""
        WITH RECURSIVE s AS (
          SELECT source, CAST(CASE source WHEN 'src0' THEN {SHARES["src0"]} WHEN 'src1' THEN {SHARES["src1"]} WHEN 'src2' THEN {SHARES["src2"]} ELSE 1 END AS BIGINT) AS a
          FROM (SELECT DISTINCT source FROM documents)),
        w AS (SELECT CAST(sum(a) AS BIGINT) AS w FROM s),
        jobs AS (
          SELECT source, a, CAST(j AS BIGINT) AS j, w, (j * w) // a AS r, ((j + 1) * w + a - 1) // a AS d,
                 row_number() OVER (ORDER BY ((j + 1) * w + a - 1) // a, source, j) AS prio
          FROM s, w, unnest(range(a)) AS u(j)),
        run(slot, chosen, done) AS (
          SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[])
          UNION ALL
          SELECT run.slot + 1, p.prio, list_append(run.done, p.prio)
          FROM run, LATERAL (SELECT min(prio) AS prio FROM jobs WHERE r <= run.slot + 1 AND NOT list_contains(run.done, prio)) p
          WHERE run.slot + 1 < (SELECT w FROM w)),
        plan AS (SELECT jobs.*, run.slot FROM run JOIN jobs ON jobs.prio = run.chosen),
        n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents),
        b AS (SELECT n.*, k // {BLOCK_ROWS} AS block, s.a FROM n JOIN s USING (source))
        SELECT b.doc_id, b.source, k AS source_rank, block, (block // b.a) * w + r AS release_slot, (block // b.a) * w + d AS deadline_slot,
               (block // b.a) * w + slot AS slot, k % {BLOCK_ROWS} AS place_in_block
        FROM b JOIN plan ON plan.source = b.source AND plan.j = block % b.a""",
    "op12_source_divergence": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS i FROM documents),
        t AS (SELECT lang, source, i, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{80}-\x{10FFFF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
        kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 10),
        c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
        n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (SELECT g.lang, g.source, kept.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 2)) // (n + 2 * v)::HUGEINT AS p
              FROM g JOIN kept USING (lang) JOIN n USING (lang, source) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
        q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (tc + 2)) // (ln + 2 * v)::HUGEINT AS q
              FROM (SELECT lang, term, sum(c)::HUGEINT AS tc FROM c GROUP BY ALL) JOIN (SELECT lang, sum(n)::HUGEINT AS ln FROM n GROUP BY 1) USING (lang) JOIN v USING (lang)),
        f AS (SELECT a.lang, a.source, b.source AS item, ((a.p - b.p) * (a.p - b.p)) // (a.p + b.p) AS f FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source),
        pair AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce((SELECT sum(f) FROM f WHERE f.lang = a.lang AND f.source = a.source AND f.item = b.source), 0) AS BIGINT) AS value
                 FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source),
        term AS (SELECT p.lang, p.source, p.term AS item, CAST(((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q),
        r AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r) WHERE part = 'pair' OR rank <= 10""",
    "op13_conversation_trie": """
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
                   FROM conversations WHERE conv_id IS NOT NULL),
        i AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM t),
        h AS (SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0] for x in string_split(s, '')])),
                lambda a, b: xor(xor(a, b) >> 1, 3988292384::BIGINT * (xor(a, b) & 1))), 4294967295::BIGINT) % 9 AS h FROM i),
        r AS (SELECT c, 0 AS part, pos, role, text FROM h JOIN t ON t.conv_id = base WHERE pos < h UNION ALL SELECT c, 1, pos, role, text FROM h JOIN t ON t.conv_id = c WHERE pos >= h),
        s AS (SELECT c, coalesce(list(struct_pack(role, text) ORDER BY part, pos) FILTER (part IS NOT NULL), []) AS seq FROM h LEFT JOIN r USING (c) GROUP BY c),
        p AS (SELECT c, seq, d, seq[1:d] AS path FROM s, unnest(range(len(seq) + 1)) AS u(d)),
        n AS (SELECT path, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(seq) = d), '')) AS ends_sha256 FROM p GROUP BY path),
        k AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.path[1:n.depth] = n.path) AS n_children,
                     CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(path[depth].text) END AS own FROM n),
        b AS (SELECT path[1:a] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved FROM k, unnest(range(depth + 1)) AS u(a) GROUP BY ALL)
        SELECT k.conv_id, k.depth, up.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, k.ends_sha256
        FROM k JOIN b USING (path) LEFT JOIN n up ON k.depth > 0 AND up.path = k.path[1:k.depth - 1] AND up.depth = k.depth - 1""",
}
