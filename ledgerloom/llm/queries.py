"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, exact_dedup, importance, jpeg, lexical, lm, merkle, minmax, packing, secrets, substring, tokenfile, toxicity
from ledgerloom.llm.common import read_table, release_staged, stage  # noqa: F401


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.find_components(read_table(spark, sf_dir, "documents"), size=3, percent=85)


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_passages(read_table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.select_texts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(read_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: F.expr(f"size(filter(base, s -> s.kind = '{kind}'))").cast("long").alias(f"n_{kind}")
    return secrets.find_secrets(read_table(spark, sf_dir, "documents")).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.listed("base"), 256).alias("base_sha256"),
        secrets.listed("sort_array(concat(base, added))").alias("spans"))


def op10_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_columns(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature", "width", "height")


def _fold_case(doc_id: bytes | None, row: tuple) -> tuple:
    """The tampering of op11: where 3 divides the id's crc32, A-Z of the text go to lower case."""
    if doc_id is None or zlib.crc32(doc_id) % 3 or row[-1] is None:
        return row
    return *row[:-1], row[-1].lower()  # bytes: only A-Z change


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle.build_manifest(read_table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], change=_fold_case)
    return made.select(
        F.col("item").cast("long").alias("doc_id"), "leaf", "subroot", "root", F.expr("sha2(array_join(transform(proof, s -> concat(s.before, s.after)), ''), 256)").alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    corpus = lexical.measure(docs)
    index = stage(lexical.build_index(docs, corpus), "index")
    return lexical.search(index, corpus, read_table(spark, sf_dir, "benchmark"))


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read_tokens(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_bpe": op2_bpe,
    "op3_minmax": op3_minmax,
    "op4_substring": op4_substring,
    "op5_packing": op5_packing,
    "op6_importance": op6_importance,
    "op7_toxicity": op7_toxicity,
    "op8_lm": op8_lm,
    "op9_secrets": op9_secrets,
    "op10_jpeg": op10_jpeg,
    "op11_merkle": op11_merkle,
    "op12_lexical": op12_lexical,
    "op13_tokens": op13_tokens,
}

SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g')) AS h FROM documents),
        g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g""",
    "op3_minmax": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
        FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, s.s""",
    "op4_substring": r"""
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        v AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM w WHERE len(w) >= 50),
        k AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS h FROM v),
        m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS low FROM k),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM m WHERE doc_id > low),
        g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
        x AS (SELECT w.doc_id, unnest(w.w) AS word, unnest(range(1, len(w.w) + 1)) AS p FROM w JOIN g USING (doc_id)),
        t AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p WHERE c.p IS NULL GROUP BY x.doc_id)
        SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(g.gone), 0)::BIGINT AS n_removed,
            sha256(CASE WHEN g.doc_id IS NULL THEN array_to_string(w.w, ' ') ELSE coalesce(t.kept, '') END) AS kept_sha256
        FROM w LEFT JOIN g USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_merkle": r"""
        WITH RECURSIVE t AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
            list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
                lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, u: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS c FROM documents),
        h AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, text, low, coalesce(xor(c, 4294967295) % 3 = 0, false) AS hit,
            coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM t),
        l AS (SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
            CASE WHEN hit THEN sha256(head || coalesce(strlen(text) || ':' || low, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS seen FROM h),
        p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, leaf) - 1 AS j FROM l),
        n(g, v, i, h, c) AS (SELECT g, 0, j, leaf, count(*) OVER (PARTITION BY g) FROM p
            UNION ALL SELECT g, v + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (max(c) + 7) // 8 FROM n WHERE c > 1 GROUP BY g, v, i // 8),
        r AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS k FROM n WHERE c = 1),
        m(v, i, h, c) AS (SELECT 0, k, subroot, count(*) OVER () FROM r
            UNION ALL SELECT v + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (max(c) + 7) // 8 FROM m WHERE c > 1 GROUP BY v, i // 8),
        s AS (SELECT g, v, i, coalesce(string_agg(h, '') OVER (PARTITION BY g, v, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
            coalesce(string_agg(h, '') OVER (PARTITION BY g, v, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM n WHERE c > 1),
        z AS (SELECT v, i, coalesce(string_agg(h, '') OVER (PARTITION BY v, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
            coalesce(string_agg(h, '') OVER (PARTITION BY v, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM m WHERE c > 1),
        e AS (SELECT p.g, p.j, s.v, s.b, s.a FROM p JOIN s ON s.g = p.g AND s.i = p.j // (8 ** s.v)::BIGINT
            UNION ALL SELECT p.g, p.j, 100 + z.v, z.b, z.a FROM p JOIN r ON r.g = p.g JOIN z ON z.i = r.k // (8 ** z.v)::BIGINT),
        q AS (SELECT g, j, row_number() OVER (PARTITION BY g, j ORDER BY v) AS v, b, a FROM e),
        f(g, j, v, h) AS (SELECT g, j, 0, seen FROM p UNION ALL SELECT f.g, f.j, f.v + 1, sha256(q.b || f.h || q.a) FROM f JOIN q ON q.g = f.g AND q.j = f.j AND q.v = f.v + 1),
        o AS (SELECT g, j, arg_max(h, v) AS folded FROM f GROUP BY g, j),
        y AS (SELECT g, j, string_agg(b || a, '' ORDER BY v) AS proof FROM q GROUP BY g, j)
        SELECT doc_id, leaf, subroot, (SELECT h FROM m WHERE c = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM m WHERE c = 1) AS verified
        FROM p JOIN r USING (g) JOIN o USING (g, j) LEFT JOIN y USING (g, j)""",
    "op12_lexical": r"""
        WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS t FROM documents),
        c AS (SELECT count(*)::BIGINT AS big_n, sum(len(t))::BIGINT AS big_l FROM d WHERE len(t) > 0),
        p AS (SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, 75 + (25 * len(t) * big_n) // big_l AS m, unnest(t) AS term FROM d, c WHERE len(t) > 0) GROUP BY doc_id, m, term),
        w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, big_n),
        q AS (SELECT item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM benchmark),
        s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) GROUP BY item_id, doc_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20""",
}
