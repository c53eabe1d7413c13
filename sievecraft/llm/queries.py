"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm import bpe, conversations, fingerprint, html, line_dedup, lm, minhash, mixing, packing, phrases, quality, toxicity
from sievecraft.llm.common import table
from sievecraft.llm.dedup import DigestIndex


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labelled(spark: SparkSession, sf_dir: str, folds: int, held: int) -> DataFrame:
    """Labels that may be learnt from: crc32(doc_id as text) mod folds is not held."""
    return table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % folds != held)


def held_out(folds: int, held: int):
    return (F.crc32(F.col("doc_id").cast("string")) % folds == held).alias("held_out")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come to the index in two parts, those of larger ids first."""
    out = DigestIndex(spark).dedup(table(spark, sf_dir, "documents"), parts=2)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_recurring", "n_dropped", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = lm.score(docs, docs.where(F.crc32(F.col("doc_id").cast("string")) % 7 != 2))
    return out.select("doc_id", held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.classify(table(spark, sf_dir, "documents"), labelled(spark, sf_dir, 4, 2))
    return out.select("doc_id", held_out(4, 2), "score", "predicted")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), labelled(spark, sf_dir, 5, 0))
    return out.select("doc_id", held_out(5, 0), "score", "predicted")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_model": op4_language_model,
    "op5_packing": op5_packing,
    "op6_html": op6_html,
    "op7_fingerprint": op7_fingerprint,
    "op8_toxicity": op8_toxicity,
    "op9_minhash": op9_minhash,
    "op10_quality": op10_quality,
    "op11_mixing": op11_mixing,
    "op12_phrases": op12_phrases,
    "op13_conversations": op13_conversations,
}

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL: dict[str, str] = {
    "op9_minhash": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS sh FROM p),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
        r(doc_id, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.v)
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.v) AS component_id, r.doc_id = min(r.v) AS kept
        FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
    # Sources fill up in the order of most / w: the level is that of the first one that it does not fill.
    "op11_mixing": r"""
        WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5('11|' || doc_id), 1, 15))::BIGINT AS draw FROM documents),
        q AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
        r AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS most, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM q),
        o AS (SELECT *, row_number() OVER (ORDER BY most / w, source NULLS LAST) AS i FROM r),
        l AS (SELECT i, most / w AS fill, (1.5::DOUBLE * sum(source_size) OVER () - (sum(most) OVER (ORDER BY i) - most)) / (sum(w) OVER () - sum(w) OVER (ORDER BY i) + w) AS level FROM o),
        t AS (SELECT source, source_size, least(most, (SELECT arg_min(level, i) FROM l WHERE fill >= level) * w) AS target FROM o),
        d AS (SELECT s.*, t.source_size, t.target, floor(t.target + 0.5::DOUBLE)::BIGINT AS budget, sum(s.size) OVER (PARTITION BY s.source ORDER BY draw, doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before
          FROM s JOIN t ON t.source IS NOT DISTINCT FROM s.source)
        SELECT doc_id, size, source_size, target, (CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - before)) END)::BIGINT AS taken FROM d""",
    "op12_phrases": rf"""
        WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM
          (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
        n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) x(k) WHERE len(w) >= k),
        f AS (SELECT lang, k, w[i : i + k - 1] AS w, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
        inside AS (SELECT lang, w[i : i + m - 1] AS w, max(f) AS f FROM (SELECT lang, w, f, m, unnest(range(1, k - m + 2)) AS i FROM f, range(2, 5) x(m) WHERE m < k) GROUP BY ALL),
        c AS (SELECT f.* FROM f LEFT JOIN inside o ON o.lang = f.lang AND o.w = f.w WHERE k > 1 AND NOT coalesce(100 * o.f >= 100 * f.f, false)),
        s AS (SELECT c.lang, c.w, c.f AS a, x.f AS l, y.f AS r, n.n, j, ((1000::HUGEINT * c.f * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
          FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f x ON x.lang = c.lang AND x.w = c.w[: j] JOIN f y ON y.lang = c.lang AND y.w = c.w[j + 1 :] JOIN n ON n.lang = c.lang),
        b AS (SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, n, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, j) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000""",
    # Costs from the last row back (states: nothing, s, u, a), then the least letter that keeps to them from the first row on.
    "op13_conversations": r"""
        WITH RECURSIVE x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        k AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda y: ord(y)::BIGINT)),
          lambda v, y: list_reduce(list_prepend(xor(v, y), range(8)), lambda z, i: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END)), 4294967295) % 20 AS d FROM x),
        e AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM
          (SELECT *, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) FROM k WHERE d <> 0)),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, right(rtrim(text, e' \t\n\x0B\f\r'), 1) AS z FROM e),
        f AS (SELECT conv_id, turn, i, role, text, left(role, 1) AS c, CASE WHEN z = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN z NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
          left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM o),
        m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
          count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS m FROM f GROUP BY conv_id),
        r AS (SELECT conv_id, i, role, text, c, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS more FROM f),
        b(conv_id, i, v) AS (SELECT conv_id, m + 1, [0, 6, 3, 0] FROM m UNION ALL
          SELECT conv_id, i, [least(v[1], 3 + v[3], 6 + v[4]), least(v[2], 3 + v[3], 6 + v[4]), least(v[3], 3 + v[4]), least(v[4], 3 + v[3])] FROM
          (SELECT r.conv_id, r.i, [least(4 + v[1], CASE WHEN gone THEN 99999999 WHEN c = 's' THEN least(more + v[2], more + 3 + v[3]) WHEN c = 'u' THEN more + v[3] ELSE more + 3 + v[3] END),
            least(4 + v[2], CASE WHEN gone THEN 99999999 WHEN c = 'u' THEN more + v[3] ELSE more + 3 + v[3] END), least(4 + v[3], CASE WHEN gone THEN 99999999 WHEN c = 'a' THEN more + v[4] ELSE more + 3 + v[4] END),
            least(4 + v[4], CASE WHEN gone THEN 99999999 WHEN c = 'u' THEN more + v[3] ELSE more + 3 + v[3] END)] AS v FROM b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1)),
        t(conv_id, i, s, audit, said) AS (SELECT conv_id, 1::BIGINT, 1, '', []::VARCHAR[] FROM m UNION ALL
          SELECT conv_id, CASE WHEN l = 'I' THEN i ELSE i + 1 END, CASE WHEN l = 'D' THEN s WHEN l = 'K' AND c = 's' THEN 2 WHEN s = 3 THEN 4 ELSE 3 END, audit || l,
            CASE l WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text) ELSE list_append(said, CASE WHEN s = 3 THEN 'assistant:' ELSE 'user:' END || CASE l WHEN 'R' THEN text ELSE '' END) END FROM
          (SELECT t.*, r.role, r.text, r.c, CASE WHEN 4 + n.v[s] = b.v[s] THEN 'D' WHEN 3 + b.v[CASE s WHEN 3 THEN 4 ELSE 3 END] = b.v[s] THEN 'I'
            WHEN NOT gone AND more + CASE WHEN c = 's' AND s = 1 THEN n.v[2] WHEN c = 'u' AND s <> 3 THEN n.v[3] WHEN c = 'a' AND s = 3 THEN n.v[4] END = b.v[s] THEN 'K' ELSE 'R' END AS l
            FROM t JOIN b ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND b.i = t.i LEFT JOIN b n ON n.conv_id IS NOT DISTINCT FROM t.conv_id AND n.i = t.i + 1 LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.i
            WHERE r.i IS NOT NULL OR b.v[s] > 0)),
        z AS (SELECT conv_id, arg_max(audit, len(audit)) AS audit, arg_max(said, len(audit)) AS said FROM t GROUP BY conv_id)
        SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
          coalesce(b.v[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = 1""",
}
