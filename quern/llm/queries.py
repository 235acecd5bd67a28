"""Queries of this package, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib
    import zlib

    from .media import feature, read_media, store_media
    from .scratch import Scratch

    stored = Scratch(spark, "op5").table(store_media(_table(spark, sf_dir, "documents")), "media")

    def told(file: bytes, samples) -> tuple:
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature(samples)

    return read_media(stored, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", told)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=80, words=2)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .langid import bucket
    from .toxicity import score, train

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    channel, scorer = train(docs, labels, allowed=bucket("doc_id", 5) != 0)
    held_out = F.coalesce(bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return score(docs.select("doc_id", "text"), channel, scorer).select("doc_id", held_out, "score", "predicted")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .substrings import remove_repeats

    done = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, capacity=2048)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import zlib

    import public_tokenizers

    from .scratch import Scratch
    from .token_store import read_token_files, write_token_files

    path = Scratch(spark, "op4").path("ids")
    write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, path, "ids_crc32 long", lambda ids: (zlib.crc32(ids),))


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    from pyspark.sql import functions as F

    from .decontam import find_leaks

    found = find_leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive, read_warc

    _, files = archive(spark, _table(spark, sf_dir, "pages"))
    return read_warc(spark, files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .langid import bucket, identify, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs, allowed=bucket("doc_id", 4) != 2)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scratch import Scratch
    from .trie import coded, ordered, prefix_trie, share_leads

    scratch = Scratch(spark, "op11")
    rows, sizes = ordered(coded(_table(spark, sf_dir, "conversations")), scratch)
    return prefix_trie(*share_leads(rows, sizes, scratch), scratch)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damage, repair
    from .scratch import Scratch

    conversations = _table(spark, sf_dir, "conversations")
    return repair(damage(conversations), conversations, Scratch(spark, "op12"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scratch import Scratch
    from .secrets import find_secrets

    return find_secrets(_table(spark, sf_dir, "documents"), Scratch(spark, "op13"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_repeats, op3_packing, op4_token_files, op5_media, op6_near_duplicates, op7_token_counts, op8_leaks, op9_warc, op10_language, op11_prefix_trie, op12_repair, op13_secrets)}
ORACLES: dict[str, str] = {
    "op2_repeats": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, p, md5(array_to_string(ws[p:p+34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM w)),
        rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
        cov AS (SELECT DISTINCT doc_id, p + k AS i FROM (SELECT doc_id, p FROM win SEMI JOIN rep USING (h)), range(35) AS r(k)),
        one AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM one ANTI JOIN cov USING (doc_id, i) GROUP BY doc_id)
        SELECT w.doc_id, len(w.ws) AS n_words, len(w.ws) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id""",
    "op6_near_duplicates": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 1 THEN [ws[1]] ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
        n AS (SELECT doc_id, coalesce(len(sh), 0) AS n FROM s),
        e AS (SELECT doc_id, unnest(sh) AS h FROM s),
        k AS (SELECT h, row_number() OVER () AS i FROM (SELECT h FROM e GROUP BY h HAVING count(*) > 1)),
        f AS (SELECT doc_id, i FROM e JOIN k USING (h)),
        pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM f x JOIN f y ON x.i = y.i AND x.doc_id < y.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 80 * (na.n + nb.n - m)),
        both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS digest FROM p),
        g AS (SELECT digest, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY digest)
        SELECT d.page_id, d.n AS payload_bytes, d.digest AS payload_digest,
               CASE WHEN d.n >= 1000 AND d.page_id <> g.last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN d.n >= 1000 AND d.page_id <> g.last THEN g.last END AS refers_to
        FROM d LEFT JOIN g ON d.digest = g.digest""",
    "op11_prefix_trie": """
        WITH o AS (SELECT conv_id, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS code, strlen(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE xor(list_reduce(flatten(list_transform(string_split(cast(conv_id AS varchar), ''), lambda ch: list_concat([ord(ch)::bigint], repeat([-1::bigint], 8)))),
            lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, 4294967295::bigint), 4294967295) % 9 END AS h FROM o),
        r AS (SELECT c.conv_id, o.pos AS part, 0 AS own, o.code, o.size FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.h AND c.base <> c.conv_id UNION ALL SELECT c.conv_id, o.pos, 1, o.code, o.size FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
        t AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(code, '') OVER w AS path, size FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, part ROWS UNBOUNDED PRECEDING)),
        p AS (SELECT conv_id, depth, path, size FROM t UNION ALL SELECT conv_id, 0, '', 0 FROM c),
        l AS (SELECT conv_id, max(depth) AS len FROM p GROUP BY conv_id),
        n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size, string_agg(CASE WHEN depth = len THEN conv_id END, ',' ORDER BY conv_id) AS ends FROM p JOIN l USING (conv_id) GROUP BY depth, path),
        k AS (SELECT x.conv_id, x.depth, count(*) AS n_children FROM n x JOIN n y ON y.depth = x.depth + 1 AND left(y.path, 32 * x.depth) = x.path GROUP BY ALL),
        u AS (SELECT p.path AS top, n.depth - p.depth AS down, n.conv_id, n.depth, n.n_convs, n.size FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth),
        s AS (SELECT top, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n_convs - 1) * size) AS saved FROM u LEFT JOIN k USING (conv_id, depth) GROUP BY top)
        SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, cast(s.saved AS bigint) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
        FROM n JOIN s ON s.top = n.path LEFT JOIN k ON k.conv_id = n.conv_id AND k.depth = n.depth LEFT JOIN n a ON n.depth > 0 AND a.depth = n.depth - 1 AND a.path = left(n.path, 32 * (n.depth - 1))""",
}
