"""One named query for each operator, over the given tables, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import backoff_lm, language_id, lexical, mixing, near_copies, packing, pieces, pii, pivots, quality_rules, spelling, toxicity, warc

Build = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file on the driver; executors get its content."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    machine = toxicity.train(documents, _table(spark, folder, "labels"), toxicity.learnable())
    held_out = F.coalesce(~toxicity.learnable(), F.lit(True)).alias("held_out")
    scored = documents.select("doc_id", held_out, toxicity.score(F.col("text"), machine, documents).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_pivots(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.find(_table(spark, folder, "embeddings"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    _, found = warc.archive(_table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(_table(spark, folder, "documents"))


def op5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digest(_table(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(_table(spark, folder, "documents"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


#: The contract of the query: three words and 85 percent.
COPIES = near_copies.Settings(words=3, percent=85)


def op8_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    found = near_copies.find(_table(spark, folder, "documents"), COPIES)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    model = language_id.train(documents, ~language_id.held_out())
    found = documents.select("doc_id", language_id.held_out().alias("held_out"), language_id.predict(F.col("text"), model, documents).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op10_backoff_lm(spark: SparkSession, folder: str) -> DataFrame:
    return backoff_lm.score(_table(spark, folder, "documents"))


def op11_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mix(_table(spark, folder, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    words = spelling.count_words(_table(spark, folder, "documents"), shortest=6, least=5, noise=199)
    return spelling.variants(words, ratio=5).select("word", "form", "root", "n", "n_near", "form_n")


def op13_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


QUERIES: dict[str, Build] = {
    build.__name__: build
    for build in (
        op1_toxicity, op2_pivots, op3_warc, op4_quality_rules, op5_pieces, op6_pii, op7_packing, op8_near_copies, op9_language,
        op10_backoff_lm, op11_mixing, op12_spelling, op13_lexical,
    )
}

_WORD_SETS = """
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents"""

_STOPS = ", ".join(f"'{w}'" for w in [*quality_rules.STOP_WORDS, *(w.capitalize() for w in quality_rules.STOP_WORDS)])

ORACLES: dict[str, str] = {
    "op2_pivots": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS len FROM v WHERE label IS NOT NULL),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE a.len > 0 AND b.len > 0 AND list_dot_product(a.e, b.e) / (a.len * b.len) >= 0.93),
        reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a),
        c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id)
        SELECT c.vec_id, (SELECT count(*) FROM links WHERE links.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c""",
    "op3_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
    "op4_quality_rules": f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
        g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
        r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        c AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM r) GROUP BY doc_id),
        m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                     length(regexp_replace(array_to_string(w, ''), '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                     (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
                     len(list_filter(w, lambda x: x IN ({_STOPS})))::BIGINT AS n_stop_words,
                     len(list_filter(w, lambda x: ends_with(x, '!!')))::BIGINT AS n_marked_words
              FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT *, NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.1
                  AND n_stop_words / n_words >= 0.04 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND n_marked_words / n_words <= 0.3 AS kept
        FROM b""",
    "op8_near_copies": f"""
        WITH RECURSIVE w AS ({_WORD_SETS}),
        s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
              UNION SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2),
        n AS (SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
            JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
        reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a),
        c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
        SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c ON c.doc_id = n.doc_id""",
    "op11_mixing": f"""
        WITH r AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest,
                          len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
        c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, digest) - 1 AS copy FROM r),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS rows FROM r GROUP BY source),
        w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
        v AS (SELECT *, ([5, 2, 1])[(place - 1) % 3 + 1] AS weight, 3 * source_size AS most FROM w),
        o AS (SELECT *, sum(source_size) OVER () - sum(most) OVER f + most AS left_, sum(weight) OVER () - sum(weight) OVER f + weight AS sharers FROM v
              WINDOW f AS (ORDER BY most::DOUBLE / weight::DOUBLE, place ROWS UNBOUNDED PRECEDING)),
        g AS (SELECT *, most * sharers < weight * left_ AS stops FROM o),
        t AS (SELECT place, source, source_size, rows,
                     CASE WHEN stops THEN most::DOUBLE
                          ELSE weight::DOUBLE * (sum(source_size) OVER () - coalesce(sum(most) FILTER (stops) OVER (), 0))::DOUBLE
                               / greatest(coalesce(sum(weight) FILTER (NOT stops) OVER (), 0), 1)::DOUBLE END AS target FROM g),
        k AS (SELECT t.*, doc_id, size, copy, md5(concat('{mixing.SEED}:', coalesce(doc_id::VARCHAR, ''), ':', digest, ':', copy // {mixing.TOGETHER})) AS key
              FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
        d AS (SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % greatest(1, (source_size + rows + {mixing.SHARD - 1}) // {mixing.SHARD}) AS shard FROM k),
        h AS (SELECT place, shard, sum(size)::BIGINT AS words, (sum(size)::BIGINT + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS blocks,
                     any_value(target) / any_value(source_size)::DOUBLE AS ratio FROM d GROUP BY place, shard HAVING sum(size) > 0),
        q AS (SELECT place, any_value(ratio) * sum(blocks)::DOUBLE AS votes, sum(blocks)::BIGINT * 3 AS most FROM h GROUP BY place),
        a AS (SELECT place, i, row_number() OVER (ORDER BY votes / (2 * i + 1)::DOUBLE DESC, place, i) AS r FROM (SELECT *, unnest(range(most)) AS i FROM q)),
        b AS (SELECT place, count(*) AS house FROM a WHERE r <= (SELECT floor(sum(votes::DECIMAL(38, 9)) + 0.5) FROM q) GROUP BY place),
        e AS (SELECT place, shard, i, row_number() OVER (PARTITION BY place ORDER BY ratio * blocks::DOUBLE / (2 * i + 1)::DOUBLE DESC, shard, i) AS r
              FROM (SELECT *, unnest(range(blocks * 3)) AS i FROM h)),
        n AS (SELECT h.*, coalesce(m.seats, 0) AS seats FROM h LEFT JOIN (
                  SELECT place, shard, count(*) AS seats FROM e JOIN b USING (place) WHERE r <= house GROUP BY place, shard) m
              ON h.place = m.place AND h.shard = m.shard),
        l AS (SELECT *, seats // blocks + (row_number() OVER (PARTITION BY place, shard ORDER BY md5(concat('{mixing.SEED}:', place, ':', shard, ':', i)))
                                           <= seats % blocks)::BIGINT AS times, i * words // blocks AS lo, (i + 1) * words // blocks AS hi
              FROM (SELECT *, unnest(range(blocks)) AS i FROM n)),
        p AS (SELECT *, row_number() OVER () AS id, (sum(size) OVER (PARTITION BY place, shard ORDER BY key, doc_id, size, copy ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
              FROM d),
        x AS (SELECT id, sum((least(hi, start + size) - greatest(lo, start)) * times)::BIGINT AS taken
              FROM p JOIN l ON p.place = l.place AND p.shard = l.shard AND lo < start + size AND hi > start GROUP BY id)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM p LEFT JOIN x USING (id)""",
    "op13_lexical": r"""
        WITH d AS (SELECT row_number() OVER () AS id, doc_id, text FROM documents),
        i AS (SELECT row_number() OVER () AS item, item_id, text FROM benchmark),
        t AS (SELECT id, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        q AS (SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i),
        n AS (SELECT id, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY id),
        s AS (SELECT count(*) AS c, sum(n)::BIGINT AS l FROM n),
        m AS (SELECT id, doc_id, 75 + (25 * n * c) // l AS m FROM n, s),
        f AS (SELECT id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY id, term),
        w AS (SELECT term, floor(1000 * ln((2 * c + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term, c),
        r AS (SELECT item, item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
              FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (id) GROUP BY item, item_id, id, doc_id),
        p AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM p WHERE rank <= 20""",
}
