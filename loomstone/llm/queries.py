"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import centroids, decontamination, exact_dedup, hard_negatives, licenses, ngram_join, packing, pieces, quality, quality_rules, secrets, toxicity, url_filter
from loomstone.llm.common import read

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents", "doc_id", "text"))


URL_RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages", "page_id", "url"), [url_filter.rule(x) for x in URL_RULES])


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.index_documents(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of a text stands for the prompt, which bears no loss."""
    return packing.pack(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), limits=packing.Limits(segments=64), prompt_lines=1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents", "doc_id", "text", "lang"), read(spark, sf_dir, "labels", "doc_id", "quality"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_join(read(spark, sf_dir, "documents", "doc_id", "text"), width=3, num=90, den=100, count_links=False)
    return found.select("doc_id", "n_shingles", "component_id")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text by merging and by the best cut, its score, and whether decoding both gives the text back."""
    coded = pieces.encode(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.size("best_ids").cast("long").alias("n_best"), "best_ids", "best_score", "round_trip")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of the labels are moved on by one, so that neighbours of other labels exist."""
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, label)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_license_scan": op2_license_scan,
    "op3_url_filter": op3_url_filter,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_decontamination": op12_decontamination,
    "op13_centroids": op13_centroids,
}

_SETTINGS = ", ".join(f"({i}, {', '.join(map(str, cuts))})" for i, cuts in enumerate(quality_rules.SETTINGS))
_RATES = {
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
}
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds one after the other, all distances in each."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    assign = f"(SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT vec_id, cluster, {distance} AS d FROM v, {{0}} c) GROUP BY vec_id)"
    tables = [
        f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, x FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k}))"""
    ]
    for r in range(rounds):
        mean = "(s - ((s % n) + n) % n) // n"  # the floor of s / n
        tables.append(f"""c{r + 1} AS MATERIALIZED (
            SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
                SELECT cluster, list({mean} ORDER BY i) AS x FROM (
                    SELECT cluster, i, sum(v.x[i])::BIGINT AS s, count(*) AS n FROM v JOIN {assign.format(f"c{r}")} a USING (vec_id), (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL
                ) GROUP BY cluster
            ) m USING (cluster)
        )""")
    return ",\n        ".join(tables) + f"""
        SELECT vec_id, cluster::INT AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
            (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM {assign.format(f"c{rounds}")} a JOIN c{rounds} c USING (cluster)
    """


ORACLES: dict[str, str] = {
    "op11_hard_negatives": f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
            FROM embeddings WHERE label IS NOT NULL AND {_FINITE}
        ),
        s AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, list_dot_product(a.x, c.x)::BIGINT AS score
            FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
        ),
        p AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        )
        SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
        QUALIFY row_number() OVER w <= 10
    """,
    "op12_decontamination": r"""
        WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS MATERIALIZED (
            SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
        ),
        runs AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
        ),
        met AS MATERIALIZED (SELECT doc_id, i, n, item_id FROM runs JOIN windows USING (n, g)),
        hit AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM met, (SELECT unnest(range(10)) AS o) WHERE o < n GROUP BY doc_id),
        found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met WHERE item_id IS NOT NULL) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
    "op13_centroids": _clusters_sql(),
    "op8_quality_rules": rf"""
        WITH t AS (
            SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
                list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
            FROM documents
        ),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM t)),
        rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
        cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest(range(8)) AS o) GROUP BY doc_id),
        counts AS (
            SELECT doc_id, stratum, len(ws)::BIGINT AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_upper
            FROM t LEFT JOIN cov USING (doc_id)
        ),
        rates AS (SELECT doc_id, stratum, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {", ".join(f"{rate} AS {rule}" for rule, rate in _RATES.items())} FROM counts),
        settings AS (SELECT * FROM (VALUES {_SETTINGS}) AS s(setting, {", ".join(f"c_{rule}" for rule in _RATES)})),
        good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
        lost AS (
            SELECT stratum, setting, count(*) AS n, count_if({" OR ".join(f"{rule} > c_{rule}" for rule in _RATES)}) AS k
            FROM rates JOIN good USING (doc_id), settings WHERE NOT base_failed GROUP BY ALL
        ),
        least AS (SELECT ceil(ln({quality_rules.CONFIDENCE_LOSS} / greatest(count(DISTINCT stratum), 1)) / ln(1 - {quality_rules.RISK})) AS least FROM lost),
        placed AS (SELECT stratum, setting, n, k, CASE WHEN n < least THEN 'few' ELSE 'own ' || stratum END AS pool FROM lost, least),
        spared AS (SELECT stratum, max(setting) AS spared FROM (SELECT *, bool_and(k <= n * {quality_rules.RISK}) OVER (PARTITION BY stratum ORDER BY setting) AS passed FROM lost) WHERE passed GROUP BY stratum),
        pooled AS (SELECT pool, setting, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM placed GROUP BY ALL),
        pools AS (SELECT greatest(count(DISTINCT pool), 1) AS pools FROM pooled),
        tested AS (
            SELECT pool, setting, CASE WHEN k >= n * {quality_rules.RISK} THEN 1.0 ELSE list_sum(list_transform(range(k + 1), lambda i:
                exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality_rules.RISK}) + (n - i) * ln(1 - {quality_rules.RISK})))) END <= {quality_rules.CONFIDENCE_LOSS} / pools AS ok
            FROM pooled, pools
        ),
        allowed AS (SELECT pool, max(setting) AS allowed FROM (SELECT *, bool_and(ok) OVER (PARTITION BY pool ORDER BY setting) AS passed FROM tested) WHERE passed GROUP BY pool),
        chosen AS (SELECT stratum, least(allowed, spared) AS setting FROM (SELECT DISTINCT stratum, pool FROM placed) JOIN allowed USING (pool) JOIN spared USING (stratum)),
        hit AS (
            SELECT doc_id, concat_ws(',', {", ".join(f"CASE WHEN {rule} > c_{rule} THEN '{rule}' END" for rule in _RATES)}) AS rejected_by
            FROM rates JOIN chosen USING (stratum) JOIN settings USING (setting)
        ),
        f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND coalesce(rejected_by, '') = '' AS kept, coalesce(rejected_by, '') AS rejected_by
        FROM f LEFT JOIN hit USING (doc_id)
    """,
    "op4_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
    """,
    "op9_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents
        ),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3
                THEN list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])
                WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
            FROM w
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
        ),
        reach AS (
            SELECT doc_id AS x, doc_id AS y FROM documents
            UNION
            SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
        )
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.y) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id
    """,
}
