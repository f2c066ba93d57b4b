"""The registered queries of this subpackage, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, language_id, lm, merkle, packing, resample, simhash, substring_dedup, token_files, topk_search, toxicity
from .common import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(table(spark, sf_dir, "documents"))
    held_out = F.coalesce(~lm.learned_on(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path)
    return token_files.digests(token_files.read(spark, path))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added)
    return chat_format.digests(chat_format.windows(chats))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(~toxicity.learned_on(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substring_dedup.remove_repeats(docs)
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = language_id.learned_on(F.col("doc_id"))
    found = language_id.identify(docs.select("doc_id", "text"), language_id.train(docs.where(learned)))
    return found.select("doc_id", F.coalesce(~learned, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.col("n_chars") + F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, 1).otherwise(0)
    fields = {c: F.col(c) for c in docs.columns}
    leaves = docs.select("lang", "doc_id", merkle.leaf(*fields.values()).alias("leaf"), merkle.leaf(*(fields | {"n_chars": tampered}).values()).alias("claimed"))
    manifest = merkle.build(leaves, "lang", "doc_id", "leaf")
    root = F.lit(manifest.root()).cast("string")
    found = merkle.proofs(manifest, "claimed")
    return found.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        root.alias("root"),
        F.sha2(F.concat_ws("", "siblings"), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == root).alias("verified"),
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_chat_format": op2_chat_format,
    "op3_toxicity": op3_toxicity,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_token_files": op6_token_files,
    "op7_topk_search": op7_topk_search,
    "op8_simhash": op8_simhash,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_importance_resampling": op13_importance_resampling,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
# CRC-32: what one byte makes of the value, for all bytes, by the rule; then byte by byte, from the hex form of a text.
_STEPS = "list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
_BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: ('0x' || h)::BIGINT)"
_CRC = "xor(list_reduce(list_concat([4294967295], " + _BYTES + "), lambda c, b: xor(c // 256, steps[xor(c % 256, b) + 1])), 4294967295)"
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_FIELD.format, ("doc_id", "source", "lang", n_chars, "text"))) + ")"

ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": f"""
        WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS pos, w FROM d WHERE len(w) >= 20),
        h AS (SELECT doc_id, pos, array_to_string(w[pos : pos + 19], ' ') AS words FROM p),
        r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY words ORDER BY doc_id, pos) AS nth FROM h),
        gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM r WHERE nth > 1),
        word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
        kept AS (
            SELECT doc_id, count(gone.pos) AS n_removed,
                   string_agg(word, ' ' ORDER BY word.pos) FILTER (WHERE gone.pos IS NULL) AS kept
            FROM word LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id
        )
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op7_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
                   FROM embeddings WHERE len(embedding) > 0
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id,
                     list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op10_decontamination": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
        b AS (SELECT DISTINCT item_id, regexp_extract_all(
                  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
        i AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
        ip AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM i),
        win AS (SELECT DISTINCT item_id, n, array_to_string(w[pos : pos + n - 1], ' ') AS span FROM ip),
        sizes AS (SELECT DISTINCT n FROM win),
        dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, sizes WHERE len(w) >= n),
        hit AS (SELECT doc_id, pos, dp.n, item_id FROM dp JOIN win
                ON dp.n = win.n AND array_to_string(w[pos : pos + dp.n - 1], ' ') = span),
        word AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM
                 (SELECT doc_id, unnest(range(pos, pos + n)) AS k FROM hit) GROUP BY doc_id),
        item AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM
                 (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
               coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
    """,
    "op11_merkle_manifest": f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
                   CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS claimed,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos
            FROM documents, (SELECT {_STEPS} AS steps)
        ),
        nodes AS (
            SELECT lang, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM leaves
            UNION ALL
            SELECT lang, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2
            FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n
        ),
        subroots AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM nodes WHERE n = 1),
        tops AS (
            SELECT 0 AS level, pos, subroot AS node, count(*) OVER () AS n FROM subroots
            UNION ALL
            SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2
            FROM tops WHERE n > 1 GROUP BY level, pos // 2, n
        ),
        inner_fold AS (
            SELECT doc_id, lang, 0 AS level, pos, claimed AS value, '' AS proof FROM leaves
            UNION ALL
            SELECT f.doc_id, f.lang, f.level + 1, f.pos // 2,
                   sha256(CASE WHEN s.node IS NULL THEN value WHEN f.pos % 2 = 1 THEN s.node || value ELSE value || s.node END),
                   proof || coalesce(s.node, '')
            FROM inner_fold f
            JOIN nodes o ON o.lang IS NOT DISTINCT FROM f.lang AND o.level = f.level AND o.pos = f.pos AND o.n > 1
            LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.pos = xor(f.pos, 1)
        ),
        within AS (SELECT doc_id, lang, value, proof FROM inner_fold QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1),
        outer_fold AS (
            SELECT doc_id, 0 AS level, s.pos, subroot, value, proof FROM within w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang
            UNION ALL
            SELECT f.doc_id, f.level + 1, f.pos // 2, subroot,
                   sha256(CASE WHEN s.node IS NULL THEN value WHEN f.pos % 2 = 1 THEN s.node || value ELSE value || s.node END),
                   proof || coalesce(s.node, '')
            FROM outer_fold f JOIN tops o ON o.level = f.level AND o.pos = f.pos AND o.n > 1
            LEFT JOIN tops s ON s.level = f.level AND s.pos = xor(f.pos, 1)
        ),
        done AS (SELECT * FROM outer_fold QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1),
        root AS (SELECT node AS root FROM tops WHERE n = 1)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, value AS folded_root, value = root AS verified
        FROM done JOIN leaves USING (doc_id), root
    """,
    "op12_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(length(text), 0) AS points,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER w = 1 AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
    """,
    "op13_importance_resampling": f"""
        WITH d AS (SELECT doc_id, coalesce({_ALNUM}, []) AS w FROM documents),
        b AS (SELECT coalesce({_ALNUM}, []) AS w FROM benchmark),
        runs AS (
            SELECT doc_id, array_to_string(w[i : i + k - 1], ' ') AS feature
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT unnest([1, 2, 3]) AS k))
        ),
        f AS (SELECT doc_id, feature, count(*) AS n FROM runs GROUP BY ALL),
        g AS (
            SELECT array_to_string(w[i : i + k - 1], ' ') AS feature
            FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b, (SELECT unnest([1, 2, 3]) AS k))
        ),
        known AS (SELECT feature, {_CRC.format("feature")} % 10000 AS bucket
                  FROM (SELECT DISTINCT feature FROM f UNION SELECT feature FROM g), (SELECT {_STEPS} AS steps)),
        s AS (SELECT bucket, sum(n) AS s FROM f JOIN known USING (feature) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM g JOIN known USING (feature) GROUP BY bucket),
        gain AS (
            SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE)
                   / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
            FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
        ),
        w AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM f JOIN known USING (feature) JOIN gain USING (bucket) GROUP BY doc_id),
        scored AS (
            SELECT doc_id, len(d.w) AS n_words, (len(d.w) + greatest(len(d.w) - 1, 0) + greatest(len(d.w) - 2, 0))::BIGINT AS n_features,
                   coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM d LEFT JOIN w USING (doc_id)
        ),
        placed AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER () // 100 AS most
            FROM scored WHERE n_words >= 20
        )
        SELECT doc_id, n_features, weight, score, place AS rank
        FROM scored LEFT JOIN (SELECT * FROM placed WHERE place <= most) USING (doc_id)
    """,
}
