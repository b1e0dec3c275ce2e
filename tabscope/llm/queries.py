"""The numbered operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm import bpe, contamination, language_model, licenses, line_templates, manifest, neighbours, pivots, quality, simhash, sketches, substrings, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_simhash_golay")
def op1_simhash_golay(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op2_warc_revisit", """
WITH paid AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     best AS (SELECT payload_digest, max(page_id) AS original FROM paid WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN original IS NOT NULL AND original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original IS NOT NULL AND original <> page_id THEN original END AS refers_to
FROM paid LEFT JOIN best USING (payload_digest)
""")
def op2_warc_revisit(spark, sf):
    return warc.deduplicate(table(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_license_compression")
def op3_license_compression(spark, sf):
    found = licenses.scan_licenses(table(spark, sf, "documents"))
    return found.select("doc_id", "license", "first_word", "last_word", F.round("saved", 6).alias("saved"), "edits", F.array_join("changes", "; ").alias("changes"))


@query("op4_importance_resampling")
def op4_importance_resampling(spark, sf):
    drawn = quality.resample(table(spark, sf, "documents"), table(spark, sf, "labels"), columns=("doc_id",))
    return drawn.select("doc_id", "weight", "weight_key")


@query("op5_stable_projections")
def op5_stable_projections(spark, sf):
    return neighbours.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op6_pigeonhole_decontamination")
def op6_pigeonhole_decontamination(spark, sf):
    return contamination.find_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op7_elias_fano_lm")
def op7_elias_fano_lm(spark, sf):
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    return language_model.train_and_score(table(spark, sf, "documents"), training)


@query("op8_substring_dedup", r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
     starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM split WHERE len(words) >= 13),
     grams AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS gram FROM starts),
     least AS (SELECT gram, min(doc_id) AS first_doc FROM grams GROUP BY gram),
     gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM grams JOIN least USING (gram) WHERE first_doc < doc_id),
     places AS (SELECT doc_id, words[p] AS word, p FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM split)),
     kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
""")
def op8_substring_dedup(spark, sf):
    cut = substrings.remove_repeats(table(spark, sf, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op9_log_templates", r"""
WITH RECURSIVE docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
     texts AS MATERIALIZED (SELECT row_number() OVER () AS whole, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
     triples AS MATERIALIZED (SELECT DISTINCT whole, hash(w[i], w[i + 1], w[i + 2]) AS h FROM (SELECT whole, w, unnest(range(1, len(w) + 1)) AS i FROM texts)),
     sizes AS (SELECT whole, count(*) AS n FROM triples GROUP BY whole),
     alike AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.whole AS a, y.whole AS b, count(*) AS n FROM triples x JOIN triples y ON x.h = y.h AND x.whole <> y.whole GROUP BY ALL) p
               JOIN sizes s ON s.whole = p.a JOIN sizes t ON t.whole = p.b WHERE p.n >= 0.6 * (s.n + t.n - p.n)),
     reached AS (SELECT a, b FROM alike UNION SELECT r.a, l.b FROM reached r JOIN alike l ON r.b = l.a),
     family AS MATERIALIZED (SELECT t.text, least(t.whole, coalesce(min(r.b), t.whole)) AS family FROM texts t LEFT JOIN reached r ON r.a = t.whole GROUP BY t.text, t.whole),
     own AS (SELECT doc_id, unnest(lines) AS own, unnest(range(len(lines))) AS line FROM docs),
     cut AS (SELECT doc_id, line, own, regexp_extract_all(own, '[^\x20\x09-\x0D]+') AS raw FROM own),
     masked AS (SELECT doc_id, line, raw, list_transform(raw, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS words FROM cut WHERE len(raw) > 0),
     met AS (SELECT doc_id, line, raw, words, {'n': len(words), 'head': words[1:3]} AS leaf FROM masked),
     leaves AS (SELECT leaf FROM met GROUP BY leaf HAVING count(*) >= 3),
     held AS (SELECT met.* FROM met JOIN leaves USING (leaf)),
     places AS (SELECT leaf, place, max(n) AS most, sum(n) AS total FROM
                (SELECT leaf, place, word, count(*) AS n FROM (SELECT leaf, unnest(words) AS word, unnest(range(len(words))) AS place FROM held) GROUP BY ALL) GROUP BY leaf, place),
     variable AS (SELECT leaf, list(place) AS free FROM places WHERE 2 * most < total GROUP BY leaf),
     general AS (SELECT doc_id, line, raw, words, list_transform(words, lambda w, i: CASE WHEN list_contains(coalesce(free, []), i - 1) THEN '<*>' ELSE w END) AS wide
                 FROM held LEFT JOIN variable USING (leaf)),
     marked AS (SELECT doc_id, line, CASE WHEN len(list_filter(wide, lambda w: w <> '<*>')) >= 0.6 * len(wide) THEN wide
                       WHEN len(list_filter(words, lambda w: w <> '<*>')) >= 0.6 * len(words) THEN words ELSE raw END AS template FROM general),
     often AS (SELECT template FROM marked JOIN docs USING (doc_id) JOIN family USING (text) GROUP BY template HAVING count(DISTINCT family) >= 3),
     gone AS (SELECT doc_id, line FROM marked JOIN often USING (template)),
     kept AS (SELECT doc_id, string_agg(own, chr(10) ORDER BY line) AS text, count(*) AS n FROM own ANTI JOIN gone USING (doc_id, line) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines), 0) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
""")
def op9_log_templates(spark, sf):
    left = line_templates.drop_recurring_lines(table(spark, sf, "documents"))
    return left.select("doc_id", F.col("lines_before").alias("n_lines"), F.col("lines_dropped").alias("n_dropped"),
                       F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


@query("op10_bpe_trie")
def op10_bpe_trie(spark, sf):
    coded = bpe.encode_documents(table(spark, sf, "documents"), VOCABULARY)
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def _rounds_sql(rounds: int) -> str:
    """Each round's assignment and centroids, one after the other."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
     near{i} AS MATERIALIZED (SELECT rid, CAST(split_part(min(lpad(CAST(d AS VARCHAR), 20, '0') || ':' || k), ':', 2) AS INT) AS k, min(d) AS d
                 FROM (SELECT v.rid, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM vecs v, cent{i} c) GROUP BY rid)""")
        if i < rounds:
            steps.append(f"""
     cent{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(n.x, c.x) AS x FROM cent{i} c LEFT JOIN (SELECT k, list(m ORDER BY place) AS x FROM (
                 SELECT k, place, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
                 SELECT a.k, u.place, sum(v.x[u.place]) AS s, count(*)::HUGEINT AS n FROM near{i} a JOIN vecs v USING (rid), (SELECT unnest(range(1, 65)) AS place) u GROUP BY a.k, u.place)) GROUP BY k) n USING (k))""")
    return ",".join(steps)


@query("op11_laesa_centroids", f"""
WITH vecs AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
                WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
     cent0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INT) AS k, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM vecs ORDER BY h, x LIMIT 8)),{_rounds_sql(10)}
SELECT vec_id, k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM near10 JOIN vecs v USING (rid) JOIN cent10 c USING (k)
""")
def op11_laesa_centroids(spark, sf):
    return pivots.cluster(table(spark, sf, "embeddings"))


@query("op12_paragraph_sketches")
def op12_paragraph_sketches(spark, sf):
    return sketches.fingerprints(table(spark, sf, "documents"))


def _tree_sql(name: str, source: str, levels: int) -> str:
    """Levels of 16-fold runs above ``source (g, pos, digest)``: siblings on the left and on the
    right of every node, and its parent's place and digest; a group's only node has none."""
    out, below = [], source
    for i in range(levels):
        out.append(f"""
     {name}{i} AS MATERIALIZED (SELECT g, pos, digest, count(*) OVER (PARTITION BY g) > 1 AS inner_node,
                 coalesce(string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY g, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                 coalesce(string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY g, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {below}),
     {name}up{i} AS MATERIALIZED (SELECT g, pos // 16 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM {name}{i} WHERE inner_node GROUP BY g, pos // 16)""")
        below = f"{name}up{i}"
    return ",".join(out)


def _manifest_sql(low: int, high: int) -> str:
    """Trees of ``low`` levels per source and ``high`` levels above them."""
    def encoded(c):
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"

    def leaf(text):
        return "sha256(" + " || ".join(encoded(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    upper, lower = manifest.UPPER, manifest.LOWER
    steps, joins, proof, folded = [], [], ["''"], "start"
    for name, levels, place in (("low", low, "d.g"), ("high", high, "0")):
        at = "d.pos" if name == "low" else "d.g"
        for i in range(levels):
            t = f"{name[0]}{i}"
            joins.append(f"LEFT JOIN {name}{i} {t} ON {t}.inner_node AND {t}.g = {place} AND {t}.pos = {at} // {16 ** i}")
            proof.append(f"coalesce({t}.l || {t}.r, '')")
    for t in [f"l{i}" for i in range(low)] + [f"h{i}" for i in range(high)]:
        steps.append(f"f{len(steps) + 1} AS (SELECT * EXCLUDE (start), CASE WHEN {t}l IS NULL THEN start ELSE sha256({t}l || start || {t}r) END AS start FROM f{len(steps)})")
    sides = ", ".join(f"{t}.l AS {t}l, {t}.r AS {t}r" for t in [f"l{i}" for i in range(low)] + [f"h{i}" for i in range(high)])
    return f"""
WITH leaves AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf,
                {leaf(f"CASE WHEN crc_hit THEN translate(text, '{upper}', '{lower}') ELSE text END")} AS start FROM (SELECT *, {_crc_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 AS crc_hit FROM documents)),
     placed AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
     bottom AS (SELECT g, pos, leaf AS digest FROM placed),{_tree_sql("low", "bottom", low)},
     subroots AS MATERIALIZED ({" UNION ALL ".join(f"SELECT g, digest FROM low{i} WHERE NOT inner_node" for i in range(low))}),
     tops AS (SELECT 0 AS g, g AS pos, digest FROM subroots),{_tree_sql("high", "tops", high)},
     top AS ({" UNION ALL ".join(f"SELECT digest FROM high{i} WHERE NOT inner_node" for i in range(high))}),
     f0 AS (SELECT d.doc_id, d.leaf, s.digest AS subroot, top.digest AS root, {" || ".join(proof)} AS proof, d.start, {sides}
            FROM placed d JOIN subroots s ON s.g = d.g CROSS JOIN top {" ".join(joins)}),
     {", ".join(steps)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, start AS folded_root, start = root AS verified FROM f{len(steps)}"""


def _crc_sql(text: str) -> str:
    """CRC-32 of a text of digits, bit by bit."""
    bits = "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, b: {bits}, 4294967295), 4294967295)"


@query("op13_merkle_manifest", _manifest_sql(6, 4))
def op13_merkle_manifest(spark, sf):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    checked = manifest.audit(table(spark, sf, "documents"), tampered=tampered)
    return checked.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")
