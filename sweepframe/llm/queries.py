"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepframe.functions.scratch import materialise
from sweepframe.llm import chatformat, filteraudit, gifmedia, hardnegatives, langid, linededup, mixing, multisethash, packing, simhash, tokenbin, tokencount, urlfilter
from sweepframe.llm.words import WORD, word_count

#: Rules of op4: host, path prefix, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Listed hosts of op4.
BLOCKED_HOSTS = [f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "language.lang_pred", "language.score", F.to_json("language.proportions").alias("proportions"))


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    measured = materialise(mixing.measure(docs))
    taken = mixing.take_measured(measured, mixing.plan(docs, measured=measured))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 4).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenbin.read(spark, tokenbin.write(docs, public_tokenizers.path("word_bpe_49k.json"), 1))


def op4_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, RULES, BLOCKED_HOSTS).select("page_id", "judged.*")


def op5_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    formatted = materialise(chatformat.format_turns(turns.unionByName(more)))
    return chatformat.read_back(formatted)


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_gif_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    images = materialise(docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), gifmedia.stored(F.col("text")).alias("image")))
    return gifmedia.payload_features(images)


def op8_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "text", "line_dedup.n_lines", "line_dedup.n_removed")


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), word_count(F.col("text")))


def op10_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = multisethash.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = rows.withColumn("edited", multisethash.edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fp", multisethash.fingerprint(F.col("edited")).alias("edited_fp"), "next_fp")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", multisethash.as_text(F.col("fp")).alias("fingerprint"), multisethash.as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        multisethash.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), multisethash.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return filteraudit.audit(spark, f"{sf_dir}/documents.parquet", labels)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(hardnegatives.usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long"))
    return hardnegatives.mine(rows.select(F.col("vec_id").alias("id"), label.alias("label"), vector.alias("v")), F.col("id") % 50 == 0)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.token_counts(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "tokens.*")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_language_mixture, op2_pareto_mix, op3_token_blocks, op4_url_cascade, op5_chat_round_trip, op6_simhash_components, op7_gif_payload, op8_line_windows, op9_best_fit, op10_multiset_hash, op11_filter_audit, op12_hard_negatives, op13_token_counts, pipeline]
    return {f.__name__: f for f in own}


# ---------------------------------------------------------------- SQL


def _mix_sql() -> str:
    weights = ", ".join(map(str, mixing.WEIGHTS))
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / {1 << 48}::DOUBLE AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         ([{weights}]::DOUBLE[])[CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1 AS INT)] AS weight
  FROM d GROUP BY source),
r AS (SELECT *, source_size * {mixing.MOST_COPIES}::DOUBLE AS cap, source_size * {mixing.MOST_COPIES}::DOUBLE / weight AS level, sum(source_size) OVER () * {mixing.SHARE}::DOUBLE AS total FROM s),
h AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here
  FROM r),
t AS (SELECT source, source_size, CASE WHEN level <= here THEN cap ELSE least(cap, weight * max(CASE WHEN level > here THEN here END) OVER ()) END AS target FROM h),
c AS (SELECT *, CASE WHEN source_size > 0 THEN least({mixing.MOST_COPIES}, CAST(floor(target / source_size) AS INT)) ELSE 0 END AS copies FROM t),
k AS (
  SELECT source, size, count(*) AS n, any_value(target - copies * source_size) AS rest FROM d JOIN (SELECT source AS of, * EXCLUDE source FROM c) ON source IS NOT DISTINCT FROM of
  WHERE size > 0 AND target > copies * source_size GROUP BY source, size),
b AS (
  SELECT *, (rest - coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * sqrt(size::DOUBLE) >= tail AS certain
  FROM (SELECT *, sum(size * n * sqrt(size::DOUBLE)) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tail FROM k)),
f AS (
  SELECT source AS of, min(size) FILTER (certain) AS certain_from, any_value(rest) - coalesce(sum(size * n) FILTER (certain), 0) AS gap,
         (any_value(rest) - coalesce(sum(size * n) FILTER (certain), 0)) / max(tail) FILTER (NOT certain) AS factor
  FROM b GROUP BY source),
q AS (
  SELECT source, doc_id, size, u, sum(size) AS words, any_value(gap) AS gap, any_value((u / (1 - u)) / (factor * sqrt(size::DOUBLE) / (1 - factor * sqrt(size::DOUBLE)))) AS q
  FROM d JOIN f ON source IS NOT DISTINCT FROM of WHERE size > 0 AND size < coalesce(certain_from, size + 1) GROUP BY source, doc_id, size, u),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q, doc_id NULLS FIRST, size) AS nth FROM q),
g AS (
  SELECT source, CAST(0 AS BIGINT) AS nth, CAST(any_value(gap) AS DOUBLE) AS gap FROM o GROUP BY source
  UNION ALL
  SELECT g.source, min(o.nth), g.gap - arg_min(o.words, o.nth) FROM g JOIN o ON g.source IS NOT DISTINCT FROM o.source AND o.nth > g.nth AND o.words <= g.gap GROUP BY g.source, g.gap),
x AS (SELECT o.source AS xs, o.doc_id AS xi, o.size AS xn, o.u AS xu FROM o JOIN g ON g.source IS NOT DISTINCT FROM o.source AND g.nth = o.nth)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, c.source_size, round(c.target, 4) AS target,
       CAST(d.size * (c.copies + CASE WHEN d.size >= f.certain_from OR x.xn IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source LEFT JOIN f ON f.of IS NOT DISTINCT FROM d.source
LEFT JOIN x ON x.xs IS NOT DISTINCT FROM d.source AND x.xi IS NOT DISTINCT FROM d.doc_id AND x.xn = d.size AND x.xu = d.u"""


def _url_sql() -> str:
    fits = "\n    ".join(f"UNION ALL SELECT '{h + p}' AS rule, '{v}' AS verdict, {len(h + p)} AS n WHERE (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, v in RULES).removeprefix("UNION ALL ")
    blocked = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in BLOCKED_HOSTS)
    return rf"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (SELECT *, (SELECT struct_pack(rule := rule, verdict := verdict) FROM (
    {fits}) ORDER BY n DESC, rule LIMIT 1) AS hit FROM p)
SELECT page_id, host, path, hit.rule AS rule, CASE WHEN hit IS NOT NULL THEN hit.verdict WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict
FROM r"""


def _chat_sql() -> str:
    said = r"\### Assistant: </turn> ok"
    control = chatformat.CONTROL
    return rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{said}' UNION ALL SELECT -7, 1, 'assistant', '{said}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(length('### ' || role || ': ' || regexp_replace(text, '{control}', '\\\1\2', 'g') || chr(10) || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


def _lines_sql() -> str:
    return r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM d WHERE len(lines) >= 3),
k AS (SELECT doc_id, i, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS body FROM w WHERE trim(lines[i] || lines[i + 1] || lines[i + 2], ' ') <> ''),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS nth, count(*) OVER (PARTITION BY body) AS times FROM k),
c AS (SELECT doc_id, j, bool_or(nth = 1) AS stays FROM (SELECT doc_id, nth, unnest([i, i + 1, i + 2]) AS j FROM n WHERE times > 1) GROUP BY doc_id, j),
g AS (SELECT doc_id, list(j) AS gone FROM c WHERE NOT stays GROUP BY doc_id)
SELECT d.doc_id,
       CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string([lines[x] for x in range(1, len(lines) + 1) if NOT list_contains(gone, x)], chr(10)), '') END AS text,
       CAST(coalesce(len(lines), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(gone), 0) AS INTEGER) AS n_removed
FROM d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id"""


def _multiset_sql() -> str:
    m = multisethash
    ends = f"(CASE WHEN w = '' THEN 0 ELSE unicode(w) * 7 + unicode(right(w, 1)) * 3 + length(w) END) % {m.ENDS} = 0"
    line = f"CASE WHEN length(l) > {m.LONG} THEN list_aggregate(list_transform(string_split(l, ' '), lambda w: CASE WHEN {ends} THEN w || chr(10) ELSE w END), 'string_agg', ' ') ELSE l END"
    lines = f"list_aggregate(list_transform(string_split(replace(body, '. ', '.' || chr(10)), chr(10)), lambda l: {line}), 'string_agg', chr(10))"
    cut = rf"regexp_replace({lines}, '{m.PART}', '\1' || chr(10), 'g')"
    lanes = ", ".join(f"CAST(coalesce(sum(({h} >> {k}) & {m.SPREAD}), 0) AS BIGINT) AS {h}{k}" for h in "ab" for k in range(m.STEPS))
    names = ", ".join(f"{h}{k}" for h in "ab" for k in range(m.STEPS))
    lane = lambda x, j: f"2 * (({x} >> {21 * j}) & {m.LANE})"
    signs = lambda v: f"[CAST(y - {v}[1] AS DOUBLE) for y in flatten([[{lane('x', 0)}, {lane('x', 1)}, {lane('x', 2)}] for x in {v}[4:]])]"
    text = lambda v: f"array_to_string([lpad(lower(to_hex(x)), 16, '0') for x in {v}], '')"
    near = lambda u, v: f"CASE WHEN {u} = {v} THEN 1.0 ELSE round(greatest(0.0, least(1.0, list_dot_product({signs(u)}, {signs(v)}) / sqrt(greatest(list_dot_product({signs(u)}, {signs(u)}), 1.0) * greatest(list_dot_product({signs(v)}, {signs(v)}), 1.0)))), 6) END"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM d WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 4) || substr(next_text, 1, length(text) // 4) AS edited FROM x),
t AS (SELECT doc_id, 0 AS kind, text AS body FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
p AS (SELECT doc_id, kind, md5(u) AS digest FROM (SELECT doc_id, kind, unnest(string_split({cut}, chr(10))) AS u FROM t) WHERE u <> ''),
h AS (SELECT doc_id, kind, CAST('0x' || substr(digest, 1, 15) AS BIGINT) AS a, CAST('0x' || substr(digest, 16, 15) AS BIGINT) AS b FROM p),
s AS (SELECT t.doc_id, t.kind, count(a) AS n, CAST(coalesce(sum(a), 0) % {m.NUMBER + 1} AS BIGINT) AS sa, CAST(coalesce(sum(b), 0) % {m.NUMBER + 1} AS BIGINT) AS sb, {lanes} FROM t LEFT JOIN h ON t.doc_id = h.doc_id AND t.kind = h.kind GROUP BY t.doc_id, t.kind),
f AS (SELECT doc_id, kind, [n, sa, sb, {names}] AS v FROM s),
j AS (SELECT e.doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, f0.v AS v, f1.v AS ve, f2.v AS vn FROM e JOIN f f0 ON f0.doc_id = e.doc_id AND f0.kind = 0 JOIN f f1 ON f1.doc_id = e.doc_id AND f1.kind = 1 JOIN f f2 ON f2.doc_id = e.next_id AND f2.kind = 0)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, edited_sha256, {text('v')} AS fingerprint, {text('ve')} AS edited_fingerprint, {near('v', 've')} AS near_edited, {near('v', 'vn')} AS near_next
FROM j"""


def _audit_sql() -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words FROM d),
good AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN good ON w.doc_id = good.doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, filter_order[step] AS here, filter_order[1:step - 1] AS before FROM o, range(1, 6) t(step) WHERE length(filter_order) = 5),
r AS (
  SELECT part, filter_order, step, here, n, good, toxic, fails, contains(fails, here) AS fails_here, regexp_matches(fails, '[' || before || '0]') AS gone
  FROM m, s),
a AS (
  SELECT part, filter_order, step, here, sum(CASE WHEN NOT gone AND NOT fails_here THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails_here THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND fails_here THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = here THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND fails_here THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails_here THEN toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, here)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, here) AS BIGINT) AS shapley
FROM a"""


def _negatives_sql() -> str:
    return """
WITH u AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM u a JOIN u r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3"""


def oracle_sql() -> dict[str, str]:
    return {"op2_pareto_mix": _mix_sql(), "op4_url_cascade": _url_sql(), "op5_chat_round_trip": _chat_sql(), "op8_line_windows": _lines_sql(), "op10_multiset_hash": _multiset_sql(), "op11_filter_audit": _audit_sql(), "op12_hard_negatives": _negatives_sql()}
