"""The thin queries that apply each operator to its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, html_extract, line_dedup, merkle, mixing, pivot_index, resample, simhash, suffix_dedup, toxicity, url_filter
from .common import md5_number, table

LINE_RATIO, LINE_MIN_PAGES = 0.1, 10


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=4, bits=4)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), ratio=LINE_RATIO, min_pages=LINE_MIN_PAGES).select("doc_id", "text", "n_lines", "n_dropped")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"), within=True).withColumnsRenamed({"first_id": "first_doc_id"})


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("__spans", lambda s: s["item_id"])))
    return found.select("doc_id", (F.size("__spans") > 0).alias("contaminated"), items.alias("item_ids"), F.size(items).cast("long").alias("n_items"))


#: A conversation that says the template's own marks.
MARKED = "</s>[INST] ok [/INST]"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    marked = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(MARKED).alias("text"))
    chats = chat.read_back(chat.format_chats(turns.unionByName(marked)))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_texts(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), F.when(F.col("__score") >= 0.5, 1).otherwise(0).alias("predicted"), F.col("__sentences").alias("offending_sentences"))


def url_lists(hosts: DataFrame) -> DataFrame:
    """Dated list entries for the tables, which hold none: by a rule, about a third of the hosts and of their parent domains are listed, some taken off again, some listed twice."""
    parent = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    names = hosts.select(F.col("host").alias("domain")).unionByName(hosts.select(parent.alias("domain"))).where("domain <> ''").distinct()
    h = md5_number(F.col("domain"))
    names = names.withColumn("h", h).where("h % 3 = 0").withColumn("day", (F.col("h") % 200).cast("int"))
    category = F.when(F.col("h") % 2 == 0, "spam").otherwise("adult")
    day = lambda n: F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("day") + n) * 86_400)
    steps = [(F.lit(True), "add", 0), (F.col("h") % 2 == 0, "remove", 60), (F.col("h") % 4 == 0, "add", 120)]
    entries = [F.when(c, F.struct(F.lit(a).alias("action"), day(n).alias("listed_at"))) for c, a, n in steps]
    return names.select("domain", category.alias("category"), F.explode(F.array_compact(F.array(*entries))).alias("e")).select("domain", "category", "e.action", "e.listed_at")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages, fetched by a rule at some second of 2024; see url_lists."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.col("page_id") * 7_919_993, F.lit(366 * 86_400)))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", at.alias("fetched_at"))
    hosts = captures.select(url_filter.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    return url_filter.filter_urls(captures, url_lists(hosts))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return pivot_index.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of a third of the rows, by a hash of the identifier, are tampered with: their capitals become small."""
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    small = F.when(touched, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))
    _, proofs = merkle.merkle_manifest(table(spark, sf_dir, "documents"), changed={"text": small})
    return proofs


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_html_extraction, op3_mixing, op4_simhash, op5_line_dedup, op6_suffix_dedup, op7_decontamination, op8_chat_formatting, op9_toxicity, op10_url_filter, op11_importance_resampling, op12_topk_search, op13_merkle_manifest)}

_ESCAPED = "replace({}, chr(92), chr(92) || chr(92))"
for _m in [m for o, c, _ in chat.TEMPLATE.values() for m in (o, c)] + list(chat.OTHER):
    _ESCAPED = f"replace({_ESCAPED}, '{_m}', '{_m[0]}' || chr(92) || '{_m[1:]}')"
_TURN_CHARS = f"length({_ESCAPED.format('text')}) + CASE role " + " ".join(f"WHEN '{r}' THEN {len(o) + len(c)}" for r, (o, c, _) in chat.TEMPLATE.items()) + f" ELSE {sum(map(len, chat.OTHER))} + length({_ESCAPED.format('role')}) END"

#: CRC-32 in SQL: the table of the polynomial's rule, and the reduction of a text's bytes by it.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_BYTES = "list_transform(range(octet_length(encode({0}))), lambda i: CAST('0x' || substr(hex(encode({0})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
_CRC = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {_BYTES}), lambda c, b: xor(c >> 8, crc[CAST(xor(c & 255, b) + 1 AS BIGINT)])), 4294967295)"


def _tree_sql(name: str, leaves: str, depth: int) -> str:
    """Levels name0 to name<depth> of the trees of leaves(g, idx, d); of each node its run's digests on both sides, and the nodes of its level."""
    run = f"PARTITION BY g, idx // {merkle.FAN_OUT} ORDER BY idx ROWS BETWEEN"
    sides = f"""coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after, count(*) OVER (PARTITION BY g) AS n"""
    out = [f"{name}0 AS (SELECT *, {sides} FROM ({leaves}))"]
    for k in range(depth):
        up = f"SELECT g, idx // {merkle.FAN_OUT} AS idx, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY idx)) END AS d FROM {name}{k} GROUP BY g, idx // {merkle.FAN_OUT}"
        out.append(f"{name}{k + 1} AS (SELECT *, {sides} FROM ({up}))")
    return ",\n".join(out)


def _fold_sql(first: str, name: str, depth: int) -> str:
    for k in range(depth):
        first = f"CASE WHEN {name}{k}.n = 1 THEN {first} ELSE sha256({name}{k}.before || {first} || {name}{k}.after) END"
    return first


_DEPTH, _ABOVE = 7, 2  # enough for 8^7 rows of a language and 64 languages
_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_SMALL = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_JOINS = "\n".join(f"JOIN t{k} ON t{k}.g = t0.g AND t{k}.idx = t0.idx // {merkle.FAN_OUT**k}" for k in range(1, _DEPTH)) + f" JOIN t{_DEPTH} ON t{_DEPTH}.g = t0.g JOIN r0 ON r0.name = t0.g " + " ".join(f"JOIN r{k} ON r{k}.idx = r0.idx // {merkle.FAN_OUT**k}" for k in range(1, _ABOVE + 1))
_SIBLINGS = " || ".join(f"{x}{k}.before || {x}{k}.after" for x, n in (("t", _DEPTH), ("r", _ABOVE)) for k in range(n))

ORACLES = {
    "op1_exact_dedup": """
WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS s FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM h""",
    "op3_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, length(coalesce(text, '')) AS n_chars,
         (CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u
  FROM documents),
k AS (SELECT *, -ln(CAST(u AS DOUBLE)) / CASE WHEN n_chars BETWEEN size * 2 AND size * 12 THEN 1.0 ELSE 0.5 END AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
c AS (SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST) AS nth FROM p),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER w, 0) AS DOUBLE) / CAST((SELECT sum(weight) FROM p) - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS own
      FROM c WINDOW w AS (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * (SELECT max(own) FROM l)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs,
             CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) % source_size ELSE 0 END AS rest FROM t)
SELECT doc_id, size, source_size, target,
       CAST(size * epochs + least(size, greatest(0, rest - coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source""",
    "op5_line_dedup": f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth FROM documents),
n AS (SELECT source, count(*) AS pages FROM documents GROUP BY source HAVING count(*) >= {LINE_MIN_PAGES}),
b AS (SELECT l.source, line FROM l JOIN n ON l.source IS NOT DISTINCT FROM n.source WHERE line <> '' GROUP BY l.source, line HAVING count(DISTINCT doc_id) > {LINE_RATIO} * any_value(pages)),
j AS (SELECT l.*, b.line IS NOT NULL AS out FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line)
SELECT d.doc_id, CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(j.line, chr(10) ORDER BY nth) FILTER (NOT out), '') END AS text,
       CASE WHEN any_value(d.text) IS NULL THEN 0 ELSE count(*) END AS n_lines, CAST(sum(CAST(out AS INT)) AS BIGINT) AS n_dropped
FROM documents d JOIN j USING (doc_id) GROUP BY d.doc_id""",
    "op8_chat_formatting": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{MARKED}' UNION ALL SELECT -1, 1, 'assistant', '{MARKED}'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS roles,
             CAST(sum({_TURN_CHARS}) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, regexp_full_match(roles, 's?(ua)+') AS valid FROM g""",
    "op10_url_filter": r"""
WITH c AS (SELECT page_id, url, nullif(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)', 1), '\.+$', '')), '') AS host,
                  TIMESTAMP '2024-01-01' + to_seconds((page_id * 7919993) % (366 * 86400)) AS fetched_at FROM pages),
n AS (SELECT host AS domain FROM c UNION SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM c),
h AS (SELECT domain, CAST('0x' || substr(md5(domain), 1, 8) AS BIGINT) AS h FROM n WHERE domain <> ''),
e AS (SELECT domain, h, h % 200 AS day, CASE WHEN h % 2 = 0 THEN 'spam' ELSE 'adult' END AS category FROM h WHERE h % 3 = 0),
v AS (SELECT domain, category, TIMESTAMP '2024-01-01' + to_days(CAST(day AS INT)) AS since, CASE WHEN h % 2 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(day AS INT) + 60) END AS until FROM e
      UNION ALL SELECT domain, category, TIMESTAMP '2024-01-01' + to_days(CAST(day AS INT) + 120), NULL FROM e WHERE h % 4 = 0),
m AS (SELECT page_id, v.*, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC, category) AS nth
      FROM c JOIN v ON (c.host = v.domain OR ends_with(c.host, '.' || v.domain)) AND since <= fetched_at AND (until IS NULL OR fetched_at < until))
SELECT c.page_id, c.url, c.host, c.fetched_at, m.domain IS NOT NULL AS blocked, m.domain, m.category, m.since AS listed_since
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.nth = 1""",
    "op11_importance_resampling": rf"""
WITH k AS (SELECT {_CRC_TABLE} AS crc),
a AS (SELECT doc_id, coalesce(text, '') AS text, false AS wanted FROM documents UNION ALL SELECT NULL, coalesce(text, ''), true FROM benchmark),
w AS (SELECT row_number() OVER () AS nth, doc_id, wanted, list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM a),
f AS (SELECT nth, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM w),
c AS (SELECT nth, feature, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT feature, {_CRC.format('feature')} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM f), k),
g AS (SELECT c.nth, bucket, wanted, CAST(sum(n) AS BIGINT) AS n FROM c JOIN b USING (feature) JOIN w USING (nth) GROUP BY ALL),
s AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (NOT wanted), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (wanted), 0) AS DOUBLE) AS t FROM g GROUP BY bucket),
v AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * ((SELECT sum(t) FROM s) + 10000)))) AS BIGINT) AS gain FROM s),
m AS (SELECT nth, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM g JOIN v USING (bucket) WHERE NOT wanted GROUP BY nth),
d AS (SELECT doc_id, nth, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
             CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS noise FROM w LEFT JOIN m USING (nth) WHERE NOT wanted),
r AS (SELECT nth, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank, count(*) OVER () AS n FROM d WHERE n_words >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM d LEFT JOIN r USING (nth)""",
    "op12_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "op13_merkle_manifest": f"""
WITH k AS (SELECT {_CRC_TABLE} AS crc),
l AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {_LEAF.format(text="text")} AS leaf, CASE WHEN {_CRC.format("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_LEAF.format(text=_SMALL)} END AS other FROM documents, k),
{_tree_sql("t", "SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS d, doc_id, other FROM l", _DEPTH)},
{_tree_sql("r", f"SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS idx, d, g AS name FROM t{_DEPTH}", _ABOVE)},
p AS (SELECT doc_id, t0.d AS leaf, t{_DEPTH}.d AS subroot, r{_ABOVE}.d AS root, sha256({_SIBLINGS}) AS proof_sha256, {_fold_sql("coalesce(other, t0.d)", "t", _DEPTH)} AS below, r0.idx AS nth FROM t0 {_JOINS}),
f AS (SELECT p.*, {_fold_sql("below", "r", _ABOVE)} AS folded_root FROM p JOIN r0 ON r0.idx = nth {" ".join(f"JOIN r{k} ON r{k}.idx = nth // {merkle.FAN_OUT**k}" for k in range(1, _ABOVE))})
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f""",
}
