"""The registered queries of this subpackage, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.chat import chat_digest
from plumbline.llm.collocations import collocations
from plumbline.llm.decontaminate import contamination
from plumbline.llm.exact_dedup import exact_dedup
from plumbline.llm.html_extract import extract_main_text
from plumbline.llm.jaccard_join import jaccard_groups
from plumbline.llm.lm_score import score_documents
from plumbline.llm.packing import pack
from plumbline.llm.prefix_trie import shared_head_trie
from plumbline.llm.quality import classify
from plumbline.llm.sharding import shard_records
from plumbline.llm.substring_dedup import substring_dedup
from plumbline.llm.url_filter import filter_urls

#: The rules that op7 is asked to judge by; fixed values of its contract.
URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]

#: The conversation that op11 formats besides the table's; a fixed value of its contract.
SELF_TEST = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(_table(spark, sf_dir, "documents"))
    return found.selectExpr("id AS doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, action string")
    return filter_urls(_table(spark, sf_dir, "pages"), rules)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(_table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.createDataFrame(SELF_TEST, "conv_id long, turn long, role string, text string")
    return chat_digest(rows.unionByName(own), public_tokenizers.path("byte_bpe_50k.json"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_head_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_packing": op4_packing,
    "op5_decontaminate": op5_decontaminate,
    "op6_lm_score": op6_lm_score,
    "op7_url_filter": op7_url_filter,
    "op8_html_extract": op8_html_extract,
    "op9_quality": op9_quality,
    "op10_sharding": op10_sharding,
    "op11_chat_format": op11_chat_format,
    "op12_collocations": op12_collocations,
    "op13_prefix_trie": op13_prefix_trie,
}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: DuckDB has no CRC: the table of its bytes, and the CRC of bytes in hexadecimal.
_CRC_TABLE = """(SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
                 FROM (SELECT unnest(range(256)) AS i))"""
_CRC = """xor(4294967295, list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda b: ('0x' || b)::BIGINT)),
            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"""
_HASH = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


def _shard_sql(shards: int) -> str:
    return f"""(SELECT arg_min(s, (-ln((('0x' || substr(md5(concat_ws('|', k, s::VARCHAR)), 1, 8))::BIGINT + 0.5) / 4294967296.0), s))
                FROM range({shards}) AS r(s))"""


ORACLE_SQL = {
    "op2_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
                   FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
             shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
             links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
             reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = other)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY 1""",
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER.format('text')}) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op5_decontaminate": f"""
        WITH words AS (
               SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
             item_words AS (
               SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
             windows AS (
               SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
               FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
             lengths AS (SELECT DISTINCT n FROM windows),
             places AS (
               SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n),
             found AS (
               SELECT doc_id, i, p.n, item_id FROM places p JOIN windows v ON v.n = p.n AND v.win = array_to_string(w[i:i + p.n - 1], ' ')),
             hit AS (
               SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY 1),
             items AS (
               SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
               FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_url_filter": """
        WITH p AS (
               SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
             r(rule, action, rhost, rpath) AS (VALUES
               ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
               ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
               ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
             best AS (
               SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action
               FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1)
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)""",
    "op10_sharding": f"""
        WITH t AS {_CRC_TABLE},
             crc AS (SELECT doc_id, text, {_CRC.format("coalesce(text, '')")} AS text_crc32 FROM documents, t),
             d AS (SELECT doc_id, doc_id::VARCHAR AS k, strlen(coalesce(text, '')) + 1 AS size, text_crc32 FROM crc),
             n AS (SELECT greatest(1, ceil(count(*) / 80000.0))::BIGINT AS buckets FROM documents),
             s AS (SELECT doc_id, size, text_crc32, {_shard_sql(8)} AS shard, {_shard_sql(9)} AS grown_shard, ({_HASH.format('k')}) % buckets AS bucket FROM d, n)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id) - 1 AS slot, grown_shard FROM s""",
    "op12_collocations": """
        WITH pieces AS (
               SELECT coalesce(lang, 'und') AS lang,
                      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
             w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
             grams AS (
               SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
               FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 4) AS ks(k) WHERE len(w) >= k)),
             f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
             sizes AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY 1),
             cuts AS (
               SELECT c.lang, c.k, c.phrase, c.f AS a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
               FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
               JOIN f x ON x.lang = c.lang AND x.k = j AND x.phrase = array_to_string(w[1:j], ' ')
               JOIN f y ON y.lang = c.lang AND y.k = c.k - j AND y.phrase = array_to_string(w[j + 1:], ' ')),
             scored AS (SELECT lang, k, phrase, any_value(a) AS a, min({'score': score, 'j': j, 'l': l, 'r': r}) AS s FROM cuts GROUP BY ALL),
             inner_ AS (
               SELECT lang, part, max(f) AS longer
               FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM (SELECT lang, f, string_split(phrase, ' ') AS w FROM f WHERE k = 3))
               GROUP BY 1, 2),
             kept AS (SELECT scored.* FROM scored LEFT JOIN inner_ i ON i.lang = scored.lang AND i.part = phrase WHERE longer IS NULL OR 100 * longer < 50 * a),
             ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY s.score DESC, a DESC, encode(phrase)) AS rank FROM kept)
        SELECT lang, rank, phrase, a, s.l AS l, s.r AS r, n, s.score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000""",
    "op13_prefix_trie": f"""
        WITH t AS {_CRC_TABLE},
             o AS (SELECT conv_id, md5(strlen(role) || ':' || role || text) AS k, strlen(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
                   FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
             ids AS (SELECT c, c - c % 5 AS base, {_CRC.format('c::VARCHAR')} % 9 AS h FROM (SELECT DISTINCT conv_id AS c FROM o), t),
             rebuilt AS (
               SELECT c, k, size, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d
               FROM (SELECT c, 0 AS part, p, k, size FROM ids JOIN o ON conv_id = base AND p <= h UNION ALL SELECT c, 1, p, k, size FROM ids JOIN o ON conv_id = c AND p > h)),
             paths AS (
               SELECT c, 0 AS d, '' AS path, NULL AS parent, 0 AS size FROM ids
               UNION ALL SELECT c, d, path, left(path, length(path) - 32), size
               FROM (SELECT c, d, size, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS path FROM rebuilt)),
             ends AS (SELECT c, max(d) AS d FROM paths GROUP BY 1),
             nodes AS (
               SELECT path, any_value(parent) AS parent, any_value(paths.d) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
                      sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE paths.d = e.d), '')) AS ends_sha256
               FROM paths JOIN (SELECT c, d FROM ends) e USING (c) GROUP BY path),
             kids AS (SELECT parent AS path, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
             below AS (
               SELECT n.path, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum(m.saved)::BIGINT AS saved_tokens
               FROM nodes n JOIN nodes m ON starts_with(m.path, n.path) LEFT JOIN kids k ON k.path = m.path GROUP BY 1)
        SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
        FROM nodes n JOIN below b ON b.path = n.path LEFT JOIN nodes p ON p.path = n.parent LEFT JOIN kids k ON k.path = n.path""",
}
