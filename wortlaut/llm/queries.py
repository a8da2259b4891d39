"""The registered queries of this folder, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wortlaut.llm.exact_dedup import mark_copies
from wortlaut.llm.fill_in_middle import fill_in_middle, restore
from wortlaut.llm.mixing import draw_mix
from wortlaut.llm.neighbours import nearest
from wortlaut.llm.packing import pack
from wortlaut.llm.pii import find_personal_data
from wortlaut.llm.prefix_trie import prefix_trie
from wortlaut.llm.quality import score_quality
from wortlaut.llm.rules import apply_rules
from wortlaut.llm.secrets import find_secrets
from wortlaut.llm.shared import scratch_path
from wortlaut.llm.simhash import near_groups
from wortlaut.llm.token_store import TokenStore
from wortlaut.llm.url_filter import judge_urls, rule_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, oracle: str | None = None):
    def register(query):
        QUERIES[name] = query
        if oracle:
            ORACLES[name] = oracle
        return query

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS content FROM documents),
g AS (SELECT content, max(doc_id) AS keep_id, count(*) AS group_size, sha256(content) AS text_sha256
      FROM d GROUP BY content)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, keep_id IS NULL) AS kept, text_sha256
FROM d JOIN g USING (content)
"""


@_add("op1_exact_dedup", _OP1)
def op1(spark, sf_dir):
    return mark_copies(_table(spark, sf_dir, "documents"))


#: The rules of the query: (action, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

_OP2 = f"""
WITH p AS (SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(action, rule_host, rule_path) AS (VALUES {", ".join(map(str, URL_RULES))}),
m AS (SELECT page_id, host, path, r.*, row_number() OVER (PARTITION BY page_id, host, path
        ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS n
      FROM u LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(action, 'allow') AS verdict FROM m WHERE n = 1
"""


@_add("op2_url_filter", _OP2)
def op2(spark, sf_dir):
    return judge_urls(_table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


@_add("op3_simhash_near_dedup")
def op3(spark, sf_dir):
    return near_groups(_table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@_add("op4_token_store")
def op4(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    store = TokenStore.write(docs, scratch_path(spark, "tokens"), vocabulary("byte_bpe_50k.json"), end_id=2)
    return store.summary().withColumnRenamed("key", "doc_id")


@_add("op5_best_fit_packing")
def op5(spark, sf_dir):
    return pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


@_add("op6_personal_data")
def op6(spark, sf_dir):
    return find_personal_data(_table(spark, sf_dir, "documents"))


_OP7 = r"""
WITH d AS (SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4) AS BIGINT) % 64, 0) AS part FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight,
    3 * source_size AS stop FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS BIGINT)
    - CAST(coalesce(sum(stop) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
    / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM w WINDOW o AS (ORDER BY stop / weight, source NULLS LAST)),
t AS (SELECT source, source_size, least(CAST(stop AS DOUBLE), max(level) OVER () * weight) AS target,
    CAST('0x' || substr(md5('mix:' || coalesce(source, chr(10))), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM l),
p AS (SELECT d.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY size, part, doc_id NULLS FIRST) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(floor(rate * place + u) - floor(rate * (place - 1) + u) AS BIGINT) * size AS taken FROM p
"""


@_add("op7_mix_sources", _OP7)
def op7(spark, sf_dir):
    return draw_mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_add("op8_quality_ranking")
def op8(spark, sf_dir):
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_add("op9_quality_rules")
def op9(spark, sf_dir):
    return apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_add("op10_secret_scan")
def op10(spark, sf_dir):
    return find_secrets(_table(spark, sf_dir, "documents"))


_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digits FROM documents),
h AS (SELECT doc_id, text, units, len(units) AS n,
    CAST('0x' || substr(digits, 1, 8) AS BIGINT) % (len(units) + 1) AS x,
    CAST('0x' || substr(digits, 9, 8) AS BIGINT) % (len(units) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
              OR CAST('0x' || substr(digits, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
         WHEN CAST('0x' || substr(digits, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(units[:least(x, y)], '') AS prefix,
    array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS middle,
    array_to_string(units[greatest(x, y) + 1:], '') AS suffix FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form != 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form != 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""


@_add("op11_fill_in_middle", _OP11)
def op11(spark, sf_dir):
    arranged = fill_in_middle(_table(spark, sf_dir, "documents"))
    text = restore(F.col("output"), F.col("form"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256")
    return arranged.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


# The checksum of an id is worked out bit by bit: only its last two bits count, so the rest is left to the loop.
_OP12 = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, max(place) AS own, c - c % 20 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''),
          lambda x: CAST(ascii(x) AS BIGINT))),
        lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
          lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384::BIGINT) ELSE s // 2 END)),
      4294967295::BIGINT) % 4 AS h FROM t GROUP BY c),
k AS (SELECT l.*, least(l.h, coalesce(b.own, 0)) AS taken FROM l LEFT JOIN l AS b ON b.c = l.base),
r AS (SELECT k.c, t.place AS depth, role, said FROM k JOIN t ON t.c = k.base AND t.place <= k.taken
  UNION ALL SELECT k.c, t.place - k.h + k.taken, role, said FROM k JOIN t ON t.c = k.c AND t.place > k.h),
s AS (SELECT c, depth, string_agg(length(role) || ':' || length(said) || ':' || role || said, '')
        OVER (PARTITION BY c ORDER BY depth) AS path,
    len(regexp_extract_all(said, '[^\x20\x09-\x0D]+')) AS words FROM r
  UNION ALL SELECT c, 0, '', 0 FROM k),
p AS (SELECT *, min(c) OVER (PARTITION BY depth, path) AS rep, max(depth) OVER (PARTITION BY c) AS longest FROM s),
n AS (SELECT depth, rep, count(*) AS n_convs, max(words) AS words, max(longest) = depth AS leaf,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (depth = longest), '')) AS ends_sha256
  FROM p GROUP BY depth, rep),
u AS (SELECT a.depth, a.rep, sum(CAST(n.leaf AS BIGINT)) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM n JOIN p AS a ON a.c = n.rep AND a.depth <= n.depth GROUP BY a.depth, a.rep),
e AS (SELECT n.depth, n.rep, a.rep AS parent FROM n JOIN p AS a ON a.c = n.rep AND a.depth = n.depth - 1),
m AS (SELECT depth - 1 AS depth, parent AS rep, count(*) AS n_children FROM e GROUP BY ALL)
SELECT rep AS conv_id, CAST(depth AS BIGINT) AS depth, parent AS parent_conv_id, n_convs,
  CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM n JOIN u USING (depth, rep) LEFT JOIN e USING (depth, rep) LEFT JOIN m USING (depth, rep)
"""


@_add("op12_prefix_trie", _OP12)
def op12(spark, sf_dir):
    return prefix_trie(_table(spark, sf_dir, "conversations"))


@_add("op13_nearest_neighbours")
def op13(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors.filter("vec_id % 20 = 0"), vectors)
