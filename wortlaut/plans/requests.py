"""Registered queries that prepare and read model requests made from conversations, texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wortlaut.operators import messages
from wortlaut.plans.common import Registry, page_docs, table, text_docs

registry = Registry()

_MODELS = (
    "gpt-4o", "GPT-3.5-turbo", "gpt-5", "claude-x", "Mistral-Small", "mistral-large", "mistral-7b", "qwen2", "llama-70b",
    "llama-8b", "gemma", "other",
)
_LENGTHS = (128000, 16385, 128000, 200000, 128000, 128000, 32000, 128000, 128000, 128000, 128000, 32000)


@registry.add(
    "i9_token_estimate",
    """WITH f AS (SELECT source, strlen('<text source="' || source || '" xml:lang="' || lang || '">' || chr(10) || '<p>' ||
      replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), chr(10), '</p>' || chr(10) || '<p>') || '</p>' || chr(10) || '</text>') AS b
      FROM documents)
    SELECT source AS subdir, CAST(sum(b) // 4 AS BIGINT) AS file_tokens, CAST(sum(b) // 4 + 100 AS BIGINT) AS total_tokens
    FROM f GROUP BY source""",
)
def i9(spark, sf_dir):
    docs = text_docs(spark, sf_dir).withColumn("subdir", F.split("subdir", "/")[0])
    return messages.token_estimate(docs, ("subdir",), history=F.lit(100))


_MODEL_SQL = f"""WITH m AS (SELECT doc_id, n_chars * 20 AS tokens, [{", ".join(f"'{m}'" for m in _MODELS)}][doc_id % 12 + 1] AS model,
  CASE WHEN doc_id % 5 = 0 THEN 8192 ELSE [{", ".join(map(str, _LENGTHS))}][doc_id % 12 + 1] END AS context_length FROM documents)"""


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(m) for m in _MODELS))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("n_chars") * 20).alias("tokens"), F.get(names, (F.col("doc_id") % 12).cast("int")).alias("model"),
        F.when(F.col("doc_id") % 5 == 0, 8192).otherwise(0).alias("reported"),
    )
    return rows.withColumn("context_length", messages.context_length(F.col("model"), F.col("reported")))


@registry.add(
    "i10_budget_flag",
    f"""{_MODEL_SQL} SELECT doc_id AS id, CASE WHEN tokens > context_length - 4096 THEN 'over'
      WHEN tokens > context_length * 0.75 THEN 'near' ELSE 'ok' END AS budget FROM m""",
)
def i10(spark, sf_dir):
    flag = messages.budget_flag(F.col("tokens"), F.col("context_length"))
    return _models(spark, sf_dir).select(F.col("doc_id").alias("id"), flag.alias("budget"))


@registry.add("i11_context_length", f"{_MODEL_SQL} SELECT doc_id AS id, model, CAST(context_length AS BIGINT) AS context_length FROM m")
def i11(spark, sf_dir):
    return _models(spark, sf_dir).select(F.col("doc_id").alias("id"), "model", "context_length")


_FILE_SQL = """'<file name="p' || page_id || '.xml" path="pages/p' || page_id || '.xml">' || chr(10) || html || chr(10) || '</file>'"""


@registry.add(
    "i12_context_block",
    f"""SELECT page_id % 10 AS selection, row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id) AS part_no,
      CASE WHEN page_id >= 10 THEN chr(10) || chr(10) ELSE '' END || {_FILE_SQL} AS part FROM pages
    UNION ALL SELECT page_id % 10, 0, '<context>' || chr(10) || 'Die folgenden XML-Dateien wurden vom Benutzer ausgewählt:'
      || chr(10) || chr(10) FROM pages GROUP BY page_id % 10
    UNION ALL SELECT page_id % 10, count(*) + 1, chr(10) || '</context>' FROM pages GROUP BY page_id % 10""",
)
def i12(spark, sf_dir):
    docs = page_docs(spark, sf_dir).withColumn("selection", F.col("doc_ord") % 10)
    return messages.context_block(docs, ("selection",))


_MESSAGES_SQL = """WITH head AS (
  SELECT conv_id, min(turn) FILTER (role <> 'system') AS turn, arg_min(text, turn) FILTER (role = 'system') AS prompt
  FROM conversations GROUP BY conv_id),
msg AS (
  SELECT c.conv_id, c.turn, role, CASE WHEN role = 'user' AND prompt IS NOT NULL THEN prompt || chr(10) || chr(10) || text
    ELSE text END AS content
  FROM conversations c LEFT JOIN head h ON c.conv_id = h.conv_id AND c.turn = h.turn WHERE role <> 'system')"""


@registry.add("i13_build_messages", f"{_MESSAGES_SQL} SELECT * FROM msg")
def i13(spark, sf_dir):
    return messages.build_messages(table(spark, sf_dir, "conversations"))


@registry.add(
    "i13_with_context",
    """WITH head AS (SELECT conv_id, min(turn) AS first FROM conversations WHERE role <> 'system' GROUP BY conv_id)
    SELECT conv_id, turn, role, CASE WHEN role = 'user' AND turn = first THEN 'Antworte kurz.' || chr(10) || chr(10) ELSE '' END
      || CASE WHEN role = 'user' AND turn % 2 = 0 AND turn > 0 THEN '<context>' || conv_id || '</context>' || chr(10) || chr(10)
        ELSE '' END || text AS content
    FROM conversations JOIN head USING (conv_id) WHERE role <> 'system'""",
)
def i13_context(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations")
    contexts = talks.filter("role = 'user' AND turn % 2 = 0 AND turn > 0").select(
        "conv_id", "turn", F.concat(F.lit("<context>"), "conv_id", F.lit("</context>")).alias("block")
    )
    return messages.build_messages(talks, contexts, system="Antworte kurz.")


def _payload_sql(head: str, tail: str) -> str:
    return f"""{_MESSAGES_SQL}, latest AS (SELECT conv_id, max(turn) AS turn FROM msg WHERE role = 'user' GROUP BY conv_id),
    sent AS (SELECT m.conv_id, l.turn, CAST(sum(strlen(content)) // 4 AS BIGINT) AS tokens, '{{"model":"m",{head}"messages":' ||
      CAST(to_json(list({{'role': role, 'content': content}} ORDER BY m.turn)) AS VARCHAR) || '{tail}}}' AS payload
    FROM msg m JOIN latest l ON m.conv_id = l.conv_id AND m.turn <= l.turn GROUP BY m.conv_id, l.turn)
    SELECT *, CASE WHEN tokens > 32000 - 4096 THEN 'over' WHEN tokens > 24000 THEN 'near' ELSE 'ok' END AS budget FROM sent"""


def _payloads(provider: str):
    def query(spark, sf_dir):
        return messages.request_payloads(messages.build_messages(table(spark, sf_dir, "conversations")), provider, "m")

    return query


for _name, _head, _tail in (("openai", "", ""), ("ollama", "", ',"stream":false'), ("anthropic", '"max_tokens":4096,', "")):
    registry.add(f"i14_requests_{_name}", _payload_sql(_head, _tail))(_payloads(_name))


_IMAGE_SQL = {
    "openai": """'{"model":"m","messages":[{"role":"user","content":[{"type":"image_url","image_url":{"url":"data:image/png;base64,'
      || base64(encode(html)) || '"}},{"type":"text","text":"Lies"}]}]}'""",
    "anthropic": """'{"model":"m","max_tokens":4096,"messages":[{"role":"user","content":[{"type":"image","source":{"type":"base64",'
      || '"media_type":"image/png","data":"' || base64(encode(html)) || '"}},{"type":"text","text":"Lies"}]}]}'""",
    "ollama": """'{"model":"m","messages":[{"role":"user","content":"Lies","images":["' || base64(encode(html)) ||
      '"]}],"stream":false}'""",
}


def _images(provider: str):
    def query(spark, sf_dir):
        pages = page_docs(spark, sf_dir).select("filename", F.lit("image/png").alias("media_type"), "content")
        return messages.image_payloads(pages, provider, "m", "Lies").drop("media_type")

    return query


for _name, _sql in _IMAGE_SQL.items():
    registry.add(f"i14_images_{_name}", f"SELECT 'p' || page_id || '.xml' AS filename, {_sql} AS payload FROM pages")(_images(_name))


def _body(provider: str):
    text, turn = F.col("text"), F.col("turn")
    if provider == "openai":
        choice = F.struct(F.struct(text.alias("content")).alias("message"))
        return F.struct(F.array(choice).alias("choices"), F.struct((turn + 7).alias("total_tokens")).alias("usage"))
    if provider == "ollama":
        return F.struct(
            F.struct(text.alias("content")).alias("message"), turn.alias("prompt_eval_count"), F.lit(7).alias("eval_count")
        )
    blocks = [("text", text), ("tool_use", F.lit("-")), ("text", F.lit("!"))]
    return F.struct(
        F.array(*(F.struct(F.lit(k).alias("type"), t.alias("text")) for k, t in blocks)).alias("content"),
        F.struct(turn.alias("input_tokens"), F.lit(7).alias("output_tokens")).alias("usage"),
    )


def _completions(provider: str):
    def query(spark, sf_dir):
        rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(_body(provider)).alias("body"))
        return messages.parse_completions(rows, provider)

    return query


for _name, _end in (("openai", ""), ("ollama", ""), ("anthropic", " || '!'")):
    registry.add(
        f"i15_completions_{_name}", f"SELECT conv_id, turn, text{_end} AS text, turn + 7 AS total_tokens FROM conversations"
    )(_completions(_name))


@registry.add(
    "i15_model_list",
    """SELECT 's' || s_suppkey AS model, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 1000 ELSE 0 END AS context_length FROM supplier
    UNION ALL SELECT 'n' || s_suppkey, 0 FROM supplier""",
)
def i15_models(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    first = rows.selectExpr(
        """to_json(struct(array(struct(concat('s', s_suppkey) AS id,
        CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey + 1000 ELSE 0 END AS loaded_context_length,
        CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 1000 END AS max_context_length)) AS data)) AS body"""
    )
    second = rows.selectExpr("to_json(struct(array(struct(concat('n', s_suppkey) AS name), struct('' AS name)) AS models)) AS body")
    return messages.parse_models(first.unionByName(second))


_ERROR_SQL = """CASE event_type WHEN 'click' THEN 'ConnectError: ' WHEN 'view' THEN 'Read Timeout ' WHEN 'error' THEN 'HTTP 404 timeout '
  ELSE 'ValueError ' END || 'x' || event_id"""


@registry.add(
    "i16_error_classes",
    """WITH e AS (SELECT event_id, event_type, contains(event_id::VARCHAR, '404') AS has_404 FROM events)
    SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'connection' WHEN event_type = 'error' OR has_404 THEN 'model_not_found'
        WHEN event_type = 'view' THEN 'timeout' ELSE 'other' END AS text_class,
      CASE WHEN event_type = 'click' THEN 'connection' WHEN event_type IN ('view', 'error') THEN 'timeout'
        WHEN has_404 THEN 'model_not_found' ELSE 'other' END AS image_class
    FROM e""",
)
def i16(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("message", F.expr(_ERROR_SQL))
    return rows.select(
        F.col("event_id").alias("id"), messages.classify_error(F.col("message")).alias("text_class"),
        messages.classify_error(F.col("message"), images=True).alias("image_class"),
    )


@registry.add(
    "i17_image_intake",
    """WITH f AS (SELECT page_id % 9 AS batch, 'p' || page_id || CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.png'
        ELSE '.gif' END AS path, row_number() OVER (PARTITION BY page_id % 9 ORDER BY page_id) - 1 AS place, strlen(html) AS size,
        CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' ELSE 'image/png' END AS media_type FROM pages)
    SELECT *, 'ready' AS status, '' AS error FROM f WHERE place < 10""",
)
def i17(spark, sf_dir):
    ending = "CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.png' ELSE '.gif' END"
    files = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "page_id % 9 AS batch", f"concat('p', page_id, {ending}) AS path", "cast(html AS binary) AS content"
    )
    return messages.image_intake(files, "page_id", ("batch",))


@registry.add(
    "i17_joined_pages",
    """SELECT 'k' || page_id % 40 AS item, count(*) AS pages, string_agg(url, chr(10) || chr(10) ORDER BY page_id) AS text
    FROM pages GROUP BY page_id % 40""",
)
def i17_pages(spark, sf_dir):
    answers = table(spark, sf_dir, "pages").selectExpr("concat('k', page_id % 40) AS item", "page_id AS page_no", "url AS text")
    return messages.joined_pages(answers)


@registry.add(
    "i17_page_requests",
    f"""SELECT 'k' || page_id % 40 AS item, page_id AS page_no, {_IMAGE_SQL["openai"]} AS payload FROM pages""",
)
def i17_requests(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").selectExpr(
        "concat('k', page_id % 40) AS item", "page_id AS page_no", "'image/png' AS media_type", "cast(html AS binary) AS content"
    )
    return messages.page_requests(pages, "openai", "m", "Lies")


def _answer(payload: str) -> str:
    if payload.startswith("E"):
        raise ConnectionError("no server")
    return payload[::-1]


@registry.add(
    "i18_complete_batch",
    """SELECT conv_id, turn, CASE WHEN starts_with(text, 'E') THEN NULL ELSE reverse(text) END AS body,
      CASE WHEN starts_with(text, 'E') THEN 'ConnectionError: no server' END AS error,
      CASE WHEN starts_with(text, 'E') THEN 'connection' END AS error_class FROM conversations""",
)
def i18(spark, sf_dir):
    requests = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("payload"))
    return messages.complete_batch(requests, _answer)


@registry.add(
    "i19_usage",
    """SELECT conv_id, arg_max(len(text), turn) AS tokens_used_last, arg_max(len(text), turn) AS tokens_used_total
    FROM conversations WHERE role = 'assistant' AND len(text) > 0 GROUP BY conv_id""",
)
def i19(spark, sf_dir):
    calls = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return messages.usage(calls.select("conv_id", "turn", F.length("text").cast("long").alias("total_tokens")))
