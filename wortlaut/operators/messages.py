"""Requests to language models as rows: size estimates, context blocks, message histories, payloads, answers.

No server is called.  ``complete_batch`` runs a function of the caller over request rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wortlaut.functions.ordering import with_position

# Token arithmetic, request and image limits, fallback context lengths by model family.
BYTES_PER_TOKEN = 4
RESPONSE_RESERVE_TOKENS = 4_096
WARN_THRESHOLD = 0.75
MAX_RESPONSE_TOKENS = 4096
MAX_IMAGES = 10
MAX_IMAGE_BYTES = 5 * 1024 * 1024
DEFAULT_CONTEXT_LENGTH = 32_000
CONTEXT_LENGTHS = (
    (("gpt-4",), 128_000),
    (("gpt-3.5",), 16_385),
    (("gpt-5",), 128_000),
    (("claude",), 200_000),
    (("mistral", "small"), 128_000),
    (("mistral", "large"), 128_000),
    (("mistral",), 32_000),
    (("qwen",), 128_000),
    (("llama",), 128_000),
    (("gemma",), 128_000),
)
CONTEXT_HEAD = "<context>\nDie folgenden XML-Dateien wurden vom Benutzer ausgewählt:\n\n"
CONTEXT_TAIL = "\n</context>"
CONTEXT_SEPARATOR = "\n\n"


def token_estimate(docs: DataFrame, group: tuple[str, ...] = (), history: Column | None = None) -> DataFrame:
    """Tokens of the selected files, and with the history added: the total size divided once, not file by file."""
    sized = docs.groupBy(*group).agg(F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("_bytes"))
    files = F.floor(F.col("_bytes") / BYTES_PER_TOKEN).cast("long")
    total = files if history is None else files + history
    return sized.select(*group, files.alias("file_tokens"), total.alias("total_tokens"))


def budget_flag(tokens: Column, context_length: Column) -> Column:
    """'over', 'near' or 'ok'; an unknown context length (0) never warns."""
    limit = context_length - RESPONSE_RESERVE_TOKENS
    return (
        F.when(context_length <= 0, "ok")
        .when(tokens > limit, "over")
        .when(tokens > context_length * WARN_THRESHOLD, "near")
        .otherwise("ok")
    )


def context_length(model: Column, reported: Column | None = None) -> Column:
    """The reported length if there is one, else that of the first model family the name fits."""
    name = F.lower(model)
    known = F.lit(DEFAULT_CONTEXT_LENGTH)
    for words, length in reversed(CONTEXT_LENGTHS):
        fits = F.contains(name, F.lit(words[0]))
        for word in words[1:]:
            fits &= F.contains(name, F.lit(word))
        known = F.when(fits, length).otherwise(known)
    return known if reported is None else F.when(reported > 0, reported).otherwise(known)


def parse_models(responses: DataFrame) -> DataFrame:
    """Model names and reported context lengths (0 = not reported) from model list responses ``(body)``."""
    schema = (
        "data array<struct<id:string,loaded_context_length:long,max_context_length:long>>,"
        "models array<struct<name:string>>"
    )
    parsed = responses.select(F.from_json("body", schema).alias("r"))
    listed = F.transform(
        "r.data",
        lambda m: F.struct(
            m["id"].alias("model"),
            F.coalesce(F.nullif(m["loaded_context_length"], F.lit(0)), m["max_context_length"], F.lit(0)).alias(
                "context_length"
            ),
        ),
    )
    named = F.transform("r.models", lambda m: F.struct(m["name"].alias("model"), F.lit(0).cast("long").alias("context_length")))
    return parsed.select(F.explode(F.coalesce(listed, named)).alias("m")).select("m.*").filter(F.col("model") != "")


def context_parts(docs: DataFrame) -> DataFrame:
    """Each document wrapped for a prompt; one that is not UTF-8 leaves an error mark."""
    text = F.col("content").cast("string")
    name = F.concat(F.lit('<file name="'), "filename")
    good = F.concat(name, F.lit('" path="'), "subdir", F.lit("/"), "filename", F.lit('">\n'), text, F.lit("\n</file>"))
    bad = F.concat(name, F.lit('" error="true">\nFehler beim Lesen: kein UTF-8\n</file>'))
    return docs.withColumn("part", F.when(F.is_valid_utf8(text), good).otherwise(bad)).drop("content")


def context_block(docs: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """The context block of each group of documents as its parts in order: ``(group, part_no, part)``.

    Part 0 is the head, then comes one part per document, then the tail; joined as they are they make up the block.  So
    a selection of any size has one shape, and no task holds more than one document of it.
    """
    parts = with_position(context_parts(docs), "doc_ord", "_place", group)
    between = F.when(F.col("_place") > 0, CONTEXT_SEPARATOR).otherwise("")
    files = parts.select(*group, (F.col("_place") + 1).alias("part_no"), F.concat(between, "part").alias("part"))
    count = docs.groupBy(*group).agg(F.count(F.lit(1)).alias("_files")).filter(F.col("_files") > 0)
    ends = F.array(
        F.struct(F.lit(0).cast("long").alias("part_no"), F.lit(CONTEXT_HEAD).alias("part")),
        F.struct((F.col("_files") + 1).alias("part_no"), F.lit(CONTEXT_TAIL).alias("part")),
    )
    return files.unionByName(count.select(*group, F.explode(ends).alias("e")).select(*group, "e.*"))


def joined_blocks(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``(keys, block)``: the parts of each block as one text, for a block that goes into one message."""
    ordered = F.array_sort(F.collect_list(F.struct("part_no", "part")))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p["part"]), "").alias("block"))


def build_messages(conversations: DataFrame, contexts: DataFrame | None = None, system: str | None = None) -> DataFrame:
    """Message rows ``(conv_id, turn, role, content)`` as they are sent.

    ``contexts(conv_id, turn, block)`` goes in front of the user message of its turn.  The system prompt, ``system`` or
    the conversation's own system turn, goes in front of the first user message, if no answer precedes it; system turns
    are not sent.  The head of a conversation is an aggregate and joined by (conversation, turn), so a very long
    conversation is no hot key.
    """
    spoken = conversations.filter(F.col("role") != "system")
    heads = spoken.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    if system is None:
        prompts = conversations.filter(F.col("role") == "system").groupBy("conv_id")
        heads = heads.join(prompts.agg(F.min_by("text", "turn").alias("_prompt")), "conv_id")
    else:
        heads = heads.withColumn("_prompt", F.lit(system))
    rows = spoken.join(heads, ["conv_id", "turn"], "left")
    content = F.col("text")
    if contexts is not None:
        rows = rows.join(contexts.select("conv_id", "turn", "block"), ["conv_id", "turn"], "left")
        content = F.when(F.coalesce("block", F.lit("")) != "", F.concat("block", F.lit("\n\n"), content)).otherwise(content)
    content = F.when(
        (F.col("role") == "user") & (F.coalesce("_prompt", F.lit("")) != ""),
        F.concat("_prompt", F.lit("\n\n"), content),
    ).otherwise(content)
    return rows.select("conv_id", "turn", "role", content.alias("content"))


def _payload(model: str, messages: Column, provider: str, max_tokens: int = MAX_RESPONSE_TOKENS) -> Column:
    fields = [F.lit(model).alias("model")]
    if provider == "anthropic":
        fields.append(F.lit(max_tokens).alias("max_tokens"))
    fields.append(messages.alias("messages"))
    if provider == "ollama":
        fields.append(F.lit(False).alias("stream"))
    elif provider not in ("openai", "anthropic"):
        raise ValueError(f"unknown provider: {provider}")
    return F.to_json(F.struct(*fields))


def request_payloads(messages: DataFrame, provider: str, model: str, length: Column | None = None) -> DataFrame:
    """The request of each conversation's latest user turn, with its whole history, in the provider's JSON shape:
    ``(conv_id, turn, tokens, budget, payload)``.

    What follows the last user turn is not sent; a conversation without one asks nothing.  Requests are never cut:
    ``tokens`` estimates their size, and ``budget`` tells whether that fits the context ``length`` (by default that of
    the model's family).
    """
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("turn")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("_turns")
    grouped = messages.groupBy("conv_id").agg(last, turns).filter(F.col("turn").isNotNull())
    grouped = grouped.withColumn("_turns", F.filter("_turns", lambda m: m["turn"] <= F.col("turn")))
    size = F.aggregate("_turns", F.lit(0).cast("long"), lambda n, m: n + F.coalesce(F.octet_length(m["content"]), F.lit(0)))
    listed = F.transform("_turns", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    tokens = F.floor(size / BYTES_PER_TOKEN).cast("long")
    limit = context_length(F.lit(model)) if length is None else length
    sized = grouped.withColumn("tokens", tokens)
    return sized.select(
        "conv_id", "turn", "tokens", budget_flag(F.col("tokens"), limit).alias("budget"),
        _payload(model, listed, provider).alias("payload"),
    )


def page_requests(pages: DataFrame, provider: str, model: str, prompt: str) -> DataFrame:
    """One request per page of an image item: ``pages(item, page_no, media_type, content)`` → ``(item, page_no,
    payload)``."""
    return image_payloads(pages.select("item", "page_no", "media_type", "content"), provider, model, prompt).drop("media_type")


def joined_pages(answers: DataFrame, separator: str = "\n\n") -> DataFrame:
    """The texts ``(item, page_no, text)`` of an item's pages joined in page order: ``(item, pages, text)``."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))))
    return answers.groupBy("item").agg(ordered.alias("_p")).select(
        "item", F.size("_p").cast("long").alias("pages"), F.array_join(F.transform("_p", lambda p: p["text"]), separator).alias("text")
    )


def image_payloads(pages: DataFrame, provider: str, model: str, prompt: str) -> DataFrame:
    """Image requests: ``pages(…, media_type, content)`` → the same rows with ``payload`` instead of the bytes."""
    data = F.translate(F.base64(F.col("content")), "\r\n", "")  # some settings break the text into lines
    ask = F.struct(F.lit("text").alias("type"), F.lit(prompt).alias("text"))
    user = F.lit("user").alias("role")
    if provider == "ollama":
        message = F.struct(user, F.lit(prompt).alias("content"), F.array(data).alias("images"))
        payload = _payload(model, F.array(message), provider)
    else:
        # the two content entries have different fields, so the list is put together from two JSON texts
        if provider == "anthropic":
            source = F.struct(F.lit("base64").alias("type"), F.col("media_type"), data.alias("data"))
            image = F.to_json(F.struct(F.lit("image").alias("type"), source.alias("source")))
        elif provider == "openai":
            url = F.concat(F.lit("data:"), "media_type", F.lit(";base64,"), data)
            image = F.to_json(F.struct(F.lit("image_url").alias("type"), F.struct(url.alias("url")).alias("image_url")))
        else:
            raise ValueError(f"unknown provider: {provider}")
        content = F.concat(F.lit("["), image, F.lit(","), F.to_json(ask), F.lit("]"))
        fields = [F.lit(model).alias("model")]
        if provider == "anthropic":
            fields.append(F.lit(MAX_RESPONSE_TOKENS).alias("max_tokens"))
        head = F.rtrim(F.to_json(F.struct(*fields)), F.lit("}"))
        payload = F.concat(head, F.lit(',"messages":[{"role":"user","content":'), content, F.lit("}]}"))
    return pages.withColumn("payload", payload).drop("content")


def parse_completions(responses: DataFrame, provider: str) -> DataFrame:
    """``(…, body)`` → the same rows with ``text`` and ``total_tokens`` instead of the body."""
    if provider == "openai":
        schema = "choices array<struct<message:struct<content:string>>>, usage struct<total_tokens:long>"
        text = F.get(F.col("_r.choices"), F.lit(0))["message"]["content"]
        tokens = F.coalesce("_r.usage.total_tokens", F.lit(0))
    elif provider == "ollama":
        schema = "message struct<content:string>, prompt_eval_count long, eval_count long"
        text = F.coalesce("_r.message.content", F.lit(""))
        tokens = F.coalesce("_r.prompt_eval_count", F.lit(0)) + F.coalesce("_r.eval_count", F.lit(0))
    elif provider == "anthropic":
        schema = "content array<struct<type:string,text:string>>, usage struct<input_tokens:long,output_tokens:long>"
        texts = F.filter("_r.content", lambda b: b["type"] == "text")
        text = F.coalesce(F.array_join(F.transform(texts, lambda b: F.coalesce(b["text"], F.lit(""))), ""), F.lit(""))
        tokens = F.coalesce("_r.usage.input_tokens", F.lit(0)) + F.coalesce("_r.usage.output_tokens", F.lit(0))
    else:
        raise ValueError(f"unknown provider: {provider}")
    parsed = responses.withColumn("_r", F.from_json("body", schema))
    return parsed.withColumn("text", text).withColumn("total_tokens", tokens).drop("body", "_r")


def classify_error(message: Column, images: bool = False) -> Column:
    """'connection', 'model_not_found', 'timeout' or 'other'; text and image requests test in different order."""
    connection = F.contains(message, F.lit("ConnectError")) | F.contains(message, F.lit("Connection"))
    missing = F.contains(message, F.lit("404"))
    late = F.contains(F.lower(message), F.lit("timeout"))
    if images:
        return F.when(connection, "connection").when(late, "timeout").when(missing, "model_not_found").otherwise("other")
    return F.when(connection, "connection").when(missing, "model_not_found").when(late, "timeout").otherwise("other")


def image_intake(
    files: DataFrame, ord_col: str, group: tuple[str, ...] = (), most: int = MAX_IMAGES, most_bytes: int = MAX_IMAGE_BYTES
) -> DataFrame:
    """The first ``most`` files ``(path, content)`` of each group, with media type and status.

    That number is the limit of the feature; files beyond it are not taken in.
    """
    taken = with_position(files.withColumn("size", F.length("content")).drop("content"), ord_col, "place", group)
    taken = taken.filter(F.col("place") < most)
    name = F.lower("path")
    media = (
        F.when(name.endswith(".pdf"), "application/pdf")
        .when(name.endswith(".jpg") | name.endswith(".jpeg"), "image/jpeg")
        .otherwise("image/png")
    )
    # the German texts here and in context_parts are fixed values
    too_large = F.col("size") > most_bytes
    megabytes = F.bround(F.col("size") / (1024 * 1024), 1)
    error = F.when(
        too_large, F.concat(F.lit("Datei zu groß ("), megabytes.cast("string"), F.lit(f" MB, max {most_bytes // (1024 * 1024)} MB)"))
    ).otherwise("")
    status = F.when(too_large, "error").otherwise("ready")
    return taken.select(
        *group, "path", "place", "size", media.alias("media_type"), status.alias("status"), error.alias("error")
    )


def complete_batch(requests: DataFrame, fn: Callable[[str], str], images: bool = False) -> DataFrame:
    """Run ``fn(payload) -> response body`` over request rows; a failure becomes a row with its message and class."""
    kept = [f for f in requests.schema if f.name != "payload"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", body string, error string"

    def one(payload: str) -> tuple[str | None, str | None]:
        try:
            return fn(payload), None
        except Exception as e:  # whatever the caller's function raises is a result
            return None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            results = [one(p) for p in frame["payload"]]
            yield frame.drop(columns="payload").assign(body=[b for b, _ in results], error=[e for _, e in results])

    done = requests.mapInPandas(run, schema)
    return done.withColumn("error_class", F.when(F.col("error").isNotNull(), classify_error(F.col("error"), images)))


def usage(calls: DataFrame) -> DataFrame:
    """Per conversation the tokens of the last call, which contain its history and so are the running total as well."""
    counted = calls.filter(F.col("total_tokens") > 0)
    last = F.max_by("total_tokens", "turn")
    return counted.groupBy("conv_id").agg(last.alias("tokens_used_last"), last.alias("tokens_used_total"))
