"""Requests and answers; positions and parts that are cut on purpose."""

import json

import pytest
from pyspark.sql import functions as F

from wortlaut.functions.ordering import running_total, with_position
from wortlaut.functions.sizes import keep_values
from wortlaut.operators import messages


def test_running_totals_and_positions(spark):
    rows = spark.range(5000).select(
        (F.col("id") * 37).alias("ord"), (F.col("id") % 3 == 0).cast("int").alias("g"), (F.col("id") % 7).alias("v")
    )
    got = running_total(rows, "ord", F.col("v"), "before", ("g",), total="total").collect()
    for g in (0, 1):
        total = 0
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["ord"])
        for r in mine:
            assert r["before"] == total
            total += r["v"]
        assert {r["total"] for r in mine} == {total}
    placed = with_position(rows, "ord").orderBy("ord").collect()
    assert [r["position"] for r in placed] == list(range(5000))


def test_positions_of_sparse_order_values(spark):
    """Hashes as order values: hardly two share their upper digits, and still no task gets them all."""
    rows = spark.range(3000).select(F.xxhash64("id").alias("ord")).unionByName(
        spark.createDataFrame([(-(2**63),), (2**63 - 1,), (0,), (-1,)], "ord long")
    )
    placed = with_position(rows, "ord")
    got = placed.orderBy("ord").collect()
    assert [r["position"] for r in got] == list(range(3004))
    assert "SinglePartition" not in placed._jdf.queryExecution().executedPlan().toString()


def test_kept_values(spark):
    words = spark.createDataFrame([("it's \\",), ("b",), (None,), ("b",)], "w string")
    wanted = spark.createDataFrame([("b",), (None,), ("it's \\",), ("c",)], "w string")
    assert sorted(r.w for r in keep_values(words, "w", wanted).collect()) == ["b", "b", "it's \\"]
    assert keep_values(words, "w", wanted.filter("w IS NULL")).count() == 0


def test_context_block_parts_make_up_the_whole(make_docs):
    files = {f"s/d{i}.xml": f"<d>{i}ß</d>" for i in range(30)} | {"bad.xml": b"\xff\xfe\xff"}
    docs = make_docs(files)
    parts = messages.context_block(docs).orderBy("part_no").collect()
    assert [p["part_no"] for p in parts] == list(range(33))
    text = "".join(p["part"] for p in parts)
    assert text.startswith('<context>\nDie folgenden XML-Dateien wurden vom Benutzer ausgewählt:\n\n<file name="d0.xml" path="s/d0.xml">\n<d>0ß</d>\n</file>\n\n<file')
    assert text.endswith('<file name="bad.xml" error="true">\nFehler beim Lesen: kein UTF-8\n</file>\n</context>')
    grouped = messages.context_block(docs.withColumn("g", F.col("doc_ord") % 2), ("g",))
    blocks = messages.joined_blocks(grouped, ("g",)).collect()
    assert sorted(b["block"].count("<file") for b in blocks) == [15, 16]
    assert all(b["block"].startswith("<context>") and b["block"].endswith("</context>") for b in blocks)
    assert messages.context_block(docs.limit(0)).count() == 0


TALK = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "system", "S"), (2, 1, "user", "d"),
        (3, 0, "assistant", "e"), (3, 1, "user", "f"), (4, 0, "system", "only")]


def test_messages(spark):
    talk = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    contexts = spark.createDataFrame([(1, 0, "C0"), (1, 2, "C2"), (2, 1, "")], "conv_id long, turn long, block string")
    got = sorted(map(tuple, messages.build_messages(talk, contexts, system="P").collect()))
    assert got == [(1, 0, "user", "P\n\nC0\n\na"), (1, 1, "assistant", "b"), (1, 2, "user", "C2\n\nc"),
                   (2, 1, "user", "P\n\nd"), (3, 0, "assistant", "e"), (3, 1, "user", "f")]
    own = sorted(map(tuple, messages.build_messages(talk).collect()))
    assert own[3] == (2, 1, "user", "S\n\nd") and own[0] == (1, 0, "user", "a")


@pytest.mark.parametrize("provider", ["openai", "ollama", "anthropic"])
def test_payloads(spark, provider):
    talk = spark.createDataFrame([t for t in TALK if t[2] != "system"], "conv_id long, turn long, role string, content string")
    rows = messages.request_payloads(talk, provider, "m").orderBy("conv_id").collect()
    want = {"model": "m", "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}, {"role": "user", "content": "c"}]}
    want |= {"ollama": {"stream": False}, "anthropic": {"max_tokens": 4096}, "openai": {}}[provider]
    assert json.loads(rows[0]["payload"]) == want
    assert [(r["conv_id"], r["turn"], r["tokens"], r["budget"]) for r in rows] == [(1, 2, 0, "ok"), (2, 1, 0, "ok"), (3, 1, 0, "ok")]
    pages = spark.createDataFrame([("p.png", "image/png", bytearray(b"\x00" * 100))], "name string, media_type string, content binary")
    image = json.loads(messages.image_payloads(pages, provider, 'm"', 'Lies "das"').first()["payload"])
    assert image["model"] == 'm"' and 'Lies "das"' in json.dumps(image, ensure_ascii=False).replace('\\"', '"')
    assert "A" * 133 in json.dumps(image)


def test_a_long_talk_is_one_request_up_to_its_last_question(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", "x" * 100) for i in range(1500)] + [(2, 5, "assistant", "no question")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, content string")
    (request,) = messages.request_payloads(talk, "openai", "m").collect()
    sent = json.loads(request["payload"])["messages"]
    assert len(sent) == 1499 and sent[-1]["role"] == "user" and request["turn"] == 1498
    assert (request["tokens"], request["budget"]) == (37475, "over")
    (roomy,) = messages.request_payloads(talk, "openai", "m", F.lit(200_000)).collect()
    assert roomy["budget"] == "ok" and roomy["payload"] == request["payload"]


def test_pages_of_an_item(spark):
    pages = spark.createDataFrame([("k", 2, "image/png", bytearray(b"b")), ("k", 1, "image/jpeg", bytearray(b"a"))],
                                  "item string, page_no long, media_type string, content binary")
    got = {r["page_no"]: r["payload"] for r in messages.page_requests(pages, "openai", "m", "Lies").collect()}
    assert "image/jpeg;base64,YQ==" in got[1] and "image/png;base64,Yg==" in got[2]
    answers = spark.createDataFrame([("k", 10, "c"), ("k", 2, "b"), ("k", 1, "a"), ("l", 1, None)], "item string, page_no long, text string")
    assert sorted(map(tuple, messages.joined_pages(answers).collect())) == [("k", 3, "a\n\nb\n\nc"), ("l", 1, "")]


def test_unknown_provider(spark):
    with pytest.raises(ValueError):
        messages.parse_completions(spark.createDataFrame([("{}",)], "body string"), "other")


def test_incomplete_answers(spark):
    empty = spark.createDataFrame([("{}",)], "body string")
    for provider, text in (("openai", None), ("ollama", ""), ("anthropic", "")):
        assert tuple(messages.parse_completions(empty, provider).first()) == (text, 0)


def test_budget_and_context_length(spark):
    rows = spark.createDataFrame([(7000, 10000), (5904, 10000), (5905, 10000), (9, 0), (20000, 32000), (24001, 32000)], "t long, c long")
    flags = [r[0] for r in rows.select(messages.budget_flag(F.col("t"), F.col("c"))).collect()]
    assert flags == ["over", "ok", "over", "ok", "ok", "near"]
    names = ["GPT-4o-mini", "gpt-3.5-turbo", "claude-x", "Mistral-small", "mistral-7b", "llama3-70b", "phi", "gpt-5"]
    df = spark.createDataFrame([(n, r) for n in names for r in (0, 77)], "n string, r long")
    got = [r[0] for r in df.select(messages.context_length(F.col("n"), F.col("r"))).collect()]
    assert got[::2] == [128000, 16385, 200000, 128000, 32000, 128000, 32000, 128000] and set(got[1::2]) == {77}


def test_images(spark):
    rows = [(i, "b" if i % 2 else "a", f"{i}.{'JPG' if i % 3 else 'tif'}", bytearray(b"x" * (6 * 1024 * 1024 if i == 1 else 9))) for i in range(25)]
    files = spark.createDataFrame(rows, "n long, g string, path string, content binary")
    got = messages.image_intake(files, "n", ("g",)).orderBy("g", "place").collect()
    assert [r["path"] for r in got if r["g"] == "a"] == [f"{i}.{'JPG' if i % 3 else 'tif'}" for i in range(0, 20, 2)]
    bad = [r for r in got if r["status"] == "error"]
    assert [(r["path"], r["error"]) for r in bad] == [("1.JPG", "Datei zu groß (6.0 MB, max 5 MB)")]
    assert {r["path"][-3:]: r["media_type"] for r in got} == {"JPG": "image/jpeg", "tif": "image/png"}
    assert messages.image_intake(files, "n").count() == 10
    assert messages.image_intake(files, "n", most=25, most_bytes=5).filter("status = 'error'").count() == 25


def test_batch_completion(spark):
    def answer(payload):
        if payload == "bad":
            raise TimeoutError("Timeout after 3 s")
        return payload + "!"

    rows = spark.createDataFrame([(1, "ok"), (2, "bad")], "id long, payload string")
    got = sorted(map(tuple, messages.complete_batch(rows, answer).collect()))
    assert got == [(1, "ok!", None, None), (2, None, "TimeoutError: Timeout after 3 s", "timeout")]
    calls = spark.createDataFrame([(1, 1, 5), (1, 3, 9), (1, 5, 0), (2, 1, 0)], "conv_id long, turn long, total_tokens long")
    assert sorted(map(tuple, messages.usage(calls).collect())) == [(1, 9, 9)]
