import hashlib

from pyspark.sql import functions as F

from framewright.llm import chat


def rows(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def test_awkward_turns_come_back(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "", None, "a\nb\n", "<|nl|>", "<|im_start|>" * 3, "é🙂<|", "|<|>"]
    data = [(1, i, "assistant" if i % 2 else "us\n<|er", t) for i, t in enumerate(texts)]
    data += [(None, 0, "user", "x"), (2, None, None, None), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (3, 0, "assistant", "other")]
    out = {r["conv_id"]: r for r in chat.parse_formatted(chat.format_turns(chat.canonical_turns(rows(spark, data)))).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("assistant" if i % 2 else "us\n<|er", t or "") for i, t in enumerate(texts)]
    assert out[1]["learnt"] == [t or "" for i, t in enumerate(texts) if i % 2]
    assert [t["text"] for t in out[3]["turns"]] == ["other", "same", "same"]
    assert [tuple(t) for t in out[2]["turns"]] == [("", "")] and [tuple(t) for t in out[None]["turns"]] == [("user", "x")]
    f = out[1]["formatted"]
    # spans count code points of the whole
    for s in out[1]["loss_spans"]:
        assert f[s["start"] - 1 : s["start"] - 1 + s["length"]] in f and f[s["start"] - 1 + s["length"] :].startswith(chat.END)


def test_digests(spark):
    data = [(9, 0, "user", "q"), (9, 1, "assistant", "a<|im_end|>"), (9, 2, "assistant", "b")]
    r = chat.digests(chat.parse_formatted(chat.format_turns(chat.canonical_turns(rows(spark, data))))).first()
    assert r["turns_sha256"] == hashlib.sha256(b"user\nq\nassistant\na<|im_end|>\nassistant\nb\n").hexdigest()
    assert r["loss_sha256"] == hashlib.sha256(b"a<|im_end|>b").hexdigest() and r["loss_chars"] == 12 and r["n_turns"] == 3


def test_layouts_by_fingerprint(spark):
    want = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    for sql in (
        "select 1L conv_id, array(named_struct('role','user','content','q'), named_struct('role','assistant','content','a')) messages",
        "select 1L conv_id, array(named_struct('from','human','value','q'), named_struct('from','gpt','value','a')) conversations, 'x' extra",
        "select 1L conv_id, 'q' prompt, 'a' response", "select 1L conv_id, 'q' instruction, 'a' output", "select 1L conv_id, 'q' question, 'a' answer, 5 score",
    ):
        got = chat.canonical_turns(spark.sql(sql)).orderBy("turn").collect()
        assert [tuple(r) for r in got] == want, sql
    try:
        chat.canonical_turns(spark.sql("select 1L conv_id, 'q' nothing"))
    except ValueError as e:
        assert "nothing" in str(e)
    else:
        raise AssertionError


def test_json_rows_of_mixed_layouts(spark):
    data = [(1, '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}'), (2, '{"instruction":"q","output":"a"}'), (3, '{"instruction":"q","input":"more","output":"a"}'), (4, "not json"), (5, None), (6, '{"prompt":"q","response":null}')]
    got = chat.canonical_json(spark.createDataFrame(data, "conv_id long, record string")).orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in got if r["conv_id"] < 6] == [(1, "user", "q"), (1, "assistant", "a"), (2, "user", "q"), (2, "assistant", "a"), (3, "user", "q\nmore"), (3, "assistant", "a")]


def test_json_rows_with_further_fields_and_without_a_mapping(spark):
    data = [
        (1, '{"prompt":"q","response":"a","id":7}'), (2, '{"messages":[{"role":"human","content":"q","name":"x"},{"role":"gpt","content":"a"}],"meta":{"prompt":"no"}}'), (3, '{"system":"s","instruction":"q","output":"a"}'),
        (4, '{"prompt":["q1"],"response":"a"}'), (5, '{"nested":{"prompt":"q","response":"a"}}'), (6, "[1]"), (7, "{"), (8, None), (9, '{"messages":["q"]}'), (10, '{"conv_id":3,"question":"q","answer":5}'), (10, '{"conv_id":3,"question":"q","answer":5}'),
    ]
    records = spark.createDataFrame(data, "conv_id long, record string")
    told = {r["conv_id"]: r for r in chat.json_layouts(records).collect()}
    assert {i: r["reason"] for i, r in told.items() if r["reason"]} == {4: "no mapping", 5: "no mapping", 6: "no object", 7: "no JSON", 8: "no JSON", 9: "no mapping"}
    assert {i: r["layout"] for i, r in told.items() if r["layout"]} == {1: "prompt and response", 2: "messages", 3: "instruction", 10: "question and answer"}
    assert told[10]["fingerprint"] == chat.fingerprint(["question", "answer"]) and told[5]["fingerprint"] != told[1]["fingerprint"]
    got = sorted(tuple(r) for r in chat.canonical_json(records).collect())
    want = [(i, k, role, text) for i in (1, 2, 3) for k, (role, text) in enumerate((("user", "q"), ("assistant", "a")))]
    assert got == sorted(want + 2 * [(10, 0, "user", "q"), (10, 1, "assistant", "5")])
    assert chat.canonical_json(records.limit(0)).count() == 0
    plan = chat.canonical_json(records)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("LocalTableScan") + plan.count("LogicalRDD") <= 8


def test_very_long_turns_and_clashing_columns(spark):
    long = "a<|b " * 200_000
    turns = rows(spark, [(1, 0, "user", long), (1, 1, "assistant", long)]).selectExpr("*", "'x' as formatted", "1 as loss_spans", "'y' as no", "2 as at")
    out = chat.parse_formatted(chat.format_turns(chat.canonical_turns(turns))).first()
    assert [t["text"] for t in out["turns"]] == [long, long] and out["learnt"] == [long] and out["n_turns"] == 2


def test_empty_table_and_no_python_in_the_plan(spark):
    empty = rows(spark, [])
    assert chat.digests(chat.parse_formatted(chat.format_turns(chat.canonical_turns(empty)))).count() == 0
    plan = chat.op1_rows(spark, empty.withColumn("formatted", F.lit(1)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
