import hashlib
import json
import random

from pyspark.sql import functions as F

from tessera.llm import chat


def digests(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def got(rows):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows.collect()}


def test_every_text_comes_back(spark):
    rng = random.Random(2)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "\\\\", " ", "\n", "a", "é🙂", "<", "[", "s>", "$1", "", "INST]"]
    convs, rows = {}, []
    for c in range(60):
        convs[c] = [(rng.choice(["user", "assistant", "system", "tool</s>", "\\"]), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12)))) for _ in range(rng.choice([1, 2, 7, 150]))]
        rows += [(c, i, r, t, "x") for i, (r, t) in enumerate(convs[c])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    blocks = chat.formatted_blocks(df)
    assert got(chat.read_back(blocks)) == {c: digests(t) for c, t in convs.items()}
    whole = {r.conv_id: r.formatted for r in chat.whole_conversations(blocks).collect()}
    assert all(w.count("[/INST] ") >= len(convs[c]) and w.startswith("<s>[INST] ") and w.endswith(" </s>") for c, w in whole.items())


def test_layouts(spark):
    turns = [("user", "Hi </s>"), ("assistant", "Yo")]
    records = {
        1: {"messages": [{"role": "user", "content": "Hi </s>"}, {"role": "assistant", "content": "Yo"}]},
        2: {"conversations": [{"from": "human", "value": "Hi </s>"}, {"from": "gpt", "value": "Yo"}]},
        3: {"prompt": "Hi </s>", "completion": "Yo"},
        4: {"instruction": "Hi </s>", "input": "", "output": "Yo"},
        5: {"instruction": "Hi </s>", "output": "Yo"},
        6: {"prompt": "Hi </s>", "response": "Yo"},
        7: {"instruction": "Hi", "input": "</s>", "output": "Yo"},
        8: {"system": None, "question": "Hi </s>", "answer": "Yo"},
    }
    odd = [(20, '{"unknown": 1}'), (21, "{"), (22, None), (23, "[]")]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in records.items()] + odd, "conv_id long, record string")
    out = chat.canonical_turns(df)
    by = {}
    for r in out.orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text) if r.layout else None)
    assert all(by[k] == turns for k in records if k != 7) and by[7] == [("user", "Hi\n\n</s>"), ("assistant", "Yo")]
    assert all(by[k] == [None] for k, _ in odd)
    assert len({r.p for r in df.filter("conv_id < 7").select(chat.field_paths(F.try_parse_json("record")).alias("p")).collect()}) == 6


def test_edges(spark):
    rows = [(1, 0, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (None, 3, "user", "x" * 200_000)]
    out = got(chat.read_back(chat.formatted_blocks(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").na.fill("", ["role", "text"]))))
    assert out[1] == digests([("", ""), ("assistant", "a"), ("assistant", "b")]) and out[None] == digests([("user", "x" * 200_000)])
    assert chat.read_back(chat.formatted_blocks(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_null_turns_come_last(spark):
    rows = [(1, None, "user", "z"), (1, 3, "assistant", "a"), (1, None, "assistant", "b"), (2, None, "user", "c")]
    records = [(c, json.dumps({"turn": t, "role": r, "text": x})) for c, t, r, x in rows] + [(1, "{"), (3, '{"x": 1}')]
    turns = chat.canonical_turns(spark.createDataFrame(records, "conv_id long, record string"))
    out = got(chat.read_back(chat.formatted_blocks(turns)))
    assert out == {1: digests([("assistant", "a"), ("assistant", "b"), ("user", "z")]), 2: digests([("user", "c")])}


def test_typed_columns_lose_nothing(spark):
    """Null turns, roles and texts and a text of 21 million characters, against OP4_SQL's rule written out."""
    long = "x</s>" * 4_200_000
    rows = [(1, None, "user", "z"), (1, 3, "assistant", None), (1, None, None, "b"), (2, None, "user", "c"), (3, 0, "assistant", long), (None, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = got(chat.read_back(chat.formatted_blocks(chat.turns_of_columns(df))))
    assert out == {1: digests([("assistant", ""), ("", "b"), ("user", "z")]), 2: digests([("user", "c")]), 3: digests([("assistant", long)]), None: digests([("", "")])}
    nested = spark.createDataFrame([(5, [("human", "Hi"), ("gpt", None)]), (6, None)], "conv_id long, conversations array<struct<from:string,value:string>>")
    assert [(r.conv_id, r.turn, r.role, r.text) for r in chat.turns_of_columns(nested).orderBy("turn").collect()] == [(5, 0, "user", "Hi"), (5, 1, "assistant", "")]
    pair = spark.createDataFrame([(7, "a", None)], "conv_id long, prompt string, response string")
    assert [(r.role, r.text) for r in chat.turns_of_columns(pair).collect()] == [("user", "a"), ("assistant", "")]


def test_the_query_with_null_turns_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = [(1, None, "user", "z"), (1, 3, "assistant", "a [INST]"), (1, None, "assistant", "b"), (2, None, None, None), (None, 0, "user", "é")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    out = chat.op4_chat_format(spark, str(tmp_path))
    want = c.execute(chat.OP4_SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in out.collect()))) == sorted(map(str, want.fetchall()))


def test_many_null_turns_of_a_conversation_take_time_in_proportion(spark):
    import time

    def seconds(n):
        rows = spark.range(n).selectExpr("7L AS conv_id", "CAST(NULL AS BIGINT) AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
        began = time.monotonic()
        blocks = chat.formatted_blocks(rows).collect()
        return time.monotonic() - began, blocks

    seconds(100)
    took, (block,) = seconds(50_000)
    assert took < 20
    said = [block.formatted[s.start : s.start + s.length] for s in block.loss]
    assert sorted(said) == sorted(f"t{i}" for i in range(1, 50_000, 2))
