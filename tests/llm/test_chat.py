import hashlib
import json
import random
import re

import duckdb

from gridlake.llm import chat

TOOLS = [{"name": "add", "required": ["a", "b"], "properties": {"a": {"type": "number"}, "b": {"type": "integer"}, "o": {"type": "object"}}}, {"name": "now", "properties": {}}]


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": list(calls)})


ROWS = [
    (1, 0, "user", 'say "hi"\n\t é / \\'),
    (1, 1, "assistant", call({"id": "x", "name": "add", "arguments": {"b": 2, "a": 1.5, "o": {"z": 1, "y": [True, None]}}}, {"id": "y", "name": "add", "arguments": '{"b": "2", "q": 1}', "depends_on": ["x"]}, content="c")),
    (1, 3, "tool", json.dumps({"tool_call_id": "x", "content": "3.5"})),
    (1, 2, "tool", json.dumps({"tool_call_id": "nope", "content": "?"})),
    (2, 0, "tool", json.dumps({"tool_call_id": "k", "content": "early"})),
    (2, 1, "assistant", call({"id": "k", "name": "now", "arguments": {}})),
    (3, 0, "assistant", call({"id": "p", "name": "now", "arguments": {}, "depends_on": ["q"]}, {"id": "q", "name": "now", "arguments": {}, "depends_on": ["p"]})),
    (4, 0, "assistant", call({"id": "r", "name": "other", "arguments": [1]})),
    (5, 0, "assistant", "{not json"),
    (None, 0, "tool", json.dumps({"tool_call_id": "x", "content": "no conversation"})),
    (6, 0, None, None),
    (6, 0, None, None),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "m", 1) for r in rows], "conv_id long, turn long, role string, text string, message string, level int")


def test_links_order_and_checks(spark):
    out = {(r.conv_id, r.turn): r for r in chat.format_messages(frame(spark), TOOLS).collect()}
    a = out[1, 1]
    assert (a.n_calls, a.n_invalid, a.n_unanswered, a.status) == (2, 1, 1, "invalid")
    assert a.message == '{"content":"c","role":"assistant","tool_calls":[{"arguments":{"a":1.5,"b":2,"o":{"y":[true,null],"z":1}},"id":"x","name":"add"},{"arguments":{"b":"2","q":1},"id":"y","name":"add"}]}'
    assert out[1, 3].status == "linked" and out[1, 2].status == "orphan" and out[None, 0].status == "orphan"
    moved = out[2, 0]
    assert moved.status == "moved" and (moved.order_turn, moved.order_level) > (out[2, 1].order_turn, out[2, 1].order_level)
    assert out[3, 0].status == "cycle" and out[4, 0].status == "invalid" and out[5, 0].status == "plain"
    assert json.loads(out[1, 0].message) == {"content": ROWS[0][3], "role": "user"} and out[6, 0].message == '{"content":"","role":""}'
    for r in out.values():
        assert list(json.loads(r.message)) == sorted(json.loads(r.message))


def test_each_row_is_formatted(spark):
    assert chat.format_messages(frame(spark), TOOLS).count() == len(ROWS)
    assert chat.format_messages(frame(spark).where("false")).count() == 0


def test_errors_and_levels(spark):
    c = {(r.conv_id, r.id): r for r in chat.link_calls(frame(spark), TOOLS).collect()}
    assert c[1, "x"].errors == [] and c[1, "y"].errors == ["missing:a", "type:b", "unknown:q"]
    assert (c[1, "x"].level, c[1, "y"].level, c[3, "p"].level) == (0, 1, None)
    assert c[4, "r"].errors == ["unknown tool"]


def test_sql_on_the_table(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    df = chat.format_messages(spark.read.parquet(path))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}'")
    assert sorted(tuple(r) for r in df.collect()) == sorted(con.execute(chat.ORACLE).fetchall())


def test_every_call_is_written(spark):
    rows = [
        (1, 0, "assistant", call({"id": "call_0", "name": "now", "arguments": {}})),
        (1, 1, "tool", json.dumps({"tool_call_id": "call_0", "content": "1"})),
        (1, 2, "assistant", call({"id": "call_0", "name": "add", "arguments": {"a": 1, "b": 2}, "depends_on": ["call_0"]}, {"name": "other", "arguments": {"z": 1}})),
        (1, 2, "assistant", call({"id": "w", "name": "add", "arguments": '{"a": 1'})),
        (1, None, "assistant", call({"id": "t", "name": "now"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "t", "content": "1"})),
        (None, 0, "assistant", call({"id": "n", "name": "now", "arguments": "{}"}, {"id": "m", "name": "add", "arguments": {}}, "odd")),
        (2, 0, "assistant", call()),
    ]
    out = sorted(((r.conv_id, r.turn, json.loads(r.message)["tool_calls"], r.n_calls, r.n_invalid, r.n_unanswered, r.order_level, r.status)
                  for r in chat.format_messages(frame(spark, rows), TOOLS).collect() if r.role == "assistant"), key=str)
    made = lambda name, id, arguments: {"arguments": arguments, "id": id, "name": name}
    assert out == sorted([
        (1, 0, [made("now", "call_0", {})], 1, 0, 0, 0, "calls"),
        (1, 2, [made("add", "call_0", {"a": 1, "b": 2}), made("other", None, {"z": 1})], 2, 1, 2, 0, "invalid"),
        (1, 2, [made("add", "w", '{"a": 1')], 1, 1, 1, 0, "invalid"),
        (1, None, [made("now", "t", {})], 1, 1, 0, 0, "invalid"),
        (None, 0, [made("now", "n", {}), made("add", "m", {}), "odd"], 3, 2, 3, 0, "invalid"),
        (2, 0, [], 0, 0, 0, 0, "calls"),
    ], key=str)
    late = [(3, 0, "assistant", call({"id": "a", "name": "now", "arguments": {}})), (3, 0, "assistant", call({"name": "now", "arguments": "{", "depends_on": ["a"]}))]
    got = sorted((r.order_level, r.n_invalid, r.status) for r in chat.format_messages(frame(spark, late)).collect())
    assert got == [(0, 0, "calls"), (1, 1, "invalid")]
    assert {(r.id, r.arguments, tuple(r.errors)) for r in chat.link_calls(frame(spark, rows[3:4])).collect()} == {("w", '"{\\"a\\": 1"', ("not JSON",))}


def test_levels_of_any_depth(spark):
    graph = {f"c{i}": [f"c{i - 1}"] * (i > 0) for i in range(150)}  # one long chain
    graph |= {f"l{i}": [f"l{j}" for j in (i - 1, i - 2) if j >= 0] for i in range(5)}  # calls that need several
    graph |= {"m": ["c100", "l4"], "n": ["m"], "o": ["n", "c3"], "p": ["q"], "q": ["r"], "r": ["p"], "s": ["q"], "t": ["s", "c1"], "u": ["t"], "v": ["v"], "w": ["absent"]}

    def want(x, seen=()):
        below = [None if y in (*seen, x) else want(y, (*seen, x)) for y in graph[x] if y in graph]
        return None if None in below else 1 + max(below, default=-1)

    rows = [(k % 2, k, "assistant", call({"id": x, "name": "now", "arguments": {}, "depends_on": graph[x]})) for k in (0, 1) for x in graph]
    got = {(r.conv_id, r.id): r.level for r in chat.link_calls(frame(spark, rows)).collect()}
    assert got == {(k, x): want(x) for k in (0, 1) for x in graph} and got[0, "c149"] == 149 and got[1, "o"] == 103
    out = {(r.turn, json.loads(r.message)["tool_calls"][0]["id"]): (r.status, r.order_level) for r in chat.format_messages(frame(spark, rows)).collect()}
    assert out[0, "c149"] == ("calls", 149) and out[0, "u"] == ("cycle", 0) and out[1, "w"] == ("calls", 0)


def brute(rows):
    """(conv, turn, role, order_turn, order_level, n_calls, n_invalid, n_unanswered, status) of each row, call by call."""
    made, answers = [], set()
    for conv, turn, role, body in rows:
        try:
            v = json.loads(body) if role in ("assistant", "tool") and body and body.lstrip().startswith("{") else None
        except ValueError:
            v = None
        calls = v.get("tool_calls") if v and role == "assistant" else None
        result = v.get("tool_call_id") if v and role == "tool" else None
        made.append((conv, turn, role, body or "", calls, result))
        if result is not None and conv is not None:
            answers.add((conv, result))
    first, listed = {}, []
    for conv, turn, _, body, calls, _ in made:
        key = hashlib.sha256(f"{turn} {body}".encode()).hexdigest()
        for pos, c in enumerate(calls or []):
            c = c if isinstance(c, dict) else {}
            one = (turn, pos, key)
            listed.append((conv, one, c.get("depends_on") or []))
            if conv is not None and c.get("id") is not None and one <= first.get((conv, c["id"]), (one,))[0]:
                first[conv, c["id"]] = (one, c.get("depends_on") or [])
    needs = {k: {(k[0], x) for x in after if (k[0], x) in first} for k, (_, after) in first.items()}
    level = {}
    while True:
        ready = {k: max([level[x] + 1 for x in n], default=0) for k, n in needs.items() if k not in level and n <= set(level)}
        if not ready:
            break
        level |= ready
    at = {(k[0], one): k for k, (one, _) in first.items()}
    out = []
    for conv, turn, role, body, calls, result in made:
        key = hashlib.sha256(f"{turn} {body}".encode()).hexdigest()
        if calls is not None:
            levels, hits = [], 0
            for pos, c in enumerate(calls if conv is not None else []):
                k = at.get((conv, (turn, pos, key)))
                if k:
                    levels.append(level.get(k))
                    hits += k in answers
                else:
                    n = [(conv, x) for x in (c.get("depends_on") or [] if isinstance(c, dict) else []) if (conv, x) in first]
                    levels.append(None if any(x not in level for x in n) else max([level[x] + 1 for x in n], default=0))
            bad = sum(not isinstance(c, dict) for c in calls)
            status = "cycle" if None in levels else "invalid" if bad else "calls"
            out.append((conv, turn, role, turn, min([x for x in levels if x is not None], default=0), len(calls), bad, len(calls) - hits, status))
        elif result is not None:
            got = first.get((conv, result)) if conv is not None else None
            when = got[0][0] if got else turn
            out.append((conv, turn, role, max(turn, when), (level.get((conv, result)) or 0) + 1 if got else 1, 0, 0, 0, "orphan" if not got else "moved" if turn < when else "linked"))
        else:
            out.append((conv, turn, role, turn, 0, 0, 0, 0, "plain"))
    return out


def test_linking_against_brute_force(spark):
    """Random conversations: ids that repeat or are absent, ties of turns, repeated rows, chains, circles, results before calls."""
    r = random.Random(12)
    rows = []
    for conv in [*range(40), None]:
        for _ in range(r.randrange(1, 14)):
            turn = r.randrange(0, 9)
            kind = r.random()
            if kind < 0.5:
                calls = [r.choice([5, "x"]) if r.random() < 0.05 else
                         {"name": "f", "arguments": {}} | ({"id": f"c{r.randrange(9)}"} if r.random() < 0.85 else {}) | ({"depends_on": [f"c{r.randrange(9)}" for _ in range(r.randrange(0, 3))]} if r.random() < 0.7 else {})
                         for _ in range(r.randrange(0, 4))]
                rows.append((conv, turn, "assistant", call(*calls)))
            elif kind < 0.85:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": f"c{r.randrange(12)}", "content": "r"})))
            else:
                rows.append((conv, turn, "user", "hello"))
    rows += r.sample(rows, 40)
    rows += [(99, i, "assistant", call({"id": f"n{i}", "name": "f", "arguments": {}, "depends_on": [f"n{i - 1}"] if i else []})) for i in range(90)] + [(99, 200, "tool", json.dumps({"tool_call_id": "n89", "content": "y" * 200_000}))]
    got = [(x.conv_id, x.turn, x.role, x.order_turn, x.order_level, x.n_calls, x.n_invalid, x.n_unanswered, x.status) for x in chat.format_messages(frame(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def test_calls_meet_the_schemas_that_their_conversation_declares(spark):
    nested = [{"type": "function", "function": {"name": t["name"], "parameters": {"required": t.get("required", []), "properties": t["properties"]}}} for t in TOOLS]
    late = {"name": "now", "input_schema": {"properties": {"zone": {}}, "required": ["zone"]}}
    asks = call({"id": "a", "name": "add", "arguments": {"a": 1, "b": 2}}, {"id": "b", "name": "add", "arguments": '{"b": "2", "q": 1}'}, {"id": "c", "name": "gone"}, {"name": "now", "arguments": {"zone": 1}}, {"id": "e", "name": "now", "arguments": "{"})
    rows = [(0, 0, "system", json.dumps({"tools": TOOLS})), (1, 0, "system", json.dumps({"tools": nested})), (2, 0, "system", "{tools"), (3, 0, "system", json.dumps({"tools": []})),
            (4, 0, "system", json.dumps({"tools": [late]})), (4, 1, "system", json.dumps({"tools": TOOLS})), (None, 0, "system", json.dumps({"tools": TOOLS})), (5, 0, "user", json.dumps({"tools": TOOLS}))]
    rows += [(k, 9, "assistant", asks) for k in (0, 1, 2, 3, 4, 5, None, 1)]
    df = frame(spark, rows)
    out = chat.format_messages(df).collect()
    bad = sorted((str(r.conv_id), r.n_invalid) for r in out if r.role == "assistant")
    assert bad == [("0", 4), ("1", 4), ("1", 4), ("2", 1), ("3", 5), ("4", 3), ("5", 1), ("None", 1)]
    assert {r.status for r in out if r.role == "system"} == {"plain"} and len(out) == len(rows)
    errors = {(r.conv_id, r.id): r.errors for r in chat.link_calls(df).collect()}
    assert errors[1, "b"] == ["missing:a", "type:b", "unknown:q"] and errors[1, "c"] == ["unknown tool"] and errors[2, "c"] == [] and errors[4, "e"] == ["not JSON"] and errors[3, "a"] == ["unknown tool"]
    # a catalogue that is given counts for all
    assert {r.n_invalid for r in chat.format_messages(df, TOOLS).collect() if r.role == "assistant"} == {4}
