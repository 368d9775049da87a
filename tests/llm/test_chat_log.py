"""Chat logs: the fold against a replay, templates against exact round trips, the query's digests against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from weftwork.llm.chat_log import LLAMA, Template, digest, fold, format_conversations, log_of, read, render
from weftwork.llm.queries import op11_chat_format

LOG = "conv_id long, seq long, kind string, turn int, role string, text string, events string"
TALKS = "conv_id long, turn long, role string, text string, place string, formatted string"


def replay(events):
    """One event after another, on unique sequences."""
    live, roles = {}, {}
    for _, seq, kind, turn, role, text, _ in sorted(events, key=lambda e: e[1]):
        if kind == "delta" or kind is None:
            if turn in live:
                live[turn] += text or ""
        elif kind in ("message", "edit", "regenerate"):
            live = {t: x for t, x in live.items() if t < turn}
            live[turn] = text or ""
            roles[turn] = role if role is not None else roles.get(turn)
    return sorted((t, roles[t], x) for t, x in live.items())


def test_fold_equals_replay(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(120):
        for seq in rng.sample(range(1000), rng.randint(1, 40)):
            kind = rng.choice(["message", "message", "delta", "delta", "delta", "edit", "regenerate", None, "seen"])
            rows.append((conv, seq, kind, rng.randint(0, 5), rng.choice(["user", "assistant", None]), rng.choice(["a", "bc", "", None, "é "]), ""))
    got = {}
    for r in fold(spark.createDataFrame(rows, LOG).repartition(7)).collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    want = {c: replay([r for r in rows if r[0] == c]) for c in range(120)}
    assert {c: sorted(x) for c, x in got.items()} == {c: x for c, x in want.items() if x}


def test_fold_of_odd_rows(spark):
    rows = [(None, 1, "message", 0, "user", "x", ""), (None, 2, None, 0, None, "y", ""), (1, None, "message", 0, "user", "first", ""), (1, 5, "delta", 3, None, "lost", "")]
    rows += [(2, 1, "message", 0, None, "b", ""), (2, 1, "message", 0, None, "a", ""), (2, 1, "delta", 0, None, "d", ""), (2, 1, "delta", 0, None, "c", ""), (3, 1, "message", None, "user", "n", ""), (3, 2, "message", 1, "user", "m", "")]
    got = sorted(map(tuple, fold(spark.createDataFrame(rows, LOG)).collect()), key=str)
    assert got == sorted([(None, 0, "user", "xy"), (1, 0, "user", "first"), (2, 0, None, "bcd"), (3, None, "user", "n"), (3, 1, "user", "m")], key=str)
    assert fold(spark.createDataFrame([], LOG)).collect() == []


NASTY = ["</s>", "<s>", "<\\s>", "<\\\\/s>", "[INST]", "[/INST]", "[\\INST]", "<<SYS>>", "<</SYS>>", "<", "[", "\\", "/s>", "INST]", " ", "\n", "\r\n", "é", "😀", "x"]


def nasty(rng):
    return "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 8)))


def test_round_trip_of_control_strings(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", nasty(rng)]), nasty(rng), "", "") for c in range(60) for t in range(rng.randint(1, 9))]
    talks = spark.createDataFrame(rows, TALKS)
    rendered = format_conversations(talks)
    for r in rendered.collect():
        mine = [x for x in rows if x[0] == r["conv_id"]]
        bare = r["formatted"]
        for mark in ("<s>", "</s>", "[INST]", "[/INST]"):
            assert bare.count(mark) == len(mine)  # only the template's own
        assert "<<SYS>>" not in bare and "<</SYS>>" not in bare
    got = sorted((r["conv_id"], r["place"], r["role"], r["text"], r["learned"]) for r in read(rendered).collect())
    assert got == [(c, t, role, x, x if role == "assistant" else None) for c, t, role, x, *_ in rows]


def test_templates_that_cannot_be_undone_are_refused():
    other = Template("<|turn|>", "<|says|>", "<|over|>", ("<|turn|>", "<|says|>", "<|over|>"), ("bot",))
    assert other.learned == ("bot",)
    for bad in ({"control": ("<s>", "s")}, {"control": ("<<S>", "<S>", "<s>", "</s>", "[INST]", "[/INST]")}, {"close": "end"}, {"close": "</s></s>"}, {"control": ("<\\s>", "</s>", "[INST]", "[/INST]")}):
        with pytest.raises(ValueError):
            Template(**bad)


def test_another_template(spark):
    t = Template("<|turn|>", "<|says|>", "<|over|>", ("<|turn|>", "<|says|>", "<|over|>"), ("bot", "user"))
    turns = spark.createDataFrame([(1, 0, "bot", "<|over|> <\\|over|>"), (1, 1, "system", "<s>"), (1, 2, "user", None), (2, 0, None, "x")], "conv_id long, turn int, role string, text string")
    rendered = render(turns, t)
    assert {r["conv_id"]: r["formatted"] for r in rendered.collect()}[2] == "<|turn|><|says|>x<|over|>"
    got = sorted(tuple(r)[:5] for r in read(rendered, t).collect())
    assert got == [(1, 0, "bot", "<|over|> <\\|over|>", "<|over|> <\\|over|>"), (1, 1, "system", "<s>", None), (1, 2, "user", "", ""), (2, 0, "", "x", None)]


def expected(rows):
    rows = sorted(((c, t, role or "", x or "") for c, t, role, x, *_ in rows), key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    out = {}
    for c, _, role, x in rows:
        out.setdefault(c, []).append((role, x))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = {c: "".join(x for role, x in ts if role == "assistant") for c, ts in out.items()}
    return {c: (len(ts), sha("".join(f"{r}\n{x}\n" for r, x in ts)), len(loss[c]), sha(loss[c])) for c, ts in out.items()}


def test_digests_of_odd_tables(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant"]), "".join(rng.choice("ab \n") for _ in range(rng.choice([0, 3, 511, 512, 513, 2000]))), "", "") for c in range(20) for t in range(5)]
    rows += [rows[3], rows[3], (5, 2, "assistant", "tie", "", ""), (None, 0, "user", "no id", "", ""), (None, 1, "assistant", None, "", ""), (7, None, "user", "no turn", "", ""), (8, 1, None, "no role", "", "")]
    rows += [(30, 0, "assistant", "long </s> text 😀" * 30_000, "", "")] + [(31, t, ("user", "assistant")[t % 2], f"turn {t} [INST]", "", "") for t in range(3000)]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in digest(read(format_conversations(spark.createDataFrame(rows, TALKS).repartition(6)))).collect()}
    assert got == expected(rows)
    empty = digest(read(format_conversations(spark.createDataFrame([], TALKS))))
    assert empty.collect() == [] and "formatted_chars" in empty.columns


def test_log_holds_drafts_and_first_tries(spark):
    rows = [(1, 0, "user", "a question that is longer than its draft", "", ""), (1, 1, "assistant", "y" * 1100, "", "")]
    kinds = [r["kind"] for r in log_of(spark.createDataFrame(rows, TALKS)).orderBy("seq").collect()]
    assert kinds == ["message", "edit", "message", "delta", "regenerate", "delta", "delta", "delta"]


def test_query_runs_without_python_and_with_one_shuffle_of_texts(spark, tmp_path):
    rows = [(-7, 2, "user", "of the table", "", ""), (1, 0, "assistant", "x", "", "")]
    spark.createDataFrame(rows, TALKS).write.parquet(f"{tmp_path}/conversations.parquet")
    out = op11_chat_format(spark, str(tmp_path))
    said = "</s>[INST] ok [/INST]"
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in out.collect()}
    assert got == expected([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    plan = op11_chat_format(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and not any(x in plan for x in ("Python", "InPandas", "InArrow", "ExistingRDD"))
    assert LLAMA.close == "</s>" and out.select(F.sum("formatted_chars")).first()[0] > 0
