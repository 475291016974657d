import asyncio
import json

import pytest
from pyspark.sql import functions as F

from sievecraft import cli, config, export, generate, load_config
from sievecraft.generation import engine
from sievecraft.generation.providers import AnthropicProvider, ChatProvider, CompletionResult, MockProvider, create_provider, split_system
from sievecraft.generation.strategies import STRATEGIES, AutoOptimize, create_strategy
from sievecraft.generation.tasks import TASKS, create_task
from sievecraft.sinks import StreamingWriter
from sievecraft.sources.documents import load_documents
from sievecraft.sources.samples import METADATA, read_samples, with_seq


def parsed(spark, task, *replies):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "batch_index int, response string")
    t = create_task(task)
    return t.valid(t.parse(df)).orderBy("batch_index", "pos").collect()


@pytest.mark.parametrize(
    "task, good, bad",
    [
        ({"type": "classification", "labels": "a, b"}, {"text": "t", "label": "a"}, {"text": "t", "label": "A"}),
        ({"type": "qa"}, {"question": "q", "answer": "a"}, {"question": "q"}),
        ({"type": "preference"}, {"prompt": "p", "chosen": "c", "rejected": "r"}, {"prompt": "p", "chosen": "", "rejected": "r"}),
        ({"type": "sft"}, {"instruction": "i", "response": "r"}, {"instruction": "", "response": "r"}),
        ({"type": "summarization"}, {"document": "d", "summary": "s"}, {"document": "d"}),
        ({"type": "distillation"}, {"instruction": "i", "teacher_response": "t", "reasoning": "r"}, {"instruction": "i", "teacher_response": "t", "reasoning": ""}),
        ({"type": "conversation"}, {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]}, {"messages": [{"role": "assistant", "content": "a"}, {"role": "user", "content": "u"}]}),
        ({"type": "ner"}, {"text": "t"}, {"entities": []}),
    ],
)
def test_parsers(spark, task, good, bad):
    got = parsed(spark, task, json.dumps([good, bad, 7, "x", None]), "no JSON", json.dumps(good), "5", None)
    assert len(got) == 1 and got[0]["batch_index"] == 0 and got[0]["pos"] == 0


def test_ner_spans(spark):
    text = "Ann met Bob"
    ents = [("Ann", 0, 3), ("Bob", 8, 11), ("Bob", -3, 99), ("Bob", 7, 10)]
    reply = json.dumps([{"text": text, "entities": [{"text": t, "label": "P", "start": a, "end": b} for t, a, b in ents] + [{"text": "Ann"}]}])
    assert [(e["text"], e["start"]) for e in parsed(spark, {"type": "ner"}, reply)[0]["entities"]] == [("Ann", 0), ("Bob", 8), ("Bob", -3)]


def test_one_bad_item_goes_alone(spark):
    assert len(parsed(spark, {"type": "qa"}, '[{"question": 5, "answer": "a"}, {"question": "q", "answer": "a", "context": "c"}]')) == 1


@pytest.mark.parametrize("name", TASKS)
def test_prompts_and_mock(spark, name):
    t = create_task({"type": name, "task": {"domain": "cooking", "labels": ["positive", "negative"]}})
    m = t.build_messages(4)
    assert [x["role"] for x in m] == ["system", "user"] and "cooking" in m[1]["content"] and "4" in m[1]["content"]
    reply = MockProvider().complete(m).content
    assert len(t.valid(t.parse(spark.createDataFrame([(reply,)], "response string"))).collect()) in (2, 4)
    assert reply == MockProvider().complete(m).content


def test_unknown_names():
    for make in (lambda: create_task({"type": "x"}), lambda: create_strategy("x"), lambda: create_provider({"kind": "x"}), lambda: create_strategy("cot", {"reasoning_depth": "x"})):
        with pytest.raises(ValueError):
            make()


@pytest.mark.parametrize("name", STRATEGIES)
def test_strategies_do_not_change_their_input(name):
    m = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]
    s = create_strategy(name, {"auto_optimize": True})
    first, second = s.apply(m, 0), s.apply(m, 1)
    assert m[1]["content"] == "u" and second[1]["content"].startswith("u\n\n") and second != first
    assert first[0] == m[0]


def test_strategy_rotation():
    m = [{"role": "user", "content": "u"}]
    s = create_strategy("persona", {"personas": ["A", "B"]})
    assert s.apply(m, 0) == s.apply(m, 2) != s.apply(m, 1)
    few = create_strategy("few_shot", {"examples": [{"a": i} for i in range(5)]}).apply(m, 0)[0]["content"]
    assert '{"a": 2}' in few and '{"a": 3}' not in few
    assert create_strategy("evolinstruct", {"evolution_rounds": 3}).apply(m, 6)[0]["content"].count("\n- ") == 3


def test_auto_optimize_once():
    calls = []

    class P:
        def complete(self, messages, temperature=0.7):
            calls.append(messages)
            return CompletionResult("Rating: 3/5\nImprovements:\n- be brief")

    s = AutoOptimize(create_strategy("direct"), P(), lambda _: [{"text": "t"}])
    m = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]
    assert s.apply(m, 0)[0]["content"].endswith("- be brief") and s.apply(m, 1)[0]["content"].endswith("- be brief")
    assert len(calls) == 2 and m[0]["content"] == "s"


def test_providers():
    assert isinstance(create_provider({"kind": "ollama", "model": "m"}), ChatProvider)
    assert isinstance(create_provider({"kind": "anthropic"}), AnthropicProvider)
    assert "max_tokens" not in ChatProvider()._body([], 0.5, None) and ChatProvider()._body([], 0.5, 7)["max_tokens"] == 7
    assert split_system([{"role": "system", "content": "a"}, {"role": "user", "content": "u"}, {"role": "system", "content": "b"}]) == ("b", [{"role": "user", "content": "u"}])
    assert CompletionResult("", 1, None).total_tokens is None and CompletionResult("", 1, 2).total_tokens == 3
    assert asyncio.run(MockProvider().async_complete([{"role": "user", "content": "u"}])).content


def test_cost_and_estimate():
    assert engine.estimate_cost(1_000_000, 1_000_000, "gpt-4o") == 12.5
    assert engine.estimate_cost(10, 10, "unheard of") == engine.estimate_cost(10, 10, "") == 0
    assert engine.estimate_cost(1_000_000, 0, "gpt-4o-mini-2024") == 0.15
    assert engine.estimate_run({"generation": {"num_samples": 10, "batch_size": 5}, "labels": ["a"]})["num_batches"] == 3
    assert engine.config_hash({"a": 1, "output": 2}) == engine.config_hash({"a": 1}) != engine.config_hash({"a": 2})


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("SET", "x")
    assert config.substitute({"a": ["${SET}", "${UNSET:-d}", "${UNSET}"]}) == {"a": ["x", "d", ""]}
    base = {"a": {"b": 1, "c": 2}}
    assert config.merge(base, {"a": {"b": 3}, "d": [1]}) == {"a": {"b": 3, "c": 2}, "d": [1]} and base["a"]["b"] == 1
    (tmp_path / "c.yaml").write_text("generation: {num_samples: 7}\n")
    c = load_config(str(tmp_path / "c.yaml"))
    assert c["generation"]["num_samples"] == 7 and c["generation"]["batch_size"] == 10
    assert load_config(str(tmp_path / "none.yaml"))["output"]["format"] == "jsonl"


def _config(tmp_path, **more):
    c = {
        "type": "classification",
        "task": {"labels": ["positive", "negative"]},
        "provider": {"kind": "mock", "model": "gpt-4o"},
        "generation": {"num_samples": 10, "batch_size": 4, "max_workers": 2},
        "quality": {"similarity_threshold": 0.95},
        "output": {"path": str(tmp_path / "out.jsonl"), "format": "jsonl"},
        "checkpoint_dir": str(tmp_path / "state"),
    }
    return config.merge(c, more)


def test_generate(spark, tmp_path):
    c = _config(tmp_path)
    out = generate(spark, c)
    assert out.count() == 10
    lines = [json.loads(x) for x in (tmp_path / "out.jsonl").read_text().splitlines()]
    assert len(lines) == 10 and set(lines[0]) == {"text", "label"} and {x["label"] for x in lines} == {"positive", "negative"}
    assert [r["text"] for r in out.orderBy("seq").collect()] == [x["text"] for x in lines]
    again = generate(spark, c)
    assert [r["text"] for r in again.orderBy("seq").collect()] == [x["text"] for x in lines]


def test_resume_calls_missing_batches_only(spark, tmp_path):
    c = _config(tmp_path)
    own = json.dumps([{"text": "restored from before", "label": "positive"}])
    engine.Checkpoint(spark, c).save(spark.createDataFrame([(1, own, 5, 5, 1)], engine.REPLIES))
    out = generate(spark, c, resume=True)
    assert out.filter("text = 'restored from before'").count() == 1
    assert engine.Checkpoint(spark, c).load() is None


def test_budget_and_stream(spark, tmp_path):
    c = _config(tmp_path, generation={"num_samples": 100, "max_workers": 1, "max_cost": 0.000001}, stream=True)
    out = generate(spark, c)
    assert 0 < out.count() <= 16  # one wave of four batches
    assert len((tmp_path / "out.jsonl").read_text().splitlines()) == out.count()


def test_failing_model(spark, tmp_path):
    c = _config(tmp_path, provider={"kind": "mock", "fail_every": 1})
    assert generate(spark, c).count() == 0 and (tmp_path / "out.jsonl").read_text() == ""


def test_grounding_and_language(spark, tmp_path):
    assert [engine.grounding_window(i, 5) for i in range(3)] == [[0, 1, 2], [3, 4, 0], [1, 2, 3]]
    assert engine.grounding_window(4, 1) == [0]
    m = engine.in_language([{"role": "system", "content": "s"}, {"role": "user", "content": "u"}], "fr")
    assert "French" in m[1]["content"] and m[0]["content"] == "s"
    for n in (3, 14):
        folder = tmp_path / f"docs{n}"
        folder.mkdir()
        for i in range(n):
            (folder / f"{i:02}.txt").write_text(f"passage {i} about subject{i}")
        task = create_task({"type": "qa", "domain": "subject7"})
        rows = engine.render_prompts(spark, {"from_docs": str(folder), "generation": {"batch_size": 3}}, task, create_strategy("direct"), [0, 1]).collect()
        assert all(json.loads(r["messages"])[1]["content"].count(" about subject") == 3 for r in rows)
    assert "passage 7" in rows[0]["messages"]


# --- files ---


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "t1", "label": "x", "source": "s", "metadata": {"context": "c", "source": "old"}}\n\n{"label": null, "k": [1, 2]}\n')
    a = read_samples(spark, str(tmp_path / "a.jsonl")).orderBy("seq").collect()
    assert [(r["seq"], r["text"], r["label"]) for r in a] == [(0, "t1", "x"), (1, "", None)]
    assert a[0]["context"] == "c" and a[0]["extra"] == {"source": "s"} and json.loads(a[1]["extra"]["k"]) == [1, 2]
    (tmp_path / "b.CSV").write_text('text,label,note\n"a ""q"",\nb",x,\nc,,n\n')
    b = read_samples(spark, str(tmp_path / "b.CSV")).orderBy("seq").collect()
    assert [(r["text"], r["label"], r["extra"]) for r in b] == [('a "q",\nb', "x", None), ("c", "", {"note": "n"})]


def test_seq_is_dense(spark):
    df = with_seq(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5), "k")
    assert [(r["k"], r["seq"]) for r in df.orderBy("k").collect()] == [(i, i) for i in range(1000)]


@pytest.fixture
def rich(spark):
    t = spark.createDataFrame([(0, "hi", None, "do it", "done", "be kind"), (1, "only text", "lab", None, None, None), (2, "bare", None, None, None, None)], "seq long, text string, label string, instruction string, response string, system_prompt string")
    return t.withColumns({"messages": F.expr(f"cast(null as {METADATA['messages']})"), "extra": F.expr("case when seq = 1 then map('k', '[1]', 'w', 'plain') end")})


def test_sinks(spark, rich, tmp_path):
    got = {}
    for fmt, name in (("jsonl", "a.jsonl"), ("openai", "b.jsonl"), ("sharegpt", "c.jsonl"), ("alpaca", "d.json"), ("csv", "e.csv"), ("parquet", "f"), ("huggingface", "g")):
        export(rich, str(tmp_path / "new" / name), fmt)
        if name.endswith(".jsonl"):
            got[fmt] = [json.loads(x) for x in (tmp_path / "new" / name).read_text().splitlines()]
    assert got["jsonl"][1] == {"text": "only text", "label": "lab", "k": [1], "w": "plain"}
    assert [m["role"] for m in got["openai"][0]["messages"]] == ["system", "user", "assistant"]
    assert [m["role"] for m in got["openai"][2]["messages"]] == ["user"]
    assert got["sharegpt"][1]["conversations"] == [{"from": "human", "value": "only text"}, {"from": "gpt", "value": "lab"}]
    assert len(got["sharegpt"][2]["conversations"]) == 1
    assert json.loads((tmp_path / "new/d.json").read_text())[1] == {"instruction": "only text", "input": "", "output": "lab"}
    assert (tmp_path / "new/e.csv").read_text().splitlines()[0].startswith("text,label")
    assert spark.read.parquet(str(tmp_path / "new/f")).count() == 3 and (tmp_path / "new/g/dataset_info.json").exists()
    export(rich.filter("false"), str(tmp_path / "none.csv"), "csv")
    assert not (tmp_path / "none.csv").exists()
    with pytest.raises(ValueError):
        export(rich, "x", "xml")


def test_streaming_writer(rich, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text("old\n")
    with StreamingWriter(str(path)) as w:
        w.write_batch(rich)
        w.write_batch(rich.filter("seq = 0"))
    assert w.count == 4 and len(path.read_text().splitlines()) == 4


def test_loaders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("caf\xe9 au lait".encode("latin-1"))
    (tmp_path / "sub/b.MD").write_text("# Title")
    (tmp_path / "c.html").write_text("<p>one<script>no()</script></p><style>x</style><p>two</p>")
    (tmp_path / "d.xyz").write_text("unknown")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    got = [(r["source"].rsplit("/", 1)[1], r["text"]) for r in load_documents(spark, str(tmp_path)).collect()]
    assert got == [("a.txt", "café au lait"), ("c.html", "one\n\ntwo"), ("b.MD", "# Title")]
    assert load_documents(spark, str(tmp_path / "nothing")).count() == 0


# --- command line ---


def test_cli(spark, tmp_path, capsys):
    source = tmp_path / "in.jsonl"
    source.write_text("".join(json.dumps({"text": t, "label": "x"}) + "\n" for t in ("a text of some length", "A text of some  length", "short", "another line of text")))
    assert cli.main(["validate", str(source)]) == 0
    assert [json.loads(x)["text"] for x in (tmp_path / "in_clean.jsonl").read_text().splitlines()] == ["a text of some length", "another line of text"]
    assert cli.main(["export", str(source), "-f", "alpaca"]) == 0 and (tmp_path / "in_alpaca.json").exists()
    capsys.readouterr()
    assert cli.main(["evaluate", str(source), "--json"]) == 0 and json.loads(capsys.readouterr().out)["count"] == 4
    assert cli.main(["init", "ner", "--entity-types", "A,B", "--output", str(tmp_path / "c.yaml")]) == 0
    assert load_config(str(tmp_path / "c.yaml"))["task"]["entity_types"] == ["A", "B"]
    assert cli.main(["init", "nothing"]) == 1
    capsys.readouterr()
    assert cli.main(["generate", "-c", str(tmp_path / "c.yaml"), "--num-samples", "10", "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out)["num_batches"] == 2
    assert cli.main(["info"]) == 0 and "evolinstruct" in capsys.readouterr().out
    args = ["generate", "--task", "qa", "--provider", "mock", "--num-samples", "4", "--output", str(tmp_path / "o.jsonl"), "--config", str(tmp_path / "none.yaml")]
    assert cli.main(args) == 0 and len((tmp_path / "o.jsonl").read_text().splitlines()) == 4
    assert cli.main(["push", str(tmp_path / "o.jsonl"), str(tmp_path / "hub"), "me/x"]) == 0 and (tmp_path / "hub/README.md").exists()
