import random

import pytest
from pyspark.sql import functions as F

from sievecraft.card import generate_card, publish, size_category
from sievecraft.functions import text as T
from sievecraft.operators import metrics
from sievecraft.operators.chunking import chunk_text
from sievecraft.operators.dedup import deduplicate, exact_dedup, greedy_losers, similar_pairs
from sievecraft.operators.filters import LanguageFilter, PIIFilter, ToxicityFilter, detect_language, validate_samples
from sievecraft.operators.judge import LLMJudge, parse_scores
from sievecraft.operators.pipeline import build_steps, run_steps
from sievecraft.operators.retrieval import retrieve


def samples(spark, *rows):
    rows = [(i, *(r if isinstance(r, tuple) else (r, None))) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "seq long, text string, label string")


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def seqs(df):
    return sorted(r["seq"] for r in df.collect())


# --- text ---


@pytest.mark.parametrize("raw, want", [("  A b\n\nC ", "a b c"), ("a\x1cb", "a b"), ("", "")])
def test_normalize(spark, raw, want):
    assert one(spark, raw, T.normalize) == want == " ".join(raw.lower().split())


@pytest.mark.parametrize("raw, want", [("hello", ["hel", "ell", "llo"]), ("ab", ["ab"]), ("", [""]), ("aaaa", ["aaa"])])
def test_shingles(spark, raw, want):
    assert one(spark, raw, T.shingles) == want


def test_words_and_jaccard(spark):
    assert one(spark, "Café, au_lait 7!", T.words) == ["café", "au_lait", "7"]
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 0.0]


@pytest.mark.parametrize(
    "reply, want",
    [
        ("<think>a\nb</think> [1]", "[1]"),
        ("<reasoning>x</reasoning>[1]<|eot|> tail", "[1]"),
        ("```json\n[1]\n```", "[1]"),
        ("```\n[1]\n``` and ``` more", "[1]\n``` and"),
        ("```", ""),
        (" [1] ", "[1]"),
    ],
)
def test_clean_response(spark, reply, want):
    assert one(spark, reply, T.clean_response) == want


# --- dedup and validation ---


def test_exact_dedup_keeps_the_first(spark):
    assert seqs(exact_dedup(samples(spark, "Same text", "other", "same  TEXT", None, None))) == [0, 1, 3, 4]


def test_fuzzy_dedup(spark):
    s = samples(spark, "The quick brown fox jumps over the lazy dog", "The quick brown fox jumps over the lazy dog!", "Something else altogether")
    assert seqs(deduplicate(s)) == [0, 2]
    assert seqs(deduplicate(s, 1.0)) == [0, 1, 2]


@pytest.mark.parametrize("threshold", [0.1, 0.5, 0.85])
def test_similar_pairs_against_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 100))
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    texts = base + [x[: len(x) // 2] + rng.choice("xyz") + x[len(x) // 2 :] for x in base]
    texts = list(dict.fromkeys(" ".join(t.split()) for t in texts))
    sets = [{t[i : i + 3] for i in range(max(1, len(t) - 2))} for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold}
    got = {(r["a"], r["b"]) for r in similar_pairs(samples(spark, *texts), threshold).collect()}
    assert got == want and len(want) > 10


@pytest.mark.parametrize("limit", [1000, 0])
def test_greedy_by_task_and_by_rounds(spark, limit):
    rng = random.Random(7)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)} | {(100, 101), (101, 102), (102, 103)})
    gone = set()
    for b in sorted({b for _, b in pairs}):
        if any(a not in gone for a, c in pairs if c == b):
            gone.add(b)
    assert set(seqs(greedy_losers(spark.createDataFrame(pairs, "a long, b long"), limit))) == gone
    assert {101, 103} <= gone and 102 not in gone


def test_validate(spark):
    s = samples(spark, ("short", "a"), ("long enough text", "a"), ("long enough text", "z"), ("long enough text", None), ("long enough text", ""), ("x" * 60, "a"), (None, "a"))
    assert seqs(validate_samples(s, 10, 50, ["a"])) == [1, 3, 4]


# --- detectors ---


@pytest.mark.parametrize(
    "text, want",
    [("mail a.b@example.com now", ["email"]), ("call (555) 123-4567", ["phone_us"]), ("id 123-45-6789.", ["ssn"]), ("4111 1111 1111 1111", ["credit_card"]), ("at 192.168.0.1:80", ["ip_address"]), ("1234567890123 or 999.1.1.1", []), (None, [])],
)
def test_pii(spark, text, want):
    assert one(spark, text, PIIFilter().detected) == want


def test_pii_actions(spark):
    s = samples(spark, "write to me@example.com please", "nothing to see", None)
    out, r = PIIFilter("remove").process(s)
    assert seqs(out) == [1, 2] and (r.removed, r.flagged, r.details) == (1, 0, {"pii_counts": {"email": 1}})
    out, r = PIIFilter("redact").process(s)
    first = out.orderBy("seq").first()
    assert first["text"] == "write to [REDACTED] please" and first["pii_redacted"] and (r.removed, r.flagged) == (0, 0)
    out, r = PIIFilter().process(s)
    assert out.orderBy("seq").first()["pii_detected"] == ["email"] and r.flagged == 1
    for bad in ({"action": "x"}, {"patterns": ["x"]}):
        with pytest.raises(ValueError):
            PIIFilter(**bad)


def test_toxicity(spark):
    s = samples(spark, "a BAD word, and bad again", "badly put", "so very bad indeed")
    f = ToxicityFilter(keywords=["bad", "very bad"])
    out, r = f.process(s)
    assert [x["toxic_keywords"] for x in out.orderBy("seq").collect()] == [["bad"], None, ["very bad"]]
    assert (r.flagged, r.details["total_matches"]) == (2, 3)
    assert seqs(ToxicityFilter(action="remove", keywords=["bad"]).process(s)[0]) == [1]
    assert ToxicityFilter(keywords=[]).process(s)[1].flagged == 3
    with pytest.raises(ValueError):
        ToxicityFilter(method="model")


@pytest.mark.parametrize(
    "text, want",
    [("The nation is going to the end of the king and the men there", "en"), ("La situación de los estados que se encuentran en el país", "es"), ("Die Entwicklung der deutschen Sprache und das Denken", "de"), ("hi", "unknown"), ("这是一个中文的句子我们在这里写的", "unknown")],
)
def test_language(spark, text, want):
    got = one(spark, text, detect_language)
    assert got["language"] == want and (got["confidence"] > 0) == (want != "unknown")


def test_language_filter(spark):
    s = samples(spark, "The nation is going to the end of the king and the men there", "Die Entwicklung der deutschen Sprache und das Denken", None)
    out, r = LanguageFilter("en").process(s)
    assert seqs(out) == [0] and r.removed == 2 and r.details["language_distribution"] == {"en": 1, "de": 1, "unknown": 1}
    out, r = LanguageFilter("en", "flag").process(s)
    assert [x["detected_language"] for x in out.orderBy("seq").collect()] == [None, "de", "unknown"] and r.flagged == 2


# --- balance and metrics ---


def test_balance(spark):
    s = samples(spark, *[("a text", "pos")] * 10, *[("a text", "neg")] * 2, ("a text", None))
    _, r = metrics.BalanceChecker(max_ratio=2).process(s)
    assert r.details["imbalanced"] and r.details["ratio"] == 5 and r.output_count == 13
    out, r = metrics.BalanceChecker("undersample", 2).process(s)
    got = [x["label"] for x in out.orderBy("seq").collect()]
    assert got == ["pos"] * 4 + ["neg"] * 2 + [None] and r.removed == 6
    assert "skipped" in metrics.BalanceChecker().process(samples(spark, "no label"))[1].details
    for bad in ({"strategy": "x"}, {"max_ratio": 0.5}):
        with pytest.raises(ValueError):
            metrics.BalanceChecker(**bad)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_ngrams_cross_rows(spark, block):
    rng = random.Random(block)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 1, 2, 5]))) for _ in range(25)]
    stream = " ".join(texts).split()
    got = {r["n"]: (r["total"], r["distinct"]) for r in metrics.distinct_ngrams(samples(spark, *texts), block=block).collect()}
    for n in (1, 2, 3):
        grams = [tuple(stream[i : i + n]) for i in range(len(stream) - n + 1)]
        assert got[n] == (len(grams), len(set(grams)))


def test_evaluate(spark):
    got = metrics.evaluate_dataset(samples(spark, ("a b c d", "x"), ("a b", "x"), ("e", "y")))
    assert got["count"] == 3 and got["num_labels"] == 2 and got["label_entropy"] == pytest.approx(0.9183)
    assert got["label_distribution"] == {"x": 2, "y": 1} and got["vocabulary_size"] == 5 and got["self_bleu"] == 0.0
    assert "error" in metrics.evaluate_dataset(samples(spark, "x").filter("false"))


def test_bleu(spark):
    df = spark.createDataFrame([("a a b", "a a a c"), ("", "a")], "r string, h string")
    assert [r[0] for r in df.select(metrics.unigram_bleu(T.tokens(F.col("r")), T.tokens(F.col("h")))).collect()] == [0.5, 0.0]


def test_entities(spark):
    df = spark.createDataFrame([([("A",), (None,)],), ([("A",)],)], "entities array<struct<label: string>>")
    assert {r["label"]: r["n"] for r in metrics.entity_distribution(df).collect()} == {"A": 2, "unknown": 1}


def test_steps_in_sequence(spark):
    s = samples(spark, ("mail me@example.com", "x"), ("plain", "x"))
    out, report = run_steps(s, build_steps([{"pii": {"action": "remove"}}, {"nothing": {}}, {"diversity": None}]))
    assert seqs(out) == [1] and [x.name for x in report.steps] == ["pii", "diversity"] and (report.input_count, report.output_count) == (2, 1)
    assert report.to_frame(spark).count() == 2


# --- judge ---


@pytest.mark.parametrize(
    "reply, want",
    [('[{"index": 1, "score": 4.5}]', [3.0, 4.5]), ("scores 4.5 and 2", [4.5, 2.0]), ("just 4", [3.0, 3.0]), ("", [3.0, 3.0]), ('[{"index": 0}]', [3.0, 3.0])],
)
def test_scores(spark, reply, want):
    assert one(spark, reply, lambda c: parse_scores(c, F.lit(2), 3.0)) == want


def test_judge_survives_a_mute_model(spark):
    s = samples(spark, *[f"text {i}" for i in range(23)])
    out, r = LLMJudge({"kind": "mock"}).process(s)  # its reply holds no scores: all get the threshold
    assert out.count() == 23 and r.removed == 0
    with pytest.raises(ValueError):
        LLMJudge()


# --- retrieval, chunks, cards ---


def test_retrieval(spark):
    docs = spark.createDataFrame([(0, "apple banana"), (1, "banana cherry"), (2, "durian"), (3, "durian fig")], "doc_id long, text string")
    ask = spark.createDataFrame([(7, "apple"), (8, "nothing known")], "query_id long, text string")
    got = retrieve(docs, ask, 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [(7, 0), (7, 3), (7, 2), (8, 3), (8, 2), (8, 1)]
    assert got[0]["score"] > 0 and all(r["score"] == 0 for r in got[1:])


def test_chunks(spark):
    df = spark.createDataFrame([(1, "a" * 400 + "\n\n" + "b" * 400), (2, "  "), (3, "short"), (4, None)], "doc_id long, text string")
    got = chunk_text(df, 500, 50).orderBy("doc_id", "chunk_index").collect()
    assert [(r["doc_id"], r["chunk_index"], r["total_chunks"]) for r in got] == [(1, 0, 2), (1, 1, 2), (3, 0, 1)]
    assert got[1]["chunk"] == "a" * 50 + "b" * 400


def test_card(spark, tmp_path):
    s = samples(spark, ("a text", "x"), ("b text", "y"), ("c text", "y"))
    card = generate_card(s, "me/data", {"type": "classification", "provider": {"model": "m"}})
    assert "text-classification" in card and "n<1K" in card and card.index("| y | 2 |") < card.index("| x | 1 |")
    assert [size_category(n) for n in (500, 5_000, 50_000, 500_000, 1_000_000)] == ["n<1K", "1K<n<10K", "10K<n<100K", "100K<n<1M", "n>1M"]
    publish(s, str(tmp_path / "out"), "me/data")
    assert (tmp_path / "out/README.md").exists() and (tmp_path / "out/dataset_info.json").exists()


def test_similar_pairs_across_blocks(spark, monkeypatch):
    """Many small blocks find what brute force finds; what is moved is one sketch a row, less than its text."""
    import random

    import pyarrow as pa

    from sievecraft.operators import dedup

    r = random.Random(3)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.choice((5, 40, 300, 1500)))) for _ in range(40)]
    texts = base + [t[:-1] + "z" for t in base] + [t[: len(t) * 9 // 10] for t in base]
    monkeypatch.setattr(dedup, "BLOCK", 7)
    got = {(r["a"], r["b"]) for r in similar_pairs(samples(spark, *texts), 0.85).collect()}
    sets = [set(dedup.shingle_hashes(" ".join(t.split()))) for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j])}
    assert got == want and len(want) > 40
    rows = pa.record_batch({"seq": range(len(texts)), "norm": texts})
    marks = next(dedup._sketches(iter([rows]), 3)).column("sketch").to_pylist()
    assert len(marks) == len(texts) and all(len(m) <= max(32, len(t) // 4) for m, t in zip(marks, texts))


def test_neighbouring_numbers_are_redacted_whole(spark):
    df = spark.createDataFrame([("x +1 (836) 555-9331 +1 (774) 555-7955 y",)], "text string")
    assert df.select(PIIFilter("redact").redacted(df["text"]).alias("t")).first()["t"] == "x [REDACTED] [REDACTED] y"
