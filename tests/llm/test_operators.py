import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.llm import imatch, lines, packing, pieces, quality, secrets, simhash, suffixes, token_counts, windows
from sievecraft.llm import _components
from sievecraft.llm._components import components
from sievecraft.llm._minhash import shingles
from sievecraft.llm._shared import documents, pack, unpack

from . import brute

LONG = " ".join(f"word{i * 7919 % 1009} and." for i in range(9000))
SYLLABLES = "the of and in on er re th ha ti sh ing ou st".split() + [" "] * 5
KEY = "AKIA" + "ABCDEFGH12345678"
#: Nulls in any column, empty, blank and very long texts, ties and repeated rows.
MESSY = [
    (1, "A first line that ends well.\nAnother line which is quite different.", "en"),
    (1, "A first line that ends well.\nAnother line which is quite different.", "en"),
    (2, "A first line that ends well!\nSomething else is written here, too.", None),
    (3, None, "en"),
    (4, "", "en"),
    (5, " \n\t", "en"),
    (None, "No id is given for this text. It has two sentences.", "de"),
    (None, None, None),
    (6, LONG, "en"),
    (7, f"token: {KEY}zz and the key {KEY} stand here.", "en"),
    (8, f"the key {KEY} stands there as well, été ▁ 日本 𝒳.", "fr"),
    (9, "x", "en"),
]
CLASHING = ("row", "hash", "chunk", "bucket", "keys", "size", "number", "bin", "blob", "node", "root", "line", "key", "digest", "first", "n", "pos", "lines", "low")


@pytest.fixture(scope="module")
def messy(spark):
    t = spark.createDataFrame(MESSY, "doc_id long, text string, lang string").withColumn("n_chars", F.length("text").cast("long"))
    return t.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="module")
def empty(messy):
    return messy.filter("false")


def rows(df):
    return rows_of(df.collect())


def rows_of(found):
    return sorted((tuple(r) for r in found), key=repr)


def test_packed_keys_come_back():
    for n in (0, 1, 1000):
        keys = np.sort(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
        assert (unpack(pack(keys)) == keys).all()


@pytest.mark.parametrize("limit", [None, 0])
def test_components_by_task_and_by_rounds(spark, limit):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), limit).collect()}
    nodes = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    root = brute.components(len(nodes), [(at[a], at[b]) for a, b in edges])
    assert found == {x: nodes[root[i]] for i, x in enumerate(nodes) if root[i] != i}


def test_components_of_repeated_edges_need_no_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(_components, "table", lambda df, what, real=_components.table: written.append(what) or real(df, what))
    edges = spark.createDataFrame([(i % 40, i % 40 + 1) for i in range(800)], "a long, b long").repartition(16)
    found = {r["node"]: r["root"] for r in components(edges, 200).collect()}
    assert found == {x: 0 for x in range(1, 41)}
    assert len(written) == 1  # 16 partitions have more than 200 edges, but of 41 nodes


# --- line dedup ---


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 8, 13])
def test_shingles_are_hashed_by_what_they_hold(size):
    texts = ["", "a", "abcabcabcabcabcabc", "xyzabcabcabcabcé漢", "bcabcabcabcabca"]
    flat, counts = shingles(texts, size)
    parts = [t[i : i + size] for t in texts for i in range(max(1, len(t) - size + 1))]
    assert counts.sum() == len(parts) == len(flat)
    assert all((flat[i] == flat[j]) == (parts[i].ljust(size, "\0") == parts[j].ljust(size, "\0")) for i in range(len(parts)) for j in range(i))


def test_sketches_leave_out_no_near_pair(monkeypatch):
    monkeypatch.setattr(lines, "PAIRED", 60)
    rng = random.Random(4)
    base = ["".join(rng.choices(SYLLABLES, k=rng.randrange(2, 40)))[:128] for _ in range(150)]
    edit = lambda x, k: x[:k] + rng.choice("#éx") + x[k + rng.randrange(3) :]
    all_ = [y for x in base for y in (x, edit(x, rng.randrange(len(x))), edit(x, len(x) - 1))]
    key = np.repeat(np.array([1, 2, 3, 4, 5], np.uint64), [40, 20, 150, 59, 181])
    flat, counts = shingles(all_, 4)
    i, j = lines.alike(key, lines.sketches(flat, counts), counts, 0.8)
    root = brute.components(len(all_), list(zip(i.tolist(), j.tolist())))
    near = [(a, b) for a, b in brute.line_pairs(all_) if key[a] == key[b] and len(brute.shingles(all_[a], 4) & brute.shingles(all_[b], 4)) >= 0.8 * len(brute.shingles(all_[a], 4) | brute.shingles(all_[b], 4))]
    assert len(near) > 40 and all(root[a] == root[b] for a, b in near)
    assert (key[i] == key[j]).all()


def test_short_lines_are_no_candidates_by_chance(spark):
    rng = random.Random(9)
    base = sorted({"".join(rng.choices(SYLLABLES, k=60))[:110].strip() for _ in range(6000)})
    all_ = base + [x[:50] + "#" + x[51:] for x in base[:200]]
    df = spark.createDataFrame([(i, "\n".join(all_[i : i + 100])) for i in range(0, len(all_), 100)], "doc_id long, text string").repartition(6)
    assert components(lines.band_links(df, 8, 12, 5)).count() < 250  # the edited ones; without sketches 700 others as well
    root = near_roots(spark, all_)
    assert sum(root[a] == root[b] for a, b in zip(base, all_[len(base) :])) >= 0.95 * 200


def test_lines_against_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("alpha beta gamma delta omega kappa sigma lambda theta".split()) + str(rng.randrange(99)) for _ in range(14)) for _ in range(30)]
    docs = []
    for i in range(40):
        own = [rng.choice(base) for _ in range(3)]
        own = [x[:-1] + rng.choice("abc") if rng.random() < 0.4 else x for x in own]
        docs.append((i, "\n".join([own[0], "", " " + own[1], own[2], own[0]])))
    got = [(r["doc_id"], r["text"]) for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(got) == brute.dedup_lines(docs)


def test_lines_recall(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    base = ["".join(rng.choice(letters) for _ in range(120)).strip() for _ in range(300)]
    near = [x[:60] + rng.choice("XYZ") + x[61:] for x in base]
    all_ = sorted({*base, *near})
    sets = {x: brute.shingles(x, 8) for x in all_}
    true = {frozenset(p) for p in zip(base, near) if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])}
    root = near_roots(spark, all_)
    assert len(true) > 200
    assert sum(len({root[x] for x in p}) == 1 for p in true) >= 0.95 * len(true)


def near_roots(spark, all_):
    """Name of its group for each line."""
    key = {x: np.array(lines.line_key(x), np.uint64).view(np.int64).item() for x in all_}
    df = spark.createDataFrame([(i, "\n".join(all_[i : i + 100])) for i in range(0, len(all_), 100)], "doc_id long, text string")
    root = {r["node"]: r["root"] for r in lines.near_lines(df).collect()}
    return {x: root.get(k, k) for x, k in key.items()}


def test_short_lines_with_a_wrong_letter(spark):
    rng = random.Random(6)
    words = "the of harbour lights keeper when night rain was over and they had gone down to see ships again".split()
    base = sorted({" ".join(rng.choices(words, k=30))[: rng.randrange(45, 90)].strip() for _ in range(200)})
    edited = [x[: (k := rng.randrange(5, len(x) - 5))] + "#" + x[k + 1 :] for x in base]
    root = near_roots(spark, sorted({*base, *edited}))
    assert sum(root[a] == root[b] for a, b in zip(base, edited)) >= 0.9 * len(base)


@pytest.mark.parametrize("most", [20, 4096])
def test_large_groups_of_lines_in_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(lines, "GROUP_LINES", most)
    rng = random.Random(8)
    frame = "The entry of the register that has the number {} was read, noted and put back on its shelf by the keeper."
    other = "Nobody of the town knew {} when the old ships were counted by the harbour master and his clerks last year."
    all_ = sorted({t.format(rng.choice(["", "0", "77"]) + str(rng.randrange(10**k))) for t in (frame, other) for k in range(1, 12) for _ in range(25)})
    root, want = near_roots(spark, all_), brute.line_groups(all_)
    pairs = lambda g: {(a, b) for a in all_ for b in all_ if g[a] == g[b]}
    assert pairs(root) <= pairs(want) and len(pairs(root)) >= 0.95 * len(pairs(want))


def test_a_frame_with_twenty_thousand_numbers(spark):
    all_ = [f"The entry of the register that has the number {i * 37 + 123456:06d} was read, noted and put back on its shelf by the keeper of it." for i in range(20000)]
    root = near_roots(spark, all_)
    assert len(set(root.values())) == 1


def test_lines_edge_cases(messy, empty):
    out = lines.dedup_lines(messy)
    assert out.columns == messy.columns
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert got >= {(3, None), (4, ""), (5, " \n\t"), (None, None), (9, "x"), (6, LONG)}
    assert (2, "Something else is written here, too.") in got  # its first line nearly repeats
    assert sum(r["doc_id"] == 1 for r in out.collect()) == 2  # equal rows keep the same lines
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["row"] == "own row" for r in out.collect())
    assert lines.dedup_lines(empty).count() == 0


# --- packing ---


@pytest.mark.parametrize("seed", range(3))
def test_packing_against_brute_force(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 3, 3, 7, 50, 99, 100, 101, 250, rng.randrange(300)]) for _ in range(300)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n int")
    out = packing.pack(df, 100, F.col("n")).collect()
    assert brute.by_bin(out) == brute.pack(sizes, 100)
    placed = {}
    for r in out:
        placed[r["doc_id"]] = placed.get(r["doc_id"], 0) + r["n_tokens"]
    assert placed == {i: n for i, n in enumerate(sizes) if n}
    assert {(r["bin"], r["slot"]) for r in out} and len({(r["bin"], r["slot"]) for r in out}) == len(out)


SIZES = {
    "uniform": lambda rng: [rng.randrange(1, 90) for _ in range(300)],
    "two sizes": lambda rng: [75] * 40 + [5] * 40,
    "small first": lambda rng: [rng.choice([1, 2, 3]) for _ in range(200)] + [rng.randrange(60, 99) for _ in range(60)],
    "one size": lambda rng: [7] * 150 + [90] * 50,
}


@pytest.mark.parametrize("sizes", SIZES)
def test_ranges_do_not_change_the_packing(spark, monkeypatch, sizes):
    sizes = SIZES[sizes](random.Random(9))
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n int").coalesce(1)
    one = rows(packing.pack(df, 100, F.col("n")))
    monkeypatch.setattr(packing, "RANGE_ROWS", 20)
    out = packing.pack(df, 100, F.col("n")).collect()
    assert sorted(r["n_tokens"] for r in out) == sorted(sizes)
    assert rows_of(out) == one
    assert len(brute.by_bin(out)) <= len(brute.pack(sizes, 100))


def test_packing_edge_cases(messy, empty):
    out = packing.pack(messy, 50).collect()
    n = {}
    for r in out:
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + r["n_tokens"]
    assert n[6] == 18000 and n[9] == 1 and n[None] == 11 and not {3, 4, 5} & set(n)
    assert n[1] == 2 * 12
    assert packing.pack(empty).count() == 0


# --- token counts ---


def test_token_counts_and_cache(spark, messy, empty, tmp_path):
    import tiktoken

    ranks, cache = token_counts.default_ranks(), str(tmp_path / "cache")
    enc = token_counts._encoder(ranks, token_counts.PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    out = token_counts.token_counts(messy, cache).collect()
    assert len(out) == len(MESSY)
    want = sorted((repr(i), len(enc.encode_ordinary((t or "").replace("\r\n", "\n").strip(" ")))) for i, t, _ in MESSY)
    assert sorted((repr(r["doc_id"]), r["n_tokens"]) for r in out) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({(t or "").strip(" ") for _, t, _ in MESSY})
    token_counts.token_counts(messy, cache)
    assert spark.read.parquet(cache).count() == stored  # only misses are encoded
    more = messy.select("doc_id", "text").union(spark.createDataFrame([(99, "new text\r\nhere")], "doc_id long, text string"))
    token_counts.token_counts(more, cache)
    assert spark.read.parquet(cache).count() == stored + 1
    token_counts.token_counts(messy, cache, pattern=r"\s+|\S+")
    assert spark.read.parquet(cache).count() == 2 * stored + 1  # another version, other keys
    assert token_counts.token_counts(empty).count() == 0


# --- secrets ---


def test_secrets_ledger(spark, messy, empty):
    ledger = secrets.Ledger(spark)
    found = secrets.scan_secrets(messy, secrets.RULES[:1], ledger)
    aws = hashlib.sha256(KEY.encode()).hexdigest()
    assert sorted((r["doc_id"], r["rule"], r["secret_sha256"], r["n_matches"]) for r in found.collect()) == [(7, "aws_access_key", aws, 2), (8, "aws_access_key", aws, 1)]
    assert ledger.scan(messy, secrets.RULES[:1]) == 0
    # a new path of a known blob needs no scan but has its findings
    moved = messy.select(F.lit(70).cast("long").alias("doc_id"), "text").filter("text LIKE 'token%'")
    assert ledger.scan(moved, secrets.RULES[:1]) == 0
    assert [r["doc_id"] for r in secrets.scan_secrets(moved, secrets.RULES[:1], ledger).collect()] == [70]
    # a new rule: all blobs again, for it alone
    texts = len({t for _, t, _ in MESSY if t is not None})
    assert ledger.scan(messy, secrets.RULES) == texts
    pairs = ledger.read("scanned", "blob string, version string")
    assert pairs.count() == pairs.distinct().count() == texts * len(secrets.RULES)
    assert secrets.scan_secrets(empty).count() == 0


def test_secrets_against_brute_force(messy):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((repr(i), rule, sha(m), n) for (i, rule, m), n in brute.secrets([(i, t) for i, t, _ in MESSY]).items())
    assert sorted((repr(r["doc_id"]), r["rule"], r["secret_sha256"], r["n_matches"]) for r in secrets.scan_secrets(messy).collect()) == want


def test_secrets_redacted(messy, empty):
    out = secrets.redact_secrets(messy)
    assert out.columns == messy.columns
    want = sorted(((i, None if t is None else brute.redacted(t)) for i, t, _ in MESSY), key=repr)
    assert rows(out.select("doc_id", "text")) == want
    assert KEY not in "".join(t or "" for _, t in want)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())
    assert secrets.redact_secrets(empty).count() == 0


def test_private_keys_go_whole(spark):
    rng = random.Random(7)
    body = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    ends = [f"-----{x} RSA PRIVATE KEY-----" for x in ("BEGIN", "END")]
    a, b, c, d = ([body(64) for _ in range(n)] + [body(9) + "0="] for n in (25, 25, 50, 1))
    fields = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-256-CBC,0123456789ABCDEF", ""]
    whole = ["\n".join([ends[0], *a, ends[1]]), "\\n".join([ends[0], *b, ends[1]]), "\n".join([ends[0], *fields, *c, ends[1]]), "\\r\\n".join([ends[0], *fields, *d]), "\n".join([ends[0], *(body(64) for _ in range(1000))])]
    docs = [(1, f"Two keys: {whole[0]} and \"{whole[1]}\" stand here."), (2, f"Encrypted:\n{whole[2]}\nThe end."), (3, f"Cut off: {whole[3]}. Plain words follow."), (4, whole[4]), (5, f"Only {ends[0]} is named."), (6, f"{ends[0]} and {whole[0]}.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = sorted((r["doc_id"], r["secret_sha256"], r["n_matches"]) for r in secrets.scan_secrets(df).collect() if r["rule"] == "private_key")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found == sorted((i, sha(s), 1) for i, s in ((1, whole[0]), (1, whole[1]), (2, whole[2]), (3, whole[3]), (4, whole[4]), (5, ends[0]), (6, ends[0]), (6, whole[0])))
    mark = "[private_key]"
    want = [f'Two keys: {mark} and "{mark}" stand here.', f"Encrypted:\n{mark}\nThe end.", f"Cut off: {mark}. Plain words follow.", mark, f"Only {mark} is named.", f"{mark} and {mark}."]
    assert [r["text"] for r in secrets.redact_secrets(df).orderBy("doc_id").collect()] == want


# --- repeated spans, both ways ---


@pytest.mark.parametrize("find", [windows.repeated_spans, suffixes.repeated_suffixes])
@pytest.mark.parametrize("chunk", [12 << 20, 500])
def test_spans_against_brute_force(spark, find, chunk):
    rng = random.Random(chunk)
    text = lambda n: " ".join(rng.choice("abcdefghij") for _ in range(n))
    shared = [text(30) for _ in range(4)]
    docs = [(i, "\n".join([text(rng.randrange(40)), rng.choice(shared), text(rng.randrange(9)), rng.choice(shared)[: rng.randrange(60)]])) for i in range(30)]
    docs += [(50, None), (51, ""), (52, "a b"), (53, docs[0][1]), (53, docs[0][1]), (None, shared[0]), (54, "é " * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("chunk", F.lit(7)).withColumn("kind", F.lit("own"))
    out = find(df, 10, chunk, 50).collect()
    assert sorted(((r["doc_id"], r["start_token"], r["end_token"]) for r in out), key=repr) == brute.repeated_spans(docs, 10)
    by_id = {i: t for i, t in docs}
    for r in out:
        words = brute.SPACES.findall(by_id[r["doc_id"]])[r["start_token"] : r["end_token"]]
        assert by_id[r["doc_id"]][r["start_char"] : r["end_char"]].split() == words
    assert find(df.filter("false"), 10).count() == 0


# --- SimHash ---


@pytest.mark.parametrize("budget, blocks", [(16, 6), (3, 4), (2, 4)])
def test_tries_against_all_pairs(budget, blocks):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 1 << 64, (300, 2), np.uint64)
    flip = np.zeros((300, 2), np.uint64)
    for _ in range(budget):
        flip[np.arange(300), rng.integers(0, 2, 300)] ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    x = simhash.ordered(np.concatenate([base, base ^ flip]))
    near = np.bitwise_count(x[:, None] ^ x[None, :]).sum(axis=2) <= budget
    want = {tuple(sorted((simhash.names(x)[i], simhash.names(x)[j]))) for i, j in zip(*np.nonzero(near)) if i < j}
    got, width = set(), simhash.BITS // blocks
    for turn, part in enumerate(simhash.block_budgets(budget, blocks)):
        if part < 0:
            continue
        y = simhash.ordered(simhash.rotate(x, turn * width))
        assert (simhash.ordered(simhash.rotate(y, simhash.BITS - turn * width)) == x).all()
        name = simhash.names(simhash.rotate(y, simhash.BITS - turn * width))
        for i, j in simhash.trie_join(y, y, 0, budget, width, part, leaf=4):
            got |= {tuple(sorted(p)) for p in zip(name[i], name[j])}
    assert got == want and len(want) >= 290


def test_near_groups_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs = []
    for g in range(60):
        words = [rng.choice(vocabulary) for _ in range(150)]
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = list(words)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(150)] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = simhash.near_groups(df).collect()
    want = brute.near_groups(docs)
    assert {r["doc_id"]: r["group_id"] for r in out} == want and len(want) > 40
    assert all(r["kept"] == (r["doc_id"] == r["group_id"]) for r in out)


def test_near_copies_edge_cases(messy, empty):
    out = simhash.drop_near_copies(messy)
    assert out.columns == messy.columns
    got = rows(out.select("doc_id", "text"))
    assert got.count((1, MESSY[0][1])) == 1 and {(3, None), (4, ""), (5, " \n\t"), (None, None), (9, "x")} <= set(got)
    assert simhash.drop_near_copies(empty).count() == 0 and simhash.near_groups(empty).count() == 0


# --- I-Match ---


@pytest.mark.parametrize("chunk", [12 << 20, 300])
def test_fingerprints_against_brute_force(spark, chunk):
    rng = random.Random(6)
    docs = [(i, " ".join(f"T{int(rng.paretovariate(0.7)) % 300}" for _ in range(40))) for i in range(60)]
    docs += [(100, docs[0][1].lower() + " !"), (101, None), (102, ""), (None, docs[1][1]), (103, "—")]
    band = (0.25, 0.8)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("bucket", F.lit(1))
    out = imatch.document_fingerprints(df, band, 4, 0.7, chunk, 20).collect()
    want = brute.band_terms(docs, band)
    assert sorted((repr(i), len(s)) for (i, _), s in zip(docs, want)) == sorted((repr(r["doc_id"]), r["n_terms"]) for r in out)
    by_id = {r["doc_id"]: r["fingerprints"] for r in out}
    sets = {i: s for (i, _), s in zip(docs, want)}
    for a in sets:
        for b in sets:
            if sets[a] == sets[b]:
                assert by_id[a] == by_id[b]
            else:  # equal fingerprints only where a lexicon can't tell the sets apart
                assert by_id[a] != by_id[b]
    assert by_id[101] == [None] * 4
    assert imatch.document_fingerprints(df.filter("false")).count() == 0


def test_fingerprints_depend_on_the_lexicon_alone():
    rng = np.random.default_rng(8)
    lists = [np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 5, 60)]
    all_ = imatch.fingerprints(lists, 5, 0.6)
    for k, x in enumerate(lists):
        assert (imatch.fingerprints([x], 5, 0.6)[0] == all_[k]).all()


def test_fingerprints_find_near_copies(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in [20, 60, 150, 400] * 50]
    near = [list(w) for w in base]
    for w in near:
        for i in rng.sample(range(len(w)), max(1, len(w) // 20)):
            w[i] = rng.choice(vocabulary)
    df = spark.createDataFrame(list(enumerate(" ".join(w) for w in base + near)), "doc_id long, text string")
    prints = {r["doc_id"]: set(enumerate(r["fingerprints"])) for r in imatch.document_fingerprints(df).collect()}
    for k in range(4):  # by length
        assert sum(bool(prints[i] & prints[i + 200]) for i in range(k, 200, 4)) >= 45
    assert not any(prints[i] & prints[j] for i in range(200) for j in range(400) if j % 200 != i)


# --- quality ---


def test_quality_against_brute_force(messy, empty, spark, data):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark, data).collect()]
    got = rows(quality.apply_rules(documents(spark, data)).select("doc_id", "text"))
    assert got == sorted(brute.quality(docs), key=repr)
    out = quality.apply_rules(messy)
    assert out.columns == messy.columns
    assert rows(out.select("doc_id", "text")) == sorted(brute.quality([(i, t) for i, t, _ in MESSY]), key=repr)
    assert quality.apply_rules(empty).count() == 0


@pytest.mark.parametrize("text, stays", [("Home | About | News | Contact | Help.", False), ("All rights reserved.", False), ("A plain sentence stands here.", True), ("$$$ !!! ### buy now!", False), ("no end to this line", False), ("la la la la la la la la la la.", False)])
def test_quality_rules(spark, text, stays):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality.apply_rules(df).count() == int(stays)


@pytest.mark.parametrize("text", ["A plain sentence.\r\nAnother one!\r\n\r\nThe last.\r\n", "\tA sentence with tabs.\t\t", "这是一个句子。\n你好吗？\n「はい、そうです。」", "第一句。第二句没有句号", "هل هذا سؤال؟\nیہ ایک جملہ ہے۔", "यह एक वाक्य है।\nयह दूसरा है।"])
def test_quality_keeps_other_line_ends_and_scripts(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r["text"] for r in quality.apply_rules(df).collect()] == [text]


@pytest.mark.parametrize("phrase, alone", [("privacy policy", False), ("Home | News | Help | About", False), ("copyright (c)2020", False), ("design in", True), ("catalog in", True), ("spread more", True)])
def test_quality_phrases_in_long_lines(spark, phrase, alone):
    plain = [" ".join(f"Word{i} and{i} more{i}." for i in range(k, k + 200)) for k in (0, 200)]
    docs = [(1, f"{plain[0]} Here it says {phrase} once. {plain[1]}"), (2, f"It says {phrase}."), (3, f"It says {phrase}. " * 12)]
    got = {r["doc_id"] for r in quality.apply_rules(spark.createDataFrame(docs, "doc_id long, text string"), quality.Rules(repeat_words=1000)).collect()}
    assert got == ({1, 2, 3} if alone else {1})


# --- SentencePiece ---


def _texts():
    rng = random.Random(11)
    alphabet = "aeiou nst rlé ñ日本語\n\t 𝒳ß"
    return [t for _, t, _ in MESSY if t] + ["".join(rng.choice(alphabet) for _ in range(n)) for n in (1, 2, 30, 400, 3000)] + ["  two  spaces ", "a" * 2000, "the " * 50, "\x00\x01"]


def test_pieces_equal_the_library():
    import sentencepiece as sp

    path = pieces.default_model()
    m, enc = sp.SentencePieceProcessor(model_file=path), pieces.Encoder(pieces.load(path))
    for t in _texts():
        flat, n = enc.encode([t])
        assert flat.tolist() == m.encode(t) and n.tolist() == [len(flat)]
        assert pieces.load(path).decode(flat, n) == [t.replace("▁", " ")]


@pytest.mark.parametrize("size", [100, 5000])
def test_pieces_of_long_words(size):
    import sentencepiece as sp

    path = pieces.default_model()
    m, enc = sp.SentencePieceProcessor(model_file=path), pieces.Encoder(pieces.load(path))
    rng = random.Random(size)
    words = ["".join(rng.choices(letters, k=size)) for letters in ("ab", "ing", "ngx", "etaoinshr", "日本語a", "0123456789abcdef", "a")]
    words += [x * (size // len(x)) for x in ("ng", "xng", "ations", "ering")]
    for w in words:
        assert enc.encode([w])[0].tolist() == m.encode(w)


def test_pieces_are_decoded(spark, messy, empty):
    encoded = pieces.encode_documents(messy)
    out = pieces.decode_documents(encoded)
    assert rows(out) == sorted(((i, t.replace("▁", " ") if t else t) for i, t, _ in MESSY), key=repr)
    assert pieces.decode_documents(pieces.encode_documents(empty)).count() == 0
    broken = spark.createDataFrame([(1, [259]), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert [r["text"] for r in pieces.decode_documents(broken).orderBy("doc_id").collect()][1:] == ["", None]


def test_pieces_edge_cases(messy, empty):
    out = pieces.encode_documents(messy).collect()
    assert len(out) == len(MESSY)
    null = [r for r in out if r["ids"] is None]
    assert len(null) == 2 and all(r["n_pieces"] is None and r["round_trip"] is None for r in null)
    assert all(r["round_trip"] == (r["doc_id"] != 8) for r in out if r["ids"] is not None)  # 8 holds the word mark
    assert [r["ids"] for r in out if r["doc_id"] == 4] == [[]]
    assert pieces.encode_documents(empty).count() == 0
