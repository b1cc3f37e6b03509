import importlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import chat_format, labels, quality_classifier, quality_rules, secrets, toxicity, url_filter
from tests.llm import brute

SF = "/root/testdata/sf0.001"
LONG = "\n".join(f"line {i % 701} of a very long text, with word{i % 977} in it." for i in range(6_000))
DOC = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, label int"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, None), (4, ""), (None, "a b c d"), (5, LONG), (6, " \n\t"), (7, "x y z x y z x y"), (8, "é ü ß ∑"), (9, "w " * 60), (10, " ".join(f"v{i}" for i in range(80)))]
    return texts, spark.createDataFrame([(i, t, "en", None if i == 3 else "s", 1, None, 4) for i, t in texts], DOC)


def sample(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# ---- 4: quality rules ----


def test_rule_counts_match_brute_force(spark, odd):
    rng = random.Random(1)
    made = [(1000 + k, " ".join(rng.choice("ab cd e # | \n".split(" ")) for _ in range(rng.randrange(200)))) for k in range(60)]
    rows = odd[0] + sample(spark) + made
    got = quality_rules.rule_signals(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sorted(((i, *brute.rule_base(t).values()) for i, t in rows), key=repr)
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=repr)
    assert have == want
    assert all(not r.kept for r in got if r.base_failed)


def test_rule_verdicts_follow_the_labels(spark):
    docs, lab = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    got = quality_rules.rule_signals(docs).where("NOT base_failed").join(lab, "doc_id").groupBy("quality", "kept").count().collect()
    assert {(r.quality, r.kept) for r in got} <= {(0, False), (1, True)}


def test_lines_are_judged_one_by_one(spark):
    text = "A plain line of words.\nHome | About | Contact | Help\nBUY!! NOW!! OR!! NEVER!!\nAll rights reserved.\n\nThe end of it."
    df = spark.createDataFrame([(text,)], "text string").select(quality_rules.clean_lines(F.col("text")).alias("t"))
    assert df.first().t == "A plain line of words.\n\nThe end of it."


def test_quality_stage_passes_on_cleaned_texts(spark):
    import corpus_pipeline

    body = "\n".join(f"one{i} two{i} three{i} four{i}" for i in range(20))
    rows = [(1, f"{body}\nPlease accept our cookie policy\n\nThe end of it", 7), (2, body, 7), (3, "too short", 7), (4, None, 7)]
    out = corpus_pipeline.quality(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), "")
    want = f"{body}\n\nThe end of it"
    assert sorted(tuple(r) for r in out.collect()) == [(1, want, len(want)), (2, body, 7)]



def test_filter_on_the_verdict_keeps_columns(spark, odd):
    out = quality_rules.rule_signals(odd[1]).where("kept").select(odd[1].columns)
    assert out.columns == odd[1].columns
    assert {r.doc_id for r in out.collect()} == {10}
    assert quality_rules.rule_signals(odd[1].limit(0)).count() == 0


# ---- 1: secrets ----


def secret_rows():
    key = "AKIA" + "Q7Z4" * 4
    own = "ghp_" + "Zx9Qw3Er7Ty1Ui5Op2As8Df4Gh6Jk0"
    return [
        (1, "r1", "o1", f'PassWord = "hunter42x", {key} and 0123456789abcdef01234567ff\nSECRET:short TOKEN=abc'),
        (2, "r2", "o2", f"api_key: {own} é apikey='live-9fQ2Lm7Xc'"),
        (3, "r3", "o3", key),
        (4, "r4", "o4", key),
        (5, None, None, None),
        (6, "r6", "o6", "secret: token: abcdefghij"),
        (6, "r6", "o6", ""),
        (7, "r7", "o7", f"{own} again"),
        (8, "r8", "o8", "Bearer Qm8vT2xLw9Zr4Kp7Yd1s"),
    ]


def test_secret_base_matches_brute_force(spark):
    rows = secret_rows() + [(100 + i, "r", "o", t) for i, t in sample(spark)] + [(999, "r", "o", "password=" + "x" * 100_000)]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, repo string, owner string, text string")).collect()
    have = sorted((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.base]) for r in got)
    assert have == sorted((i, brute.secret_base(t)) for i, _, _, t in rows)


def test_owners_tell_examples_from_live_secrets(spark):
    got = secrets.find_secrets(spark.createDataFrame(secret_rows(), "doc_id long, repo string, owner string, text string")).collect()
    spans = {(r.doc_id, s.kind): s.asDict() for r in got for s in r.spans}
    assert spans[3, "access"]["verdict"] == "example" and spans[3, "access"]["owners"] == 3
    assert spans[8, "bearer"]["verdict"] == "live"
    assert [s.verdict for r in got if r.doc_id == 2 for s in r.spans] == ["shared", "live"]
    assert (7, "prefixed") not in spans
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, repo string, owner string, text string")).count() == 0


# ---- 2: chat ----


def test_chat_round_trip_and_machine(spark):
    t = chat_format.ChatTemplate()
    hostile = "\\ \\\\ <|turn|> \\<|end|> [INST][/INST] <<SYS>> <</SYS>> </s></s> <|say <|says|>\\"
    chats = {1: [("system", "s"), ("user", hostile), ("assistant", hostile)], 2: [("user", "a"), ("user", "b")], 3: [("assistant", None)], 4: [("tool", "<"), (None, ">")], 5: [("system", "x")]}
    rows = [(c, k, r, x) for c, turns in chats.items() for k, (r, x) in enumerate(turns)] + [(None, 0, "user", "q"), (6, 0, "user", "b"), (6, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat_format.format_chats(df, t).withColumn("back", chat_format.read_back(F.col("formatted"), t)).collect()}
    for c, turns in chats.items():
        assert [(b.role, b.text) for b in out[c].back] == [(r or "", x or "") for r, x in turns]
        assert out[c].formatted == "".join(s.text for s in out[c].segments)
        assert [s.loss for s in out[c].segments[1::3]] == [r == "assistant" for r, _ in turns]
    assert [out[c].valid for c in (1, 2, 3, 4, 5)] == [True, False, False, False, False]
    assert [out[c].first_bad_turn for c in (1, 2, 3)] == [None, 1, 0]
    assert [b.text for b in out[6].back] == ["a", "b"]
    assert chat_format.format_chats(df.limit(0)).count() == 0


# ---- 10: URLs ----


def test_url_verdicts(spark):
    urls = ["https://Example.ORG/es/1", "http://a.example.org/en/12?x", "http://example.org", "http://x.com/fr/a", "http://x.com/de/a", "ftp://h.net/p#f", None, "nothing", "http://", "http://notexample.org/es/", "http://h.net/p.html?utm_source=feed", "http://www.h.net/p/", "http://h.net/q"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "key", "block", "w0", "listed", "verdict", "id")})
    got = {r.page_id: r for r in url_filter.judge_urls(pages, url_filter.syndicated(pages)).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("example.org/es/", "block"), ("example.org/en/1", "block"), (None, "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/", "allow"), (None, "block"), (None, "block"), (None, "allow")
    ]
    assert (got[0].host, got[0].path, got[2].path, got[7].host) == ("example.org", "/es/1", "", "")
    assert url_filter.judge_urls(pages.limit(0), url_filter.syndicated(pages.limit(0))).count() == 0


@pytest.mark.parametrize("limit", [1 << 18, 0])
def test_bloom_filter_has_no_false_negatives(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "MAX_BROADCAST_BLOCKS", limit)
    keys = spark.range(4000).select(F.concat(F.lit("h.net/"), "id").alias("key"))
    found = url_filter.listed_hits(keys, keys.where("key LIKE '%7'")).collect()
    assert len(found) == 4000
    assert all(r.listed == r.key.endswith("7") and (r.possible_hit or not r.listed) for r in found)
    assert sum(r.possible_hit and not r.listed for r in found) < 200


# ---- 5 and 9: learned operators ----


def accuracy(spark, module, query, target, sf):
    got = getattr(module, query)(spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select(target, "predicted").collect()
    hit = defaultdict(list)
    for r in rows:
        hit[r[target]].append(r.predicted == r[target])
    return {k: sum(v) / len(v) for k, v in hit.items()}


def test_quality_on_held_out_rows(spark):
    by = accuracy(spark, quality_classifier, "op5_quality_classifier", "quality", f"{SF}/../sf0.01")
    assert by[1] > 0.95 and by[0] > 0.9


def test_toxicity_on_held_out_rows(spark):
    by = accuracy(spark, toxicity, "op9_toxicity", "toxic", f"{SF}/../sf0.1")
    assert by[0] > 0.99 and by[1] > 0.85


@pytest.mark.parametrize("module,score", [(quality_classifier, "score_quality"), (toxicity, "score_toxicity")])
def test_scores_of_odd_rows(spark, odd, module, score):
    texts, df = odd
    lab = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, None, 1), (None, 1, 1), (5, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    got = getattr(module, score)(df, lab).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in texts)
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 2}) == 1
    assert getattr(module, score)(df.limit(0), lab).count() == 0
    assert getattr(module, score)(df, lab.limit(0)).count() == len(texts)


def test_fold_is_the_crc_of_the_id(spark):
    import zlib

    got = spark.range(200).select("id", labels.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_grammar_weighs_clauses():
    s = toxicity.Scorer(toxicity.Lexicon({"idiot": 1.0}, {"moro": 1.0}))
    total = lambda t: s(t)[0]
    assert total("nice day") == 0 and total("morons!") == 1.0
    assert total("you are an idiot") > total("an idiot") > total("he is not an idiot") > 0
    assert total("she said: an idiot") == total("an idiot")  # a new clause
    assert total("critics said idiot") < total("idiot")
    assert total("i will kill you") > 0 and total("kill the process") == 0
    # who acts is no object, and an object stands near
    assert total("they kill the process") == total("people beat the record") == total("you kill me") == 0
    assert total("you. idiot") == total("idiot")


def plain_clauses(tokens, lexicon, weights):
    """(total, heaviest clause, sums by symbol) with every transducer run for itself, symbol by symbol."""
    total, most, clause, sums = 0.0, 0.0, 0.0, dict.fromkeys(toxicity.SYMBOLS, 0.0)
    machines = toxicity.cascade()
    states = [m.start for m in machines]
    for t in [*tokens, "."]:
        if t in toxicity.CLAUSE_ENDS:
            total, most, clause = total + clause, max(most, clause), 0.0
            states = [m.start for m in machines]
            continue
        c, w = lexicon.classify(t)
        symbol = toxicity.NAMES[c]
        for k, m in enumerate(machines):
            states[k], symbol = m.arcs.get((states[k], symbol), (states[k], symbol))
        clause += weights.get(symbol, 0.0) * w
        if symbol in sums:
            sums[symbol] += w
    return total, most, list(sums.values())


def test_composed_grammar_matches_its_transducers():
    rng = random.Random(2)
    lexicon = toxicity.Lexicon({"idiot": 1.0, "fool": 0.7, "fine": 0.0}, {"moro": 1.5})
    weights = {x: rng.random() for x in toxicity.SYMBOLS}
    score = toxicity.Scorer(lexicon, weights)
    words = ["idiot", "fool", "fine", "morons", "kill", "hurt", "you", "them", "not", "never", "said", "wrote", "the", "process", ".", "!", "\n"]
    for _ in range(400):
        tokens = rng.choices(words, k=rng.randrange(0, 40))
        total, most, sums = plain_clauses(tokens, lexicon, weights)
        got = score(" ".join(tokens))
        assert got == (pytest.approx(total), pytest.approx(most), len(tokens))
        assert score.parts(" ".join(tokens)) == (pytest.approx(sums), len(tokens))


def test_weights_of_symbols_are_learned():
    rng = np.random.default_rng(3)
    at = {x: k for k, x in enumerate(toxicity.SYMBOLS)}
    parts = np.zeros((600, len(at)))
    parts[:, at["insult-aimed"]] = rng.integers(0, 2, 600)
    parts[:, at["insult-reported"]] = rng.integers(0, 2, 600)
    y = (parts[:, at["insult-aimed"]] > 0).astype(float)
    got = toxicity.learned_weights(parts, np.full(600, 50.0), y)
    # here reports of insults are never toxic; symbols that no text has stay as they were
    assert got["insult-reported"] < toxicity.WEIGHTS["insult-reported"] and got["insult-aimed"] >= toxicity.WEIGHTS["insult-aimed"]
    assert got["insult"] == toxicity.WEIGHTS["insult"] and got["threat"] == 0.0


def test_scores_of_attention_match_plain_loops():
    import math

    g = np.random.default_rng(1)
    texts = ["Plain words, one after the other. " * 90, "", "x", "a b\n" * 700, "ÄÖÜ ß !! ### " * 40]
    bags = [quality_classifier.encode(t) for t in texts]
    m = quality_classifier.GatedAttention.start(np.concatenate(bags))
    for v in m.p.values():
        v[...] = g.normal(size=v.shape)
    dot = lambda a, b: sum(float(x) * float(y) for x, y in zip(a, b, strict=True))
    sig = lambda x: 1 / (1 + math.exp(-x))
    p = m.p
    for bag in bags:
        hidden, energy = [], []
        for x in (bag - m.mean) / m.scale:
            h = [math.tanh(dot(x, p["w"][:, j]) + p["b"][j]) for j in range(len(p["b"]))]
            gate = [math.tanh(dot(h, p["v"][:, j])) * sig(dot(h, p["u"][:, j])) for j in range(p["v"].shape[1])]
            hidden.append(h)
            energy.append(dot(gate, p["a"]))
        e = [math.exp(x - max(energy)) for x in energy]
        z = [sum(w * h[j] for w, h in zip(e, hidden, strict=True)) / sum(e) for j in range(len(hidden[0]))]
        assert m.forward(bag, np.array([0]))[0][0] == pytest.approx(sig(dot(z, p["c"]) + float(p["d"][0])))
    assert [len(b) for b in bags] == [-(-len(t.encode()) // 1024) or 1 for t in texts]


def test_training_sample_is_bounded(spark):
    rows = [(i % 50, "v" * (i % 7 + 1)) for i in range(400)] + [(60, None), (None, "n"), (70, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(65)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = labels.training_texts(docs, lab, "quality", 20).collect()
    assert len(got) <= 20 and len({r.doc_id for r in got}) == len(got)
    fewer = labels.training_texts(docs, lab, "quality", 20, most_bytes=5).collect()
    assert {r.doc_id for r in fewer} < {r.doc_id for r in got} and sum(len(r.text or "") for r in fewer) <= 5
    assert all(r.text == min((t for i, t in rows if i == r.doc_id and t), default=None) for r in got)


def test_attention_gradient():
    g = np.random.default_rng(0)
    x = g.normal(size=(9, quality_classifier.N_FEATURES))
    starts, y, w = np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0]), np.ones(3)
    m = quality_classifier.GatedAttention.start(x)

    def loss():
        p = m.forward(x, starts)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grad = m.gradient(x, starts, y, w)
    for k, v in m.p.items():
        at = tuple(g.integers(0, n) for n in v.shape)
        old, e = v[at], 1e-5
        v[at] = old + e
        up = loss()
        v[at] = old - e
        down = loss()
        v[at] = old
        assert (up - down) / (2 * e) == pytest.approx(grad[k][at], abs=1e-6)


# ---- pipeline ----


def test_pipeline_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    at, columns = docs, docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        before = at.count()
        at = stage(spark, at, SF)
        assert at.columns == columns, name
        assert at.count() <= before or name == "mixing"
        at = at.checkpoint()
    assert all(r.text in rows[r.doc_id] or rows[r.doc_id].strip().startswith(r.text.strip()[:50]) for r in at.collect())
    packed = pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == at.select("doc_id").distinct().count()
