import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tapeloom.llm import exact_dedup, mixing, packing, simhash, tokens
from tests.llm import brute

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def key(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, None), (4, ""), (None, "a b c d"), (None, None), (5, LONG), (6, LONG + " tail"), (7, "A b\tC  d"), (8, " \n"), (9, "x")]
    return rows, spark.createDataFrame([(i, t, "en", None if i == 3 else "s", 1, 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, keep_id long")


def test_exact_matches_brute_force(spark, odd):
    rows, df = odd
    got = [tuple(r) for r in exact_dedup.exact_groups(df).collect()]
    assert key(got) == key(brute.exact(rows))
    got = [tuple(r) for r in exact_dedup.exact_groups(df, keep="min").collect()]
    assert key(got) == key(brute.exact(rows, min))
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_exact_with_colliding_digests(spark, odd):
    rows, df = odd
    weak = lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 1).cast("string"))
    got = [tuple(r) for r in exact_dedup.exact_groups(df, digest=weak).collect()]
    assert key(got) == key(brute.exact(rows))


def test_index_merges_runs_and_finds_digests(spark, tmp_path):
    index = exact_dedup.MergeIndex(spark, f"file://{tmp_path}/index")
    batch = lambda ids: spark.createDataFrame([(bytes([k % 7]) * 32, k) for k in ids], "digest binary, id long")
    index.flush(batch(range(20, 40)))
    index.flush(batch(range(20)))
    assert {(r.digest[0], r.keep_id, r.copies) for r in index.compact().collect()} == {(k, k, 5 + (k < 5)) for k in range(7)}
    assert [(r.keep_id, r.copies) for r in index.lookup([b"\x03" * 32, b"\x63" * 32]).collect()] == [(3, 6)]


def test_drop_exact_copies(spark, odd):
    rows, df = odd
    left = exact_dedup.drop_exact_copies(df)
    assert left.columns == df.columns
    texts = [r.text or "" for r in left.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in rows})
    assert exact_dedup.drop_exact_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("cap", [64, 1])
def test_simhash_matches_brute_force(spark, odd, cap):
    rows, df = odd
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    both = rows + [(r.doc_id + 100, r.text) for r in docs.collect()]
    df = df.select("doc_id", "text").union(docs.select(F.col("doc_id") + 100, "text"))
    got = [(r.doc_id, f"{r.fp & 0xFFFFFFFFFFFFFFFF:016x}", r.component_id) for r in simhash.near_groups(df, cap).collect()]
    assert key(got) == key(brute.near_components(both))


@pytest.mark.parametrize("cap", [64, 2])
def test_links_reach_all_that_are_within_two_bits(spark, cap):
    rng = random.Random(5)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 8)):
            prints.add(x)
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
    signed = {x - (1 << 64) if x >> 63 else x: x for x in prints}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    from tapeloom.llm.common import components

    roots = {r.node: r.root for r in components(simhash.links(df, cap)).collect()}
    got = defaultdict(set)
    for s, x in signed.items():
        got[roots.get(s, s)].add(x)
    want = defaultdict(set)
    parent = {x: x for x in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    for x in prints:
        want[find(x)].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_drop_near_copies_keeps_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    groups = simhash.near_groups(docs).select("component_id").distinct().count()
    left = simhash.drop_near_copies(docs)
    assert left.count() == groups and left.columns == docs.columns
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cap", [64, 2])
def test_near_stage_drops_all_copies_of_similarity_080(spark, odd, cap):
    import corpus_pipeline

    rng = random.Random(11)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    for _ in range(12):
        words = [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        for _ in range(rng.randrange(2, 6)):
            edited = list(words)
            for _ in range(max(1, len(words) // rng.choice([60, 80, 120]))):
                edited[rng.randrange(len(words))] = "edit"
            texts.append(" ".join(edited))
    rows = list(enumerate(texts)) + [(i, t) for i, t in odd[0] if t != LONG]
    sets = []
    for _, t in rows:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) * 5 >= len(a | b) * 4:
                group[max(find(i), find(j))] = min(find(i), find(j))
    want = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        want[find(i)].append(doc)
    firsts = [min((d for d in g if d is not None), default=None) for g in want.values()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.near(spark, df, SF) if cap == 64 else corpus_pipeline.jaccard.drop_near_copies(df, cap)
    assert left.columns == df.columns
    assert key([r.doc_id for r in left.collect()]) == key(firsts)
    assert corpus_pipeline.near(spark, df.limit(0), SF).count() == 0


def test_mixing_reaches_targets(spark, odd):
    for df in (odd[1].select("doc_id", "text", F.array("source").alias("members")), spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.array("source").alias("members"))):
        rows = df.collect()
        got = mixing.mix(df).collect()
        assert sorted((r.doc_id, r.size) for r in got if r.doc_id) == sorted((r.doc_id, len(brute.words(r.text))) for r in rows if r.doc_id)
        assert len(got) == len(rows)
        sizes, took = defaultdict(int), defaultdict(int)
        for r in got:
            sizes[r.members[0]] += r.size
            took[r.members[0]] += r.taken
            assert 0 <= r.taken <= 3 * r.size
        want = brute.targets(sizes)
        for r in got:
            assert r.source_size == sizes[r.members[0]]
            assert r.target == pytest.approx(want[r.members[0]])
        for s, t in want.items():
            assert abs(took[s] - t) <= 1
        again = mixing.mix(df.repartition(3)).collect()
        assert key(again) == key(got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_flow_routes_overlaps_around_full_patterns():
    # a only in x; b in both: y's quota must come from b, x's from a and its repeats
    sent = mixing.min_cost_flow([10, 10], [[0], [0, 1]], {0: 15, 1: 8}, 3)
    assert sent == [{0: 13}, {0: 2, 1: 8}] or (sum(sent[0].values()) + sent[1][0] == 15 and sent[1][1] == 8)
    total = sum(sum(x.values()) for x in sent)
    assert total == 23
    # first repetitions are used up before a second one opens
    assert min(sum(sent[0].values()), sum(sent[1].values())) >= 10


def test_mixing_with_overlapping_members(spark):
    rows = [(i, "w " * (i % 7 + 1), ["a"] if i % 3 else ["a", "b"]) for i in range(200)] + [(500, "v " * 40, ["c"]), (501, None, None), (502, "z", [])]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, members array<string>")).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert sum(r.taken for r in got) == pytest.approx(sum(r.size for r in got), abs=3)


def test_draw_follows_the_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mix(docs.select("doc_id", "text", F.array("source").alias("members")))
    out = mixing.draw(docs, mixed)
    assert out.columns == docs.columns
    took = defaultdict(int)
    for r in out.collect():
        took[r.doc_id] += len(brute.words(r.text))
    assert took == {r.doc_id: r.taken for r in mixed.collect() if r.taken}


@pytest.mark.parametrize("module", ["simhash", "jaccard"])
def test_near_copies_are_dropped_by_row(spark, odd, module):
    import importlib

    drop = importlib.import_module(f"tapeloom.llm.{module}").drop_near_copies
    other = " ".join(f"q{i}" for i in range(80))
    rows = [(i, t) for i, t in odd[0] if t != LONG and t != LONG + " tail"] + [(2, other), (2, other), (None, other + "x " + LONG)]
    left = drop(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # 'a b c d' in any case, no words, 'x', the other text, the long one of a null id
    assert key([(r.doc_id, (r.text or "").lower().split()[:1]) for r in left]) == key([(1, ["a"]), (3, []), (9, ["x"]), (2, ["q0"]), (None, ["q0"])])


def test_draw_gives_each_row_its_own_take(spark, odd):
    rows, df = odd
    more = spark.createDataFrame([(2, "a b c e", "en", "u", 1, 7), (2, "a b c d", "en", "u", 1, 7), (2, "a b c d", "en", "u", 1, 7)], df.schema)
    docs = df.unionByName(more)
    mixed = mixing.mix(docs.withColumn("members", F.array("source")))
    out = mixing.draw(docs, mixed)
    assert out.columns == docs.columns
    took, want = defaultdict(int), defaultdict(int)
    for r in out.collect():
        took[r.doc_id, r.source] += len(brute.words(r.text))
    for r in mixed.collect():
        if r.taken:
            want[r.doc_id, r.members[0]] += r.taken
    assert took == want


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    model = Tokenizer.from_file(path)
    extra = "End NOW... x,; 12.5% NOW! Don't <|endoftext|> stop now\x1cor\x0bnever İstanbul Σας é ＡＢＣ 中文字 🙂🙂 it's"
    rows = odd[0] + [(50, extra)]  # with null ids, a repeated row, empty texts and two very long ones
    rows += [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id long, text string, start long, marks int")
    pieces = packing.pack_documents(df, path).collect()
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append([*model.encode(t or "", add_special_tokens=False).ids, 1])
    of, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        seqs[p.sequence_id].append(p)
        of[p.doc_id].append(p)
    assert set(of) == set(ids)
    crc = lambda x: zlib.crc32(b"".join(k.to_bytes(4, "little") for k in x))
    for i, texts in ids.items():
        # a piece may belong to any text of a repeated id; together they tile all of them
        assert sum(p.length for p in of[i]) == sum(map(len, texts))
        for p in of[i]:
            assert any(len(x) == p.doc_tokens and crc(x[p.start : p.start + p.length]) == p.ids_crc32 for x in texts)
        if len(texts) == 1:
            at = 0
            for p in sorted(of[i], key=lambda p: p.start):
                assert p.start == at
                at += p.length
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    used = sum(p.length for p in pieces)
    assert len(seqs) <= -(-used // 2048) + 2
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_merger_gives_the_ids_of_the_tokenizer():
    encode = tokens.TextEncoder(packing.default_tokenizer())
    rng = random.Random(9)
    usual = [chr(k) for k in range(1, 1 << 16) if encode.kinds[k] != tokens.UNUSUAL]
    common = "abcdefghijklmnopqrstuvwxyzABCäöüßéèñçабвгдежз" + "'" * 5 + ".,;!?-_()[]{}@#$%^&*~`|0123456789²½€™«»stmdlrve \n\t"
    words = rng.choices(list(encode.model.get_vocab()), k=3_000)
    texts = [" ".join(words[k : k + 30]) for k in range(0, len(words), 30)]
    texts += ["".join(rng.choice(common) for _ in range(rng.randrange(1, 200))) for _ in range(1_500)]
    texts += ["".join(rng.choice(usual) for _ in range(20)) for _ in range(1_500)]
    texts += ["it's IT'S we'Re 'tis '" + "'s a'' 'll' 'd've x'm'", "a'", "'", "", " \n", "a\0b", "x <|endoftext|> <|EndOfText|>", "y" * 1_000, "🙂 hi", "İ Σας é", "\x1c\x85\xa0　x"]
    rng.shuffle(texts)
    want = encode.model.encode_batch_fast(texts, add_special_tokens=False)
    assert [x.tolist() for x in encode(texts)] == [x.ids for x in want]
    assert sum(map(encode._usual, texts)) > 3_000
    encode.merger = None  # as for a tokenizer of another form
    assert [x.tolist() for x in encode(texts[:50])] == [x.ids for x in want[:50]]


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_layout_places_every_id_once(seed):
    rng = random.Random(seed)
    histogram = {n: rng.randrange(400) for n in [*range(1, 32), *range(32, 2049, 32)]}
    if seed == 4:
        histogram = {1280: 5000, 20: 5000}
    if seed == 5:
        histogram = {1984: 1000, 2048: 3, 31: 10}
    slots = packing.layout(histogram)
    ids, seqs = defaultdict(list), defaultdict(list)
    for n, lo, hi, start, part, first, per, seq, off in slots:
        for r in range(lo, hi):
            ids[n, r].append((start, part))
            k = first + r - lo
            seqs[seq + k // per].append((off + k % per * part, part))
    assert set(ids) == {(n, r) for n, c in histogram.items() for r in range(c)}
    for (n, _), parts in ids.items():
        assert tiles(parts) == n
    for parts in seqs.values():
        assert tiles(parts) <= 2048
    used = sum(n * c for n, c in histogram.items())
    assert len(seqs) <= used / 2048 * 1.005 + 2


def tiles(parts):
    at = 0
    for start, n in sorted(parts):
        assert start == at
        at += n
    return at


@pytest.mark.parametrize("cap", [64, 2])
def test_near_stage_links_what_the_index_of_fingerprints_finds(spark, cap):
    from pyspark.sql import functions as F

    from tapeloom.llm import jaccard

    rng = random.Random(5)
    texts = ["", "few words"]
    for _ in range(15):
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        texts += [" ".join(words[: 300 - k]) for k in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = jaccard.signatures(docs)
    prints = {r.node: r.fp & 0xFFFFFFFFFFFFFFFF for r in found.where("doc_id > 0").collect()}
    sets = {r.node: set(jaccard.shingles(texts[r.doc_id]).tolist()) for r in found.collect()}
    near = {(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2}
    assert len(near) > 10

    def groups(pairs):
        root = {n: n for n in sets}
        for a, b in pairs:
            old, new = root[a], root[b]
            root = {n: new if r == old else r for n, r in root.items()}
        return {frozenset(n for n in root if root[n] == r) for r in root.values()}

    assert groups((r.a, r.b) for r in jaccard.indexed(found, cap).collect()) == groups(near)
    # no two sets share a band here, so all links come from the index, and whole sets decide
    alone = found.withColumn("keys", F.when(F.size("keys") > 0, F.array("node")).otherwise(F.col("keys")))
    links = {(r.a, r.b) for r in jaccard.links(docs, alone, cap).collect()}
    similar = {(a, b) for a, b in near if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4}
    assert groups(links) == groups(similar) and all(tuple(sorted(x)) in similar for x in links)
