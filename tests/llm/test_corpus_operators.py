"""Search, scoring, mixing, near-dup, sharding, packing and the pipeline against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowspark.llm import lmscore, mixing, neardup, packing, quality, sharding, vafile
from flowspark.llm.common import document_words, word_hashes
from flowspark.llm.queries import fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# Words

def test_word_hashes_tell_words_apart_and_cross_chunks():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcXYZé.", k=rng.randint(1, 9))) for _ in range(3000)] + ["x" * 3_000_000]
    text = " ".join(rng.choices(vocabulary[:-1], k=300_000)) + "\n" + vocabulary[-1] + "\t" + vocabulary[0]
    hashes, starts = word_hashes(text.encode())
    names = words(text)
    assert len(hashes) == len(names) == len(starts)
    by_name = {}
    assert all(by_name.setdefault(n, h) == h for n, h in zip(names, hashes.tolist(), strict=True)) and len(set(by_name.values())) == len(by_name)
    assert document_words([b"", b" a b ", b"\xc3\x89 A\n", b""])[1].tolist() == [0, 2, 2, 0]


# Search

def brute_search(rows, k, every):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in usable if i % every == 0}:
        query = next(v for i, v in usable if i == q)
        scored = sorted((-sum(a * b for a, b in zip(query, v, strict=False)), i) for i, v in usable if i != q)[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)}
    return out


def found(df, every, k=5):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in vafile.search(df, F.col("vec_id") % every == 0, k).collect()}


def test_search_with_copies_ties_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 6).tolist()) for i in range(300)]
    rows += [(300 + i, [0.1] * 6) for i in range(150)] + [(450 + i, [0.05 * (i % 2)] * 6) for i in range(50)]
    rows += [(501, None), (502, [None] * 6), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (505, []), (506, [0.3, 0.3]), (None, [0.5] * 6), (510, [3.0] * 6), (520, [-3.0] * 6)]
    df = spark.createDataFrame([(*r, 1.5, "v") for r in rows], "vec_id long, embedding array<float>, x double, v string").repartition(3)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert found(df, 10) == brute_search(exact, 5, 10)
    monkeypatch.setattr(vafile, "BLOCK_BYTES", 200)
    assert found(df, 50) == brute_search(exact, 5, 50)


def test_search_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert found(spark.createDataFrame([(0, [1.0]), (50, [2.0])], schema), 50) == {(0, 1, 50, 131072), (50, 1, 0, 131072)}
    assert found(spark.createDataFrame([(0, [1.0])], schema), 50) == set()
    assert found(spark.createDataFrame([], schema), 50) == set()
    assert found(spark.createDataFrame([(1, [1.0]), (2, None)], schema), 50) == set()


# Scoring

def brute_lm(rows, learned):
    tokens = [[*words(t), None] for _, t in rows]
    seen = collections.Counter(w for ok, t in zip(learned, tokens, strict=True) if ok for w in t)
    n, v = sum(seen.values()), len(seen)
    return [(len(t), sum(w in seen for w in t), n, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in t)) for t in tokens], seen


def test_scores(documents, spark):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    learned = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    expected, seen = brute_lm(rows, learned)
    got = {r.doc_id: r for r in lmscore.score(documents, fold(7) != 2).collect()}
    for (i, _), e in zip(rows, expected, strict=True):
        g = got[i]
        assert (g.n_tokens, g.n_known, g.train_tokens) == e[:3] and g.base_score == pytest.approx(e[3], rel=1e-9)
    held = [got[i] for (i, _), ok in zip(rows, learned, strict=True) if not ok]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def test_score_is_the_interpolated_model(documents, spark):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    weights = []
    original = lmscore.learn_weights
    try:
        lmscore.learn_weights = lambda *a: weights.append(original(*a)) or weights[-1]
        got = {r.doc_id: r.score for r in lmscore.score(documents, fold(7) != 2).collect()}
    finally:
        lmscore.learn_weights = original
    one, two = collections.Counter(), collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            w = [None, *words(t), None]
            one.update(w[1:])
            two.update(zip(w, w[1:], strict=False))
    n, v = sum(one.values()), len(one)
    assert np.allclose(weights[0].sum(axis=1), 1)
    for i, t in rows[:40]:
        w, total = [None, *words(t), None], 0.0
        for a, b in zip(w, w[1:], strict=False):
            l2, l1, l0 = weights[0][one[a].bit_length()]
            total += math.log10(l2 * (two[a, b] / one[a] if one[a] else 0) + l1 * one[b] / n + l0 / (v + 1))
        assert got[i] == pytest.approx(total, rel=1e-9)


def test_em_finds_the_mixture():
    rng = np.random.default_rng(0)
    p2, p1, p0 = rng.uniform(0.1, 0.5, 400), rng.uniform(0.001, 0.01, 400), 1e-4
    n = 1e6 * (0.6 * p2 + 0.3 * p1 + 0.1 * p0)
    cells = [((3 << 32) | ((i + 1) << 16) | (i + 1), x, x * math.log(a), x * math.log(b)) for i, (x, a, b) in enumerate(zip(n, p2, p1, strict=True))]
    w = lmscore.learn_weights(cells, p0)
    likelihood = lambda m: (n * np.log(m[0] * p2 + m[1] * p1 + m[2] * p0)).sum()
    assert likelihood(w[3]) >= likelihood([0.6, 0.3, 0.1]) and (w[10] == w[3]).all()


def test_score_edges(odd, odd_rows, empty):
    got = lmscore.score(odd, F.lit(True)).collect()
    expected, _ = brute_lm([(r[0], r[1]) for r in odd_rows], [True] * len(odd_rows))
    assert sorted((g.n_tokens, g.n_known, g.train_tokens) for g in got) == sorted(e[:3] for e in expected)
    assert sorted(g.base_score for g in got) == pytest.approx(sorted(e[3] for e in expected))
    assert all(math.isfinite(g.score) and g.score <= 0 for g in got)
    assert lmscore.score(empty, F.lit(True)).count() == 0
    assert {g.score for g in lmscore.score(odd, F.lit(False)).collect()} == {0.0}


# Mixing

def test_exponent_meets_targets():
    shares = [0.6, 0.3, 0.08, 0.02]
    flat = mixing.solve_exponent(shares, 0.95, None)
    assert mixing.entropy(mixing.tempered(shares, flat)) == pytest.approx(0.95 * math.log(4), abs=1e-6)
    limited = mixing.solve_exponent(shares, 0.95, 2.0)
    rates = [w / s for w, s in zip(mixing.tempered(shares, limited), shares, strict=True)]
    assert max(rates) / min(rates) == pytest.approx(2.0, rel=1e-6) and limited > flat
    assert mixing.solve_exponent([1.0], 0.9, 4) == 1.0 and mixing.solve_exponent([0.5, 0.5], 0.95, 4) == 1.0


def test_mixture_realises_weights(spark, empty):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), "big" if i % 3 else ("small" if i % 2 else None)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    table = mixing.weights(mixing.narrowed(df), 1.0, 3.0)
    out = mixing.schedule(df, 1.0, 3.0, block_tokens=20_000).collect()
    tokens = collections.Counter()
    for r in out:
        tokens[r.source] += r.n_tokens
    total = sum(tokens.values())
    for t in table:
        assert tokens[t["source"]] / total == pytest.approx(t["weight"], abs=0.002)
    assert {r.doc_id for r in out} == set(range(3000))
    times = collections.Counter(r.doc_id for r in out)
    by_source = {s: {times[i] for i, _, x in rows if x == s} for s in ("big", "small", None)}
    assert all(max(n) - min(n) <= 1 for n in by_source.values())
    blocks = collections.defaultdict(collections.Counter)
    for r in out:
        blocks[r.block][r.source] += r.n_tokens
    for b in blocks.values():
        assert sum(b.values()) == pytest.approx(20_000, rel=0.1) and b["big"] / sum(b.values()) == pytest.approx(tokens["big"] / total, abs=0.03)
    assert mixing.schedule(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixture_budget_and_edges(spark, odd):
    df = spark.createDataFrame([(i, "a b c d", "s") for i in range(500)], "doc_id long, text string, source string")
    assert mixing.mix(df, None, None, budget=1000).count() == pytest.approx(250, abs=1)
    assert mixing.mix(df, None, None, budget=5000).count() == pytest.approx(1250, abs=1)
    out = mixing.mix(odd)
    assert out.columns == odd.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in odd.collect()}


# Near duplicates

def brute_groups(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def near_rows():
    rng = random.Random(4)
    rows = []
    for size in (1, 2, 3, 40, 5):
        base = " ".join(f"word{rng.randrange(400)}" for _ in range(150))
        chain = base
        for _ in range(size):
            rows.append((len(rows), chain))
            chain = edited(rng, chain if rng.random() < 0.6 else base, rng.choice([0, 1, 2, 4, 8]))
    return rows + [(len(rows) + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 40)))) for i in range(40)]


@pytest.mark.parametrize(("n", "percent", "small"), [(3, 85, 16), (5, 80, 16), (3, 85, 1), (5, 80, 1)])
def test_groups_equal_brute_force(spark, monkeypatch, n, percent, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rows = near_rows()
    random.Random(1).shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.group(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n, percent).collect()}
    assert got == brute_groups(rows, n, percent)


def test_groups_of_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    out = neardup.group(documents, 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_groups(rows, 3, 85) and all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5, 5)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 50)}}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dup_edges(odd, empty):
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in neardup.group(odd, 3, 85).collect())
    assert got[(None, None, True)] == 2 and got[(2, 1, False)] == 2 and got[(4, 4, True)] == got[(5, 5, True)] == got[(6, 6, True)] == got[(10, 10, True)] == 1
    out = neardup.drop(odd)
    assert out.columns == odd.columns and sorted(r.doc_id for r in out.filter("doc_id in (1, 2, 3)").collect()) == [1]
    assert neardup.group(empty).count() == 0 and neardup.drop(empty).count() == 0


def test_posterior_bounds():
    assert neardup.least_matches(100, 85, 1e-6) < 70 and neardup.least_matches(20, 85, 1e-6) < 10
    assert (1 - 0.85 ** 5) ** neardup.band_count(85, 1e-6) <= 1e-6


# Sharding

def brute_ring(loads, owners, capacity):
    room, out = list(capacity), collections.Counter()
    left = []
    for cell in sorted(loads):
        got = min(loads[cell], room[owners[cell]])
        room[owners[cell]] -= got
        out[cell, owners[cell]] += got
        left += [cell] * (loads[cell] - got)
    for cell in left:
        at = cell
        while not room[owners[at % sharding.CELLS]]:
            at += 1
        room[owners[at % sharding.CELLS]] -= 1
        out[cell, owners[at % sharding.CELLS]] += 1
    return out


def test_ring_plan_walks_clockwise():
    rng = random.Random(9)
    owners = sharding.ring_owners(5, 16)
    assert set(owners) == set(range(5))
    loads = {rng.randrange(sharding.CELLS): rng.randint(1, 30) for _ in range(300)} | {7: 900}
    total = sum(loads.values())
    capacity = [total // 5 + (s < total % 5) for s in range(5)]
    placed = collections.Counter()
    slots = collections.defaultdict(list)
    for cell, first, end, shard, slot in sharding.plan_ring(loads, owners, capacity):
        placed[cell, shard] += end - first
        slots[shard] += range(slot, slot + end - first)
    assert +placed == +brute_ring(loads, owners, capacity)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_assignment(documents, odd, empty):
    for df in (documents, odd):
        out = sharding.assign(df, 8).collect()
        assert sorted((r.doc_id, r.size, r.text_crc32) for r in out if r.doc_id is not None) == sorted(
            (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect() if r.doc_id is not None)
        counts = collections.Counter(r.shard for r in out)
        assert len(out) == df.count() and max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1
        assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in counts.items())
    assert sharding.assign(empty, 8).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(odd, 0)


def test_growing_moves_little(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    before = {r.doc_id: r.shard for r in sharding.assign(df, 8, load_factor=1.25).collect()}
    after = {r.doc_id: r.shard for r in sharding.assign(df, 9, load_factor=1.25).collect()}
    assert sum(before[i] != s for i, s in after.items()) < 0.3 * len(after)


# Packing

def test_pieces_are_the_tokenizers(documents, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for df in (documents.limit(60), odd):
        rows = [r for r in df.collect() if r.doc_id is not None and r.doc_id != 2]
        pieces = collections.defaultdict(list)
        for r in packing.pack(df, max_tokens=512).collect():
            pieces[r.doc_id].append(r)
        for r in rows:
            ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
            at = 0
            for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
                at += p.length
            assert at == len(ids)


@pytest.mark.parametrize("text", ["I'M don't 'S it's", "Σίσυφος ΟΔΟΣ", "İstanbul ǅ", "a\x1cb\x85c d", "é ́x", "<|endoftext|> x", "日本語 text", "#!? 12½²", "\x00\x7f", "a­b ²³ ǅx Ȁ", "ﬁ 🙂 ok"])
def test_encoder_equals_tokenizer(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    assert np.frombuffer(packing.word_encoder(path)(text.encode()), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_vectors_fit_their_bins():
    rng = np.random.default_rng(8)
    demands = np.column_stack([rng.integers(1, 4097, 900), np.ones(900, int), rng.integers(0, 2000, 900)])
    limits = np.array([4096, 6, 2500])
    bins = packing.pack_vectors(demands, limits)
    for b in range(bins.max() + 1):
        assert (bins == b).any() and (demands[bins == b].sum(axis=0) <= limits).all()
    lower = max(math.ceil(demands[:, d].sum() / limits[d]) for d in range(3))
    assert bins.max() + 1 <= 1.35 * lower
    with pytest.raises(ValueError):
        packing.pack_vectors(np.array([[5000, 1, 1]]), limits)


def test_packed_sequences(documents, odd, empty, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    for df in (documents, odd):
        sequences = collections.defaultdict(list)
        for r in packing.pack(df, max_segments=8).collect():
            sequences[r.sequence_id].append(r)
        for s in sequences.values():
            at = 0
            for r in sorted(s, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 4096 and len(s) <= 8
    assert packing.pack(empty).count() == 0


# Pipeline

def test_pipeline_stages(spark, sf_dir, documents):
    docs = documents
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, sf_dir)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == documents.columns and out.dtypes == documents.dtypes
        after = out.collect()
        ids = collections.Counter(r.doc_id for r in after)
        if name == "quality_rules":
            kept = {r.doc_id: r.quality.cleaned for r in quality.judge(docs).collect() if r.quality.kept}
            assert {r.doc_id: r.text for r in after} == kept
        elif name == "line_dedup":
            assert set(ids) == {r.doc_id for r in before} and max(ids.values()) == 1
        elif name == "near_dedup":
            groups = brute_groups([(r.doc_id, r.text) for r in before], 5, 80)
            assert set(ids) == {i for i, (_, root) in groups.items() if root == i}
        elif name == "mix_sources":
            assert set(ids) == {r.doc_id for r in before}
        else:
            lengths = collections.Counter()
            for r in after:
                lengths[r.sequence_id] += r.length
            assert set(ids) == {r.doc_id for r in before} and max(lengths.values()) <= 4096
        docs = spark.createDataFrame(after, out.schema) if after else out
    assert corpus_pipeline.run(spark, sf_dir).count() == len(after)


def test_near_dup_drop_keeps_other_text_of_a_shared_id(spark):
    text, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (2, text), (2, other), (3, text)], "doc_id long, text string")
    assert sorted(map(tuple, neardup.drop(df).collect())) == [(1, text), (2, other)]


# Search: any size of components, repeated ids

def brute_items(rows, k, every):
    """Scores of ids are the highest over their vectors, and 64-bit numbers."""
    clamp = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    whole = lambda x: math.floor(x * 256) if abs(x) < 2.0**52 else 256 * int(x)
    by_id = collections.defaultdict(list)
    for i, v in rows:
        by_id[i].append([whole(x) for x in v])
    out = set()
    for q in by_id:
        if q % every == 0:
            scored = sorted((-max(clamp(sum(map(int.__mul__, a, b))) for a in by_id[q] for b in by_id[i]), i) for i in by_id if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)}
    return out


def test_search_large_components(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [100000.0]), (2, [70000.0]), (3, [65536.0])], "vec_id long, embedding array<double>")
    assert found(df, 50) == {(0, 1, 1, 6553600000), (0, 2, 2, 4587520000), (0, 3, 3, 4294967296)}
    rng = np.random.default_rng(5)
    for scale in (1e5, 1e9, 1e30, 1e200):
        rows = [(i, (rng.normal(0, 1, 5) * scale ** rng.random(5)).tolist()) for i in range(120)] + [(200 + i, [0.25] * 5) for i in range(9)]
        assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), 10) == brute_items(rows, 5, 10), scale


def test_search_far_outliers_among_ordinary_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(800)] + [(1000, [1e6] + [0.1] * 7), (1001, [-3e5] * 8), (1050, [0.0] * 7 + [2e4])]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), 50) == brute_items(rows, 5, 50)


def test_search_repeated_ids(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [1.0])] * 7 + [(1, [1.0]), (2, [1.0]), (3, [0.5])]
    assert found(spark.createDataFrame(rows, schema).repartition(3), 50) == {(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 3, 32768)}
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(0, 1, 4).tolist()) for i in range(60)]
    rows += [(i, (3 * rng.normal(0, 1, 4)).tolist()) for i in (0, 0, 10, 7, 7, 7) for _ in range(15)] + rows[:20] + [(20, rows[5][1]), (21, rows[5][1])]
    assert found(spark.createDataFrame(rows, schema).repartition(3), 10) == brute_items(rows, 5, 10)


# Mixing against a plain walk

def test_exponent_by_passes_is_the_least():
    for goal in (0.0, 0.1, 0.3333, 0.999999, 1.0):
        assert mixing._least(lambda tried, goal=goal: [a >= goal for a in tried]) == pytest.approx(goal, abs=2 ** (1 - mixing.BITS))
    assert mixing._least(lambda tried: [False] * len(tried)) == 1.0


@pytest.mark.parametrize("budget", [None, 9000])
def test_mixture_equals_a_walk(spark, budget):
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40])), rng.choice(["a"] * 9 + ["b"] * 3 + ["c", None])) for i in range(900)] + [(1000, "", "d"), (1001, None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    narrow = mixing.narrowed(df)
    table = {r["source"]: r for r in mixing.weights(narrow, 0.97, 4.0, budget)}
    tokens = collections.Counter()
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    live = {s: n / sum(tokens.values()) for s, n in tokens.items() if n}
    exponent = mixing.solve_exponent(list(live.values()), 0.97, 4.0)
    shaped = dict(zip(live, mixing.tempered(list(live.values()), exponent), strict=True))
    spent = budget or max(tokens[s] / w for s, w in shaped.items())
    for s, r in table.items():
        assert r["exponent"] == pytest.approx(exponent, abs=1e-8) and r["weight"] == pytest.approx(shaped.get(s, 0), abs=1e-7)
        assert r["rate"] == pytest.approx(spent * shaped[s] / tokens[s] if s in shaped else 1.0, rel=1e-6)

    # Every epoch is the order of its hashes; the last is cut with the document that reaches the budget.
    epochs = max(math.ceil(r["rate"]) for r in table.values())
    keys = {(r.doc_id, e): r[f"k{e}"] for r in narrow.select("doc_id", *[F.xxhash64(F.lit(0), F.lit(e), "doc_id", "print").alias(f"k{e}") for e in range(epochs)]).collect() for e in range(epochs)}
    size = {i: len((t or "").split()) for i, t, _ in rows}
    out = mixing.schedule(df, 0.97, 4.0, budget, block_tokens=2000).collect()
    blocks = max(1, math.ceil(sum(r["rate"] * r["tokens"] for r in table.values()) / 2000), math.ceil(len(out) / 2000))
    expected = {}
    for s, r in table.items():
        walked = 0
        quota = max(1.0, r["rate"] * r["tokens"])
        for e in range(math.ceil(r["rate"])):
            goal = (r["rate"] - e) * r["tokens"]
            read = 0
            for i in sorted((i for i, _, x in rows if x == s), key=lambda i, e=e: keys[i, e]):
                if e + 1 > r["rate"] and read >= goal:
                    break
                expected[i, e] = min(blocks - 1, math.floor(walked * blocks / quota)) if size[i] else None
                read += size[i]
                walked += size[i]
    assert sorted((r.doc_id, r.epoch) for r in out) == sorted(expected)
    assert all(expected[r.doc_id, r.epoch] in (None, r.block) for r in out)
    places = collections.defaultdict(list)
    for r in out:
        places[r.block].append(r.place)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    mixed = collections.Counter(r.doc_id for r in mixing.mix(df, 0.97, 4.0, budget).collect())
    assert mixed == collections.Counter(i for i, _ in expected)


# Packing by its method

def brute_pack(demands, limits):
    """One bin after the other: of the rows that fit, the largest dot product with the room left."""
    rows = sorted(range(len(demands)), key=lambda i: ([-d / x for d, x in zip(demands[i], limits, strict=True)], i))
    bins, number = {}, 0
    while rows:
        room = list(limits)
        while fitting := [i for i in rows if all(d <= r for d, r in zip(demands[i], room, strict=True))]:
            best = max(fitting, key=lambda i: (sum(d / x * (r / x) for d, x, r in zip(demands[i], limits, room, strict=True)), -rows.index(i)))
            bins[best] = number
            rows.remove(best)
            room = [r - d for r, d in zip(room, demands[best], strict=True)]
        number += 1
    return [bins[i] for i in range(len(demands))]


def test_bins_are_those_of_the_largest_dot_product():
    rng = random.Random(14)
    for limits in ([64, 4, 32], [128, 16, 128], [64, 64, 16]):  # powers of two, so that products are exact
        demands = [(n := rng.randint(1, limits[0]), 1, rng.randint(0, min(n, limits[2]))) for _ in range(150)]
        assert packing.pack_vectors(np.array(demands), np.array(limits)).tolist() == brute_pack(demands, limits)


def test_cut_points_keep_every_limit():
    rng = random.Random(15)
    for _ in range(300):
        n, most = rng.randint(1, 500), rng.randint(1, 100)
        prompt, loss = rng.randint(0, n), rng.randint(1, most)
        pieces = packing.cut_points(n, prompt, most, loss)
        assert [a for a, _, _ in pieces] == [sum(x for _, x, _ in pieces[:i]) for i in range(len(pieces))] and sum(x for _, x, _ in pieces) == n
        assert all(0 < x <= most and y <= loss and y == sum(j >= prompt for j in range(a, a + x)) for a, x, y in pieces)


def test_each_of_three_limits_binds(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    pieces = packing.tokenised(docs, packing.default_tokenizer(), 2, packing.MAX_TOKENS, packing.MAX_LOSS).cache()
    limits = {"length": packing.MAX_TOKENS, "segments": packing.MAX_SEGMENTS, "loss_tokens": packing.MAX_LOSS}

    def packed(**other):
        now = limits | other
        sums = collections.defaultdict(collections.Counter)
        for r in packing.pack_pieces(pieces, now["length"], now["segments"], now["loss_tokens"]).collect():
            sums[r.sequence_id].update(length=r.length, segments=1, loss_tokens=r.loss_tokens)
        return list(sums.values())

    bins = packed()
    assert all(b[k] <= n for b in bins for k, n in limits.items())
    for limit in limits:
        assert max(b[limit] for b in packed(**{limit: 10 ** 6})) > limits[limit]
    assert sum(b["length"] for b in bins) >= 0.97 * packing.MAX_TOKENS * len(bins)


def test_tokenizers_of_other_layouts_are_encoded_whole(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(packing.default_tokenizer()))
    assert packing.by_runs(spec)
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}):
        path = tmp_path / f"{len(packing._encoders)}.json"
        path.write_text(json.dumps(spec | change))
        assert packing.by_runs(spec | change) is None
        text = "Some words,  of ANY kind\u00a0x"
        assert np.frombuffer(packing.word_encoder(str(path))(text.encode()), "<u4").tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids


def test_equal_pieces_spread_over_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    rows = spark.createDataFrame([(None, "")] * 1000 + [(1, "a b\nc")] * 500, "doc_id long, text string")
    first = sorted(map(str, packing.pack(rows.repartition(3)).collect()))
    assert len(first) == 1500 and first == sorted(map(str, packing.pack(rows.repartition(7)).collect()))
    assert packing.pack(rows).groupBy(F.shiftright("sequence_id", 24)).count().agg(F.max("count")).first()[0] < 120


def test_large_buckets_of_texts_below_the_threshold(spark, monkeypatch):
    """Many texts share most of their words with all others, but few are links; blocks are bounded by bytes."""
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 30_000)
    rng = random.Random(17)
    shared = " ".join(f"s{i}" for i in range(120))
    rows = [(i, shared + " " + " ".join(f"o{rng.randrange(10 ** 6)}" for _ in range(rng.choice([20, 30, 60])))) for i in range(160)]
    rows += [(200 + i, edited(rng, rows[i % 40][1], rng.choice([1, 2, 3]))) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.group(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85).collect()}
    assert got == brute_groups(rows, 3, 85)


def test_weights_without_held_out_counts():
    w = lmscore.learn_weights([], 1e-3)
    assert w[0].tolist() == [0.0, 0.9, 0.1] and (w[1:] == [0.4, 0.5, 0.1]).all()
