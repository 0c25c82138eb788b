"""Every operator on a small table with nulls, empty and long texts, ties, repeated rows and clashing names, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from barlab.llm import chat, embed_lsh, gam, lm, packing, pieces, simhash, suffix, topk, wordpiece
from barlab.llm.shared import components, forest, sorted_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, root string, rest string"


def texts():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta&", "theta<|", "iota", "kappa", "naïve", "ünder"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    base, passage = say(120), say(60)
    out = [None, "", " \n\t ", "one", "two words", base, base, base.replace("alpha", "omega", 1), base + " tail", passage,
        say(30) + passage + say(30), passage + say(5), say(9000), "ab" * 200, "ab" * 180, "▁ x ▁▁y  z\r\nw\x00\x1c", "日本語 テキスト 🙂 ok"]
    return out + [say(rng.randrange(1, 80)) for _ in range(60)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", len(t or ""), 7, "r", "x") for i, t in enumerate(texts())]
    rows += [(None, "nobody's text, " + (rows[5][1] or ""), None, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 3 and 1, 0) for i in range(5, 70)] + [(None, 1, 0), (3, None, 0)],
        "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rng = np.random.default_rng(5)
    v = rng.standard_normal((120, 8))
    v[30:60] = v[:30] + rng.standard_normal((30, 8)) * 0.02
    vec = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    vec += [(120, vec[0][1], 1), (140, None, 1), (141, [0.0] * 8, 2), (142, [float("nan")] * 8, 1), (143, [None] * 8, 1),
        (144, [float("inf")] * 8, 1), (160, [1.0, 2.0], 1), (180, [], 1)]
    spark.createDataFrame(vec, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    talk = [(1, 0, "user", "hi & <|im_end|> &amp;"), (1, 1, "assistant", None), (1, 2, None, "x\ny"), (2, None, "assistant", "b"),
        (2, None, "assistant", "a"), (2, 1, "user\n<|", ""), (None, 0, "assistant", "lost"), (3, 0, "user", "q"), (3, 0, "user", "q")]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    for name, schema in {"documents": SCHEMA, "labels": "doc_id long, quality int, toxic int",
        "embeddings": "vec_id long, embedding array<float>, label int", "conversations": "conv_id long, turn long, role string, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    return d


def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def split(t):
    return (t or "").encode().lower().split()


@pytest.mark.parametrize("query", [lm.op1_lm_scores, suffix.op2_suffix_dedup, topk.op3_topk, embed_lsh.op5_embedding_dedup, simhash.op6_simhash,
    gam.op7_quality, packing.op8_packing, pieces.op9_sentencepiece, wordpiece.op10_token_counts])
def test_empty_tables_give_empty_results(spark, none, query):
    assert query(spark, none).count() == 0


def test_lm_base_and_interpolated_scores(spark, sf):
    own = docs(spark, sf)
    rest = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 for i in own}
    tokens = {i: [*split(t), b"\n"] for i, t in own.items()}
    uni, bi = Counter(), Counter()
    for i, x in tokens.items():
        if rest[i]:
            uni.update(x)
            bi.update(zip([b"\n", *x], x, strict=False))
    n, v = sum(uni.values()), len(uni)
    rows = lm.op1_lm_scores(spark, sf).collect()
    assert len(rows) == len(own)
    for r in rows:
        x = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (rest[r["doc_id"]] == 0, len(x), sum(uni[w] > 0 for w in x), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x))
        assert r["score"] < 0
    # the learned model is better than the base on held-out text
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])


def brute_interpolated(rows, rounds=15):
    """log10 probability of each (id, text, role) as the docstring of score_documents says, without chunks, hashes or Spark."""
    tokens = [[*split(t), b"\n"] for _, t, _ in rows]
    pairs = lambda x: [*zip([b"\n", *x], x, strict=False)]

    def counts(roles):
        uni, bi = Counter(), Counter()
        for x, (_, _, role) in zip(tokens, rows, strict=True):
            if role in roles:
                uni.update(x)
                bi.update(pairs(x))
        return uni, bi, sum(uni.values()), len(uni)

    bucket = lambda c: min(47, math.floor(math.log2(c)) + 1) if c else 0
    weights = {k: [0.4, 0.59, 0.01] if k else [0, 0.99, 0.01] for k in range(48)}
    uni, bi, n, v = counts([lm.COUNTING])
    held = [p for x, (_, _, role) in zip(tokens, rows, strict=True) if role == lm.MIXING for p in pairs(x)]
    for _ in range(rounds if held and n else 0):
        new = {}
        for a, w in held:
            k = bucket(uni[a])
            parts = [weights[k][0] * (bi[a, w] / uni[a] if uni[a] else 0), weights[k][1] * uni[w] / n, weights[k][2] / (v + 1)]
            for j in range(3):
                new.setdefault(k, [0.0] * 3)[j] += parts[j] / sum(parts)
        for k, x in new.items():
            x = [x[0] if k else 0, x[1], max(x[2], 1e-9 * sum(x))]
            weights[k] = [y / sum(x) for y in x]
    uni, bi, n, v = counts([lm.COUNTING, lm.MIXING])
    out = []
    for x in tokens:
        total = 0.0
        for a, w in pairs(x):
            own = weights[bucket(uni[a])]
            total += math.log10(own[0] * bi[a, w] / max(uni[a], 1) + own[1] * uni[w] / n + own[2] / (v + 1)) if n else 0.0
        out.append(total)
    return out


@pytest.mark.parametrize("roles", [(0, 1, 2, 2, 2), (0, 2), (0, 1), (0,)])
def test_lm_scores_equal_brute_force(spark, sf, roles):
    """Weights learned, fixed for want of mixing texts, without counting texts, and without any training text; chunks and slices many and few."""
    rows = [(i, t, roles[n % len(roles)]) for n, (i, t) in enumerate(docs(spark, sf).items())]
    rows += [(5, rows[5][1], rows[5][2])]
    want = sorted((i is None, i or 0, s) for (i, _, _), s in zip(rows, brute_interpolated(rows), strict=True))
    for size in ({}, {"chunk_tokens": 700, "slice_bytes": 2000}):
        got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string, role int"), **size).collect()
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in got)
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def brute_removed(own, length=50):
    first, grams = {}, {}
    key = lambda i: float("inf") if i is None else i
    for i, t in own.items():
        b = (t or "").encode()
        grams[i] = [b[k : k + length] for k in range(len(b) - length + 1)]
        for g in grams[i]:
            first[g] = min(first.get(g, float("inf")), key(i))
    out = {}
    for i, t in own.items():
        b = bytearray(len((t or "").encode()))
        for k, g in enumerate(grams[i]):
            if first[g] < key(i):
                b[k : k + length] = b"\1" * length
        out[i] = bytes(b)
    return out


def test_suffix_dedup_removes_exactly_what_brute_force_does(spark, sf):
    own = docs(spark, sf)
    gone = brute_removed(own)
    for r in suffix.op2_suffix_dedup(spark, sf).collect():
        raw, marks = (own[r["doc_id"]] or "").encode(), gone[r["doc_id"]]
        kept = bytes(b for b, m in zip(raw, marks, strict=True) if not m)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw), sum(marks), len([x for x in marks.split(b"\0") if x]),
            hashlib.sha256(kept).hexdigest())


def test_deep_shallow_order_and_groups():
    rng = random.Random(1)
    buffer = bytes(rng.choice(b"ab") for _ in range(400)) + b"abab" * 60
    starts = np.arange(len(buffer) - 50)
    order, group = suffix.deep_shallow(buffer, starts, 50)
    strings = [buffer[i : i + 50] for i in order]
    assert strings == sorted(buffer[i : i + 50] for i in starts)
    assert [a == b for a, b in zip(strings, strings[1:], strict=False)] == (group[1:] == group[:-1]).tolist()


def test_whole_characters_are_kept(spark):
    rows = [(0, "é" * 80, None), (1, "x" + "é" * 80 + "yz", None)]
    out = {r["doc_id"]: bytes(r["kept"]) for r in suffix.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string, rest string"), 50, True).collect()}
    assert out[1].decode() == "xyz"


def test_top_k_equals_brute_force(spark, sf):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    good = {i: [math.floor(64 * x) for x in v] for i, v in rows.items() if v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in good if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:20]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted(tuple(r) for r in topk.op3_topk(spark, sf).collect()) == sorted(want)


def test_top_k_ties_repeats_and_rounds(spark):
    v = [(i, [1.0, 1.0]) for i in range(70)] + [(200, [2.0**26, 2.0**26]), (201, [1.0, 1.0]), (201, [3.0, 0.0]), (None, [9.0, 9.0]), (300, None)]
    df = spark.createDataFrame(v, "vec_id long, v array<double>")
    for size in (16_000_000, 100):
        rows = topk.top_k(df, df.where("vec_id in (40, 200, 201) or vec_id is null"), k=5, round_bytes=size).collect()
        got = {}
        for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
            got.setdefault((r["query_id"], r["rank"]), []).append((r["vec_id"], r["score"]))
        assert [got[40, n][0][0] for n in range(1, 6)] == [200, 201, 0, 1, 2]
        assert [got[200, n][0][0] for n in range(1, 6)] == [201, 0, 1, 2, 3]
        # two rows of one id are two queries
        assert sorted(got[201, 1]) == [(200, 2**27), (200, 3 * 2**26)] and {*map(len, got.values())} == {1, 2}


def test_top_k_scores_are_exact_up_to_the_last_long(spark):
    rng = random.Random(12)
    v = [(0, [3e9]), (1, [1e9]), (2, [9e8]), (3, [-3037000499.0]), (4, [3037000499.0])]
    v += [(10 + i, [float(rng.randrange(-(2**31), 2**31)) for _ in range(2)]) for i in range(40)]
    df = spark.createDataFrame(v, "vec_id long, v array<double>")
    want = []
    for q, x in v:
        best = sorted((-sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), i) for i, y in v if i != q and len(x) == len(y))[:20]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_k(df, df).collect()) == sorted(want)
    assert max(abs(w[3]) for w in want) > 2**62
    over = spark.createDataFrame([(0, [2.0**32]), (1, [2.0**32])], "vec_id long, v array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(over, over).collect()


def test_embedding_dedup_equals_brute_force(spark, sf):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows.items() if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {i: [j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.95] for i in good}
    for r in embed_lsh.op5_embedding_dedup(spark, sf).collect():
        seen, todo = {r["vec_id"]}, [r["vec_id"]]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert (r["n_links"], r["component_id"], r["kept"]) == (len(links.get(r["vec_id"], [])), min(seen), min(seen) == r["vec_id"])


def test_quality_learns_the_same_from_repeated_ids_in_any_order(spark):
    rng = random.Random(5)
    text = lambda good: " ".join(rng.choice(("The river, however, rises.", "It rains in May.") if good else ("BUY NOW!!! $$$", "click click 111")) for _ in range(rng.randrange(3, 30)))
    rows = [(i, text(i % 2)) for i in range(200)]
    rows += [(i, text(i % 3)) for i in range(0, 200, 4)] + [(7, text(1)) for _ in range(50)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    probe = spark.createDataFrame([(t,) for _, t in rows[:40]], "text string")
    got = []
    for order in (rows, rows[::-1]):
        model = gam.learn(spark.createDataFrame(order, "doc_id long, text string").repartition(3), labels)
        got.append(sorted((r["text"], r["s"]) for r in probe.select("text", gam.quality(model, "text").alias("s")).collect()))
    assert got[0] == got[1] and len({s for _, s in got[0]}) > 2


def test_embedding_buckets_and_grids_count_the_same_pairs(spark):
    """Whole buckets and grids of them, vectors as doubles: the same counts and components, and no link below the threshold."""
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((3, 16))
    rows = [(i, list(map(float, centre[i % 3] + rng.standard_normal(16) * (0.02, 0.12, 0.25)[i % 5 % 3]))) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(300, rows[0][1][:8]), (301, rows[3][1][:8]), (302, None), (303, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [{r["vec_id"]: tuple(r)[1:] for r in embed_lsh.near_vectors(df, block=block).collect()} for block in (4096, 60, 7)]
    assert all(x == got[0] for x in got[1:])
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and any(v)}
    true = {i: sum(j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95 for j in unit) for i in unit}
    found = {i: got[0][i][0] for i in unit}
    assert all(found[i] <= true[i] for i in unit) and sum(found.values()) >= 0.95 * sum(true.values()) > 1000
    assert got[0][302] == (0, 302, True) and got[0][303] == (0, 303, True)


def simple_print(t, words=3):
    w = split(t)
    s = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(ids, near):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            m = min((label[j] for j in ids if near(i, j)), default=label[i])
            if m < label[i]:
                label[i], changed = m, True
    return label


def test_simhash_equals_brute_force(spark, sf):
    own = docs(spark, sf)
    prints = {i: simple_print(t) for i, t in own.items()}
    order = {i: (10**9 if i is None else i) for i in own}
    back = {v: k for k, v in order.items()}
    label = closure([*order.values()], lambda a, b: (prints[back[a]] ^ prints[back[b]]).bit_count() <= 3)
    for r in simhash.op6_simhash(spark, sf).collect():
        component = label[order[r["doc_id"]]]
        assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", None if component == 10**9 else component)


def test_anchor_covering_loses_no_link(spark):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in [*values][:60]:
        for d in (1, 2, 3, 4):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), d)))
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    half = simhash.hamming(5)
    nodes = spark.createDataFrame([(s,) for s in signed], "f0 long")
    for block in (4096, 3):
        links = simhash.anchored_links(nodes, 1, [(0, half, 1), (32, half, 1)], 3, block=block)
        assert all((signed[r["a"]] ^ signed[r["b"]]).bit_count() <= 3 for r in links.collect())
        got = {r["node"]: r["root"] for r in components(links).collect()}
        want = closure([*signed], lambda a, b: (signed[a] ^ signed[b]).bit_count() <= 3)
        assert {s: got.get(s, s) for s in signed} == want


@pytest.mark.parametrize("code", [simhash.hamming(4), simhash.golay()])
def test_codes_cover(code):
    starts, patterns = code.within(code.radius)
    assert (np.diff(starts) >= 1).all()
    v = np.random.default_rng(0).integers(0, 2**code.n, 500).astype(np.uint64)
    s = code.syndromes(v)
    anchor = v ^ patterns[starts[s]]
    assert (code.syndromes(anchor) == 0).all() and (np.bitwise_count(v ^ anchor) <= code.radius).all()


def test_near_duplicate_groups_find_similar_texts(spark, sf):
    own = docs(spark, sf)
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in own.items()}
    near = lambda a, b: (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1) >= 0.8
    label = closure([i for i in sets if i is not None], near)
    # the row without an id belongs to the group that it is like, or to none
    want = label | {None: min((label[i] for i in label if near(i, None)), default=None)}
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == want


def test_near_duplicate_groups_catch_planted_copies(spark):
    """Of copies at a similarity of 0.8 to 0.95, nine of ten at least are in their original's group."""
    rng = random.Random(21)
    rows, planted = [], []
    for i in range(150):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(rng.randrange(60, 400))]
        rows.append((i, " ".join(words)))
        copy = words.copy()
        while True:
            trial = copy.copy()
            trial[rng.randrange(len(trial))] = "new" + str(rng.randrange(10**6))
            a, b = (set(simhash.shingle_hashes(" ".join(x), 5).tolist()) for x in (words, trial))
            if len(a & b) / len(a | b) < rng.uniform(0.8, 0.9):
                break
            copy = trial
        if copy != words:
            rows.append((1000 + i, " ".join(copy)))
            planted.append(i)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(planted) > 100 and sum(got[1000 + i] == i for i in planted) >= 0.9 * len(planted)
    assert all(got[i] == i for i in range(150))


def test_near_duplicate_groups_check_what_failed_links_leave(spark):
    """Pairs around the bound: each candidate that met at an anchor and reaches it connects, whatever became of closer candidates."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(90)]
    own = {}
    for i in range(400):
        t = base.copy()
        t[5 + 8 * rng.randrange(10) + rng.randrange(3)] = f"x{i}"
        if i % 4 == 0:
            t[rng.randrange(90)] = f"y{i}"
        own[i] = " ".join(t)
    hashes = {i: np.unique(simhash.shingle_hashes(t, 5)) for i, t in own.items()}
    sets = {i: set(h.tolist()) for i, h in hashes.items()}
    prints = np.array([simhash.fingerprint(h, 4) for h in hashes.values()])
    code, met = simhash.golay(), np.zeros((len(own), len(own)), bool)
    (homes, home), (starts, patterns) = code.within(code.radius), code.within(code.radius + 1)
    whole = [sum(int(x) << 64 * k for k, x in enumerate(p)) for p in prints]
    for r in range(11):
        v = np.array([(x >> 23 * r) & (2**23 - 1) for x in whole], np.uint64)
        s = code.syndromes(v)
        at = v ^ home[homes[s]]
        for i in range(len(v)):
            met[i] |= np.isin(at, v[i] ^ patterns[starts[s[i]] : starts[s[i] + 1]])
    bits = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2)
    met = (met | met.T) & (bits <= 54)
    likeness = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    cluster = closure([*own], lambda a, b: met[a, b])
    want = closure([*own], lambda a, b: bits[a, b] == 0 or (cluster[a] == cluster[b] and bits[a, b] <= 54 and likeness(a, b) >= 0.8))
    table = spark.createDataFrame([*own.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(table).collect()}
    assert len({*want.values()}) > 2 and got == want


def test_jaccards_are_those_of_single_pairs():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)).tobytes() for n in (0, 0, 1, 20, 40, 40, 300)]
    many = simhash.jaccards(sets, sets[::-1], step=7)
    assert many.tolist() == [[simhash.jaccard(a, b) for b in sets[::-1]] for a in sets]


def test_near_duplicate_groups_look_behind_closer_pairs_that_fail(spark):
    """0 and 1 have 77 of 95 shingles in common, 2 has 76 of 96 with either and is closer to both by fingerprint: 0 and 1 are a group all the same."""
    rows = []
    for n, (case, place) in enumerate({c: random.Random(c).randrange(45, 80) for c in (408, 1015, 1066, 1732, 1891, 2056)}.items()):
        for i, p in enumerate((20, 24, place)):
            rows.append((3 * n + i, " ".join(f"s{case}x{i}" if k == p else f"s{case}w{k}" for k in range(90))))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - (i % 3 == 1) for i in range(len(rows))}


def test_quality_learns_a_rule_and_scores_all_texts(spark, tmp_path):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(300):
        good = i % 4 != 0
        words = [("".join(rng.choice("abcdefg") for _ in range(5))) + ("" if good else "!!") for _ in range(40)]
        rows.append((i, " ".join(words) if good else " ".join(words).upper()))
        marks.append((i, int(good)))
    rows += [(1000, None), (1001, ""), (None, "who")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = gam.op7_quality(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    for r in out:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
    held = [(r["score"], dict(marks)[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert all((s >= 0.3) == (y == 1) for s, y in held)


def test_quality_scores_are_sums_of_looked_up_additions(spark, tmp_path):
    """Every score equals the model's tables looked up one by one; repeated rows, conflicting labels and labels of fold 0 change nothing that they should not."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["one", "Two!", "3", "FOUR"]) for _ in range(rng.randrange(1, 60)))) for i in range(120)]
    rows += [rows[3], rows[3], (None, None)]
    marks = [(i, int(len(t) > 90)) for i, t in rows[:110]]
    table, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks + [(4, 0), (4, 1), (4, 1)], "doc_id long, quality int")
    model = gam.learn(table, labels)
    for r in table.select("doc_id", "text", gam.quality(model, "text").alias("score")).collect():
        x = gam.features(r["text"])
        z = model.intercept + sum(t[int((np.asarray(c) <= v).sum())] for v, c, t in zip(x, model.cuts, model.tables, strict=True))
        z += sum(t[int((np.asarray(model.coarse[i]) <= x[i]).sum()), int((np.asarray(model.coarse[j]) <= x[j]).sum())] for (i, j),
            t in zip(model.pairs, model.pair_tables, strict=True))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)))
    # labels of fold 0 teach nothing
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in marks] + [(4, 0), (4, 1), (4, 1)], "doc_id long, quality int")
    assert gam.learn(table, flipped).intercept == model.intercept and all((a == b).all() for a, b in zip(gam.learn(table, flipped).tables, model.tables, strict=True))


def test_quality_held_out(spark):
    """Held-out figures on the given tables: labelled rows of fold 0, which teach nothing."""
    sf = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["score"], marks[r["doc_id"]], r["predicted"]) for r in gam.op7_quality(spark, sf).collect() if r["held_out"] and marks.get(r["doc_id"]) is not None]
    good, bad = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    area = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert area > 0.97 and sum(p == y for _, y, p in held) / len(held) > 0.95


def test_gam_uses_a_pair():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.fit(x, y)
    assert (0, 1) in model.pairs
    z = rng.uniform(-1, 1, (1000, 4))
    assert ((model.score(z) > 0.5) == ((z[:, 0] > 0) ^ (z[:, 1] > 0))).mean() > 0.95


def test_packing_holds_every_token_once(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = docs(spark, sf)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.op8_packing(spark, sf).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == own.keys()
    for i, parts in by_doc.items():
        ids = np.array([*tokenizer.encode(own[i] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096


def test_packing_pads_little_and_only_below_a_sequence(spark):
    """Sequences are bins of one class, padded by less than a piece, or a tail of powers of two without padding."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["stone", "river", "cloud"]) for _ in range(rng.choice([0, 3, 90, 700, 5000])))) for i in range(160)]
    out = packing.packed_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    filled = Counter()
    for r in out:
        filled[r["sequence_id"]] += r["length"]
    assert sorted(filled) == list(range(len(filled)))
    odd = [n for n in filled.values() if n < 4096 * 0.98]
    assert all(n & (n - 1) == 0 for n in odd) and len(odd) == len({*odd})
    spent = sum(n if n in odd else 4096 for n in filled.values())
    assert sum(filled.values()) > 0.985 * spent


def test_word_tokens_are_the_tokenizers_own():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(8)
    parts = [*"aB9.,!?;:<|>_-'\" \t\n\r\x0b\x0c\x1céß日🙂", "<|endoftext|>", "<|im_end|>", "the", "don't", "\u0301"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(4000)]
    ids, of = packing.WordTokens.of(path, 2).encode(pa.array(some))
    got = np.split(ids, np.cumsum(of)[:-1])
    want = Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)
    assert [x.tolist() for x in got] == [[*e.ids, 2] for e in want]


def test_cut_covers_lengths():
    for n in [*range(1, 300), 4095, 4096, 4097, 9000]:
        parts = packing.cut(n, 4096, 64)
        assert sum(x for x, _ in parts) == n and all(j * x <= 4096 for x, j in parts)


def test_sentencepiece_round_trip_and_best_sum(spark, sf):
    import public_tokenizers

    own, path = docs(spark, sf), public_tokenizers.path("piece_bpe_32k.model")
    for r in pieces.op9_sentencepiece(spark, sf).collect():
        assert r["decoded_sha256"] == hashlib.sha256((own[r["doc_id"]] or "").encode()).hexdigest()
    import sentencepiece

    model, p = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(path)
    known = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    for text in ["alpha beta", "  two  spaces", "naïve 日本語x", "line\nend"]:
        s = ("▁" + text).replace(" ", "▁")
        best = [0.0] + [-1e18] * len(s)
        for e in range(1, len(s) + 1):
            best[e] = max([best[e - 1] + p.unknown] + [best[b] + known[s[b:e]] for b in range(max(0, e - 40), e) if s[b:e] in known])
        spent, fallback = 0.0, b""
        for i in p.encode(text).tolist():
            if model.is_byte(i):
                fallback += p.table[i]
            else:
                spent += known[model.id_to_piece(i)]
        assert spent + p.unknown * len(fallback.decode()) == pytest.approx(best[-1])


def test_token_counts_equal_greedy_matching(spark, sf):
    import public_tokenizers

    initial, inner = map(set, wordpiece.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))

    def greedy(w):
        n = at = 0
        while at < len(w):
            end = next((e for e in range(len(w), at, -1) if w[at:e] in (inner if at else initial)), None)
            if end is None:
                return 0
            at, n = end, n + 1
        return n

    own = docs(spark, sf)
    for r in wordpiece.op10_token_counts(spark, sf).collect():
        counts = [greedy(w.decode()) for w in (own[r["doc_id"]] or "").encode().split()]
        assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (len(counts), sum(counts) + counts.count(0), counts.count(0))


def test_chat_round_trip(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    want = {-1: [("user", chat.CONTROL), ("assistant", chat.CONTROL)]}
    for r in sorted(rows, key=lambda r: (r["turn"] is None, r["turn"] or 0, r["role"] or "", r["text"] or "")):
        want.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    got = chat.op4_chat_format(spark, sf).collect()
    assert {r["conv_id"] for r in got} == want.keys()
    for r in got:
        turns = want[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_layouts(spark):
    records = [
        ("a", '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}'),
            ("b", '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}'),
        ("c", '{"instruction": "do", "input": "this", "output": "done"}'), ("d", '{"instruction": "do", "output": "done"}'),
            ("e", '{"prompt": "p", "completion": "c"}'), ("f", '{"response": "r", "prompt": "p"}'),
        ("g", '{"unknown": 1}'), ("h", None), ("i", "not json"), ("j", '{"turn": 1, "role": "assistant", "text": "two"}'),
            ("j", '{"turn": 0, "role": "user", "text": "one"}'), ("k", '{"instruction": "do", "input": "", "output": null}'),
    ]
    got = {r["id"]: (r["layout"], [(t["role"], t["text"]) for t in r["turns"]]) for r in chat.canonical_turns(spark.createDataFrame(records,
        "id string, record string")).collect()}
    qa = [("user", "q"), ("assistant", "a")]
    assert got["a"][1] == qa and got["b"][1] == qa
    assert got["c"][1] == [("user", "do"), ("user", "this"), ("assistant", "done")] and got["d"][1] == [("user", "do"), ("assistant", "done")]
    assert got["e"][1] == [("user", "p"), ("assistant", "c")] and got["f"][1] == [("user", "p"), ("assistant", "r")]
    assert got["g"] == (None, []) and got["h"] == (None, []) and got["i"] == (None, [])
    assert got["j"][1] == [("user", "one"), ("assistant", "two")] and got["k"][1] == [("user", "do"), ("assistant", "")]


def test_chat_fingerprints_select(spark):
    """Fields that no mapping names change nothing; a combination of known fields that none declares has no turns."""
    records = [
        ("a", '{"id": 5, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "name": "x"}]}'),
            ("b", '{"messages": [{"role": "user"}, {"content": "late"}]}'), ("c", '{"prompt": "p", "completion": "c", "response": "r"}'),
        ("d", '{"messages": []}'), ("e", '{"messages": "none"}'), ("f", '{"turn": "x", "role": "user", "text": "odd"}'),
            ("f", '{"turn": 2, "role": "user", "text": "two"}'), ("g", "[1]"),
    ]
    got = {r["id"]: (r["layout"], [(t["role"], t["text"]) for t in r["turns"]]) for r in chat.canonical_turns(spark.createDataFrame(records,
        "id string, record string")).collect()}
    assert got["a"] == ("messages", [("user", "q"), ("assistant", "a")]) and got["b"] == ("messages", [("user", ""), ("", "late")])
    assert all(got[k] == (None, []) for k in "cdeg") and got["f"] == ("turn rows", [("user", "two"), ("user", "odd")])
    struct = spark.createDataFrame([(1, ([("human", "q"), ("gpt", None)], 3)), (2, None)],
        "id long, record struct<conversations: array<struct<`from`:string,value:string>>, odd: int>")
    got = {r["id"]: (r["layout"], [(t["role"], t["text"]) for t in r["turns"]]) for r in chat.canonical_turns(struct).collect()}
    assert got == {1: ("shared dialogue", [("user", "q"), ("assistant", "")]), 2: (None, [])}
    table = spark.createDataFrame([(1, 0, "user", "q", "s", 2), (1, 1, "assistant", "a", "s", 2)],
        "conv long, turn int, role string, text string, id string, `odd.name` int")
    assert [(r["layout"], len(r["turns"])) for r in chat.row_turns(table, "conv").collect()] == [("turn rows", 2)]
    assert {(r["layout"], len(r["turns"])) for r in chat.row_turns(table.drop("role"), "conv").collect()} == {(None, 0)}


def test_chat_with_clashing_columns_keeps_every_text(spark, tmp_path):
    """Columns called like fields of other layouts change no conversation, and each has one row."""
    talk = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "r"), (None, 0, "user", "lost")]
    plain, odd, none = (str(tmp_path / n) for n in ("plain", "odd", "none"))
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{plain}/conversations.parquet")
    extra = [(*r, "s", "i", "p", "c", "r", "u", "o", [("human", "x")], [("user", "y")]) for r in talk]
    spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, system string, input string, prompt string, completion string, response string, "
        "instruction string, output string, conversations array<struct<`from`: string, value: string>>, messages array<struct<role: string, content: string>>").write.parquet(f"{odd}/conversations.parquet")  # fmt: skip
    rows = lambda d: sorted(map(str, chat.op4_chat_format(spark, d).collect()))
    assert rows(odd) == rows(plain) and len(rows(odd)) == 4 and sum("n_turns=2" in r for r in rows(odd)) == 2
    spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "conv_id long, message string").write.parquet(f"{none}/conversations.parquet")
    assert sorted((r["conv_id"], r["n_turns"]) for r in chat.op4_chat_format(spark, none).collect()) == [(-1, 2), (1, 2), (2, 1)]
    bare = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "conv_id long, message string")
    assert sorted((r["id"], r["layout"], len(r["turns"])) for r in chat.row_turns(bare, "conv_id").collect()) == [(1, None, 0), (2, None, 0)]
    records = [("a", '{"system": "s", "messages": [{"role": "user", "content": "q"}]}'), ("b", '{"input": "i", "turn": 0, "role": "user", "text": "t"}'),
        ("c", '{"prompt": "p", "response": "r", "input": "i"}'), ("d", '{"prompt": "p", "completion": "c", "messages": [{"role": "user", "content": "q"}]}')]
    got = {r["id"]: (r["layout"], [t["text"] for t in r["turns"]]) for r in chat.canonical_turns(spark.createDataFrame(records, "id string, record string")).collect()}
    assert got == {"a": ("messages", ["q"]), "b": ("turn rows", ["t"]), "c": ("prompt and response", ["p", "r"]), "d": (None, [])}


@pytest.mark.parametrize("hot_runs", [0, 6, 10**9])
def test_suffix_dedup_however_hot_anchors_are_dealt(spark, hot_runs):
    """A phrase in every document, with other texts around it, and copies; every string by definition."""
    rng = random.Random(7)
    say = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    phrase, longer = say(40), say(90)
    rows = [(i, say(rng.randint(0, 90)) + (phrase if i % 4 else longer) + say(rng.randint(0, 60)), None) for i in range(60)]
    rows += [(60 + i, rows[i][1][rng.randint(0, 20) :] + say(10), None) for i in range(20)] + [(90, "ab" * 80, None), (91, "ab" * 70, None), (92, None, None)]
    first = {}
    for i, text, _ in rows:
        for a in range(len(text or "") - 49):
            first.setdefault(text[a : a + 50], i)
    want = {}
    for i, text, _ in rows:
        gone = {b for a in range(len(text or "") - 49) if first[text[a : a + 50]] < i for b in range(a, a + 50)}
        want[i] = "".join(c for b, c in enumerate(text or "") if b not in gone)
    out = suffix.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string, rest string").repartition(9), hot_runs=hot_runs, chunk_bytes=900, slice_bytes=2000, sorted_bytes=3000)
    assert {r["doc_id"]: bytes(r["kept"]).decode() for r in out.collect()} == want
    assert sum(len(t or "") for _, t, _ in rows) - sum(map(len, want.values())) > 2000


def test_parts_of_a_hot_anchor_are_many_groups():
    """The phrase's strings with other texts around them do not meet in one group."""
    rng = random.Random(3)
    say = lambda n: bytes(rng.choice(b"abcdefghijklmnop") for _ in range(n))
    phrase = say(20)
    chunk = suffix.Chunk([say(60) + phrase + say(60) for _ in range(400)], np.arange(400), 50)
    often = np.bincount(chunk.at)
    hot = often == often.max()
    assert often.max() > 100
    runs, low, high, hashed = chunk.parts(hot)
    assert np.bincount(np.unique(hashed, return_inverse=True)[1]).max() <= 2 and len(runs) > often.max()
    # every string of the runs is in one part
    starts = sorted((r, s) for r, a, b in zip(runs, low, high) for s in range(a, b + 1))
    assert starts == sorted((r, s) for r in np.flatnonzero(hot[chunk.at]) for s in range(chunk.low[r], chunk.high[r] + 1))


def test_contexts_of_several_chunks_are_sorted_once(monkeypatch):
    rng = random.Random(11)
    say = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    one, two = say(84), say(70)
    contexts = [one, two, one, one[9:70], say(30) + one[:54], one, two]
    told = np.array([7, 3, 5, 6, 4, 9, 3])
    seen = []
    sort = suffix.deep_shallow
    monkeypatch.setattr(suffix, "deep_shallow", lambda buffer, suffixes, length: seen.append(len(suffixes)) or sort(buffer, suffixes, length))
    got = suffix.smaller_masks(iter(contexts), told, 50)
    least = {}
    for x, i in zip(contexts, told.tolist()):
        for a in range(len(x) - 49):
            least[x[a : a + 50]] = min(i, least.get(x[a : a + 50], i))
    assert got.tolist() == [sum((least[x[a : a + 50]] < i) << a for a in range(len(x) - 49)) for x, i in zip(contexts, told.tolist())]
    assert seen == [sum(len(x) - 49 for x in set(contexts))]


@pytest.mark.parametrize("block", [64, 1000, 2**16])
def test_anchors_whatever_the_blocks(monkeypatch, block):
    """Every string is in one run, and equal strings have one anchor at one place, also across the blocks' edges."""
    monkeypatch.setattr(suffix, "BLOCK", block)
    rng = random.Random(block)
    texts = [bytes(rng.choice(b"ab\xff" if i % 3 else b"a") for _ in range(rng.choice([0, 1, 49, 50, 51, 90, 700]))) for i in range(30)]
    texts += [t[5:] for t in texts] + [b""]
    buffer, ends = b"".join(texts), np.cumsum([*map(len, texts)])
    runs = [*zip(*(x.tolist() for x in suffix.anchors(buffer, ends, 50)), strict=True)]
    starts = [(d, s) for d, low, high, *_ in runs for s in range(low, high + 1)]
    assert starts == [(d, s) for d, end in enumerate(ends.tolist()) for s in range(end - len(texts[d]), end - 49)]
    seen = {}
    for _, low, high, place, h in runs:
        for s in range(low, high + 1):
            assert 0 <= place - s <= 34 and seen.setdefault(buffer[s : s + 50], (place - s, h)) == (place - s, h)


def test_suffix_dedup_of_the_largest_id(spark):
    text = "x" * 30 + "".join(map(chr, range(97, 122))) * 3
    rows = spark.createDataFrame([(5, text, None), (2**63 - 1, text, None), (None, text, None)], "doc_id long, text string, rest string")
    got = sorted(((r["doc_id"], len(r["removed"])) for r in suffix.repeated_strings(rows).collect()), key=str)
    assert got == [(5, 0), (2**63 - 1, 1), (None, 1)]


def test_chat_of_an_empty_table_is_the_extra_conversation(spark, none, sf):
    assert [r["conv_id"] for r in chat.op4_chat_format(spark, none).collect()] == [-1]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (None, 3), (41, 40), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 42)} | {100 + i: 100 for i in range(1, 30)} | {201: 200}


def test_forest_and_sorted_groups():
    import pandas as pd

    assert forest(5, np.array([3, 1]), np.array([4, 3])).tolist() == [0, 1, 2, 1, 1]
    parts = [pd.DataFrame({"k": [1, 1, 2]}), pd.DataFrame({"k": []}), pd.DataFrame({"k": [2, 2, 3]})]
    assert [len(g) for g in sorted_groups(parts, ["k"])] == [2, 3, 1]
