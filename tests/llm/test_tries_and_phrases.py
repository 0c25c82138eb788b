"""Prefix trie, license scans and collocations on small tables with nulls, ties, repeats, long texts and clashing names, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from barlab.llm import collocations, licenses, prefix_trie

DOCS = "doc_id long, text string, lang string, source string, words string, n long, phrase string, spans string, chunk long"
TALK = "conv_id long, turn long, role string, text string, id long, digest string, turns string, base long"


def texts():
    rng = random.Random(11)
    vocabulary = ["The", "license", "MIT", "general", "public", "apache", "of", "éa", "x1", "über", "software", "is", "日本"]
    say = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n", "\t", " \x1c"]) for _ in range(n))
    out = [None, "", " \t\n.", "mit-license", "MIT\nLicense mit license", "general public license general public license", say(20_000), "a " * 500, "a.a.a b b b b b b"]
    return out + [say(rng.randrange(1, 120)) for _ in range(80)]


@pytest.fixture(scope="module")
def documents(spark):
    langs = ["en", "de", None, "und"]
    rows = [(i, t, langs[i % 4], "s", "w", 1, "p", "q", 5) for i, t in enumerate(texts())]
    rows += [(2**63 - 1, rows[5][1], "en", None, None, None, None, None, None), (None, rows[4][1], None, None, None, None, None, None, None), rows[7]]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def spelt(docs, lang_of):
    for lang, text in docs:
        text = (text or "").encode().lower().decode() if (text or "").isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), text)
        yield lang_of(lang), [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def brute_collocations(docs, threshold, longest):
    n, f = Counter(), Counter()
    for lang, pieces in spelt(docs, lambda x: "und" if x is None else x):
        for words in pieces:
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= threshold}
    inside = defaultdict(int)
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    rows = defaultdict(list)
    for (lang, w), a in candidates.items():
        if 100 * inside[lang, w] >= 100 * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        rows[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in rows.items() for i, (s, a, p, left, right) in enumerate(sorted(own)))


@pytest.mark.parametrize("sizes", [{}, {"shards": 3, "chunk_tokens": 300, "slice_keys": 200, "most_bits": 6}, {"shards": 1, "chunk_tokens": 5000}])
def test_collocations_are_brute_forces(documents, sizes):
    docs = [(r["lang"], r["text"]) for r in documents.collect()]
    for top, threshold in ((None, 12), (7, 5)):
        got = collocations.collocations(documents, threshold=threshold, longest=5, top=top, **sizes)
        want = [r for r in brute_collocations(docs, threshold, 5) if top is None or r[1] <= top]
        assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 10


def test_no_collocations(spark, documents):
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for docs in (documents.limit(0), documents.where("text is null"), documents.where("length(text) < 5")):
        got = collocations.collocations(docs)
        assert got.columns == columns and got.count() == 0


def test_collocation_scores_past_64_bits(spark):
    wide = spark.createDataFrame([(10**14, 10**15, 10**9, 10**9)], "a long, n long, l long, r long")
    d = lambda c: f"cast({c} as decimal(18,0))"
    row = wide.selectExpr(f"(cast(1000 as decimal(4,0)) * ({d('a')} * {d('n')})) div ({d('l')} * {d('r')}) as s").first()
    assert row["s"] == 1000 * 10**14 * 10**15 // 10**18


def test_automaton_is_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        sequences = [[rng.randint(1, 3) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 4))]
        text = [rng.randint(1, 4) for _ in range(30)]
        parts = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        automaton = licenses.Automaton(sequences)
        for i, (v, n) in enumerate(automaton.statistics(text)):
            assert n == max([k for k in range(i + 2) if tuple(text[i - k + 1 : i + 1]) in parts], default=0)
            if n:
                ends = {(q, j) for q, s in enumerate(sequences) for j in range(n - 1, len(s)) if s[j - n + 1 : j + 1] == text[i - n + 1 : i + 1]}
                assert set(automaton.ends[v]) == ends and len(automaton.ends[v]) == len(ends)


def folded(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_phrase_places_are_brute_forces(spark, documents, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.op12_licenses(spark, str(tmp_path)).collect()
    want = []
    for r in documents.collect():
        w, places = folded(r["text"]), []
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        starts = [i for i, _ in places]
        want.append((r["doc_id"], len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert any(r["n_base"] > 5 for r in got)
    empty = licenses.license_spans(documents.limit(0))
    assert empty.columns == ["doc_id", "n_words", "spans"] and empty.count() == 0


def test_license_texts_are_found_and_clean_ones_left_alone(spark):
    rng = random.Random(4)
    noise = lambda n: " ".join(rng.choice(["in", "the", "of", "and", "to", "copy", "any", "software", "river", "stone", "blue"]) for _ in range(n))
    rows, want = [], {}
    for i, (label, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        broken = "\n".join("# " + " ".join(words[j : j + 7]) for j in range(0, len(words), 7))
        named = " ".join(words[: len(words) // 2] + ["Some", "Holder"] + words[len(words) // 2 :])
        for k, t in enumerate((text, noise(300) + "\n" + broken + "\n" + noise(50), named, text.upper())):
            rows.append((i * 10 + k, t))
            want[i * 10 + k] = label
    rows += [(1000 + i, noise(400)) for i in range(30)]
    for r in licenses.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found = {s["label"] for s in r["spans"] if s["coverage"] >= 0.5}
        if r["doc_id"] < 1000:
            assert want[r["doc_id"]] in found, (r["doc_id"], want[r["doc_id"]], found)
            best = max((s for s in r["spans"] if s["label"] == want[r["doc_id"]] and not s["named"]), key=lambda s: s["coverage"])
            assert best["coverage"] > 0.85 and best["last"] < r["n_words"]
            assert best["first"] == (300 if r["doc_id"] % 10 == 1 else 0)
        else:
            assert not found


def talk():
    rng = random.Random(8)
    says = ["hello", "hi there you", "", None, "Étion x\ty", "ok  ok", "a\nb c"]
    rows = []
    for c in [*range(-3, 130), 2**62, 200, 201]:
        for turn in range(rng.choice([1, 1, 2, 3, 6, 40 if c % 50 == 7 else 4])):
            rows.append((c, turn, ["user", "assistant", None][turn % 3], rng.choice(says[: 2 if turn < 2 else 7]), 1, "d", "t", 3))
    rows += [(5, None, "user", "nobody's", 1, "d", "t", 3), (5, None, "system", "nobody's", 1, "d", "t", 3), (None, 0, "user", "lost", 1, "d", "t", 3)]
    return rows + [r for r in rows if r[0] == 9]


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        seq = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(m) - 1) * words
    return sorted((m[0], len(node), members[node[:-1]][0] if node else None, len(m), children[node], leaves[node], saved[node],
        hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()) for node, m in members.items())


def test_prefix_trie_is_brute_force(spark, tmp_path):
    rows = talk()
    spark.createDataFrame(rows, TALK).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    want = brute_trie(rows)
    assert len(want) > 100 and max(r[1] for r in want) > 20
    assert sorted(tuple(r) for r in prefix_trie.op11_prefix_trie(spark, str(tmp_path)).collect()) == want
    plain = duckdb.connect()
    plain.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    sql = plain.sql(prefix_trie.SQL["op11_prefix_trie"])
    at = [sql.columns.index(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")]
    assert sorted(tuple(r[i] for i in at) for r in sql.fetchall()) == want


@pytest.mark.parametrize("shard_turns", [1, 7, 1000])
def test_prefix_trie_over_many_shards(spark, shard_turns):
    """Long common prefixes, sequences that end where the next shard goes on, copies, an empty one."""
    rng = random.Random(shard_turns)
    seqs = [[], [1], [1], [1, 2], [1, 2, 3], [1, 2, 3], list(range(60)), [*range(60), 5], [*range(60), 5]] + [[1, 2, 3, *[rng.randint(0, 1) for _ in range(rng.randint(0, 6))]] for _ in range(80)]
    words = lambda x: 3 * x + 1
    frame = spark.createDataFrame([(i + 5, [(x, words(x)) for x in s]) for i, s in enumerate(seqs)], f"conv_id long, turns {prefix_trie.TURNS}")
    got = prefix_trie.trie(frame, shard_turns=shard_turns).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    members, ends = defaultdict(list), defaultdict(list)
    for i, s in enumerate(seqs):
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(i + 5)
        ends[tuple(s)].append(i + 5)
    children = Counter(n[:-1] for n in members if n)
    below = {n: [m for m in members if m[: len(n)] == n] for n in members}
    want = sorted((m[0], len(n), members[n[:-1]][0] if n else None, len(m), children[n], sum(children[x] == 0 for x in below[n]),
        sum((len(members[x]) - 1) * words(x[-1]) for x in below[n] if x), hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, m in members.items())
    assert sorted(tuple(r) for r in got.collect()) == want


def test_prefix_trie_of_nothing(spark, tmp_path):
    spark.createDataFrame([], TALK).write.parquet(f"{tmp_path}/conversations.parquet")
    got = prefix_trie.op11_prefix_trie(spark, str(tmp_path))
    assert got.count() == 0 and "saved_tokens" in got.columns


def test_trees_are_balanced():
    tree = prefix_trie.TernaryTree()
    for i in prefix_trie.medians(1000):
        tree.insert([i], [1], 1, i, "")
    depth = {0: 0}
    order, _ = tree.walk()
    for at in order:
        for to in (tree.below[at], tree.above[at], tree.down[at]):
            if to >= 0:
                depth[to] = depth[at] + 1
    assert max(depth.values()) <= 11 and len(order) == 1001
