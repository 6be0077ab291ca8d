"""Each operator against a plain version of it, and over awkward rows: nulls, empty and long texts, ties, repeats, no rows, extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbascope.llm import bpe, classifier, components, exact_dedup, html_text, katz, mixing, quality_rules, simhash, token_counts, url_filter

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, _text string, _id int, size double, id string, fp string"
ROWS = [
    (1, "The cat sat on the mat", "a"), (2, "THE CAT SAT ON THE MAT", "b"), (3, None, "a"), (4, "", None), (5, " \t\n", "b"), (6, "é É\x1cx\xa0y one", "c"),
    (7, "the cat sat on the mat today", None), (8, "word " * 20_000, "a"), (9, "x" * 70_000, "c"), (None, "the cat sat", "a"), (1, "The cat sat on the mat", "a"), (10, "É é\x1cX\xa0y one", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", 7, 0.5, "z", "q") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").translate(AZ))


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[(t or "").translate(AZ)].append(i)
    want = []
    for i, t, _ in ROWS:
        n = (t or "").translate(AZ)
        keep = max((x for x in groups[n] if x is not None), default=None)
        want.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()), key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(empty).collect() == []
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {w[0] for w in want if w[3]}


def plain_mix(rows, passes=3):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    open_ = set(order)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > passes * sizes[s]}
        target |= {s: passes * sizes[s] for s in full} if full else share
        open_ -= full or open_
    return sizes, target


def test_mixing_targets_and_order(spark, docs, empty):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "a", "a", "b", "c", None, "d"])) for i in range(600)]
    sizes, target = plain_mix(rows)
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        assert r.size == len(words(rows[r.doc_id][1])) and r.source_size == sizes[source[r.doc_id]] and 0 <= r.taken <= 3 * r.size
        assert math.isclose(r.target, target[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 60 for s in target) and sum(taken.values()) <= sum(sizes.values())
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    odd = mixing.mix(docs)
    assert odd.count() == len(ROWS) and odd.where("taken > 3 * size").count() == 0
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(docs).columns == docs.columns


def test_fair_targets_caps_and_shares_again(spark, monkeypatch):
    from verbascope.llm import common

    monkeypatch.setattr(common, "LEAST_RANGE_ROWS", 3)
    got, budget = mixing.fair_targets(spark.createDataFrame([("sa", 10), ("sb", 1000), ("t", 0)], "_name string, _total long"))
    plan = {r._name: r._target for r in got.collect()}
    assert plan["sa"] == 30.0 and math.isclose(plan["sb"], 980.0) and plan["t"] == 0.0 and budget == 1010
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 50), f"s{rng.randint(0, 25):03}" if rng.random() < 0.5 else "s007") for i in range(500)]
    sizes, target = plain_mix(rows)
    got, _ = mixing.fair_targets(spark.createDataFrame([(f"s{k}", n) for k, n in sizes.items()], "_name string, _total long"))
    assert all(math.isclose(r._target, target[r._name[1:]], abs_tol=1e-9) for r in got.collect())


def test_mixing_hot_source_and_equal_rows(spark, monkeypatch):
    from verbascope.llm import common

    for name, value in (("LEAST_RANGE_ROWS", 20), ("HOT_ROWS", 50), ("SALTS", 4)):
        monkeypatch.setattr(common, name, value)
    rows = [(None, "a b c", "hot")] * 300 + [(i, "w " * (i % 9), "hot") for i in range(200)] + [(i, "x y", f"s{i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df).collect()
    sizes, target = plain_mix(rows)
    name = {n: s for s, n in sizes.items()}
    taken = Counter()
    for r in got:
        taken[r.source_size, round(r.target, 6)] += r.taken
    want = Counter()
    for s in sizes:
        want[sizes[s], round(target[s], 6)] += target[s]
    assert len(got) == len(rows) and name and all(abs(taken[k] - want[k]) <= 9 * len(sizes) for k in want) and sum(taken.values()) <= sum(sizes.values())


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/7x?y", "https://a.example.com/en/8", "ftp://example.net/de/81#a", "http://x.net/de/", "http://notexample.net", "http://org/es/1", "http://b.org/es", "http://com/en/", "x://c.com/en/?/en/7", "http://badexample.com/en/7", "://.com/en/a"]
    df = spark.createDataFrame([(i % 5, u, 1, "x") for i, u in enumerate(urls)], "page_id long, url string, rule int, _host string")
    for u, r in zip(urls, url_filter.filter_urls(df.coalesce(1)).collect(), strict=True):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(AZ), m[2]) if m else ("", "")
        fit = [x for x in url_filter.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.text), default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best.text if best else None, best.action if best else "allow"), u
    assert url_filter.filter_urls(df.limit(0)).collect() == []
    assert {r.verdict for r in url_filter.filter_urls(df, ()).collect()} == {"allow"}
    assert all(len(v) for v in url_filter.build_index(df.selectExpr("'a.com' _host", "'/en/x' _path"), url_filter.RULES).values())


def repeat_words(w):
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    return len({i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)})


def test_quality_rules(spark, docs, empty):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice(["a", "b", "cc", "#", "|x", "é"]) + rng.choice([" ", "\n", "\t", "  ", "\n\n"]) for _ in range(rng.randint(0, 120)))) for i in range(60)]
    rows += [(100, "- a\n* b\n• c\n" * 30), (101, "one two three ...\nfour five six…\nseven" + " w" * 60), (102, "1 2 3 4 " * 20 + "word " * 30), (103, "!" * 50_000 + " a" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    every = tuple(dict.fromkeys([*wanted, *(r.metric for r in quality_rules.RULES)]))
    want, plain = {}, {}
    for i, t in rows:
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        n = len(w)
        want[i] = (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat_words(w))
        letters, dots, bullets = sum(any(map(str.isalpha, x)) for x in w), sum(bool(re.search(r"(?:\.\.\.|…)\s*$", x)) for x in lines), sum(bool(re.match(r"\s*[-*•]", x)) for x in lines)
        fails = {"few_words": n < 50, "repetition": 2 * want[i][4] > n, "word_length": not 2 * n <= want[i][1] <= 15 * n, "symbols": 2 * want[i][2] > n, "few_letters": 10 * letters < 7 * n, "ellipses": 10 * dots > 3 * len(lines), "bullets": 10 * bullets > 9 * len(lines), "repeated_lines": 10 * want[i][3] > 3 * len(lines)}
        plain[i] = {k for k, x in fails.items() if x}
    assert set().union(*plain.values()) == {r.name for r in quality_rules.RULES}
    order = quality_rules.order_rules(df, wanted=wanted)
    for order in (order, order[::-1]):
        got = {r.doc_id: r for r in quality_rules.cascade(df, wanted=wanted, order=order).collect()}
        for i, r in got.items():
            assert tuple(r[m] for m in wanted) == want[i] and r.kept == (not plain[i])
            assert r.failed_rule == next((x.name for x in order if x.name in plain[i]), None)
            done = set(wanted) | {x.metric for x in order[: 1 + next((k for k, x in enumerate(order) if x.name in plain[i]), len(order))]}
            assert {m for m in every if r[m] is not None} == done, "what comes after a failure isn't measured"
    assert {r.name for r in order} == {r.name for r in quality_rules.RULES}
    assert {r.metric for r in quality_rules.order_rules(df, wanted=wanted)[:4]} <= set(wanted)
    assert quality_rules.cascade(docs).count() == len(ROWS) and quality_rules.cascade(empty).collect() == []


def test_bpe_agrees_with_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary_path()
    library, (merges, special) = tokenizers.Tokenizer.from_file(path), bpe.load(path)
    encoder, digester = bpe.TextEncoder(merges, special), bpe.Digester(merges, special)
    viewer, meant = bpe.TextEncoder(merges, special, digester.view, digester.part), bpe.spelled_text(merges, special)
    rng = random.Random(1)
    alphabet = "abeinorsth'’ .,!?-019ÉéßΣςİ̧가각ᄀ漢\x1c\x85\xa0　\t\n#<|🙂"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["a" * 70_000, "!" * 70_000, "it's " * 20_000, "x" * 66_000 + "'s<|endoftext|>é", "é" * 70_000, "́" * 66_000, "", "<|startoftext|> a"]
    texts += ["".join(rng.choice("abinthereo'st!") for _ in range(3_000)) for _ in range(10)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert [i for block in encoder.encode(text) for run in block for i in run] == want
        n, ids, decoded, chars = digester.digest(viewer.encode(text))
        machine = bpe.TextDecoder(meant)
        plain = "".join(machine.feed([i]) for i in want) + machine.end()
        assert (n, chars) == (len(want), len(plain)) and ids == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert decoded == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_word_encoder_needs_no_more_than_its_lookahead():
    merges, _ = bpe.load(bpe.vocabulary_path())
    rng = random.Random(3)
    for _ in range(60):
        word = "".join(rng.choice(["the", "in", "ing", "er", "a", "tion", "x"]) for _ in range(rng.randint(1, 900))).encode()
        encoder, out, at = bpe.WordEncoder(merges), [], 0
        while at < len(word):
            k = rng.randint(1, 200)
            out += encoder.feed(word[at : at + k])
            at += k
            assert len(encoder.rest) < 2 * encoder.step
        assert out + encoder.end() == merges.word(word)


def test_bpe_frames(docs, empty):
    assert bpe.digest_documents(docs).count() == len(ROWS) and bpe.digest_documents(empty).collect() == []
    got = {(r.doc_id, r.text) for r in bpe.encode_documents(docs.where("doc_id = 7")).collect()}
    assert got == {(7, "the cat sat on the mat today")}


def test_token_counts(docs, empty):
    rng = random.Random(2)
    for _ in range(200):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 8))}
        counter = token_counts.PieceCounter(pieces)
        for _ in range(40):
            word = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randint(1, 10)))
            at = n = 0
            while at < len(word):
                end = next((j for j in range(len(word), at, -1) if word[at:j] in pieces), 0)
                at, n = (end, n + 1) if end else (len(word), -n)
                if not end:
                    n = 0
                    break
            assert counter.count(word) == n
    got = {r.doc_id: r for r in token_counts.count_tokens(docs.where("doc_id > 2")).collect()}
    assert got[3].n_tokens == got[4].n_tokens == 0 and got[8].n_words == 20_000 == got[8].n_tokens
    assert token_counts.count_tokens(empty).collect() == []


def plain_fingerprint(text, k=3):
    from xxhash import xxh64_intdigest

    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] or [xxh64_intdigest(b" ".join(w), 42)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_simhash_rows(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(t) for _, t, _ in ROWS]
    near = plain_components(len(ROWS), [(a, b) for a in range(len(ROWS)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    low = {c: min((i for (i, _, _), x in zip(ROWS, near, strict=True) if x == c and i is not None), default=None) for c in near}
    want = [(i, f"{p:016x}", low[c]) for (i, _, _), p, c in zip(ROWS, prints, near, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.one_of_each(docs).columns == docs.columns


def test_vantage_point_shards_find_every_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 1_500).astype(np.uint64)
    points = [base]
    for _ in range(3):
        base = base ^ (np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64))
        points.append(base)
    points = np.unique(np.concatenate(points))
    found = np.arange(len(points))
    homes = 0
    for _, home, query in simhash.route(simhash.build_tree(points[::5], 16), points):
        at = np.concatenate([home, query])
        homes += len(home)
        a, b = simhash.forest(points[home], points[query], block=32)
        components.join(found, at[a], at[b])
    want = np.arange(len(points))
    for k in range(0, len(points), 500):
        a, b = np.nonzero(np.bitwise_count(points[k : k + 500][:, None] ^ points[None, :]) <= 2)
        components.join(want, a + k, b)
    assert homes == len(points) and np.array_equal(simhash._flat(found), simhash._flat(want))


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(50)] + [(200, x) for x in range(201, 260)] + [(7, 7)]
    want = plain_components(300, pairs)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: c for i, c in enumerate(want) if i != c}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_classifier_learns_and_scores(spark, docs, empty):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8)))
    rows = [(i, " ".join(word() + ("!!" if i % 3 == 0 else "") for _ in range(40)), int(i % 3 != 0)) for i in range(300)]
    model = classifier.train([(t, y) for _, t, y in rows[:200]])
    score = model.scorer()
    assert sum((score(t) >= 0.3) == bool(y) for _, t, y in rows[200:]) >= 95
    assert 0 <= score("") <= 1 and classifier.train([]).scorer()("any text") == 0.5
    assert classifier.train([(t, y) for _, t, y in rows[:200]]) == model
    got = classifier.score_documents(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert classifier.score_documents(empty, model).collect() == [] and classifier.accepted_documents(docs, model, 0.0).count() == len(ROWS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 11)] + [(None, 1), (1, None), (2, 5)], "doc_id long, quality int")
    used = classifier.training_rows(docs, labels, most=3)
    held = {i for i in range(11) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert 0 < len(used) <= 8 and not any(t == "the cat sat on the mat today" for t, _ in used if 7 in held)


def test_katz_against_plain_counts(spark, docs, empty):
    rng = random.Random(8)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(3_000)]
    rows = [(i, " ".join(rng.choice(vocabulary).title() if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(250)] + [(None, "w1 w2"), (500, None), (500, "w1"), (500, "w1")]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    texts = [[*words(t), ""] for _, t in rows]
    c1 = Counter(w for t, h in zip(texts, held, strict=True) if not h for w in t)
    c2 = Counter(p for t, h in zip(texts, held, strict=True) if not h for p in zip([" ", *t], t, strict=False))
    n, v = sum(c1.values()), len(c1)
    after = defaultdict(list)
    for (h, w), c in c2.items():
        after[h].append(w)
    d1, d2 = (katz.good_turing([sum(c == k for c in x.values()) for k in range(1, 7)]) for x in (c1, c2))
    d = lambda ds, c: ds[c - 1] if c <= 5 else 1.0
    unknown = 1 - sum(d(d1, c) * c for c in c1.values()) / n
    p1 = lambda w: d(d1, c1[w]) * c1[w] / n if c1[w] else unknown
    model = {}
    for h, ws in after.items():
        kept, whole = sum(d(d2, c2[h, w]) * c2[h, w] for w in ws), sum(c2[h, w] for w in ws)
        whole += kept >= whole
        model[h] = whole, (1 - kept / whole) / (1 - sum(map(p1, ws)))
        seen = sum(d(d2, c2[h, w]) * c2[h, w] / whole for w in ws)
        assert math.isclose(seen + model[h][1] * (sum(p1(w) for w in c1 if w not in ws) + unknown), 1.0)
    want = []
    for (i, _), t, h in zip(rows, texts, held, strict=True):
        pairs = zip([" ", *t], t, strict=False)
        s = sum(math.log10(d(d2, c2[p]) * c2[p] / model[p[0]][0]) if c2[p] else math.log10((model[p[0]][1] if p[0] in model else 1) * p1(p[1])) for p in pairs)
        want.append((str(i), h, len(t), sum(c1[w] > 0 for w in t), n, round(sum(math.log10((c1[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6), round(s, 6)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = katz.score(df, katz.fit(df)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)
    # Documents that the model wasn't fitted on, with words, pairs and histories that it doesn't know.
    other = [(i, " ".join(rng.choice([*vocabulary[:50], "never", "seen"]) for _ in range(rng.randint(0, 30)))) for i in range(1_000, 1_080)] + [(1_100, "never seen"), (1_101, None)]
    got = {r.doc_id: r.score for r in katz.score(spark.createDataFrame(other, "doc_id long, text string"), katz.fit(df)).collect()}
    for i, text in other:
        t = [*words(text), ""]
        pairs = zip([" ", *t], t, strict=False)
        s = sum(math.log10(d(d2, c2[p]) * c2[p] / model[p[0]][0]) if c2[p] else math.log10((model[p[0]][1] if p[0] in model else 1) * p1(p[1])) for p in pairs)
        assert math.isclose(got[i], s, abs_tol=1e-6)
    fitted = katz.fit(docs)
    assert katz.score(docs, fitted).count() == len(ROWS) and katz.score(empty, fitted).collect() == []
    assert katz.score(docs, katz.fit(empty)).where("n_known = 0").count() == len(ROWS)


def test_katz_spreads_hot_words_and_cuts_long_texts(spark, monkeypatch):
    monkeypatch.setattr(katz, "BATCH_TOKENS", 50)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["hot", "hot", "x", f"w{rng.randint(0, 300)}"]) for _ in range(rng.choice([3, 40, 400])))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = katz.fit(df)
    assert katz._hash(b"hot") in model.hot.tolist() and katz._hash(b"w7") not in model.hot.tolist()
    spread = {r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in katz.score(df, model).collect()}
    monkeypatch.setattr(katz, "BATCH_TOKENS", 10_000)
    monkeypatch.setattr(katz, "hot_words", lambda *_: np.empty(0, np.uint64))
    assert spread == {r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in katz.score(df, katz.fit(df)).collect()}


def test_katz_buckets_have_tasks_of_their_own(spark):
    def task(table):
        import pyarrow as pa
        from pyspark import TaskContext

        return pa.table({"task": [TaskContext.get().partitionId()]})

    model = katz.fit(spark.createDataFrame([(i, " ".join(f"w{(i * k) % 997}" for k in range(60))) for i in range(300)], "doc_id long, text string"))
    for table in (model.ngrams, model.histories):
        buckets, tasks = table.count(), [r.task for r in table.groupBy("bucket").applyInArrow(task, "task long").collect()]
        assert buckets == len(tasks) == len(set(tasks)) == katz.LEAST_BUCKETS


def test_katz_evaluates_a_bucket_batch_by_batch(spark, monkeypatch, tmp_path):
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    rng, folder, plain = random.Random(5), str(tmp_path), PandasCogroupedOps.applyInArrow
    df = spark.createDataFrame([(i, " ".join(f"w{rng.randint(0, 50)}" for _ in range(999))) for i in range(400)], "doc_id long, text string").coalesce(1)

    def traced(self, f, schema):
        def run(left, right):
            import tracemalloc
            from pathlib import Path
            from uuid import uuid4

            tracemalloc.start()
            out = f(left, right)
            Path(folder, uuid4().hex).write_text(str(tracemalloc.get_traced_memory()[1]))
            tracemalloc.stop()
            return out

        return plain(self, run, schema)

    monkeypatch.setattr(katz, "LEAST_BUCKETS", 1)
    monkeypatch.setattr(katz, "BATCH_TOKENS", 20_000)
    model = katz.fit(df)
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", traced)
    assert sum(r.n_tokens for r in katz.score(df, model).collect()) == 400_000
    peaks = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert peaks and max(peaks) < 16 * 400_000, peaks  # bytes


def test_html_layout(spark):
    show = html_text.extract
    assert show("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>") == "a     bbb\ncccc  d"
    assert show("<ul><li>x<li>y<ol><li>1<li>2</ol></ul>z") == "- x\n- y\n  1. 1\n  2. 2\n\nz"
    assert show("<p>a<p>b<div hidden>no</div><div style='display: none'>no<p>no</div>c<br>d &amp; <b>e</b>f") == "a\n\nb\n\nc\nd & ef"
    assert show("<head><title>t</title><style>s</style></head><body>x<script>var a='</p>'</script><!-- no --> y<pre> a\n  b</pre>") == "x y\n\n a\n  b"
    assert show("") == "" and show("a < b <") == "a < b <" and show("<div>" * 30_000 + "x") == "x"
    df = spark.createDataFrame([(1, "<p>a", 1), (None, None, 2), (1, "", 3)], "page_id long, html string, id int")
    assert sorted(map(tuple, html_text.extract_text(df).collect()), key=str) == [(1, "", 0), (1, "a", 1), (None, "", 0)]
    assert html_text.extract_text(df.limit(0)).collect() == []


def test_html_shows_every_visible_word():
    rng = random.Random(11)
    for _ in range(150):
        parts, shown, n = [], [], 0
        for _ in range(60):
            tag = rng.choice(["p", "div", "li", "ul", "b", "td", "tr", "table", "h1", "pre", "blockquote", "dd", "/p", "/div", "/ul", "/td", "/table", "/b", "br"])
            parts.append(f"<{tag}>")
            parts.append(f" w{n} ")
            shown.append(f"w{n}")
            n += 1
        assert sorted(html_text.extract("".join(parts)).replace("- ", " ").split()) == sorted(shown)


def test_queries_and_sql_names_match():
    from verbascope.llm import queries

    assert {int(q[2:].split("_")[0]) for q in queries.queries()} == set(range(1, 11)) and set(queries.oracle_sql()) <= set(queries.queries())


def test_pipeline_stages(spark):
    import corpus_pipeline

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    at, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at, stage(spark, at, path).cache()
        assert at.columns == docs.columns, name
        assert at.join(before, "doc_id", "left_anti").count() == 0, name
        sizes.append(at.count())
    texts = [t.translate(AZ) for (t,) in at.select("text").distinct().collect()]
    assert len(texts) == len(set(texts)) and sizes[0] > sizes[1] >= sizes[2] >= sizes[3]
    assert at.groupBy("doc_id").count().where(F.col("count") > 3).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, at, path).count() == at.count()


def plain_sets(text, k=5):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").translate(AZ).encode())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def plain_near(rows):
    """Component of each (id, text), over all pairs with a similarity of 0.8 or more."""
    sets = [plain_sets(t) for _, t in rows]
    return plain_components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))])


def near_rows():
    """Copies with one to four changed words, some on the edge of 0.8; a crowd of copies of copies; a passage that many texts share; short, empty, repeated and null rows."""
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    out, passage = [], text(30)
    for _ in range(40):
        base = text(rng.randint(20, 120))
        out.append(base)
        for _ in range(rng.randint(0, 2)):
            copy = list(base)
            for _ in range(rng.randint(1, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 5000)}"
            out.append(copy)
    chain = text(80)
    for i in range(30):
        chain = list(chain)
        chain[rng.randrange(80)] = f"y{i}"
        out.append(chain)
    out += [text(rng.randint(1, 20)) + passage for _ in range(60)]
    out += [["A"], ["a"], ["a", "b", "c", "d"], [], [" "]]
    rows = [(i, " ".join(t)) for i, t in enumerate(out)]
    rng.shuffle(rows)
    return rows + [rows[0], (None, None), (None, rows[1][1]), (rows[2][0], "other words under an id that repeats"), (None, "no id here at all, not once"), (None, "no id here at all, not once")]


def test_near_copies_finds_every_pair(spark):
    rows = near_rows()
    groups = defaultdict(list)
    for (i, t), c in zip(rows, plain_near(rows), strict=True):
        groups[c].append((i, t))
    assert len(groups) < len(rows) - 40
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    left = Counter()
    for r in got:
        c = next(c for c, g in groups.items() if (r.doc_id, r.text) in g)
        left[c] += 1
        assert r.doc_id == min((i for i, _ in groups[c] if i is not None), default=None)
    assert left == Counter(dict.fromkeys(groups, 1))
    assert simhash.one_of_each(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_mixed_documents_are_what_the_mix_takes(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, i % 25, i]), f"t{i} " * rng.randint(0, 30), rng.choice(["a", "b", "b", "b", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got = Counter(), Counter()
    for r in mixing.mix(df).where("taken > 0").collect():
        want[r.doc_id, r.size] += r.taken // r.size
    for r in mixing.mixed_documents(df).collect():
        got[r.doc_id, len(words(r.text))] += 1
    assert got == want and any(i is None for i, _ in want)


def test_one_row_of_each_group_whatever_the_ids(spark):
    a, near, b = " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(401)), "quite another text with words of its own"
    assert (plain_fingerprint(a) ^ plain_fingerprint(near)).bit_count() <= 2 < (plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count()
    kept = lambda f, rows: sorted(map(tuple, f(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert kept(exact_dedup.keep_one, [(1, "a"), (2, "a"), (1, "b"), (1, "b"), (None, "A"), (None, "c"), (None, "c")]) == [(1, "b"), (2, "a"), (None, "c")]
    assert kept(simhash.one_of_each, [(0, near), (1, a), (1, b), (1, b), (None, "no id"), (None, "no id"), (None, b)]) == [(0, near), (1, b), (None, "no id")]
    assert kept(simhash.one_of_each, []) == []


def test_html_stray_quotes_and_form_text():
    show = html_text.extract
    assert show('<p class="a"">Hello world</p><p class="b">More text</p><p>end</p>') == "Hello world\n\nMore text\n\nend"
    assert show("<div data-n=5'>one two three</div><p four>five</p>") == "one two three\n\nfive"
    assert show("<p title='a > b' x = \"c > d\" y=>shown</p>") == "shown"
    assert show("<head><title>t</title>Hello") == "Hello"
    assert show("<textarea>in a field</textarea> <select><option>one<option>two</select> <svg><text>drawn</text></svg> <math><mi>x</mi></math>").split() == "in a field one two drawn x".split()


def test_parity_bits_never_rule_out_a_similar_pair():
    from verbascope.llm import near_copies

    rng = np.random.default_rng(4)
    for n in (1, 4, 9, 40, 300, 5_000):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.concatenate([rng.permutation(a)[int(n * rng.random() * 0.3) :], rng.integers(0, 2**63, int(n * rng.random() * 0.3)).astype(np.uint64)]))
            x, y = (np.frombuffer(near_copies.parity(s), np.uint8) for s in (a, b))
            fewest = int(near_copies.differing(x, y[None, :])[0])
            assert fewest <= len(np.setxor1d(a, b)) and (not near_copies.similar(a, b) or 9 * fewest <= len(a) + len(b))


class _Layout:
    """Random pages as trees of (kind, children); how each is written, end tags left out where HTML allows it, and how it is shown."""

    def __init__(self, seed):
        self.rng, self.n = random.Random(seed), 0

    def inline(self):
        out = []
        for _ in range(self.rng.randint(1, 4)):
            self.n += 1
            out.append((self.rng.choice(["text", "text", "b", "a", "gone", "script"]), f"w{self.n}"))
        return [*out, ("text", f"e{self.n}")]

    def block(self, depth):
        kinds = ["p", "p", "h2", "gone"] + (["div", "ul", "ol", "blockquote", "table", "unseen"] if depth < 4 else [])
        kind = self.rng.choice(kinds)
        if kind in ("p", "h2"):
            return kind, self.inline()
        if kind == "table":
            return kind, [[(self.inline() if self.rng.random() < 0.8 else self.blocks(depth + 1), self.rng.choice([1, 1, 2])) for _ in range(self.rng.randint(1, 4))] for _ in range(self.rng.randint(1, 3))]
        if kind in ("ul", "ol"):
            return kind, [self.inline() if self.rng.random() < 0.6 else self.blocks(depth + 1) for _ in range(self.rng.randint(1, 3))]
        return kind, self.blocks(depth + 1)

    def blocks(self, depth):
        return [self.block(depth) for _ in range(self.rng.randint(1, 3))]

    def write(self, parts):
        end = lambda tag: self.rng.choice(["", f"</{tag}>"])
        out = []
        for kind, x in parts:
            if kind == "text":
                out.append(f" {x}\n")
            elif kind in ("b", "a"):
                out.append(f"<{kind} class='x'> {x} </{kind}>")
            elif kind == "script":
                out.append(f"<script>var a = '<p>{x}'</script>")
            elif kind == "gone":
                inner = x if isinstance(x, str) else self.write(x)
                out.append(f"<div hidden><div>{inner}</div> lost</div>" if not isinstance(x, str) else f"<span style='color:red; DISPLAY : none'><span>{inner}</span> lost</span>")
            elif kind == "unseen":
                out.append(f"<div style='visibility:hidden'>lost<div style='visibility:visible'>{self.write(x)}</div>lost</div>")
            elif kind in ("p", "h2"):
                out.append(f"<{kind}>{self.write(x)}" + (end("p") if kind == "p" else "</h2>"))
            elif kind in ("ul", "ol"):
                out.append(f"<{kind}>" + "".join(f"<li>{self.write(i)}{end('li')}" for i in x) + f"</{kind}>")
            elif kind == "table":
                rows = "".join("<tr>" + "".join(f"<td colspan={n}>{self.write(c)}{end('td')}" for c, n in row) + end("tr") for row in x)
                out.append(f"<table>{rows}</table>")
            else:
                out.append(f"<{kind}>{self.write(x)}</{kind}>")
        return "".join(out)

    def show(self, parts, in_list=False):
        """[lines before, text, lines after] of each part."""
        out = []
        line = " ".join(x for kind, x in parts if kind in ("text", "b", "a"))
        if line:
            return [[0, line, 0]]
        for kind, x in parts:
            if kind in ("p", "h2"):
                out.append([2, self.joined(self.show(x)), 2])
            elif kind in ("div", "unseen"):
                inner = self.show(x, in_list)
                # Unseen words stand between; they leave their block's edges.
                edges = [1, "", 1]
                out += [edges, *inner, edges]
            elif kind in ("ul", "ol"):
                edge = [1 if in_list else 2, "", 1 if in_list else 2]
                items = []
                for k, i in enumerate(x, 1):
                    text, mark = self.joined(self.show(i, True)), "- " if kind == "ul" else f"{k}. "
                    if text:
                        items.append([1, mark + re.sub(r"\n(?=[^\n])", "\n" + " " * len(mark), text), 1])
                out += [edge, *items, edge]
            elif kind == "blockquote":
                text = self.joined(self.show(x, in_list))
                if text:
                    out.append([2, "  " + re.sub(r"\n(?=[^\n])", "\n  ", text), 2])
            elif kind == "table":
                text = self.table(x, in_list)
                if text:
                    out.append([2, text, 2])
        return out

    def joined(self, chunks):
        out, due = "", 0
        for before, text, after in chunks:
            due = max(due, before)
            if text:
                out += ("\n" * due if out else "") + text
                due = 0
            due = max(due, after)
        return out

    def table(self, rows, in_list):
        grid = []
        for row in rows:
            at, cells = 0, []
            for c, n in row:
                cells.append((at, at + n, self.joined(self.show(c, in_list)).split("\n")))
                at += n
            grid.append(cells)
        grid = [r for r in grid if any(any(c[2]) for c in r)]
        if not grid:
            return ""
        starts = sorted({a for r in grid for a, _, _ in r})
        span = lambda a, b: [s for s in starts if a <= s < b]
        wide = dict.fromkeys(starts, 0)
        for size in range(1, len(starts) + 1):
            for a, b, lines in (c for r in grid for c in r if len(span(c[0], c[1])) == size):
                *first, last = span(a, b)
                wide[last] = max(wide[last], max(map(len, lines)) - sum(wide[s] + 2 for s in first))
        out = []
        for r in grid:
            for k in range(max(len(c[2]) for c in r)):
                line = ""
                for a, b, lines in r:
                    width = sum(wide[s] + 2 for s in span(a, b)) - 2
                    text = lines[k] if k < len(lines) else ""
                    line += (text.ljust(width) if width <= html_text.ALIGN_WIDTH else text) + "  "
                out.append(line.rstrip())
        return "\n".join(out)


def test_html_layout_against_a_plain_renderer():
    for seed in range(400):
        page = _Layout(seed)
        tree = page.blocks(0)
        assert html_text.extract("<!DOCTYPE html><html><head><title>t</title></head><body>" + page.write(tree)) == page.joined(page.show(tree)), seed


def test_html_closes_the_innermost_element():
    show = html_text.extract
    assert show("<div hidden><div>a</div>SECRET</div>") == "" and show('<span style="display:none"><span>a</span>LEAK</span>x') == "x"
    assert show("<ol><li>a<ol><li>b</li></ol></li><li>c</li></ol>") == "1. a\n   1. b\n2. c"
    assert show("<table><tr><td>A<table><tr><td>in</table></td><td>B</td></tr><tr><td>C</td><td>D</td></tr></table>") == "A   B\n\nin\nC   D"
    assert show("<div>a<div>b</div>c</div>d") == "a\nb\nc\nd" and show("<blockquote><p>a</p><p>b</p></blockquote>") == "  a\n\n  b"
    assert show("<details>x<summary>S</summary>y</details>") == "S" and show("<ruby>k<rp>(</rp><rt>r</rt><rp>)</rp></ruby>") == "kr"
    assert show("<table><tr><td rowspan=2>r</td><td>1</td></tr><tr><td>22</td></tr></table>") == "r  1\n   22"
    # Work grows with the page, however it is nested.
    for page in ("<p><button>" + "<div>" * 50_000, "<ul><li>" * 20_000 + "x", "<table><tr><td>" * 20_000 + "x", "<b>" * 20_000 + "<p></i></span></b>" * 20_000):
        assert show(page).strip(" -") in ("", "x")


def test_url_rules_as_a_table(spark):
    rng = random.Random(5)
    hosts, paths = ["com", "net", "a.com", "b.a.com", "org", "x-y.org", "n\xe9t.de"], ["/", "/en/", "/en/7", "/de/a b/", "/e.*/", "/en/7/x"]
    rules = [url_filter.UrlRule(rng.choice(["block", "allow"]), h, p) for h in hosts for p in paths if rng.random() < 0.6]
    urls = [f"http://{rng.choice(['', 'w.', 'my host.'])}{rng.choice(hosts)}{rng.choice(['', *paths, '/en/7/x/y', '/de/'])}{rng.choice(['', '?q', '#f'])}" for _ in range(150)] + [None, "", "http://com/en/"] * 40
    pages = spark.createDataFrame([(i % 100, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(3)
    table = spark.createDataFrame([(r.action, r.host, r.path) for r in rules] + [("block", None, "/")], "action string, host string, path string")
    inline, joined = url_filter.filter_urls(pages, tuple(rules)), url_filter.filter_urls(pages, table)
    assert sorted(map(str, inline.collect())) == sorted(map(str, joined.collect()))
    for r in inline.collect():
        fit = [x for x in rules if (r.host == x.host or r.host.endswith("." + x.host)) and r.path.startswith(x.path)]
        best = min(fit, key=lambda x: (-len(x.text), -len(x.host), x.action != "block", x.text), default=None)
        assert (r.rule, r.verdict) == ((best.text, best.action) if best else (None, "allow"))
    assert url_filter.filter_urls(pages.limit(0), table).collect() == []


def plain_score(text, model):
    """The mean of the margins of all features of all words, one by one."""
    margin, found = np.frombuffer(model.margin), []
    w = re.findall(rb"[^\x20\x09-\x0d]+", text.encode())
    for a, b in zip([None, *w], w, strict=False):
        marked = b"<" + b + b">"
        for x in [marked, *(marked[i : i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1))]:
            found.append(margin[zlib.crc32(x) % classifier.BUCKETS])
        found += [margin[classifier.SAME]] * (classifier.SAME_WEIGHT if a == b else 0)
    return 1 / (1 + math.exp(-(model.bias + (sum(found) / len(found) if found else 0))))


def test_classifier_scores_against_plain_sums(spark, docs):
    rng = random.Random(2)
    rows = [(" ".join(rng.choice(["good", "fine", "bad", "vile", "été"]) + ("x" if y else "!") for _ in range(rng.randint(1, 30))), y) for y in (0, 1) for _ in range(60)]
    model = classifier.train(rows)
    got = {(r.doc_id, round(r.score, 9)) for r in classifier.score_documents(docs.where("doc_id <> 8"), model).collect()}
    assert got == {(i, round(plain_score(t or "", model), 9)) for i, t, _ in ROWS if i not in (8, None)}


def plain_mixed(rows):
    """(id, text) as often as the mix takes them; rows: (id, text, source), ids unique."""
    sizes = {i: len(words(t)) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    weight, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}, Counter()
    for i, _, s in rows:
        total[s] += sizes[i]
    key = lambda i: int(hashlib.md5(f"mix-1|{i}".encode()).hexdigest()[:15], 16)
    items = []
    for k, s in enumerate(sources):
        at = 0
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (key(r[0]), r[0])):
            at += sizes[i]
            items += [((at + p * total[s]) / weight[s], k, key(i), i, t) for p in range(3) if sizes[i]]
    run, out = 0, []
    for _, _, _, i, t in sorted(items):
        run += sizes[i]
        if run > sum(sizes.values()):
            break
        out.append((i, t))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    import tokenizers

    import corpus_pipeline

    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    good = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [good(rng.randint(20, 80)) for _ in range(50)]
    near = [" ".join([*t.split()[:-1], "changed"]) for t in texts[:15]] + [" ".join([*t.split()[:-30], "quite", "changed"]) for t in texts[15:20]]
    junk = [" ".join(f"{rng.choice(vocabulary)}!!$" for _ in range(30)) for _ in range(30)]
    every = [*texts, *near, *[t.upper() for t in texts[:10]], *junk, texts[3], "", None, " \n", "one two"]
    rng.shuffle(every)
    rows = [(i, t, "en", rng.choice(["a", "a", "b", None, "c"]), len(t or "")) for i, t in enumerate(every)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 0 if t in junk else 1, 0) for i, t in enumerate(every) if t and i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    model = classifier.train(sorted_training(rows, labels))
    kept = [(i, t, s) for i, t, _, s, _ in rows if plain_score(t or "", model) >= classifier.THRESHOLD]
    last = {(t or "").translate(AZ): i for i, t, _ in kept}
    kept = [r for r in kept if last[(r[1] or "").translate(AZ)] == r[0]]
    groups = plain_near([(i, t) for i, t, _ in kept])
    least = {c: min(r[0] for r, x in zip(kept, groups, strict=True) if x == c) for c in groups}
    kept = [r for r, c in zip(kept, groups, strict=True) if least[c] == r[0]]
    library = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    want = Counter()
    for i, t in plain_mixed(kept):
        ids = library.encode(t, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and len(want) < len([t for t in every if t and t not in junk]) - 20
    assert not {i for i, *_ in want} & {i for i, t in enumerate(every) if t in junk}


def sorted_training(rows, labels):
    """What classifier.training_rows gives: labelled rows outside fold 0, by id."""
    text = {i: t or "" for i, t, *_ in rows}
    return [(text[i], q) for i, q, _ in sorted(labels) if zlib.crc32(str(i).encode()) % 5]


def test_rows_are_numbered_alike_however_they_are_read(spark, docs, tmp_path):
    from verbascope.llm.common import ROW, numbered

    docs.write.parquet(str(tmp_path / "p"))
    docs.select("doc_id", "text").write.json(str(tmp_path / "j"))
    table = spark.read.parquet(str(tmp_path / "p"))
    rows = numbered(table, "test")
    assert rows.columns == [*table.columns, ROW]
    again = numbered(table, "test").repartition(7).select(ROW, "text")
    assert rows.select(ROW).distinct().count() == len(ROWS) == rows.join(again.withColumnRenamed("text", "other"), ROW).where("text <=> other").count()
    for other in (spark.read.json(str(tmp_path / "j")), table.where("doc_id > 3"), table.limit(0)):
        assert numbered(other, "test").select(ROW).distinct().count() == other.count()


@pytest.mark.parametrize("most_blocks", [None, 1])
def test_counted_rows_give_what_a_join_gives(spark, monkeypatch, most_blocks):
    """Numbers at the edges of blocks and files; with more blocks than allowed by a shuffled join."""
    from verbascope.llm import common

    if most_blocks:
        monkeypatch.setattr(common, "MOST_BLOCKS", most_blocks)
    rng = random.Random(3)
    numbers = [f << common.PLACE_BITS | p for f in (0, 1, 7) for p in (*range(130), 1 << 33)]
    rows = spark.createDataFrame([(str(n), n) for n in numbers], f"`a.b` string, {common.ROW} long")
    want = {n: rng.randint(1, 3) for n in rng.sample(numbers, 200)} | {0: 3, 63: 3, 64: 1}
    counts = spark.createDataFrame(list(want.items()), f"{common.ROW} long, times int")
    got = common.counted_rows(rows, counts, "times", 3, "test").collect()
    assert sorted((r["a.b"], r["times"]) for r in got) == sorted((str(n), t) for n, t in want.items())
    kept = common.rows_in(rows, counts.unionAll(counts), "test")
    assert kept.columns == rows.columns and sorted(r[common.ROW] for r in kept.collect()) == sorted(want)


def test_texts_stay_where_they_are(spark, docs, tmp_path):
    """Keeping one row of equal texts and taking the mix join no texts by a shuffle, however little Spark would broadcast by itself."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stage in (exact_dedup.keep_one, mixing.mixed_documents):
            plan = stage(table)._jdf.queryExecution().sparkPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan, stage
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_task_gives_back_what_the_one_before_held():
    import gc
    import weakref

    from verbascope.llm.common import give_back

    gc.disable()
    try:
        merges, special = bpe.load(bpe.vocabulary_path())
        digester = bpe.Digester(merges, special)
        encoder = bpe.TextEncoder(merges, special, digester.view, digester.part)
        digester.digest(encoder.encode("some words to remember"))
        held = [weakref.ref(encoder), weakref.ref(digester)]
        del digester, encoder
        give_back()
        assert all(x() is None for x in held)
    finally:
        gc.enable()
