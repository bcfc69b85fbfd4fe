"""The ten operators on edge cases and against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wordloom.llm import capfilter, ctw, decontaminate, language, licenses, maintext, packing, repeats, secrets, simhash
from wordloom.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def _corpus():
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 6))) for _ in range(300)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 120))) for _ in range(40)]
    texts += [texts[1], texts[1], texts[2] + " tail", "x " + texts[3], None, "", " \t\n", "One", "Two Words", "Été a  B\u000bc"]
    shared = " ".join(rng.choices(vocab, k=30))
    texts += [f"{a} {shared} {b}" for a, b in zip(vocab[:8], vocab[8:16])]
    texts += [" ".join(rng.choices(vocab, k=30_000))]
    return list(enumerate(texts))


CORPUS = _corpus()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, ["en", "fr"][i % 2], "src", 0) for i, t in CORPUS], DOCS)
    # further columns whose names the operators use inside
    return df.withColumn("id", df.doc_id).withColumn("score", df.doc_id).withColumn("spans", df.doc_id).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    for few in (0, 10_000):  # by rounds, and by one task
        got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
        assert {got[i] for i in range(41)} == {0} and {got[k] for k in range(100, 160)} == {100} and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_secrets_base_spans_match_python(spark, empty):
    key = "A3T5X9" * 4
    texts = [None, "", 'pass PassWord: "abcdefgh1" x', "token=secret:abcdefgh12", "api_key==abcdefgh", "AKIA" + key + " AKIA12", "é\U0001f600 " + "0a1b2c3d" * 5, "secret=short token = longenough_1", "x" * 100_000 + " token=abcdefgh"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2])]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", secrets.digest(secrets.F.filter("spans", lambda s: s["kind"] < 3)).alias("d")).collect()
    assign = re.compile(r"""((?:(?i:password|passwd|secret|token)|(?i:api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    for doc, got in found:
        text = texts[doc] or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
        assert got == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    assert len(found) == len(rows)
    assert secrets.scan(empty).count() == 0


def test_secrets_add_random_tokens_and_leave_words(spark):
    rng = random.Random(2)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted = ["".join(rng.choices(chars, k=40)) for _ in range(5)]
    words = ["internationalisationofeverything", "thereforeandthereafteragain", "considerationsnotwithstanding"]
    rows = [(i, f"plain {rng.choice(words)} text {planted[i] if i < 5 else ''}") for i in range(60)]
    out = secrets.masked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in out:
        assert ("[SECRET]" in r.text) == (r.doc_id < 5)
        assert any(w in r.text for w in words)


def test_cap_filters_match_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 32))
    near = base[:20] + rng.normal(size=(20, 32)) * 0.15
    hot = base[0] + rng.normal(size=(50, 32)) * 0.1
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near, hot]))]
    n = len(rows)
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, None), (n + 3, []), (n + 4, [0.0] * 32), (n + 5, [float("nan")] * 32), (n + 6, [1.0, None]), (n + 7, [float("inf"), 1.0]), (n + 8, [2.0, 0.0]), (n + 9, [5.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    links = Counter()
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def sound(v):
        return bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = rows[a][1], rows[b][1]
        if sound(x) and sound(y) and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
            links[a] += 1
            links[b] += 1
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    for block in (1500, 7):
        got = capfilter.near_duplicates(df, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_links, r.component_id, r.kept) == (links[r.id], root(r.id), root(r.id) == r.id), (block, r)
    assert capfilter.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_cap_filters_recall_at_the_limit():
    """Pairs at cosine 0.9 exactly meet in a filter, and their sign bits are near, among 1e4 and 1e6 rows."""
    rng = np.random.default_rng(1)
    for rows, pairs in ((10_000, 2000), (1_000_000, 400)):
        a = capfilter.unit(rng.normal(size=(pairs, 64)))
        other = rng.normal(size=(pairs, 64))
        other = capfilter.unit(other - (other * a).sum(axis=1, keepdims=True) * a)
        b = 0.9 * a + math.sqrt(1 - 0.81) * other
        cap, words = capfilter.parameters(rows)
        sets = [set(zip(*map(np.ndarray.tolist, capfilter.decode(v, words, cap)))) for v in (a, b)]
        met = len({row for row, _ in sets[0] & sets[1]}) / pairs
        far = ((a @ capfilter._signs(64) > 0) != (b @ capfilter._signs(64) > 0)).sum(axis=1)
        assert met >= 0.95 and (far <= capfilter.FAR).all(), (rows, met)


def test_cap_decoding_finds_every_filter_above_the_cap():
    v = capfilter.unit(np.random.default_rng(2).normal(size=(30, 10)))
    first, second = capfilter.codes(10, 12)
    score = (v[:, :5] @ first.T)[:, :, None] + (v[:, 5:] @ second.T)[:, None, :]
    row, found = capfilter.decode(v, 12, 1.0)
    for k in range(30):
        above = set(np.flatnonzero((score[k] / math.sqrt(2)).ravel() >= 1.0 / math.sqrt(10)).tolist())
        got = set(found[row == k].tolist())
        assert got == above if len(above) >= 11 else above <= got


def test_simhash_links_match_brute_force(spark, docs, empty):
    text = dict(CORPUS)
    fps = {i: simhash.fingerprint(t) for i, t in text.items()}
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    for limit in (64, 2):
        got = simhash.near_duplicates(docs, bucket_limit=limit).collect()
        assert {r.id: r.component_id for r in got} == {i: root(i) for i in fps} and len(got) == len(CORPUS)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_large_bucket_keeps_every_link(spark):
    rng = np.random.default_rng(8)
    values = {0}
    for _ in range(400):  # a walk of one- and two-bit steps, all in a few buckets
        values.add(int(rng.choice(sorted(values))) ^ (1 << int(rng.integers(24))) ^ (1 << int(rng.integers(24))))
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    chosen = [(list(range(22)), 0), (list(range(22, 43)), 0), (list(range(43, 64)), 0)]
    got = {r.id: r.component_id for r in components(simhash.links(nodes, chosen, 16)).collect()}
    assert {got.get(v) for v in values} == {0}


def test_simhash_plan_is_complete():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 2**63, size=2000, dtype=np.uint64)
    for rows in (10, 10**6, 10**11):
        chosen = simhash.plan(sample, rows)
        for _ in range(300):
            flips = rng.choice(64, size=2, replace=False)
            assert any(sum(b in bits for b in flips) <= t for bits, t in chosen)


def test_language_learns_and_defines_edges(spark, empty):
    rng = random.Random(1)
    words = {"en": ["the", "and", "thing", "with"], "de": ["der", "und", "nicht", "schön"]}
    rows = [(i, " ".join(rng.choices(words[l], k=30)), l, "s", 0) for i, l in enumerate(["en", "de"] * 30)]
    tagger = language.train(spark.createDataFrame(rows, DOCS))
    asked = [(0, "the thing and the"), (1, "und der nicht"), (2, None), (3, "123 --"), (4, ""), (5, "the and thing the " * 20 + "der und"), (5, "the and thing the " * 20 + "der und"), (6, "the " * 50_000)]
    got = language.predict(spark.createDataFrame(asked, "doc_id long, text string"), tagger).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)] == ["en", "de", "und", "und", "und", "en", "en", "en"]
    assert all(0 <= r.score <= 1 for r in got)
    none = language.train(empty)
    assert language.predict(spark.createDataFrame(asked, "doc_id long, text string"), none).where("lang_pred = 'und'").count() == len(asked)
    assert language.predict(empty, tagger).count() == 0


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(2)
    trans, scores = rng.normal(size=(3, 3)), rng.normal(size=(7, 3))
    start = np.array([1, 0, 0, 0, 1, 0, 0], bool)
    got = language.posteriors(scores, trans, start, np.append(start[1:], True))
    want = np.zeros((7, 3))
    for a, b in ((0, 4), (4, 7)):
        total = 0.0
        for path in itertools.product(range(3), repeat=b - a):
            w = math.exp(sum(scores[a + t, y] for t, y in enumerate(path)) + sum(trans[x, y] for x, y in zip(path, path[1:])))
            total += w
            for t, y in enumerate(path):
                want[a + t, y] += w
        want[a:b] /= total
    assert np.allclose(got, want)


def test_packing_is_gapless_and_round_trips(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(packing.pieces(docs), per_salt=5).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in [*CORPUS, ]:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        own = sorted(by[i], key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(own):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(packing.pieces(empty)).count() == 0


def test_packing_special_token_text_follows_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    for text in ("a <|endoftext|> b", "it's  12 é\n\n x"):
        assert packing._encoder(path)(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_plan_fills_like_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(30):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(1, 60))]
        slots, used = packing.plan(Counter(lengths), 50)
        room = []
        for n in sorted(lengths, reverse=True):
            fit = min((r for r in room if r >= n), default=None)
            if fit is None:
                room.append(50 - n)
            else:
                room.remove(fit)
                room.append(fit - n)
        assert used == len(room) and sum(int(s[2]) for s in slots) == len(lengths)


def test_main_text(spark):
    page = "<html><head><title>t</title></head><body><header>Site</header><nav><a href=x>Menu</a></nav><div class='cookie-notice'>We use cookies.</div><article><h1>A &amp; B</h1><p>First  paragraph\nof the story, long enough.<p><b>Second one.<br>More.</article><div id=comments><p>Nice article, I really liked to read it.</p></div><aside>More</aside><form><p>Join</p></form><footer>end</footer>"
    want = "A & B\n\nFirst paragraph of the story, long enough.\n\nSecond one. More."
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "", ""), (4, "v", "<p <<< a='b"), (5, "w", "<script>if (a < b) x()</script>"), (6, "x", "<article>" + "<p>Word word word word.</p>" * 3000)]
    got = {r.page_id: r for r in maintext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == want and got[1].n_chars == len(want)
    assert got[2].text == got[3].text == got[5].text == "" and got[6].text.count("\n\n") == 2999


def test_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 7)
        cost = [rng.uniform(-2, 2) for _ in range(n)]
        joins = [(i, i + 1, rng.uniform(0, 2)) for i in range(n - 1)] + [(i, j, rng.random()) for i in range(n) for j in range(i + 2, n) if rng.random() < 0.3]
        energy = lambda side: sum(max(c, 0) if not s else max(-c, 0) for c, s in zip(cost, side)) + sum(w for a, b, w in joins if side[a] != side[b])  # noqa: B023, E731
        assert abs(energy(maintext.labels(cost, joins)) - min(map(energy, itertools.product([False, True], repeat=n)))) < 1e-9


def test_repeats_match_brute_force(docs, empty):
    words = {i: SPLIT.findall(t or "") for i, t in CORPUS}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    got = {r.doc_id: r for r in repeats.dedup(docs).collect()}
    assert set(got) == set(words)
    removed = 0
    for i, own in words.items():
        gone = [False] * len(own)
        for k in range(len(own) - 12):
            if first[tuple(own[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(w for w, g in zip(own, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
        removed += sum(gone)
    assert removed > 200
    assert repeats.dedup(empty).count() == 0


def test_licenses(spark, empty):
    texts = [None, "", "Released under the MIT License.", "GNU General Public\nLicense, version 3 and the Apache License", "cc-by 4.0 CC BY-NC", "no licence", "mit mit license mit license", "x " * 40_000 + "Apache License, Version 2.0"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].base_labels) == (5, 1, 3, "mit")
    assert (got[3].base_labels, got[3].labels, got[3].first_word, got[3].last_word) == ("apache,gpl", "apache,gpl,gpl-3.0", 0, 8)
    assert (got[4].n_base, got[4].labels) == (2, "cc-by,cc-by-nc")
    assert (got[6].n_base, got[6].first_word, got[6].last_word) == (2, 1, 3)
    assert got[7].labels == "apache,apache-2.0" and got[7].n_words == 40_005
    assert all(got[i].score == 0 and got[i].first_word is None for i in (0, 1, 5))
    assert licenses.scan(empty).count() == 0


def test_licence_texts_whole_edited_and_cut(spark):
    texts, rng = {label: text.split() for label, _, text in licenses.TEXTS}, random.Random(3)
    rows, want = [], {}
    for label, words in texts.items():
        phrase = next(p for name, p, _ in licenses.TEXTS if name == label)
        at = next(i for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        fixed = range(at, at + len(phrase.split()))
        edited = [w if i in fixed or rng.random() > 0.15 else "edited" for i, w in enumerate(words)]
        for made, there in ((words, True), (edited, True), (words[:at] + words[fixed[-1] :], False), (phrase.split(), len(phrase.split()) > 0.9 * len(words))):
            want[len(rows)] = (label, there)
            rows.append((len(rows), "Some words before. " + " ".join(made).upper() + ", and after."))
    rows += [(1000, " ".join(texts["mit-text"][3:])), (1001, "mit license, nothing else")]  # a file may begin inside a text
    rows += [(2000 + i, f"ordinary words of document {i} and no licence") for i in range(100)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, (label, there) in want.items():
        assert (label in got[doc].labels.split(",")) == there, (doc, label, got[doc])
    assert "mit-text" in got[1000].labels and got[1000].score > got[1001].score > 0
    assert got[0].score >= got[1].score and all(got[2000 + i].score == 0 for i in range(100))


def test_ctw_base_and_model(docs, spark, empty):
    held = ctw.fold("doc_id") % 7 == 2
    got = ctw.score(docs, ctw.learn(docs.where(~held))).collect()
    token = {i: [*SPLIT.findall((t or "").translate(LOW)), None] for i, t in CORPUS}
    counts = Counter(w for i, own in token.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in own)
    total = sum(counts.values())
    assert len(got) == len(CORPUS)
    for r in got:
        own = token[r.doc_id]
        want = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert math.isclose(r.base_score, want, rel_tol=1e-9) and r.score < 0
    nothing = ctw.score(docs, ctw.learn(empty)).where("doc_id = 45").first()
    assert math.isclose(nothing.score, 8 * (len((CORPUS[45][1] or "").encode()) + 1) * math.log10(0.5), rel_tol=1e-5)
    assert ctw.score(empty, ctw.learn(docs)).count() == 0


def test_ctw_tables_are_distributions_and_weights_match_recursion():
    texts = [b"abracadabra", b"abcabcabc", b"zz"]
    keys, n = np.unique(ctw._grams(texts, 2), return_counts=True)
    levels = []
    for d in range(3):
        own, at = np.unique(keys & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        levels.append((own, np.bincount(at, weights=n).astype(np.int64)))
    model = ctw.Model(levels)
    assert np.allclose((10.0 ** model.table.astype(np.float64)).sum(axis=1), 1, atol=1e-5)
    # the first decision of a byte, by the recursion on explicit counts
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)
    seen = Counter()
    for t in texts:
        data = b"\0\0" + t + b"\0"
        for i in range(2, len(data)):
            for c in (b"", data[i - 1 : i], data[i - 2 : i]):
                seen[c, data[i] >> 7] += 1
    pair = lambda c: (seen[c, 0], seen[c, 1])
    deep = {c for c, _ in seen if len(c) == 2}
    w1 = {c: math.log(0.5 * math.exp(kt(*pair(c))) + 0.5 * math.exp(sum(kt(*pair(x)) for x in deep if x[1:] == c))) for c, _ in seen if len(c) == 1}
    w0 = math.log(0.5 * math.exp(kt(*pair(b""))) + 0.5 * math.exp(sum(w1.values())))
    p = [(pair(c)[0] + 0.5) / (sum(pair(c)) + 1) for c in (b"", b"b", b"ab")]
    s0, s1 = 0.5 * math.exp(kt(*pair(b"")) - w0), 0.5 * math.exp(kt(*pair(b"b")) - w1[b"b"])
    want = s0 * p[0] + (1 - s0) * (s1 * p[1] + (1 - s1) * p[2])
    row = model.child[model.child[0, ord("b")], ord("a")]
    assert math.isclose((10.0 ** model.table[row].astype(np.float64))[:128].sum(), want, rel_tol=1e-5)


def test_ctw_every_context_has_a_node(spark):
    rng = random.Random(8)
    texts = 2 * ["".join(rng.choices("abcdefghijklmnopqrst", k=300)) for _ in range(150)]  # four letters tell the next, over 2**14 times
    held = ["".join(rng.choices("abcdefghij", k=80)) for _ in range(10)] + [None, "é"]
    keys, n = np.unique(ctw._grams([t.encode() for t in texts], ctw.DEPTH), return_counts=True)
    levels = []
    for d in range(ctw.DEPTH + 1):
        own, at = np.unique(keys & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        levels.append((own, np.bincount(at, weights=n).astype(np.int64)))
    assert len(np.unique(keys >> 8)) > 1 << 14
    model = ctw.Model(levels)
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = spark.createDataFrame(list(enumerate([*texts[:10], *held])), "doc_id long, text string")
    got = {r.doc_id: r.score for r in ctw.score(docs, ctw.learn(train)).collect()}
    want = model.log10([(t or "").encode() for t in [*texts[:10], *held]])
    assert len(got) == len(want) and all(math.isclose(got[i], w, rel_tol=1e-4) for i, w in enumerate(want))


def test_decontamination_finds_edited_copies(spark, empty):
    rng = random.Random(6)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(400)]
    items = [(k, " ".join(rng.choices(vocab, k=n))) for k, n in enumerate((40, 25, 12, 8, 5))]
    rows = []
    for k, text in items:
        own = text.split()
        edits = int(0.2 * len(own))
        changed = list(own)
        for at in rng.sample(range(len(own)), edits):
            changed[at] = "changed"
        rows.append((k, " ".join(rng.choices(vocab, k=300)) + " " + " ".join(changed) + " " + " ".join(rng.choices(vocab, k=50))))
        rows.append((100 + k, " ".join(rng.choices(vocab, k=300))))
        rows.append((200 + k, text.upper().replace(" ", ", ")))
    rows += [(300, None), (301, ""), (302, "word " * 50_000)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items, (9, None), (10, "")], "item_id long, text string")
    for size in (8_000_000, 10):
        got = {(r.doc_id, r.item_id) for r in decontaminate.find(d, b, block_bytes=size).collect()}
        assert got == {(k, k) for k, _ in items} | {(200 + k, k) for k, _ in items}
    clean = {r.doc_id for r in decontaminate.clean(d, b).collect()}
    assert clean == {100 + k for k, _ in items} | {300, 301, 302}
    assert decontaminate.find(empty, b).count() == 0 and decontaminate.find(d, b.where("item_id < 0")).count() == 0


def test_repeats_of_rows_that_share_an_id(spark):
    words = [f"w{k}" for k in range(90)]
    rows = [(1, " ".join(words[:60])), (5, " ".join([*(f"a{k}" for k in range(9)), *words[:30]])), (5, " ".join([*words[30:60], "end"])), (None, " ".join(words[:60]))]
    got = {(r.doc_id, r.n_words, r.n_removed) for r in repeats.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 60, 0), (5, 39, 30), (5, 31, 30), (None, 60, 0)}


def test_a_flush_settles_only_what_is_hot(monkeypatch):
    h = np.array([7, 7, 8, 8, 9, 9, 9, 10], dtype=np.uint64)
    d = np.array([1, 2, 1, 2, 4, 4, 4, 5])
    order, settled, on, anchors = repeats._settled(h, d, np.array([0, 1, 0, 0, 1, 1, 1, 1], dtype=bool))
    assert settled.tolist() == [True, True] + [False] * 6 and on.tolist() == [True, False] + [True] * 6 and anchors[0]


def test_letters_are_category_l():
    assert language.core("½²_3é'A") == "éa" and language.core("½ ²") == ""
    assert len(set(language.features("wa") + language.features("a"))) == len(set(language.features("wa"))) + len(set(language.features("a")) - set(language.features("wa")))
    assert "wa" not in language.features("wa")[1:]


def test_the_cut_moves_blocks_with_little_evidence():
    page = "<article><p>" + "A long sentence of the story, with many words in it. " * 3 + "</p><li><a href=x>See this</a></li><p>" + "Another long sentence of the story with words. " * 3 + "</p></article><div class=sidebar><p>Lines of the sidebar that are long enough to look like prose.</p></div>"
    found = maintext.blocks(page)
    own = [maintext.weight(b) for b in found]
    assert maintext.labels(own, maintext.edges(found)) == [True, True, True, False]
    alone = maintext.labels([*own[:1], -0.9, *own[2:]], maintext.edges(found))
    assert alone == [True, True, True, False] and maintext.labels([own[0], -0.9, own[2], own[3]], []) == [True, False, True, False]


def test_very_long_white_space_has_the_librarys_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, library = packing._encoder(path), Tokenizer.from_file(path)
    for text in (" " * 400_000, "a" + "\n" * 200_000 + "b", "x" * 30_000, "<|endoftext|> a", "é​   ퟿ 𐍈", "1" * 9999 + " \t\r\n"):
        assert list(encode(text)) == library.encode(text, add_special_tokens=False).ids
