"""The language model, language ID, toxicity, decontamination, personal data and near-duplicates."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cuewise.llm import decontamination, hmm, language_id, pii, simhash, toxicity


def model(k=5, seed=3):
    m = hmm.Model([], np.random.default_rng(seed).integers(1, 50, k).astype(float), seed)
    m.move = np.random.default_rng(seed).dirichlet(np.ones(hmm.STATES), hmm.STATES)
    m.start = np.random.default_rng(seed + 1).dirichlet(np.ones(hmm.STATES))
    return m


def test_forward_is_the_sum_over_paths():
    m = model()
    sequences = [np.array(s) for s in ([0], [1, 2], [4, 0, 3], [2, 2, 1])]
    got = hmm.forward(m, sequences)
    for s, log in zip(sequences, got, strict=True):
        total = 0.0
        for path in itertools.product(range(hmm.STATES), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            total += p
        assert log == pytest.approx(math.log10(total), abs=1e-9)


def test_expected_counts_and_ascent():
    m, rng = model(), np.random.default_rng(0)
    sequences = [rng.integers(0, 5, n) for n in (1, 7, 3, 12)]
    counts = hmm.expected_counts(m, sequences)
    tokens = np.bincount(np.concatenate(sequences), minlength=5)
    assert counts[:5].sum(1) == pytest.approx(tokens)
    assert counts[5:-1].sum() == pytest.approx(sum(len(s) - 1 for s in sequences)) and counts[-1].sum() == pytest.approx(4)
    many = [rng.choice(5, 40, p=[0.6, 0.1, 0.1, 0.1, 0.1]) for _ in range(50)]
    before = hmm.forward(m, many).sum()
    for _ in range(3):
        m.update(hmm.expected_counts(m, many))
    assert hmm.forward(m, many).sum() > before


def test_every_round_reads_all_training_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b a b c d c d" if i % 2 else "d c a") for i in range(20)], "doc_id long, text string")
    seen, own = [], hmm._round
    monkeypatch.setattr(hmm, "_round", lambda m, rows: seen.append(rows.count()) or own(m, rows))
    fresh = lambda: hmm.Model([b"a", b"b", b"c", b"d"], np.ones(hmm.TOP + 1 + hmm.TAIL))
    trained = hmm.train(docs, fresh())
    assert set(seen) == {20} and len(seen) == 9
    assert np.ptp(trained.emit[:4], axis=1).min() > 0.001  # the states differ
    assert (hmm.train(docs.limit(0), fresh()).emit == fresh().emit).all()


def test_language_model_counts(spark, small):
    rows = {r["doc_id"]: r for r in hmm.score_documents(small).collect()}
    docs = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b"\n"] for r in small.collect()}
    train = [w for i, ws in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws]
    counts = {}
    for w in train:
        counts[w] = counts.get(w, 0) + 1
    n, v = len(train), len(counts)
    assert rows.keys() == docs.keys()
    for i, ws in docs.items():
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in counts for w in ws), n)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    out = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


@pytest.mark.parametrize("known", [1 << 17, 50])
def test_language_model_scores_against_plain_recursion(spark, small, monkeypatch, known):
    """The whole query's score, with most words looked up and with most words joined, against floats and loops."""
    monkeypatch.setattr(hmm, "KNOWN", known)
    monkeypatch.setattr(hmm, "ROUNDS", 2)
    kept, own = [], hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a: kept.append(own(*a)) or kept[-1])
    docs = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b"\n"] for r in small.collect()}
    scores = {r["doc_id"]: r["score"] for r in hmm.score_documents(small).collect()}
    m = kept[0]
    counts = Counter(w for i, ws in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    number = {w: i for i, w in enumerate(m.top)} | {b"\n": hmm.TOP}
    cls = lambda w: number.get(w, hmm.tail_class(w))
    total, distinct = Counter(), Counter()
    for w, c in counts.items():
        total[cls(w)] += c
        distinct[cls(w)] += 1
    assert len(m.top) == min(hmm.TOP, known, len(counts) - 1)
    for i, ws in sorted(docs.items())[:40]:
        alpha, log = m.start, 0.0
        for w in ws:
            c = cls(w)
            alpha = alpha * m.emit[c]
            inner = 1.0 if c <= hmm.TOP else (counts[w] + 1) / (total[c] + distinct[c] + 1)
            log += math.log10(alpha.sum() * inner)
            alpha = alpha / alpha.sum() @ m.move
        assert scores[i] == pytest.approx(log, rel=1e-9)


def test_segments_don_t_count_as_starts():
    m, rng = model(), np.random.default_rng(1)
    m.move = np.eye(hmm.STATES) * 0.8 + 0.2 / hmm.STATES
    sequences = [rng.integers(0, 5, n) for n in (4, 9, 2)]
    counts = hmm.expected_counts(m, sequences, np.array([True, False, False]))
    assert counts[-1].sum() == pytest.approx(1) and counts[:5].sum() == pytest.approx(15)
    assert hmm.stationary(m.move) @ m.move == pytest.approx(hmm.stationary(m.move))


def test_language_model_edges(edge_docs, no_docs):
    rows = hmm.score_documents(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(r["score"] < 0 for r in rows)
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)] == [1, 1, 1]
    assert hmm.score_documents(no_docs).count() == 0


def test_language_id(spark, small, edge_docs, no_docs):
    truth = {r["doc_id"]: r["lang"] for r in small.collect()}
    rows = [r for r in language_id.identify_languages(small).collect() if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    edges = language_id.identify_languages(edge_docs).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in edges if r["doc_id"] in (3, 4, 5, 8)} == dict.fromkeys((3, 4, 5, 8), "und")
    assert all(0 <= r["score"] <= 1 for r in edges)
    assert language_id.identify_languages(no_docs).count() == 0
    assert {r["doc_id"] for r in language_id.identified_documents(edge_docs).collect()} == {1, 2, None, 7, -9}


def test_documents_stay_where_no_language_is_known(edge_docs):
    unlabelled = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in language_id.identified_documents(unlabelled).collect()} == {1, 2, None, 7, -9}


def naive_bundle(text):
    """Trigrams of the letters between single boundaries, bound letter by letter."""
    letters = [ord(c.lower()[0]) if c.isalpha() else 0 for c in text]
    if not any(letters):
        return None
    padded = [0]
    for x in [*letters, 0]:
        if x or padded[-1]:
            padded.append(x)
    vector = lambda x: language_id.letter_vectors(np.array([x]))[0].astype(int)
    grams = Counter(zip(padded, padded[1:], padded[2:], strict=False))
    return sum((n * np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c) for (a, b, c), n in grams.items()), np.zeros(language_id.DIM, int))


def test_hyperdimensional_bundles(monkeypatch):
    texts = ["Été, no", "", "x", "Ночь и день", "日本 語!", "12", "ab ab ab"]
    want = [naive_bundle(t) for t in texts]
    for table in (1 << 22, 1):
        monkeypatch.setattr(language_id, "TABLE", table)
        got = language_id.bundles([language_id.symbols_of(t) for t in texts])
        assert all((g == (0 if w is None else w)).all() for g, w in zip(got, want, strict=True))
    many = language_id.letter_vectors(np.arange(1, 3000)).astype(int)
    assert len(np.unique(many, axis=0)) == len(many)  # every letter has a vector of its own
    assert abs(many[:500] @ many[500:1000].T).max() < 6 * language_id.DIM**0.5


def test_language_id_against_brute_force(spark, small):
    rows = small.orderBy("doc_id").collect()
    bundle = {r["doc_id"]: naive_bundle(r["text"] or "") for r in rows}
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows}
    names = sorted({r["lang"] for r in rows if r["lang"] and not held[r["doc_id"]]})
    total = {n: np.sum([bundle[r["doc_id"]] for r in rows if r["lang"] == n and not held[r["doc_id"]] and bundle[r["doc_id"]] is not None], axis=0) for n in names}
    for r in language_id.identify_languages(small).collect():
        own = bundle[r["doc_id"]]
        assert r["held_out"] == held[r["doc_id"]]
        if own is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        cosines = {n: own @ total[n] / np.linalg.norm(own) / np.linalg.norm(total[n]) for n in names}
        assert r["lang_pred"] == max(names, key=cosines.get) and abs(r["score"] - max(0, max(cosines.values()))) < 1e-6


def test_documents_of_unlearned_languages_are_rejected(spark, small):
    rng = random.Random(2)
    noise = "".join(rng.choice("qxzjkvwpyh") for _ in range(400))
    rows = [(10**6, "Не только в столице, но и в других городах люди говорят об этом каждый день и каждую ночь", None), (10**6 + 1, noise, "en"), (10**6 + 2, "Zq xk", None), (10**6 + 3, "«» 12", "en")]
    docs = small.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    kept = {r["doc_id"] for r in language_id.identified_documents(docs).collect()}
    clean = {r["doc_id"] for r in small.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert kept & {r[0] for r in rows} == {10**6 + 2} and len(kept & clean) >= 0.99 * len(clean)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_fuzzy_lexicon_against_brute_force():
    rng = random.Random(2)
    terms = {"".join(rng.choice("abc") for _ in range(n)): 1.0 for n in (2, 4, 4, 5, 7, 8, 9, 10)}
    lexicon = toxicity.FuzzyLexicon(terms)
    for _ in range(4000):
        if rng.random() < 0.5:
            word = list(rng.choice(sorted(terms)))
            for _ in range(rng.randrange(4)):
                word[rng.randrange(len(word))] = rng.choice(["", "a", "b", "cc"])
            word = "".join(word)
        else:
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(12)))
        near = [(d, t) for t in terms if (d := levenshtein(word, t)) <= toxicity.edits_for(t)]
        want = min(near)[::-1] if near else None
        assert lexicon.find(word) == want


def toxic_rows(n=300):
    rng = random.Random(1)
    words = ["river", "stone", "apple", "cloud", "table", "green", "house", "paper"]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(40)]
        bad = i % 3 == 0
        if bad:
            text[5], text[20] = rng.sample(["moronic", "worthless", "pathetic", "stupidly"], 2)
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_rows()
    docs += [(1000, "you are pathetlc and w0rthless"), (1001, 'he said "worthless" to the river and the stone, and the apple fell'), (1002, "river stone apple"), (1003, "you worthless pathetic moronic river"), (1004, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score_documents(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [i for i, _ in labels if got[i]["held_out"]]
    assert all(got[i]["predicted"] == labels[i][1] for i in held)
    assert got[1000]["predicted"] == 1 and got[1003]["predicted"] == 1 and got[1002]["predicted"] == 0 and got[1004]["predicted"] == 0
    assert got[1001]["score"] < got[1003]["score"]


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    rows = toxicity.score_documents(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_documents(no_docs, labels).count() == 0
    assert toxicity.score_documents(edge_docs, labels.limit(0)).count() == edge_docs.count()


def test_quotation():
    low = 'she said "what a worthless idea" and left; later he was worthless.'
    first = low.index("worthless")
    second = low.index("worthless", first + 1)
    assert toxicity.quoted(low, first, first + 9) and not toxicity.quoted(low, second, second + 9)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.choice([b"x", b"y", b"z", b"w"]) for _ in range(rng.randrange(1, 70))] for _ in range(2))
        assert decontamination.common_subsequence(a, b) == lcs(a, b)


@pytest.fixture(scope="module")
def leaky(spark):
    """Documents of the smallest table, some with benchmark items planted whole or with words changed."""
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rng, planted = random.Random(6), set()
    for k, (item, text) in enumerate(items[:20]):
        i, old = docs[5 * k]
        words = text.split()
        if k % 2:
            words = [w if rng.random() > 0.08 or n >= len(words) - 6 else "changed" for n, w in enumerate(words)]
        half = len(old.split()) // 2
        docs[5 * k] = (i, " ".join([*old.split()[:half], *words, *old.split()[half:]]))
        planted.add((i, item))
    return docs, items, planted


def test_decontamination(spark, leaky):
    docs, items, planted = leaky
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(frame, bench).collect()}
    clean = lambda t: b" " + b" ".join(decontamination.words_of(t)) + b" "
    whole = {(i, k) for i, text in docs for k, item in items if clean(item) in clean(text)}
    assert whole <= found and len(planted & found) >= 0.9 * len(planted)
    by_lcs = {i: decontamination.words_of(t) for i, t in docs}
    for i, k in found - whole:
        item = decontamination.words_of(dict(items)[k])
        assert lcs(item, by_lcs[i]) >= decontamination.LIKELY * len(item)
    kept = {r["doc_id"] for r in decontamination.clean_documents(frame.withColumn("n", F.lit(1)), bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in found}


def test_decontamination_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "lazy dog"), (4, "lazy dog")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(edge_docs, bench).collect()}
    assert {(1, 1), (2, 1)} <= found and {i for i, _ in found} == {1, 2}
    assert decontamination.clean_documents(edge_docs, bench.limit(0)).count() == edge_docs.count()
    assert decontamination.clean_documents(edge_docs, bench).columns == edge_docs.columns
    assert decontamination.find_leaks(no_docs, bench).count() == 0 == decontamination.clean_documents(no_docs, bench).count()


def test_recall_of_the_latent_search(spark):
    """Items planted whole, or with words changed as the rules allow, against the rules applied without a search."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    idf = decontamination.inverse_frequencies(docs)
    directions = decontamination.latent_directions(docs, idf)
    texts = [w for r in docs.collect() if len(w := decontamination.words_of(r["text"])) > 200]
    words = [w for t in texts[:50] for w in t]
    rng = random.Random(1)
    found = Counter()
    for size in (5, 8, 12, 16, 32):
        for changed in (0, 0.3):
            items, hosts = [], []
            for k in range(40):
                source, host = rng.choice(texts), list(rng.choice(texts))
                a, at = rng.randrange(len(source) - size), rng.randrange(len(host))
                own = source[a : a + size]
                items.append((k, list(own)))
                for i in rng.sample(range(max(0, size - 6)), min(max(0, size - 6), round(size * changed))):
                    own[i] = rng.choice(words)
                hosts.append(host[:at] + own + host[at:])
            index = decontamination.Index(items, directions)
            got = {(r, i) for r, i, *_ in index.matches([b" ".join(h).decode() for h in hosts], decontamination.Features())}
            want = {(k, k) for k in range(40) if size >= 8 and index.verdict(items[k][1], hosts[k]) or size < 8 and not changed}
            found[changed, "want"] += len(want)
            found[changed, "got"] += len(want & got)
    assert found[0, "got"] == found[0, "want"] and found[0.3, "got"] >= 0.9 * found[0.3, "want"] > 0


def naive_base(text):
    digits = lambda t: re.sub("[^0-9]", "", t)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m.group())) <= 15]


def test_base_spans_against_plain_patterns(small):
    rng = random.Random(7)
    texts = [r["text"] or "" for r in small.collect()] + ["".join(rng.choice("ab1234567890..--@@++ ()%é") for _ in range(rng.randrange(80))) for _ in range(5000)]
    for text in texts:
        assert pii.find_spans(text, pii.train_classifier(None))[0] == naive_base(text)


def test_long_runs_take_linear_time():
    for text in ("x" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@" * 100_000):
        pii.find_spans(text, pii.train_classifier(None))


def test_personal_data(spark, edge_docs, no_docs):
    rows = [(i, f"write to user{i}@mail{i % 9}.example.com or call +1 ({200 + i}) 555-{1000 + i} from 10.{i}.0.1") for i in range(60)]
    rows += [(100, "mail: jane.doe (at) example (dot) com"), (101, "phone (212) 555-0123"), (102, "version 1.2.3.456 of 4111 1111 1111 1112"), (103, "4111111111111111 5500005555555559")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[5]["n_email"], got[5]["n_ip"], got[5]["n_card"], got[5]["n_phone"]) == (1, 1, 0, 1)
    assert got[100]["spans"] == "email:6:37" and got[101]["spans"] == "phone:6:20" and got[102]["spans"] == ""
    assert got[103]["n_card"] == 0
    edges = pii.find_personal_data(edge_docs).collect()
    assert len(edges) == edge_docs.count() and {r["spans"] for r in edges} == {""}
    assert pii.find_personal_data(no_docs).count() == 0


def test_written_out_addresses_of_every_form_are_candidates():
    ats, dots = ("(at)", "[at]", "{at}", " at ", " AT ", " (At) "), ("(dot)", "[dot]", "{dot}", " dot ", ".", " [DOT] ", " (dot) ")
    for at, dot in itertools.product(ats, dots):
        text = f"mail john.smith{at}example{dot}com now"
        assert ("email", 5, len(text) - 4) in list(pii.loose_matches(text, {})), text
    texts = ["jane at example (dot) org", "she was at home. The end", "x" * 5000 + " at y", "a at b.cd at e.fg", "café at home.now"]
    for text in texts:
        plain = [m.span() for m in pii._LOOSE["email"].finditer(text)]
        assert [(a, b) for kind, a, b in pii.loose_matches(text, {}) if kind == "email"] == plain


def naive_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(marks):
    """{doc: smallest doc reachable} by comparing all pairs."""
    ids = sorted(marks)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (marks[a] ^ marks[b]).bit_count() <= 3:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_duplicates(small):
    texts = {r["doc_id"]: r["text"] or "" for r in small.collect()}
    marks = {i: naive_simhash(t) for i, t in texts.items()}
    want = naive_components(marks)
    rows = simhash.near_duplicates(small).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{m:016x}", want[i]) for i, m in marks.items()}
    kept = {r["doc_id"] for r in simhash.one_of_each_group(small).collect()}
    assert kept == set(want.values())


def chained_marks(n=400):
    rng = random.Random(8)
    out = set()
    for _ in range(n // 8):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 14)):
            out.add(x)
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)


@pytest.mark.parametrize(("hot", "sample", "leaf"), [(1 << 21, 1 << 18, 64), (100, 600, 4), (100, 1, 10**9)])
def test_links_and_hot_shards(spark, monkeypatch, hot, sample, leaf):
    """With the registered bounds, with shards that are cut again, and with shards that no cut divides."""
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    monkeypatch.setattr(simhash, "LEAF", leaf)
    marks = chained_marks(800)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    links = simhash.fingerprint_links(spark.createDataFrame([(m,) for m in signed], "fp long"))
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    want = naive_components(dict(zip(signed, marks, strict=True)))
    assert {m: roots.get(m, m) for m in signed} == want


def depth(node):
    return 0 if isinstance(node, int) else 1 + max(depth(node[4]), depth(node[5]))


def test_trees_cut_prune_and_copy_the_boundary(spark, small):
    """What the registered query does with the fingerprints of its documents, at its own parameters."""
    marks = np.unique(np.array([naive_simhash(r["text"] or "") for r in small.collect()], np.uint64))
    for half in (0, 1):
        tree = simhash.VantageTree(marks, half)
        leaves = list(tree.lookup(marks))
        assert depth(tree.root) >= 2 and tree.size >= 3
        copies = sum(len(rows) for _, rows in leaves)
        assert len(marks) < copies < 2 * len(marks)  # rows of the boundary are in two leaves
        assert sum(len(rows) ** 2 for _, rows in leaves) < len(marks) ** 2 / 2  # the bound prunes the rest
        mask, radius, vantage, mu, _, _ = tree.root
        far = np.bitwise_count((marks ^ vantage) & mask)
        assert mask == simhash.HALVES[half] and ((far > mu) & (far <= mu + radius)).any()
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").mapInArrow(simhash._fingerprints, "doc_id long, fp long").select("fp").distinct()
    dealt = simhash.deal(big).groupBy("half").agg(F.countDistinct("key").alias("shards"), F.count("*").alias("n")).collect()
    assert len(dealt) == 2 and all(r["n"] >= big.count() for r in dealt)


def test_a_tight_cloud_of_fingerprints_is_divided():
    """Variants of one text, a few bits apart, don't all end in one leaf, and no link is lost."""
    rng = random.Random(4)
    base = rng.getrandbits(64)
    cloud = np.unique(np.array([base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 9))) for _ in range(4000)], np.uint64))
    tree = simhash.VantageTree(cloud, 0)
    leaves = [rows for _, rows in tree.lookup(cloud)]
    met = {tuple(sorted(p)) for half in (0, 1) for _, rows in simhash.VantageTree(cloud, half).lookup(cloud) for i, a in enumerate(rows.tolist()) for p in [(a, b) for b in rows[i + 1 :].tolist()] if (int(cloud[p[0]]) ^ int(cloud[p[1]])).bit_count() <= 3}
    every = {(i, int(j)) for i in range(len(cloud)) for j in np.flatnonzero(np.bitwise_count(cloud ^ cloud[i]) <= 3) if j > i}
    assert max(map(len, leaves)) < 0.6 * len(cloud) and met == every


def test_near_duplicate_edges(edge_docs, no_docs):
    rows = simhash.near_duplicates(edge_docs).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == edge_docs.count()
    assert by_id[3]["fingerprint"] == by_id[4]["fingerprint"] == by_id[5]["fingerprint"] == "0" * 16 and by_id[5]["component_id"] == 3
    assert by_id[2]["component_id"] == 1 and by_id[None]["component_id"] is None
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in simhash.one_of_each_group(edge_docs).collect()) == sorted((i is None, i) for i in (1, 3, 7, 8, -9, None))
    assert simhash.near_duplicates(no_docs).count() == 0 == simhash.one_of_each_group(no_docs).count()


def test_toxic_terms_between_any_white_space():
    lexicon = toxicity.FuzzyLexicon({"moronic": 3.0, "worthless": 2.0})
    matches = toxicity.Matches(lexicon)
    spaced = toxicity.features("they are moronic and worthless", matches)
    for space in "\u00a0\u3000\u0085\u2003\u1680":
        assert (toxicity.features(f"they{space}are{space}moronic{space}and{space}worthless", matches) == spaced).all()
        assert toxicity.features(f"are{space}moronic", matches)[1] == 1
    assert toxicity.tokens_of("A\u00a0b\u3000\tc") == [m.group() for m in toxicity._TOKEN.finditer("a\u00a0b\u3000\tc")] == ["a", "b", "c"]


def planted_texts(n=400):
    """(text, loose spans of personal data): written-out addresses and numbers run together, among look-alikes."""
    rng = random.Random(12)
    out = []
    for i in range(n):
        name, host = f"{rng.choice(['ann', 'bo', 'cy'])}{i}", rng.choice(["mail.com", "post.de", "corp.org"])
        digits = [rng.randrange(10) for _ in range(15)]
        card = "4" + "".join(map(str, digits[1:]))
        card += next(str(d) for d in range(10) if pii.luhn(card + str(d)))
        kind, text, span = rng.choice(
            [
                ("email", "please write to {} today", f"{name} at {host.replace('.', ' dot ')}"),
                ("email", "contact: {} .", f"{name}(at){host}"),
                ("phone", "call my mobile {} now", f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"),
                ("ip", "the server host {} is up", f"10[.]{rng.randrange(255)}[.]{rng.randrange(255)}[.]{rng.randrange(255)}"),
                ("card", "my visa card {} please", f"{card[:4]}/{card[4:8]}/{card[8:12]}/{card[12:]}"),
                (None, "we met at {} for lunch", "noon at the corner. then home"),
                (None, "see section {} of the release", f"{rng.randrange(100, 999)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}"),
                (None, "strict mail {}", f"{name}@{host}"),
            ]
        )
        start = text.index("{}")
        out.append((text.format(span), [(kind, start, start + len(span))] if kind else []))
    return out


def test_added_spans_on_planted_texts(spark):
    planted = planted_texts()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(planted)], "doc_id long, text string").repartition(4)
    rows = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()}
    hits = wanted = false = 0
    for i, (text, spans) in enumerate(planted):
        got = {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in rows[i].split(",") if s)}
        base = set(pii.find_spans(text, pii.train_classifier(None))[0])
        wanted += len(spans)
        hits += sum(any(k == kind and a < b2 and a2 < b for kind, a2, b2 in got) for k, a, b in spans)
        false += not spans and bool(got - base)
    assert hits >= 0.95 * wanted and false <= 0.1 * sum(not s for _, s in planted)


def test_the_classifier_sees_more_than_votes():
    one = pii.span_features("call 200 300 4000 now", "phone", 5, 17, (0, 1, 0, 1, 1, 1))
    other = pii.span_features("x=200.300.4000;", "phone", 2, 14, (0, 1, 0, 1, 1, 1))
    assert one != other and max(one + other) < pii.WIDTH == len(pii.prior_weights()) and set(one[:5]) == set(other[:5])


def test_training_needs_no_order(spark):
    texts = [t for t, _ in planted_texts(120)]
    counted = lambda n: spark.createDataFrame([(t,) for t in texts], "text string").repartition(n).mapInArrow(pii._count_candidates, "kind string, votes array<int>, x array<int>, n long").groupBy("kind", "votes", "x").agg(F.sum("n").alias("n"))
    assert np.allclose(pii.train_classifier(counted(1)), pii.train_classifier(counted(5)), atol=1e-3)


def brute_score(text, model):
    """A toxicity score by comparing each token with each term."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    terms, innocent, near = model.lexicon
    low = (text or "").lower()
    tokens = low.split()
    plain = aside = top = number = 0.0
    for place in re.finditer(r"\S+", low):
        word = place.group().strip(toxicity._EDGES)
        found = min(((d, t) for t in terms if abs(len(t) - len(word)) <= toxicity.edits_for(t) and (d := distance(word, t)) <= toxicity.edits_for(t)), default=None)
        if found is None or (found[0] and word in innocent):
            continue
        weight = (near if found[0] else terms)[found[1]]
        if weight <= toxicity.LEAST:
            continue
        if toxicity.quoted(low, place.start(), place.end()):
            aside += weight
        else:
            number, top, plain = number + 1, max(top, weight), plain + weight
    x = [1, number > 0, math.log1p(plain), math.log1p(100 * number / max(1, len(tokens))), math.log1p(aside), top]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))


def test_toxicity_against_brute_force(spark, small):
    """The whole query: every document's score, from the same learned terms and weights."""
    from cuewise.llm.common import held_out

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = small.select("doc_id", "text", held_out(4).alias("held_out"))
    model = toxicity.learn(rows.where("not held_out").select("doc_id", "text"), labels.where(~held_out(4)).select("doc_id", "toxic"))
    got = {r["doc_id"]: r for r in toxicity.score_documents(small, labels).collect()}
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    assert len(got) == len(texts) and model.lexicon[0]
    for i, text in texts.items():
        if len(text or "") < 20_000 or got[i]["predicted"]:
            assert got[i]["score"] == pytest.approx(brute_score(text, model), abs=1e-9), i
