"""The training-data operators against brute force on a small table with odd rows."""

import collections
import hashlib
import math
import pathlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from lodestar.llm import chat, decontaminate, langid, linededup, mixing, prefixhash, repeats, simhash, suffixtree, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string"


def made_docs():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = line(120)
    texts = []
    for i in range(60):
        texts.append("\n".join(line(rng.randint(1, 25)) for _ in range(rng.randint(1, 8))))
    texts += [texts[3], texts[3], texts[4] + "\n" + texts[5], texts[7].replace(" ", "  ", 3), texts[8] + " extra", texts[9].upper()]
    words = texts[10].split(" ")
    texts.append(" ".join([*words[:-1], "changed"]))
    texts += [passage, line(9) + " " + passage + " " + line(11), "pre" + passage[:450] + "post", passage[30:] + "é" + passage]
    texts += ["", None, "   \n\n ", "x", "ab " * 300, "éß漢字 " * 40, "\U0001f600" * 7, "a" * 900, line(3000)]
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}" if i % 7 else None, i, "clash") for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "src1", 0, "clash"), (None, "null id one two three", None, None, None, None), (None, None, None, None, None, None), (5, "same id, other text", "en", "src0", 1, "x"), (6, texts[6], "en", "src2", 6, "clash")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return made_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def count(items):
    return collections.Counter(items)


def test_simhash_matches_brute_force(docs, empty, rows):
    def fp(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fps = [fp(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = count((r[0], f"{fps[i]:016x}", least.get(find(i))) for i, r in enumerate(rows))
    assert count(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_shards_lose_no_link():
    rng = random.Random(1)
    masks = simhash.shard_masks(2)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 2):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_lines_match_brute_force(docs, empty, rows):
    def tie(t):
        return int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=4).digest(), "little")

    lines = []
    for r in rows:
        for k, x in enumerate((r[1] or "").encode().split(b"\n")):
            lines.append(((-(1 << 63) if r[0] is None else r[0]), tie(r[1]), k, frozenset(x.lower().split()), r))
    lines.sort(key=lambda x: x[:3])
    gone = collections.defaultdict(set)
    for j, b in enumerate(lines):
        for a in lines[:j]:
            both = len(a[3] & b[3])
            if b[3] and both >= 0.8 * len(a[3] | b[3]) - 1e-9:
                gone[j] = True
                break
    kept = collections.defaultdict(list)
    for j, x in enumerate(lines):
        if j not in gone:
            kept[x[0]].append(x[3])
    out = linededup.dedup(docs)
    assert out.schema == docs.schema
    got = collections.defaultdict(list)
    for r in out.collect():
        for x in (r.text or "").encode().split(b"\n"):
            got[-(1 << 63) if r.doc_id is None else r.doc_id].append(frozenset(x.lower().split()))
    drop = lambda d: {k: count(x for x in v if x) for k, v in d.items() if any(v)}
    assert drop(got) == drop(kept)
    assert linededup.dedup(empty).count() == 0
    report = linededup.dedup(docs, report=True)
    assert report.count() == len(rows) and report.agg({"n_removed": "sum"}).first()[0] == len(gone)


def test_near_lines_are_removed_and_clean_ones_stay(spark):
    base = [f"word{i} and{i} some{i} other{i} text{i} here{i} is{i} long{i} enough{i} now{i}" for i in range(40)]
    near = [x.replace("some", "SOME") for x in base[:10]] + [x + " more" for x in base[10:20]]
    table = spark.createDataFrame([(0, "\n".join(base)), (1, "\n".join(near)), (2, "another line altogether")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in linededup.dedup(table, report=True).collect()}
    assert got == {0: 0, 1: 20, 2: 0}


def test_language_learns_and_marks_texts_without_letters(spark, empty):
    rng = random.Random(0)
    sounds = {"en": ["th", "e", "ing", "and", "er"], "de": ["sch", "ei", "ung", "der", "ü"], "fr": ["eau", "é", "tion", "que", "oi"]}
    rows = [(i, " ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(30)), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "12 + 3 = ###", "fr"), (None, rows[0][1], None), (0, rows[0][1], "en")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == lang for i, _, lang in rows[:180])
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert langid.identify(empty).count() == 0


def test_languages_share_families_and_inner_machines_part_them(spark):
    import numpy as np

    rng = random.Random(1)
    common = {"north": ["sk", "en", "et"], "south": ["ci", "on", "os"]}
    own = {"n1": ("north", ["ø", "ae"]), "n2": ("north", ["ä", "ö"]), "s1": ("south", ["ñ", "ll"]), "s2": ("south", ["ão", "lh"])}
    langs = [x for x in own for _ in range(60)]
    texts = [" ".join("".join(rng.choices(common[own[x][0]] * 2 + own[x][1], k=3)) for _ in range(30)).encode() for x in langs]
    x = langid.features(texts)
    model = langid.LanguageModel(x[::2], langs[::2], np.array([langid.bins(t) for t in texts[::2]]), spark)
    assert sorted(sorted(model.langs[i] for i in f) for f in model.families) == [["n1", "n2"], ["s1", "s2"]]
    assert len(model.top) == 1 and [len(m) for m in model.inner] == [1, 1]
    assert np.mean(np.array(model.predict(x[1::2])[0]) == np.array(langs[1::2])) > 0.95
    here = langid.LanguageModel(x[::2], langs[::2])
    assert here.predict(x[1::2])[0] == model.predict(x[1::2])[0]
    noise = "".join(rng.choice("bcdfghjkmpqrstvwxz ") for _ in range(300)).encode()
    assert all(model.belongs(t) for t in texts[1::2]) and not model.belongs(noise) and not model.belongs("漢字仮名交じり文".encode() * 5)


@pytest.mark.skipif(not pathlib.Path("/root/testdata/sf0.01").exists(), reason="needs the driver's tables")
def test_families_on_the_drivers_languages(spark):
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), per_language=100)
    assert max(map(len, model.families)) >= 2 and any(model.inner)


def test_training_rows_stay_small_on_the_driver(spark):
    """2000 rows of 4096 bins, twice, are 33 MB even as half floats; the driver never has them all unpacked."""
    import tracemalloc

    rng = random.Random(3)
    langs = ["aa", "bb", "cc", "dd"]
    rows = [(i, " ".join("".join(rng.choices(langs[i % 4] + "xyz", k=5)) for _ in range(300)), langs[i % 4]) for i in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    try:
        model = langid.fit(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.langs == langs and model.predict(langid.features([r[1].encode() for r in rows]))[0] == [r[2] for r in rows]
    assert peak < 33e6


def test_packed_training_rows_give_the_same_model():
    import numpy as np

    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdef"[i % 3 :] + " ", k=200)).encode() for i in range(90)]
    langs = ["xyz"[i % 3] for i in range(90)]
    x, n = langid.features(texts).astype(np.float16), np.array([langid.bins(t) for t in texts])
    plain = langid.LanguageModel(x.astype(np.float32), langs, n.astype(np.float32))
    small = langid.LanguageModel([langid.packed(r) for r in x], langs, [langid.packed(r) for r in n])
    assert small.families == plain.families and (small.log_share == plain.log_share).all()
    for a, b in zip([*small.top, *sum(small.inner, [])], [*plain.top, *sum(plain.inner, [])], strict=True):
        assert a[:2] == b[:2] and (a[2] == b[2]).all() and a[3] == b[3]


def test_toxicity_learns_and_is_exact(spark, empty):
    import numpy as np

    rng = random.Random(0)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        toxic = int(i % 4 == 0)
        text = [rng.choice(words) for _ in range(40)] + ([rng.choice(["vile", "scum", "Trash!"]) for _ in range(2)] if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, 0, toxic))
    rows += [(1000, None), (1001, ""), (None, "x"), (5, rows[5][1])]
    labels += [(None, 0, 1), (2000, 0, 1), (7, None, None), (5, 0, labels[5][2])]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held) > 20
    g = np.random.default_rng(0)
    v = np.abs(g.normal(size=(500, 60))) * (g.random((500, 60)) < np.where(np.arange(60) < 6, 0.7, 0.05))
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    row, term = np.nonzero(v[:400])
    index = toxicity.BlockMaxIndex(row, term, v[row, term], 400, 60)
    assert 0 < len(index.table) < 60 and index.blocks > 2
    row, term = np.nonzero(v[400:])
    for q, ids, sims in zip(v[400:], *index.all_nearest(row, term, v[400:][row, term], 100, 7)):
        cosines = v[:400] @ q
        want = np.sort(cosines[cosines > 1e-6])[::-1][:7]
        ids, sims = ids[ids >= 0], sims[ids >= 0]
        assert len(ids) == len(want) and np.allclose(sims, want, atol=1e-5) and np.allclose(cosines[ids], sims, atol=1e-5)
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score == 0 for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), no_labels).collect())


def test_toxicity_scores_match_brute_force(spark):
    """The whole score again, with dense vectors over all terms and all examples."""
    import numpy as np

    from lodestar.llm import textops

    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(300, rows[1][1]), (301, "long " * 50_000 + "a1 b2")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int("a1" in t)) for i, t in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs.withColumn("held_out", textops.crc_bucket("doc_id", 5) == 0), labels.where(textops.crc_bucket("doc_id", 5) != 0), 3000, 25)
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    bag = lambda t: count(t.split())
    vocabulary = sorted({w for _, t in train for w in t.split()})
    df = np.array([sum(w in bag(t) for _, t in rows) for w in vocabulary])
    y = np.array([int("a1" in t) for _, t in train])
    held = np.array([[w in bag(t) for w in vocabulary] for _, t in train], float)
    d, a, n = held.sum(0), (held * y[:, None]).sum(0), len(train)
    e = d * y.sum() / n
    chi = (a - e) ** 2 / np.maximum(e * (1 - y.sum() / n) * (1 - d / n), 1e-9)
    scale = (np.log((1 + len(rows)) / (1 + df)) + 1) * (chi / (chi + toxicity.HALF)) ** 2 + 1e-6
    vector = lambda t: np.log1p(np.array([bag(t)[w] for w in vocabulary])) * scale
    norm = lambda v: v / max(np.linalg.norm(v), 1e-12)
    kinds = {}
    for (_, t), label in zip(train, y):
        kinds.setdefault(tuple(sorted(bag(t).items())), []).append(label)
    entries = [(norm(vector(" ".join(w for w, c in k for _ in range(c)))), len(v), sum(v)) for k, v in kinds.items()]
    for i, t in rows:
        q = norm(vector(t))
        near = sorted(((float(v @ q), c, s) for v, c, s in entries if v @ q > 1e-9), reverse=True)[:25] if q.any() else [(1.0, c, s) for v, c, s in entries if not v.any()]
        if len(near) == 25 and sorted(float(v @ q) for v, *_ in entries)[-26] > near[-1][0] - 1e-6:
            continue  # a tie at the last place may go either way
        close = [s / (1.02 - min(s, 1)) for s, _, _ in near]
        p = (sum(c * x[2] for c, x in zip(close, near)) + model.smooth * model.prior) / (sum(c * x[1] for c, x in zip(close, near)) + model.smooth)
        logit = math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
        assert abs(got[i] - 1 / (1 + math.exp(-(model.slope * logit + model.shift)))) < 2e-3


def test_suffix_tree_base_is_exact(docs, empty, rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    end = object()
    tokens = [(r[1] or "").encode().lower().split() + [end] for r in rows]
    train = count(t for r, ts in zip(rows, tokens) if not held(r[0]) for t in ts)
    n, v = sum(train.values()), len(train)
    want = collections.defaultdict(list)
    for r, ts in zip(rows, tokens):
        want[r[0]].append((len(ts), sum(train[t] > 0 for t in ts), round(sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 6)))
    got = collections.defaultdict(list)
    for r in suffixtree.score(docs).collect():
        assert r.held_out == held(r.doc_id) and r.train_tokens == n and r.score < 0 and math.isfinite(r.score)
        got[r.doc_id].append((r.n_tokens, r.n_known, round(r.base_score, 6)))
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in want.items()}
    assert suffixtree.score(empty).count() == 0


def brute_tree(texts, least, divergence):
    """log10 of the probability of a text's symbols, by dictionaries over all contexts."""
    levels = [0, *suffixtree.LEVELS]
    counts = {k: collections.defaultdict(collections.Counter) for k in levels}
    for t in texts:
        padded = bytes([10] * 8) + t + bytes([10])
        for i in range(8, len(padded)):
            for k in levels:
                counts[k][padded[i - k : i]][padded[i]] += 1
    memo = {}

    def p(context, x):
        """In the longest kept state of the context."""
        if (context, x) not in memo:
            k = len(context)
            shorter = levels[levels.index(k) - 1] if k else None
            own = counts[k].get(context, {})
            n, kinds = sum(own.values()), max(1, len(own))
            if not k:
                memo[context, x] = (own.get(x, 0) + kinds / 256) / (n + kinds)
            else:
                below = p(context[k - shorter :], x)
                far = k == suffixtree.FAR and any(sum(counts[suffixtree.NEAR][context[j : j + 5]].values()) < 1 for j in range(4))
                nats = sum(c * math.log(c / n / p(context[k - shorter :], y)) for y, c in own.items())
                memo[context, x] = (own.get(x, 0) + kinds * below) / (n + kinds) if n >= least and nats >= divergence and not far else below
        return memo[context, x]

    def score(t):
        padded = bytes([10] * 8) + t + bytes([10])
        return sum(math.log10(p(padded[i - 8 : i], padded[i])) for i in range(8, len(padded)))

    return score


def normal(text):
    """Lower-cased A-Z, runs of white space as one space, none at the start."""
    import re

    return re.sub(rb"[ \t-\r]+", b" ", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())).lstrip(b" ")


@pytest.mark.parametrize("piece", [suffixtree.PIECE, 300])
def test_suffix_tree_scores_match_brute_force(docs, rows, monkeypatch, piece):
    monkeypatch.setattr(suffixtree, "PIECE", piece)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    want_of = brute_tree([normal(r[1]) for r in rows if not held(r[0])], 20, 8.0)
    want = collections.defaultdict(list)
    for r in rows:
        want[r[0]].append(round(want_of(normal(r[1])), 2))
    got = collections.defaultdict(list)
    for r in suffixtree.score(docs, least=20, divergence=8.0).collect():
        got[r.doc_id].append(r.score)
    assert set(got) == set(want)
    for i, scores in got.items():
        assert all(abs(a - b) < 0.02 + 1e-4 * abs(b) for a, b in zip(sorted(scores), sorted(want[i]))), i
    tree = suffixtree.fit(docs.where("text is not null"), 20, 8.0)
    assert piece > 1000 or len(tree.shipped) > 3
    assert suffixtree.FAR in tree.piece(0).share or piece < 1000


def test_suffix_tree_looks_up_once(docs):
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 62, 14_000, dtype=np.uint64))
    table = suffixtree.Table(keys, np.arange(len(keys)))
    assert table.rows.ndim == 1 and len(table.rows) < 4 * len(keys)  # a slot is fetched as one record
    found, value = table.get(np.concatenate([keys, keys + np.uint64(1 << 63)]))
    assert found[: len(keys)].all() and not found[len(keys) :].any() and (value[: len(keys)] == np.arange(len(keys))).all()
    tree = suffixtree.fit(docs.where("text is not null"), 20, 8.0)
    piece, asked = tree.piece(0), []
    get = piece.usual.get
    piece.usual.get = lambda x: asked.append(len(x)) or get(x)
    settled = total = 0
    for _, context, next_ in suffixtree.runs([r.text.encode() for r in docs.where("text is not null").select("text").collect()]):
        settled += int(piece.pairs[suffixtree.FAR].get(suffixtree.pair_key(context, next_))[0].sum())
        total += len(context)
        piece.log10(context, next_, tree.root)
    assert settled > 0 and sum(asked) == total - settled  # what a long context settles is not looked up again


def test_suffix_tree_counts_go_to_their_parts():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 62, 3000, dtype=np.uint64))
    n, mark = rng.integers(1, 9, len(keys)), rng.integers(0, 256, len(keys)).astype(np.uint8)
    for parts in (7, 70_000):
        part = (keys % np.uint64(parts)).astype(np.int64)
        batches = list(suffixtree.in_parts(part, 8, keys, n, mark))
        assert [b.column(0)[0].as_py() for b in batches] == np.unique(part).tolist()
        for b in batches:
            mine = part == b.column(0)[0].as_py()
            got = suffixtree.unsqueezed(b.column(2)[0].as_py(), np.uint64, np.int64, np.uint8)
            assert all((x == y[mine]).all() for x, y in zip(got, (keys, n, mark)))
    assert not list(suffixtree.in_parts(np.zeros(0, np.int64), 8, keys[:0], n[:0]))


def test_repeats_match_brute_force(docs, empty, rows):
    length = 400
    where = collections.Counter()
    texts = [(r[1] or "").encode() for r in rows]
    for t in texts:
        for p in range(len(t) - length + 1):
            where[t[p : p + length]] += 1
    want = collections.Counter()
    for r, t in zip(rows, texts):
        cover = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if where[t[p : p + length]] > 1:
                cover[p : p + length] = b"\1" * length
        left = bytes(c for c, x in zip(t, cover) if not x)
        spans = sum(1 for i, x in enumerate(cover) if x and (i == 0 or not cover[i - 1]))
        want[r[0], len(t), sum(cover), spans, hashlib.sha256(left).hexdigest()] += 1
    assert count(map(tuple, repeats.remove_repeats(docs).drop("n_passages").collect())) == want
    assert sum(k[2] > 0 for k in want) > 5
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_match_brute_force_at_random(spark):
    rng = random.Random(5)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(20, 90))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts)[rng.randint(0, 9) :] for _ in range(rng.randint(1, 9)))) for i in range(60)]
    length = 64
    where = collections.Counter(t[p : p + length] for _, t in rows for p in range(len(t) - length + 1))
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length).collect()}
    for i, t in rows:
        cover = set()
        for p in range(len(t) - length + 1):
            if where[t[p : p + length]] > 1:
                cover |= set(range(p, p + length))
        assert got[i] == len(cover)


def test_shared_passages_are_told(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 5))) for _ in range(n))
    passage, short = prose(50), prose(31)
    rows = [(0, prose(80) + " " + passage + " " + prose(40)), (1, prose(7) + " " + passage), (2, prose(300)), (3, short + " " + prose(90)), (4, prose(90) + " " + short), (5, None), (6, "few words")]
    rows += [(7, rows[2][1] + " end"), (8, rows[2][1] + " end")]
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r.n_passages} == {0, 1, 2, 7, 8} and {i for i, r in got.items() if r.n_removed} == {2, 7, 8}


CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a\\b ### x </turn>"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "assistant", "é漢\U0001f600 \\s\\e\\h"),
    (2, 0, None, "no role"), (2, None, "user", "first"), (2, 1, "odd: role</turn>###", "x: y"), (2, 1, "odd: role</turn>###", "x: y"),
    (None, 0, "assistant", "null id"), (3, 0, "system", "</turn>\n### assistant: fake</turn>\n"),
]


def test_chat_round_trip(spark):
    made = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    want = {}
    for c in {r[0] for r in CONVERSATIONS}:
        turns = sorted(((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in CONVERSATIONS if r[0] == c))
        loss = "".join(t[2] for t in turns if t[1] == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{t[1]}\n{t[2]}\n" for t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    rendered = chat.format_rows(made)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digest(rendered).collect()}
    assert got == want
    assert all("".join(s.text for s in r.segments) == r.formatted for r in rendered.collect())
    assert chat.format_rows(made.limit(0)).count() == 0


def test_chat_folds_edits_and_regenerations(spark):
    log = [
        (1, 0, 0, 0, "open", "user", None), (1, 1, 0, 0, "delta", None, "hel"), (1, 2, 0, 0, "delta", None, "lo"),
        (1, 3, 1, 1, "open", "assistant", None), (1, 4, 1, 1, "delta", None, "bad"), (1, 5, 2, 2, "open", "user", None), (1, 6, 2, 2, "delta", None, "dropped"),
        (1, 7, 1, 1, "regenerate", None, None), (1, 8, 1, 1, "delta", None, "go"), (1, 9, 1, 1, "delta", None, "od"),
        (1, 10, 2, 3, "open", "user", None), (1, 11, 2, 3, "delta", None, "typo"), (1, 12, 2, 3, "edit", None, "fixed"), (1, 13, 2, 3, "delta", None, "!"),
        (2, 0, 0, 0, "open", "user", None),
    ]
    got = chat.fold(spark.createDataFrame(log, "conv_id long, seq long, turn long, msg long, kind string, role string, text string")).collect()
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in got) == [(1, 0, "user", "hello"), (1, 1, "assistant", "good"), (1, 2, "user", "fixed!"), (2, 0, "user", "")]


ITEM = "A train leaves the town at 9 and travels with Anna for 120 km until it reaches the far station by the sea."


def test_decontamination(spark, empty):
    items = [(1, ITEM), (2, "too short"), (3, None), (4, "What is the name of the old bridge that crosses the river near the northern market square")]
    changed = ITEM.replace("9", "14").replace("Anna", "Boris").replace("120", "75").replace("km", "miles")
    mixed = "A train leaves the town at 3 and travels with Anna for 4 km until it reaches. " * 1
    texts = {0: "clean words only, nothing of the kind at all in this text here", 1: "before. " + ITEM + " after it all", 2: "x " + changed, 3: "", 4: None, 5: "the old bridge that crosses", 6: items[3][1].upper() + "!", 7: "It leaves the town at 9 and then", 8: mixed}
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([*texts.items(), (1, texts[1]), (None, ITEM)], "doc_id long, text string")
    got = count((r.doc_id, r.contaminated, tuple(r["items"])) for r in decontaminate.label(docs, bench).collect())
    assert got[1, True, (1,)] == 2 and got[2, True, (1,)] == 1 and got[6, True, (4,)] == 1 and got[None, True, (1,)] == 1
    assert got[8, True, (1,)] == 1 and sum(n for (_, c, _), n in got.items() if not c) == 5
    kept = [r.doc_id for r in decontaminate.clean(docs, bench).collect()]
    assert {0, 3, 4, 5, 7} <= set(kept) and not {1, 2, 6, None} & set(kept)
    assert decontaminate.label(empty, bench).count() == 0 and not decontaminate.label(docs, bench.limit(0)).where("contaminated").count()


def test_decontamination_of_long_runs_short_items_and_tables_of_numbers(spark):
    rng = random.Random(6)
    plain = lambda n: [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{k}x" for k in range(n)]
    long = plain(200)
    items = [(1, " ".join(long)), (2, "seven dwarfs live here"), (3, " ".join(str(k) for k in range(30))), (4, "one two")]
    numbers = " ".join(str(rng.randint(100, 999)) for _ in range(20_000))
    texts = [" ".join(plain(40) + long[50:75] + plain(40)), " ".join(plain(40) + long[50:65] + plain(40)), "so SEVEN dwarfs, live here. yes", "seven dwarfs live elsewhere", numbers, "pad " + items[2][1] + " pad", "one two three"]
    got = {r.doc_id: list(r["items"]) for r in decontaminate.label(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {0: [1], 1: [], 2: [2], 3: [], 4: [], 5: [3], 6: []}


@pytest.mark.parametrize("names", [("_id", "_h", "__s", "__b"), ("doc", "h", "first_doc", "_doc"), ("__bucket", "aside", "_aside", "source_")])
def test_columns_of_any_name_pass_through(spark, names):
    rows = [(i, f"word{i} and{i} more{i} of{i} it{i} here{i}", "en", f"s{i % 2}", *(f"{n}{i}" for n in names)) for i in range(6)] + [(6, "x y", "en", "s0", None, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    bench = spark.createDataFrame([(1, "nothing that any of these texts has at all in it")], "item_id long, text string")
    for out in (linededup.dedup(table), simhash.one_of_each_group(table), decontaminate.clean(table, bench), mixing.mix(table), langid.keep_identified(table)):
        assert out.columns[: len(table.columns)] == table.columns
        assert {r[4] for r in out.select(*(f"`{c}`" for c in table.columns)).collect()} == {r[4] for r in rows}


def test_mixing(docs, empty, rows):
    size = lambda t: len((t or "").encode().split())
    by = collections.Counter()
    for r in rows:
        by[r[3]] += size(r[1])
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = sum(by.values()) - sum(3 * by[s] for s in full)
        level = left / max(1e-9, sum(weight[s] for s in names if s not in full))
        over = {s for s in names if s not in full and level * weight[s] > 3 * by[s]}
        if not over:
            break
        full |= over
    target = {s: 3 * by[s] if s in full else level * weight[s] for s in names}
    mixed = mixing.mix(docs)
    assert mixed.columns[: len(docs.columns)] == docs.columns
    got = mixed.collect()
    taken = collections.Counter()
    for r in got:
        assert r.size == size(r.text) and r.source_size == by[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        assert all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert count((r.doc_id, r.text, r.taken) for r in got) == count((r.doc_id, r.text, r.taken) for r in mixing.mix(docs.repartition(5)).collect())
    assert mixing.mix(empty).count() == 0


def test_curriculum_positions_follow_the_schedule(spark):
    from pyspark.sql import functions as F

    rows = [(i, "w " * 10, f"s{i % 2}") for i in range(4000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rising = lambda rank: F.when(rank == 0, F.array(*(F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in ((0.0, 0.0), (1.0, 2.0))))).otherwise(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in ((0.0, 1.0), (1.0, 1.0)))))
    got = mixing.in_order(mixing.mix(table, rising)).collect()
    assert [r.position for r in got] == sorted(r.position for r in got)
    early = sum(r.source == "s0" and r.position < 0.5 for r in got)
    flat = sum(r.source == "s1" and r.position < 0.5 for r in got)
    assert abs(early - 500) < 20 and abs(flat - 1000) < 20


def test_prefix_hashes(docs, empty, rows):
    import numpy as np

    place = lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or "")
    ordered = sorted(((*place(r), r[0]) for r in rows), key=lambda x: (x[0], x[1].encode()))
    want = collections.Counter()
    for k, (_, text, doc) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        want[doc, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    got = prefixhash.fingerprints(docs).collect()
    assert count((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    prints = {}
    text_of = collections.defaultdict(set)
    for r in rows:
        text_of[r[0]].add(r[1] or "")
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.n_chars < 2 or r.near_edited >= 0.5)
        if len(text_of[r.doc_id]) == 1:
            assert prints.setdefault(next(iter(text_of[r.doc_id])), r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)
    assert prefixhash.fingerprints(empty).count() == 0
    a, b = prefixhash.PrefixHash(prefixhash.points("xxabcdefg")), prefixhash.PrefixHash(prefixhash.points("abcdeZZZZZZZ"))
    assert a.common(2, 0, b) == 5 and a.equal(0, 1, 1) and not a.equal(0, 2, 1)
    for one, two in [("abcXdef", "abcYYdef"), ("", "a"), ("same", "same"), ("aaaa", "aa"), ("xab", "ab"), ("q" * 140_000 + "left" + "z" * 300_000, "q" * 140_000 + "rite" + "z" * 300_000)]:
        x, y = (prefixhash.fingerprint_and_prefixes(prefixhash.points(t))[1] for t in (one, two))
        assert x.common_prefix(y) == next((i for i, (a, b) in enumerate(zip(one, two)) if a != b), min(len(one), len(two)))
        assert x.common_suffix(y) == next((i for i, (a, b) in enumerate(zip(one[::-1], two[::-1])) if a != b), min(len(one), len(two)))
    long = prefixhash.points("abcdefghij" * 30000)
    assert prefixhash.fingerprint(long)[3].tolist() == prefixhash.fingerprint(np.concatenate([long, long]))[3].tolist()
    f = prefixhash.fingerprint(long)
    g = prefixhash.from_text(prefixhash.as_text(f))
    assert f[:2] == g[:2] and prefixhash.likeness(f, g) == 1


def test_edits_stay_near_and_others_do_not(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(200))) for i in range(30)]
    got = prefixhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert min(r.near_edited for r in got) > 0.4 and max(r.near_next for r in got) < 0.2


def test_long_lines_match_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(700)]
    base = [rng.sample(words, rng.randint(90, 260)) for _ in range(25)]
    lines = list(base)
    for b in base:
        for share in (0.05, 0.09, 0.11, 0.13, 0.2):
            n = int(len(b) * share)
            lines.append(b[n:] + rng.sample(words, n))
    rng.shuffle(lines)
    want = {i for i, b in enumerate(lines) for a in lines[:i] if len({*a} & {*b}) >= 0.8 * len({*a} | {*b}) - 1e-9}
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id for r in linededup.dedup(table, report=True).collect() if r.n_removed}
    assert got == want and 25 < len(want) < len(lines) - 25


def test_templated_lines_do_not_meet_pair_by_pair(spark):
    """200,000 lines of one template: with two words of their own each they stay, with one they are one line."""
    import time

    began = time.perf_counter()
    apart = [f"posted on day{i} at the old town hall by user{i}" for i in range(100_000)]
    alike = [f"this page was last changed by somebody of the name of visitor{i} today" for i in range(100_000)]
    table = spark.createDataFrame([(k, "\n".join(apart[k::50] + alike[k::50])) for k in range(50)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in linededup.dedup(table, report=True).collect()}
    assert got == {k: 2000 - (k == 0) for k in range(50)}
    assert time.perf_counter() - began < 60


def test_hot_words_match_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    lines = []
    for i in range(400):
        words = ["hot", *rng.sample([f"c{k}" for k in range(14)], rng.randint(5, 12))]
        lines.append(" ".join(words + [f"own{i}"] * (i % 2)))
    sets = [frozenset(x.split()) for x in lines]
    want = {i for i, b in enumerate(sets) for a in sets[:i] if len(a & b) >= 0.8 * len(a | b) - 1e-9}
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    monkeypatch.setattr(linededup, "HOT", 2)
    got = {r.doc_id for r in linededup.dedup(table, report=True).collect() if r.n_removed}
    assert got == want and len(want) > 50


@pytest.mark.skipif(not pathlib.Path("/root/testdata/sf0.001").exists(), reason="needs the driver's tables")
def test_executors_need_no_copy_of_the_repository(tmp_path):
    """Every query runs from a folder, and with a path, from which workers cannot import this package."""
    import os
    import subprocess
    import sys

    root = str(pathlib.Path(__file__).resolve().parents[2])
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", {str(tmp_path / "ck")!r}).getOrCreate()
assert not s.range(1).selectExpr("id").rdd.map(lambda r: __import__("importlib.util").util.find_spec("lodestar") is not None).first()
from lodestar.llm import registry
for name, q in registry.QUERIES.items():
    assert q(s, "/root/testdata/sf0.001").count() > 0, name
print("all", len(registry.QUERIES))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all 14" in done.stdout, done.stderr[-3000:]
