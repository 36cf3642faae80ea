"""The pipeline's stages on planted cases, and the whole against brute force."""

import random
import zlib

import pytest

import corpus_pipeline
from lodestar.llm import langid, mixing, simhash

SOUNDS = {"en": ["th", "e", "ing", "and", "er", "on"], "de": ["sch", "ei", "ung", "der", "ü", "ach"]}


def word(rng, lang):
    return "".join(rng.choices(SOUNDS[lang], k=rng.randint(2, 4)))


def jaccard(a, b, n=5):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    benchmark = [(i, " ".join(word(rng, "en") for _ in range(30))) for i in range(3)]
    docs, kind = [], {}

    def add(text, lang, what):
        kind[len(docs)] = what
        docs.append((len(docs), text, lang, f"src{len(docs) % 3}", len(text or "")))

    for i in range(80):
        lang = "en" if i % 2 else "de"
        add("\n".join(" ".join(word(rng, lang) for _ in range(30)) for _ in range(4)), lang, "clean")
    for i in range(8):
        w = docs[i][1].split(" ")
        w[len(w) // 2] = "changedword"
        add(" ".join(w), docs[i][2], ("near", i))
        add(docs[20 + i][1], docs[20 + i][2], ("exact", 20 + i))
    for i in range(3):
        add(" ".join(word(rng, "en") for _ in range(20)) + " " + benchmark[i][1] + " " + " ".join(word(rng, "en") for _ in range(20)), "en", "leak")
    add("12345 ### 99 !!", "en", "junk")
    add(None, None, "junk")
    return docs, kind, benchmark


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    docs, _, benchmark = corpus
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_language_stage_drops_only_texts_without_language(spark, corpus, folder):
    _, kind, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.language_id(spark, docs, folder)
    assert out.schema == docs.schema
    assert {r.doc_id for r in out.collect()} == {i for i, k in kind.items() if k != "junk"}


def test_identified_language_goes_on_to_the_stream(spark, corpus, tmp_path):
    """Held-out rows whose lang is null or wrong leave the stage, and the pipeline, with the language of their text."""
    docs, kind, benchmark = corpus
    rows = [d for d in docs if kind[d[0]] == "clean"]
    spoilt = {d[0]: [None, "en", "de"][n % 3] for n, d in enumerate(d for d in rows if zlib.crc32(str(d[0]).encode()) % 4 == 2)}
    spark.createDataFrame([(*d[:2], spoilt.get(d[0], d[2]), *d[3:]) for d in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, table, str(tmp_path)).collect()}
    assert len({d[2] for d in rows if spoilt.get(d[0], d[2]) != d[2]}) == 2
    assert got == {d[0]: d[2] for d in rows} == {r.doc_id: r.lang_pred for r in langid.identify(table).collect()}
    stream = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in stream} & spoilt.keys() and all(r.lang == docs[r.doc_id][2] for r in stream)


def test_near_dedup_keeps_one_of_each_group(spark, corpus):
    docs, kind, _ = corpus
    rows = [*docs, docs[0], (None, docs[1][1], None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = simhash.one_of_each_group(table)
    assert out.schema == table.schema
    kept = [r.doc_id for r in out.collect()]
    gone = {i for i, k in kind.items() if k[0] in ("near", "exact")} | {1}
    assert sorted(kept, key=str) == sorted([i for i in kind if i not in gone] + [None], key=str)
    assert simhash.one_of_each_group(table.limit(0)).count() == 0


def test_similar_texts_are_found_by_segments(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        w = [word(rng, "en") + str(rng.randint(0, 99)) for _ in range(200)]
        rows.append((2 * i, " ".join(w)))
        for _ in range(2):
            w[rng.randrange(200)] = "edit"
        rows.append((2 * i + 1, " ".join(w)))
    high = [i for i in range(150) if jaccard(rows[2 * i][1], rows[2 * i + 1][1]) >= 0.9]
    kept = {r.doc_id for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * i in kept for i in range(150))
    assert sum(2 * i + 1 not in kept for i in high) >= 0.95 * len(high) > 50


def test_near_dedup_links_just_the_pairs_at_the_similarity(spark):
    rng = random.Random(9)
    texts = []
    for i in range(240):
        w = [word(rng, "en") + str(rng.randint(0, 999)) for _ in range(150)]
        texts.append(" ".join(w))
        for at in rng.sample(range(5, 145), i % 6 + 1):
            w[at] = f"edit{i}"
        texts.append(" ".join(w))
    alike = {i for i in range(240) if jaccard(texts[2 * i], texts[2 * i + 1]) >= 0.8}
    apart = {i for i in range(240) if 0.65 <= jaccard(texts[2 * i], texts[2 * i + 1]) < 0.8}
    assert min(len(alike), len(apart)) > 40
    out = simhash.one_of_each_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in out.collect()} == {d for d in range(480) if d % 2 == 0 or d // 2 not in alike}


def test_near_dedup_proposes_by_bk_trees_of_fingerprints(spark, folder, monkeypatch):
    """The stage searches SimHash words by operator 2's trees: what they propose is within the radius, and joins what all such pairs join."""
    seen, plain = [], simhash.proposed
    monkeypatch.setattr(simhash, "proposed", lambda distinct, radius: seen.append((distinct, radius)) or plain(distinct, radius))
    corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    (distinct, radius), = seen
    assert radius == 2 and {"id", "f0"} <= set(distinct.columns)
    rng = random.Random(2)
    words = [rng.getrandbits(64) for _ in range(60)]
    words += [w ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for w in words[:30]] + words[:10] + [w ^ 7 for w in words[40:50]]
    fp = {i: w - (w >> 63 << 64) for i, w in enumerate(words)}
    apart = lambda a, b: (words[a] ^ words[b]).bit_count()
    pairs = [(r.u, r.v) for r in plain(spark.createDataFrame(list(fp.items()), "id long, f0 long"), 2).collect()]
    assert pairs and all(apart(a, b) <= 2 for a, b in pairs)

    def groups(links):
        root = {i: i for i in fp}
        for _ in fp:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert groups(pairs) == groups([(a, b) for a in fp for b in fp if a < b and apart(a, b) <= 2])


def test_run_is_the_stages_and_their_decisions_hold(spark, corpus, folder):
    """What each stage keeps, and the stream at the end, by brute force over the planted corpus."""
    docs, kind, _ = corpus
    text = {d[0]: d[1] for d in docs}
    kept = {i for i, k in kind.items() if k != "junk"}
    # line dedup: a near copy's or a copy's lines that an earlier line is like go
    lines, left = [], {}
    for i in sorted(kept):
        own = []
        for line in text[i].split("\n"):
            words = frozenset(line.lower().split())
            if not (words and any(len(words & w) >= 0.8 * len(words | w) - 1e-9 for w in lines)):
                own.append(line)
            if words:
                lines.append(words)
        left[i] = "\n".join(own)
    # near-dedup: the first of each component stays
    groups, order = {}, sorted(kept)
    for i in order:
        same = {groups[j] for j in order[: order.index(i)] if jaccard(left[i], left[j]) >= 0.8}
        groups[i] = min(same, default=i)
        groups |= {j: groups[i] for j, g in groups.items() if g in same}
    kept = {i for i in kept if groups[i] == i} - {i for i, k in kind.items() if k == "leak"}
    stream = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    assert all(r["text"] == left[r["doc_id"]] for r in stream) and {r["doc_id"] for r in stream} <= kept
    # mixing: places on each source's line are cut at its target
    size = {i: len(left[i].split()) for i in kept}
    total = sum(size.values())
    taken = {}
    for r in stream:
        taken[r["doc_id"]] = r["taken"]
        assert r["taken"] <= 3 * r["size"] == 3 * size[r["doc_id"]]
    assert abs(sum(taken.values()) - total) <= 3
    position = [r["position"] for r in spark.createDataFrame([(r["position"],) for r in stream], "position double").orderBy("position").collect()]
    assert sorted(r["position"] for r in stream) == position and all(0 <= p <= 1 for p in position)
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame([(i, left[i], docs[i][3]) for i in kept], "doc_id long, text string, source string")).collect()}
    assert {i: r.taken for i, r in got.items() if r.positions} == taken


def test_stages_are_named(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]


def test_odd_rows_pass_every_stage(spark, folder):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "x", None, "s", 1), (3, "Überall", "de", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert out.count() <= len(rows)
        assert stage(spark, docs.limit(0), folder).count() == 0
        if k < 4:
            assert out.columns == docs.columns


def test_without_languages_nothing_can_be_learnt(spark):
    docs = spark.createDataFrame([(0, "abc", None), (4, "1", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.keep_identified(docs).collect()] == [0]
