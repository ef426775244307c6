"""The operators against brute force, round trips and held-out labels, on small and odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editlens.llm import (embedding_dedup, induced, line_dedup, mixing, packing, quality, simhash, suffix_dedup, token_store,
                          tokens, toxicity, warc)
from editlens.session import read_table

from . import brute

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n ", "en", "a", 4), (3, "One line.", "en", None, 9),
    (4, "Same text here.\nSecond line.\nThird line.", "en", "b", 1), (4, "Same text here.\nSecond line.\nThird line.", "en", "b", 1),
    (5, "Same text here.\nSecond line.\nThird line.", "en", "b", 1), (6, LONG, "en", "c", len(LONG)),
    (7, "naïve Ünïcödé ﬁ ΑΣ Σ x <|endoftext|> don't I'll 12 3½ \U0001F600", "fr", "c", 5), (None, "No id at all.", "en", "c", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


def clash(df, *names):
    """``df`` with further columns named like an operator's results."""
    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit("x"))
    return df.withColumn("more", F.lit(1))


#: Names that operators used for columns of their own.
HELPERS = ("seq", "lo", "hi", "per", "slot", "sc", "pc", "n_salts", "fp", "cut", "passes", "u", "v", "root", "first", "h", "n",
           "sha", "word", "key", "part", "mask", "code", "size", "shard", "no", "k", "s", "count", "name", "__h", "rp", "rs", "owner")


def empty(spark, schema=DOC):
    return spark.createDataFrame([], schema)


# quality rules ------------------------------------------------------------------------------------------------

def test_repeat_words_brute(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abc" if i % 2 else "abcdefghij") for _ in range(rng.randint(0, 40)))) for i in range(200)]
    got = {r.doc_id: r for r in quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        ws = t.split()
        seen = [tuple(ws[k:k + 3]) for k in range(len(ws) - 2)]
        cover = {k + d for k, g in enumerate(seen) if seen.count(g) > 1 for d in range(3)}
        assert got[i].n_repeat_words == len(cover) and got[i].n_words == len(ws)


def test_quality_lines(spark):
    good = "\n".join(f"Line{i} says{i} what{i} is{i} quite{i} clean{i}." for i in range(12))
    bad = "\n".join(f"buy{i}%%% it{i}&&& now{i}### x{i}$$$ and{i}### again{i}" for i in range(30))
    nav = "Home | News | Sport | Weather | Contact"
    rows = [(1, good), (2, good + "\n" + nav), (3, good + "\n" + bad), (4, None), (5, "")]
    got = {r.doc_id: r for r in quality.apply_rules(clash(spark.createDataFrame(rows, "doc_id long, text string"), "kept", "n_words")).collect()}
    assert got[1].kept and got[1].clean_text == good and got[1].more == 1
    assert got[2].kept and got[2].clean_text == good and got[2].n_failed_lines == 1
    assert not got[3].kept and not got[3].base_failed
    assert got[4].base_failed and got[5].base_failed and got[4].n_words == 0
    assert quality.apply_rules(empty(spark)).count() == 0


# line dedup ---------------------------------------------------------------------------------------------------

def test_line_chunks_resist_shifts(spark, odd):
    rng = random.Random(2)
    passage = [f"shared line {i} {rng.random()}" for i in range(60)]
    rows = [(i, "\n".join([f"own {i} {k} {rng.random()}" for k in range(rng.randint(1, 9))] + passage + [f"end {i}"])) for i in range(40)]
    got = {r.doc_id: r for r in line_dedup.remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_removed_lines == 0
    assert all(got[i].n_removed_lines >= 40 for i in range(1, 40))
    for i, t in rows:
        left = got[i].dedup_text.split("\n")
        assert len(left) + got[i].n_removed_lines == len(t.split("\n")) and got[i].dedup_text.startswith(f"own {i} 0")
    r = line_dedup.remove_repeated_chunks(clash(odd, "n_lines", *HELPERS)).collect()
    assert len(r) == len(ODD) and {x.doc_id: x.n_removed_lines for x in r}[5] == 3
    assert [x.n_removed_lines for x in r if x.doc_id == 4] == [0, 0]
    assert line_dedup.remove_repeated_chunks(empty(spark)).count() == 0


@pytest.mark.parametrize("size", range(2, 9))
def test_short_passages_are_found(spark, size):
    """A passage of a few lines inside otherwise different documents goes from all but the first."""
    rng = random.Random(size)
    shared = [f"shared {size} {i} {rng.random()}" for i in range(size)]
    own = lambda i, n: [f"own {i} {k} {rng.random()}" for k in range(n)]
    rows = [(i, "\n".join(own(i, rng.randint(1, 4)) + shared + own(i + 100, rng.randint(0, 3)))) for i in range(30)]
    got = {r.doc_id: r for r in line_dedup.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].dedup_text == rows[0][1] and got[0].n_removed_passages == 0
    for i, t in rows[1:]:
        assert got[i].dedup_text.split("\n") == [x for x in t.split("\n") if x not in shared]
        assert (got[i].n_removed_lines, got[i].n_removed_passages) == (size, 1)
    same = line_dedup.remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.dedup_text for r in same} == {i: r.dedup_text for i, r in got.items()}


def test_passages_against_brute_force(spark, odd):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["", " ", "", *"abcdefghijklm"]) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "z\nz\nz"), (204, "y\ny\ny\ny\ny")]
    for df in (spark.createDataFrame(rows, "doc_id long, text string"),
               read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")):
        texts = [tuple(r) for r in df.collect()]
        want, n_chunks = brute.passages(texts), brute.removed_chunks(texts)
        assert sum(n_chunks.values()) > 0
        got = {r.doc_id: r for r in line_dedup.remove_repeated_passages(df).collect()}
        chunks = {r.doc_id: r for r in line_dedup.remove_repeated_chunks(df).collect()}
        assert sum(map(len, want.values())) > 100
        for d, r in got.items():
            lines, gone = (r.text or "").split("\n"), want.get(d, set())
            assert r.dedup_text == ("\n".join(x for i, x in enumerate(lines) if i not in gone) if r.text is not None else None)
            assert r.n_removed_lines == len(gone) == chunks[d].n_removed_lines and r.dedup_text == chunks[d].dedup_text
            assert chunks[d].n_removed_chunks == n_chunks.get(d, 0)
            assert r.n_removed_passages == sum(i - 1 not in gone for i in gone)
    r = line_dedup.remove_repeated_passages(clash(odd, "n_lines", *HELPERS)).collect()
    assert len(r) == len(ODD) and {x.doc_id: x.n_removed_lines for x in r}[5] == 3
    assert [x.n_removed_lines for x in r if x.doc_id == 4] == [0, 0]
    assert line_dedup.remove_repeated_passages(empty(spark)).count() == 0


# tokens, packing, token files -----------------------------------------------------------------------------------

def test_encoder_equals_tokenizer():
    import pyarrow as pa
    texts = [t for _, t, *_ in ODD] + ["Á İı ß ŉ \x85\xa0x\x1cy\x0bz 'S don't!!'s ...", "\0 a\0b", "中文 text"]
    ids, off = tokens.Encoder.of(tokens.public_path()).batch(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[off[i]:off[i + 1]].tolist() == brute.tokens(t, 0)[:-1]


def test_packing(spark, odd):
    docs = read_table(spark, SF, "documents").select("doc_id", "text").union(odd.select("doc_id", "text").where("doc_id is null or doc_id in (4, 6)"))
    rows = packing.pack(clash(docs, "offset", "start", *HELPERS)).collect()
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(brute.tokens(r.text, 2))
    seqs, per_doc = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        per_doc.setdefault(r.doc_id, []).append(r)
        assert 1 <= r.length <= 4096 and r.more == 1
        assert any(len(t) == r.doc_tokens and brute.crc(t[r.start:r.start + r.length]) == r.ids_crc32 for t in want[r.doc_id])
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    total = sum(len(t) for ts in want.values() for t in ts)
    assert sum(r.length for r in rows) == total
    for d, ts in want.items():
        assert sorted(r.start for r in per_doc[d]) == sorted(x for t in ts for x in range(0, len(t), 4096))
    assert len(seqs) * 4096 < total * 1.1
    assert packing.pack(empty(spark)).count() == 0


@pytest.mark.parametrize("n, top", [(20_000, 3), (3000, 40), (3000, 6000), (400, 130)])
def test_padding_is_little(spark, n, top):
    """Short, empty and mixed texts: at most 2 % more sequences than their ids need, and two more."""
    rng = random.Random(top)
    rows = [(i, " ".join("a" for _ in range(rng.randint(0, top)))) for i in range(n)]
    r = packing.pack(clash(spark.createDataFrame(rows, "doc_id long, text string"), *HELPERS)).agg(
        F.sum("length"), F.countDistinct("sequence_id"), F.max(F.col("offset") + F.col("length"))).first()
    assert r[0] == sum(len(t.split()) + 1 for _, t in rows) and r[2] <= 4096
    assert r[1] <= r[0] / 4096 * 1.02 + 2


def test_cutting_stock_beats_bound(spark):
    # after a session has started in this process, with every class in use
    rng = np.random.default_rng(0)
    widths = packing.class_widths(4096)
    demand = rng.integers(0, 400, len(widths))
    plan = packing.solve(demand, widths, 4096)
    made = sum(t * p for t, p in plan)
    assert (made >= demand).all() and all((p * widths).sum() <= 4096 for _, p in plan)
    assert sum(t for t, _ in plan) <= (demand * widths).sum() / 4096 * 1.02 + 2


def test_inverse_without_threads():
    a = np.random.default_rng(1).random((90, 90))
    assert np.abs(packing._inverse(a) @ a - np.eye(90)).max() < 1e-8


def test_token_files(spark, odd, tmp_path):
    docs = read_table(spark, SF, "documents").select("doc_id", "text").where("doc_id > 7").union(odd.select("doc_id", "text"))
    rows = token_store.round_trip(clash(docs, "start"), folder=str(tmp_path)).collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or ""), brute.tokens(r.text, 1)) for r in docs.collect())
    at = 0
    for r, (key, ids) in zip(sorted(rows, key=lambda r: r.start), want):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key[1] if key[0] else None, at, len(ids), brute.crc(ids))
        at += len(ids)
    assert len(rows) == len(want) and token_store.round_trip(empty(spark)).count() == 0


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, 100)
    yield
    spark.conf.unset(name)


def test_token_files_are_bounded(spark, tmp_path, small_batches):
    """A repeated id is split, a task closes a full file, and reading deals out the files."""
    rng = random.Random(3)
    rows = [(7 if i % 3 else None, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 60)))) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    files = token_store.store(df, str(tmp_path), file_ids=5000)
    made = sorted(files.collect(), key=lambda r: r.file_no)
    assert len(made) > 8 and [r.file_no for r in made] == list(range(len(made))) and max(r.n_tokens for r in made) < 150_000
    assert [r.base for r in made] == [sum(x.n_tokens for x in made[:i]) for i in range(len(made))]
    back = token_store.read(spark, files)
    assert back.rdd.getNumPartitions() == len(made)
    got = sorted((r.start, r.n_tokens, r.ids_crc32) for r in back.collect())
    want, at = [], 0
    for key, ids in sorted(((d is not None, d or 0, t), brute.tokens(t, 1)) for d, t in rows):
        want.append((at, len(ids), brute.crc(ids)))
        at += len(ids)
    assert got == want


def test_archives_are_dealt_to_tasks(spark, tmp_path):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html")).repartition(6)
    files = warc.write_monolithic(warc.with_revisits(pages, "page_id", "url", "html", 0), str(tmp_path))
    n = files.count()
    normal = warc.normalise(files, str(tmp_path))
    assert n > 1 and warc.read(normal).rdd.getNumPartitions() == n == warc.by_file(files).rdd.getNumPartitions()
    assert warc.read(normal).count() == 40


@pytest.mark.parametrize("big", [10, 300, 70_000, 1 << 25])
def test_random_access(tmp_path, big):
    ids = np.random.default_rng(big).integers(0, big, 5000).astype(np.uint32)
    with open(tmp_path / "f", "w+b") as f:
        token_store.write_ids(f, ids, np.array([0, 10, 10, 5000]))
        t = token_store.TokenFile(f)
        assert t.offsets().tolist() == [0, 10, 10, 5000]
        for i in [0, 1, 511, 512, 513, 4095, 4999]:
            assert t[i] == ids[i]
        assert (t.ids(777, 3333) == ids[777:3333]).all()


# toxicity -----------------------------------------------------------------------------------------------------

def test_toxicity_held_out(spark, odd):
    d = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit / sum(r.predicted for r in got) > 0.95 and hit / sum(r.toxic for r in got) > 0.9
    r = toxicity.score(clash(odd, "score", *HELPERS), model).collect()
    assert len(r) == len(ODD) and all(0 <= x.score <= 1 and x.more == 1 for x in r) and not any(x.predicted for x in r)
    none = toxicity.learn(docs, labels.limit(0))
    assert toxicity.score(odd, none).agg(F.max("score")).first()[0] < 1e-9
    assert toxicity.score(empty(spark), model).count() == 0


def test_toxicity_against_plain_version(spark):
    rng = random.Random(9)
    plain, ill = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)], ["idiot", "idiots", "moronic", "trash", "scum"]
    rows = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(0, 40))]
        y = int(i % 4 == 0)
        words += [rng.choice(ill if y else ["trashcan", "idiom", "clown", "trash can"]) for _ in range(rng.randint(1, 3) if y or i % 3 == 0 else 0)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), y))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(8, "zzz later text"), (None, "idiot")], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    seen = [(i, t, y) for i, t, y in rows if __import__("zlib").crc32(str(i).encode()) % 3 != 1]
    weights, harmless = brute.lexicon([(set(toxicity.fold(min(t, "zzz later text") if i == 8 else t)), y) for i, t, y in seen])
    assert model.weights.keys() == weights.keys() and all(abs(model.weights[g] - w) < 1e-9 for g, w in weights.items()) and weights
    assert model.exceptions == toxicity.EXCEPTIONS + harmless
    s, n = model.sums([t for _, t, _ in rows], model.automaton())
    for (_, t, _), a, k in zip(rows, s, n):
        words = toxicity.fold(t)
        assert k == len(words) and abs(a - brute.toxic_sum(words, weights, model.exceptions)) < 1e-9
    # the curve is the optimum: no gradient of the penalised likelihood is left
    s, n = model.sums([min(t, "zzz later text") if i == 8 else t for i, t, _ in seen], model.automaton())
    y = np.array([y for *_, y in seen])
    w = np.array(model.curve)
    left = toxicity.features(s, n).T @ (y - model.scores(s, n)) - 1e-2 * np.array([0, 1, 1]) * w
    assert np.abs(left).max() < 1e-4
    assert toxicity.learn(docs, labels) == model


def test_toxicity_folding_and_exceptions():
    m = toxicity.Model({"idiot ": 5.0, "trash ": 4.0, "moro": 3.0}, ["trash can"], (-3.0, 2.0, 0.0))
    a = m.automaton()
    for t in ["an IDIOT", "1d10t!", "іdіоt", "ｉｄｉｏｔ", "tr@sh", "tra$h", "m0ronic"]:
        assert m.sums([t], a)[0][0] > 0, t
    for t in ["idiotic", "trash can", "tomorrow", "the trash can.", "$100", "", None]:
        assert m.sums([t], a)[0][0] == 0, t


# simhash ------------------------------------------------------------------------------------------------------

def test_simhash(spark, odd):
    docs = read_table(spark, SF, "documents").select("doc_id", "text")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(clash(docs, "component_id", *HELPERS)).collect()}
    assert got == brute.simhash([tuple(r) for r in docs.collect()])
    r = simhash.near_duplicates(odd).collect()
    assert len(r) == len(ODD) and {x.component_id for x in r if x.doc_id in (0, 1, 2)} == {0}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_hot_shards_are_cut_again(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(300)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    met = {}
    for r in simhash.shards(df, 3, max_shard=20).collect():
        met.setdefault(r.shard, set()).add(r.fp % (1 << 64))
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                assert any(a in s and b in s for s in met.values())


def test_tree_finds_all_links():
    rng = random.Random(4)
    fps = [rng.getrandbits(10) for _ in range(300)]
    fps = sorted(set(fps))
    a, b = simhash.tree_links(fps, 3)
    assert {(max(x, y), min(x, y)) for x, y in zip(a, b)} == {
        (i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3}


# suffix dedup -------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("memory", [1 << 20, 3])
def test_induced_sorting(tmp_path, memory):
    rng = random.Random(memory)
    for _ in range(60):
        letters = rng.choice([b"a", b"ab", b"abc", bytes(range(256))])
        ss = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 8))]
        w = rng.choice([1, 2, 5, 17])
        from collections import Counter
        c = Counter(s[i:i + w] for s in ss for i in range(len(s) - w + 1))
        got = induced.repeated(ss, w, str(tmp_path), memory)
        assert [g.tolist() for g in got] == [[i for i in range(len(s) - w + 1) if c[s[i:i + w]] > 1] for s in ss]
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("width", [12, 40, 400])
def test_suffix_dedup(spark, odd, width):
    rng = random.Random(width)
    shared = ["".join(rng.choice("abcd ") for _ in range(rng.choice([width - 1, width, 3 * width]))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(["é", "x", "yy"]) if rng.random() < .3 else rng.choice(shared) for _ in range(6))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "ab" * width), (103, "q" * (width + 3)), (104, rows[0][1]), (104, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(clash(df, "n_spans", *HELPERS), width=width, with_text=True).collect()
    key = lambda i, r: (i, *r)
    want = sorted(key(i, r) for (i, _), r in zip(rows, brute.repeats([t for _, t in rows], width)))
    assert sorted(key(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want
    assert all(r.n_bytes - r.n_removed == len(r.kept_text) for r in got)
    assert suffix_dedup.remove_repeats(odd).count() == len(ODD) and suffix_dedup.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("splits", [0, 1, 4])
def test_crowded_names_are_split(spark, splits, monkeypatch):
    """One short passage in many surroundings: no shard holds more of a name than ``name_bytes``; results stay."""
    rng, width, most = random.Random(9), 40, 2000
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    short, long_, near = word(34), word(90), word(39)
    rows = [(i, word(60) + rng.choice([short, near]) + word(60) + (long_ if i % 9 == 0 else "") + word(20)) for i in range(150)]
    rows += [(200, rows[0][1]), (201, None), (202, rows[3][1][20:140] + "end"), (203, "q" * 100)]
    sizes = spark.sparkContext.accumulator(0)
    inner = suffix_dedup.sort_shards

    def seen(df, *a):
        per = df.dropDuplicates(["name", "s1", "s2"]).groupBy("name").agg(F.sum(F.length("body")).alias("n"))
        sizes.add(per.agg(F.max("n")).first()[0] or 0)
        return inner(df, *a)
    monkeypatch.setattr(suffix_dedup, "sort_shards", seen)
    monkeypatch.setattr(suffix_dedup, "SPLITS", splits)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df, width=width, name_bytes=most).collect()
    want = brute.repeats([t for _, t in rows], width)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((i, *r) for (i, _), r in zip(rows, want))
    assert sum(r[1] for r in want) > 0 and sizes.value <= most
    sizes.value = 0
    suffix_dedup.remove_repeats(df, width=width).count()
    assert sizes.value > most


# embeddings ---------------------------------------------------------------------------------------------------

def vectors(seed, n, dim):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, dim))
    out = [base[i % len(base)] + rng.standard_normal(dim) * rng.choice([0, .1, .25, .33, 1]) for i in range(n)]
    return [(i, v.tolist()) for i, v in enumerate(out)]


@pytest.mark.parametrize("dim,rows_a_cell", [(64, 8192), (10, 7), (3, 50)])
def test_embeddings(spark, dim, rows_a_cell, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", rows_a_cell)
    rows = vectors(dim, 300, dim) + [(1000, None), (1001, []), (1002, [0.0] * dim), (1003, [float("nan")] * dim),
                                     (1004, [None] + [1.0] * (dim - 1)), (1005, [1.0] * (dim + 1)), (1006, [float("inf")] * dim)]
    rows += [(2000 + i, rows[5][1]) for i in range(20)] + [(3000, [2 * x for x in rows[5][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(clash(df, "kept", "n_links", *HELPERS)).collect()}
    assert got == brute.embeddings(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_chunks_meet_once(spark):
    """Any two chunks of a cell meet in one task, and a vector goes to half of its cell's tasks and one more (was: to all)."""
    rows = [(c, n) for n in range(1, 10) for c in range(n)]
    got = spark.createDataFrame(rows, "chunk int, chunks int").select("*", embedding_dedup.tasks_of("chunk", "chunks").alias("at")).collect()
    for n in range(1, 10):
        met = sorted(tuple(sorted((r.chunk, a))) for r in got if r.chunks == n for a in r["at"])
        assert met == [(a, b) for a in range(n) for b in range(a, n)]
        assert max(len(r["at"]) for r in got if r.chunks == n) <= n // 2 + 1


def test_embedding_chunks_in_batches(spark, monkeypatch):
    """Small held chunks, batches that end within a chunk, chunks that the hash leaves empty."""
    for name, value in (("CELL_ROWS", 3), ("HELD_ROWS", 3), ("AT_ONCE", 5), ("SLICE", 4)):
        monkeypatch.setattr(embedding_dedup, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rows = vectors(2, 40, 2)
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute.embeddings(rows)


# warc ---------------------------------------------------------------------------------------------------------

def test_warc(spark, tmp_path):
    rows = [(1, "http://a/b c\r\nx", "<p>é</p>"), (2, None, None), (3, "", ""), (4, "u", "<p>é</p>"), (4, "u", "<p>é</p>"),
            (5, "v", "a\r\n\r\nWARC/1.1\r\n\r\n" * 3), (6, "w", LONG), (None, "z", LONG)]
    df = clash(spark.createDataFrame(rows, "page_id long, url string, html string"), "record_type")
    got = warc.round_trip(df, folder=str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert by[1][0].record_type == "revisit" and by[1][0].refers_to == 4 and [r.record_type for r in by[4]] == ["response"] * 2
    assert by[2][0].refers_to == 3 and by[2][0].payload_bytes == 0
    assert by[None][0].refers_to == 6 and by[None][0].payload_bytes == len(LONG)
    for i, _, h in rows:
        assert all(r.payload_digest == warc.digest((h or "").encode()) and r.payload_bytes == len((h or "").encode()) for r in by[i])
    big = warc.round_trip(df, min_revisit=1).where("page_id = 2").first()
    assert big.record_type == "response"
    assert warc.round_trip(df.limit(0)).count() == 0


# mixing -------------------------------------------------------------------------------------------------------

def test_mixing(spark, odd):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    got = mixing.mix(docs)
    per = got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max(F.col("taken") - 3 * F.col("size")).alias("over"),
                                    F.max("size").alias("big")).collect()
    assert all(abs(r.t - r.g) <= r.big and r.over <= 0 for r in per)
    assert abs(sum(r.g for r in per) - got.agg(F.sum("size")).first()[0]) < 1e-3
    again = mixing.mix(docs.repartition(7))
    assert sorted((r.doc_id, r.taken) for r in got.collect()) == sorted((r.doc_id, r.taken) for r in again.collect())
    r = mixing.mix(clash(odd, "size", "target", *HELPERS)).collect()
    assert len(r) == len(ODD) and all(x.more == 1 and 0 <= x.taken <= 3 * x.size for x in r)
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_boundary_is_refined(spark):
    """Few bits in the first histogram: the boundary bucket holds many documents and is summed again."""
    old = mixing.BITS
    try:
        mixing.BITS = 1
        slim = spark.range(2000).select(F.lit("a").alias("source"), (F.col("id") % 32).alias("hash"), F.lit(1).alias("size"))
        plan = spark.createDataFrame([("a", 2000, 700.0)], "source string, source_size long, target double")
        cut = mixing.thresholds(slim, plan).first().cut
        assert abs(slim.where(F.col("hash") < cut).count() - 700) <= 63
    finally:
        mixing.BITS = old


def test_mixing_meets_targets_without_ids(spark):
    """Rows of one id, or of none, are told apart by their texts."""
    rng = random.Random(6)
    rows = [(None if i % 2 else 7, " ".join(f"w{rng.random()}" for _ in range(rng.randint(5, 30))), "abc"[i % 3]) for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    per = got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 30 for r in per)


# pipeline -----------------------------------------------------------------------------------------------------

def test_pipeline_keeps_one_row_of_a_component(spark):
    """Repeated and null ids: two texts under one id are two documents, and null ids have copies like others."""
    import corpus_pipeline as P
    rng = random.Random(8)
    a, b, c, d = (" ".join(f"w{rng.random()}" for _ in range(60)) for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (2, b), (3, c), (None, c), (None, d), (None, d), (None, None), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], DOC)
    got = P.dedup_simhash(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (1, b), (3, c), (None, d), (5, None)], key=str)


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as P
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    cols, step = docs.columns, docs
    for name, f in P.STAGES[:4]:
        before = step
        step = f(spark, before, "/root/testdata/sf0.01").cache()
        assert step.columns == cols and step.count() > 0, name
        old, new = {r.doc_id: r.text for r in before.collect()}, [(r.doc_id, r.text) for r in step.collect()]
        if name == "SimHash near-dedup":
            assert {d for d, _ in new} == {c for _, c in brute.simhash(list(old.items())).values()} and len(new) == len(dict(new))
        if name == "line dedup":
            assert len(new) == len(old)
        if name != "line dedup" and name != "quality rules":
            assert all(old[d] == t for d, t in new)
    last = P.STAGES[4][1](spark, step, "/root/testdata/sf0.01").collect()
    assert sum(r.length for r in last) == sum(len(brute.tokens(r.text, 2)) for r in step.collect())
    assert len(P.run(spark, "/root/testdata/sf0.001").collect()) > 0
