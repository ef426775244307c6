"""Spelling variants, BPE coding and the filter audit against plain versions, on small and odd tables."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from editlens.llm import bpe, filter_audit, spelling
from editlens.llm.queries import QUERIES
from editlens.session import read_table

from . import brute
from .test_llm import HELPERS, ODD, SF, clash, empty, odd  # noqa: F401


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# spelling variants --------------------------------------------------------------------------------------------

def reduced(word, symbols):
    return tuple(ord(c) if symbols is None else ord(c) % symbols + 1 for c in word)


def code(symbols):
    c = 0
    for s in symbols:
        c = (c * spelling.BASE + s) % (1 << 64)
    return c if c < 1 << 63 else c - (1 << 64)


@pytest.mark.parametrize("symbols", [2, 6, None])
def test_neighbourhoods_are_whole(symbols):
    rng = random.Random(symbols or 0)
    words = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    assert spelling.codes(words, symbols).tolist() == [code(reduced(w, symbols)) for w in words]
    letters = spelling.LETTERS if symbols is None else range(1, symbols + 1)
    for full in (False, True):
        at, near = spelling.neighbours(words, symbols, full)
        want = set()
        for i, w in enumerate(words):
            r = reduced(w, symbols)
            for j in range(len(r)):
                want.add((i, code(r[:j] + r[j + 1:])))
                want |= {(i, code(r[:j] + (t,) + r[j + 1:])) for t in letters if (t != r[j] if full else t > r[j])}
            if full:
                want |= {(i, code(r[:j] + (t,) + r[j:])) for j in range(len(r) + 1) for t in letters}
        assert sorted(zip(at.tolist(), near.tolist())) == sorted(want)


@pytest.mark.parametrize("max_bucket", [64, 3, 1])
def test_variants_against_brute_force(spark, max_bucket):
    """Few letters make crowded reduced words, which meet again over finer alphabets."""
    rng = random.Random(7)
    docs = [(i if i % 9 else None, " ".join("".join(rng.choice("aàgmB-") for _ in range(rng.randint(2, 6))) for _ in range(60)))
            for i in range(60)]
    docs += [(900 + i, "gambbag " * 30 + "gambag gambbgg") for i in range(20)] + [(1, None), (2, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    vocab = spelling.vocabulary(clash(df, "word", "n", "run"), min_length=2, misspell=5)
    want = brute.spelling(docs, min_length=2, misspell=5)
    assert len(want) > 200 and any(r[1] for r in want)
    assert rows(spelling.group_variants(vocab, max_bucket=max_bucket)) == sorted(want, key=repr)


def test_variants_of_odd_tables(spark, odd):  # noqa: F811
    docs = [(r[0], r[1]) for r in ODD]
    got = rows(spelling.group_variants(spelling.vocabulary(clash(odd, *HELPERS), misspell=31)))
    assert got == sorted(brute.spelling(docs), key=repr)
    assert spelling.group_variants(spelling.vocabulary(empty(spark))).count() == 0


def test_roots_follow_forms(spark):
    """Chains of forms end at the same word, ties go to the smaller word."""
    vocab = [("aaaaaaa", 1), ("aaaaaab", 10), ("aaaaabb", 100), ("aaaabbb", 1000), ("zzzzzzza", 1), ("zzzzzzzb", 10), ("zzzzzzzc", 10), ("alonely", 5)]
    got = {r.word: r for r in spelling.group_variants(spark.createDataFrame(vocab, "word string, n long")).collect()}
    assert {got[w].root for w in ("aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb")} == {"aaaabbb"}
    assert got["aaaaaaa"].form == "aaaaaab" and got["aaaaaaa"].form_n == 10 and got["aaaabbb"].form is None
    assert got["zzzzzzza"].form == "zzzzzzzb" and got["zzzzzzza"].n_near == 2
    assert (got["alonely"].form, got["alonely"].root, got["alonely"].n_near) == (None, "alonely", 0)


# BPE ----------------------------------------------------------------------------------------------------------

SIGNS = [*"aaabcdeé ñÜß'’s\n\t<|>.!12½٣ΑΣ中文", "\u0301", "\u2003", "İ", "ı", "ǅ", "ﬁ", "\U0001F600", "\x00", "\x7f", "\u200b", "\u212a",
         "<|endoftext|>", "<|startoftext|>"]


def some_texts():
    rng = random.Random(11)
    out = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return out + [None, "", "a" * 3000, "ab" * 2000, "<|endoftext|>x<|startoftext|><|endoftext|> y", "don't I'LL he'S 'S"] + [r[1] for r in ODD]


def test_coder_equals_library():
    from tokenizers import Tokenizer
    library, coder, texts = Tokenizer.from_file(bpe.public_path()), bpe.Coder(bpe.public_path()), some_texts()
    ids, off = coder.encode(pa.array(texts))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want
    decoded = coder.decode(pa.LargeListArray.from_arrays(pa.array(off), pa.array(ids))).to_pylist()
    assert decoded == [library.decode(w, skip_special_tokens=False) for w in want]
    assert coder.merges.in_order
    coder.merges.in_order = False                   # one place a round gives the same
    assert np.array_equal(coder.encode(pa.array(texts))[0], ids)


def test_merges_out_of_order():
    """A pair may rank before the merge that makes one of its symbols: the lowest rank, leftmost first."""
    rng = random.Random(5)
    for _ in range(200):
        pairs, made = {}, 3
        for _ in range(12):
            p = (rng.randrange(made), rng.randrange(made))
            if p not in pairs:
                pairs[p] = made
                made += 1
        order = [(a, b, m) for (a, b), m in pairs.items()]
        rng.shuffle(order)
        rank = {(a, b): (i, m) for i, (a, b, m) in enumerate(order)}
        words = [[rng.randrange(3) for _ in range(rng.randint(1, 12))] for _ in range(20)]
        want = []
        for w in words:
            w = list(w)
            while hits := [(rank[p][0], i) for i, p in enumerate(zip(w, w[1:])) if p in rank]:
                i = min(hits)[1]
                w[i:i + 2] = [rank[w[i], w[i + 1]][1]]
            want.append(w)
        ids, n = bpe.Merges(order, made).run(np.array(sum(words, []), np.int64), np.array([len(w) for w in words]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_bpe_tables(spark, odd):  # noqa: F811
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(bpe.public_path())
    docs = spark.createDataFrame(list(enumerate(some_texts())), "doc_id long, text string")
    coded = bpe.encode(clash(docs, "ids", *HELPERS))
    got = bpe.decode(coded.withColumn("decoded", F.lit(1)))
    assert got.columns[-1] == "decoded" and "text" not in got.columns
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(some_texts())}
    for r in got.collect():
        assert r.ids == want[r.doc_id] and r.decoded == library.decode(r.ids, skip_special_tokens=False) and r.more == 1
    broken = spark.createDataFrame([(1, None), (2, []), (3, [320, -1, None, 10 ** 9, 320])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(broken).orderBy("doc_id").collect()] == ["", "", library.decode([320, 320])]
    assert bpe.decode(bpe.encode(empty(spark))).count() == 0


def test_bpe_query(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(bpe.public_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = {r.doc_id: r.text for r in read_table(spark, SF, "documents").collect()}
    got = QUERIES["op12_bpe"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


# filter audit -------------------------------------------------------------------------------------------------

def test_plain_changes():
    from itertools import permutations
    for n in range(6):
        order, seen = list(range(n)), [tuple(range(n))]
        for k in filter_audit.plain_changes(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(permutations(range(n)))


def test_swaps_keep_the_counts():
    rng = random.Random(2)
    for _ in range(20):
        cells = {m: (rng.randint(0, 3), rng.randint(0, 1), 0) for m in range(32)}
        cells = {m: c for m, c in cells.items() if any(c)}
        d, order = filter_audit.Diagram(), list(range(5))
        root = d.build(cells, 5)
        for k in filter_audit.plain_changes(5):
            root = d.swap(root, k, order)
            order[k], order[k + 1] = order[k + 1], order[k]
            for m in range(32):
                at = root
                for v in order:
                    assert at == 0 or d.node[at][0] == v
                    at = d.node[at][1 + (m >> v & 1)]
                assert d.counts[at] == cells.get(m, (0, 0, 0))


def test_audit_against_brute_force(spark, odd):  # noqa: F811
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(["Aa", "b", "C", "dd", "e$", "ff", "g", "hh", "i", "jj"]) + (str(rng.randint(0, 9)) if rng.random() < 0.5 else "")
                            for _ in range(rng.choice([3, 60, 80])))
    docs = [(i, text(), rng.choice(["x", "y", None, ""])) for i in range(120)]
    docs += [(200 + i, docs[i % 7][1], rng.choice(["x", None])) for i in range(60)]            # copies, in parts of their own too
    docs += [(5, docs[5][1], "x"), (5, docs[9][1], "y"), (None, docs[3][1], "x"), (None, docs[3][1], "x"), (300, None, "y"), (301, "", "y")]
    docs += [(r[0], r[1], r[3]) for r in ODD]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 230, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None)]
    df = clash(spark.createDataFrame(docs, "doc_id long, text string, source string"), "part", "mask", "sha", "id", "n", "good", *HELPERS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = rows(filter_audit.audit_texts(df, lab))
    want = sorted(brute.audit(docs, labels), key=repr)
    assert len(got) == 600 * len({d[2] or "" for d in docs}) and got == want
    assert filter_audit.audit_texts(empty(spark), lab).count() == 0
    assert {r[3 + 5] for r in rows(filter_audit.audit_texts(df, lab.limit(0)))} == {0}
