"""Whitening, byte-level BPE and the prefix trie against dense algebra, tiktoken and brute force, with edge cases."""

import hashlib
import random
import sys
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from pulselake.llm import byte_bpe, prefix_trie, whitening

CLASHING = ("x", "y", "d", "n", "ids", "starts", "m", "j", "h", "k", "rep", "said", "depth", "bytes", "part", "base")

# ---- 11 whitening


def whitened(spark, rows, kind="array<double>"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").withColumns({c: F.lit("x") for c in CLASHING})
    return whitening.whiten(df).collect()


def check_against_dense(got, ids, vectors, n_components=4):
    x = np.floor(256 * np.asarray(vectors, float)).astype(int)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    mean = fit.mean(axis=0)
    cov = (fit - mean).T @ (fit - mean) / n
    e, c = np.linalg.eigh(cov)
    e, c = e[::-1], c[:, ::-1]
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(n_components):
        w = (x - mean) @ c[:, k] / np.sqrt(e[k])
        found = np.array([by[i, k + 1].whitened for i in ids])
        assert np.allclose(found * np.sign(found @ w), w, atol=1e-8)
        assert all(np.isclose(by[i, k + 1].explained, e[k] / e.sum(), rtol=1e-8) for i in ids)
    for i, row in zip(ids, x):
        r = by[i, 1]
        assert r.n == n and r.deviation == int(((n * row - total) ** 2).sum()) and r.deviation_text == str(r.deviation)
    assert max(r.identity_error for r in got) < 1e-9


def test_whitening_matches_dense_algebra(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 12)) @ np.diag(np.linspace(3, 0.2, 12))
    x = np.concatenate([x, x[:40], np.repeat(x[:1], 100, axis=0)])  # copies count once
    got = whitened(spark, [(k, v.tolist()) for k, v in enumerate(x)])
    assert len(got) == 4 * len(x)
    check_against_dense(got, range(len(x)), x)


def test_whitening_drops_and_separates(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 6)), rng.normal(size=(30, 3))
    odd = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [])]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(100 + k, v.tolist()) for k, v in enumerate(y)] + odd + [(None, x[0].tolist()), (0, x[0].tolist())]
    got = whitened(spark, rows)
    assert {r.vec_id for r in got} == {*range(50), *range(100, 130), None}
    assert sum(r.vec_id == 0 for r in got) == 8 and sum(r.vec_id is None for r in got) == 4
    check_against_dense([r for r in got if (r.vec_id or 0) < 100], range(50), x)
    check_against_dense([r for r in got if (r.vec_id or 0) >= 100], range(100, 130), y, 3)


def test_whitening_without_spread(spark):
    for rows, size in (([(1, [2.0, 2.0])], 2), ([(1, [1.0, 1.0]), (2, [1.0, 1.001])], 4)):
        got = whitened(spark, rows)
        assert len(got) == size and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error == 0 for r in got)
    line = whitened(spark, [(k, [float(k), 2.0 * k, 0.0, 0.0, 0.0]) for k in range(10)])  # rank one
    assert [r.whitened is None for r in sorted(line, key=lambda r: (r.vec_id, r.component))][:4] == [False, True, True, True]
    assert np.isclose(sum(r.explained for r in line if r.vec_id == 0), 1)
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_whitening_of_repeated_eigenvalues(spark):
    axes = np.concatenate([np.eye(8), -np.eye(8)]) * np.array([3, 3, 3, 2, 2, 2, 2, 1])  # eigenvalues of multiplicity 3 and 4
    got = whitened(spark, [(k, v.tolist()) for k, v in enumerate(axes)])
    share = sorted({(r.component, round(r.explained, 9)) for r in got})
    e = np.array([9, 9, 9, 4, 4, 4, 4, 1]) / 44
    assert np.allclose([s for _, s in share], e[:4]) and max(r.identity_error for r in got) < 1e-9


def test_whitening_of_wide_numbers(spark):
    got = whitened(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])])
    r = {(r.vec_id, r.component): r for r in got}
    top, low = 2**63 - 1, -(2**63)
    total = [top + low, 256 + 128]
    for k, x in ((1, (top, 0)), (2, (low, 256)), (3, (0, 128))):
        want = sum((3 * a - s) ** 2 for a, s in zip(x, total))
        assert r[k, 1].deviation_text == str(want) and r[k, 1].deviation == (want if want < 2**63 else None)


# ---- 12 byte-level BPE


def plain_encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.VOCABULARY), special_tokens={})


def hard_texts():
    rng, parts = random.Random(0), ["aab aaa", " ", "'s", "'ll", "the", "\n", "\r\n", "é", "日本", "🎉", "́", "0", "½", "²", "\t", "\x1c", "\x85", "　", "<|endoftext|>", "\x00"]
    made = []
    for _ in range(600):
        some = [rng.choice(parts) if rng.random() < 0.7 else chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x10000, 0x1FFFF), rng.randrange(0x30000, 0x34000)])) for _ in range(rng.choice([3, 30, 200]))]
        made.append("".join(some))
    return made + ["", "a" * 100_000, "ab" * 50_000, " " * 50_000, "word " * 1000, "é" * 50_000, "!?" * 50_000]


def test_ids_equal_tiktoken_and_decode_to_the_text(spark):
    texts, plain = hard_texts(), plain_encoding()
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHING})
    got = byte_bpe.decode(byte_bpe.encode(df).withColumnRenamed("text", "given")).orderBy("doc_id").collect()
    assert len(got) == len(texts) + 1 and got[-1].ids == [] and got[-1].bytes == b"" and got[-1].given is None
    for r, text in zip(got, texts):
        assert r.ids == plain.encode_ordinary(text)
        assert r.text == text and bytes(r.bytes) == text.encode() and r.k == "x"
        width = [len(plain.decode_single_token_bytes(i)) for i in r.ids]
        at, char = np.cumsum([0, *width]), np.cumsum([b & 0xC0 != 0x80 for b in text.encode()]) - 1
        assert r.starts == [char[a] for a in at[:-1]] and r.ends == [char[b - 1] + 1 for b in at[1:]]


def test_classes_are_the_ones_of_the_splitter():
    """Every character alone and before an apostrophe is cut as tiktoken cuts it."""
    codec = byte_bpe.Codec(byte_bpe.read_ranks(byte_bpe.VOCABULARY), tuple(byte_bpe.explicit(public_tokenizers.PATTERN, m) for m in (0xFFFF, sys.maxunicode)))
    texts = [chr(c) + "'s" for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    plain = plain_encoding()
    for at in range(0, len(texts), 50_000):
        some = texts[at : at + 50_000]
        assert [x.tolist() for x in codec.encode(some)] == [plain.encode_ordinary(t) for t in some]


def test_a_long_text_is_one_text(spark, monkeypatch):
    text = "".join(hard_texts()[:300])
    monkeypatch.setattr(byte_bpe, "LISTED", 100)
    monkeypatch.setattr(byte_bpe, "MEMO_PIECES", 50)
    codec = byte_bpe.Codec(byte_bpe.read_ranks(byte_bpe.VOCABULARY), tuple(byte_bpe.explicit(public_tokenizers.PATTERN, m) for m in (0xFFFF, sys.maxunicode)))
    for _ in range(2):
        assert codec.encode([text, "short"])[0].tolist() == plain_encoding().encode_ordinary(text)


def test_decoding_odd_ids(spark):
    ranks = byte_bpe.read_ranks(byte_bpe.VOCABULARY)
    half = [ranks[b"\xf0"], ranks[b"\x9f"]]
    rows = [(1, None), (2, []), (3, [-1]), (4, [50256]), (5, [10**9]), (6, half), (7, [None, 1])]
    got = {r.doc_id: r for r in byte_bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    assert [got[k].bytes is None for k in range(1, 8)] == [True, False, True, True, True, False, True]
    assert bytes(got[6].bytes) == b"\xf0\x9f" and got[6].text == "�" and got[2].text == ""
    assert byte_bpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bpe_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    plain, got = plain_encoding(), {r.doc_id: r for r in byte_bpe.op12_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for d in docs:
        ids = plain.encode_ordinary(d.text or "")
        sha = lambda t: hashlib.sha256(t).hexdigest()
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((d.text or "").encode()))


# ---- 13 prefix trie


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    path = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        path[c] = tuple(convs.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:])
    members, children = {}, {}
    for c, p in path.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) or 1
        saved[p] = (len(members[p]) - 1) * len(p[-1][1] if p else "") + sum(saved[x] for x in below)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if path[c] == p).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], ends(p)) for p, m in members.items()), key=str)


def made_conversations(seed):
    rng, rows = random.Random(seed), []
    for c in [*range(0, 260), *range(-120, -60), 700, 950, 951, 10**12, 10**12 + 1]:
        for turn in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "", None, "héllo " * 3])))
    return rows + [(5, 0, "user", "a")] * 3 + [(None, 0, "user", "a"), (400, 1, "user", "x" * 100_000), (401, 1, "user", "x" * 100_000), (402, 0, "us", "era"), (403, 0, "user", "a")]


@pytest.mark.parametrize("small", [False, True])
def test_trie_matches_brute_force(spark, monkeypatch, small):
    if small:  # pieces, ranges and a sketch so small that all of them overflow
        for name, size in (("PIECE", 3), ("RANGE", 4), ("LEAST_BITS", 4), ("MOST_BITS", 5)):
            monkeypatch.setattr(prefix_trie, name, size)
    rows = made_conversations(int(small))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in CLASHING}).repartition(5)
    got = sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=str)
    assert got == brute_trie(rows)


def test_trie_of_one_long_conversation_and_its_copy(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 64)
    rows = [(c, t, "user", f"turn {t}") for c in (100, 200, 301) for t in range(500)]
    got = sorted((tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    assert got == brute_trie(rows)


def test_tails_are_not_shuffled(spark, monkeypatch):
    """Conversations that share nothing leave no prefix to group."""
    grouped, write = [], prefix_trie.Scratch.write

    def counted(self, df, name="t"):
        out = write(self, df, name)
        if name == "nodes":
            grouped.append(out.count())
        return out

    monkeypatch.setattr(prefix_trie.Scratch, "write", counted)
    rows = [(100 * c, t, "user", f"{c} {t}") for c in range(50) for t in range(20)]
    assert prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() == 1001
    assert grouped == [0]


def test_trie_of_turnless_and_no_conversations(spark):
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)  # its only turn goes, and there is no conversation 0
    df = spark.createDataFrame([(c, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    sha = hashlib.sha256(str(c).encode()).hexdigest()
    assert [tuple(r) for r in prefix_trie.trie(df).collect()] == [(c, 0, None, 1, 0, 1, 0, sha)]
    assert prefix_trie.trie(df.where("false")).count() == 0
    assert prefix_trie.trie(df.withColumn("conv_id", F.lit(None).cast("long"))).count() == 0


def test_trie_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    got = sorted((tuple(r) for r in prefix_trie.op13_prefix_trie(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == sorted(con.execute(prefix_trie.ORACLE_SQL).fetchall(), key=str)
