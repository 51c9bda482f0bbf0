"""The ten operators against brute force, round trips and edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.llm import chat_format, decontaminate, embedding_dedup, language_id, license_scan, mixing, ngram_join, pii, quality, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def documents(spark, texts, extra=False):
    """Documents with ids from 0; with extra also columns whose names clash with the operators' own."""
    df = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)], DOCS)
    return df.withColumns({c: F.lit("x") for c in ("n", "sig", "score", "token", "id", "u", "v", "size", "p", "item", "block", "key", "base", "n_words", "row")}) if extra else df


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, vocabulary, n))


# ---- 1 embeddings


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(120, 16))
    near = base[:60] + 0.05 * rng.normal(size=(60, 16))
    group = base[0] + 0.01 * rng.normal(size=(40, 16))
    x = np.concatenate([base, near, group, base[:5], 2 * base[:3]]).astype(np.float32)
    label = np.concatenate([np.arange(120) % 3, np.arange(60) % 3, np.zeros(40), np.arange(5) % 3, np.arange(3) % 3]).astype(int)
    rows = [(k, v.tolist(), int(lab)) for k, (v, lab) in enumerate(zip(x, label))]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, x[0].tolist(), None), (904, [1.0], 0), (905, [None] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    found = sum(got[k].n_links for k in range(len(x)))
    assert found >= 0.9 * link.sum() and all(got[k].n_links <= link[k].sum() for k in range(len(x)))
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(900, 906))
    assert got[180].component_id == 0 and not got[180].kept


def test_large_bucket_is_cut_and_all_pairs_compared(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(1)
    x = np.ones((50, 8)) + 0.01 * rng.normal(size=(50, 8))
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(df).collect()
    assert {r.n_links for r in got} == {49} and {r.component_id for r in got} == {0}


def test_each_vector_length_is_its_own_group(spark):
    rows = [(10, [1.0, 0.0], 1), (11, [1.0, 0.001], 1), (12, [1.0, 0.0, 0.0], 1), (13, [1.0, 0.0, 0.01], 1), (14, [0.0, 1.0, 0.0], 1), (15, [2.0], 1), (16, [3.0], 1), (17, [-3.0], 1), (18, [0.1], 1), (19, [0.1], 2), (20, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("d", "v", "t", "key", "component", "n")})
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {10: (1, 10), 11: (1, 10), 12: (1, 12), 13: (1, 12), 14: (0, 14), 15: (2, 15), 16: (2, 15), 17: (0, 17), 18: (2, 15), 19: (0, 19), 20: (0, 20)}


def test_repeated_vector_ids_and_text_labels(spark):
    rows = [(1, [1.0, 2.0], "")] * 3 + [(2, [1.0, 2.0], ""), (2, [1.0, 9.0], ""), (3, [1.0, 2.0], "b"), (None, [1.0, 2.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == {(1, 1, 1): 3, (2, 1, 1): 2, (3, 0, 3): 1, (None, 0, None): 1}


@pytest.mark.parametrize("width", [6, 20])
def test_recall_at_the_widest_substrings(spark, monkeypatch, width):
    monkeypatch.setattr(embedding_dedup.Codes, "width", lambda self, dim: width)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 64))
    near = base + 0.17 * rng.normal(size=base.shape)  # cosines about the threshold
    x = np.concatenate([base, near])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = int((u @ u.T >= 0.98).sum()) - len(x)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = sum(r.n_links for r in embedding_dedup.near_duplicates(df).collect())
    print(f"width {width}: {found} of {links} links")
    assert links > 200 and found <= links and found >= 0.9 * links


def test_no_embeddings(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(df).count() == 0


# ---- 2 language


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs)
    got = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) >= 0.95
    odd = language_id.predict(documents(spark, [None, "", "12 34 !", "the and of"], True), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and all(0 <= r.score <= 1 for r in odd)
    assert language_id.fit(docs.where("false")) is None
    assert language_id.predict(docs.limit(2), None).first().lang_pred == "und"
    assert language_id.keep_recognised(docs, model).columns == docs.columns


def test_language_model_matches_plain_sets():
    """Kernel by Python sets, Nyström map and ridge by plain solves, against the model's batched products."""
    rng = np.random.default_rng(2)
    letters = {"x": "abcdefgh ", "y": "efghijkl ", "z": "ijklmnop "}
    texts, labels = [], []
    for k in range(60):
        lang = "xyz"[k % 3]
        texts.append("".join(rng.choice(list(letters[lang]), 60)).encode())
        labels.append(lang)
    grams = [{t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)} for t in (re.sub(rb" +", b" ", t) for t in texts)]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    present = np.stack([language_id.gram_set(t) for t in texts])
    unit = language_id._unit(present)
    want = np.array([[kernel(a, b) for b in grams] for a in grams])
    off = np.abs(unit @ unit.T - want)  # two n-grams in a hundred share a hashed place
    assert off.mean() < 0.02 and off.max() < 0.1
    model = language_id.Model(present, np.array(labels))
    assert model.languages == ["x", "y", "z"] and len(model.landmarks) == 60
    k_ll = (unit @ unit.T).astype(float)
    values, vectors = np.linalg.eigh(k_ll)
    ok = values > 1e-6 * values.max()
    z = np.hstack([k_ll @ vectors[:, ok] / np.sqrt(values[ok]), np.ones((60, 1))])
    y = np.where(np.array(labels)[:, None] == np.array(["x", "y", "z"])[None, :], 1.0, -1.0)
    a = z.T @ z / 20
    w = np.linalg.solve(a + language_id.RIDGE * np.trace(a) / len(a) * np.eye(len(a)), z.T @ y / 20)
    best, score = model.predict(present)
    assert best.tolist() == (z @ w).argmax(axis=1).tolist() == [0, 1, 2] * 20
    assert ((score > 0) & (score <= 1)).all()


def test_language_of_repeated_ids_and_rows(spark):
    rows = [(1, "der die das und", "de"), (1, "the of and", "en"), (3, "the of and to", "en"), (3, "the of and to", "en"), (6, "der und die", "de")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    got = language_id.predict(df, model).distinct().collect()
    assert {r.lang_pred for r in got} <= {"de", "en"} and len(got) == len({(r.doc_id, r.lang_pred, r.score) for r in got})


def test_gram_set_covers_the_whole_text():
    a, b = b"abc " * 400_000 + b"zq", b"abc " * 400_000
    assert (language_id.gram_set(a) != language_id.gram_set(b)).any()


# ---- 3 chat


def test_chat_round_trip(spark):
    hostile = "\\### Assistant: </turn> ok \\"
    rows = [(1, 0, "user", hostile), (1, 1, "assistant", "é\n" + hostile), (1, 2, "tool", "x\ny"), (2, 0, None, None), (None, 0, "assistant", "a" * 10000), (1, 1, "assistant", "é\n" + hostile)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    got = {r.conv_id: r for r in chat_format.digests(df).collect()}
    order = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == 1))
    assert got[1].n_turns == 4
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in order).encode()).hexdigest()
    said = "".join(x for _, r, x in order if r == "assistant")
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[2].n_turns == 1 and got[2].loss_chars == 0 and got[None].loss_chars == 10000
    assert chat_format.digests(df.where("false")).count() == 0
    assert chat_format.unescape(chat_format.escape(hostile)) == hostile


def test_mask_marks_the_assistant_only():
    tokens, mask = chat_format.assemble("assistant", np.array([5, 6, 7], np.int32), True)
    assert tokens[mask].tolist() == [5, 6, 7]
    assert not chat_format.assemble("user", np.array([5], np.int32), False)[1].any()


# ---- 4 URLs


def test_urls_match_brute_force(spark):
    urls = [None, "", "nope", "http://a.NET/x?q", "http://a.net", "https://x.example.net/en/1#t", "https://example.net/en/", "https://badexample.net/en/", "http://q.example.com/de/2", "http://z.org/fr/1", "http://z.org/x.net/fr/", "ftp://spam-farm.example.org", "http://net/" + "a" * 20000, "http://h?x://b.net/"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("x"))
    got = {r.page_id: r for r in url_rules.judge(df).collect()}
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fits = [(len(h + p), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1:] if fits else (None, "block" if "spam-farm" in host else "allow")
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, *rule), u


# ---- 5 mixing


def test_mixing(spark):
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(["w"] * int(n)), "en", None if k % 5 == 4 else f"s{k % 5}", 0) for k, n in enumerate(rng.integers(0, 60, 400))]
    rows += [(1, "w w", "en", "s1", 0), (1, "w w", "en", "s1", 0), (None, None, "en", "s2", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("item", F.lit(1))
    one, two = (sorted(map(tuple, mixing.mix(df).collect()), key=str) for _ in range(2))
    assert one == two and len(one) == len(rows)
    out = mixing.mix(df).toPandas()
    sizes = {s: sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight, target, open_ = dict(zip(order, (5, 2, 1, 5, 2))), {}, set(sizes)
    while True:  # reshare the excess until none is above
        left = sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= set(over)
    out["source"] = out["source"].astype(object).where(out["source"].notna(), None)
    for s in order:
        mine = out[[x == s for x in out["source"]]]
        assert mine["target"].iloc[0] == pytest.approx(target[s]) and mine["source_size"].iloc[0] == sizes[s]
        assert abs(mine["taken"].sum() - target[s]) <= 60
    assert (out["taken"] <= 3 * out["size"]).all() and (out["taken"] % out["size"].clip(lower=1) == 0).all()
    assert mixing.mix(df.where("false")).count() == 0
    assert mixing.mix(df.where("text is null")).first().taken == 0


def test_mixing_spreads_a_hot_id(spark):
    rows = [(7, "a b c", "s0")] * 5000 + [(None, "d e", "s1")] * 3000 + [(k, "x " * (k % 9), "s2") for k in range(100, 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("copies", "place", "h", "hot")})
    out = mixing.mix_documents(df)
    assert {"text", "source", "copies", "taken", "h"} <= set(out.columns) and "mix_place" not in out.columns
    got = out.groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert {r.source: r.n for r in got} == {"s0": 5000, "s1": 3000, "s2": 400}
    assert all(abs(r.taken - r.target) <= 10 and r.most <= 3 for r in got)
    again = Counter((r.doc_id, r.text, r.copies) for r in out.collect())
    assert again == Counter((r.doc_id, r.text, r.copies) for r in mixing.mix_documents(df).collect())


# ---- 6 PII


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TRICKY = [None, "", "a@b.c_d@e.f é😀 x@y.z.w", "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112", "+1 (23) 456-7890 +123 +1 2", "1 " * 9000, "9" * 30000 + "a" * 30000 + " +", "a" * 50000 + "@x.y"]


def test_pii_base_spans(spark):
    df = documents(spark, [*TRICKY, TRICKY[2]], True)
    got = {r.doc_id: r.s for r in pii.find(df).select("doc_id", pii.as_text(F.col("base")).alias("s")).collect()}
    assert all(got[k] == ",".join(base_spans(t)) for k, t in enumerate([*TRICKY, TRICKY[2]]))


def test_pii_of_a_very_long_text_is_linear(spark):
    import time

    began = time.perf_counter()
    ids = [f"id{k}x{k * 7919 % 10007}" for k in range(80_000)]
    mails = [f"u{k}@h{k}.org" for k in range(3_000)]
    text = " ".join(ids) + " " + " ".join(mails)
    df = documents(spark, [text])
    found = pii.find(df).select(F.size("base").alias("n")).first().n
    clean = pii.redact(df).first().text
    assert found == 3_000 and clean.endswith("[EMAIL] [EMAIL]") and clean.count("[EMAIL]") == 3_000
    assert time.perf_counter() - began < 90


def test_pii_empty_table_and_repeated_rows(spark):
    df = documents(spark, ["call +12345678901 now", "call +12345678901 now", None], True)
    assert pii.find(df.where("false")).count() == 0 and pii.redact(df.where("false")).count() == 0
    assert sorted(str(r.text) for r in pii.redact(df).collect()) == ["None", "call [PHONE] now", "call [PHONE] now"]


def test_pii_scoring_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = [(f"p{rng.integers(0, 8)}", f"i{rng.integers(0, 40)}", bool(rng.random() < 0.3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "pattern string, instance string, seed boolean")
    got = {r.pattern for r in pii.trusted_patterns(df, pii.Scratch(spark, "t")).collect()}
    n = Counter((p, i) for p, i, _ in rows)
    seed = {i: max(float(s) for _, j, s in rows if j == i) for _, i, _ in rows}
    edge_seed = {(p, i): max(float(s) for q, j, s in rows if (q, j) == (p, i)) for p, i in n}
    belief = {i: max(v for (_, j), v in edge_seed.items() if j == i) for i in seed}
    for k in range(pii.ROUNDS):
        conf = {p: sum(c * belief[i] for (q, i), c in n.items() if q == p) / (sum(c for (q, _), c in n.items() if q == p) + pii.SMOOTHING) for p, _ in n}
        support = {p: sum(belief[i] >= pii.MIN_CONFIDENCE for q, i in n if q == p) for p in conf}
        sure = {p: c if c >= pii.MIN_CONFIDENCE and support[p] >= pii.MIN_SUPPORT else 0.0 for p, c in conf.items()}
        belief = {i: max(seed[i], 1 - np.prod([max(1 - sure[p], 1e-6) for p, j in n if j == i])) for i in seed}
    assert got == {p for p, c in sure.items() if c > 0}


def test_pii_bootstrap_and_redaction(spark):
    seeds = [f"word token = \"{hashlib.sha1(str(k).encode()).hexdigest()}\" end" for k in range(12)]
    unseen = ["more token = \"9f8e7d6c5b4a39281706a5b4\" end", "TOKEN = \"" + hashlib.sha1(b"x").hexdigest().upper() + "\" end", "the year 1999 and 123456 units"]
    df = documents(spark, seeds + unseen)
    found = {r.doc_id: r.found for r in pii.find(df).collect()}
    assert all(len(found[k]) == 1 for k in range(12)) and len(found[13]) == 1 and not found[14]
    clean = {r.doc_id: r.text for r in pii.redact(df.union(documents(spark, [None]).withColumn("doc_id", F.lit(99).cast("long")))).collect()}
    assert clean[0] == 'word token = "[ID]" end' and clean[14] == unseen[2] and clean[99] is None and len(clean) == 16
    mail = pii.redact(documents(spark, ["write to a.b@c.de now"])).first()
    assert mail.text == "write to [EMAIL] now"


# ---- 7 licences


def test_license_scan(spark):
    long_ = "filler words here " * 3000
    texts = [None, "", "Released under the MIT License.", "MIT!! license MIT-LICENSE", "Licensed under CC BY-NC 4.0.", long_ + "GNU General Public License " + long_, "This work is licensed under the", "the general public"]
    got = {r.doc_id: r for r in license_scan.scan(documents(spark, texts, True)).collect()}
    for k, t in enumerate(texts):
        words = WORD.findall((t or "").translate(LOWER))
        starts = [i for p in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(starts), min(starts, default=None), max(starts, default=None))
    assert got[2].labels == "mit" and got[4].labels == "cc-by-nc" and got[4].base_labels == "" and got[6].labels == "" and got[5].base_labels == "gpl"


def test_license_labels_match_brute_force(spark):
    """Whole templates are found and placed; a template with a repeated phrase is placed right; scattered words are not."""
    rng = np.random.default_rng(4)
    templates = {f"t{k}": [" ".join(f"w{j}" for j in rng.integers(0, 30, rng.integers(5, 15)))] for k in range(12)} | {"twice": ["use copy sell of it and use copy sell for all"]}
    scanner = license_scan.Scanner(templates, {})
    for _ in range(200):
        picked = rng.choice(list(templates), 2, replace=False)
        words = [f"v{j}" for j in rng.integers(0, 50, 20)]
        text = " ".join([*words[:7], templates[picked[0]][0], *words[7:13], templates[picked[1]][0], *words[13:]])
        *_, spans = scanner.scan(text.encode())
        split = text.split()
        whole = {(i, i + len(t.split()) - 1, lab) for lab, (t,) in templates.items() for i in range(len(split)) if split[i : i + len(t.split())] == t.split()}
        assert whole <= {s[:3] for s in spans if s[3] == 1.0}, (text, spans)
    scattered = " ".join(f"{w} filler{k} junk{k} more{k} words{k}" for k, w in enumerate(templates["t3"][0].split()))
    assert not scanner.spans(license_scan.alnum_words(scattered.encode()))


def test_license_empty_table_and_repeated_rows(spark):
    df = documents(spark, ["Released under the MIT License."] * 3, True)
    assert license_scan.scan(df.where("false")).count() == 0
    assert [r.labels for r in license_scan.scan(df).collect()] == ["mit"] * 3


def test_matching_statistics_are_the_longest_suffixes():
    a = license_scan.SuffixAutomaton([[1, 2, 3, 4], [3, 4, 5], [2, 3, 9]])
    text, subs = [1, 2, 3, 9, 3, 4, 5, 7, 2, 3], {tuple(s[i:j]) for s in ([1, 2, 3, 4], [3, 4, 5], [2, 3, 9]) for i in range(4) for j in range(i + 1, 5)}
    for at, length, _ in a.statistics(text):
        best = max((n for n in range(1, at + 2) if tuple(text[at + 1 - n : at + 1]) in subs), default=0)
        assert length == best


# ---- 8 quality


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).toPandas()
    assert ((got["score"] >= 0.3).astype(int) == got["quality"]).mean() >= 0.9
    odd = quality.score(documents(spark, [None, "", "x" * 100000], True), model).collect()
    assert len(odd) == 3 and all(0 <= r.score <= 1 for r in odd)
    assert quality.train(np.zeros((0, len(quality.FEATURES))), np.zeros(0)).score(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]


def test_tree_arrays_match_a_recursive_walk_and_exhaustive_splits(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    y = (x[:, 1] + 0.3 * rng.normal(size=400) > 0.2).astype(float)
    trees = quality.train(x, y)

    def walk(k, row, node=0):
        left = trees.left[k, node]
        return trees.value[k, node] if not left else walk(k, row, left + (row[trees.feature[k, node]] > trees.threshold[k, node]))

    raw = np.array([trees.prior + sum(walk(k, row) for k in range(len(trees.feature))) for row in x[:50]])
    assert np.allclose(trees.score(x[:50]), 1 / (1 + np.exp(-raw)), atol=1e-6)
    # the first split against all thresholds of the bins
    p = y.mean()
    grad, hess = y - p, np.full(len(y), p * (1 - p))
    best = max(
        (grad[low].sum() ** 2 / (hess[low].sum() + quality.L2) + grad[~low].sum() ** 2 / (hess[~low].sum() + quality.L2), f, c)
        for f in range(3) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1]))
        if quality.MIN_LEAF <= (low := x[:, f] <= c).sum() <= len(y) - quality.MIN_LEAF
    )
    assert trees.feature[0, 0] == best[1] and np.isclose(trees.threshold[0, 0], best[2], atol=1e-6)


def test_quality_duplicate_labels_and_empty_tables(spark):
    docs = documents(spark, ["good words here", "BAD!!! $$$ ###"] * 20, True)
    labels = spark.createDataFrame([(k, k % 2 == 0, k) for k in range(40)] + [(0, False, 0)] * 50, "doc_id long, good boolean, n long").select("doc_id", F.col("good").cast("int").alias("quality"))
    model = quality.fit(docs.union(docs), labels)
    assert quality.score(docs.where("false"), model).count() == 0
    assert quality.fit(docs.where("false"), labels).score(np.zeros((1, len(quality.FEATURES)))).tolist() == [0.5]
    assert quality.fit(docs, labels.where("false")).score(np.zeros((1, len(quality.FEATURES)))).tolist() == [0.5]


# ---- 9 decontamination


def brute_hits(text, items):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        m = min(13, len(w))
        wins = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()
        for k in range(len(words) - m + 1):
            if tuple(words[k : k + m]) in wins:
                hit |= set(range(k, k + m))
                found.add(str(i))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("part", [2_000_000, 5])
def test_decontamination(spark, monkeypatch, part):
    monkeypatch.setattr(decontaminate, "PART_WORDS", part)
    items = [(1, prose(1, 40)), (2, prose(2, 13)), (10, "Solo"), (4, "two words"), (5, None), (6, ""), (7, prose(1, 40)), (8, "aa " * 30)]
    texts = [None, "", prose(1, 40), "x " * 5000 + prose(2, 13) + " y" * 5000, prose(3, 50) + " SOLO " + prose(4, 50), "two, words two", prose(1, 40)[:60], "aa " * 50, prose(1, 40)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(1))
    got = {r.doc_id: r for r in decontaminate.scan(documents(spark, texts, True), bench).collect()}
    for k, t in enumerate(texts):
        n, hit, found = brute_hits(t, items)
        r = got[k]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest()), k
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    kept = decontaminate.drop_contaminated(documents(spark, texts), bench).collect()
    assert {r.doc_id for r in kept} == {k for k in got if not got[k].contaminated}
    assert decontaminate.scan(documents(spark, texts), bench.where("false")).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("part", [2_000_000, 1])
def test_contaminated_rows_go_by_their_own_text(spark, monkeypatch, part):
    monkeypatch.setattr(decontaminate, "PART_WORDS", part)
    bench = spark.createDataFrame([(1, "some words of a test"), (None, "words without an id"), (2, "other words")], "item_id long, text string")
    rows = [(5, "clean text"), (5, "some words of a test"), (None, "some words of a test"), (None, "clean"), (6, "clean text"), (7, None), (7, ""), (8, "see words without an id"), (8, "see words without an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x"))
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter({(5, "clean text"): 1, (None, "clean"): 1, (6, "clean text"): 1, (7, None): 1, (7, ""): 1})
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.scan(df, bench).collect())
    assert got == Counter({(5, 2, 0, 0): 1, (5, 5, 5, 1): 1, (None, 5, 5, 1): 1, (None, 1, 0, 0): 1, (6, 2, 0, 0): 1, (7, 0, 0, 0): 2, (8, 5, 4, 0): 2})


# ---- 10 n-gram join


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return [len(s) for s in sets], root


def test_ngram_components(spark):
    rng = np.random.default_rng(0)
    base = [prose(k, 80, 2000) for k in range(12)]
    texts = [None, "", "One two", "one TWO", "a b c d e", *base]
    for k in range(60):  # near copies of varying closeness, chains and hubs
        w = base[k % 12 if k < 30 else 0].split()
        for at in rng.integers(0, len(w), rng.integers(0, 4)):
            w[at] = f"z{rng.integers(0, 50)}"
        texts.append(" ".join(w[: rng.integers(60, 81)]))
    shared = prose(99, 30, 2000)
    texts += [shared + " " + prose(200 + k, 30, 2000) for k in range(10)] + [base[1]] * 5 + [base[2].upper()]
    size, root = brute_components(texts)
    got = {r.doc_id: r for r in ngram_join.near_duplicate_components(documents(spark, texts, True)).collect()}
    assert [got[k].n_shingles for k in range(len(texts))] == size
    assert [got[k].component_id for k in range(len(texts))] == root
    assert len(set(root)) < len(texts) - 20


def test_ngram_pairs_of_a_large_group(spark, monkeypatch):
    """A group of 2,000 near copies makes far fewer pairs than the square of its size."""
    rng = np.random.default_rng(5)
    base, texts = prose(7, 60, 2000).split(), []
    for k in range(2000):
        w = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 3)):
            w[at] = f"z{rng.integers(0, 5000)}"
        texts.append(" ".join(w))
    made, joined, write = [], [], ngram_join.Scratch.write

    def counted(self, df, name="t"):
        out = write(self, df, name)
        if name in ("tried", "passing"):  # what is verified
            made.append(out.count())
        if name == "rest":  # what the last join makes
            joined.append(out.count())
        return out

    monkeypatch.setattr(ngram_join.Scratch, "write", counted)
    got = ngram_join.near_duplicate_components(documents(spark, texts)).collect()
    _, root = brute_components(texts[:60])
    large = Counter(r.component_id for r in got).most_common(1)[0]
    assert large[0] == 0 and large[1] > 1000 and Counter(root).most_common(1)[0][0] == 0
    assert sum(made) < 2000 * 25, made
    assert sum(joined) < 2000 * 1999 / 2 / 20, joined


def test_ngram_pairs_grow_with_the_group(spark, monkeypatch):
    """Copies of one template, each with two random edits: pairs made and verified grow by a power below 1.3, components are those of brute force."""
    made, write = {}, ngram_join.Scratch.write

    def counted(self, df, name="t"):
        out = write(self, df, name)
        if name in ("tried", "passing", "rest"):
            made[size] = made.get(size, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join.Scratch, "write", counted)
    for size in (500, 2000):
        rng = np.random.default_rng(5)
        base, texts = [f"w{k}" for k in rng.integers(0, 2000, 60)], []
        for _ in range(size):
            w = list(base)
            for at in rng.integers(0, 60, 2):
                w[at] = f"z{rng.integers(0, 10**6)}"
            texts.append(" ".join(w))
        got = {r.doc_id: r.component_id for r in ngram_join.near_duplicate_components(documents(spark, texts)).collect()}
        sets = [{tuple(t.split()[k : k + 5]) for k in range(56)} for t in texts]
        root = np.arange(size)
        for a in range(size):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                    x, y = sorted((root[a], root[b]))
                    root[root == y] = x
        assert [got[k] for k in range(size)] == root.tolist()
    power = np.log(made[2000] / made[500]) / np.log(4)
    print("pairs made and verified", made, "power", power)
    assert power < 1.3, made


def test_ngram_odd_ids(spark):
    df = spark.createDataFrame([(5, prose(1, 20)), (5, prose(1, 20)), (None, prose(1, 20)), (7, prose(1, 20)), (8, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in ngram_join.near_duplicate_components(df).collect())
    assert got == {(5, 5): 2, (None, None): 1, (7, 5): 1, (8, 8): 1}
    assert ngram_join.near_duplicate_components(df.where("false")).count() == 0


# ---- letters, long texts and long contexts


def test_language_of_texts_without_letters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = ["²½ 12", "½", "Ⅷ", "①", "́", "_", "٣", "ª", "²½ 12 é"]
    got = language_id.predict(documents(spark, texts, True), language_id.fit(docs)).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in got] == [True] * 7 + [False] * 2
    assert all(r.score == 0 for r in got[:7])


def test_chat_ids_are_those_of_the_whole_text(spark):
    import base64

    import tiktoken

    with open(chat_format.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("own", pat_str=r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=ranks, special_tokens={})
    texts = ["word " * 1000, "".join(f"x{k} é" for k in range(25_000)), "a" * 100_000, " " * 9000 + "b", "\\ </turn> ### User: " * 3000]
    df = spark.createDataFrame([(k, 0, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.ids for r in chat_format.encode_turns(df).collect()}
    assert all(got[k] == plain.encode_ordinary(chat_format.escape(t)) for k, t in enumerate(texts))


def test_pii_contexts_of_any_length(spark):
    """A word of 200 characters, and one 20 marks away, are part of the pattern."""
    word, far = "k" * 200, "!?" * 10
    rows = [(k, f"x {word} abc{k}def99 y", "") for k in range(2)] + [(2, f"token{far}zz12345z", ""), (3, f"other{far}zz12345z", "")]
    df = spark.createDataFrame(rows, "key long, text string, b string").withColumn("base", F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)"))
    got = {r.key: r.pattern for r in pii.candidates(df).collect()}
    assert got[0].startswith(word + "| |") and got[0] == got[1]
    assert got[2].startswith(f"token|{far}|") and got[3].startswith(f"other|{far}|")
