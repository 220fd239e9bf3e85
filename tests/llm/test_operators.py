"""The corpus operators against plain versions, and on odd inputs: nulls, empty and very long texts, ties, repeated rows, no rows, clashing columns."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from lodestone.llm import decontamination, exact_dedup, language_id, lm_scoring, mixing, pii, simhash, token_output, toxicity, url_filter

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, host string, copy int, fp long"


def text(seed: int, n: int = 60) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeated rows, a very long text, and columns whose names the operators use."""
    rows = [(1, text(1)), (2, None), (3, ""), (4, " \t\n"), (5, text(1)), (5, text(1)), (None, text(2)), (None, None), (7, text(3, 30_000)), (8, "x" * 5000), (9, "\U0001f600 1234"), (10, text(2))]
    return spark.createDataFrame([(i, t, "en", "s", None, 0.0, "h", 1, 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup_odd(odd, none):
    got = exact_dedup.dedup_against(odd.limit(0), odd).collect()
    assert len(got) == 12 and sum(r["kept"] for r in got) == 7
    by = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got}
    assert {(1, 1, 3), (5, 1, 3), (2, 2, 3), (3, 2, 3), (None, 2, 3), (10, 10, 2), (None, 10, 2), (4, 4, 1)} <= by
    assert exact_dedup.dedup_against(none, none).count() == 0


def test_exact_dedup_across_snapshot(odd):
    both = exact_dedup.dedup_against(odd.where("doc_id <= 4"), odd.where("doc_id > 4 or doc_id is null")).collect()
    whole = exact_dedup.dedup_against(odd.limit(0), odd).collect()
    key = lambda r: (str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"])
    assert sorted(map(key, both)) == sorted(map(key, whole))


@pytest.mark.parametrize("n", [0, 1, 3, 500, 20_000])
def test_fuse_filter(n):
    r = np.random.default_rng(n)
    keys = r.integers(0, 1 << 63, n, dtype="u8")
    blob = exact_dedup.build_filter(keys)
    assert exact_dedup.may_hold(blob, keys).all()
    assert exact_dedup.may_hold(blob, r.integers(0, 1 << 63, 20_000, dtype="u8")).mean() < 0.01


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), set()).add(n)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("shard", [4, 64, 2048])
def test_links_match_brute_force(spark, shard):
    r = random.Random(shard)
    fps = set()
    for _ in range(4):
        base = r.getrandbits(64)
        for _ in range(60):
            fp = base
            for _ in range(r.randrange(6)):
                fp ^= 1 << r.randrange(64)
            fps.add(fp - (1 << 64) if fp >> 63 else fp)
    prints = spark.createDataFrame([(0, x, x) for x in fps], "k int, fp long, node long")
    got = [(e["a"], e["b"]) for e in simhash.link_forest(prints, shard).collect()]
    want = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert components(fps, got) == components(fps, want)


def test_simhash_odd(odd, none):
    got = simhash.near_duplicates(odd).collect()
    by = {(r["doc_id"], r["component_id"]) for r in got}
    assert len(got) == 12 and {(1, 1), (5, 1), (2, 2), (3, 2), (4, 2), (None, 2), (None, 10), (10, 10)} <= by
    assert {r["fingerprint"] for r in got if r["doc_id"] in (2, 3, 4)} == {"0" * 16}
    assert simhash.near_duplicates(none).count() == 0


def test_near_copies_go_and_others_stay(spark, odd, none):
    base = [text(i, 300) for i in range(20)]
    near = [" ".join("changed" if k == 150 else w for k, w in enumerate(t.split())) for t in base]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(base + near)], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert set(range(20)) <= kept and len(kept) <= 21
    stay = simhash.drop_near_duplicates(odd)
    assert stay.columns == odd.columns and stay.count() == 9  # five without words, and a row of each of four texts
    assert simhash.drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize("bucket", [2, 1024])
def test_near_copies_by_jaccard(spark, monkeypatch, bucket):
    """Whatever is at 0.8 or more to another text goes, nothing else: one word in 50 or 40 changed, or so many that 0.8 isn't reached; long and short."""
    monkeypatch.setattr(simhash, "BUCKET", bucket, raising=False)
    r = random.Random(1)
    docs, pairs = [], {True: 0, False: 0}
    for i in range(60):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([50, 100, 400]))]
        docs.append(words)
        for step in (50, 40, 25, 18):
            docs.append([f"x{i}" if k % step == step // 2 else w for k, w in enumerate(words)])
    sets = [set(zip(*[d[i:] for i in range(5)])) for d in docs]
    alike = [(a, b) for a in range(len(docs)) for b in range(a + 1, len(docs)) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for a, b in alike:
        pairs[a // 5 == b // 5] += 1
    assert pairs[True] > 100 and not pairs[False]
    want = {min(g) for g in components(range(len(docs)), alike)}
    table = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(3)
    assert {x["doc_id"] for x in simhash.drop_near_duplicates(table).collect()} == want


def plain_contamination(docs, items, window=10):
    wins = {}
    for item, t in items:
        w = decontamination.words_of(t)
        if w and item is not None:
            for i in range(max(len(w) - window, 0) + 1):
                wins.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for t in docs:
        w, hit, found = decontamination.words_of(t), set(), set()
        for m in {len(x) for x in wins}:
            for i in range(len(w) - m + 1):
                if (k := tuple(w[i : i + m])) in wins:
                    hit |= set(range(i, i + m))
                    found |= wins[k]
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_decontamination_matches_brute_force(spark, none):
    items = [(1, text(100, 25)), (2, text(101, 10)), (3, "Rare SHORT item"), (4, None), (5, "  "), (6, "one"), (7, text(100, 25)), (None, text(102, 12)), (8, "a a a a a a a a a a a a")]
    docs = [text(100, 25), "x " + text(100, 14) + " y", text(101, 9), "the rare short ITEM, twice: rare, short item", None, "", "One", "a " * 30, text(103, 80) + " " + text(101, 10)]
    d = spark.createDataFrame([(i, t, i) for i, t in enumerate(docs)], "doc_id long, text string, __row int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontamination.contamination(d, b).collect())
    assert got == [(i, *x) for i, x in enumerate(plain_contamination(docs, items))]
    assert decontamination.contamination(none, b).count() == 0
    assert decontamination.contamination(d, b.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.decontaminate(d.drop("__row"), b).count() == sum(not x[1] for x in plain_contamination(docs, items))


def test_tokens_round_trip(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_output.default_tokenizer())
    out = f"file://{tmp_path}/tokens"
    manifest = token_output.write_tokens(odd, out, shard_rows=4)
    got = token_output.read_tokens(spark, out, manifest, with_ids=True).orderBy("start").collect()
    want = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    start = 0
    for g, (i, x) in zip(got, want, strict=True):
        assert g["doc_id"] == i and g["start"] == start
        assert zlib.crc32(np.array(g["ids"], "<u4").tobytes()) == g["ids_crc32"] and g["ids"][-1] == 2
        start += g["n_tokens"]
    assert sorted(map(tuple, (g["ids"] for g in got))) == sorted(tuple(t.encode(x or "", add_special_tokens=False).ids) + (2,) for _, x in want)
    doc_id, ids = token_output.read_document(out, manifest[-1]["shard"], 0)
    assert any(g["doc_id"] == doc_id and g["ids"] == ids.tolist() for g in got)
    assert token_output.tokenize_and_read(none).count() == 0


def test_token_dictionary_knows_whole_texts(spark):
    """What stands at the end of long texts trains the dictionary too."""
    t = token_output.default_tokenizer()
    ending = text(7, 400)
    docs = spark.createDataFrame([(i, text(1000 + i, 8000) + " " + ending) for i in range(40)], "doc_id long, text string")
    zdict = token_output.train_dictionary(docs, t)
    ids = token_output.encoder(t).encode(" " + ending)
    assert any(ids[i : i + 160] in zdict for i in range(0, len(ids) - 160, 4))


def test_encoder_matches_library():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(token_output.default_tokenizer()), token_output.WordEncoder(token_output.default_tokenizer())
    r = random.Random(5)
    letters = "abzAZéßÉñ'.,!0 9\n\t\r  sS<|>_-İςΣ中 ́\x1c "
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(3000)] + ["it's <|endoftext|> x<|startoftext|>y", "", "don't They'LL"]
    for x in texts:
        assert np.frombuffer(e.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_language_id(spark, odd, none):
    en, de = ["the house and the garden are there with this thing"] * 5, ["der garten und das haus sind dort mit dieser sache"] * 5
    rows = [(i, t, k) for i, (t, k) in enumerate([(t, "en") for t in en] + [(t, "de") for t in de] + [("12", "en"), (None, "de"), ("text", None)])]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    ask = spark.createDataFrame([(1, "the garden"), (2, "das haus"), (3, None), (4, ""), (5, "12 !?"), (6, "x" * 3000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(ask, model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] != "und"
    assert language_id.predict(odd, model).count() == 12 and language_id.predict(none, model).count() == 0
    assert language_id.predict(ask, language_id.fit(none)).where("lang_pred != 'und'").count() == 0
    assert language_id.keep_languages(ask, model, ["en"]).columns == ask.columns


def test_forward_sums_all_segmentations():
    model = language_id.train({"a": {"banana": 3, "band": 1}, "b": {"cab": 2}}, language_id.default_vocabulary(), rounds=1)
    vocab = language_id.pieces(model.path)

    def all_ways(s):
        if not s:
            return np.ones(2)
        total = np.zeros(2)
        for k in range(1, len(s) + 1):
            if s[:k] in vocab or k == 1:
                total += model.prob[vocab.get(s[:k], -1)] * all_ways(s[k:])
        return total

    for w in ("banana", "é中x", "zq"):
        assert np.allclose(model.score_words([w])[0], np.log(all_ways(language_id.MARK + w)))


def test_toxicity(spark, odd, none):
    r = random.Random(3)
    bad = ["scumbag", "worthless", "disgusting"]
    rows = [(i, " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(80)) + (f" {r.choice(bad)} {r.choice(bad)} " + text(i, 10) if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id < 300"), labels)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs.where("doc_id >= 300"), model).collect()}
    assert np.mean([(s >= 0.5) == (i % 4 == 0) for i, s in got.items()]) > 0.9
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == 12 and all(0 <= x["score"] <= 1 for x in scored)
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_toxicity_ordinary_texts_by_hash():
    """Which ordinary texts train the dictionary doesn't depend on the order of the rows, and the bound holds."""
    rows = [(text(i, 60), 0, True) for i in range(300)] + [(text(i, 20) + " scumbag worthless", 1, True) for i in range(300, 340)]
    bound = sum(len(t) for t, label, _ in rows if not label) // 3
    a, b = (toxicity.train(iter(x), bound) for x in (rows, rows[::-1]))
    assert a.ordinary == b.ordinary
    chosen = [toxicity.Chosen(bound) for _ in range(2)]
    for c, part in zip(chosen, (rows, rows[::-1])):
        for t, _, _ in part:
            c.add(t)
    texts = chosen[0].texts()
    assert texts == chosen[1].texts() and bound <= sum(map(len, texts)) < bound + max(map(len, texts))
    assert texts[:5] != [t for t, _, _ in rows[:5]]


def test_pii_spans(odd, none):
    t = "mail a.b@c.de, ip 1.2.3.4 card 4111 1111 1111 1111 call +49 (30) 1234567 GB82 WEST 1234 5698 7654 32 ssn 123-45-6789, 123.300.1.1"
    found = [(k, t[s:e]) for k, s, e, _ in pii.spans_of(t)]
    assert found == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 1234567"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789")]
    assert pii.personal_data(odd).count() == 12 and pii.personal_data(none).count() == 0
    assert pii.redact(odd).columns == odd.columns


def test_pii_neighbours_and_context_after():
    def kept(t):
        return [(k, t[s:e]) for k, s, e, _ in pii.spans_of(t) if k in ("iban", "ssn", "imei")]

    gb, de = "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"
    assert kept(f"{gb} {de}") == [("iban", gb), ("iban", de)] and kept(f"{de} {gb} {de}") == [("iban", de), ("iban", gb), ("iban", de)]
    assert kept(f"AB12 CDEF GHIJ {gb} END") == [("iban", gb)]
    assert kept("123-45-6789 is the social security number") == [("ssn", "123-45-6789")] and kept("490154203237518, the imei") == [("imei", "490154203237518")]
    assert kept("123-45-6789" + " and so on" * 5 + " ssn") == []


def test_url_filter_odd(spark):
    urls = [None, "", "nohost", "https://EXAMPLE.org/es/x?q=1#f", "https://a.example.org/en/12", "http://b.com/de/?x", "http://b.com/fr/", "ftp://x.org", "http://notorg/", "http://c.net/a//b?u=1&v=2", "http://b.com/de/?x"]
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, suffix int")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert [got[i]["rule"] for i in range(11)] == [None, None, None, "example.org/es/", "example.org/en/1", "com/de/", "com/fr/", None, None, None, "com/de/"]
    assert got[3]["host"] == "example.org" and got[3]["path"] == "/es/x" and got[0]["host"] == got[2]["path"] == ""
    assert {r["verdict"] for r in got.values()} <= {"allow", "block"} and got[7]["path"] == ""
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_mixing(spark, odd, none):
    docs = spark.createDataFrame([(i, f"t{i}", "big" if i < 3000 else "small") for i in range(4000)], "doc_id long, text string, source string")
    n = {r["source"]: r["count"] for r in mixing.mix(docs, {"big": 1, "small": 1}).groupBy("source").count().collect()}
    assert abs(n["big"] - 2000) < 200 and abs(n["small"] - 2000) < 200
    assert mixing.mix(docs, {"small": 1}).where("source = 'big'").count() == 0
    again = [sorted(map(tuple, mixing.mix(docs).select("doc_id", "copy").collect())) for _ in range(2)]
    assert again[0] == again[1]
    assert "rate" in mixing.mix(odd).columns and mixing.mix(none).count() == 0
    big = spark.createDataFrame([(1, "x", "one")], "doc_id long, text string, source string")
    assert 850 < mixing.mix(big, epochs=1000.0).count() < 1150


def test_lm_scores(spark, odd, none):
    docs = spark.createDataFrame([(i, text(i) if i % 2 else " ".join(reversed(text(i).upper().split("a")))) for i in range(40)], "doc_id long, text string")
    ids = lm_scoring.encoded(docs)
    place = lm_scoring.fit(ids, spark.createDataFrame([(i,) for i in range(40) if i % 2] + [(None,)], "doc_id long"))
    got = {r["doc_id"]: r for r in lm_scoring.score(ids, place).collect()}
    assert np.mean([got[i]["score"] for i in range(1, 40, 2)]) < np.mean([got[i]["score"] for i in range(0, 40, 2)])
    odd_scores = lm_scoring.score(lm_scoring.encoded(odd), place).collect()
    assert len(odd_scores) == 12 and all(r["score"] == 0 for r in odd_scores if not r["n_tokens"])
    assert lm_scoring.score(lm_scoring.encoded(none), lm_scoring.fit(lm_scoring.encoded(none), docs.select("doc_id"))).count() == 0


@pytest.mark.parametrize("resident", [None, 0])
def test_lm_counts_are_exact(spark, resident):
    """Scores against plain counts by pair, with more pairs than a table of a fixed size keeps apart."""
    r = np.random.default_rng(1)
    docs = [r.integers(0, 60_000, 20_000) for _ in range(16)] + [np.array([5]), np.zeros(0, "i8"), np.array([0, 0, 0, 65_535, 65_535])]
    frame = spark.createDataFrame([(i, bytearray(d.astype("<u4").tobytes())) for i, d in enumerate(docs)], "doc_id long, ids binary")
    place = lm_scoring.fit(frame, spark.createDataFrame([(i,) for i in range(0, 19, 2)], "doc_id long"))
    got = {x["doc_id"]: x for x in lm_scoring.score(frame, place, *([] if resident is None else [resident])).collect()}
    models = []
    for part in (docs[::2], docs):
        uni, bi = {}, {}
        for d in part:
            for x in d.tolist():
                uni[x] = uni.get(x, 0) + 1
            for x in zip(d.tolist(), d[1:].tolist()):
                bi[x] = bi.get(x, 0) + 1
        models.append((uni, bi, sum(uni.values())))
    for i, d in enumerate(docs):
        for (uni, bi, total), column in zip(models, ("target_loss", "background_loss")):
            loss, before = 0.0, None
            for x in d.tolist():
                p = uni.get(x, 0) / total * (1 - lm_scoring.UNIFORM) + lm_scoring.UNIFORM / lm_scoring.IDS
                if uni.get(before):
                    p = lm_scoring.BIGRAM * min(bi.get((before, x), 0) / uni[before], 1.0) + (1 - lm_scoring.BIGRAM) * p
                loss, before = loss - np.log(p), x
            assert got[i][column] == pytest.approx(loss / max(len(d), 1), abs=1e-5)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, text(i, 120) + f" unique{i}", "en", "s" if i % 3 else None, 1) for i in range(30)] + [(30, text(3, 120) + " unique3", "en", "s", 1), (31, "123 456", "en", "s", 1), (32, None, None, None, None), (33, text(500, 40), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text(500, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert kept[0] == set(range(34)) - {31, 32} and kept[1] == kept[0] - {30} and kept[2] == kept[1] - {33}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} <= kept[2]
